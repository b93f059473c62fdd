import base64
import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from heddle.llm import exact, mixing, warc


def test_exact_against_brute_force(documents):
    rows = [(5, "a  b"), (2, "a\tb"), (9, "a b"), (1, None), (3, ""), (4, " "), (7, "\n\n"), (8, "A b"), (6, "x" * 200_000), (10, "x" * 200_000), (None, "a b"), (2, "a\tb")]
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0d]+", " ", t or "")].append(i)
    want = []
    for i, t in rows:
        plain = re.sub(r"[\x20\x09-\x0d]+", " ", t or "")
        keep = min(x for x in groups[plain] if x is not None)
        want.append((str(i), keep, len(groups[plain]), i == keep, hashlib.sha256(plain.encode()).hexdigest()))
    for fan_in in (2, 8):
        found = exact.exact_dedup(documents(rows, extra=True), fan_in=fan_in)
        assert sorted((str(r.doc_id), r.keep_id, r.group_size, r.kept, r.text_sha256) for r in found.collect()) == sorted(want)


def test_exact_large_group_and_rows_kept(documents):
    df = documents([(i, "same") for i in range(500)] + [(1000 + i, f"text {i}") for i in range(100)] + [(0, "same")])
    sizes = Counter(r.group_size for r in exact.exact_dedup(df).collect())
    assert sizes == {501: 501, 1: 100}
    kept = exact.distinct_documents(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [0, *range(1000, 1100)]
    assert exact.exact_dedup(documents([])).count() == 0 == exact.distinct_documents(documents([])).count()


def brute_targets(sizes, weights=(5, 2, 1), times=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    cap = {s: times * sizes[s] for s in names}
    out, open_, left = {}, set(names), sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > cap[s]}
        if not full:
            return out | {s: level * weight[s] for s in open_}
        for s in full:
            out[s] = cap[s]
            left -= cap[s]
        open_ -= full
    return out


@pytest.fixture
def mixed_rows():
    rows = [(i, "w " * (1 + i % 13), None, ["b", "a", None, "é", "z", "c"][i % 6 if i % 3 else 4]) for i in range(600)]
    return [*rows, (700, None, None, "a"), (701, " ", None, "b"), (702, "", None, "only empty"), (703, "long " * 900, None, "a")]


def test_mix(documents, mixed_rows):
    df = documents(mixed_rows, extra=True)
    found = mixing.mix(df).collect()
    sizes, taken = Counter(), Counter()
    for r, source in [(r, {i: s for i, _, _, s in mixed_rows}[r.doc_id]) for r in found]:
        sizes[source] += r.size
        taken[source] += r.taken
        assert r.taken % max(1, r.size) == 0 and 0 <= r.taken <= 3 * r.size
    want = brute_targets(sizes)
    for r in found:
        source = {i: s for i, _, _, s in mixed_rows}[r.doc_id]
        assert r.target == pytest.approx(want[source]) and r.source_size == sizes[source]
    largest = max(r.size for r in found)
    assert all(abs(taken[s] - want[s]) <= largest for s in sizes)
    assert 0 <= sum(sizes.values()) - sum(taken.values()) <= 3 * largest
    assert sorted(map(tuple, found)) == sorted(map(tuple, mixing.mix(df.repartition(7)).collect()))
    copies = Counter(r.doc_id for r in mixing.mixed_documents(documents(mixed_rows)).collect())
    assert copies == {r.doc_id: r.taken // r.size for r in found if r.taken}


def test_mix_of_repeated_rows_and_clashing_names(documents):
    rows = [(1, "a b c", None, "s"), (1, "a b c", None, "s"), (1, "a b", None, "s"), (None, "d e", None, None), (None, "f g", None, "s"), (2, "w " * 5, None, "t")]
    df = documents(rows).selectExpr("*", "'x' AS _copies", "'y' AS _pass", "'z' AS _id", "1 AS taken")
    plan = Counter((r.doc_id, r.size, r.taken // r.size) for r in mixing.mix(df).collect())
    found = mixing.mixed_documents(df)
    assert found.columns == df.columns
    got = Counter((r.doc_id, len(r.text.split())) for r in found.collect())
    want = Counter()
    for (i, size, times), n in plan.items():
        want[i, size] += times * n
    assert got == +want


def test_targets_of_many_sources(documents):
    rows = [(i, "w " * (1 + i % 40), None, f"s{i % 97}" if i % 50 else None) for i in range(800)]
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(t.split())
    want = brute_targets(sizes)
    by_id = {i: s for i, _, _, s in rows}
    assert all(r.target == pytest.approx(want[by_id[r.doc_id]]) for r in mixing.mix(documents(rows)).collect())


def test_mix_of_nothing(documents):
    assert mixing.mix(documents([])).count() == 0
    assert [(r.size, r.taken) for r in mixing.mix(documents([(1, None), (2, "")])).collect()] == [(0, 0), (0, 0)]
    assert [(r.size, r.taken) for r in mixing.mix(documents([(1, "a b", None, "s")])).collect()] == [(2, 2)]


def brute_warc(pages, least=0):
    first = {}
    for i, _, html in pages:
        first[html or ""] = min(i, first.get(html or "", i))
    out = []
    for i, _, html in pages:
        body = (html or "").encode()
        again = len(body) >= least and first[html or ""] != i
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", first[html or ""] if again else None))
    return sorted(out)


@pytest.mark.parametrize("least", [0, 3])
def test_archive(spark, tmp_path, least):
    pages = [(3, "http://a", "<p>é</p>"), (1, None, "<p>é</p>"), (2, "http://b\r\nWARC-Type: x", None), (5, "u", ""), (4, "http://ü", "ab"), (6, "v", "ab"), (7, "w", "WARC/1.1\r\n\r\nx" * 9000), (-8, "n", "ab")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id bigint, url string, html string, key string").repartition(3)
    root = str(tmp_path / "archive")
    warc.write_archive(df, root, min_bytes=least)
    records = warc.read_archive(spark, root)
    for r in records.collect():
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        length = int(re.search(rb"\r\nContent-Length: (\d+)", head)[1])
        assert rest[length:] == b"\r\n\r\n"
        if b"WARC-Type: response" in head:
            assert rest[:length].partition(b"\r\n\r\n")[2] == bytes(r.payload)
    found = warc.parse_records(records)
    got = sorted((r.record_id, len(r.payload), r.payload_digest, r.record_type, r.refers_to) for r in found.collect())
    assert got == brute_warc(pages, least)
    payloads = spark.read.parquet(f"{root}/payloads")
    assert payloads.count() == payloads.select("key").distinct().count() == len({p[2] or "" for p in pages})


def test_archive_of_repeated_rows(spark, tmp_path):
    pages = [(1, "u", "same"), (1, "u", "same"), (1, "v", "other"), (2, "w", "same"), (2, "w", "same")]
    warc.write_archive(spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(3), str(tmp_path))
    found = warc.parse_records(warc.read_archive(spark, str(tmp_path))).collect()
    got = sorted((r.record_id, bytes(r.payload).decode(), r.record_type, r.refers_to) for r in found)
    assert got == [(1, "other", "response", None), (1, "same", "response", None), (1, "same", "response", None), (2, "same", "revisit", 1), (2, "same", "revisit", 1)]
    assert spark.read.parquet(f"{tmp_path}/payloads").count() == 2


def test_damage_is_noticed(spark, tmp_path):
    root = str(tmp_path / "archive")
    warc.write_archive(spark.createDataFrame([(1, "u", "text")], "page_id bigint, url string, html string"), root)
    spark.read.parquet(f"{root}/payloads").withColumn("payload", F.lit(b"other")).write.parquet(str(tmp_path / "other/payloads"))
    spark.read.parquet(f"{root}/headers").write.parquet(str(tmp_path / "other/headers"))
    with pytest.raises(Exception, match="does not match its digest"):
        warc.read_archive(spark, str(tmp_path / "other")).collect()


def test_empty_archive(spark, tmp_path):
    warc.write_archive(spark.createDataFrame([], "page_id bigint, url string, html string"), str(tmp_path / "a"))
    assert warc.parse_records(warc.read_archive(spark, str(tmp_path / "a"))).count() == 0
