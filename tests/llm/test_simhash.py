import random
import time

import numpy as np
import pyarrow as pa
import xxhash

from heddle.llm import simhash
from heddle.llm.components import connected_components
from heddle.llm.shared import Stage


def brute_fingerprint(text):
    words = (text or "").translate({i: i + 32 for i in range(65, 91)}).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, bits=4):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                parent[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        least[find(i)] = min(x, least.get(find(i), x))
    return {x: least[find(i)] for i, x in enumerate(ids)}


def test_codewords_are_perfect():
    words = np.arange(1 << 14, dtype=np.int64) << 5
    code = simhash.nearest_codeword(words)
    assert code.min() >= 0 and code.max() < 1 << 12
    assert (np.bincount(simhash._remainders(np.arange(1 << 11, dtype=np.int64) ^ 0) * 0) == [1 << 11]).all()
    assert len({int(x) for x in simhash._ERRORS}) == 1 << 11  # each remainder has a pattern of its own


def test_four_bits_apart_share_a_key():
    rng = np.random.default_rng(2)
    fp = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    other = fp.copy()
    for i in range(len(other)):
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            other[i] ^= np.uint64(1) << np.uint64(b)
    sets = []
    for x in (fp, other):
        rows, keys = simhash.fuzzy_keys(x)
        own = [set() for _ in x]
        for r, k in zip(rows, keys, strict=True):
            own[r].add(int(k))
        sets.append(own)
    assert all(a & b for a, b in zip(*sets, strict=True))


def test_against_brute_force(documents):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "a b c d"), (None, "alone in here")]
    for i in range(40):
        base = rng.choices(words, k=rng.randint(5, 200))
        for copy in range(rng.randint(1, 4)):
            text = base[:]
            for _ in range(rng.randint(0, 2)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((100 + 10 * i + copy, " ".join(text)))
    rows.append((9000, "long " * 50_000))
    found = simhash.near_duplicates(documents(rows, extra=True)).collect()
    rows = [r for r in rows if r[0] is not None]
    fps = [brute_fingerprint(t) for _, t in rows]
    got = {r.doc_id: r for r in found if r.doc_id is not None}
    assert {i: got[i].fp % (1 << 64) for i, _ in rows} == {i: f for (i, _), f in zip(rows, fps, strict=True)}
    assert {i: got[i].component_id for i, _ in rows} == brute_components([i for i, _ in rows], fps)


def test_large_group_in_one_key(spark):
    rng = np.random.default_rng(8)
    base = int(rng.integers(0, 1 << 62))
    near = {base} | {base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (900, 2))}
    far = {int(x) for x in rng.integers(0, 1 << 62, 200)}
    fps = sorted(near | far)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    links = simhash.link_fingerprints(spark.createDataFrame([(x,) for x in signed], "fp bigint").repartition(4))
    found = {r.node: r.component for r in connected_components(links, Stage(spark, "t")).collect()}
    want = brute_components(signed, fps)
    assert {x: found.get(x, x) for x in signed} == {x: want[x] for x in signed}


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100), (201, 200), (200, 201), (202, 200), (202, 201)]
    found = connected_components(spark.createDataFrame(edges, "u bigint, v bigint"), Stage(spark, "t")).collect()
    assert {r.node: r.component for r in found} == {i: 0 for i in range(61)} | {200: 200, 201: 200, 202: 200}
    assert connected_components(spark.createDataFrame([], "u bigint, v bigint"), Stage(spark, "t")).count() == 0


def test_long_text_is_read_in_pieces(monkeypatch):
    rng = random.Random(1)
    text = " ".join("".join(rng.choices("abAB", k=rng.randint(1, 9))) for _ in range(3000)).encode()
    want = simhash.shingle_hashes(text, 4)
    monkeypatch.setattr("heddle.llm.shared._PIECE_BYTES", 300)
    assert (simhash.shingle_hashes(text, 4) == want).all() and len(want) == 2997
    assert len(simhash.shingle_hashes(b"x" * 5000, 4)) == 1 and len(simhash.shingle_hashes(b" \n" * 900, 4)) == 0


def test_text_of_many_megabytes(documents):
    text = "some words of a very long text " * 700_000  # over 20 MB
    found = {r.doc_id: r for r in simhash.near_duplicates(documents([(1, text), (2, text + "end"), (3, "short")])).collect()}
    assert found[2].component_id == 1 and found[3].component_id == 3


def shingle_set(text):
    words = text.lower().split()
    return {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def test_representatives_against_brute_force(documents):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(3000)]
    rows, n = [(1, "a b c d e f"), (2, None), (3, ""), (4, " \n"), (5, "one two"), (6, "ONE  two"), (7, "one two three"), (7, "one two three")], 10
    for _ in range(60):
        base = rng.choices(words, k=rng.randint(100, 300))
        for _ in range(rng.randint(1, 5)):
            text = base[:]
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((n, " ".join(text)))
            n += 1
    sets = [shingle_set(t or "") for _, t in rows]
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    kept = simhash.representatives(documents(rows).selectExpr("*", "'x' AS _kept_id", "'y' AS _row", "1 AS mark"))
    assert kept.columns[-3:] == ["_kept_id", "_row", "mark"]
    ids = [r.doc_id for r in kept.collect()]
    least = {g: min(i for (i, _), x in zip(rows, group, strict=True) if x == g) for g in set(group)}
    assert set(ids) >= set(least.values()) and len(ids) == len(set(ids))  # no group is lost
    assert len(ids) <= len(least) + 0.1 * (len(rows) - len(least))  # keys miss few links of 0.8


def test_no_link_at_the_threshold_is_missed(documents, monkeypatch):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(5000)]
    passage = rng.choices(words, k=60)
    rows, n = [], 1
    for g in range(70):
        base = rng.choices(words, k=200)
        if g % 2:
            base[40:100] = passage  # shingles of many documents
        for k in (0, 4, 4):  # 20 of some 216 shingles go, a similarity of 0.815
            text = base[:]
            for place in range(k):
                text[20 + 40 * place + rng.randrange(8)] = f"x{n}-{place}"
            rows.append((n, " ".join(text)))
            n += 1
    sets = [shingle_set(t) for _, t in rows]
    first = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                first = [first[j] if f == first[i] else f for f in first]
    want = {min(rows[i][0] for i, f in enumerate(first) if f == x) for x in set(first)}
    assert 70 <= len(want) < 100
    assert {r.doc_id for r in simhash.representatives(documents(rows)).collect()} == want
    monkeypatch.setattr(simhash, "_COMMON", 1 << 20)  # whatever counts as common, groups are the same
    assert {r.doc_id for r in simhash.representatives(documents(rows)).collect()} == want


def test_a_shared_passage_makes_no_pairs(documents, monkeypatch):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(20000)]
    passage, rows = rng.choices(words, k=150), []
    for n in range(150):  # 150 of some 210 words are those of all others
        rows.append((n, " ".join(passage + rng.choices(words, k=60))))
        if n % 10 == 0:
            text = rows[-1][1].split()
            for place in (40, 80, 120, 195):
                text[place] = "x"
            rows.append((1000 + n, " ".join(text)))
    made, table = {}, Stage.table

    def counted(self, df, name, by=None):
        out = table(self, df, name, by)
        made[name] = out.count()
        return out

    monkeypatch.setattr(Stage, "table", counted)
    assert sorted(r.doc_id for r in simhash.representatives(documents(rows)).collect()) == list(range(150))
    assert made["met"] <= len(rows)  # they were 13,515


def test_folded_parity_bits_lose_no_similar_pair():
    rng = np.random.default_rng(9)
    sets, near = [], []
    for n in (1, 5, 30, 33, 130, 600, 2500, 20000):
        for _ in range(6):
            base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            gone = n // 9  # of either set: a similarity of 0.8
            near.append((len(sets), len(sets) + 1))
            sets += [base, np.concatenate([base[gone:], rng.integers(0, 1 << 63, gone, dtype=np.uint64)])]
    sizes = np.array([len(x) for x in sets])
    folds = np.array([simhash._folded(simhash._parity(x)) for x in sets], object)
    assert max(map(len, folds)) == simhash._FOLD_BYTES
    fit = simhash._folds_fit(folds, sizes, 0.8)
    assert fit(np.array(near).T).all()
    other = np.array([(a, b) for a in range(len(sets)) for b in range(a) if 30 < sizes[a] < 1000 and 0.8 * sizes[a] <= sizes[b] <= sizes[a] / 0.8 and a // 2 != b // 2]).T
    assert other.shape[1] > 100 and not fit(other).any()


def test_shuffle_files_go_once_a_table_is_written(spark):
    kept = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ").count("shuffle_")
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = kept(), spark.conf.get(key)
    made = Stage(spark, "t").table(spark.range(5000).repartition(4, "id"), "x")
    deadline = time.time() + 20
    while kept() > before and time.time() < deadline:
        time.sleep(0.1)
    assert kept() <= before and spark.conf.get(key) == setting and made.count() == 5000


def test_pairs_under_keys_against_brute_force(monkeypatch):
    rng = np.random.default_rng(5)
    rows = sorted({(int(k), int(x)) for k, x in zip(rng.integers(0, 40, 3000) ** 2 // 300, rng.integers(0, 400, 3000), strict=True)})
    key, node = (np.array(c, np.int64) for c in zip(*rows, strict=True))
    label, size = node % 7 * (node % 3 > 0), (50 + node % 60).astype(np.int32)
    want = {
        (u, v) for (k, u) in rows for (m, v) in rows
        if k == m and u < v and u % 7 * (u % 3 > 0) != v % 7 * (v % 3 > 0) and min(50 + u % 60, 50 + v % 60) >= 0.8 * max(50 + u % 60, 50 + v % 60)
    }
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in (key, node, label, size)], ["shingle", "node", "label", "size"])
    for step in (1, 7, 100, 5000):
        for most in (50, 1 << 20):
            monkeypatch.setattr(simhash, "_PAIRS", most)
            found = simhash._pairs_under_keys(0.8)(batch.slice(at, step) for at in range(0, len(key), step))
            assert {(u, v) for b in found for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)} == want


def test_spanning_forest_connects_what_is_close():
    rng = np.random.default_rng(3)
    fp = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) for c in rng.integers(0, 1 << 62, 4, dtype=np.uint64)]))
    links = simhash._spanning_forest(fp, 6)
    assert all(0 < (a ^ b).bit_count() <= 6 for a, b in links)
    a, b = np.triu_indices(len(fp), 1)
    near = np.bitwise_count(fp[a] ^ fp[b]) <= 6
    a, b = a[near], b[near]
    keep = simhash._spanning_links(a, b, simhash._weights(fp[a], fp[b]))
    assert {frozenset(x) for x in links} == {frozenset((int(fp[x]), int(fp[y]))) for x, y in zip(a[keep], b[keep], strict=True)}
    assert len(fp) - len(links) == len(set(brute_components([int(x) for x in fp], [int(x) for x in fp], 6).values()))


def test_empty_and_representatives(documents):
    assert simhash.near_duplicates(documents([])).count() == 0
    df = documents([(3, "a b c d e f"), (1, "A b c d e f"), (2, "quite another text with words of its own")])
    kept = simhash.representatives(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2]
