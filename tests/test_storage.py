import random

from pyspark.sql import functions as F

from heddle.operators.reconcile import append_version
from heddle.sources import runs
from heddle.sources.store import CausalStore
from heddle.streaming import ingest
from heddle.streaming.ingest import reconcile_stream, run_to_end


def test_compaction_keeps_the_newest(spark, tmp_path):
    tables = {1: [("a", "a1")], 2: [("a", "a2"), ("b", "b2")], 3: [("b", "b3"), ("c", "c3")]}
    paths = {}
    for number, entries in tables.items():
        paths[number] = str(tmp_path / f"run{number}")
        runs.write_run(spark.createDataFrame(entries, "key string, data string"), paths[number])
    merged = str(tmp_path / "merged")
    runs.compact(runs.read_runs(spark, paths), ["run"], ["data"], merged)
    assert sorted(map(tuple, spark.read.parquet(merged).collect())) == [("a", "a2"), ("b", "b3"), ("c", "c3")]


def test_point_reads_reach_the_reader(spark, tmp_path):
    path = str(tmp_path / "run")
    runs.write_run(spark.range(1000).select(F.lpad(F.col("id").cast("string"), 6, "0").alias("key"), "id"), path, files=3)
    plan = spark.read.parquet(path).where("key = '000123'")._jdf.queryExecution().toString()
    assert "EqualTo(key,000123)" in plan


def test_manifest_and_plan(spark):
    changes = spark.createDataFrame(
        [(1, "created", 10, 0, 0, []), (2, "flushed", 10, 0, 5, []), (3, "flushed", 11, 0, 5, []), (4, "merged", 12, 1, 9, [10, 11]), (5, "flushed", 13, 0, 4, []), (6, "flushed", 14, 0, 4, [])],
        "seq bigint, kind string, id bigint, level int, size bigint, removed array<bigint>",
    )
    active = runs.manifest(changes)
    assert sorted(r.id for r in active.collect()) == [12, 13, 14]
    assert [tuple(r) for r in runs.compaction_plan(active, [(0, 2, None, 1), (1, 2, 1, 1)]).collect()] == [(0, 1, 2, 8)]
    assert runs.compaction_plan(active, [(0, 10, 100, 1)]).count() == 0


def test_store(spark, tmp_path):
    store = CausalStore(spark, str(tmp_path / "log"))
    first = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "", "bad")], "seq bigint, key string, data string")
    assert sorted((r.seq, r.status) for r in store.put(first, F.lit(1)).collect()) == [(1, "ok"), (2, "ok"), (3, "invalid")]
    other = spark.createDataFrame([(4, "a", "concurrent")], first.schema)
    store.put(other, F.lit(2))
    read = store.get(spark.createDataFrame([("a",), ("missing",)], "key string"))
    assert {r.data for r in read.collect()} == {"x", "concurrent"}
    context = read.first().context
    assert context == {1: 1, 2: 1}
    gone = spark.createDataFrame([(5, "a", context)], "seq bigint, key string, version map<bigint,bigint>")
    assert [r.status for r in store.delete(gone, F.lit(1)).collect()] == ["ok"]
    read = store.get(spark.createDataFrame([("a",)], "key string")).collect()
    assert [(r.key, r.seq, r.data, r.context) for r in read] == [("a", None, None, {1: 2, 2: 1})]
    # Without the context a deleted key cannot be written again, and the store says so; with it, it can.
    assert [r.status for r in store.put(spark.createDataFrame([(6, "a", "lost")], first.schema), F.lit(1)).collect()] == ["obsolete"]
    again = spark.createDataFrame([(7, "a", "back", read[0].context)], "seq bigint, key string, data string, version map<bigint,bigint>")
    assert [r.status for r in store.put(again, F.lit(1)).collect()] == ["ok"]
    assert [(r.data, r.context) for r in store.get(spark.createDataFrame([("a",)], "key string")).collect()] == [("back", {1: 3, 2: 1})]
    store.delete(spark.createDataFrame([(8, "a", {1: 3, 2: 1})], gone.schema), F.lit(2))
    assert [r.key for r in store.scan("a", "z").collect()] == ["b"]


def test_stream_equals_fold_over_batches(spark, tmp_path):
    schema = "seq bigint, key string, tombstone boolean, version map<bigint,bigint>"
    writes = [(1, "k", False, {1: 1}), (2, "k", False, {2: 1}), (3, "k", False, {1: 1}), (4, "k", False, {1: 2, 2: 1}), (5, "k", True, {3: 1})]
    for n, row in enumerate(writes):
        spark.createDataFrame([row], schema).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    run_to_end(reconcile_stream(stream), str(tmp_path / "out"), str(tmp_path / "ck"))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 5
    assert {r.seq: r.accepted for r in out.collect()}[5] is False


def test_stream_holds_state_by_bucket(spark, tmp_path):
    schema = "seq bigint, key string, tombstone boolean, version map<bigint,bigint>"
    rng = random.Random(3)
    names = [None, "null", "", *(f"k{i}" for i in range(40))]
    rows = [(n * 37 % 500, rng.choice(names), rng.random() < 0.2, {i: rng.randint(1, 4) for i in range(rng.randint(1, 3))}) for n in range(500)]
    writes = spark.createDataFrame(rows, schema).repartition(3)
    ingest.write_in_order(writes, F.floor(F.col("seq") / 60), str(tmp_path / "blocks"), str(tmp_path / "in"))
    files = sorted((tmp_path / "in").glob("*.parquet"), key=lambda f: f.stat().st_mtime_ns)
    assert [sorted({r.seq // 60 for r in spark.read.parquet(str(f)).collect()}) for f in files] == [[b] for b in range(9)]
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run_to_end(reconcile_stream(stream, 4), str(tmp_path / "out"), str(tmp_path / "ck"))
    want, siblings = {}, {}
    for seq, key, tombstone, version in sorted(rows, key=lambda r: r[0]):
        after = append_version(siblings.get(key, []), (version, tombstone, seq))
        want[seq] = (key, after is not None)
        siblings[key] = siblings.get(key, []) if after is None else after
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(out) == 500 and {r.seq: (r.key, r.accepted) for r in out} == want
    last = {r.key: r.siblings for r in sorted(out, key=lambda r: r.seq)}
    assert last == {k: ",".join(map(str, sorted(s[2] for s in v))) for k, v in siblings.items()}
    # A row of state, and a call to Python in each batch, for each bucket, not for each key.
    assert spark.read.format("statestore").load(str(tmp_path / "ck")).count() <= 4


def test_update_reads_again_after_a_conflict(spark, tmp_path):
    store = CausalStore(spark, str(tmp_path / "log"))
    schema = "seq bigint, key string, data string"
    store.put(spark.createDataFrame([(1, "a", "1"), (2, "b", "1")], schema), F.lit(1)).collect()
    keys = spark.createDataFrame([("a",), ("b",)], "key string")
    seen = []

    def change(read):
        seen.append({r.key: r.data for r in read.collect()})
        if len(seen) == 1:  # Another client uses the same coordinator on "a" meanwhile.
            store.put(spark.createDataFrame([(3, "a", "other", {1: 1})], f"{schema}, version map<bigint,bigint>"), F.lit(1)).collect()
        return read.select((F.lit(10 * len(seen)) + F.ascii("key")).cast("bigint").alias("seq"), "key", F.concat("data", F.lit("+")).alias("data"))

    got = sorted((r.key, r.attempt, r.status) for r in store.update(keys, change, F.lit(1)).collect())
    assert got == [("a", 2, "ok"), ("b", 1, "ok")]
    assert seen == [{"a": "1", "b": "1"}, {"a": "other"}]
    assert {r.key: r.data for r in store.get(keys).collect()} == {"a": "other+", "b": "1+"}
