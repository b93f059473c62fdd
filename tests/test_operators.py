import pytest
from pyspark.sql import functions as F

from heddle.functions import scalars
from heddle.operators import crdt, index, membership, replicas
from heddle.operators.log import coordinated, previous, running_counts, validated

VALUES = "key string, replica int, seq bigint, version map<bigint,bigint>, tombstone boolean"


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize(("level", "needed"), [("one", 1), ("two", 2), ("quorum", 5), ("all", 9), ("QUORUM", 5), ("what", 1)])
def test_levels(spark, level, needed):
    assert spark.range(1).select(scalars.needed_acks(F.lit(level), F.lit(9))).first()[0] == needed


def test_register_bytes_round_trip(spark):
    df = spark.createDataFrame([(1700000000123, "héllo"), (0, ""), (-5, "x")], "ts bigint, value string")
    data = df.select("ts", "value", scalars.register_bytes(F.col("ts"), F.col("value")).alias("data"))
    for r in data.select("*", scalars.register_time(F.col("data")).alias("t"), scalars.register_value(F.col("data")).alias("v")).collect():
        assert (r.t, r.v) == (r.ts, r.value)
        assert bytes(r.data) == r.ts.to_bytes(8, "little", signed=True) + len(r.value.encode()).to_bytes(4, "little") + r.value.encode()


def test_merge_read_drops_all_dominated_values(spark):
    values = spark.createDataFrame([("k", 0, 1, {1: 1}, False), ("k", 1, 2, {2: 1}, False), ("k", 2, 3, {2: 2}, False)], VALUES)
    read = replicas.merged_read(values)
    assert {r.seq for r in read.collect()} == {1, 3} and read.first().merged == {1: 1, 2: 2}
    packed = values.coalesce(1).sortWithinPartitions("seq").groupBy("key").agg(F.collect_list(F.struct("version", "tombstone")).alias("v"))
    assert packed.select(F.size(replicas.compat_merge(F.col("v")))).first()[0] == 3  # the looser rule keeps {2: 1}


def test_repair_only_with_one_current_value(spark):
    values = spark.createDataFrame(
        [("a", 0, 1, {1: 1}, False), ("a", 1, 2, {1: 2}, False), ("b", 0, 3, {1: 1}, False), ("b", 1, 4, {2: 1}, False)], VALUES
    )
    asked = spark.createDataFrame([(k, r) for k in "ab" for r in range(3)], "key string, replica int")
    read = replicas.merged_read(values)
    old = replicas.stale(values, asked, read)
    assert rows(old) == [("a", 0), ("a", 2), ("b", 2)]
    assert [(r.key, r.replica, r.seq) for r in replicas.repairs(old, read).orderBy("replica").collect()] == [("a", 0, 2), ("a", 2, 2)]


def test_quorum_prefix_by_arrival(spark):
    replies = spark.createDataFrame([("a", 0, 9), ("a", 1, 1), ("a", 2, 5), ("b", 0, 1)], "key string, replica int, arrival int")
    assert rows(replicas.quorum_prefix(replies, F.lit(2))) == [("a", 1), ("a", 2)]


def test_registers(spark):
    df = spark.createDataFrame([("k", 1, 1, "a"), ("k", 2, 2, "b"), ("k", 2, 3, "c")], "key string, ts bigint, id bigint, value string")
    assert rows(crdt.merge_registers(df)) == [("k", 2, "c", True)]
    new = spark.createDataFrame([("k", 2, 9, "late"), ("n", 1, 1, "first")], df.schema)
    stored = spark.createDataFrame([("k", 2, 3, "c")], df.schema)
    assert rows(crdt.put_registers(stored, new).select("key", "value")) == [("k", "c"), ("n", "first")]


def test_sets(spark):
    ops = spark.createDataFrame(
        [(1, "x", "add", 1, 1), (1, "x", "remove", 2, 2), (1, "y", "add", 3, 3), (2, "y", "add", 1, 4), (2, "z", "add", 9, 5)],
        "key bigint, item string, op string, ts bigint, id bigint",
    )
    present = crdt.present_items(ops)
    assert rows(present) == [(1, "y"), (2, "y"), (2, "z")]
    assert rows(crdt.set_members(present)) == [(1, "y", 1), (2, "y,z", 2)]
    groups = spark.createDataFrame([("g", 1), ("g", 2)], "group string, key bigint")
    assert rows(crdt.set_intersection(present, groups)) == [("g", "y")]
    assert rows(crdt.present_items(ops, spark.createDataFrame([(2, 5)], "key bigint, ts bigint"))) == [(1, "y"), (2, "z")]


def test_ordered_keys(spark):
    table = spark.createDataFrame([(k, k) for k in "badceg"], "key string, value string")
    assert [r.key for r in index.scan(table).collect()] == list("abcdeg")
    assert [r.key for r in index.scan(table, "b", "d").collect()] == list("bcd")
    assert rows(index.upsert(table, spark.createDataFrame([("d", "new"), ("z", "z")], table.schema)))[3] == ("d", "new")
    assert index.remove(table, spark.createDataFrame([("a",), ("q",)], "key string")).count() == 5


@pytest.mark.parametrize("strict", [False, True])
def test_floor(spark, strict):
    keys = [3, 7, 100, 5000]
    probes = [-1, 0, 3, 4, 7, 99, 100, 101, 4999, 5000, 90000]
    found = index.floor_lookup(
        spark.createDataFrame([(p,) for p in probes], "probe bigint"), spark.createDataFrame([(k,) for k in keys], "key bigint"), F.floor(F.col("k") / 64), strict
    )
    want = {p: max((k for k in keys if (k < p if strict else k <= p)), default=None) for p in probes}
    assert {r.probe: r.floor for r in found.collect()} == want


def test_membership(spark):
    seen = spark.createDataFrame(
        [(1, 1, 5, 1), (1, 1, 5, 2), (2, 1, 9, 1), (2, 2, 1, 1), (3, 1, 2, 3), (3, 1, 8, 1)], "id bigint, run_id bigint, gen bigint, status int"
    )
    merged = membership.merge_states(seen)
    assert rows(merged) == [(1, 1, 5, 2), (2, 2, 1, 1), (3, 1, 8, 3)]
    assert membership.state_hash(merged).first()[0] == membership.state_hash(merged.repartition(3)).first()[0]
    assert {r.target for r in membership.pick_probers(merged, 2).collect()} <= {1, 2, 3}


def test_votes_are_not_inverted(spark):
    votes = spark.createDataFrame([(1, True), (1, True), (2, False), (3, True), (3, False)], "target bigint, healthy boolean")
    assert rows(membership.indirect_verdicts(votes)) == [(1, 2, "healthy"), (2, 1, "unhealthy"), (3, 2, "undecided")]


def test_log_helpers(spark):
    writes = spark.createDataFrame([("k", False, None), ("", False, None), ("k", True, None), (None, False, {1: 1})], "key string, tombstone boolean, version map<bigint,bigint>")
    assert [r.status for r in validated(writes).collect()] == [None, "invalid", "invalid", "invalid"]
    assert coordinated(writes.limit(1), F.lit(3)).first().version == {3: 1}
    many = spark.createDataFrame([("hot", i) for i in range(300)], "key string, n bigint")
    counted = running_counts(many, "key", "n", {"even": F.col("n") % 2 == 0}, block=16)
    assert {r.n: r.even for r in counted.collect()} == {i: i // 2 + 1 for i in range(300)}


def test_bloom_and_addresses(spark):
    bits, hashes, parts = spark.range(1).select(scalars.bloom_bits(F.lit(1000), 0.01), scalars.bloom_hashes(F.lit(1000), 0.01), scalars.addresses(F.lit(" a:1, ,b:2,"))).first()
    assert (bits, hashes, parts) == (9585, 6, ["a:1", "b:2"])


def test_blocks_carry_the_row_before_and_running_counts(spark):
    rows = [(n % 3, n, 1 + (n * n // 5) % 2) for n in range(0, 60, 2)]
    df = spark.createDataFrame(rows, "node bigint, seq bigint, status int")
    before = {(r.node, r.seq): r.was for r in previous(df, "node", "seq", "status", "was", block=5).collect()}
    for node, seq, _ in rows:
        earlier = [s for k, n, s in rows if k == node and n < seq]
        assert before[node, seq] == (earlier[-1] if earlier else None)
    gens = {(r.node, r.seq): r.gen for r in membership.generations(df).collect()}
    for node, seq, _ in rows:
        seen = [1, *(s for k, n, s in rows if k == node and n <= seq)]
        assert gens[node, seq] == sum(a != b for a, b in zip(seen, seen[1:], strict=False))


@pytest.mark.parametrize("strict", [False, True])
def test_floor_over_ranges_of_buckets(spark, strict):
    keys, probes = [7, 8, 5000, 12000, 20000], [0, 7, 8, 9, 4999, 5000, 11999, 20000, 30000]
    found = index.floor_lookup(
        spark.createDataFrame([(p,) for p in probes], "probe bigint"), spark.createDataFrame([(k,) for k in keys], "key bigint"), F.floor("k"), strict
    )
    want = {p: max((k for k in keys if k < p or (k == p and not strict)), default=None) for p in probes}
    assert {r.probe: r.floor for r in found.collect()} == want


def test_types_read_absent_keys_as_zero(spark):
    parts = spark.createDataFrame([("a", 1, 2), ("a", 1, 3), ("a", 2, 1)], "key string, node bigint, n bigint")
    keys = spark.createDataFrame([("a",), ("b",)], "key string")
    assert {r.key: r.n for r in crdt.counter_type().read(parts, keys).collect()} == {"a": 4, "b": 0}
    raised = crdt.counter_type().mutate(parts, lambda df: df.withColumn("modified", F.col("n") == 0).withColumn("n", F.col("n") + 1), keys)
    assert [tuple(r) for r in raised.collect()] == [("b", 1)]
