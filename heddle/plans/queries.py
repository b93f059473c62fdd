"""Registered queries over the test tables, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.functions import scalars, vclock
from heddle.operators import crdt, index, membership, replicas
from heddle.operators.log import log_from_events, previous
from heddle.operators.reconcile import fold_writes, maximal_versions
from heddle.sources import runs
from heddle.sources.store import CausalStore
from heddle.streaming.ingest import reconcile_stream, run_to_end, write_in_order
from heddle.workspace import shared_dir, staged

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
#: Sequence numbers that a micro-batch of ``stream_ingest`` spans.
_STREAM_BLOCK = 1 << 20


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_from_events(_table(spark, sf_dir, "events"))


def _text(column: str = "version"):
    return vclock.to_string(F.col(column))


# SQL pieces: the write log of ``log_from_events`` with counters in columns, and the text of a version.
_LOG = """
l AS (
  SELECT seq, key, node, tombstone, CASE WHEN ctx OR node = 0 THEN c0 ELSE 0 END AS v0, CASE WHEN ctx OR node = 1 THEN c1 ELSE 0 END AS v1,
         CASE WHEN ctx OR node = 2 THEN c2 ELSE 0 END AS v2
  FROM (
    SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS key, event_id % 3 AS node, event_type = 'error' AS tombstone,
           event_type IN ('purchase', 'error') AS ctx,
           CAST(sum(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS c0,
           CAST(sum(CASE WHEN event_id % 3 = 1 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS c1,
           CAST(sum(CASE WHEN event_id % 3 = 2 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS c2
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)))"""


def _sql_text(a: str = "v0", b: str = "v1", c: str = "v2") -> str:
    parts = ", ".join(f"CASE WHEN {x} > 0 THEN '{i}=' || upper(to_base({x}, 36)) END" for i, x in enumerate((a, b, c)))
    return f"'{{' || concat_ws(',', {parts}) || '}}'"


_FOLD_STEPS = """
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS n FROM l),
f AS (
  SELECT key, n, seq, tombstone, true AS accepted, [{'seq': seq, 't': tombstone, 'a': v0, 'b': v1, 'c': v2}] AS state FROM r WHERE n = 1
  UNION ALL
  SELECT key, n, seq, t, ok, CASE WHEN ok THEN list_append(kept, w) ELSE state END FROM (
    SELECT *, NOT beaten AND NOT (t AND len(kept) > 0) AS ok FROM (
      SELECT r.key, r.n, r.seq, r.tombstone AS t, f.state, {'seq': r.seq, 't': r.tombstone, 'a': r.v0, 'b': r.v1, 'c': r.v2} AS w,
             len(list_filter(f.state, lambda x: r.v0 <= x.a AND r.v1 <= x.b AND r.v2 <= x.c)) > 0 AS beaten,
             list_filter(f.state, lambda x: NOT (x.a <= r.v0 AND x.b <= r.v1 AND x.c <= r.v2) AND NOT x.t) AS kept
      FROM f JOIN r ON r.key = f.key AND r.n = f.n + 1)))"""
_FOLD = f"WITH RECURSIVE {_LOG}, {_FOLD_STEPS}"
# The same log, but writes arrive up to 500 places late.
_LATE = _LOG.replace("\nl AS (\n  SELECT seq,", "\nl AS (\n  SELECT (seq + seq * 7919 % 500) * 1000000000 + seq AS seq,")
_LATE_FOLD = f"WITH RECURSIVE {_LATE}, {_FOLD_STEPS}"

_MAXIMAL = """
m AS (
  SELECT * FROM l WHERE NOT EXISTS (
    SELECT 1 FROM l o WHERE o.key = l.key AND o.v0 >= l.v0 AND o.v1 >= l.v1 AND o.v2 >= l.v2
      AND (o.v0 > l.v0 OR o.v1 > l.v1 OR o.v2 > l.v2 OR o.seq < l.seq)))"""


# -- version vectors ---------------------------------------------------------------


@query(f"WITH {_LOG} SELECT seq, key, {_sql_text()} AS version FROM l")
def vclock_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).select("seq", "key", _text().alias("version"))


@query(f"WITH {_LOG} SELECT seq, v0, v1, v2, true AS round_trip FROM l")
def vclock_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = _log(spark, sf_dir).select("seq", "version", vclock.from_string(_text()).alias("read"))
    counters = [F.coalesce(F.element_at("read", F.lit(i).cast("bigint")), F.lit(0)).alias(f"v{i}") for i in range(3)]
    return coded.select("seq", *counters, vclock.is_equal(F.col("version"), F.col("read")).alias("round_trip"))


@query(f"WITH {_LOG} SELECT seq, {_sql_text()} AS version FROM l")
def vclock_must_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts read with an error for any that is invalid, and written again."""
    return _log(spark, sf_dir).select("seq", vclock.to_string(vclock.checked(_text())).alias("version"))


@query(f"""
WITH {_LOG},
p AS (SELECT *, lag(v0) OVER w AS p0, lag(v1) OVER w AS p1, lag(v2) OVER w AS p2 FROM l WINDOW w AS (PARTITION BY key ORDER BY seq))
SELECT seq, key, CASE WHEN (p0 > v0 OR p1 > v1 OR p2 > v2) AND (p0 < v0 OR p1 < v1 OR p2 < v2) THEN 'concurrent'
  WHEN p0 > v0 OR p1 > v1 OR p2 > v2 THEN 'after' WHEN p0 < v0 OR p1 < v1 OR p2 < v2 THEN 'before' ELSE 'equal' END AS causality
FROM p WHERE p0 IS NOT NULL""")
def vclock_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each write's predecessor on its key against the write."""
    paired = previous(_log(spark, sf_dir), "key", "seq", "version", "before").where("before IS NOT NULL")
    return paired.select("seq", "key", vclock.compare(F.col("before"), F.col("version")).alias("causality"))


@query(f"WITH {_LOG} SELECT key, {_sql_text('max(v0)', 'max(v1)', 'max(v2)')} AS version FROM l GROUP BY key")
def vclock_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vclock.merge_all(_log(spark, sf_dir), ["key"], "version").select("key", _text().alias("version"))


@query(f"""
WITH {_LOG} SELECT seq, key, {_sql_text('v0 + (node = 0)::BIGINT', 'v1 + (node = 1)::BIGINT', 'v2 + (node = 2)::BIGINT')} AS version FROM l""")
def vclock_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version that the write's node would store as coordinator."""
    log = _log(spark, sf_dir)
    return log.select("seq", "key", vclock.to_string(vclock.increment(F.col("version"), F.col("node"))).alias("version"))


# -- reconciliation ----------------------------------------------------------------


@query(f"WITH {_LOG}, {_MAXIMAL} SELECT key, seq, {_sql_text()} AS version FROM m")
def causal_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes of each key that no other one dominates."""
    return maximal_versions(_log(spark, sf_dir), ["key"]).select("key", "seq", _text().alias("version"))


@query(f"""{_FOLD}
SELECT key, x.seq AS seq, x.t AS tombstone FROM (
  SELECT key, unnest(state) AS x FROM f WHERE (key, n) IN (SELECT (key, max(n)) FROM f GROUP BY key))""")
def causal_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Siblings that remain after all writes and deletes, in order of arrival."""
    return fold_writes(_log(spark, sf_dir), ["key"]).where("surviving").select("key", "seq", "tombstone")


def _late_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).withColumn("seq", (F.col("seq") + F.col("seq") * 7919 % 500) * 1_000_000_000 + F.col("seq"))


@query(f"{_LATE_FOLD} SELECT key, seq FROM f WHERE NOT accepted")
def obsolete_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes that a later version had overtaken when they arrived."""
    return fold_writes(_late_log(spark, sf_dir), ["key"]).where("NOT accepted").select("key", "seq")


@query(f"{_LATE_FOLD} SELECT key, seq, CASE WHEN accepted THEN 'ok' ELSE 'obsolete' END AS status FROM f WHERE tombstone")
def delete_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each delete."""
    deletes = fold_writes(_late_log(spark, sf_dir), ["key"]).where("tombstone")
    return deletes.select("key", "seq", F.when(F.col("accepted"), "ok").otherwise("obsolete").alias("status"))


@query(f"""
WITH {_LOG}, {_MAXIMAL}
SELECT siblings, CAST(count(*) AS BIGINT) AS keys FROM (SELECT key, CAST(count(*) AS BIGINT) AS siblings FROM m GROUP BY key) GROUP BY siblings""")
def conflict_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many keys have how many siblings."""
    each = maximal_versions(_log(spark, sf_dir), ["key"]).groupBy("key").agg(F.count(F.lit(1)).alias("siblings"))
    return each.groupBy("siblings").agg(F.count(F.lit(1)).alias("keys"))


# -- replicas ----------------------------------------------------------------------

_REPLICAS = """
d AS (SELECT l.*, r FROM l, (VALUES (0), (1), (2)) AS x(r) WHERE (seq * 7 + r * 3) % 10 <> 0),
h AS (
  SELECT * FROM d WHERE (CAST(key AS BIGINT) + r) % 3 < 2 AND NOT EXISTS (
    SELECT 1 FROM d o WHERE o.key = d.key AND o.r = d.r AND o.v0 >= d.v0 AND o.v1 >= d.v1 AND o.v2 >= d.v2
      AND (o.v0 > d.v0 OR o.v1 > d.v1 OR o.v2 > d.v2 OR o.seq < d.seq))),
u AS (SELECT DISTINCT seq, key, tombstone, v0, v1, v2 FROM h),
t AS (
  SELECT * FROM u WHERE NOT EXISTS (
    SELECT 1 FROM u o WHERE o.key = u.key AND o.v0 >= u.v0 AND o.v1 >= u.v1 AND o.v2 >= u.v2
      AND (o.v0 > u.v0 OR o.v1 > u.v1 OR o.v2 > u.v2 OR o.seq < u.seq))),
g AS (SELECT key, max(v0) AS m0, max(v1) AS m1, max(v2) AS m2 FROM u GROUP BY key),
a AS (SELECT key, r FROM (SELECT DISTINCT key FROM l), (VALUES (0), (1), (2)) AS x(r) WHERE (CAST(key AS BIGINT) + r) % 3 < 2),
s AS (
  SELECT key, r FROM a WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.key = a.key AND h.r = a.r)
  UNION
  SELECT key, r FROM h WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.key = h.key AND t.v0 = h.v0 AND t.v1 = h.v1 AND t.v2 = h.v2))"""


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of three replicas answer for each key; which ones, and in which order, follows from the key."""
    keys = _table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key")).distinct()
    asked = keys.withColumn("replica", F.explode(F.array(*map(F.lit, range(3)))))
    asked = asked.withColumn("arrival", F.pmod(F.col("key").cast("bigint") + F.col("replica"), F.lit(3))).where("arrival < 2")
    return replicas.quorum_prefix(asked, scalars.needed_acks(F.lit("quorum"), F.lit(3)))


def _replica_values(log: DataFrame, asked: DataFrame) -> DataFrame:
    """What the asked replicas hold: each lost some of the writes and keeps its own maximal set."""
    received = log.withColumn("replica", F.explode(F.array(*map(F.lit, range(3))))).where((F.col("seq") * 7 + F.col("replica") * 3) % 10 != 0)
    held = maximal_versions(received.join(asked, ["key", "replica"], "left_semi"), ["key", "replica"], ("tombstone",))
    return held.select("key", "replica", "seq", "version", "tombstone")


@query(f"WITH {_LOG}, {_REPLICAS} SELECT t.key, seq, {_sql_text()} AS version, {_sql_text('m0', 'm1', 'm2')} AS merged FROM t JOIN g ON t.key = g.key WHERE NOT tombstone")
def quorum_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live values and merged version that a quorum read of each key returns."""
    log = _log(spark, sf_dir)
    read = replicas.merged_read(_replica_values(log, _asked(spark, sf_dir))).where("NOT tombstone")
    return read.select("key", "seq", _text().alias("version"), _text("merged").alias("merged"))


@query(f"WITH {_LOG}, {_REPLICAS} SELECT key, r AS replica FROM s")
def stale_replicas(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    asked = _asked(spark, sf_dir)
    values = staged(_replica_values(log, asked), "values")
    return replicas.stale(values, asked, replicas.merged_read(values))


@query(f"""
WITH {_LOG}, {_REPLICAS},
o AS (SELECT key, min(seq) AS seq, bool_or(tombstone) AS tombstone FROM t GROUP BY key HAVING count(*) = 1)
SELECT s.key, s.r AS replica, o.seq, {_sql_text('m0', 'm1', 'm2')} AS version, o.tombstone FROM s JOIN o ON s.key = o.key JOIN g ON s.key = g.key""")
def read_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes that bring stale replicas up to date where one value is current."""
    log = _log(spark, sf_dir)
    asked = _asked(spark, sf_dir)
    values = staged(_replica_values(log, asked), "values")
    read = staged(replicas.merged_read(values), "read")
    return replicas.repairs(replicas.stale(values, asked, read), read).select("key", "replica", "seq", _text().alias("version"), "tombstone")


@query("""
SELECT key, level, level <> 'most' AS known, total, alive, needed, alive >= needed AS possible FROM (
  SELECT key, level, total, alive, CASE level WHEN 'Two' THEN 2 WHEN 'quorum' THEN total // 2 + 1 WHEN 'all' THEN total ELSE 1 END AS needed
  FROM (
    SELECT CAST(user_id AS VARCHAR) AS key, CAST(count(DISTINCT event_id % 7) AS BIGINT) AS total,
           CAST(count(DISTINCT CASE WHEN event_type <> 'error' THEN event_id % 7 END) AS BIGINT) AS alive
    FROM events GROUP BY user_id),
    (VALUES ('one'), ('Two'), ('quorum'), ('all'), ('most')) AS x(level))""")
def consistency_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each key, whose replicas are the nodes that saw it and are alive if they saw more than errors: what each level needs, and whether it can be met."""
    node = F.pmod(F.col("event_id"), F.lit(7))
    seen = _table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("key"), node.alias("node"))
    nodes = seen.agg(F.bool_or(F.col("event_type") != "error").alias("up"))
    sizes = nodes.groupBy("key").agg(F.count(F.lit(1)).alias("total"), F.count_if("up").alias("alive"))
    levels = sizes.withColumn("level", F.explode(F.array(*map(F.lit, ("one", "Two", "quorum", "all", "most")))))
    needed = scalars.needed_acks(F.col("level"), F.col("total"))
    known = scalars.known_level(F.col("level")).alias("known")
    return levels.select("key", "level", known, "total", "alive", needed.alias("needed"), (F.col("alive") >= needed).alias("possible"))


@query(f"""
WITH {_LOG},
x AS (
  SELECT seq, CAST(sum(CASE WHEN (seq * 7 + r * 3) % 10 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS reached,
         CAST(sum(CASE WHEN (seq * 7 + r * 3) % 10 <> 0 AND (seq * 11 + r * 5) % 6 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS acks
  FROM l, (VALUES (0), (1), (2)) AS v(r) GROUP BY seq)
SELECT seq, reached, acks, CASE WHEN reached < 2 THEN 'unavailable' WHEN acks < 2 THEN 'not_enough_acks' ELSE 'ok' END AS status FROM x""")
def put_ack_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    replies = log.select("seq", F.explode(F.array(*map(F.lit, range(3)))).alias("replica"))
    replies = replies.withColumn("reached", (F.col("seq") * 7 + F.col("replica") * 3) % 10 != 0).withColumn("acked", (F.col("seq") * 11 + F.col("replica") * 5) % 6 != 0)
    return replicas.put_status(log, replies, "quorum", 3)


# -- registers, sets, counters -----------------------------------------------------


def _register_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    return orders.select(F.col("o_custkey").alias("key"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("value"))


@query("""
SELECT CAST(o_custkey AS VARCHAR) || '.lww' AS key, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS value, min(o_orderstatus) <> max(o_orderstatus) AS conflict
FROM orders GROUP BY o_custkey""")
def register_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = crdt.merge_registers(_register_writes(spark, sf_dir))
    return merged.select(crdt.register_key(F.col("key")).alias("key"), "value", "conflict")


@query("""
WITH c AS (SELECT o_custkey AS key, max(o_orderdate) AS ts, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS id FROM orders GROUP BY o_custkey),
w AS (SELECT key, ts + to_days(CAST(key % 3 - 1 AS INTEGER)) AS ts, id + 1 AS id FROM c WHERE key % 2 = 0)
SELECT c.key, CASE WHEN w.ts > c.ts THEN w.id ELSE c.id END AS id, CASE WHEN w.ts > c.ts THEN 'new' ELSE 'old' END AS value
FROM c LEFT JOIN w ON c.key = w.key""")
def register_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes a day before, at, or a day after the stored time of every other register."""
    stored = crdt.merge_registers(_register_writes(spark, sf_dir).withColumn("value", F.col("id"))).select("key", "ts", F.col("value").alias("id"), F.lit("old").alias("value"))
    days = F.make_dt_interval(F.pmod(F.col("key"), F.lit(3)).cast("int") - 1)
    writes = stored.where("key % 2 = 0").select("key", (F.col("ts") + days).alias("ts"), (F.col("id") + 1).alias("id"), F.lit("new").alias("value"))
    return crdt.put_registers(stored, writes).select("key", "id", "value")


@query("""
SELECT o_custkey AS key, CAST(count(*) AS BIGINT) AS n FROM (SELECT o_custkey, o_orderstatus FROM orders) GROUP BY o_custkey HAVING count(*) % 2 = 1""")
def typed_mutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters by customer and order status, replicated three times with older states; odd ones are written back."""
    orders = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("node"))
    now = orders.groupBy("key", "node").agg(F.count(F.lit(1)).alias("n"))
    copies = now.withColumn("replica", F.explode(F.array(*map(F.lit, range(3))))).withColumn("n", F.greatest(F.col("n") - F.col("replica"), F.lit(0)))
    return crdt.counter_type().mutate(copies, lambda merged: merged.withColumn("modified", F.col("n") % 2 == 1))


@query("""
SELECT c_custkey AS key, coalesce(v, '') AS value, coalesce(ts, TIMESTAMP '1970-01-01') = TIMESTAMP '1970-01-01' AS zero
FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS ts, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS v FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey""")
def register_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The register of every customer; those who never ordered hold the zero register."""
    customers = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    read = crdt.register_type().read(_register_writes(spark, sf_dir), customers)
    return read.select("key", "value", (F.col("ts") == F.timestamp_seconds(F.lit(0))).alias("zero"))


@query("""
SELECT o_orderkey AS key, o_custkey AS ts, o_orderpriority AS value,
       printf('%02X%02X%02X%02X', o_custkey & 255, (o_custkey >> 8) & 255, (o_custkey >> 16) & 255, (o_custkey >> 24) & 255) || '00000000'
         || printf('%02X', octet_length(encode(o_orderpriority))) || '000000' || hex(encode(o_orderpriority)) AS stored
FROM orders""")
def register_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registers written as bytes and read back, the customer key being the time."""
    data = scalars.register_bytes(F.col("o_custkey"), F.col("o_orderpriority"))
    coded = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), data.alias("data"))
    return coded.select("key", scalars.register_time(F.col("data")).alias("ts"), scalars.register_value(F.col("data")).alias("value"), F.hex("data").alias("stored"))


def _set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    op = F.when(F.col("event_id") % 4 == 0, "remove").otherwise("add")
    return events.select(F.col("user_id").alias("key"), F.col("event_type").alias("item"), op.alias("op"), "ts", F.col("event_id").alias("id"))


_PRESENT = """
p AS (
  SELECT key, item FROM (
    SELECT user_id AS key, event_type AS item, arg_max(CASE WHEN event_id % 4 = 0 THEN 'remove' ELSE 'add' END, (ts, event_id)) AS op
    FROM events GROUP BY user_id, event_type) WHERE op = 'add')"""


@query(f"WITH {_PRESENT} SELECT key, string_agg(item, ',' ORDER BY item) AS items, CAST(count(*) AS BIGINT) AS n FROM p GROUP BY key")
def set_get_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crdt.set_members(crdt.present_items(_set_ops(spark, sf_dir)))


@query(f"WITH {_PRESENT} SELECT DISTINCT user_id AS key, user_id IN (SELECT key FROM p WHERE item = 'purchase') AS contains FROM events")
def set_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = _set_ops(spark, sf_dir)
    return crdt.set_contains(ops.select("key").distinct(), crdt.present_items(ops), "purchase")


@query(f"""
WITH {_PRESENT}, k AS (SELECT DISTINCT user_id AS key, user_id // 3 AS grp FROM events)
SELECT k.grp AS "group", item FROM k JOIN p ON k.key = p.key GROUP BY k.grp, item
HAVING count(*) = (SELECT count(*) FROM k x WHERE x.grp = k.grp)""")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items in all sets of three neighbouring keys."""
    ops = _set_ops(spark, sf_dir)
    groups = ops.select(F.floor(F.col("key") / 3).alias("group"), "key").distinct()
    return crdt.set_intersection(crdt.present_items(ops), groups)


@query("""
WITH c AS (SELECT user_id AS key, max(ts) AS cleared FROM events WHERE event_id % 97 = 0 GROUP BY user_id),
p AS (
  SELECT user_id AS key, event_type AS item, arg_max(CASE WHEN event_id % 4 = 0 THEN 'remove' ELSE 'add' END, (ts, event_id)) AS op, max(ts) AS ts
  FROM events GROUP BY user_id, event_type)
SELECT p.key, item FROM p LEFT JOIN c ON p.key = c.key WHERE op = 'add' AND (cleared IS NULL OR ts > cleared)""")
def set_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    clears = _table(spark, sf_dir, "events").where("event_id % 97 = 0").select(F.col("user_id").alias("key"), "ts")
    return crdt.present_items(_set_ops(spark, sf_dir), clears)


# -- ordered keys ------------------------------------------------------------------


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select(F.col("c_name").alias("key"), F.col("c_mktsegment").alias("data"), F.col("c_custkey").alias("version"))


@query("""
SELECT k.key, c_mktsegment AS data, c_custkey AS version, c_custkey IS NOT NULL AS found
FROM (SELECT 'Customer#' || lpad(CAST(s_suppkey * 17 AS VARCHAR), 9, '0') AS key FROM supplier) k LEFT JOIN customer ON c_name = k.key""")
def kv_point_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = _table(spark, sf_dir, "supplier").select(F.concat(F.lit("Customer#"), F.lpad((F.col("s_suppkey") * 17).cast("string"), 9, "0")).alias("key"))
    found = index.get(_customers(spark, sf_dir), wanted)
    return found.select("key", "data", "version", F.col("version").isNotNull().alias("found"))


@query("SELECT c_name AS key, c_mktsegment AS data, c_custkey AS version FROM customer WHERE c_name >= 'Customer#000000100' ORDER BY c_name")
def kv_scan_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.scan(_customers(spark, sf_dir), "Customer#000000100")


@query("SELECT c_name AS key, c_mktsegment AS data, c_custkey AS version FROM customer WHERE c_name BETWEEN 'Customer#000000050' AND 'Customer#000000149' ORDER BY c_name")
def kv_scan_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.scan(_customers(spark, sf_dir), "Customer#000000050", "Customer#000000149")


def _floor_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All order keys of lineitem, and those of finished orders."""
    keys = _table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("key"))
    return _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("probe")).distinct(), keys


_FLOOR = """
SELECT probe, o_orderkey AS floor FROM (SELECT DISTINCT l_orderkey AS probe FROM lineitem) p
ASOF LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') o ON p.probe >= o.o_orderkey"""


@query(_FLOOR)
def floor_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest key of a finished order at or below each order key of lineitem."""
    return index.floor_lookup(*_floor_sides(spark, sf_dir), F.floor(F.col("k") / 1024))


@query(_FLOOR.replace(">=", ">"))
def find_less(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, strictly below."""
    return index.floor_lookup(*_floor_sides(spark, sf_dir), F.floor(F.col("k") / 1024), strict=True)


@query("""
SELECT p_brand AS key, p_type AS data, p_retailprice AS price FROM (
  SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey DESC) AS n FROM part) WHERE n = 1 AND p_brand NOT IN (SELECT p_brand FROM part WHERE p_size >= 50 AND p_retailprice < 910)""")
def kv_upsert_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by brand: later parts replace earlier ones, then some brands are removed."""
    part = _table(spark, sf_dir, "part").select(F.col("p_brand").alias("key"), F.col("p_type").alias("data"), F.col("p_retailprice").alias("price"), F.col("p_partkey").alias("seq"), "p_size")
    def last(df: DataFrame) -> DataFrame:
        return runs.newest(df, ["seq"], ["seq", "data", "price"]).drop("entries")
    table = index.upsert(last(part.where("seq % 2 = 0")), last(part))
    gone = part.where("p_size >= 50 AND price < 910").select("key")
    return index.remove(table, gone).select("key", "data", "price")


# -- runs --------------------------------------------------------------------------

_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]
_SQL_KEY = "lpad(CAST(l_orderkey AS VARCHAR), 8, '0') || ':' || CAST(l_linenumber AS VARCHAR)"


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.lpad(F.col("l_orderkey").cast("string"), 8, "0"), F.lit(":"), F.col("l_linenumber").cast("string"))
    return _table(spark, sf_dir, "lineitem").select(key.alias("key"), *_ORDER)


@query(f"SELECT {_SQL_KEY} AS key, arg_max(l_extendedprice, (l_shipdate, l_partkey, l_suppkey, l_extendedprice)) AS l_extendedprice, CAST(count(*) AS BIGINT) AS entries FROM lineitem GROUP BY 1")
def lsm_merge_on_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.newest(_entries(spark, sf_dir), _ORDER, ["l_extendedprice"])


@query(f"SELECT key, l_extendedprice, l_partkey FROM (SELECT {_SQL_KEY} AS key, l_extendedprice, l_partkey, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS n FROM lineitem) WHERE n = 1")
def lsm_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four runs of lineitem merged into one run, which is read back."""
    root = f"{shared_dir(spark)}/heddle-runs-{uuid.uuid4().hex}"
    entries = _entries(spark, sf_dir)
    paths = {}
    for number in range(4):
        paths[number] = f"{root}/run{number}"
        runs.write_run(entries.where(F.pmod(F.month("l_shipdate"), F.lit(4)) == number), paths[number])
    runs.compact(runs.read_runs(spark, paths), _ORDER, ["l_extendedprice", "l_partkey"], f"{root}/merged")
    return runs.read_runs(spark, {4: f"{root}/merged"}).drop("run")


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change log from events: sign-ups create, views flush, purchases merge and take two earlier tables away."""
    kind = F.when(F.col("event_type") == "view", "flushed").when(F.col("event_type") == "purchase", "merged").otherwise("created")
    removed = F.when(F.col("event_type") == "purchase", F.array(F.col("event_id") - 1, F.col("event_id") - 2)).otherwise(F.array().cast("array<bigint>"))
    return _table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), kind.alias("kind"), F.col("event_id").alias("id"), (F.col("event_type") == "purchase").cast("int").alias("level"), F.col("user_id").alias("size"), removed.alias("removed")
    )


_TABLES = """
t AS (
  SELECT event_id AS id, CAST(event_type = 'purchase' AS INTEGER) AS level, user_id AS size FROM events e
  WHERE event_type IN ('view', 'purchase') AND NOT EXISTS (
    SELECT 1 FROM events p WHERE p.event_type = 'purchase' AND p.event_id IN (e.event_id + 1, e.event_id + 2)))"""


@query(f"WITH {_TABLES} SELECT * FROM t")
def lsm_manifest_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.manifest(_changes(spark, sf_dir))


@query(f"""
WITH {_TABLES} SELECT level, 1 AS target, CAST(count(*) AS BIGINT) AS segments, CAST(sum(size) AS BIGINT) AS bytes
FROM t GROUP BY level HAVING count(*) >= 2 AND (count(*) >= CASE level WHEN 0 THEN 10 ELSE 2 END)""")
def lsm_compaction_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.compaction_plan(runs.manifest(_changes(spark, sf_dir)), [(0, 10, None, 1), (1, 2, None, 1)])


@query("""
SELECT run, n, CAST(floor(-n * ln(0.01) / (ln(2) * ln(2))) AS BIGINT) AS bits,
       CAST(floor(floor(-n * ln(0.01) / (ln(2) * ln(2))) / n * ln(2)) AS BIGINT) AS hashes
FROM (SELECT CAST(year(l_shipdate) AS BIGINT) AS run, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1)""")
def bloom_sizing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = _table(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").cast("bigint").alias("run")).agg(F.count(F.lit(1)).alias("n"))
    return sizes.select("run", "n", scalars.bloom_bits(F.col("n"), 0.01).alias("bits"), scalars.bloom_hashes(F.col("n"), 0.01).alias("hashes"))


@query()
def checksum_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.crc32(F.col("text").cast("binary")).alias("checksum"))


# -- membership --------------------------------------------------------------------


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of 40 nodes as events report them: three runs, seven generations, three statuses."""
    e = F.col("event_id")
    return _table(spark, sf_dir, "events").select(
        F.pmod(F.col("user_id"), F.lit(40)).alias("id"),
        F.floor(F.pmod(e * 31, F.lit(3000)) / 1000).alias("run_id"),
        F.pmod(e * 13, F.lit(7)).alias("gen"),
        F.when(F.pmod(e, F.lit(11)) == 0, 3).when(F.col("event_type") == "error", 2).otherwise(1).alias("status"),
    )


@query("""
WITH o AS (
  SELECT user_id % 40 AS id, (event_id * 31 % 3000) // 1000 AS run_id, event_id * 13 % 7 AS gen,
         CASE WHEN event_id % 11 = 0 THEN 3 WHEN event_type = 'error' THEN 2 ELSE 1 END AS status FROM events),
r AS (SELECT * FROM o WHERE (id, run_id) IN (SELECT (id, max(run_id)) FROM o GROUP BY id))
SELECT id, run_id, max(gen) AS gen, CASE WHEN max(status) = 3 THEN 3 ELSE arg_max(status, (gen, status)) END AS status FROM r GROUP BY id, run_id""")
def membership_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return membership.merge_states(_observations(spark, sf_dir))


@query()
def membership_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return membership.state_hash(membership.merge_states(_observations(spark, sf_dir)))


@query("""
SELECT node, seq, status, CAST(sum(CASE WHEN status <> before THEN 1 ELSE 0 END) OVER (PARTITION BY node ORDER BY seq) AS BIGINT) AS gen
FROM (
  SELECT user_id AS node, event_id AS seq, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS status,
         lag(CASE WHEN event_type = 'error' THEN 2 ELSE 1 END, 1, 1) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)""")
def status_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = _table(spark, sf_dir, "events").select(F.col("user_id").alias("node"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", 2).otherwise(1).alias("status"))
    return membership.generations(signals)


_VOTES = "v AS (SELECT event_id // 3 AS target, event_type <> 'error' AS healthy FROM events)"
_VERDICT = "CASE WHEN bool_and(healthy) THEN 'healthy' WHEN bool_and(NOT healthy) THEN 'unhealthy' ELSE 'undecided' END"


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 3).alias("target"), (F.col("event_type") != "error").alias("healthy"))


@query(f"WITH {_VOTES} SELECT target, CAST(count(*) AS BIGINT) AS votes, {_VERDICT} AS verdict FROM v GROUP BY target")
def indirect_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return membership.indirect_verdicts(_votes(spark, sf_dir))


@query(f"""
WITH {_VOTES}, w AS (SELECT target, {_VERDICT} AS verdict FROM v GROUP BY target)
SELECT target, CASE WHEN target % 5 = 0 AND verdict <> 'healthy' THEN 2 ELSE 1 END AS status FROM w""")
def failure_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth target missed its direct probe; the indirect verdict decides."""
    votes = _votes(spark, sf_dir)
    direct = votes.select("target").distinct().withColumn("reached", F.col("target") % 5 != 0)
    return membership.detect(direct, membership.indirect_verdicts(votes))


# -- streaming ---------------------------------------------------------------------


@query(f"{_FOLD} SELECT key, seq, accepted FROM f")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The write log of ``events`` as a stream of files; the outcome of every write."""
    root = f"{shared_dir(spark)}/heddle-stream-{uuid.uuid4().hex}"
    log = _log(spark, sf_dir).select("seq", "key", "tombstone", "version")
    # Files arrive in order of seq, and a micro-batch takes one, so that no key has more writes in memory than a block.
    write_in_order(log, F.floor(F.col("seq") / _STREAM_BLOCK), f"{root}/blocks", f"{root}/in")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    run_to_end(reconcile_stream(stream), f"{root}/out", f"{root}/checkpoint")
    return spark.read.schema("key string, seq bigint, accepted boolean").parquet(f"{root}/out")


# -- the store ---------------------------------------------------------------------


def _stored(spark: SparkSession, sf_dir: str) -> CausalStore:
    """A store that holds the writes of ``events``, which arrive late; clients send what they had read."""
    store = CausalStore(spark, f"{shared_dir(spark)}/heddle-store-{uuid.uuid4().hex}")
    own = F.col("node").cast("bigint")
    read = F.map_filter(F.transform_values("version", lambda k, n: F.when(k == own, n - 1).otherwise(n)), lambda k, n: n > 0)
    writes = _late_log(spark, sf_dir).withColumn("version", read)
    store.put(writes.where("NOT tombstone").drop("tombstone"), own)
    store.delete(writes.where("tombstone").drop("tombstone", "data"), own)
    return store


@query(f"{_LATE_FOLD} SELECT key, seq, CASE WHEN accepted THEN 'ok' ELSE 'obsolete' END AS status FROM f")
def store_put_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status of every write to the store."""
    return _stored(spark, sf_dir).outcomes().select("key", "seq", "status")


@query(f"""{_LATE_FOLD},
e AS (SELECT key, unnest(state) AS x FROM f WHERE (key, n) IN (SELECT (key, max(n)) FROM f GROUP BY key)),
c AS (SELECT key, max(x.a) AS v0, max(x.b) AS v1, max(x.c) AS v2, count(*) FILTER (NOT x.t) AS live FROM e GROUP BY key)
SELECT e.key, x.seq AS seq, v0, v1, v2 FROM e JOIN c ON e.key = c.key WHERE NOT x.t
UNION ALL SELECT key, CAST(NULL AS BIGINT) AS seq, v0, v1, v2 FROM c WHERE live = 0""")
def store_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live siblings of every key with the context to write back with; deleted keys have their context alone."""
    read = _stored(spark, sf_dir).get()
    counters = [F.coalesce(F.element_at("context", F.lit(i).cast("bigint")), F.lit(0)).alias(f"v{i}") for i in range(3)]
    return read.select("key", "seq", *counters)
