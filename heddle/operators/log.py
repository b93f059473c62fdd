"""The write log: validation, coordinator versions, and running counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heddle.functions import vclock


def validated(writes: DataFrame) -> DataFrame:
    """``writes`` with ``status``: ``invalid`` where the key is empty or a delete has no version, else null."""
    bad_key = F.coalesce(F.col("key"), F.lit("")) == ""
    bad_delete = F.col("tombstone") & F.col("version").isNull()
    return writes.withColumn("status", F.when(bad_key | bad_delete, F.lit("invalid")))


def coordinated(writes: DataFrame, node: Column) -> DataFrame:
    """The version that a coordinator stores: the client's context with the coordinator's counter one higher."""
    context = F.coalesce(F.col("version"), vclock.empty())
    return writes.withColumn("version", vclock.increment(context, node))


def running_counts(df: DataFrame, key: str, order: str, flags: dict[str, Column], block: int = 1 << 16) -> DataFrame:
    """For each flag, how often it held for the key up to and including the row, in order of ``order`` (bigint).

    Rows are counted within blocks of ``block`` order values and block totals are
    accumulated apart, so a key with very many rows is many small groups.
    """
    marked = df.withColumns({f"_{n}": c.cast("bigint") for n, c in flags.items()}).withColumn("_block", F.floor(F.col(order) / block))
    totals = marked.groupBy(key, "_block").agg(*[F.sum(f"_{n}").alias(f"_sum_{n}") for n in flags])
    before = W.partitionBy(key).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select(
        F.col(key).alias("_key"), F.col("_block").alias("_base_block"), *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_base_{n}") for n in flags]
    )
    inside = W.partitionBy(key, "_block").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    counted = marked.withColumns({f"_in_{n}": F.sum(f"_{n}").over(inside) for n in flags})
    joined = counted.join(bases, F.col(key).eqNullSafe(F.col("_key")) & F.col("_block").eqNullSafe(F.col("_base_block")))
    return joined.select(*df.columns, *[(F.col(f"_base_{n}") + F.col(f"_in_{n}")).alias(n) for n in flags])


def previous(df: DataFrame, key: str, order: str, column: str, name: str, block: int = 1 << 16) -> DataFrame:
    """``df`` with ``name``: ``column`` of the key's row before, in order of ``order`` (bigint); null for the first.

    Rows are sorted within blocks of ``block`` order values; the last value of a block is carried
    to the key's next block, so a key with very many rows is many small groups.
    """
    marked = df.withColumn("_block", F.floor(F.col(order) / block))
    ends = marked.groupBy(F.col(key).alias("_key"), F.col("_block").alias("_at")).agg(F.max_by(F.struct(column), order).alias("_end"))
    carried = ends.select("_key", "_at", F.lag("_end").over(W.partitionBy("_key").orderBy("_at")).alias("_carried"))
    inside = marked.withColumn("_before", F.lag(F.struct(column)).over(W.partitionBy(key, "_block").orderBy(order)))
    joined = inside.join(carried, F.col(key).eqNullSafe(F.col("_key")) & F.col("_block").eqNullSafe(F.col("_at")))
    return joined.select(*df.columns, F.coalesce("_before", "_carried").getField(column).alias(name))


def log_from_events(events: DataFrame, nodes: int = 3) -> DataFrame:
    """A write log ``(seq, key, node, data, tombstone, version)`` from an event table.

    Node is the event id modulo ``nodes``; purchases and errors carry the full context
    (read, then write), others only their own counter; errors are deletes.
    """
    node = F.pmod(F.col("event_id"), F.lit(nodes))
    rows = events.select(
        F.col("event_id").alias("seq"),
        F.col("user_id").cast("string").alias("key"),
        node.alias("node"),
        F.col("value").cast("string").alias("data"),
        (F.col("event_type") == "error").alias("tombstone"),
        F.col("event_type").isin("purchase", "error").alias("context"),
    )
    counted = running_counts(rows, "key", "seq", {f"c{i}": F.col("node") == i for i in range(nodes)})
    pairs = [F.struct(F.lit(i).cast("bigint").alias("k"), F.when(F.col("context") | (F.col("node") == i), F.col(f"c{i}")).otherwise(F.lit(0)).alias("v")) for i in range(nodes)]
    version = F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["v"] > 0))
    return counted.select("seq", "key", "node", "data", "tombstone", version.alias("version"))
