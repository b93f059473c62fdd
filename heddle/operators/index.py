"""Ordered keys: point and range reads, floor look-ups, upserts and removals. Keys sort by their bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def get(table: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``keys`` with the stored columns; null where a key is missing."""
    return keys.join(table, "key", "left")


def contains(table: DataFrame, keys: DataFrame) -> DataFrame:
    return keys.join(table, "key", "left_semi")


def scan(table: DataFrame, start: str | None = None, stop: str | None = None) -> DataFrame:
    """Rows with ``start <= key <= stop`` in order of key; the bounds reach the Parquet reader."""
    if start is not None:
        table = table.where(F.col("key") >= start)
    if stop is not None:
        table = table.where(F.col("key") <= stop)
    return table.orderBy("key")


def upsert(table: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` replace stored rows of the same key; keys of ``rows`` must be unique."""
    return table.join(rows, "key", "left_anti").unionByName(rows)


def remove(table: DataFrame, keys: DataFrame) -> DataFrame:
    return table.join(keys, "key", "left_anti")


def floor_lookup(probes: DataFrame, keys: DataFrame, bucket: Column, strict: bool = False) -> DataFrame:
    """``(probe, floor)``: the greatest key at or below each probe (below, if ``strict``), or null.

    ``bucket`` is a bigint expression over ``k`` that never falls as ``k`` rises; it cuts the key
    space, so that each bucket is sorted by itself. The largest key of a bucket is carried
    over within ranges of 4096 buckets, and only that of each range from range to range.
    """
    both = probes.select(F.col("probe").alias("k"), F.lit(not strict).cast("int").alias("side"), F.lit(None).cast(keys.schema["key"].dataType).alias("key"), F.lit(True).alias("is_probe"))
    stored = keys.select(F.col("key").alias("k"), F.lit(int(strict)).alias("side"), F.col("key"), F.lit(False).alias("is_probe"))
    rows = both.unionByName(stored).withColumn("b", bucket)
    inside = W.partitionBy("b").orderBy("k", "side").rowsBetween(W.unboundedPreceding, 0)
    local = rows.withColumn("local", F.last("key", ignorenulls=True).over(inside)).where("is_probe")
    tops = rows.groupBy("b").agg(F.max("key").alias("top")).withColumn("range", F.floor(F.col("b") / 4096))
    below = W.partitionBy("range").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    ranges = tops.groupBy("range").agg(F.max("top").alias("top"))
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    bases = ranges.select("range", F.last("top", ignorenulls=True).over(before).alias("base"))
    carried = tops.withColumn("within", F.last("top", ignorenulls=True).over(below)).join(bases, "range")
    carried = carried.select("b", F.coalesce("within", "base").alias("carried"))
    return local.join(carried, "b").select(F.col("k").alias("probe"), F.coalesce("local", "carried").alias("floor"))
