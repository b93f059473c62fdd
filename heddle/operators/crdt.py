"""Conflict-free types: last-write-wins registers, sets with tombstones, counters, and typed mutations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REGISTER_SUFFIX = ".lww"


def register_key(key: Column) -> Column:
    return F.concat(key.cast("string"), F.lit(REGISTER_SUFFIX))


def merge_registers(writes: DataFrame, key: str = "key") -> DataFrame:
    """``(key, ts, value, conflict)``: the value with the latest time, ties by the larger ``id``.

    ``conflict`` tells whether different values were merged. Columns: key, ts, id, value.
    """
    return writes.groupBy(key).agg(
        F.max("ts").alias("ts"),
        F.max_by("value", F.struct("ts", "id")).alias("value"),
        (F.min("value") != F.max("value")).alias("conflict"),
    )


def put_registers(current: DataFrame, writes: DataFrame) -> DataFrame:
    """Registers ``(key, ts, id, value)`` after writes; a write must be strictly later to win."""
    sides = current.withColumn("_new", F.lit(0)).unionByName(writes.withColumn("_new", F.lit(1)))
    # Of equal times the stored value stays, so it sorts above new ones.
    order = F.struct("ts", -F.col("_new"), "id")
    return sides.groupBy("key").agg(F.max("ts").alias("ts"), F.max_by("id", order).alias("id"), F.max_by("value", order).alias("value"))


def present_items(ops: DataFrame, clears: DataFrame | None = None) -> DataFrame:
    """``(key, item)`` of sets: items whose latest operation, by time then id, is an add, after any clear of the key.

    Columns of ``ops``: key, item, op (``add`` or ``remove``), ts, id; of ``clears``: key, ts.
    Removal keeps a tombstone (the operation itself); this rule is a choice of this library.
    """
    latest = ops.groupBy("key", "item").agg(F.max_by("op", F.struct("ts", "id")).alias("op"), F.max("ts").alias("ts"))
    alive = latest.where(F.col("op") == "add")
    if clears is not None:
        last = clears.groupBy("key").agg(F.max("ts").alias("cleared"))
        alive = alive.join(last, "key", "left").where(F.col("cleared").isNull() | (F.col("ts") > F.col("cleared")))
    return alive.select("key", "item")


def set_members(present: DataFrame) -> DataFrame:
    return present.groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("item")), ",").alias("items"), F.count(F.lit(1)).alias("n"))


def set_contains(keys: DataFrame, present: DataFrame, item: str) -> DataFrame:
    holds = present.where(F.col("item") == item).select("key", F.lit(True).alias("_holds"))
    return keys.join(holds, "key", "left").select("key", F.coalesce("_holds", F.lit(False)).alias("contains"))


def set_intersection(present: DataFrame, groups: DataFrame) -> DataFrame:
    """``(group, item)`` in all sets of a group of keys; ``groups`` has ``(group, key)``, each once."""
    sizes = groups.groupBy("group").agg(F.count(F.lit(1)).alias("_keys"))
    counted = groups.join(present, "key").groupBy("group", "item").agg(F.count(F.lit(1)).alias("_in"))
    return counted.join(sizes, "group").where(F.col("_in") == F.col("_keys")).select("group", "item")


def merge_counters(parts: DataFrame) -> DataFrame:
    """Grow-only counters ``(key, node, n)``: the largest part of each node, summed."""
    top = parts.groupBy("key", "node").agg(F.max("n").alias("n"))
    return top.groupBy("key").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class DataType:
    """How the siblings of a key become one value: ``merge`` gives one row for each key, ``zero`` the columns of a key without siblings."""

    merge: Callable[[DataFrame], DataFrame]
    zero: dict[str, Column]

    def read(self, siblings: DataFrame, keys: DataFrame | None = None) -> DataFrame:
        """One row for each key; with ``keys``, for each of them, absent ones at zero."""
        merged = self.merge(siblings)
        if keys is None:
            return merged
        found = merged.withColumn("_found", F.lit(True))
        columns = [F.when(F.col("_found"), F.col(c)).otherwise(self.zero[c]).alias(c) for c in merged.columns if c != "key"]
        return keys.select("key").distinct().join(found, "key", "left").select("key", *columns)

    def mutate(self, siblings: DataFrame, change: Callable[[DataFrame], DataFrame], keys: DataFrame | None = None) -> DataFrame:
        """Read, merge, apply: ``change`` gives rows with ``modified``; only those are written."""
        return change(self.read(siblings, keys)).where("modified").drop("modified")


def counter_type() -> DataType:
    return DataType(merge_counters, {"n": F.lit(0).cast("bigint")})


def register_type() -> DataType:
    """Last write wins; a register that was never written holds an empty value at time zero."""
    return DataType(merge_registers, {"ts": F.timestamp_seconds(F.lit(0)), "value": F.lit(""), "conflict": F.lit(False)})
