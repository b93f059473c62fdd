"""Replica merge, quorum reads, stale replicas and read repair, with acknowledgements as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heddle.functions import vclock
from heddle.functions.scalars import needed_acks
from heddle.operators.reconcile import maximal_versions


def quorum_prefix(replies: DataFrame, needed: Column, key: str = "key") -> DataFrame:
    """The first ``needed`` distinct replicas to answer for each key, in order of ``arrival``; none if fewer answered."""
    answered = replies.select(key, "replica", "arrival").distinct()
    turn = F.row_number().over(W.partitionBy(key).orderBy("arrival", "replica"))
    total = F.count(F.lit(1)).over(W.partitionBy(key))
    chosen = answered.withColumn("_turn", turn).withColumn("_total", total).where((F.col("_turn") <= needed) & (F.col("_total") >= needed))
    return chosen.select(key, "replica")


def merged_read(values: DataFrame) -> DataFrame:
    """``(key, seq, version, tombstone, merged)`` for values ``(key, replica, seq, version, tombstone)`` of the replicas that answered.

    Values that no other one dominates, one for each version, and the merge of all
    versions read, which is that of the undominated ones; tombstones are kept here and
    marked, readers drop them. The values are read once; a key's siblings are merged in one row.
    """
    top = maximal_versions(values, ["key"], ("tombstone",))
    found = top.groupBy("key").agg(F.collect_list(F.struct("seq", "version", "tombstone")).alias("found"))
    merged = F.aggregate(F.col("found.version"), vclock.empty(), vclock.merge)
    return found.select("key", F.explode("found").alias("one"), merged.alias("merged")).select("key", "one.*", "merged")


def compat_merge(values: Column) -> Column:
    """The looser rule over an array of ``struct<version, tombstone, data>``, for comparison in tests.

    One pass finds a highest version, replaced only by a later one; only what lies strictly
    before it goes. Dominated values that are concurrent with it stay; tombstones go.
    """
    highest = F.aggregate(
        F.transform(values, lambda v: v["version"]),
        vclock.empty(),
        lambda best, v: F.when(vclock.compare(best, v) == "before", v).otherwise(best),
    )
    kept = F.filter(values, lambda v: (vclock.compare(v["version"], highest) != "before") & ~v["tombstone"])
    return F.when(F.size(values) < 2, values).otherwise(kept)


def stale(values: DataFrame, asked: DataFrame, read: DataFrame) -> DataFrame:
    """``(key, replica)`` of asked replicas that hold nothing for a key, or a value that the read dominates."""
    versions = read.select("key", vclock.to_string(F.col("version")).alias("text"))
    texts = values.select("key", "replica", vclock.to_string(F.col("version")).alias("text"))
    holds_old = texts.join(versions, ["key", "text"], "left_anti").select("key", "replica")
    empty = asked.join(values.select("key", "replica"), ["key", "replica"], "left_anti")
    return holds_old.unionByName(empty).distinct()


def repairs(stale_replicas: DataFrame, read: DataFrame) -> DataFrame:
    """``(key, replica, seq, version, tombstone)`` to write back: where exactly one value is current and some replica is stale."""
    one = read.groupBy("key").agg(
        F.count(F.lit(1)).alias("_n"), F.min("seq").alias("seq"), F.first("merged").alias("version"), F.max("tombstone").alias("tombstone")
    )
    return stale_replicas.join(one.where("_n = 1").drop("_n"), "key")


def put_status(writes: DataFrame, replies: DataFrame, level: str, total: int) -> DataFrame:
    """``(seq, reached, acks, status)`` of each write from replies ``(seq, replica, reached, acked)``.

    ``unavailable`` if fewer replicas were reached than the level asks for, else
    ``not_enough_acks`` if fewer acknowledged, else ``ok``.
    """
    counted = replies.groupBy("seq").agg(F.count_if("reached").alias("reached"), F.count_if(F.col("reached") & F.col("acked")).alias("acks"))
    needed = needed_acks(F.lit(level), F.lit(total))
    joined = writes.select("seq").join(counted, "seq", "left").fillna(0, ["reached", "acks"])
    status = F.when(F.col("reached") < needed, "unavailable").when(F.col("acks") < needed, "not_enough_acks").otherwise("ok")
    return joined.withColumn("status", status)
