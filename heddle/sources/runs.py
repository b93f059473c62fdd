"""Sorted runs: merge on read, compaction, its planning, and the manifest as a fold of a change log.

A run is a Parquet table sorted by key within files, with a bloom filter on the key.
Row-group statistics and the filter prune point reads; a scan's bounds prune ranges.
The newest entry of a key wins as a whole; tombstones stay unless a grace is given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_run(entries: DataFrame, path: str, files: int | None = None) -> None:
    """Write entries (with ``key``) as one run: ranges of the key space, each file sorted."""
    dealt = entries.repartitionByRange(files, "key") if files else entries.repartitionByRange("key")
    writer = dealt.sortWithinPartitions("key").write.option("parquet.bloom.filter.enabled#key", "true")
    writer.option("parquet.bloom.filter.fpp#key", "0.01").option("parquet.block.size", str(64 << 20)).parquet(path)


def read_runs(spark: SparkSession, paths: dict[int, str]) -> DataFrame:
    """All runs as one table with ``run``, newest number last; filters on ``key`` reach each run's files."""
    parts = [spark.read.parquet(path).withColumn("run", F.lit(number).cast("bigint")) for number, path in sorted(paths.items())]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def newest(entries: DataFrame, order: list[str], keep: list[str]) -> DataFrame:
    """``(key, keep..., entries)``: the last entry of each key by ``order``, combined in each task before the shuffle."""
    best = F.max(F.struct(*order, *[c for c in keep if c not in order])).alias("best")
    merged = entries.groupBy("key").agg(best, F.count(F.lit(1)).alias("entries"))
    return merged.select("key", *[F.col(f"best.{c}").alias(c) for c in keep], "entries")


def compact(entries: DataFrame, order: list[str], keep: list[str], path: str, drop_tombstones: bool = False) -> None:
    """Merge runs into one: newest entry of each key, sorted."""
    merged = newest(entries, order, keep).drop("entries")
    if drop_tombstones and "tombstone" in keep:
        merged = merged.where(~F.col("tombstone"))
    write_run(merged, path)


def manifest(changes: DataFrame) -> DataFrame:
    """Active tables ``(id, level, size)`` after a log of changes ``(seq, kind, id, level, size, removed)``.

    ``created`` opens a memory table, ``flushed`` turns it into a table of level 0,
    ``merged`` adds a table and takes the ids in ``removed`` away.
    """
    added = changes.where(F.col("kind").isin("flushed", "merged"))
    latest = added.groupBy("id").agg(F.max_by(F.struct("level", "size"), "seq").alias("state"))
    removed = changes.where(F.col("kind") == "merged").select(F.explode("removed").alias("id")).distinct()
    return latest.join(removed, "id", "left_anti").select("id", "state.level", "state.size")


def compaction_plan(tables: DataFrame, rules: list[tuple[int, int, int | None, int]]) -> DataFrame:
    """``(level, target, segments, bytes)`` of levels to compact, by rules ``(level, most segments, most bytes, target)``.

    A level needs two segments at least, and as many as the rule allows or as many bytes.
    """
    spark = tables.sparkSession
    listed = spark.createDataFrame([(a, b, c, d) for a, b, c, d in rules], "level int, most int, most_bytes bigint, target int")
    sizes = tables.groupBy("level").agg(F.count(F.lit(1)).alias("segments"), F.sum("size").alias("bytes"))
    full = (F.col("segments") >= F.col("most")) | (F.col("most_bytes").isNotNull() & (F.col("bytes") >= F.col("most_bytes")))
    return sizes.join(F.broadcast(listed), "level").where((F.col("segments") >= 2) & full).select("level", "target", "segments", "bytes")
