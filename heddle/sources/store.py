"""A key-value store over an append-only write log in Parquet, read by folding versions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.functions import vclock
from heddle.operators.log import coordinated, validated
from heddle.operators.reconcile import fold_writes
from heddle.schema import WRITE
from heddle.workspace import staged


class CausalStore:
    """``put`` and ``delete`` append writes, ``get`` and ``scan`` return the siblings of keys.

    Writes have ``(seq, key, data, version)``; ``seq`` gives the order of arrival and must
    rise over the store's life. Versions are the contexts that clients read; the
    coordinator's counter is added. Every write has a status: ``invalid`` ones are not
    stored, ``obsolete`` ones had been overtaken when they arrived, all others are ``ok``.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _append(self, writes: DataFrame, node: Column) -> DataFrame:
        checked = validated(writes)
        good = coordinated(checked.where("status IS NULL"), node).select(*[F.col(f.name).cast(f.dataType) for f in WRITE])
        good.write.mode("append").parquet(self.root)
        refused = checked.where("status IS NOT NULL").select("seq", "key", "status")
        own = writes.select(F.col("seq").alias("_seq"), F.col("key").alias("_key"))
        stored = self.outcomes(own.select(F.col("_key").alias("key"))).join(own, (F.col("seq") == F.col("_seq")) & (F.col("key") == F.col("_key")), "left_semi")
        return refused.unionByName(stored)

    def put(self, writes: DataFrame, node: Column) -> DataFrame:
        """Append writes; ``(seq, key, status)`` of each."""
        if "version" not in writes.columns:
            writes = writes.withColumn("version", F.lit(None).cast(WRITE["version"].dataType))
        return self._append(writes.withColumn("tombstone", F.lit(False)), node)

    def delete(self, writes: DataFrame, node: Column) -> DataFrame:
        """Append tombstones, which need the version that the client read; ``(seq, key, status)`` of each."""
        return self._append(writes.withColumn("tombstone", F.lit(True)).withColumn("data", F.lit(None).cast("string")), node)

    def update(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame], node: Column, attempts: int = 3) -> DataFrame:
        """Read ``keys``, change them and write back; ``(key, attempt, status)`` of each key that was written.

        ``change`` takes what ``get`` returns and gives ``(seq, key, data)``, one row for each key to
        write, whose ``seq`` lies above all stored ones. Keys whose write another client had overtaken are read and
        changed again, up to ``attempts`` times in all; then they stay ``obsolete``.
        """
        pending, results = keys.select("key").distinct(), []
        for attempt in range(1, attempts + 1):
            # What was read must not be read again after the writes are stored.
            read = staged(self.get(pending), "read")
            contexts = read.groupBy("key").agg(F.first("context").alias("version"))
            writes = staged(change(read).join(contexts, "key", "left").select("seq", "key", "data", "version"), "update")
            status = staged(self.put(writes, node).select("key", F.lit(attempt).alias("attempt"), "status"), "status")
            again = status.where("status = 'obsolete'").select("key")
            last = attempt == attempts or again.isEmpty()
            results.append(status if last else status.where("status <> 'obsolete'"))
            if last:
                break
            pending = again
        return reduce(DataFrame.unionByName, results)

    def log(self) -> DataFrame:
        return self.spark.read.schema(WRITE).parquet(self.root)

    def _of(self, keys: DataFrame | None) -> DataFrame:
        return self.log() if keys is None else self.log().join(keys.select("key").distinct(), "key", "left_semi")

    def outcomes(self, keys: DataFrame | None = None) -> DataFrame:
        """``(seq, key, status)`` of all stored writes, of the given keys or of all."""
        return fold_writes(self._of(keys), ["key"]).select("seq", "key", F.when(F.col("accepted"), "ok").otherwise("obsolete").alias("status"))

    def siblings(self, log: DataFrame) -> DataFrame:
        """``(key, seq, data, version, tombstone)`` of surviving siblings, tombstones too."""
        alive = fold_writes(log, ["key"]).where("surviving").select("key", "seq")
        return log.join(alive, ["key", "seq"], "left_semi").select("key", "seq", "data", "version", "tombstone")

    def get(self, keys: DataFrame | None = None) -> DataFrame:
        """``(key, seq, data, version, context)``: live siblings, and the merged version to write back with.

        A deleted key has one row with that context alone, so that it can be written again; a
        missing key has none. Without ``keys``, all keys are read.
        """
        found = self.siblings(self._of(keys))
        dead = F.col("tombstone")
        entry = F.struct("seq", "data", "version")
        read = found.groupBy("key").agg(F.collect_list(F.when(~dead, entry)).alias("live"), F.collect_list("version").alias("versions"))
        context = F.aggregate("versions", vclock.empty(), vclock.merge)
        rows = read.select("key", F.explode_outer("live").alias("live"), context.alias("context"))
        return rows.select("key", "live.seq", "live.data", "live.version", "context")

    def scan(self, start: str | None = None, stop: str | None = None) -> DataFrame:
        """``(key, seq, data, version)``: live siblings of all keys between the bounds (both inclusive), in order of key."""
        log = self.log()
        log = log if start is None else log.where(F.col("key") >= start)
        log = log if stop is None else log.where(F.col("key") <= stop)
        return self.siblings(log).where("NOT tombstone").drop("tombstone").orderBy("key", "seq")
