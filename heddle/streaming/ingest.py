"""Streaming ingest: writes arrive in files, siblings are kept as state for each key.

Replayed writes meet an equal version and are rejected, so at-least-once delivery is
enough. Lateness is decided by versions, not by time: no watermark drops a write.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from heddle.functions import vclock
from heddle.operators.reconcile import append_version

_OUT = "key string, seq bigint, accepted boolean, siblings string"
#: Keys share state by a hash: a call to Python costs some milliseconds, so calls go by bucket, not by key.
_BUCKETS = 1024


def _read(text: str) -> dict[int, int]:
    return {int(k): int(v, 36) for k, v in (p.split("=") for p in text.strip("{}").split(",") if p)}


def _update(bucket: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State is the list of (key, text of its siblings); texts of keys without new writes are not read."""
    texts = dict(json.loads(state.get[0])) if state.exists else {}
    writes = pd.concat(list(frames)).sort_values("seq", kind="stable")
    keys, seqs, tombstones, versions = (writes[c].tolist() for c in ("key", "seq", "tombstone", "version"))
    held: dict[str | None, list[tuple]] = {}
    accepted = []
    for key, seq, tombstone, version in zip(keys, seqs, tombstones, versions, strict=True):
        if key not in held:
            held[key] = [({int(k): n for k, n in v.items()}, t, s) for v, t, s in json.loads(texts.get(key, "[]"))]
        after = append_version(held[key], (_read(version), bool(tombstone), int(seq)))
        accepted.append(after is not None)
        if after is not None:
            held[key] = after
    texts.update((key, json.dumps(siblings)) for key, siblings in held.items())
    state.update((json.dumps(list(texts.items())),))
    now = {key: ",".join(str(s[2]) for s in sorted(siblings, key=lambda s: s[2])) for key, siblings in held.items()}
    yield pd.DataFrame({"key": keys, "seq": seqs, "accepted": accepted, "siblings": [now[key] for key in keys]})


def reconcile_stream(writes: DataFrame, buckets: int = _BUCKETS) -> DataFrame:
    """``(key, seq, accepted, siblings)`` for each arriving write ``(seq, key, tombstone, version)``.

    ``siblings`` lists the sequence numbers that the key holds after the micro-batch; within
    a batch writes are applied in order of ``seq``. A batch rewrites the state of each bucket of keys
    that it touches, and holds a bucket's new writes in memory; ``buckets`` stays what it was when a checkpoint was made.
    """
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket")
    text = writes.select("seq", "key", "tombstone", vclock.to_string(F.col("version")).alias("version"), bucket)
    return text.groupBy("bucket").applyInPandasWithState(_update, _OUT, "siblings string", "append", GroupStateTimeout.NoTimeout)


def write_in_order(writes: DataFrame, block: Column, folder: str, target: str) -> None:
    """``writes`` as one file in ``target`` for each value of ``block`` (bigint), modified in that order, which is the order a stream reads them in.

    Files are written side by side below ``folder``; copies of them then arrive one by one. Writes
    without a block have no place in the order and are left out.
    """
    spark = writes.sparkSession
    # Row groups of 2 MB, so that several tasks read a file.
    tidy = writes.withColumn("_block", block).where("_block IS NOT NULL").repartition("_block").sortWithinPartitions("_block", "seq")
    tidy.write.option("parquet.block.size", 2 << 20).partitionBy("_block").parquet(folder)
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    files = hadoop.Path(folder).getFileSystem(conf)
    files.mkdirs(hadoop.Path(target))
    found = {}
    for status in files.listStatus(hadoop.Path(folder)):
        name = status.getPath().getName()
        if name.startswith("_block="):
            (found[int(name.removeprefix("_block="))],) = (f.getPath() for f in files.listStatus(status.getPath()) if f.getPath().getName().endswith(".parquet"))
    latest = -1
    for place, number in enumerate(sorted(found)):
        copy = hadoop.Path(f"{target}/{place:09d}.parquet")
        while True:
            hadoop.FileUtil.copy(files, found[number], files, copy, False, True, conf)
            modified = files.getFileStatus(copy).getModificationTime()
            if modified > latest:
                break
            time.sleep(0.02)
        latest = modified


def run_to_end(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Process everything that is there, write results as Parquet, and stop."""
    query = stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
    query.option("path", out).option("checkpointLocation", checkpoint).start().awaitTermination()
