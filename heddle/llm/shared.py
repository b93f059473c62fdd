"""What the operators of this subpackage have in common: staged tables and fixed patterns."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.workspace import shared_dir

#: White space of every contract here: space, tab, line feed, vertical tab, form feed, return.
SPACE = r"[\x20\x09-\x0D]+"
_SPACE_BYTE = re.compile(rb"[\x20\x09-\x0D]")
_PIECE_BYTES = 1 << 20


def word_lists(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, A-Z lower-cased, in lists for about a megabyte each, so that a long text is never split whole."""
    at = 0
    while len(text) - at > _PIECE_BYTES:
        cut = _SPACE_BYTE.search(text, at + _PIECE_BYTES)
        if cut is None:
            break
        yield text[at : cut.start()].lower().split()
        at = cut.end()
    yield (text[at:] if at else text).lower().split()


_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
_BATCH_BYTES = 4 << 20
_CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def bounded_batches(spark: SparkSession) -> None:
    """Have Spark send texts to Python in Arrow batches of a few megabytes, however long they are.

    A session setting; a lower limit that is already set stays.
    """
    now = spark.conf.get(_BATCH_KEY).removesuffix("b")
    if not now.isdigit() or int(now) > _BATCH_BYTES:
        spark.conf.set(_BATCH_KEY, str(_BATCH_BYTES))


class Stage:
    """Tables that cut lineage, written as Parquet in the shared folder and read again.

    A written table survives the loss of executors and is stored compressed, which a
    serialised checkpoint is not. Shuffle files of its plan go once it is written.
    """

    def __init__(self, spark: SparkSession, label: str):
        bounded_batches(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/heddle-{label}-{uuid.uuid4().hex}"
        self.made = 0

    def path(self, name: str) -> str:
        self.made += 1
        return f"{self.root}/{self.made:03d}-{name}"

    def table(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """``df`` as written; ``by`` is a column of few values that later filters name, a folder for each."""
        schema, path = df.schema, self.path(name)
        writer = df.write.option("compression", "zstd")
        before = self.spark.conf.get(_CLEANUP_KEY, "false")
        self.spark.conf.set(_CLEANUP_KEY, "true")
        try:
            (writer.partitionBy(by) if by else writer).parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP_KEY, before)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, df: DataFrame | None) -> None:
        """Delete the files of a staged table that no later plan reads."""
        if df is None:
            return
        for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            target = self.spark._jvm.org.apache.hadoop.fs.Path(file)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sampled(df: DataFrame, key: str, rows: int, total: int) -> DataFrame:
    """At most ``rows`` rows of ``total``, chosen by a hash of ``key``, the same ones on every run.

    The hash first thins the table to about twice as many, so that what tasks send on to be
    ordered is bounded for the whole table, not for each task.
    """
    share = min(1.0, 2 * rows / max(1, total) + 1e-6)
    if share < 1.0:
        df = df.where(F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    return df.orderBy(F.xxhash64(key), key).limit(rows)
