"""Exact deduplication by a tree merge of sorted digest runs.

Each input partition makes one run: digests in order, equal ones merged, with the
smallest identifier and the number of rows. Runs then meet in binomial rounds. With
``P = m ** R`` ranks, round ``j`` replaces the ``j``-th base-``m`` digit of a run's rank
by the ``j``-th digit of each digest's place in the digest space, so that groups of
``m`` ranks exchange parts of their runs and merge what they get; after ``R`` rounds a
rank holds one range of the digest space, fully merged. A group of copies, however
large, sends at most ``m`` entries to any merge.

An entry is an equality class only if the SHA-256 digest, the length in bytes and a
second, independent hash all agree; every level compares all three.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm.shared import SPACE, shuffle_width

_KEY = ["digest", "n_bytes", "second"]


def normalised(text: Column) -> Column:
    """Each run of white space becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE, " ")


def _merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge equal neighbours of sorted entries; the last entry of a batch waits for the next one."""
    waiting: pa.Table | None = None
    schema = None
    for batch in batches:
        schema = batch.schema
        rows = pa.Table.from_batches([batch])
        if waiting is not None:
            rows = pa.concat_tables([waiting, rows])
        if not len(rows):
            continue
        merged = rows.group_by([*_KEY, "rank", "slot"], use_threads=False).aggregate([("keep_id", "min"), ("rows", "sum")])
        merged = merged.rename_columns([c.removesuffix("_min").removesuffix("_sum") for c in merged.column_names]).select(schema.names).cast(schema)
        last = len(merged) - 1
        yield from merged.slice(0, last).to_batches()
        waiting = merged.slice(last)
    if waiting is not None:
        yield from waiting.to_batches()


def _sorted_run(entries: DataFrame) -> DataFrame:
    return entries.sortWithinPartitions(*_KEY).mapInArrow(_merge, entries.schema)


def merge_tree(entries: DataFrame, fan_in: int = 8) -> DataFrame:
    """``(digest, n_bytes, second, keep_id, rows)``: one entry for each equality class of ``entries``."""
    width = max(2, shuffle_width(entries.sparkSession))
    rounds = max(1, math.ceil(math.log(width, fan_in)))
    m = math.ceil(width ** (1 / rounds))
    ranks = m**rounds
    place = F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("bigint")
    runs = entries.select(
        *_KEY,
        "keep_id",
        "rows",
        (F.spark_partition_id() % ranks).alias("rank"),
        F.floor(place * ranks / F.lit(1 << 32)).cast("int").alias("slot"),
    )
    runs = _sorted_run(runs)
    for j in range(rounds):
        unit = m**j
        digit = lambda c: F.floor(F.col(c) / unit) % m  # noqa: B023, E731
        runs = runs.withColumn("rank", (F.col("rank") + (digit("slot") - digit("rank")) * unit).cast("int"))
        runs = _sorted_run(runs.repartitionById(ranks, "rank"))
    return runs.drop("rank", "slot")


def _entries(df: DataFrame) -> DataFrame:
    return df.select(*_KEY, F.col("_id").alias("keep_id"), F.lit(1).cast("bigint").alias("rows"))


def _keyed(df: DataFrame, text: Column) -> DataFrame:
    plain = normalised(text)
    return df.withColumns(
        {"digest": F.unhex(F.sha2(plain.cast("binary"), 256)), "n_bytes": F.octet_length(plain), "second": F.xxhash64(plain)}
    )


def distinct_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 8) -> DataFrame:
    """The rows of ``df``, with its columns, that stay: of equal texts the one with the smallest id.

    Equality and nulls as in ``exact_dedup``; of equal rows that also share the id, one stays.
    """
    held = df.select(F.col(id_col).alias("_id"), F.struct(*[df[c] for c in df.columns]).alias("_row"))
    held = _keyed(held, F.col("_row")[text_col])
    classes = merge_tree(_entries(held), fan_in)
    names = {k: f"_{k}" for k in (*_KEY, "keep_id")}
    classes = classes.select(*[F.col(k).alias(v) for k, v in names.items()])
    stays = held.join(classes, [held[k] == classes[names[k]] for k in _KEY] + [F.col("_id").eqNullSafe(F.col("_keep_id"))], "left_semi")
    return stays.dropDuplicates([*_KEY, "_id"]).select("_row.*")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 8) -> DataFrame:
    """``(id_col, keep_id, group_size, kept, text_sha256)``: one row for every input row.

    Texts are equal when they agree after ``normalised``; null and empty texts are equal.
    The row with the smallest id stays. Rows that share an id are rows of their own in
    ``group_size`` and share the decision; a null id never wins over another id. An empty
    table gives no rows; other columns, whatever their names, are not read.
    """
    rows = _keyed(df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), F.col("_text")).drop("_text")
    classes = merge_tree(_entries(rows), fan_in)
    return rows.join(classes, _KEY).select(
        F.col("_id").alias(id_col),
        "keep_id",
        F.col("rows").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
