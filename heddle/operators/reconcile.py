"""Reconciling versions: the siblings of a key that writes leave behind.

Two forms. Without tombstones the result is the set of maximal versions, whatever the
order of arrival, so each task reduces its rows before the shuffle and a key with very
many writes sends a few rows from each task. With tombstones the outcome depends on
the order of arrival; writes are then sorted by key and sequence and folded in one
pass that holds the siblings of one key only, however many writes it has.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.functions import vclock

_FLUSH = 200_000
#: Reduced batches that are held before they are reduced together; rows of a batch sent on; counters of a matrix (64 MB).
_MERGE, _ROWS, _CELLS = 16, 10_000, 1 << 23


def _entries(column: pa.Array) -> list[dict[int, int]]:
    return [dict(v or ()) for v in column.to_pylist()]


def covers(a: dict[int, int], b: dict[int, int]) -> bool:
    """Whether version ``a`` is at or after ``b``."""
    return all(a.get(k, 0) >= n for k, n in b.items())


def append_version(siblings: list[tuple], new: tuple) -> list[tuple] | None:
    """Siblings after a write, or None if it is obsolete. Items are (version, tombstone, ...).

    A write at or before a sibling is obsolete, siblings before it go, and so do
    concurrent tombstones; a tombstone never replaces a concurrent live value.
    """
    version, tombstone = new[0], new[1]
    kept = []
    for sibling in siblings:
        if covers(sibling[0], version):
            return None
        if not covers(version, sibling[0]) and not sibling[1]:
            kept.append(sibling)
    if kept and tombstone:
        return None
    return [*kept, new]


def _codes(rows: pa.Table, by: list[str]) -> np.ndarray:
    """One number for each row, equal where all columns of ``by`` are equal (null equals null)."""
    codes = np.zeros(rows.num_rows, np.int64)
    for name in by:
        found = pc.dictionary_encode(rows[name].combine_chunks(), null_encoding="encode")
        part = found.indices.to_numpy(zero_copy_only=False)
        codes = np.unique(codes * (len(found.dictionary) + 1) + part, return_inverse=True)[1]
    return codes


def _counters(versions: pa.MapArray) -> np.ndarray:
    """Versions as a matrix, a column for each node that occurs; null counts as empty."""
    offsets = versions.offsets.to_numpy()
    first, last = offsets[0], offsets[-1]
    nodes, column = np.unique(versions.keys.to_numpy(zero_copy_only=False)[first:last], return_inverse=True)
    matrix = np.zeros((len(versions), len(nodes)), np.int64)
    matrix[np.repeat(np.arange(len(versions)), np.diff(offsets)), column] = pc.fill_null(versions.items, 0).to_numpy(zero_copy_only=False)[first:last]
    return matrix


def _reduced(rows: pa.Table, by: list[str]) -> pa.Table:
    """Rows that no other row of their group dominates; of equal versions the one with the lowest ``seq``.

    In each round the row with the largest sum of counters left in its group is maximal, and all that it
    covers go, in all groups at once; there are as many rounds as the group with most siblings has.
    """
    if rows.num_rows == 0:
        return rows
    groups, seqs = _codes(rows, by), rows["seq"].to_numpy()
    matrix = _counters(rows["version"].combine_chunks())
    left = np.lexsort((seqs, -matrix.sum(axis=1), groups))
    heads = []
    while len(left):
        group = groups[left]
        start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        top = left[start]
        heads.append(top)
        above = np.repeat(top, np.diff(np.r_[start, len(left)]))
        left = left[(matrix[left] > matrix[above]).any(axis=1)]
    return rows.take(np.sort(np.concatenate(heads)))


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.Table]:
    """A batch in pieces whose counters fit ``_CELLS``, even if every row had all nodes of the batch."""
    nodes = len(pc.unique(batch.column("version").keys))
    step = max(256, _CELLS // max(1, nodes))
    for start in range(0, batch.num_rows, step):
        yield pa.Table.from_batches([batch.slice(start, step)])


def maximal_versions(writes: DataFrame, by: list[str], also: tuple[str, ...] = ()) -> DataFrame:
    """``(by..., seq, version, also...)`` of the writes of each group that no other write dominates (tombstones count as writes)."""
    columns = [*by, "seq", "version", *also]

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            held += [_reduced(piece, by) for piece in _pieces(batch)]
            if sum(t.num_rows for t in held) > _FLUSH:
                yield from pa.concat_tables(held).to_batches(_ROWS)
                held = []
            elif len(held) > _MERGE:
                held = [_reduced(piece, by) for b in pa.concat_tables(held).combine_chunks().to_batches() for piece in _pieces(b)]
        for table in held:
            yield from table.to_batches()

    def final(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group: all but the last group of a piece are complete."""
        open_group: pa.Table | None = None
        for batch in batches:
            for piece in _pieces(batch):
                found = _reduced(piece if open_group is None else pa.concat_tables([open_group, piece]), by)
                codes = _codes(found, by)
                open_rows = int(np.argmax(codes == codes[-1]))
                yield from found.slice(0, open_rows).to_batches(_ROWS)
                open_group = found.slice(open_rows)
        if open_group is not None:
            yield from open_group.to_batches(_ROWS)

    rows = writes.select(*columns)
    reduced = rows.mapInArrow(partial, rows.schema)
    return reduced.repartition(*by).sortWithinPartitions(*by).mapInArrow(final, rows.schema)


def fold_writes(writes: DataFrame, by: list[str]) -> DataFrame:
    """``(by..., seq, tombstone, accepted, surviving)``: what became of each write, in order of ``seq`` within its group."""
    kinds = ", ".join(f"`{c}` {writes.schema[c].dataType.simpleString()}" for c in by)
    width = len(by)

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, siblings, waiting, like = None, [], [], None

        def rows(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names)

        for batch in batches:
            if like is None:
                like = batch.schema
                types = [*(f.type for f in list(like)[: width + 2]), pa.bool_(), pa.bool_()]
                names = [*like.names[: width + 2], "accepted", "surviving"]
            out = []
            keys = zip(*(batch.column(k).to_pylist() for k in range(width)), strict=True)
            columns = (batch.column(width).to_pylist(), batch.column(width + 1).to_pylist(), _entries(batch.column(width + 2)))
            for key, seq, tombstone, version in zip(keys, *columns, strict=True):
                if key != current:
                    out += [(*current, s[2], s[1], True, True) for s in siblings] if current is not None else []
                    current, siblings = key, []
                after = append_version(siblings, (version, tombstone, seq))
                if after is None:
                    out.append((*key, seq, tombstone, False, False))
                else:
                    stay = {s[2] for s in after}
                    out += [(*key, s[2], s[1], True, False) for s in siblings if s[2] not in stay]
                    siblings = after
            if out:
                yield rows(out)
        if current is not None and siblings:
            yield rows([(*current, s[2], s[1], True, True) for s in siblings])

    ordered = writes.select(*by, "seq", "tombstone", "version").repartition(*by).sortWithinPartitions(*by, "seq")
    return ordered.mapInArrow(fold, f"{kinds}, seq bigint, tombstone boolean, accepted boolean, surviving boolean")


def siblings_by_anti_join(writes: DataFrame, by: list[str]) -> DataFrame:
    """Maximal versions as a self anti join on the group: for groups with few writes, all inside the JVM."""
    other = writes.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("seq").alias("_seq"), F.col("version").alias("_version"))
    causality = vclock.compare(F.col("version"), F.col("_version"))
    beaten = (causality == "before") | ((causality == "equal") & (F.col("_seq") < F.col("seq")))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    return writes.join(other, [*same, beaten], "left_anti").select(*by, "seq", "version")
