"""Removal of long repeated byte strings with sharded suffix arrays.

A byte is removed if a string of ``length`` bytes that covers it also starts somewhere
else, in another document or the same one. To find such strings across documents,
every window of ``length`` bytes is keyed by content: by the smallest hash of the short
grams in it. Equal windows have equal keys. Neighbouring windows with the same gram form
one string, so the corpus becomes strings of less than twice the window, dealt by key.

A key that occurs at one place only has nothing to share; its strings are never made.
Strings of the other keys are stored once with their number, go to shards of bounded
size by key, and each shard finds its repeated windows by a suffix array (induced
sorting) and permuted common prefixes. A string stored for several places repeats as a
whole, and a key with one string in all needs no suffix array: two windows of a string
have their gram at different places, so they are never equal. Results go back to the
places and are cut from the documents.

One key may have more different strings than a shard may hold (a phrase of a gram's length
that very many documents share, each in words of its own). Windows of such keys are
counted by their place in relation to the gram and a 128-bit digest instead,
a count that any number of tasks can share. Strings too are told apart by a 128-bit digest.
Neither is compared byte by byte: that two of n differing ones meet has a chance below
n^2 / 2^129, a billionth for 10^14 of them.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.sais import permuted_lcp, suffix_array
from heddle.llm.shared import Stage, shuffle_width

_GRAM = 32
_PLACE_BITS = 24
_PART = (1 << _PLACE_BITS) - 4096  # bytes whose windows are keyed in one go
_MULTIPLIERS = tuple(np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
_EMIT_BYTES = 8 << 20
_SEEN = 300_000  # digests that a task remembers


def _gram_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of the 32 bytes from each place on."""
    n = len(text) - _GRAM + 1
    words = np.ndarray((len(text) - 7,), "<u8", text, 0, (1,))
    out = words[:n] * _MULTIPLIERS[0]
    for k in range(1, 4):
        mixed = words[8 * k : 8 * k + n] + out
        mixed ^= mixed >> np.uint64(31)
        out = mixed * _MULTIPLIERS[k]
    return out ^ (out >> np.uint64(29))


def _sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(values) - width + 1
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def keyed_runs(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring windows with the same least gram: key, first window, last window + 1, place of the gram.

    Of equal hashes in a window the leftmost counts, so equal windows have their gram at
    the same place.
    """
    parts = []
    for base in range(0, max(1, len(text) - length + 1), _PART):
        part = text[base : base + _PART + length - 1]
        if len(part) < length:
            break
        hashes = _gram_hashes(part)
        place = np.arange(len(hashes), dtype=np.uint64)
        ordered = (hashes & ~np.uint64((1 << _PLACE_BITS) - 1)) | place
        least = _sliding_minimum(ordered, length - _GRAM + 1)
        cuts = np.concatenate([[0], np.nonzero(least[1:] != least[:-1])[0] + 1, [len(least)]])
        gram = (least[cuts[:-1]] & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
        parts.append((hashes[gram].view(np.int64), cuts[:-1] + base, cuts[1:] + base, gram + base))
    if not parts:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


_FIRST, _SPAN = 1 << 32, 1 << 16  # a run in one number: first window, number of windows, place of the gram after the first window


def _anchor_rows(length: int):
    """Each key of a document once, with its first run and an array of its others, if there are any."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            for start in range(0, len(batch), 500):
                keys, row, runs = [], [], []
                for k, text in enumerate(texts.slice(start, 500)):
                    own, first, last, gram = keyed_runs(text.as_py(), length)
                    keys.append(own)
                    row.append(np.full(len(own), start + k))
                    runs.append(first * _FIRST + (last - first) * _SPAN + (gram - first))
                keys, row, runs = (np.concatenate(x) for x in (keys, row, runs))
                order = np.lexsort((keys, row))
                keys, row, runs = keys[order], row[order], runs[order]
                is_first = np.ones(len(keys), bool)
                is_first[1:] = (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])
                head = np.nonzero(is_first)[0]
                others = np.diff(head, append=len(keys)) - 1
                offsets = pa.array(np.append(0, np.cumsum(others)).astype(np.int32), mask=np.append(others == 0, False))
                at = pa.array(row[head])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(keys[head]), pa.array(runs[head]), pa.ListArray.from_arrays(offsets, pa.array(runs[~is_first]))],
                    ["id", "mark", "key", "run", "others"],
                )

    return run


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one, as they are about to be shuffled."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        packed = [pack(t.as_py()) for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["id", "mark", "packed"])


def _cut_strings(length: int):
    """Strings of the keys that a document shares; within some neighbouring rows each different one has its bytes once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        names = ["id", "mark", "key", "digest", "start", "gram", "bytes"]
        seen: set[bytes] = set()
        for batch in batches:
            rows: list[tuple] = []
            held = 0

            def emit() -> pa.RecordBatch:
                at = pa.array([r[0] for r in rows], pa.int64())
                columns = [batch.column(0).take(at), batch.column(1).take(at)]  # noqa: B023
                for k, kind in ((1, pa.int64()), (2, pa.binary()), (3, pa.int64()), (4, pa.int32()), (5, pa.binary())):
                    columns.append(pa.array([r[k] for r in rows], kind))
                rows.clear()
                return pa.RecordBatch.from_arrays(columns, names)

            for k in range(len(batch)):
                text = unpack(batch.column(2)[k].as_py())
                shared = batch.column(3).slice(k, 1).flatten()
                keys, others = shared.field("key").to_numpy(zero_copy_only=False), shared.field("others")
                keys = np.concatenate([keys, np.repeat(keys, others.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
                runs = np.concatenate([shared.field("run").to_numpy(zero_copy_only=False), others.flatten().to_numpy(zero_copy_only=False)])
                first, span, gram = runs // _FIRST, runs % _FIRST // _SPAN, runs % _SPAN
                for key, a, n, offset in zip(keys.tolist(), first.tolist(), span.tolist(), gram.tolist(), strict=True):
                    b = a + n - 1 + length
                    string = text[a:b]
                    digest = hashlib.blake2b(string, digest_size=16, salt=offset.to_bytes(4, "little")).digest()
                    new = digest not in seen
                    seen.add(digest)
                    rows.append((k, key, digest, a, offset, string if new else None))
                    held += 64 + (b - a if new else 0)
                    if held > _EMIT_BYTES:
                        yield emit()
                        held = 0
                if len(seen) > _SEEN:
                    seen.clear()
            if rows:
                yield emit()

    return run


def repeated_windows(data: np.ndarray, sizes: np.ndarray, length: int) -> np.ndarray:
    """For strings that lie one after the other in ``data``, whether the window of ``length`` from each byte on occurs elsewhere.

    By one suffix array over all of them; windows do not cross strings.
    """
    # UTF-8 has no bytes 0xFE and 0xFF: 0 and 1 are free for the sentinel and between strings.
    joined = np.full(len(data) + len(sizes) + 1, 1, np.uint8)
    joined[-1] = 0
    place = np.arange(len(data)) + np.repeat(np.arange(len(sizes)), sizes)
    joined[place] = data + np.uint8(2)
    before, common = permuted_lcp(joined, suffix_array(joined))
    long = np.nonzero(common >= length)[0]
    repeated = np.zeros(len(joined), bool)
    repeated[long] = True
    repeated[before[long]] = True
    return repeated[place]


def _verdicts(rows: pa.Table, length: int) -> pa.RecordBatch:
    """``(key, digest, runs)`` of the strings of a shard that hold windows which occur elsewhere: first window, last window + 1."""
    rows = rows.combine_chunks()
    key, copies = rows["key"].to_numpy(), rows["copies"].to_numpy()
    strings = rows["bytes"].chunk(0)
    offsets = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    data, offsets = np.frombuffer(strings.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]
    sizes = np.diff(offsets)
    _, group, times = np.unique(key, return_inverse=True, return_counts=True)
    open_to_doubt = times[group] > 1
    repeated = np.zeros(len(data), bool)
    if open_to_doubt.any():
        inside = np.repeat(open_to_doubt, sizes)
        repeated[inside] = repeated_windows(data[inside], sizes[open_to_doubt], length)
    # Windows only; runs end with their string.
    left = offsets[1:].repeat(sizes) - np.arange(len(data))
    repeated |= np.repeat(copies > 1, sizes)
    repeated &= left >= length
    edge = np.diff(np.concatenate([[False], repeated, [False]]).astype(np.int8))
    first, stop = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    of = np.searchsorted(offsets, first, "right") - 1
    some, head = np.unique(of, return_index=True)
    flat = (np.stack([first, stop], axis=1) - offsets[of][:, None]).astype(np.int32).ravel()
    lists = pa.ListArray.from_arrays(pa.array((2 * np.append(head, len(of))).astype(np.int32)), pa.array(flat))
    return pa.RecordBatch.from_arrays([pa.array(key[some]), rows["digest"].chunk(0).take(pa.array(some)), lists], ["key", "digest", "runs"])


def _shard(length: int):
    """Shards come in order; the last shard of a batch waits for the next batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        current = None
        for batch in batches:
            if not len(batch):
                continue
            shard, rows = batch.column(0).to_numpy(), pa.Table.from_batches([batch])
            cuts = [0, *(np.nonzero(np.diff(shard))[0] + 1).tolist(), len(batch)]
            for a, b in itertools.pairwise(cuts):
                if held and shard[a] != current:
                    yield _verdicts(pa.concat_tables(held), length)
                    held = []
                current = shard[a]
                held.append(rows.slice(a, b - a))
        if held:
            yield _verdicts(pa.concat_tables(held), length)

    return run


def _window_rows(length: int):
    """Each window of a string by its place in relation to the gram, with a digest."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, digest, string, copies, gram in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                n = len(string) - length + 1
                names = [hashlib.blake2b(string[i : i + length], digest_size=16).digest() for i in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * n), pa.array([digest] * n, pa.binary()), pa.array(range(n), pa.int32()), pa.array([gram - i for i in range(n)], pa.int32()), pa.array(names, pa.binary()), pa.array([copies] * n, pa.int64())],
                    ["key", "digest", "window", "gram", "name", "copies"],
                )

    return run


def _cut_documents(length: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = []
            for k in range(len(batch)):
                text = unpack(batch.column(1)[k].as_py())
                pairs = batch.column(2).slice(k, 1).flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, 2)
                edges = np.zeros(len(text) + 1, np.int64)
                np.add.at(edges, pairs[:, 0], 1)
                np.subtract.at(edges, pairs[:, 1] - 1 + length, 1)
                gone = np.cumsum(edges[:-1]) > 0
                spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                rows.append((len(text), int(gone.sum()), spans, np.frombuffer(text, np.uint8)[~gone].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary())))],
                ["id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return run


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, shard_bytes: int = 1 << 20) -> DataFrame:
    """``(id_col, n_bytes, n_removed, n_spans, kept)``: one row for every input row.

    ``kept`` is what remains of the text's UTF-8 bytes; strings of ``length`` (48 to 4000) are judged
    on the input, may overlap, and never cross documents. A null text is empty. Rows that share
    an id are documents of their own: if their texts are equal too, each repeats the
    other. An empty table gives no rows; other columns are not read.
    """
    if not _GRAM + 16 <= length <= 4000:
        raise ValueError("length must be 48 to 4000")
    spark = df.sparkSession
    stage = Stage(spark, "repeats")
    source = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b"")).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    source = source.select("id", F.xxhash64("text").alias("mark"), "text")
    anchors = source.where(F.octet_length("text") >= length).mapInArrow(_anchor_rows(length), f"id {kind}, mark bigint, key bigint, run bigint, others array<bigint>")
    anchors = stage.table(anchors, "anchors")
    shared = anchors.groupBy("key").agg(F.sum(F.when(F.col("others").isNull(), 1).otherwise(1 + F.size("others"))).alias("n")).where("n > 1").select("key")
    # Equal rows, of id and text, have equal runs; each has its places once.
    hits = anchors.join(shared, "key", "left_semi").groupBy("id", "mark").agg(F.collect_set(F.struct("key", "run", "others")).alias("keys"))
    packed = source.mapInArrow(_packed, f"id {kind}, mark bigint, packed binary")

    def with_document(other: DataFrame, how: str) -> DataFrame:
        other = other.withColumnRenamed("id", "o_id").withColumnRenamed("mark", "o_mark")
        return packed.join(other, F.col("id").eqNullSafe(F.col("o_id")) & (F.col("mark") == F.col("o_mark")), how)

    cut = with_document(hits, "inner").select("id", "mark", "packed", "keys")
    cut = stage.table(
        cut.mapInArrow(_cut_strings(length), f"id {kind}, mark bigint, key bigint, digest binary, start bigint, gram int, bytes binary"), "strings"
    )
    stage.drop(anchors)
    strings = cut.groupBy("key", "digest").agg(F.max("bytes").alias("bytes"), F.count(F.lit(1)).alias("copies"), F.max("gram").alias("gram"))
    strings = stage.table(strings, "different")

    sizes = strings.groupBy("key").agg(F.sum(F.octet_length("bytes")).alias("key_bytes"))
    large = sizes.where(F.col("key_bytes") > 4 * shard_bytes).select("key")
    total = strings.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    tasks = int(min(shards, max(shuffle_width(spark), 20_000)))
    dealt = (
        strings.join(large, "key", "left_anti")
        .select(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), "key", "digest", "bytes", "copies")
        .repartitionById(tasks, (F.col("shard") % tasks).cast("int"))
        .sortWithinPartitions("shard")
    )
    verdicts = dealt.mapInArrow(_shard(length), "key bigint, digest binary, runs array<int>")
    windows = strings.join(large, "key", "left_semi").select("key", "digest", "bytes", "copies", "gram")
    windows = windows.mapInArrow(_window_rows(length), "key bigint, digest binary, window int, gram int, name binary, copies bigint")
    often = windows.groupBy("key", "gram", "name").agg(F.sum("copies").alias("n")).where("n > 1").select("key", "gram", "name")
    single = windows.join(often, ["key", "gram", "name"], "left_semi").select("key", "digest", F.array(F.col("window"), F.col("window") + 1).alias("runs"))
    verdicts = stage.table(verdicts.unionAll(single), "verdicts")
    stage.drop(strings)

    places = cut.select("id", "mark", "key", "digest", "start").join(verdicts, ["key", "digest"])
    shifted = F.transform("runs", lambda r: (r + F.col("start")).cast("int"))
    gone = places.select("id", "mark", shifted.alias("runs")).groupBy("id", "mark").agg(F.collect_list("runs").alias("runs"))
    final = with_document(gone, "left").select("id", "packed", F.coalesce("runs", F.array().cast("array<array<int>>")).alias("runs"))
    result = final.mapInArrow(_cut_documents(length), f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    return result.withColumnRenamed("id", id_col)
