"""SimHash near-deduplication with Golay-code fuzzy hashing.

The binary Golay code of length 23 is perfect: each 23-bit word lies within three bits
of exactly one code word. A word has as keys the code words (their 12 message bits) to
which it and its one-bit neighbours decode, one to six of them; two words that differ
in at most two bits have a common one-bit neighbour, hence a common key.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits. If two
fingerprints differ in at most four bits, two of the three segments together differ in
at most two bits (the third has as many errors as either, so it holds half of them or
more, rounded up), and both share a key. So keys of fingerprints are (pair of segments,
key, key): at most 108 each, no link is lost, and candidates are verified bit by bit.

Copies of a fingerprint are one row before keys are made. Within a key, verified links
are reduced to a forest, so that thousands of near copies cost rows in proportion to
their number. Verification time within a key grows with the square of the distinct
fingerprints there (one in 2^24 of unrelated ones for each pair of segments and keys).

``representatives`` finds documents whose sets of word shingles are similar. Sets at a
Jaccard similarity of 0.8 differ in some 15 % of their bits, far more than four of 64, so
it takes keys from six segments of a wider fingerprint, with the same pairs of fuzzy keys.
Candidates within a key are compared by 64 bits that the keys do not use, and reduced to
a minimum spanning forest: if two documents are close, so is each link on the way
between them. Links count once the exact similarity of both sets is high enough.

Fingerprints alone miss links near the threshold, so an exact join between the groups
found so far follows. Of two sets with a Jaccard similarity of t or more, the larger has
n shingles and they share t n at the least; in any order of all shingles that both
follow, their first n - ceil(t n) + 1 have one in common. The order is by how often a
shingle's place in a table of counters is taken, seldom first, then by hash; the counters
change the work, not the result. Shingles that only one set puts first are dropped before
anything else is known of them. Pairs that meet under the others, of different groups and
fitting sizes, are compared by parity bits (they differ in no more bits than the sets do
in shingles), by a few of them where they meet, then by all, then shingle by shingle.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm.components import connected_components
from heddle.llm.shared import Stage, word_lists

_GENERATOR = 0b101011100011  # fixed value: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
_SEGMENTS = ((0, 22), (22, 21), (43, 21))
_WIDE_SEGMENTS = tuple((at, 21) for at in (0, 21, 42))  # of either of two numbers
_MIX = tuple(map(np.uint64, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)))
_SLICE_BYTES = 2 << 20
_SMALL_GROUP = 32
_PIECE = 8192  # hashes whose bits are counted together
_COMMON = 2  # counts up to this one are all equally rare
_PLACES, _PARTS = 1 << 20, 16  # counters of shingles (4 MB), and the rows that hold them
_PARITY_BITS = 1 << 16
_FOLD_BYTES = 128  # parity bits that go along with a shingle
_COMPARED = 1 << 20  # bytes of parity bits that are compared at once
_PAIRS = 1 << 20  # pairs held before they are made distinct and sent on


def _remainders(values: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit polynomials by the generator."""
    out = values.copy()
    for bit in range(22, 10, -1):
        out ^= np.where(out >> bit & 1, _GENERATOR << (bit - 11), 0)
    return out


def _decoder() -> tuple[np.ndarray, np.ndarray]:
    """Remainder of each word's high 12 bits, and the error pattern of each remainder."""
    high = _remainders(np.arange(1 << 12, dtype=np.int64) << 11)
    patterns = np.array([sum(1 << b for b in bits) for n in range(4) for bits in combinations(range(23), n)], np.int64)
    errors = np.zeros(1 << 11, np.int64)
    errors[_remainders(patterns)] = patterns
    return high, errors


_HIGH, _ERRORS = _decoder()


def nearest_codeword(words: np.ndarray) -> np.ndarray:
    """Message bits of the code word within three bits of each 23-bit word."""
    return (words ^ _ERRORS[_HIGH[words >> 11] ^ (words & 0x7FF)]) >> 11


def segment_keys(words: np.ndarray, bits: int) -> np.ndarray:
    """Distinct keys of each word, as rows of six filled up with -1."""
    flips = np.concatenate([[0], 1 << np.arange(bits, dtype=np.int64)])
    found = np.sort(nearest_codeword(words[:, None] ^ flips), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return -np.sort(-found, axis=1)[:, :6]


def _segments(fingerprints: np.ndarray, places: tuple[tuple[int, int], ...]) -> list[np.ndarray]:
    """Keys of each segment of each fingerprint."""
    return [segment_keys((fingerprints >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64), n) for at, n in places]


def pair_keys(segments: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Row number and key of every pair of keys of two segments."""
    rows, out = [], []
    for number, (i, j) in enumerate(combinations(range(len(segments)), 2)):
        a, b = segments[i][:, :, None], segments[j][:, None, :]
        both = (a >= 0) & (b >= 0)
        rows.append(np.nonzero(both)[0])
        out.append(((number << 24) | (a << 12) | b)[both])
    return np.concatenate(rows), np.concatenate(out)


def fuzzy_keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row number and key of every key of every fingerprint."""
    return pair_keys(_segments(fingerprints, _SEGMENTS))


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of each run of ``width`` words, repeats included; of all words if there are fewer."""
    digest = xxhash.xxh64_intdigest
    parts, carried = [], []
    for words in word_lists(text):
        words = carried + words
        if len(words) >= width:
            joined = b" ".join(words)
            starts = list(accumulate((len(w) + 1 for w in words), initial=0))
            parts.append(np.array([digest(joined[a : b - 1], 42) for a, b in zip(starts, starts[width:], strict=False)], np.uint64))
        carried = words[1 - width :]
    if not parts:
        parts = [np.array([digest(b" ".join(carried), 42)] if carried else [], np.uint64)]
    return np.concatenate(parts) if len(parts) > 1 else parts[0]


def _set_bits(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How often each bit is set, by run of hashes; in pieces, as unpacked bits take 64 times the space when summed."""
    out = np.zeros((len(starts), 64), np.int64)
    for at in range(0, len(hashes), _PIECE):
        bits = np.unpackbits(hashes[at : at + _PIECE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = int(np.searchsorted(starts, at, "right")) - 1
        last = int(np.searchsorted(starts, at + len(bits), "left"))
        out[first:last] += np.add.reduceat(bits, np.maximum(starts[first:last] - at, 0), axis=0, dtype=np.int64)
    return out


def majority(hashes: list[np.ndarray]) -> np.ndarray:
    """The fingerprint of each array of hashes: bits that more than half of them have; 0 without any."""
    sizes = np.fromiter(map(len, hashes), np.int64, len(hashes))
    out = np.zeros(len(hashes), np.uint64)
    some = np.nonzero(sizes)[0]
    if len(some):
        set_in = _set_bits(np.concatenate(hashes), (np.cumsum(sizes) - sizes)[some])
        bits = (2 * set_in > sizes[some][:, None]).astype(np.uint8)
        out[some] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def _slices(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Start and texts of parts of a column of about ``_SLICE_BYTES`` each."""
    start, held, texts = 0, 0, []
    for k, text in enumerate(column):
        texts.append(text.as_py() or b"")
        held += len(texts[-1])
        if held >= _SLICE_BYTES or k == len(column) - 1:
            yield start, texts
            start, held, texts = k + 1, 0, []


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp)``: the 64-bit fingerprint of each whole text as a signed number; no words give 0."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in _slices(batch.column(1)):
                fp = majority([shingle_hashes(t, 4) for t in texts]).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), pa.array(fp)], ["id", "fp"])

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return source.mapInArrow(run, f"id {source.schema[0].dataType.simpleString()}, fp bigint")


def _keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False)
        for start in range(0, len(fp), 4096):
            part = fp[start : start + 4096]
            rows, keys = fuzzy_keys(part.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(part[rows])], ["key", "fp"])


def _forest(fp: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links that connect what is connected in one key: each search step drops what it reaches from the rest."""
    links, rest = [], fp
    while len(rest):
        reached, rest = [rest[0]], rest[1:]
        while reached and len(rest):
            at = reached.pop()
            near = np.bitwise_count(rest ^ at) <= bits
            if near.any():
                links += [(int(x), int(at)) for x in rest[near]]
                reached += list(rest[near])
                rest = rest[~near]
    return links


def _weights(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits, then a hash of both: no two pairs weigh the same, and a pair weighs the same under every key."""
    mixed = (a * _MIX[0]) ^ (b * _MIX[0])
    return np.bitwise_count(a ^ b).astype(np.uint64) << np.uint64(57) | (mixed * _MIX[1]) >> np.uint64(7)


def _spanning_forest(fp: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links of the minimum spanning forest under ``bits`` differing bits, grown from one fingerprint at a time."""
    links = []
    near, nearest = np.full(len(fp), np.iinfo(np.uint64).max), np.zeros(len(fp), np.int64)
    rest = np.arange(len(fp))
    while len(rest):
        k = int(near[rest].argmin())
        at = rest[k]
        if near[at] >> np.uint64(57) <= bits:
            links.append((int(fp[at]), int(fp[nearest[at]])))
        rest = np.delete(rest, k)
        weight = _weights(fp[rest], fp[[at]])
        closer = weight < near[rest]
        near[rest[closer]], nearest[rest[closer]] = weight[closer], at
    return links


def _spanning_links(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which links (places ``a`` and ``b``) are in the minimum spanning forest: each component takes its lightest way out, again and again."""
    names, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = place[: len(a)], place[len(a) :]
    label, keep = np.arange(len(names)), np.zeros(len(a), bool)
    while (out := np.nonzero(label[a] != label[b])[0]).size:
        best = np.full(len(names), np.iinfo(np.uint64).max)
        np.minimum.at(best, label[a[out]], weight[out])
        np.minimum.at(best, label[b[out]], weight[out])
        chosen = out[(weight[out] == best[label[a[out]]]) | (weight[out] == best[label[b[out]]])]
        keep[chosen] = True
        while (label[a[chosen]] != label[b[chosen]]).any():  # components joined take their least label
            least = np.minimum(label[a[chosen]], label[b[chosen]])
            lower = np.arange(len(names))
            np.minimum.at(lower, label[a[chosen]], least)
            np.minimum.at(lower, label[b[chosen]], least)
            label = lower[label]
    return keep


def _linker(bits: int, forest=_forest):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keys come in order; the last key of a batch waits for the next batch."""
        held: list[np.ndarray] = []
        held_key = None

        def large(parts: list[np.ndarray]) -> pa.RecordBatch:
            links = np.sort(np.array(forest(np.concatenate(parts).view(np.uint64), bits), np.uint64).reshape(-1, 2), axis=1).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(links[:, k])) for k in (0, 1)], ["u", "v"])

        for batch in batches:
            keys, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            if not len(keys):
                continue
            cuts = np.nonzero(np.diff(keys))[0] + 1
            first = int(cuts[0]) if len(cuts) else len(keys)
            if keys[0] == held_key:
                held.append(fp[:first])
            else:
                if held:
                    yield large(held)
                held, first = [], 0
            if keys[0] == held_key and first == len(keys):
                continue
            if held:
                yield large(held)
            last = int(cuts[-1]) if len(cuts) else 0
            held, held_key = [fp[last:]], keys[-1]
            keys, fp = keys[first:last], fp[first:last].view(np.uint64)
            if not len(keys):
                continue
            bounds = np.concatenate([[0], np.nonzero(np.diff(keys))[0] + 1, [len(keys)]])
            sizes = np.diff(bounds)
            for k in np.nonzero(sizes > _SMALL_GROUP)[0]:
                yield large([fp[bounds[k] : bounds[k + 1]].view(np.int64)])
            small = np.repeat(sizes <= _SMALL_GROUP, sizes)
            keys, fp = keys[small], fp[small]
            found = []
            for apart in range(1, min(_SMALL_GROUP, len(keys))):
                at = np.nonzero(keys[apart:] == keys[:-apart])[0]
                if not len(at):
                    break
                at = at[np.bitwise_count(fp[at] ^ fp[at + apart]) <= bits]
                found.append(np.stack([at, at + apart]))
            if found:
                a, b = np.concatenate(found, axis=1)
                keep = _spanning_links(a, b, _weights(fp[a], fp[b]))
                u, v = np.sort(np.stack([fp[a[keep]], fp[b[keep]]]), axis=0).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
        if held:
            yield large(held)

    return run


def link_fingerprints(distinct: DataFrame, bits: int = 4) -> DataFrame:
    """``(u, v)``: links that connect exactly the fingerprints (column ``fp``, distinct) within ``bits``.

    ``bits`` may be 4 at most, the most that the keys cover.
    """
    if not 0 <= bits <= 4:
        raise ValueError("keys cover 0 to 4 differing bits")
    keyed = distinct.select("fp").mapInArrow(_keyed, "key int, fp bigint")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_linker(bits), "u bigint, v bigint").distinct()


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 4) -> DataFrame:
    """``(id_col, fp, component_id)``: one row for every input row.

    Texts are lower-cased (A-Z), cut at white space and read as 4-word shingles, repeats
    included; a shorter text is one shingle, and a null, empty or blank text has
    fingerprint 0, which links like any other. ``component_id`` is the smallest id
    reachable over links of at most ``bits`` differing bits. Rows that share an id keep a
    row each; an empty table gives no rows; other columns are not read.
    """
    stage = Stage(df.sparkSession, "simhash")
    marked = stage.table(fingerprints(df, id_col, text_col), "fingerprints")
    distinct = marked.groupBy("fp").agg(F.min("id").alias("first_id"))
    components = connected_components(link_fingerprints(distinct, bits), stage)
    rooted = distinct.join(components, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("component", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_fp = rooted.join(smallest, "root").select("fp", "component_id")
    return marked.join(of_fp, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def _prefix_length(size: int, similarity: float) -> int:
    """How many first shingles of a set include one that any set similar to it shares."""
    return size - math.ceil(similarity * size - 1e-9) + 1 if size else 0


def _parity(hashes: np.ndarray) -> bytes:
    """Whether an odd number of hashes falls on each place; at least two places for each hash, a power of two, up to a bound."""
    places = 64
    while places < min(2 * len(hashes), _PARITY_BITS):
        places *= 2
    odd = np.bincount((hashes >> np.uint64(20)).astype(np.int64) & (places - 1), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(parity: bytes) -> bytes:
    """Parity bits of fewer places, ``_FOLD_BYTES`` at the most; they bound differences as well, less tightly."""
    if len(parity) <= _FOLD_BYTES:
        return parity
    return np.bitwise_xor.reduce(np.frombuffer(parity, np.uint8).reshape(-1, _FOLD_BYTES), axis=0).tobytes()


def _places(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - _PLACES.bit_length() + 1)).astype(np.int64)


def _short(digest: bytes) -> int:
    """A node's number of 64 bits, known from its set alone; nodes that share one are both looked at."""
    return int.from_bytes(digest[:8], "little", signed=True)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    sizes = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(arrays).view(np.int64)))


def _wide_fingerprints(width: int):
    """From ``(id, mark, text)``: a digest of the set of shingles, the fingerprint that is compared and the two that have keys, size and parity bits of the set.

    Each task ends with rows that have a ``part`` and nothing else but its counters of shingles.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken = np.zeros(_PLACES, np.uint32)
        schema = None
        for batch in batches:
            for start, texts in _slices(batch.column(2)):
                sets = [np.unique(shingle_hashes(t, width)) for t in texts]
                taken += np.bincount(_places(np.concatenate(sets)), minlength=_PLACES).astype(np.uint32)
                digests = [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
                views = [sets]
                for factor in _MIX:
                    mixed = [x * factor for x in sets]
                    views.append([x ^ (x >> np.uint64(32)) for x in mixed])
                found = [pa.array(majority(v).view(np.int64)) for v in views]
                parities = [_parity(x) for x in sets]
                found += [pa.array([len(x) for x in sets], pa.int32()), pa.array(parities, pa.binary()), pa.array(map(_folded, parities), pa.binary())]
                found += [pa.array(map(_short, digests), pa.int64()), pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())]
                out = pa.RecordBatch.from_arrays(
                    [batch.column(k).slice(start, len(texts)) for k in (0, 1)] + [pa.array(digests, pa.binary()), *found],
                    ["id", "mark", "digest", "fp", "a", "b", "size", "parity", "fold", "short", "part", "counts"],
                )
                schema = out.schema
                yield out
        if schema is not None:
            for part, counts in enumerate(np.split(taken, _PARTS)):
                own = {"part": pa.array([part], pa.int32()), "counts": pa.array([counts.tobytes()], pa.binary())}
                yield pa.RecordBatch.from_arrays([own.get(f.name, pa.nulls(1, f.type)) for f in schema], schema=schema)

    return run


def _summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From ``(part, counts)``: the sum of each part."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            counts = np.frombuffer(counts.as_py(), np.uint32)
            total = sums.setdefault(part, np.zeros(len(counts), np.uint32))
            total += np.minimum(counts, ~total)  # stays at the largest number
    for part, total in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "counts"])


def _wide_keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp, *wide = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        for start in range(0, len(fp), 1024):
            own = slice(start, start + 1024)
            rows, keys = pair_keys([x for number in wide for x in _segments(number[own].view(np.uint64), _WIDE_SEGMENTS)])
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(fp[own][rows])], ["key", "fp"])


def _shingle_sets(width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in _slices(batch.column(1)):
                sets = [np.unique(shingle_hashes(t, width)) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), _lists(sets)], ["node", "shingles"])

    return run


def _prefixes(width: int, similarity: float, counts: np.ndarray):
    """From texts: ``(shingle, short)`` for the first shingles of each set, by counts of their places, then by hash."""

    def first(hashes: np.ndarray) -> np.ndarray:
        return hashes[np.argsort(counts[_places(hashes)], kind="stable")[: _prefix_length(len(hashes), similarity)]]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in _slices(batch.column(0)):
                sets = [np.unique(shingle_hashes(t, width)) for t in texts]
                firsts = [first(x) for x in sets]
                shorts = np.array([_short(xxhash.xxh3_128_digest(x.tobytes())) for x in sets], np.int64)
                rows = [np.concatenate(firsts).view(np.int64), np.repeat(shorts, [len(x) for x in firsts])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows], ["shingle", "short"])

    return run


def _shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From ``(shingle, short)`` in order: each row once, without shingles of one set."""
    for shingle, short in _whole_keys(batches):
        new = np.concatenate([[True], (shingle[1:] != shingle[:-1]) | (short[1:] != short[:-1])])
        shingle, short = shingle[new], short[new]
        same = shingle[1:] == shingle[:-1]
        several = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        yield pa.RecordBatch.from_arrays([pa.array(shingle[several]), pa.array(short[several])], ["shingle", "short"])


def _whole_keys(batches: Iterable[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of batches sorted by the first one, cut anew so that no key is in two parts."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        keys = columns[0]
        if not len(keys):
            continue
        last = int(np.searchsorted(keys, keys[-1], "left"))
        if last or (held and held[-1][0][-1] != keys[0]):
            yield [np.concatenate(parts) for parts in zip(*held, [c[:last] for c in columns], strict=True)]
            held = []
        held.append([c[last:] for c in columns])
    if held:
        yield [np.concatenate(parts) for parts in zip(*held, strict=True)]


def _pairs_of_small(key: np.ndarray, label: np.ndarray, size: np.ndarray, similarity: float) -> Iterator[np.ndarray]:
    """Pairs of places under one key, of different labels and fitting sizes, in keys of few rows."""
    for apart in range(1, min(_SMALL_GROUP, len(key))):
        at = np.nonzero(key[apart:] == key[:-apart])[0]
        if not len(at):
            break
        to = at + apart
        fits = (label[at] != label[to]) & (np.minimum(size[at], size[to]) >= similarity * np.maximum(size[at], size[to]) - 1e-9)
        yield np.stack([at[fits], to[fits]])


def _pairs_of_large(label: np.ndarray, size: np.ndarray, similarity: float) -> Iterator[np.ndarray]:
    """The same for the rows of one key; those of its largest label are met by others only, so that a large group costs time in proportion."""
    by_size = np.argsort(size, kind="stable")
    label, size = label[by_size], size[by_size]
    names, counts = np.unique(label, return_counts=True)
    largest = label == names[counts.argmax()]
    low = np.searchsorted(size, similarity * size - 1e-9, "left")
    high = np.searchsorted(similarity * size - 1e-9, size, "right")
    place = np.arange(len(label))
    for k in np.nonzero(~largest)[0]:
        window = slice(low[k], high[k])
        other = by_size[window][(label[window] != label[k]) & (largest[window] | (place[window] > k))]
        if len(other):
            yield np.stack([np.full(len(other), by_size[k]), other])


def _folds_fit(folds: np.ndarray, size: np.ndarray, similarity: float):
    """Which pairs of places (two rows) have parity bits that allow the similarity."""
    words = np.fromiter(map(len, folds), np.int64, len(folds)) // 8
    starts = np.cumsum(words) - words
    flat = np.frombuffer(b"".join(folds), np.uint64)

    def read(at: np.ndarray, width: int) -> np.ndarray:
        out = np.empty((len(at), width), np.uint64)
        for own in np.unique(words[at]):
            rows = np.nonzero(words[at] == own)[0]
            out[rows] = np.bitwise_xor.reduce(flat[starts[at[rows]][:, None] + np.arange(own)].reshape(len(rows), -1, width), axis=1)
        return out

    def fit(pairs: np.ndarray) -> np.ndarray:
        width, apart = words[pairs].min(axis=0), np.zeros(pairs.shape[1], np.int64)
        for own in np.unique(width):
            rows = np.nonzero(width == own)[0]
            step = max(1, _COMPARED // (8 * int(own)))
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                apart[part] = np.bitwise_count(read(pairs[0, part], own) ^ read(pairs[1, part], own)).sum(axis=1)
        return (1 + similarity) * apart <= (1 - similarity) * size[pairs].sum(axis=0) + 1e-6

    return fit


def _pairs_under_keys(similarity: float):
    """From ``(shingle, node, label, size, fold)`` sorted by shingle: pairs of nodes that may be similar, repeats left out as far as they are at hand.

    ``fold`` holds parity bits; without it, pairs of fitting sizes are found.
    """

    def met(key: np.ndarray, label: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
        bounds = np.concatenate([[0], np.nonzero(np.diff(key))[0] + 1, [len(key)]])
        sizes = np.diff(bounds)
        for k in np.nonzero(sizes > _SMALL_GROUP)[0]:
            own = slice(bounds[k], bounds[k + 1])
            yield from (bounds[k] + pairs for pairs in _pairs_of_large(label[own], size[own], similarity))
        small = np.nonzero(np.repeat((sizes > 1) & (sizes <= _SMALL_GROUP), sizes))[0]
        yield from (small[pairs] for pairs in _pairs_of_small(key[small], label[small], size[small], similarity))

    def found(batches: Iterable[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for key, node, label, size, *folds in _whole_keys(batches):
            fit = _folds_fit(folds[0], size, similarity) if folds else None
            for pairs in met(key, label, size):
                yield node[pairs[:, fit(pairs)] if fit else pairs]

    def sent(parts: list[np.ndarray]) -> pa.RecordBatch:
        pairs = np.unique(np.sort(np.concatenate(parts, axis=1), axis=0), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[k])) for k in (0, 1)], ["u", "v"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for part in found(batches):
            held.append(part)
            rows += part.shape[1]
            if rows > _PAIRS:
                yield sent(held)
                held, rows = [], 0
        if rows:
            yield sent(held)

    return run


def _parity_fits(similarity: float):
    """From ``(u, v, size_u, size_v, parity_u, parity_v)``: pairs whose parity bits allow the similarity."""

    def differing(x: bytes, y: bytes) -> int:
        x, y = (np.frombuffer(p, np.uint64) for p in sorted((x, y), key=len))
        while len(y) > len(x):
            y = y[: len(y) // 2] ^ y[len(y) // 2 :]
        return int(np.bitwise_count(x ^ y).sum())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = np.array([differing(x.as_py(), y.as_py()) for x, y in zip(batch.column(4), batch.column(5), strict=True)], np.float64)
            sizes = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            fits = pa.array((1 + similarity) * apart <= (1 - similarity) * sizes + 1e-6)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(fits) for k in (0, 1)], ["u", "v"])

    return run


def similar_groups(df: DataFrame, id_col: str, text_col: str, width: int, similarity: float, bits: int, stage: Stage) -> DataFrame:
    """``(id, mark, first)`` of each row of ``df``: ``first`` is the smallest ``(id, mark)`` of the row's group, where ``mark`` is a hash of the text.

    Groups are connected by links between sets of shingles whose exact similarity is ``similarity`` or more.
    """
    texts = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    texts = texts.select("id", F.xxhash64("text").alias("mark"), F.col("text").cast("binary").alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    columns = f"id {kind}, mark bigint, digest binary, fp bigint, a bigint, b bigint, size int, parity binary, fold binary, short bigint, part int, counts binary"
    passed = stage.table(texts.mapInArrow(_wide_fingerprints(width), columns), "marked")
    marked = passed.where("part IS NULL")
    # Rows with equal sets are one node; of nodes with equal fingerprints one, the hub, looks for others.
    nodes = marked.groupBy("digest").agg(F.min(F.struct("id", "mark")).alias("first"), *[F.max(c).alias(c) for c in ("fp", "a", "b", "size", "parity", "fold", "short")])
    nodes = stage.table(nodes.withColumn("number", F.monotonically_increasing_id()), "nodes")
    keyed = nodes.select("fp", "a", "b").distinct().mapInArrow(_wide_keyed, "key int, fp bigint")
    dealt = keyed.repartition("key").sortWithinPartitions("key")
    close = stage.table(dealt.mapInArrow(_linker(bits, _spanning_forest), "u bigint, v bigint").where("u != v").distinct(), "close")
    hubs = nodes.groupBy("fp").agg(F.min(F.struct("digest", "first")).alias("hub"), F.count(F.lit(1)).alias("n"))
    hubs = stage.table(hubs.select("fp", F.col("hub.digest").alias("hub_digest"), F.col("hub.first").alias("first"), "n"), "hubs")
    others = nodes.join(hubs.where("n > 1").select(F.col("fp").alias("h_fp"), "hub_digest"), F.col("fp") == F.col("h_fp")).where("digest != hub_digest")

    spent = [close]

    def shingles_of(wanted: DataFrame, key: str) -> DataFrame:
        """``(node, shingles)`` for the rows of ``wanted (key, first)``."""
        wanted = wanted.select(F.col(key).alias("node"), F.col("first.id").alias("n_id"), F.col("first.mark").alias("n_mark"))
        read = texts.join(wanted, F.col("id").eqNullSafe(F.col("n_id")) & (F.col("mark") == F.col("n_mark"))).select("node", "text").dropDuplicates(["node"])
        spent.append(stage.table(read.mapInArrow(_shingle_sets(width), f"node {wanted.schema['node'].dataType.simpleString()}, shingles array<bigint>"), "shingles"))
        return spent[-1]

    def alike(left: Column, right: Column) -> Column:
        both = F.size(F.array_intersect(left, right))
        return both >= similarity * (F.size(left) + F.size(right) - both) - 1e-9

    asked = close.select(F.col("u").alias("a_fp")).unionAll(close.select(F.col("v").alias("a_fp"))).unionAll(others.select(F.col("fp").alias("a_fp"))).distinct()
    sets = shingles_of(hubs.join(asked, F.col("fp") == F.col("a_fp"), "left_semi"), "fp")
    side = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"of_{c}"))
    linked = close.join(side("u"), "u").join(side("v"), "v").where(alike(F.col("of_u"), F.col("of_v")))
    components = connected_components(linked.select("u", "v"), stage)
    # A node that is no hub belongs to its hub's group if it is similar to the hub, else it is alone.
    own = shingles_of(others, "digest").select(F.col("node").alias("digest"), F.col("shingles").alias("of_own"))
    joined = others.select("digest", "fp").join(own, "digest").join(side("fp"), "fp").where(alike(F.col("of_own"), F.col("of_fp")))
    member = hubs.select(F.col("hub_digest").alias("m_digest")).unionAll(joined.select(F.col("digest").alias("m_digest")))
    rooted = nodes.join(components, F.col("fp") == F.col("node"), "left").join(member, F.col("digest") == F.col("m_digest"), "left")
    root = F.when(F.col("m_digest").isNotNull(), F.concat(F.lit("fp "), F.coalesce("component", "fp"))).otherwise(F.hex("digest"))
    rooted = stage.table(rooted.select("digest", "number", "first", root.alias("root")), "rooted")
    for table in spent:
        stage.drop(table)
    labels = rooted.groupBy("root").agg(F.min("number").alias("label"))
    labelled = stage.table(rooted.join(labels, "root").select("digest", "number", "first", "label"), "labelled")

    # Links that fingerprints missed, between the groups so far.
    partial = passed.where("part IS NOT NULL").select("part", "counts").mapInArrow(_summed, "part int, counts binary")
    summed = partial.repartition("part").mapInArrow(_summed, "part int, counts binary").toArrow().sort_by("part")
    counts = np.frombuffer(b"".join(summed["counts"].to_pylist()) or bytes(4 * _PLACES), np.uint32)
    counts = np.where(counts > _COMMON, counts, 0).astype(np.uint32)
    placed = texts.select("text").mapInArrow(_prefixes(width, similarity, counts), "shingle bigint, short bigint")
    shared = placed.repartition("shingle").sortWithinPartitions("shingle", "short").mapInArrow(_shared, "shingle bigint, short bigint")
    shared = stage.table(shared, "shared")
    owners = labelled.join(nodes.select("digest", "short", "size", "fold"), "digest").select("short", "number", "label", "size", "fold")
    owned = shared.join(owners, "short").select("shingle", "number", "label", "size", "fold")
    met = owned.repartition("shingle").sortWithinPartitions("shingle").mapInArrow(_pairs_under_keys(similarity), "u bigint, v bigint")
    met = stage.table(met.distinct(), "met")
    compared = lambda c: nodes.select(F.col("number").alias(c), F.col("size").alias(f"size_{c}"), F.col("parity").alias(f"parity_{c}"))
    compared = met.join(compared("u"), "u").join(compared("v"), "v").select("u", "v", "size_u", "size_v", "parity_u", "parity_v")
    near = stage.table(compared.mapInArrow(_parity_fits(similarity), "u bigint, v bigint"), "near")
    asked = near.select(F.col("u").alias("asked")).unionAll(near.select(F.col("v").alias("asked"))).distinct()
    sets = shingles_of(labelled.join(asked, F.col("number") == F.col("asked"), "left_semi"), "number")
    linked = near.join(side("u"), "u").join(side("v"), "v").where(alike(F.col("of_u"), F.col("of_v")))
    of = lambda c: labelled.select(F.col("number").alias(c), F.col("label").alias(f"label_{c}"))
    linked = linked.select("u", "v").join(of("u"), "u").join(of("v"), "v").select(F.col("label_u").alias("u"), F.col("label_v").alias("v"))
    joined_groups = connected_components(linked, stage)
    grouped = labelled.join(joined_groups, F.col("label") == F.col("node"), "left").select("digest", "first", F.coalesce("component", "label").alias("group"))
    least = grouped.groupBy("group").agg(F.min("first").alias("least"))
    of_digest = grouped.join(least, "group").select("digest", F.col("least").alias("first"))
    return marked.select("id", "mark", "digest").join(of_digest, "digest").select("id", "mark", "first")


def representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, bits: int = 16) -> DataFrame:
    """The rows of ``df``, with its columns, that stay: of each group of near copies the one with the smallest id.

    Documents link if the Jaccard similarity of their sets of ``width``-word shingles, exactly
    counted, is at least ``similarity``; words are lower-cased (A-Z). A text of fewer words is one
    shingle; null, empty and blank texts are equal. Candidates first come from fuzzy keys of 126 bits
    and may differ in ``bits`` of 64 more; links between the groups that these make are then found by an exact
    join, so that none is missed. Of rows that share id and text one stays; a null id is
    smaller than others. Other columns may have any name.
    """
    stage = Stage(df.sparkSession, "simhash")
    found = stage.table(similar_groups(df, id_col, text_col, width, similarity, bits, stage), "groups")
    kept = found.select(F.col("first.id").alias("_kept_id"), F.col("first.mark").alias("_kept_mark")).distinct()
    mark = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    held = df.select(F.col(id_col).alias("_id"), mark.alias("_mark"), F.struct(*[df[c] for c in df.columns]).alias("_row"))
    stays = held.join(kept, F.col("_id").eqNullSafe(F.col("_kept_id")) & (F.col("_mark") == F.col("_kept_mark")), "left_semi")
    if not found.groupBy("id", "mark").count().where("count > 1").isEmpty():
        stays = stays.dropDuplicates(["_id", "_mark"])
    return stays.select("_row.*")
