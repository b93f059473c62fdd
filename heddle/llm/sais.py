"""Suffix arrays by induced sorting, with whole-array numpy steps, and permuted common prefixes.

Suffixes are classified as smaller (S) or larger (L) than their right neighbour; the
leftmost S of each run is LMS. LMS substrings are sorted and named; if names repeat, the
reduced string of names is sorted recursively, which orders the LMS suffixes. From
these, two linear sweeps over the buckets of first symbols induce the order of all
suffixes: each sweep moves whole runs of a bucket at once, and goes on within a bucket
for as long as it puts new suffixes into it.

A reduced string has as many symbols as names, too many to sweep bucket by bucket;
there the suffixes up to their next LMS position, with that position's rank, are
ordered by refining groups of equals, the same step that names LMS substrings.
"""

from __future__ import annotations

import numpy as np


def is_smaller(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is of type S; the last symbol is a sentinel, smaller than all others."""
    turns = np.nonzero(text[1:] != text[:-1])[0]
    rises = text[turns] < text[turns + 1]
    out = np.ones(len(text), bool)
    out[:-1] = np.repeat(rises, np.diff(turns, prepend=-1))
    return out


def refine(symbols: np.ndarray, start: np.ndarray, stop: np.ndarray, width: int, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings ``symbols[start..stop]`` (inclusive), and the slot at which each one's group of equals begins.

    Symbols are at least 1 and take ``width`` bits. Groups are refined by as many symbols
    at a time as fit a number, and finally by ``last``.
    """
    n, at_once = len(start), 63 // width
    padded = np.concatenate([symbols.astype(np.int64), np.zeros(at_once, np.int64)])
    order, group = np.arange(n), np.zeros(n, np.int64)
    active, offset = np.arange(n), 0  # slots whose groups may still split
    while len(active):
        who = order[active]
        at = start[who] + offset
        left = stop[who] - at + 1  # symbols not compared yet
        key = np.zeros(len(who), np.int64)
        for k in range(at_once):
            key = (key << width) | np.where(k < left, padded[np.minimum(at + k, len(padded) - 1)], 0)
        active, offset = _split(order, group, active, who, key, left > at_once), offset + at_once
    if last is not None:
        slots = np.nonzero(_tied(group[order]))[0]
        who = order[slots]
        _split(order, group, slots, who, last[who], np.zeros(len(who), bool))
    return order, group


def _tied(sorted_group: np.ndarray) -> np.ndarray:
    same = sorted_group[1:] == sorted_group[:-1]
    return np.concatenate([same, [False]]) | np.concatenate([[False], same])


def _split(order, group, slots, who, key, more) -> np.ndarray:
    """Sort the members of tied groups by ``key`` in place; slots of groups that are still tied and have ``more`` to compare."""
    if not len(slots):
        return slots
    by = np.lexsort((key, group[who]))
    who, key, more = who[by], key[by], more[by]
    old = group[who]
    order[slots] = who
    fresh = np.concatenate([[True], (old[1:] != old[:-1]) | (key[1:] != key[:-1])])
    head = np.nonzero(fresh)[0]
    sizes = np.diff(head, append=len(who))
    group[who] = np.repeat(slots[head], sizes)
    # Equal keys have the same number of symbols left, so a group goes on as a whole.
    return slots[np.repeat(sizes > 1, sizes) & more]


def _bits(symbols: np.ndarray) -> int:
    return max(1, int(symbols.max()).bit_length())


def lms_ranks(text: np.ndarray, smaller: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """LMS positions in order of place, and the rank of each one's suffix among them."""
    lms = 1 + np.nonzero(smaller[1:] & ~smaller[:-1])[0]
    symbols = 2 * text.astype(np.int64) + smaller
    order, group = refine(symbols, lms, np.append(lms[1:], len(text) - 1), _bits(symbols))
    _, names = np.unique(group, return_inverse=True)
    if int(names.max(initial=-1)) + 1 == len(lms):
        return lms, names
    ranks = np.empty(len(lms), np.int64)
    ranks[_reduced_order(names)] = np.arange(len(lms))
    return lms, ranks


def _reduced_order(names: np.ndarray) -> np.ndarray:
    """Suffix array of a string of names whose last is the unique smallest."""
    smaller = is_smaller(names)
    lms, ranks = lms_ranks(names, smaller)
    symbols = 2 * names + smaller + 1
    n = len(names)
    following = np.searchsorted(lms, np.arange(n), "right")
    stop = np.append(lms, n - 1)[following]
    return refine(symbols, np.arange(n), stop, _bits(symbols), np.append(ranks, -1)[following])[0]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of bytes that end with a unique smallest byte."""
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64)
    smaller = is_smaller(text)
    lms, ranks = lms_ranks(text, smaller)
    sorted_lms = np.empty(len(lms), np.int64)
    sorted_lms[ranks] = lms
    counts = np.bincount(text, minlength=256)
    ends = np.cumsum(counts)
    starts = ends - counts
    out = np.full(n, -1, np.int64)
    lms_cut = np.searchsorted(text[sorted_lms], np.arange(257))

    head = starts.copy()

    def put_larger(found: np.ndarray) -> None:
        """Predecessors of type L go to the heads of their buckets, in the order found."""
        before = found[found > 0] - 1
        before = before[~smaller[before]]
        first = text[before]
        by = np.argsort(first, kind="stable")
        many = np.bincount(first, minlength=256)
        out[np.repeat(head - (np.cumsum(many) - many), many) + np.arange(len(before))] = before[by]
        np.add(head, many, out=head)

    for c in np.nonzero(counts)[0].tolist():
        done = int(starts[c])
        while done < head[c]:
            stop = int(head[c])
            put_larger(out[done:stop])
            done = stop
        put_larger(sorted_lms[lms_cut[c] : lms_cut[c + 1]])

    tail = ends.copy()

    def put_smaller(found: np.ndarray) -> None:
        """Predecessors of type S go to the tails of their buckets; ``found`` is in descending order."""
        before = found[found > 0] - 1
        before = before[smaller[before]]
        first = text[before]
        by = np.argsort(first, kind="stable")
        many = np.bincount(first, minlength=256)
        out[np.repeat(tail - 1 + (np.cumsum(many) - many), many) - np.arange(len(before))] = before[by]
        np.subtract(tail, many, out=tail)

    for c in np.nonzero(counts)[0][::-1].tolist():
        if c == text[-1]:
            out[starts[c]] = n - 1  # the sentinel, a bucket of its own
            put_smaller(out[starts[c] : ends[c]])
            continue
        done = int(ends[c])
        while done > tail[c]:
            stop = int(tail[c])
            put_smaller(out[stop:done][::-1])
            done = stop
        put_smaller(out[starts[c] : head[c]][::-1])
    return out


def permuted_lcp(text: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix, its predecessor in the suffix array (-1 for the first) and their common prefix.

    Where the symbols before both suffixes agree, the common prefix is that of the left
    neighbour less one; only the other places compare symbols, eight at a time.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    previous = np.maximum(before, 0)
    reducible = np.zeros(n, bool)
    reducible[1:] = (before[1:] > 0) & (before[:-1] >= 0) & (text[previous[1:] - 1] == text[:-1])
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.ndarray((n + 1,), "<u8", padded.tobytes(), 0, (1,))
    heads = np.nonzero(~reducible & (before >= 0))[0]
    a, b, common = heads.copy(), before[heads], np.zeros(len(heads), np.int64)
    live = np.arange(len(heads))
    while len(live):
        x, y = a[live] + common[live], b[live] + common[live]
        inside = np.maximum(x, y) < n  # the sentinel is unique, so a mismatch comes before the end
        differ = words[np.minimum(x, n)] ^ words[np.minimum(y, n)]
        same = (differ == 0) & inside
        low = differ & (~differ + np.uint64(1))
        equal_bytes = np.where(differ == 0, 8, np.bitwise_count(low - np.uint64(1)) // 8)
        common[live] += np.where(inside, equal_bytes, 0)
        live = live[same]
    value = np.zeros(n, np.int64)
    value[heads] = common
    start = np.zeros(n, np.int64)
    anchored = ~reducible
    start[anchored] = np.nonzero(anchored)[0]
    start = np.maximum.accumulate(start)
    return before, np.maximum(value[start] - (np.arange(n) - start), 0)
