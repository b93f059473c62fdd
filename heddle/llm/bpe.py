"""Byte-level BPE encoding and decoding by speculation and verification.

Encoding a word by the merge list is sequential, but *checking* a proposed token
sequence is not: a sequence is the merge result of its bytes exactly when every
adjacent pair of tokens is, and whether a pair is compatible depends on those two
tokens only. So each word gets a proposal by greedy longest match, and the pairs of
all proposals are checked together with array look-ups. Words with a failing pair
get further proposals, which take a shorter token where a pair fails, and step back
where none is left; a sequence whose pairs all pass is the merge result of its bytes,
so there is one at most, and no two searches meet. Only words that are long or need
many steps are merged exactly.

Pair check. Let the boundary lie between tokens ``a`` and ``b``. While the merges of
``a`` and ``b`` happen in order of rank, the pieces that touch the boundary are the
tokens on the right edge of ``a``'s merge tree and on the left edge of ``b``'s. The
pair is incompatible if some edge pieces ``x`` and ``y`` have a merge of their own
whose turn comes before either of them is absorbed into its parent.

Texts are never split into Python strings: pre-tokens are cut by array operations on
the code points of many texts, and each different one of a slice is encoded once.
Long texts are cut in pieces at spaces that follow a visible character: no pre-token
reaches across such a place.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.shared import bounded_batches
from heddle.llm.tables import NEVER, ByteTrie, PairTable

#: Kinds of characters that the byte-level pre-tokeniser tells apart, with Unicode white space spelt out.
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
#: Letters and numbers of Unicode 16, the library's version, that Python's tables of Unicode 15.1 lack.
_ADDED = {
    _LETTER: "1c89-1c8a a7cb-a7cd a7da-a7dc 105c0-105f3 10d4a-10d65 10d6f-10d85 10ec2-10ec4 11380-11389 1138b 1138e 11390-113b5 113b7 "
    "113d1 113d3 11bc0-11be0 13460-143fa 16100-1611d 16d40-16d6c 18cff 1e5d0-1e5ed 1e5f0",
    _NUMBER: "10d40-10d49 116d0-116e3 11bf0-11bf9 16130-16139 16d70-16d79 1ccf0-1ccf9 1e5f1-1e5fa",
}
_SAFE_CUT = re.compile(rb"[!-~](?= )")
_SUFFIX_ONE = np.array([ord(c) for c in "stmd"], np.uint32)
_SUFFIX_TWO = np.array([ord(a) << 21 | ord(b) for a, b in ("re", "ve", "ll")], np.uint64)

_TOGETHER_BYTES = 40
_WALKED_BYTES = 128
_STEPS = 64
_VERDICTS = 1 << 20
_PIECE_BYTES = 1 << 20
_SLICE_BYTES = 2 << 20


def _printable_bytes() -> dict[str, int]:
    """Characters that stand for bytes in the vocabulary file: printable Latin-1 for itself, others from U+0100 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class SpeculativeBpe:
    """One vocabulary with the verdicts on pairs seen; lives as long as the Python worker."""

    def __init__(self, tokenizer_json: str):
        spec = json.loads(tokenizer_json)
        byte_of = _printable_bytes()
        vocab = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        for content in self.special:
            vocab.pop(content.encode(), None)
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = token
        for content, i in self.special.items():
            self.token_bytes[i] = content.encode()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        raw = [(bytes(byte_of[c] for c in a), bytes(byte_of[c] for c in b)) for a, b in pairs]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        left, right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        made_at = np.full(size, NEVER, np.int64)
        for rank, (a, b) in enumerate(raw):
            made = vocab[a + b]
            self.merges.setdefault((vocab[a], vocab[b]), (rank, made))
            if left[made] < 0:
                left[made], right[made], made_at[made] = vocab[a], vocab[b], rank
        self.pairs = PairTable(self.merges, shift=40)
        self.right_edge, self.right_until = self._edge(right, made_at)
        self.left_edge, self.left_until = self._edge(left, made_at)
        self.byte_ids = [vocab[bytes([b])] for b in range(256)]
        self._set_proposals(vocab, left, right)
        self.verdict_keys, self.verdicts = np.full(_VERDICTS, -1, np.int64), np.zeros(_VERDICTS, bool)
        self.kinds = _kinds()
        self.pattern = (
            re.compile(b"|".join(re.escape(c.encode()) for c in sorted(self.special, key=len, reverse=True))) if self.special else None
        )
        self.in_pieces = not any(" " in content for content in self.special)
        self.token_array = pa.array(self.token_bytes, pa.large_binary())

    @staticmethod
    def _edge(child: np.ndarray, made_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each token's edge from the token itself downwards, and the rank at which each piece is absorbed."""
        level, until = np.arange(len(child)), np.full(len(child), NEVER, np.int64)
        edges, untils = [], []
        while (level >= 0).any():
            edges.append(level)
            untils.append(until)
            inside = level >= 0
            until = np.where(inside, made_at[level], NEVER)
            level = np.where(inside, child[level], -1)
        return np.stack(edges), np.stack(untils)

    def _set_proposals(self, vocab: dict[bytes, int], left: np.ndarray, right: np.ndarray) -> None:
        """Tokens that their own bytes encode to: both halves are such tokens, and no merge across them comes first."""
        whole = np.nonzero(left >= 0)[0]
        fits = ~self._crossed(left[whole], right[whole], skip_top=True)
        good = left < 0
        for i, ok in sorted(zip(whole.tolist(), fits.tolist(), strict=True), key=lambda x: len(self.token_bytes[x[0]])):
            good[i] = ok and good[left[i]] and good[right[i]]
        self.proposals = {token: i for token, i in vocab.items() if good[i]}
        self.lengths = np.fromiter(map(len, self.token_bytes), np.int64, len(self.token_bytes))
        self.trie = ByteTrie(self.proposals)
        #: The next shorter token that a token starts with, -1 if there is none.
        self.shorter = np.full(len(self.token_bytes), -1, np.int64)
        for token, i in self.proposals.items():
            self.shorter[i] = next((self.proposals[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.proposals), -1)

    def _crossed(self, a: np.ndarray, b: np.ndarray, skip_top: bool = False) -> np.ndarray:
        """For each pair, whether some merge across its boundary gets its turn."""
        bad = np.zeros(len(a), bool)
        for i in range(len(self.right_edge)):
            rows_i = np.nonzero(~bad & (self.right_edge[i][a] >= 0))[0]
            if not len(rows_i):
                break
            for j in range(len(self.left_edge)):
                if skip_top and i == j == 0:
                    continue
                rows = rows_i[self.left_edge[j][b[rows_i]] >= 0]
                if not len(rows):
                    break
                rank, _ = self.pairs.find(self.right_edge[i][a[rows]], self.left_edge[j][b[rows]])
                bad[rows] |= (rank < self.right_until[i][a[rows]]) & (rank <= self.left_until[j][b[rows]]) & (rank < NEVER)
        return bad

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Vectorised verdict for adjacent pairs; each slot of a fixed table keeps the latest pair that fell on it."""
        keys = (a << 32) | b
        slots = self._verdict_slot(keys)
        good = self.verdicts[slots]
        unknown = np.nonzero(self.verdict_keys[slots] != keys)[0]
        if len(unknown):
            fresh, back = np.unique(keys[unknown], return_inverse=True)
            verdict = ~self._crossed(fresh >> 32, fresh & 0xFFFFFFFF)
            good[unknown] = verdict[back]
            slots, last = np.unique(self._verdict_slot(fresh), return_index=True)
            self.verdict_keys[slots], self.verdicts[slots] = fresh[last], verdict[last]
        return good

    @staticmethod
    def _verdict_slot(keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed >> np.uint64(40)) & np.uint64(_VERDICTS - 1)).astype(np.int64)

    def propose(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match over tokens that stand for themselves: all words' tokens, and how many each has.

        Words lie in ``text`` one after the other. Short ones look up their tokens as they come to them, long ones every place at once.
        """
        token = np.full(len(text), -1, np.int64)
        long = ends - starts > _WALKED_BYTES
        if long.any():
            places = np.nonzero(np.repeat(long, ends - starts))[0]
            token[places] = self.trie.longest(text, places, np.repeat(ends[long], (ends - starts)[long]))
        chosen = np.zeros(len(text), bool)
        at, limit = starts[ends > starts], ends[ends > starts]
        while len(at):
            chosen[at] = True
            unknown = token[at] < 0
            if unknown.any():
                token[at[unknown]] = self.trie.longest(text, at[unknown], limit[unknown])
            at = at + self.lengths[token[at]]
            going = at < limit
            at, limit = at[going], limit[going]
        before = np.concatenate([[0], np.cumsum(chosen)])
        return token[chosen], before[ends] - before[starts]

    def propose_again(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sequences without a failing pair, longest match first: tokens, their number, and which words are done.

        All words take a step together; words that need more than ``_STEPS`` are left.
        """
        n = len(starts)
        chain = np.full((n, int((ends - starts).max()) + 1), -1, np.int32)
        depth, done = np.zeros(n, np.int64), np.zeros(n, bool)
        rows, at, limit = np.arange(n), starts.copy(), ends
        next_token = self.trie.longest(text, at, limit)
        for _ in range(_STEPS):
            if not len(rows):
                break
            level = depth[rows]
            before = chain[rows, level - 1].astype(np.int64)
            fits = (next_token >= 0) & (level == 0)
            check = np.nonzero((next_token >= 0) & (level > 0))[0]
            fits[check] = self.compatible(before[check], next_token[check])
            taken, gone = np.nonzero(fits)[0], np.nonzero(next_token < 0)[0]
            refused = np.nonzero(~fits & (next_token >= 0))[0]
            next_token[refused] = self.shorter[next_token[refused]]
            depth[rows[gone]] -= 1  # no token is left here: the one before must be shorter
            at[gone] -= self.lengths[before[gone]]
            next_token[gone] = self.shorter[before[gone]]
            chain[rows[taken], level[taken]] = next_token[taken]
            depth[rows[taken]] += 1
            at[taken] += self.lengths[next_token[taken]]
            ended = at[taken] == limit[taken]
            done[rows[taken[ended]]] = True
            taken = taken[~ended]
            next_token[taken] = self.trie.longest(text, at[taken], limit[taken])
            going = ~done[rows] & ((depth[rows] > 0) | (next_token >= 0))
            rows, at, limit, next_token = rows[going], at[going], limit[going], next_token[going]
        sizes = np.where(done, depth, 0)
        return chain[np.arange(chain.shape[1]) < sizes[:, None]], sizes, done

    def merge_together(self, words: list[bytes]) -> list[np.ndarray]:
        """The merge list applied to many short words at once: each round makes every word's next merge."""
        n, width = len(words), max(map(len, words))
        tokens = np.full((n, width + 1), -1, np.int64)
        sizes = np.fromiter(map(len, words), np.int64, n)
        inside = np.arange(width + 1) < sizes[:, None]
        tokens[inside] = np.array(self.byte_ids, np.int64)[np.frombuffer(b"".join(words), np.uint8)]
        ranks = np.full((n, width), NEVER, np.int64)
        slots = np.zeros((n, width), np.int64)
        both = inside[:, 1:]
        ranks[both], slots[both] = self.pairs.find(tokens[:, :-1][both], tokens[:, 1:][both])
        done: list[np.ndarray] = [tokens[0, :0]] * n
        rows, columns = np.arange(n), np.arange(width + 1)
        while len(rows):
            at = ranks.argmin(axis=1)
            line = np.arange(len(rows))
            ready = ranks[line, at] == NEVER
            for k in np.nonzero(ready)[0].tolist():
                done[rows[k]] = tokens[k][tokens[k] >= 0]
            if ready.any():
                rows, at, tokens, ranks, slots = rows[~ready], at[~ready], tokens[~ready], ranks[~ready], slots[~ready]
                line = np.arange(len(rows))
            if not len(rows):
                break
            made = self.pairs.made[slots[line, at]]
            later = columns[None, :-1] > at[:, None]
            tokens[:, :-1] = np.where(later, tokens[:, 1:], tokens[:, :-1])
            tokens[:, -1] = -1
            tokens[line, at] = made
            ranks[:, :-1] = np.where(later[:, :-1], ranks[:, 1:], ranks[:, :-1])
            slots[:, :-1] = np.where(later[:, :-1], slots[:, 1:], slots[:, :-1])
            ranks[:, -1] = NEVER
            for place in (at - 1, at):
                good = place >= 0
                good[good] &= tokens[line[good], place[good] + 1] >= 0
                ranks[line[place >= 0], place[place >= 0]] = NEVER
                ranks[line[good], place[good]], slots[line[good], place[good]] = self.pairs.find(
                    tokens[line[good], place[good]], tokens[line[good], place[good] + 1]
                )
        return done

    def merge_exactly(self, word: bytes) -> list[int]:
        """The merge list applied in order of rank, leftmost first, over a linked list."""
        tokens = [self.byte_ids[b] for b in word]
        n = len(tokens)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        queue = [(*self.merges[p], i, *p) for i in range(n - 1) if (p := (tokens[i], tokens[i + 1])) in self.merges]
        queue = [(rank, i, a, b, made) for rank, made, i, a, b in queue]
        heapq.heapify(queue)
        while queue:
            _, i, a, b, made = heapq.heappop(queue)
            if not alive[i] or tokens[i] != a or (j := after[i]) >= n or tokens[j] != b:
                continue
            tokens[i], alive[j], after[i] = made, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (found := self.merges.get((tokens[x], tokens[y]))):
                    heapq.heappush(queue, (found[0], x, tokens[x], tokens[y], found[1]))
        return [t for t, live in zip(tokens, alive, strict=True) if live]

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of different words (large binary): where in the array of tokens each word's are, and how many."""
        bounds = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, 8 * words.offset)
        text = np.frombuffer(words.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
        starts, ends = bounds[:-1] - bounds[0], bounds[1:] - bounds[0]
        flat, sizes = self.propose(text, starts, ends)
        first = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(words)), sizes)
        inner = np.nonzero(owner[1:] == owner[:-1])[0]
        failing = np.zeros(len(words), bool)
        failing[owner[inner[~self.compatible(flat[inner], flat[inner + 1])]]] = True
        found, made = [flat], len(flat)

        def put(rows: np.ndarray, tokens: np.ndarray, counts: np.ndarray) -> None:
            nonlocal made
            first[rows], sizes[rows] = made + np.cumsum(counts) - counts, counts
            found.append(tokens)
            made += len(tokens)

        short = np.nonzero(failing & (ends - starts <= _TOGETHER_BYTES))[0]
        if len(short):
            tokens, counts, done = self.propose_again(text, starts[short], ends[short])
            put(short[done], tokens, counts[done])
            failing[short[done]] = False
        by_width: dict[int, list[int]] = {}
        for k in np.nonzero(failing)[0].tolist():
            size = int(ends[k] - starts[k])
            by_width.setdefault((size + 7) // 8 if size <= _TOGETHER_BYTES else -1, []).append(k)
        for width, rows in by_width.items():
            spelt = [text[starts[k] : ends[k]].tobytes() for k in rows]
            merged = self.merge_together(spelt) if width > 0 else [np.array(self.merge_exactly(w), np.int64) for w in spelt]
            put(np.array(rows), np.concatenate(merged), np.fromiter(map(len, merged), np.int64, len(merged)))
        return np.concatenate(found), first, sizes

    def word_starts(self, text: bytes, breaks: np.ndarray, special: np.ndarray) -> np.ndarray:
        """Where the pre-tokens of several texts start, as ``text`` holds them one after the other.

        ``breaks`` are the places where a text or a special token starts or ends, ``special``
        has the start and end of each special token.
        """
        points = np.frombuffer(text.decode().encode("utf-32-le"), "<u4")
        raw = np.frombuffer(text, np.uint8)
        place = np.nonzero((raw & 0xC0) != 0x80)[0]
        n = len(points)
        fresh = np.zeros(n + 3, bool)
        fresh[np.searchsorted(place, breaks)] = True
        fresh[n:] = True
        kind = self.kinds[points]
        start = np.zeros(n + 3, bool)
        start[:n] = fresh[:n]
        start[1:n] |= kind[1:] != kind[:-1]
        # The last of several white-space characters stands alone, and a space joins what follows it.
        last = np.nonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~fresh[1:n])[0]
        start[last] = True
        start[last[points[last] == ord(" ")] + 1] = False
        # An apostrophe that starts a pre-token takes one of seven suffixes with it; the letters after them start anew.
        marks = np.nonzero((points[:-1] == ord("'")) & start[: n - 1] & ~fresh[1:n])[0]
        one = marks[np.isin(points[marks + 1], _SUFFIX_ONE)]
        marks = marks[marks + 2 < n]
        marks = marks[~fresh[marks + 2]]
        two = marks[np.isin(points[marks + 1].astype(np.uint64) << np.uint64(21) | points[marks + 2], _SUFFIX_TWO)]
        start[one + 1], start[one + 2] = False, True
        start[two + 1], start[two + 3] = False, True
        for a, b in np.searchsorted(place, special).tolist():
            start[a + 1 : b] = False
        return place[start[:n]]

    def _pieces(self, text: bytes, bounds: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
        """Consecutive stretches of about ``size`` bytes that end with a text, or at a safe cut of a long one."""
        at, end = int(bounds[0]), int(bounds[-1])
        while at < end:
            stop = int(bounds[np.searchsorted(bounds, at + size, "right") - 1])
            if stop <= at:
                stop = int(bounds[np.searchsorted(bounds, at, "right")])
                if self.in_pieces and (cut := _SAFE_CUT.search(text, at + size, stop)):
                    stop = cut.end()
            yield at, stop
            at = stop

    def _specials(self, text: bytes, bounds: np.ndarray) -> np.ndarray:
        """Start and end of each special token in the texts."""
        found: list[tuple[int, int]] = []
        if self.pattern and self.pattern.search(text):
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                found.extend((a + m.start(), a + m.end()) for m in self.pattern.finditer(text[a:b]))
        return np.array(found, np.int64).reshape(-1, 2)

    def encode_joined(self, text: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the bounds of each text's; ``bounds`` are those of the texts in bytes."""
        special = self._specials(text, bounds)
        made, total, ends = [np.zeros(0, np.uint32)], 0, np.zeros(len(bounds), np.int64)
        for low, high in self._pieces(text, bounds, _SLICE_BYTES):
            here = slice(*np.searchsorted(bounds, [low, high], "right"))
            inside = special[(special[:, 0] >= low) & (special[:, 1] <= high)]
            ids, before = self._encode_stretch(text, np.unique([low, *bounds[here], high]), inside, bounds[here])
            ends[here] = total + before
            made.append(ids)
            total += len(ids)
        return np.concatenate(made), ends

    def _encode_stretch(self, text: bytes, bounds: np.ndarray, special: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts with these bounds, and how many come before each of ``places``."""
        breaks = np.union1d(bounds, special)
        starts = []
        for a, b in self._pieces(text, bounds, _PIECE_BYTES):
            inside = special[(special[:, 0] >= a) & (special[:, 1] <= b)]
            here = breaks[np.searchsorted(breaks, a) : np.searchsorted(breaks, b)]
            starts.append(a + self.word_starts(text[a:b], here - a, inside - a))
        starts = np.concatenate([*starts, bounds[-1:]])
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(text)])
        words = words.dictionary_encode()
        number, words = words.indices.to_numpy(), words.dictionary
        ids, first, sizes = self.encode_words(words)
        if len(special):
            rows = number[np.searchsorted(starts, special[:, 0])]
            first[rows], sizes[rows] = len(ids) + np.arange(len(rows)), 1
            ids = np.concatenate([ids, [self.special[text[a:b].decode()] for a, b in special.tolist()]])
        each = sizes[number]
        ends = np.concatenate([[0], np.cumsum(each)])
        wanted = np.repeat(first[number] - ends[:-1], each)
        wanted += np.arange(ends[-1])
        return ids.astype(np.uint32)[wanted], ends[np.searchsorted(starts, places)]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        spelt = [t.encode() for t in texts]
        ids, ends = self.encode_joined(b"".join(spelt), np.concatenate([[0], np.cumsum([len(t) for t in spelt])]).astype(np.int64))
        packed = ids.astype("<u4").tobytes()
        return [packed[4 * a : 4 * b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def decode_joined(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The texts of consecutive lists of ids, as ``decode`` makes them."""
        spelt = self.token_array.take(pa.array(ids))
        bounds = np.frombuffer(spelt.buffers()[1], np.int64, len(ids) + 1)[ends] if len(ids) else ends
        data = spelt.buffers()[2] or pa.py_buffer(b"")
        texts = pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(_narrow(bounds)), data])
        try:
            return texts.cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([t.decode("utf-8", "replace") for t in texts.to_pylist()], pa.string())

    def decode(self, packed: bytes) -> str:
        """Bytes of the tokens joined; ill-formed UTF-8 becomes U+FFFD."""
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(packed, "<u4").tolist())).decode("utf-8", "replace")


def _kinds() -> np.ndarray:
    """The kind of every code point."""
    every = list(map(chr, range(0x110000)))
    major = np.frombuffer("".join(map(unicodedata.category, every)).encode(), "S1")[::2]
    kinds = np.full(len(every), _OTHER, np.uint8)
    kinds[major == b"L"], kinds[major == b"N"] = _LETTER, _NUMBER
    for kind, ranges in _ADDED.items():
        for low, *high in (r.split("-") for r in ranges.split()):
            kinds[int(low, 16) : int((high or [low])[0], 16) + 1] = kind
    kinds[[ord(c) for c in re.findall(f"[{_WS}]", "".join(every[:0x3001]))]] = _SPACE
    return kinds


_WORKER: dict[int, SpeculativeBpe] = {}


def _loaded(tokenizer_json: str) -> SpeculativeBpe:
    key = hash(tokenizer_json)
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = SpeculativeBpe(tokenizer_json)
    return _WORKER[key]


def _release() -> None:
    """Workers are used again by later stages: free what only this task needed."""
    pa.default_memory_pool().release_unused()


def _sent(made: pa.RecordBatch, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """What was made of ``part`` in batches for about _PIECE_BYTES of text: Spark keeps whole batches outside its heap."""
    at = 0
    for rows in _slices(part, 1, _PIECE_BYTES):
        yield made.slice(at, len(rows))
        at += len(rows)


def _narrow(bounds: np.ndarray) -> np.ndarray:
    """Bounds as 32-bit offsets, as Arrow's plain types have them."""
    if bounds[-1] > np.iinfo(np.int32).max:
        raise OverflowError(f"one slice makes {bounds[-1]} bytes, more than an Arrow column holds")
    return bounds.astype(np.int32)


def _slices(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with about ``size`` bytes of text, one row at least."""
    sizes = batch.column(column).cast(pa.large_string() if pa.types.is_string(batch.schema.field(column).type) else pa.large_binary())
    sizes = np.frombuffer(sizes.buffers()[1], np.int64, len(batch) + 1, 8 * sizes.offset) if len(batch) else np.zeros(1, np.int64)
    start = 0
    while start < len(batch):
        stop = max(start + 1, int(np.searchsorted(sizes, sizes[start] + size, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def _joined(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """All texts one after the other, and their bounds in bytes; nulls are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return b"", np.zeros(1, np.int64)
    bounds = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
    return (column.buffers()[2] or pa.py_buffer(b""))[int(bounds[0]) : int(bounds[-1])].to_pybytes(), bounds - bounds[0]


def _broadcast(df: DataFrame, tokenizer: str):
    """The vocabulary file's text (a fixed size of a few MB), read once by the driver."""
    bounded_batches(df.sparkSession)
    with open(tokenizer, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, ids array<int>)``: token ids of every whole text.

    A null text counts as empty and has no ids. Strings of special tokens inside a text
    become those tokens, as in the library's ``encode(add_special_tokens=False)``.
    Rows are independent: repeated rows, an empty table and further columns (ignored)
    need no care. There is no shuffle.
    """
    vocabulary = _broadcast(df, tokenizer)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(vocabulary.value)
        for batch in batches:
            for part in _slices(batch, 1, _SLICE_BYTES):
                ids, ends = bpe.encode_joined(*_joined(part.column(1)))
                lists = pa.ListArray.from_arrays(pa.array(_narrow(ends)), pa.array(ids.astype(np.int32)))
                yield from _sent(pa.RecordBatch.from_arrays([part.column(0), lists], [id_col, "ids"]), part)
        _release()

    source = df.select(F.col(id_col), F.col(text_col).cast("string"))
    return source.mapInArrow(run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, ids array<int>")


def decode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id_col, text)``: the text of each list of ids; null or empty lists give an empty text."""
    vocabulary = _broadcast(df, tokenizer)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(vocabulary.value)
        for batch in batches:
            texts = [bpe.decode(np.array(ids or [], "<u4").tobytes()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    source = df.select(F.col(id_col), F.col(ids_col))
    return source.mapInArrow(run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, text string")


def round_trip(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_tokens, ids_le, decoded)``: encode and decode in one pass over the rows.

    ``ids_le`` holds the ids as little-endian unsigned 32-bit integers, ``decoded`` the
    text that ``decode`` makes of them. Nulls and special tokens as in ``encode``.
    """
    vocabulary = _broadcast(df, tokenizer)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(vocabulary.value)
        for batch in batches:
            for part in _slices(batch, 1, _SLICE_BYTES):
                ids, ends = bpe.encode_joined(*_joined(part.column(1)))
                packed = [None, pa.py_buffer(_narrow(4 * ends)), pa.py_buffer(ids.astype("<u4"))]
                made = pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(np.diff(ends), pa.int64()),
                        pa.BinaryArray.from_buffers(pa.binary(), len(part), packed),
                        bpe.decode_joined(ids, ends),
                    ],
                    [id_col, "n_tokens", "ids_le", "decoded"],
                )
                yield from _sent(made, part)
        _release()

    source = df.select(F.col(id_col), F.col(text_col).cast("string"))
    return source.mapInArrow(run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, n_tokens bigint, ids_le binary, decoded string")
