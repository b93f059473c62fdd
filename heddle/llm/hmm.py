"""Scoring texts with a hidden Markov language model.

Latent states emit words; Baum-Welch trains them. Each frequent word (a bounded list) has
an emission of its own in each state. All other words of the corpus belong to classes
by their endings; a class has an emission in each state, spread over its words by their
smoothed counts, so that every word, seen or not, has a probability and tells about
states.

Training. Word counts cover all training texts. The model is seeded by noise on them, and
Baum-Welch then goes over all training texts several times. The texts are dealt into
slices; after each slice the model is fitted to the newest expected counts of all slices
(incremental expectation maximisation, Neal and Hinton 1998), so a pass makes as many
steps as there are slices. Tasks run the scaled forward-backward recursion over windows of
whole texts, with some tokens of warm-up around what a window counts, and emit expected
counts, which are aggregated for each word and each pair of states. The driver holds the
model (a few numbers for each frequent word, class and state).

Scoring. The scaled forward recursion runs over each whole text, its exact likelihood
under the model. Words outside the frequent list get their counts by a join, since the
vocabulary grows with the corpus and is never broadcast.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm.shared import Stage, word_lists

_FLUSH_WORDS = 300_000
_TEXTS = 1000  # texts that are encoded or cut into windows together
_BLOCK = 512  # windows whose recursions run together
_TOKENS_A_TASK = 50_000_000  # that a task of a training step takes at the most, on average
_END = 0  # the id of ends; then come classes, then frequent words
_ENDING = 3  # bytes of a word that decide on its class


@dataclass
class Hmm:
    start: np.ndarray  # by state
    move: np.ndarray  # state by next state
    emit: np.ndarray  # id by state


def count_words(df: DataFrame, text_col: str) -> DataFrame:
    """``(word, c)`` over all rows; each task adds up before the shuffle. Words are bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])
            counts.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                for words in word_lists(text.as_py() or b""):
                    counts.update(words)
                if len(counts) > _FLUSH_WORDS:
                    yield rows()
        yield rows()

    texts = df.select(F.col(text_col).cast("string").cast("binary"))
    return texts.mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def most_frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The ``most`` words with the largest counts, ties by a hash of the word.

    Histograms find the smallest count that is taken (first by sixteenths of an octave, then
    exactly) and, among the words that have it, the largest hash; so little more than ``most`` words
    are sent to the driver, whatever the number of tasks or ties.
    """

    def reached(by: Column, some: DataFrame, need: int) -> tuple[int | None, int]:
        """The last value of ``by``, largest first, that is needed to hold ``need`` rows, and the rows before it."""
        held = 0
        for value, n in sorted(map(tuple, some.groupBy(by.alias("value")).agg(F.count(F.lit(1))).collect()), reverse=True):
            if held + n >= need:
                return value, held
            held += n
        return None, held

    octave, ties = F.floor(F.log2("c") * 16), F.shiftrightunsigned(F.xxhash64("word"), 52)
    bin_of, before = reached(octave, counts, most)
    wanted = F.lit(True)
    if bin_of is not None:
        count, inside = reached(F.col("c"), counts.where(octave == bin_of), most - before)
        tie, _ = reached(-ties, counts.where(F.col("c") == count), most - before - inside)
        wanted = (F.col("c") > count) | ((F.col("c") == count) & (-ties >= tie))
    found = counts.where(wanted).select("word", "c", F.xxhash64("word")).collect()
    ordered = sorted(((bytes(w), c, h % (1 << 64)) for w, c, h in found), key=lambda x: (-x[1], x[2], x[0]))
    return [(w, c) for w, c, _ in ordered[:most]]


def word_class(word: bytes, classes: int) -> int:
    """The id of a word that is not frequent."""
    return 1 + zlib.crc32(word[-_ENDING:]) % classes


def encode(df: DataFrame, frequent: list[bytes], classes: int, slices: int) -> DataFrame:
    """``(slice, row, id, ids, rare)`` from ``(row, id, learn, text)``.

    ``ids`` has two bytes for each token, ``rare`` the different words that are not frequent, with
    their numbers. Slices deal out texts that the model learns from; others have slice -1.
    """
    shared = df.sparkSession.sparkContext.broadcast({w: k + 1 + classes for k, w in enumerate(frequent)})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        turn = 0
        for batch in batches:
            for start in range(0, len(batch), _TEXTS):
                part = batch.slice(start, _TEXTS)
                ids, words, times, sizes = [], [], [], [0]
                for text in part.column(3):
                    rare: Counter[bytes] = Counter()
                    own = []
                    for some in word_lists(text.as_py() or b""):
                        found = list(map(number.get, some))
                        if None in found:
                            others = [w for w, k in zip(some, found, strict=True) if k is None]
                            rare.update(others)
                            kinds = iter([word_class(w, classes) for w in others])
                            found = [next(kinds) if k is None else k for k in found]
                        own.append(np.array(found, "<u2"))
                    own.append(np.array([_END], "<u2"))
                    ids.append(np.concatenate(own).tobytes())
                    words += rare.keys()
                    times += rare.values()
                    sizes.append(len(words))
                learn = part.column(2).to_numpy(zero_copy_only=False)
                slot = np.where(learn, (turn + np.arange(len(part))) % slices, -1).astype(np.int32)
                turn += len(part)
                entries = pa.StructArray.from_arrays([pa.array(words, pa.binary()), pa.array(times, pa.int64())], ["word", "times"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(slot), part.column(0), part.column(1), pa.array(ids, pa.binary()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), entries)],
                    ["slice", "row", "id", "ids", "rare"],
                )

    kind = df.schema["id"].dataType.simpleString()
    texts = df.select("row", "id", "learn", F.col("text").cast("binary"))
    return texts.mapInArrow(run, f"slice int, row bigint, id {kind}, ids binary, rare array<struct<word:binary,times:bigint>>")


@dataclass
class Windows:
    """Parts of texts in descending order of length; tokens ``core_from`` to ``core_to`` of a window are counted in it alone."""

    tokens: np.ndarray  # of all texts, one after the other
    first: np.ndarray
    size: np.ndarray
    core_from: np.ndarray
    core_to: np.ndarray
    opens: np.ndarray  # whether it starts where its text does


def windows(ids: list[bytes], core: int, warm_up: int) -> Windows:
    """Each token of each text is in the core of one window, with up to ``warm_up`` tokens of the text on either side."""
    tokens = np.frombuffer(b"".join(ids), "<u2")
    length = np.fromiter((len(p) // 2 for p in ids), np.int64, len(ids))
    parts = -(-length // core)
    text = np.repeat(np.arange(len(ids)), parts)
    core_at = (np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)) * core
    begin = np.maximum(core_at - warm_up, 0)
    end = np.minimum(core_at + core, length[text])
    stop = np.minimum(end + warm_up, length[text])
    order = np.argsort(begin - stop, kind="stable")
    values = ((np.cumsum(length) - length)[text] + begin, stop - begin, core_at - begin, end - begin, begin == 0)
    return Windows(tokens, *(v[order] for v in values))


def forward_backward(some: Windows, model: Hmm, at: int = 0, most: int = _BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts of starts, moves and (id, state) in the cores of windows ``at`` to ``at + most``, and their natural log likelihood.

    Recursions are in single precision, scaled at each place. A window that does not open
    its text starts from any state.
    """
    size, states = some.size[at : at + most], len(model.start)
    n, length = len(size), int(size[0])
    live = n - np.searchsorted(size[::-1], np.arange(length + 1), "right")
    place = np.arange(length)[:, None]
    token = some.tokens[np.minimum(some.first[at : at + most] + place, len(some.tokens) - 1)]
    counted = ((place >= some.core_from[at : at + most]) & (place < some.core_to[at : at + most])).astype(np.float32)
    top = model.emit.max(axis=1, keepdims=True)
    emission = (model.emit / top).astype(np.float32)
    opens = some.opens[at : at + most]
    # By place, state, window: sums over states then run along contiguous rows.
    emit = np.ascontiguousarray(emission[token].transpose(0, 2, 1))
    forward = np.empty((length, states, n), np.float32)
    scale = np.ones((length, n), np.float32)
    move, back_move = np.ascontiguousarray(model.move.T, np.float32), model.move.astype(np.float32)
    for t in range(length):
        k = live[t]
        own = forward[t, :, :k]
        if t:
            np.matmul(move, forward[t - 1, :, :k], out=own)
        else:
            own[:] = np.where(opens[:k], model.start[:, None], 1.0 / states)
        own *= emit[t, :, :k]
        np.sum(own, axis=0, out=scale[t, :k])
        own /= scale[t, :k]
    emit /= scale[:, None, :]
    moves = np.zeros((states, states))
    backward = np.ones((states, n), np.float32)
    for t in range(length - 1, -1, -1):
        k = live[t]
        ahead = backward[:, :k] * emit[t, :, :k]
        # From here on ``emit`` holds the share of each state.
        np.multiply(forward[t, :, :k], backward[:, :k], out=emit[t, :, :k])
        emit[t, :, :k] *= counted[t, :k]
        emit[t, :, k:] = 0.0
        if t:
            np.matmul(back_move, ahead, out=backward[:, :k])
            ahead *= counted[t, :k]
            moves += forward[t - 1, :, :k] @ ahead.T
    flat = token.ravel()
    emitted = np.stack([np.bincount(flat, emit[:, s].ravel(), len(model.emit)) for s in range(states)], axis=1)
    weight = counted * (place < size)
    likelihood = float((np.log(scale) * weight).sum(dtype=np.float64) + (np.log(top[:, 0])[flat] * weight.ravel()).sum())
    return emit[0][:, opens].sum(axis=1, dtype=np.float64), moves * model.move, emitted, likelihood


def fitted(start: np.ndarray, moves: np.ndarray, emitted: np.ndarray, unigram: np.ndarray, discount: float) -> Hmm:
    """Normalised counts. ``discount`` of each expected emission goes to the unigram instead.

    Words with little evidence in a state thus keep the share that the unigram gives them, in small
    corpora nearly all words, and nothing has probability 0.
    """
    start, moves = start + 1.0, moves + 1.0
    kept = np.maximum(emitted - discount, 0.0)
    spare = emitted.sum(axis=0) - kept.sum(axis=0) + discount
    emit = kept + spare * unigram[:, None]
    return Hmm(start / start.sum(), moves / moves.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def seeded(unigram: np.ndarray, states: int) -> Hmm:
    """A first model: states differ by fixed noise on the unigram of all training texts and tend to stay."""
    noise = np.random.default_rng(7).uniform(0.5, 1.5, (len(unigram), states))
    emit = unigram[:, None] * noise
    move = np.full((states, states), 0.2 / states) + np.eye(states) * 0.8
    return Hmm(np.full(states, 1.0 / states), move, emit / emit.sum(axis=0))


def expected_counts(encoded: DataFrame, model: Hmm, tasks: int, core: int, warm_up: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts of starts, moves and (id, state) over all rows of ``encoded``, and their natural log likelihood.

    Counts are summed in each task, then across at most ``tasks`` tasks.
    """
    states, n_ids = len(model.start), len(model.emit)
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        start, moves, emitted, likelihood = np.zeros(states), np.zeros((states, states)), np.zeros((n_ids, states)), np.zeros(1)
        for batch in batches:
            for at in range(0, len(batch), _TEXTS):
                some = windows(batch.column(0).slice(at, _TEXTS).to_pylist(), core, warm_up)
                for block in range(0, len(some.first), _BLOCK):
                    for total, part in zip((start, moves, emitted, likelihood), forward_backward(some, known, block), strict=True):
                        total += part
        # Emissions under their id, moves under -1 - state, starts under -1 - states, then the likelihood.
        used = np.nonzero(emitted.any(axis=1))[0]
        number = np.concatenate([used, -1 - np.arange(states), [-1 - states, -2 - states]]).astype(np.int32)
        rows = np.concatenate([emitted[used], moves, start[None], np.repeat(likelihood, states)[None]])
        yield pa.RecordBatch.from_arrays([pa.array(number), *[pa.array(np.ascontiguousarray(rows[:, s])) for s in range(states)]], ["number", *names])

    names = [f"s{s}" for s in range(states)]
    counts = encoded.select("ids").coalesce(tasks).mapInArrow(run, "number int, " + ", ".join(f"{s} double" for s in names))
    table = counts.groupBy("number").agg(*[F.sum(s).alias(s) for s in names]).toArrow()
    shared.unpersist()
    number = table["number"].to_numpy()
    rows = np.stack([table[s].to_numpy() for s in names], axis=1) if len(number) else np.zeros((0, states))
    moves, emitted = np.zeros((states, states)), np.zeros((n_ids, states))
    emitted[number[number >= 0]] = rows[number >= 0]
    is_move = (number < 0) & (number > -1 - states)
    moves[-1 - number[is_move]] = rows[is_move]
    return rows[number == -1 - states].sum(axis=0), moves, emitted, float(rows[number == -2 - states, 0].sum())


def trained(encoded: DataFrame, unigram: np.ndarray, n_tokens: int, states: int, slices: int, passes: int, discount: float, core: int, warm_up: int) -> Hmm:
    """The model after ``passes`` over all slices of ``encoded``."""
    context = encoded.sparkSession.sparkContext
    tasks = max(context.defaultParallelism, -(-n_tokens // (slices * _TOKENS_A_TASK)))
    model, newest = seeded(unigram, states), {}
    for step in range(passes * slices):
        own = encoded.where(F.col("slice") == step % slices)
        newest[step % slices] = expected_counts(own, model, tasks, core, warm_up)[:3]
        model = fitted(*map(sum, zip(*newest.values(), strict=True)), unigram, discount)
    return model


def log_likelihoods(ids: list[bytes], model: Hmm) -> np.ndarray:
    """Log10 probability of each whole id sequence, by the scaled forward recursion over all of them at once."""
    sizes = np.fromiter((len(p) // 2 for p in ids), np.int64, len(ids))
    order = np.argsort(-sizes, kind="stable")
    flat = np.frombuffer(b"".join(ids), "<u2")
    first = (np.cumsum(sizes) - sizes)[order]
    live_at = len(sizes) - np.searchsorted(np.sort(sizes), np.arange(int(sizes.max(initial=0))), "right")
    total = np.zeros(len(ids))
    forward = None
    for t, live in enumerate(live_at.tolist()):
        at = (model.start if forward is None else forward[:live] @ model.move) * model.emit[flat[first[:live] + t]]
        scale = at.sum(axis=1)
        total[:live] += np.log10(scale)
        forward = at / scale[:, None]
    out = np.zeros(len(ids))
    out[order] = total
    return out


def score(
    df: DataFrame,
    learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    states: int = 8,
    frequent_words: int = 32_768,
    classes: int = 4096,
    slices: int = 4,
    passes: int = 4,
    discount: float = 0.7,
    core: int = 112,
    warm_up: int = 8,
) -> DataFrame:
    """``(id_col, n_tokens, n_known, train_tokens, base_score, score)``: one row for every input row.

    Tokens are the words of a text and one end. The model learns from rows where ``learn``
    holds; ``base_score`` is the smoothed unigram's log10 probability, ``score`` the hidden
    Markov model's. A null text is empty (an end only). Rows that share an id, or id and text,
    are texts of their own. An empty training set leaves the smoothing alone. ``frequent_words``
    and ``classes`` bound the model; counts and passes cover all training rows.
    """
    if not (frequent_words >= 1 and classes >= 1 and frequent_words + classes < 1 << 16):
        raise ValueError("ids have two bytes")
    stage = Stage(df.sparkSession, "hmm")
    source = df.select(F.col(id_col).alias("id"), F.coalesce(learn, F.lit(False)).alias("learn"), F.col(text_col).cast("string").alias("text"))
    source = source.withColumn("row", F.monotonically_increasing_id())
    counts = stage.table(count_words(source.where("learn"), "text"), "counts")
    ends = source.where("learn").count()
    totals = counts.agg(F.count(F.lit(1)), F.sum("c")).first()
    distinct, n = totals[0] + (ends > 0), (totals[1] or 0) + ends
    top = most_frequent(counts, frequent_words)
    c = np.zeros(1 + classes + len(top))
    c[_END] = ends
    c[1 + classes :] = [k for _, k in top]
    # Of each class the smoothed count: of its seen words that are not frequent, and of one unseen.
    ending = F.expr(f"substring(word, -{_ENDING}, {_ENDING})")
    of_class = counts.groupBy((1 + F.pmod(F.crc32(ending), F.lit(classes))).alias("class")).agg(F.sum("c"), F.count(F.lit(1)))
    mass = np.full(classes + 1, 0.1)
    for k, tokens, types in of_class.collect():
        mass[k] += tokens + 0.1 * types
    for w, k in top:
        mass[word_class(w, classes)] -= k + 0.1
    mass = np.maximum(mass, 0.1)  # differences of large numbers
    base_norm = n + 0.1 * (distinct + 1)
    unigram = c + 0.1
    unigram[1 : classes + 1] = mass[1:]
    unigram /= unigram.sum()
    # What an id adds by itself; the join adds the logarithm of the smoothed count for words of classes.
    base_logs, chain_logs = np.log10((c + 0.1) / base_norm), np.zeros(len(c))
    base_logs[1 : classes + 1], chain_logs[1 : classes + 1] = -np.log10(base_norm), -np.log10(mass[1:])

    encoded = stage.table(encode(source, [w for w, _ in top], classes, slices), "encoded", by="slice")
    model = trained(encoded, unigram, n, states, slices, passes if ends else 0, discount, core, warm_up)
    shared = df.sparkSession.sparkContext.broadcast((model, base_logs, chain_logs, ends > 0))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, base, chain, end_known = shared.value
        for batch in batches:
            ids = batch.column(2).to_pylist()
            if not ids:
                continue
            sizes = np.fromiter((len(p) // 2 for p in ids), np.int64, len(ids))
            flat = np.frombuffer(b"".join(ids), "<u2")
            cuts = np.cumsum(sizes) - sizes  # never empty: each text has an end
            sums = [np.add.reduceat(x[flat], cuts) for x in (base, chain)]
            seen = np.add.reduceat(((flat == _END) & end_known | (flat > classes)).astype(np.int32), cuts).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes), pa.array(seen), pa.array(sums[0]), pa.array(sums[1] + log_likelihoods(ids, known))],
                ["row", "id", "n_tokens", "seen", "base", "chain"],
            )

    kind = source.schema["id"].dataType.simpleString()
    whole = encoded.select("row", "id", "ids").mapInArrow(run, f"row bigint, id {kind}, n_tokens bigint, seen bigint, base double, chain double")
    # Words without an id, each once for a text, joined with the counts of all words.
    rare = encoded.select("row", F.explode("rare").alias("entry")).select("row", "entry.*")
    counted = rare.join(counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    of_rare = counted.groupBy(F.col("row").alias("rare_row")).agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("rare_seen"), F.sum(F.col("times") * F.log10(F.col("c") + 0.1)).alias("rare_logs")
    )
    joined = whole.join(of_rare, F.col("row") == F.col("rare_row"), "left")
    none = F.lit(0.0)
    return joined.select(
        F.col("id").alias(id_col),
        "n_tokens",
        (F.col("seen") + F.coalesce("rare_seen", F.lit(0))).alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_logs", none)).alias("base_score"),
        (F.col("chain") + F.coalesce("rare_logs", none)).alias("score"),
    )
