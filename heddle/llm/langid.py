"""Language identification by segmentation-marginalised unigram models.

Each language has a probability for each piece of a fixed public vocabulary. The
probability of a word is the sum over all its segmentations into pieces of the product
of their probabilities, found by a forward recursion over the word's characters; a text
is the product over its words. Piece probabilities are fitted by expectation
maximisation on counted words: the forward-backward recursion gives the expected number
of uses of each piece, aggregated over all labelled training texts.

Words are maximal runs of letters, lower-cased, with the vocabulary's word mark in
front, so whatever a document repeats is scored once. The vocabulary is lower-cased
too: pieces that differ in case only are one piece, and pieces that hold anything but
letters and a mark in front, which no word can use, are left out. Recursions run for many
words of one length together; pieces are found by walking a trie held in arrays. Words
whose probability may leave the range of doubles are summed as logarithms, at any length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm.shared import Stage
from heddle.llm.tables import PairTable

_WORD = regex.compile(r"\p{L}+")
_MARK = "▁"
_OTHER = 1e-7  # probability of a character that is no piece by itself
_LINEAR_CHARS = 28  # longer words are summed as logarithms
_CELLS = 400_000  # words by characters (by languages, when scoring) that are worked on together
_FAINT = 1e-100  # scaled probability of a word below which training takes logarithms
_COMMON = 63  # characters that each state of the trie has a column for
_TOGETHER = 1000  # texts whose new words are scored together
_FLUSH_WORDS = 300_000
_CACHE_WORDS = 250_000
_ROWS_A_TASK = 100_000  # counted words that a task of a training round takes
_MOST_TASKS = 4000  # of a training round, so that what a round shuffles stays bounded


def pieces_of(model_file: str) -> list[str]:
    """The vocabulary's ordinary pieces that a word can use, lower-cased, in order of id, each once."""
    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)))
    usable = regex.compile(_MARK + r"?\p{L}*")
    return list(dict.fromkeys(p for p in (model.id_to_piece(i).lower() for i in ids) if p and usable.fullmatch(p)))


class Lattice:
    """Finds the pieces that start at each character of many words.

    A state of the trie has a row with a column for each of the most common characters;
    steps by other characters are looked up by pair.
    """

    def __init__(self, pieces: list[str]):
        steps: dict[tuple[int, int], tuple[int, int]] = {}
        end: list[int] = [-1]
        uses: Counter[str] = Counter()
        for number, piece in enumerate(pieces):
            state = 0
            uses.update(piece)
            for c in piece:
                state = steps.setdefault((state, ord(c)), (0, len(steps) + 1))[1]
                if state == len(end):
                    end.append(-1)
            end[state] = number
        self.end, self.longest = np.array(end, np.int32), max(map(len, pieces))
        self.column = np.zeros(0x110000, np.int8)
        common = sorted(uses, key=lambda c: (-uses[c], c))[:_COMMON]
        self.column[[ord(c) for c in common]] = np.arange(1, len(common) + 1)
        inner = {s: k for k, s in enumerate(sorted({s for s, _ in steps}))}
        self.row = np.full(len(end), len(inner), np.int32)  # states without steps share an empty row
        self.row[list(inner)] = list(inner.values())
        self.next = np.full((len(inner) + 1, _COMMON + 1), -1, np.int32)
        for (state, code), (_, made) in steps.items():
            self.next[inner[state], self.column[code]] = made
        self.next[:, 0] = -1
        self.other = PairTable({k: v for k, v in steps.items() if not self.column[k[1]]} or {(0, 0): (0, 0)})

    def edges(self, codes: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, stop, words, piece of each): in order of start, then stop.

        Words are rows of character codes, filled up with 0, in descending order of their ``sizes``.
        A character that is no piece by itself has piece -1.
        """
        live_at = len(sizes) - np.searchsorted(sizes[::-1], np.arange(codes.shape[1]), "right")
        columns = np.ascontiguousarray(self.column[codes].T)
        for i in range(codes.shape[1]):
            rows, state = np.arange(live_at[i]), np.zeros(live_at[i], np.int32)
            for j in range(i, min(codes.shape[1], i + self.longest)):
                column = columns[j][rows]
                made = self.next[self.row[state], column]
                other = np.nonzero(column == 0)[0]
                other = other[codes[rows[other], j] > 0]
                if len(other):
                    rank, slot = self.other.find(state[other].astype(np.int64), codes[rows[other], j])
                    made[other] = np.where(rank == 0, self.other.made[slot], -1)
                on = np.nonzero(made >= 0)[0]
                if j == i:
                    piece = np.full(len(rows), -1, np.int32)
                    piece[on] = self.end[made[on]]
                    yield i, i + 1, rows, piece
                rows, state = rows[on], made[on]
                if not len(rows):
                    break
                if j > i:
                    piece = self.end[state]
                    whole = np.nonzero(piece >= 0)[0]
                    if len(whole):
                        yield i, j + 1, rows[whole], piece[whole]


def _matrices(words: list[str], cells: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in ``words``, character codes, sizes) of words with the mark in front; long words apart from others.

    ``cells`` bounds words by characters, unless one word is longer.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    order = np.argsort(-lengths, kind="stable")
    groups, at = [], 0
    while at < len(order):
        longest = int(lengths[order[at]])
        stop = at + max(1, cells // longest)
        if longest > _LINEAR_CHARS:  # short words never share a group with long ones
            stop = min(stop, int(np.searchsorted(-lengths[order], -_LINEAR_CHARS)))
        groups.append(order[at:stop])
        at = stop
    for places in groups:
        sizes = lengths[places]
        flat = np.frombuffer("".join([_MARK + words[k] for k in places.tolist()]).encode("utf-32-le"), np.uint32)
        codes = np.zeros((len(places), int(sizes[0])), np.int64)
        codes[np.arange(codes.shape[1]) < sizes[:, None]] = flat
        yield places, codes, sizes


def word_scores(words: list[str], lattice: Lattice, logp: np.ndarray) -> np.ndarray:
    """Natural log probability of each word (rows) in each language (columns); ``logp`` has a row for each piece."""
    out = np.zeros((len(words), logp.shape[1]))
    logs = np.concatenate([logp, np.full((1, logp.shape[1]), np.log(_OTHER))])  # the last row is piece -1
    numbers = np.exp(logs)
    for places, codes, sizes in _matrices(words, _CELLS // max(1, logp.shape[1])):
        n, m = codes.shape
        linear = m <= _LINEAR_CHARS
        forward = np.full((m + 1, n, logp.shape[1]), 0.0 if linear else -np.inf)
        forward[0] = 1.0 if linear else 0.0
        for i, j, rows, piece in lattice.edges(codes, sizes):
            if linear:
                forward[j, rows] += forward[i, rows] * numbers[piece]
            else:
                forward[j, rows] = np.logaddexp(forward[j, rows], forward[i, rows] + logs[piece])
        last = forward[sizes, np.arange(n)]
        out[places] = np.log(last) if linear else last
    return out


def expected_uses(words: list[str], language: np.ndarray, counts: np.ndarray, lattice: Lattice, logp: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in each language, for words that belong to one language each."""
    n_pieces, n_languages = logp.shape
    flat_p = np.concatenate([np.exp(logp).ravel(), np.full(n_languages, _OTHER)])  # the last ones are piece -1
    uses = np.zeros(len(flat_p))
    for places, codes, sizes in _matrices(words, _CELLS):
        n, m = codes.shape
        of, weight = language[places], counts[places]
        if m > _LINEAR_CHARS:
            uses += _log_uses(codes, sizes, of, weight, lattice, flat_p, n_pieces, n_languages)
            continue
        # Scaled by position, so that few products of small numbers vanish; those are summed as logarithms.
        scale = 1e3
        forward, backward = np.zeros((m + 1, n)), np.zeros((m + 1, n))
        forward[0] = 1.0
        backward[sizes, np.arange(n)] = 1.0
        edges = []
        for i, j, rows, piece in lattice.edges(codes, sizes):
            index = np.where(piece < 0, n_pieces, piece) * n_languages + of[rows]
            step = flat_p[index] * scale ** (j - i)
            forward[j, rows] += forward[i, rows] * step
            edges.append((i, j, rows, index, step))
        for i, j, rows, _, step in reversed(edges):
            backward[i, rows] += backward[j, rows] * step
        faint = np.nonzero(backward[0] < _FAINT)[0]
        share = np.where(backward[0] < _FAINT, 0.0, weight / np.maximum(backward[0], _FAINT))
        used = [forward[i, rows] * step * backward[j, rows] * share[rows] for i, j, rows, _, step in edges]
        uses += np.bincount(np.concatenate([e[3] for e in edges]), np.concatenate(used), len(uses))
        if len(faint):
            uses += _log_uses(codes[faint], sizes[faint], of[faint], weight[faint], lattice, flat_p, n_pieces, n_languages)
    if not np.isfinite(uses).all():
        raise FloatingPointError("expected uses are not finite")
    return uses[: n_pieces * n_languages].reshape(n_pieces, n_languages)


def _log_uses(codes, sizes, of, weight, lattice: Lattice, flat_p: np.ndarray, n_pieces: int, n_languages: int) -> np.ndarray:
    """Uses of pieces in words whose scaled probability may leave the range of doubles."""
    n, m = codes.shape
    logs = np.log(flat_p)
    forward, backward = np.full((m + 1, n), -np.inf), np.full((m + 1, n), -np.inf)
    forward[0] = 0.0
    backward[sizes, np.arange(n)] = 0.0
    uses, edges = np.zeros(len(flat_p)), []
    for i, j, rows, piece in lattice.edges(codes, sizes):
        index = np.where(piece < 0, n_pieces, piece) * n_languages + of[rows]
        forward[j, rows] = np.logaddexp(forward[j, rows], forward[i, rows] + logs[index])
        edges.append((i, j, rows, index))
    for i, j, rows, index in reversed(edges):
        backward[i, rows] = np.logaddexp(backward[i, rows], backward[j, rows] + logs[index])
    for i, j, rows, index in edges:
        uses += np.bincount(index, np.exp(forward[i, rows] + logs[index] + backward[j, rows] - backward[0, rows]) * weight[rows], len(uses))
    return uses


def letters(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def counted_words(labelled: DataFrame) -> DataFrame:
    """``(lang, word, n)`` over all rows of ``(lang, text)``; each task adds up before the shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter[str]] = {}

        def rows() -> pa.RecordBatch:
            flat = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in flat], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "word", "n"])

        for batch in batches:
            for start in range(0, len(batch), _TOGETHER):
                part = batch.slice(start, _TOGETHER)
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    counts.setdefault(lang, Counter()).update(letters(text))
                if sum(map(len, counts.values())) > _FLUSH_WORDS:
                    yield rows()
        yield rows()

    return labelled.mapInArrow(run, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


class LanguageModel:
    """Languages in order of name, log priors, pieces, and log probabilities (pieces by languages)."""

    def __init__(self, languages: list[str], log_prior: np.ndarray, pieces: list[str], logp: np.ndarray):
        self.languages, self.log_prior, self.pieces, self.logp = languages, log_prior, pieces, logp


def train(df: DataFrame, model_file: str, text_col: str = "text", lang_col: str = "lang", rounds: int = 3, smoothing: float = 0.05, max_languages: int = 64) -> LanguageModel:
    """Fit piece probabilities on every row with a text and a label.

    The driver holds one number for each piece and language: at most ``max_languages``
    columns, more are an error. Without labelled rows the model knows no language.
    """
    stage = Stage(df.sparkSession, "langid")
    labelled = df.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).dropna()
    seen = sorted(map(tuple, labelled.groupBy("lang").count().limit(max_languages + 1).collect()))
    if len(seen) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    pieces = pieces_of(model_file)
    languages = [lang for lang, _ in seen]
    documents = np.array([n for _, n in seen], float)
    logp = np.full((len(pieces), len(languages)), -np.log(len(pieces)))
    model = LanguageModel(languages, np.log(documents / documents.sum()) if len(seen) else documents, pieces, logp)
    if not languages:
        return model
    words = stage.table(counted_words(labelled), "words")
    number = F.create_map(*[x for k, lang in enumerate(languages) for x in (F.lit(lang), F.lit(k))])
    # Tasks by rows, as a row's bytes say little about its work.
    tasks = max(1, min(_MOST_TASKS, -(-words.count() // _ROWS_A_TASK)))
    numbered = stage.table(words.select(F.element_at(number, F.col("lang")).alias("language"), "word", "n").repartition(tasks, "language", "word"), "numbered")
    stage.drop(words)
    context = df.sparkSession.sparkContext
    lattice_of = context.broadcast(Lattice(pieces))
    for _ in range(rounds):
        shared = context.broadcast(model.logp)

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            logp = shared.value
            lattice, uses = lattice_of.value, np.zeros(logp.shape)
            for batch in batches:
                language, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
                uses += expected_uses(batch.column(1).to_pylist(), language.astype(np.int64), n.astype(float), lattice, logp)
            piece, language = np.nonzero(uses)
            yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(language.astype(np.int32)), pa.array(uses[piece, language])], ["piece", "language", "uses"])

        uses = numbered.mapInArrow(run, "piece int, language int, uses double").groupBy("piece", "language").agg(F.sum("uses").alias("uses")).toArrow()
        dense = np.zeros(logp.shape)
        dense[uses["piece"].to_numpy(), uses["language"].to_numpy()] = uses["uses"].to_numpy()
        dense += smoothing
        model.logp = np.log(dense / dense.sum(axis=0))
        shared.unpersist()
    lattice_of.unpersist()
    stage.drop(numbered)
    return model


class _Scorer:
    """Scores of words seen by this task."""

    def __init__(self, model: LanguageModel):
        self.model, self.lattice = model, Lattice(model.pieces)
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.table = np.zeros((0, len(self.model.languages)))

    def posteriors(self, texts: list[list[str]]) -> np.ndarray:
        if len(self.place) > _CACHE_WORDS:
            self._forget()
        fresh = list(set(chain.from_iterable(texts)) - self.place.keys())
        if fresh:
            base = len(self.place)
            self.place.update({w: base + k for k, w in enumerate(fresh)})
            self.table = np.concatenate([self.table, word_scores(fresh, self.lattice, self.model.logp)])
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        flat = np.fromiter(map(self.place.__getitem__, chain.from_iterable(texts)), np.int64, int(sizes.sum()))
        total = np.tile(self.model.log_prior, (len(texts), 1))
        some = np.nonzero(sizes)[0]
        if len(some):
            total[some] += np.add.reduceat(self.table[flat], (np.cumsum(sizes) - sizes)[some], axis=0)
        total = np.exp(total - total.max(axis=1, keepdims=True))
        return total / total.sum(axis=1, keepdims=True)


def _predictions(scorer: "_Scorer | None", languages: list[str], texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and posterior of each text; ``und`` with 0 where there is no letter or no model."""
    words = [letters(t) for t in texts]
    if scorer is None:
        return ["und"] * len(words), np.zeros(len(words))
    chances = scorer.posteriors(words)
    has = np.fromiter(map(bool, words), bool, len(words))
    best = [languages[k] if h else "und" for k, h in zip(chances.argmax(axis=1).tolist(), has.tolist(), strict=True)]
    return best, np.where(has, chances.max(axis=1), 0.0)


def keep_identified(df: DataFrame, model: LanguageModel, text_col: str = "text", least_score: float = 0.5) -> DataFrame:
    """The rows of ``df``, all columns, whose language is identified with at least ``least_score``; no shuffle.

    Rejected are null texts, texts without a letter, and texts that two languages share evenly.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    column = df.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        scorer = _Scorer(known) if known.languages else None
        for batch in batches:
            for start in range(0, len(batch), _TOGETHER):
                part = batch.slice(start, _TOGETHER)
                best, score = _predictions(scorer, known.languages, part.column(column).to_pylist())
                yield part.filter(pa.array([b != "und" and s >= least_score for b, s in zip(best, score.tolist(), strict=True)], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def predict(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, lang_pred, score)``: one row for every input row.

    ``score`` is the posterior of the predicted language under the training shares as
    prior. A text that is null or has no letter, or a model without languages, gives
    ``und`` with score 0; ties go to the first language by name. Rows are independent;
    other columns are not read.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        scorer = _Scorer(known) if known.languages else None
        for batch in batches:
            for start in range(0, len(batch), _TOGETHER):
                part = batch.slice(start, _TOGETHER)
                best, score = _predictions(scorer, known.languages, part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(best, pa.string()), pa.array(score, pa.float64())], [id_col, "lang_pred", "score"])

    source = df.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    return source.mapInArrow(run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, lang_pred string, score double")


def fold(id_column: Column, parts: int) -> Column:
    """CRC-32 of the id as text, modulo ``parts``; a null id reads as the empty text."""
    return F.pmod(F.crc32(F.coalesce(id_column.cast("string"), F.lit(""))), F.lit(parts))
