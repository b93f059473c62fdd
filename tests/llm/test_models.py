import itertools
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from heddle.llm import hmm, langid

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def brute_word(word, pieces, p):
    """Sum over all segmentations; a character that is no piece by itself may stand alone."""
    text, single = "▁" + word, set(pieces)
    total = [1.0] + [0.0] * len(text)
    for j in range(1, len(text) + 1):
        for i in range(j):
            part = text[i:j]
            if part in single:
                total[j] += total[i] * p[part]
            elif j == i + 1:
                total[j] += total[i] * 1e-7
    return math.log(total[-1])


def test_word_scores_sum_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "aba", "▁ab", "é"]
    rng = np.random.default_rng(0)
    p = rng.dirichlet(np.ones(len(pieces)), 2).T
    words = ["", "a", "ab", "abab", "xay", "é" * 3, "ab" * 40, "z" * 35]
    found = langid.word_scores(words, langid.Lattice(pieces), np.log(p))
    for k in range(2):
        assert found[:, k] == pytest.approx([brute_word(w, pieces, dict(zip(pieces, p[:, k], strict=True))) for w in words])


def test_expected_uses_are_posterior_counts():
    pieces = ["▁", "▁a", "a", "b", "ab"]
    p = np.array([[0.3], [0.2], [0.2], [0.1], [0.2]])
    uses = langid.expected_uses(["ab", "b"], np.array([0, 0]), np.array([2.0, 1.0]), langid.Lattice(pieces), np.log(p))[:, 0]
    ways = {("▁", "a", "b"): 0.3 * 0.2 * 0.1, ("▁", "ab"): 0.3 * 0.2, ("▁a", "b"): 0.2 * 0.1}
    want = Counter({"▁": 1.0, "b": 1.0})
    for way, q in ways.items():
        for piece in way:
            want[piece] += 2 * q / sum(ways.values())
    assert uses == pytest.approx([want[x] for x in pieces])


def test_expected_uses_of_a_long_run_of_faint_pieces():
    pieces = ["▁", "a", "b"]
    for faint, n in itertools.product((1e-7, 1e-10, 1e-14), (20, 64, 200)):
        p = np.array([[0.5], [0.5], [faint]])
        uses = langid.expected_uses(["b" * n, "a"], np.array([0, 0]), np.array([3.0, 1.0]), langid.Lattice(pieces), np.log(p))[:, 0]
        assert uses == pytest.approx([4.0, 1.0, 3.0 * n])


def test_language_id_against_brute_force(documents, monkeypatch):
    """The whole operator, counted and scored by a plain recursion over characters, with a word of 200 letters."""
    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "▁ab", "é", "bb"]
    monkeypatch.setattr(langid, "pieces_of", lambda file: pieces)
    rng = random.Random(6)
    rows = [(i, " ".join("".join(rng.choices("abé" if i % 2 else "bbaz", k=rng.randint(1, 9))) for _ in range(5)), "xx" if i % 2 else "yy") for i in range(30)]
    rows += [(50, "ab" * 100 + " Bé", "xx"), (51, "b" * 200, "yy"), (52, "abab, bb", None)]
    model = langid.train(documents(rows), "unused", rounds=2)
    p = {lang: dict.fromkeys(pieces, 1 / len(pieces)) for lang in ("xx", "yy")}

    def ways(word, q):
        text = "▁" + word
        forward = [1.0] + [0.0] * len(text)
        edges = [(i, j, text[i:j] if text[i:j] in q else None) for j in range(1, len(text) + 1) for i in range(j) if text[i:j] in q or j == i + 1]
        value = lambda x: q[x] if x else 1e-7
        for i, j, x in edges:
            forward[j] += forward[i] * value(x)
        backward = [0.0] * len(text) + [1.0]
        for i, j, x in sorted(edges, key=lambda e: -e[1]):
            backward[i] += backward[j] * value(x)
        return forward[-1], [(x, forward[i] * value(x) * backward[j] / forward[-1]) for i, j, x in edges if x]

    for _ in range(2):
        for lang, q in p.items():
            uses = dict.fromkeys(pieces, 0.05)
            for _, text, own in rows:
                for word in langid.letters(text) if own == lang else ():
                    for x, share in ways(word, q)[1]:
                        uses[x] += share
            p[lang] = {x: u / sum(uses.values()) for x, u in uses.items()}
    for k, lang in enumerate(model.languages):
        assert np.exp(model.logp[:, k]) == pytest.approx([p[lang][x] for x in pieces], rel=1e-6)
    prior = {"xx": 16 / 32, "yy": 16 / 32}
    for r in langid.predict(documents(rows), model).collect():
        logs = {lang: math.log(prior[lang]) + sum(math.log(ways(w, p[lang])[0]) for w in langid.letters(dict((x[0], x[1]) for x in rows)[r.doc_id])) for lang in p}
        best = max(logs, key=logs.get)
        assert r.lang_pred == best and r.score == pytest.approx(1 / sum(math.exp(v - logs[best]) for v in logs.values()))


def test_pieces_that_words_can_use():
    pieces = langid.pieces_of(PIECES)
    assert len(set(pieces)) == len(pieces) > 20_000
    assert all(p == p.lower() and p.removeprefix("▁").isalpha() for p in pieces if p != "▁")


@pytest.fixture
def languages(documents):
    rng = random.Random(1)
    syllables = {"xx": ["ka", "to", "mi", "ren"], "yy": ["schl", "ung", "ver", "ein"], "zz": ["eau", "ille", "ois", "que"]}
    rows = []
    for i in range(300):
        lang = rng.choice(list(syllables))
        words = ["".join(rng.choices(syllables[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(3, 30))]
        rows.append((i, " ".join(words), lang if i % 5 else None))
    truth = {i: ["xx", "yy", "zz"][max(range(3), key=lambda k: sum(t.count(s) for s in syllables[["xx", "yy", "zz"][k]]))] for i, t, _ in rows}
    odd = [(1000, None, "xx"), (1001, "", "yy"), (1002, "123 !?", "zz"), (1003, "Ⅷ", None), (1004, "KATO " * 20_000, None), (None, "mi", None), (7, "ver", "yy")]
    return documents([*rows, *odd], extra=True), truth


def test_language_id(languages):
    df, truth = languages
    model = langid.train(df, PIECES)
    assert model.languages == ["xx", "yy", "zz"] and np.exp(model.logp).sum(axis=0) == pytest.approx([1, 1, 1])
    found = langid.predict(df, model).collect()
    by_id = {r.doc_id: r for r in found}
    assert len(found) == 307 and all(0 <= r.score <= 1 for r in found)
    assert np.mean([by_id[i].lang_pred == t for i, t in truth.items() if i != 7]) > 0.99
    assert [by_id[i].lang_pred for i in (1000, 1001, 1002, 1003, 1004)] == ["und"] * 4 + ["xx"]
    kept = langid.keep_identified(df, model)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} >= {i for i, t in truth.items() if i != 7}
    assert not {r.doc_id for r in kept.select("doc_id").collect()} & {1000, 1001, 1002, 1003}


def test_language_id_without_labels(documents):
    df = documents([(1, "some text"), (2, None)])
    model = langid.train(df, PIECES)
    assert sorted((r.doc_id, r.lang_pred, r.score) for r in langid.predict(df, model).collect()) == [(1, "und", 0.0), (2, "und", 0.0)]
    assert langid.keep_identified(df, model).count() == 0
    assert langid.predict(documents([]), model).count() == 0


def test_too_many_languages(documents):
    with pytest.raises(ValueError, match="more than 2"):
        langid.train(documents([(i, "a", f"l{i}") for i in range(3)]), PIECES, max_languages=2)


def brute_likelihood(ids, model):
    states = range(len(model.start))
    total = 0.0
    for path in itertools.product(states, repeat=len(ids)):
        p = model.start[path[0]] * model.emit[ids[0], path[0]]
        for a, b, i in zip(path, path[1:], ids[1:], strict=False):
            p *= model.move[a, b] * model.emit[i, b]
        total += p
    return math.log10(total)


@pytest.fixture
def small_model():
    rng = np.random.default_rng(3)
    return hmm.Hmm(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(5), 3).T)


def test_forward_sums_all_paths(small_model):
    texts = [[0], [1, 2, 0], [4, 4, 3, 1, 2, 0], [2, 0]]
    found = hmm.log_likelihoods([np.array(t, "<u2").tobytes() for t in texts], small_model)
    assert found == pytest.approx([brute_likelihood(t, small_model) for t in texts])


def packed(texts):
    return [np.array(t, "<u2").tobytes() for t in texts]


def test_expected_counts_and_training(small_model):
    texts = [[1, 2, 0], [3, 4, 2, 0], [0]]
    ids = packed(texts)
    start, moves, emitted, likelihood = hmm.forward_backward(hmm.windows(ids, 8, 2), small_model)
    assert start.sum() == pytest.approx(3) and moves.sum() == pytest.approx(5) and emitted.sum() == pytest.approx(8)
    assert emitted.sum(axis=1) == pytest.approx(np.bincount(sum(texts, []), minlength=5))
    assert likelihood / math.log(10) == pytest.approx(sum(brute_likelihood(t, small_model) for t in texts), rel=1e-5)
    model, last = small_model, -np.inf
    for _ in range(5):  # without a discount, Baum-Welch never makes the data less likely
        s, m, e, _ = hmm.forward_backward(hmm.windows(ids, 8, 2), model)
        model = hmm.Hmm(s / s.sum(), m / m.sum(axis=1, keepdims=True), e / e.sum(axis=0))
        now = hmm.log_likelihoods(ids, model).sum()
        assert now >= last - 1e-4
        last = now


def brute_counts(texts, model):
    """Posterior counts of starts, moves and (id, state), over all paths of states."""
    states = range(len(model.start))
    start, moves, emitted = np.zeros(len(states)), np.zeros((len(states),) * 2), np.zeros(model.emit.shape)
    for ids in texts:
        chances = {}
        for path in itertools.product(states, repeat=len(ids)):
            p = model.start[path[0]] * model.emit[ids[0], path[0]]
            for a, b, i in zip(path, path[1:], ids[1:], strict=False):
                p *= model.move[a, b] * model.emit[i, b]
            chances[path] = p
        total = sum(chances.values())
        for path, p in chances.items():
            start[path[0]] += p / total
            for a, b in itertools.pairwise(path):
                moves[a, b] += p / total
            for i, s in zip(ids, path, strict=True):
                emitted[i, s] += p / total
    return start, moves, emitted


def test_counts_against_all_paths(small_model):
    texts = [[1, 2, 0], [3, 4, 2, 1, 0], [0], [2, 0]]
    found = hmm.forward_backward(hmm.windows(packed(texts), 8, 2), small_model)[:3]
    for got, want in zip(found, brute_counts(texts, small_model), strict=True):
        assert got == pytest.approx(want, abs=1e-5)


def test_windows_count_every_token_and_move_once(small_model):
    rng = np.random.default_rng(1)
    texts = [[*rng.integers(1, 5, n).tolist(), 0] for n in (0, 3, 7, 8, 40, 200)]
    some = hmm.windows(packed(texts), 8, 4)
    assert (some.core_to - some.core_from).sum() == sum(map(len, texts)) and some.opens.sum() == len(texts)
    whole = hmm.forward_backward(hmm.windows(packed(texts), 1000, 0), small_model)
    cut = [sum(x) for x in zip(*(hmm.forward_backward(some, small_model, at, 16) for at in range(0, len(some.first), 16)), strict=True)]
    assert cut[0].sum() == pytest.approx(len(texts)) and cut[1].sum() == pytest.approx(sum(len(t) - 1 for t in texts))
    assert cut[2].sum(axis=1) == pytest.approx(np.bincount(sum(texts, []), minlength=5))
    assert cut[3] == pytest.approx(whole[3], rel=2e-2)


def test_scores(documents):
    rng = random.Random(2)
    groups = [["red", "blue", "green"], ["uno", "dos", "tres"]]
    rows = [(i, " ".join(rng.choices(groups[i % 2], k=rng.randint(1, 60)) + ([f"rare{i}"] if i % 3 else []))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (1002, "never seen words"), (1003, "Red BLUE\tred"), (1004, "red blue " * 20_000)]
    learn = lambda i: i % 10 != 0 and i < 1002
    df = documents(rows, extra=True)
    options = dict(states=3, frequent_words=5, classes=50, core=16)
    found = {r.doc_id: r for r in hmm.score(df, (F.col("doc_id") % 10 != 0) & (F.col("doc_id") < 1002), **options).collect()}
    token_rows = {i: [*(t or "").lower().split(), None] for i, t in rows}
    c = Counter(w for i, t in token_rows.items() if learn(i) for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in token_rows.items():
        r = found[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t))
    held = [i for i in token_rows if i % 10 == 0 and i < 400]
    assert sum(found[i].score for i in held) > sum(found[i].base_score for i in held)


def test_states_of_a_small_late_group_are_learnt(documents):
    # Far into every text, words come in two kinds that never mix, which openings do not show.
    rng = random.Random(5)
    kinds = [["red", "blue", "green"], ["uno", "dos", "tres"]]
    rows = [(i, " ".join(rng.choices(sum(kinds, []), k=1100) + rng.choices(kinds[i % 2], k=3000))) for i in range(60)]
    rows += [(1000 + i, " ".join(rng.choices(kinds[i % 2], k=50))) for i in range(20)]
    found = {r.doc_id: r for r in hmm.score(documents(rows), F.col("doc_id") < 1000, states=3, core=16).collect()}
    held = [found[1000 + i] for i in range(20)]
    gain = sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held)
    assert gain > 0.2  # of log10(2) = 0.3


def test_scores_against_brute_force(documents):
    """The whole operator on short texts: counts over all paths, then the sum over all paths."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(["red", "blue", "uno", "dos", f"x{i}", f"y{i % 3}"], k=rng.randint(0, 4)))) for i in range(30)]
    frequent_words, classes, states = 3, 4, 2
    options = dict(states=states, frequent_words=frequent_words, classes=classes, slices=1, passes=3)
    found = {r.doc_id: r for r in hmm.score(documents(rows), F.col("doc_id") < 24, **options).collect()}
    c = Counter(w for i, t in rows if i < 24 for w in t.encode().split())
    top = [w for w, _ in hmm.most_frequent(documents([]).sparkSession.createDataFrame([(w, k) for w, k in c.items()], "word binary, c bigint"), frequent_words)]
    assert sorted(c[w] for w in top) == sorted(c.values())[-frequent_words:]
    number = {w: classes + 1 + k for k, w in enumerate(top)}
    mass = [0.1 * (1 + sum(w not in number and hmm.word_class(w, classes) == k for w in c)) + sum(n for w, n in c.items() if w not in number and hmm.word_class(w, classes) == k) for k in range(classes + 1)]
    unigram = np.array([24.1, *mass[1:], *(c[w] + 0.1 for w in top)])
    unigram /= unigram.sum()
    texts = {i: [*(number.get(w, hmm.word_class(w, classes)) for w in t.encode().split()), 0] for i, t in rows}
    model = hmm.seeded(unigram, states)
    for _ in range(3):
        model = hmm.fitted(*brute_counts([t for i, t in texts.items() if i < 24], model), unigram, 0.7)
    for i, t in rows:
        share = sum(math.log10((c[w] + 0.1) / mass[hmm.word_class(w, classes)]) for w in t.encode().split() if w not in number)
        assert found[i].score == pytest.approx(brute_likelihood(texts[i], model) + share, rel=1e-4)


def test_rows_that_share_an_id_are_scored_apart(documents):
    rows = [(1, "red blue"), (1, "red rare words here"), (1, "red rare words here"), (2, "blue red red"), (None, "rare"), (None, "blue")]
    found = hmm.score(documents(rows), F.lit(True), states=2, frequent_words=2).collect()
    assert sorted((r.n_tokens, r.n_known) for r in found) == sorted([(3, 3), (5, 5), (5, 5), (4, 4), (2, 2), (2, 2)])
    alone = {t: s for t, s in zip([r.n_tokens for r in found], [r.base_score for r in found], strict=True)}
    assert len({round(r.base_score, 9) for r in found if r.n_tokens == 5}) == 1 and alone[5] < alone[3]


def test_most_frequent_takes_ties_exactly(spark):
    rows = [(f"w{i}".encode(), 1 + (i < 7) + 5 * (i < 3)) for i in range(2000)]
    counts = spark.createDataFrame(rows, "word binary, c bigint").repartition(5)
    of = dict(rows)
    for most in (1, 3, 5, 7, 100, 1999, 2000, 5000):
        got = hmm.most_frequent(counts, most)
        assert len(got) == min(most, 2000) and sorted((c for _, c in got), reverse=True) == sorted(of.values(), reverse=True)[:most]
        assert all(of[w] == c for w, c in got) and got == hmm.most_frequent(counts, 5000)[:most]


def test_scores_without_training_rows(documents):
    rows = hmm.score(documents([(1, "a b"), (2, None)]), F.lit(False), states=2).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in rows) == [(1, 3, 0, 0), (2, 1, 0, 0)]
    assert all(r.base_score == pytest.approx(0) and r.score <= 1e-9 for r in rows)
    assert hmm.score(documents([]), F.lit(True), states=2).count() == 0
