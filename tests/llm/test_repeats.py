import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from heddle.llm import repeats, sais


def brute_order(text):
    return sorted(range(len(text)), key=lambda i: text[i:])


@given(st.one_of(st.binary(max_size=60), st.text("ab", max_size=80).map(str.encode), st.text("abc", max_size=9).map(lambda s: s.encode() * 9)))
@settings(max_examples=400, deadline=None)
def test_suffix_array_and_lcp(raw):
    text = bytes(max(1, b) for b in raw) + b"\0"
    array = np.frombuffer(text, np.uint8)
    order = sais.suffix_array(array)
    assert order.tolist() == brute_order(text)
    before, common = sais.permuted_lcp(array, order)
    for x, y in zip(order[1:].tolist(), order[:-1].tolist(), strict=True):
        k = next(k for k in range(len(text)) if text[x + k : x + k + 1] != text[y + k : y + k + 1])
        assert (before[x], common[x]) == (y, k)


def brute(texts, length):
    counts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((len(t), int(gone.sum()), spans, np.frombuffer(t, np.uint8)[~gone].tobytes()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdé", k=rng.randint(1, 8)))
    passages = [" ".join(word() for _ in range(rng.randint(20, 80))) for _ in range(4)]
    phrase = "this very common phrase stands in many documents, in words of its own"
    texts = [None, "", "short", "a" * 700, "ab" * 300, passages[0], passages[0], "日本語" * 100]
    for _ in range(40):
        parts = [" ".join(word() for _ in range(rng.randint(5, 60))) for _ in range(3)]
        parts.insert(rng.randint(0, 3), rng.choice([*passages, phrase, phrase]))
        texts.append(" ".join(parts))
    return [*texts, texts[-1][:-20], texts[-1] + " tail", texts[-2]]


@pytest.mark.parametrize(("shard_bytes", "length"), [(1 << 20, 200), (1500, 200), (300, 60)])
def test_against_brute_force(documents, shard_bytes, length):
    """Small shards send the common phrase's key the way of keys that no shard can hold."""
    texts = corpus(length)
    df = documents([(i if i % 7 else None, t) for i, t in enumerate(texts)], extra=True)
    found = repeats.remove_repeats(df, length=length, shard_bytes=shard_bytes).collect()
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found)
    assert got == sorted(brute([(t or "").encode() for t in texts], length))


def test_long_documents_are_keyed_in_parts(monkeypatch):
    monkeypatch.setattr(repeats, "_PART", 500)
    text = ("".join(random.Random(3).choices("abcdefgh ", k=3000))).encode()
    key, first, last, gram = repeats.keyed_runs(text, 200)
    assert first[0] == 0 and last[-1] == len(text) - 199 and (first[1:] == last[:-1]).all()
    assert ((gram >= last - 1) & (gram + 32 <= first + 200)).all()


def test_empty_and_repeated_rows(documents):
    assert repeats.remove_repeats(documents([])).count() == 0
    same = repeats.remove_repeats(documents([(1, "x" * 50 + "y" * 200), (1, "x" * 50 + "y" * 200)])).collect()
    assert [(r.n_removed, r.n_spans) for r in same] == [(250, 1), (250, 1)]
