import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, pre_tokenizers

from heddle.llm import bpe
from heddle.llm.tables import ByteTrie, PairTable

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["a", " ", "  ", "\n", "\t", "é", "ß", "'s", "'ll", "1", "23", "!", "\x1c", "\x85", " ", "　", "日本", "😀", "<|endoftext|>", "the", " the", "\0", "=", "    ", "\r\n"]


@pytest.fixture(scope="module")
def own():
    with open(PATH, encoding="utf-8") as f:
        return bpe.SpeculativeBpe(f.read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def same(own, library, texts):
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    got = [np.frombuffer(x, "<u4").tolist() for x in own.encode_batch(texts)]
    assert got == want
    assert [own.decode(np.array(x, "<u4").tobytes()) for x in want] == [library.decode(x, skip_special_tokens=False) for x in want]


@given(st.lists(st.lists(st.sampled_from(ODD), max_size=20).map("".join), max_size=5))
@settings(max_examples=150, deadline=None)
def test_odd_texts(own, library, texts):
    same(own, library, texts)


@given(st.lists(st.text(max_size=40), max_size=5))
@settings(max_examples=150, deadline=None)
def test_any_text(own, library, texts):
    same(own, library, texts)


def test_random_words_and_long_runs(own, library):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(1, 30))) for _ in range(3000)]
    same(own, library, [" ".join(words[i : i + 50]) for i in range(0, 3000, 50)] + ["a" * 5000, "=" * 777, " " * 300, "x" * 41 + "é" * 100])


def test_one_merge_at_a_time_equals_many(own):
    for word in (b"hello", b"aaaaaaaaaa", "überzeugung".encode()):
        assert own.merge_exactly(word) == own.merge_together([word, b"zz"])[0].tolist()


def test_ill_formed_ids_decode_with_replacement(own, library):
    ids = [own.byte_ids[b] for b in "é".encode()][:1]
    assert own.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False) == "�"


def test_tables(documents, library):
    rows = [(1, "the cat"), (1, "the cat"), (2, None), (3, ""), (None, "x" * 100_000 + " end"), (5, "a <|endoftext|> b")]
    df = documents(rows, extra=True)
    found = sorted((r.doc_id or 0, r.n_tokens, bytes(r.ids_le), r.decoded) for r in bpe.round_trip(df, PATH).collect())
    want = sorted((i or 0, len(ids), np.array(ids, "<u4").tobytes(), t or "") for i, t in rows for ids in [library.encode(t or "", add_special_tokens=False).ids])
    assert found == want
    coded = bpe.encode(df, PATH)
    assert {r.text for r in bpe.decode(coded, PATH).collect()} == {t or "" for _, t in rows}
    assert bpe.round_trip(documents([]), PATH).count() == 0


def test_query_digests(spark, tmp_path, documents, library):
    from heddle.llm.queries import op1_bpe_round_trip

    documents([(7, "Héllo  wörld\n")]).write.parquet(str(tmp_path / "documents.parquet"))
    row = op1_bpe_round_trip(spark, str(tmp_path)).first()
    ids = library.encode("Héllo  wörld\n", add_special_tokens=False).ids
    assert (row.doc_id, row.n_tokens) == (7, len(ids))
    assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert row.decoded_sha256 == hashlib.sha256("Héllo  wörld\n".encode()).hexdigest()


def test_words_with_failing_proposals_need_no_merging(own, library, monkeypatch):
    rng = random.Random(2)
    parts = ["er", "on", "the", "an", "ti", "re", "sh", "ou", "ä", "en", "st", "nt"]
    texts = [" ".join("".join(rng.choices(parts, k=rng.randint(1, 6))) for _ in range(500)) for _ in range(4)]
    words = pa.array(sorted({" " + w for t in texts for w in t.split(" ")}), pa.large_binary())
    raw, bounds = np.frombuffer(words.buffers()[2], np.uint8), np.frombuffer(words.buffers()[1], np.int64)
    _, sizes = own.propose(raw, bounds[:-1], bounds[1:])
    assert sum(n != len(library.encode(w.decode()).ids) for n, w in zip(sizes, words.to_pylist(), strict=True)) > 50
    for name in ("merge_together", "merge_exactly"):
        monkeypatch.setattr(own, name, lambda words: pytest.fail("merged"))
    same(own, library, texts)


@pytest.mark.parametrize("steps", [0, 3])
def test_words_of_many_steps_are_merged(own, library, monkeypatch, steps):
    monkeypatch.setattr(bpe, "_STEPS", steps)
    same(own, library, ["eronouen thstinnt andhain tionanon", "überzeugungen" * 3, "a" * 200, "thstinnt" * 40])


@pytest.mark.parametrize("size", [1, 7, 60])
def test_long_texts_in_pieces(own, library, monkeypatch, size):
    monkeypatch.setattr(bpe, "_PIECE_BYTES", size)
    monkeypatch.setattr(bpe, "_SLICE_BYTES", 3 * size)
    rng = random.Random(size)
    texts = ["".join(rng.choices([*ODD, "don't", "'S", " - ", "x "], k=k)) for k in (0, 200, 0, 1, 50, 0)]
    same(own, library, [*texts, "a <|endoftext|> b<|endof", "text|> <|endoftext|>", "no cut" * 30])


def test_kinds_are_those_of_the_library(own):
    split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    new = [0x1C89, 0xA7CB, 0x105C0, 0x10D40, 0x11BF0, 0x16D70]  # letters and numbers of Unicode 16
    later = [0x558, 0x88F, 0xA7D2, 0x323B0, 0x3F3DA]  # of later versions, or of none
    for point in [*range(0x20, 0xD800, 97), *new, *later, *range(0x10000, 0x33500, 997)]:
        c = chr(point)
        kind = 1 if len(split(f"a{c}b")) == 1 else 2 if len(split(f"1{c}2")) == 1 else 0 if len(split(f"!{c}!")) == 1 else 3
        assert own.kinds[point] == kind, hex(point)


def test_unassigned_characters_end_words(own, library):
    same(own, library, ["\U0003f3da鬁Ʉ", "a՘b", "x\U000323b0日"])


def test_joined_lists_decode_apart(own, library):
    half = own.byte_ids[0xC3], own.byte_ids[0xA9]
    lists = [[], [half[0]], [half[1]], [*half], [50256], []]
    ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    found = own.decode_joined(np.array(sum(lists, []), np.uint32), ends)
    assert found.to_pylist() == [library.decode(x, skip_special_tokens=False) for x in lists]


def test_pairs_spread_over_the_table():
    pairs = {(a, b): (0, a) for a in range(4000) for b in range(97, 107)}
    table = PairTable(pairs, shift=40)
    keys = np.array([(a << 32) | b for a, b in pairs], np.int64)
    _, slot = table.find(keys >> 32, keys & 0xFFFFFFFF)
    assert (table.keys[slot] == keys).all()
    assert ((slot - table._slot(keys)) & table.mask).mean() < 1


def test_longest_match():
    trie = ByteTrie({bytes([b]): b for b in range(256)} | {b"ab": 300, b"abcd": 301})
    text = np.frombuffer(b"abcdabcab", np.uint8)
    assert trie.longest(text, np.array([0, 0, 1, 4, 7]), np.array([9, 3, 9, 9, 8])).tolist() == [301, 300, ord("b"), 300, ord("a")]


def test_results_are_sent_in_small_batches(monkeypatch):
    monkeypatch.setattr(bpe, "_PIECE_BYTES", 10)
    part = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array(["a" * 8, None, "b" * 30, "c"])], ["id", "text"])
    sent = list(bpe._sent(part, part))
    assert [len(x) for x in sent] == [2, 1, 1]
    assert pa.Table.from_batches(sent).equals(pa.Table.from_batches([part]))
