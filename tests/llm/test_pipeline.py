import hashlib
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline


def tables(documents, tmp_path):
    rng = random.Random(9)
    syllables = {"xx": ["ka", "to", "mi", "ren"], "yy": ["schl", "ung", "ver", "ein"]}
    rows = []
    for i in range(120):
        lang = "xx" if i % 2 else "yy"
        text = " ".join("".join(rng.choices(syllables[lang], k=rng.randint(1, 5))) for _ in range(rng.randint(20, 60)))
        rows.append((i, text, lang, f"s{i % 4}"))
    rows += [(200, rows[0][1] + " ", "yy", "s0"), (201, rows[0][1].replace(" ", "\n"), "yy", "s0"), (202, None, "xx", "s1"), (203, "12 34 !", None, "s2"), (204, "", None, None)]
    documents(rows).write.parquet(str(tmp_path / "documents.parquet"))
    return rows


def test_stages(spark, documents, tmp_path):
    rows = tables(documents, tmp_path)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    kept = {}
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, str(tmp_path))
        assert docs.columns == columns
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = sorted(r.doc_id for r in docs.collect())
    assert kept["language_id"] == [*range(120), 200, 201]
    assert kept["exact_dedup"] == [*range(120), 200]  # 201 equals 0 after white space, 200 ends in one
    assert kept["simhash_near_dedup"] == [*range(120)]
    assert set(kept["source_mix"]) <= set(range(120))

    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in out) == kept["source_mix"]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = {r[0]: r[1] for r in rows}
    for r in out[:20]:
        ids = np.array(library.encode(text[r.doc_id], add_special_tokens=False).ids, "<u4").tobytes()
        assert (bytes(r.ids_le), r.ids_sha256) == (ids, hashlib.sha256(ids).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_empty_table(spark, documents, tmp_path):
    documents([]).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
