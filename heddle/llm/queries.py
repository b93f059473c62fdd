"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm import bpe, exact, graph, hmm, langid, mixing, repeats, simhash, templates, warc
from heddle.llm.shared import Stage

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text for every document."""
    coded = bpe.round_trip(_table(spark, sf_dir, "documents"), BYTE_BPE)
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids_le", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op3_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes removed from every document, and the digest of what is left."""
    found = repeats.remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equality class, its smallest id and size for every document."""
    return exact.exact_dedup(_table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, CAST(count(*) OVER w AS BIGINT) AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


def op5_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, dropped lines and what remains of every document."""
    found = templates.drop_boilerplate(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents)),
t AS (
  SELECT doc_id, i, [CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END FOR x IN regexp_split_to_array(line, '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM l),
p AS (SELECT doc_id, i, concat_ws(' ', CAST(len(w) AS VARCHAR), array_to_string(w[1:3], ' ')) AS leaf, array_to_string(w, ' ') AS line FROM t WHERE len(w) > 0),
c AS (SELECT * FROM p WHERE leaf IN (SELECT leaf FROM p GROUP BY leaf HAVING count(DISTINCT doc_id) >= 5)),
e AS (SELECT leaf, line FROM p WHERE CAST(split_part(leaf, ' ', 1) AS BIGINT) >= 50 GROUP BY leaf, line HAVING count(DISTINCT doc_id) >= 2),
d AS (SELECT leaf, line, count(DISTINCT doc_id) AS docs FROM c GROUP BY leaf, line),
s AS (SELECT leaf, line, docs, unnest(range(1, len(x) + 1)) AS place, unnest(x) AS token FROM (SELECT *, string_split(line, ' ') AS x FROM d)),
k AS (SELECT leaf, place, token FROM s WHERE token <> '<*>' GROUP BY leaf, place, token HAVING sum(docs) >= 5),
m AS (
  SELECT s.leaf, s.line, string_agg(CASE WHEN k.token IS NULL THEN '<*>' ELSE s.token END, ' ' ORDER BY s.place) AS template
  FROM s LEFT JOIN k ON s.leaf = k.leaf AND s.place = k.place AND s.token = k.token
  GROUP BY s.leaf, s.line HAVING count(k.token) >= 0.5 * count(*)),
h AS (SELECT c.doc_id, c.i, c.leaf, m.template FROM c JOIN m ON c.leaf = m.leaf AND c.line = m.line),
x AS (SELECT doc_id, i FROM h WHERE (leaf, template) IN (SELECT (leaf, template) FROM h GROUP BY leaf, template HAVING count(DISTINCT doc_id) >= 5)
  UNION SELECT doc_id, i FROM p WHERE (leaf, line) IN (SELECT (leaf, line) FROM e)),
r AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) AS text, count(*) AS n FROM l ANTI JOIN x ON l.doc_id = x.doc_id AND l.i = x.i GROUP BY l.doc_id),
n AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines FROM l GROUP BY doc_id)
SELECT n.doc_id, n_lines, CAST(n_lines - coalesce(r.n, 0) AS BIGINT) AS n_dropped, sha256(coalesce(r.text, '')) AS kept_sha256
FROM n LEFT JOIN r ON n.doc_id = r.doc_id
"""


def op6_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and hidden Markov scores of every document, learnt from nine folds of ten."""
    held_out = langid.fold(F.col("doc_id"), 10) == 0
    found = hmm.score(_table(spark, sf_dir, "documents"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of links, component and decision for every vector."""
    return graph.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mix(_table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS turn,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT source, source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, 3 * source_size AS cap FROM s),
o AS (
  SELECT *, cap / weight AS ratio,
         row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS n,
         (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM r WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, CASE WHEN l IS NULL OR ratio < l THEN CAST(cap AS DOUBLE) ELSE l * weight END AS target
  FROM o, (SELECT arg_min(level, n) AS l FROM o WHERE level <= ratio)),
q AS (
  SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY turn, size ROWS UNBOUNDED PRECEDING) AS cum
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
i AS (
  SELECT q.*, p, CASE WHEN target > 0 THEN (source_size * p + cum) / target ELSE 0.0 END AS finish
  FROM q, (VALUES (0), (1), (2)) AS passes(p)),
c AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, turn, size, p ROWS UNBOUNDED PRECEDING) AS spent FROM i WHERE size > 0)
SELECT d.doc_id, d.size, t.source_size, t.target,
       CAST(coalesce((SELECT sum(c.size) FROM c WHERE c.doc_id = d.doc_id AND c.spent <= (SELECT sum(size) FROM d)), 0) AS BIGINT) AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
"""


def op9_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages, read the archive back and report what each record says."""
    root = Stage(spark, "warc").path("archive")
    warc.write_archive(_table(spark, sf_dir, "pages"), root)
    return warc.parse_records(warc.read_archive(spark, root)).select(
        F.col("record_id").alias("page_id"),
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        "refers_to",
    )


OP9_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first_id FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) % 32 + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM f
"""


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learnt from two folds of three."""
    documents = _table(spark, sf_dir, "documents")
    held_out = langid.fold(F.col("doc_id"), 3) == 1
    model = langid.train(documents.where(~held_out), PIECES)
    found = langid.predict(documents, model)
    return found.select("doc_id", (langid.fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe_round_trip": op1_bpe_round_trip,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_repeated_strings": op3_repeated_strings,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_line_templates": op5_line_templates,
    "op6_hmm_scores": op6_hmm_scores,
    "op7_embedding_near_dedup": op7_embedding_near_dedup,
    "op8_source_mix": op8_source_mix,
    "op9_warc_archive": op9_warc_archive,
    "op10_language_id": op10_language_id,
}

ORACLE_SQL: dict[str, str] = {
    "op4_exact_dedup": OP4_SQL,
    "op5_line_templates": OP5_SQL,
    "op8_source_mix": OP8_SQL,
    "op9_warc_archive": OP9_SQL,
}
