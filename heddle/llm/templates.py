"""Line deduplication with a log-template tree, in DataFrame operations only.

Lines go down a tree of fixed depth: first by their number of tokens, then by their
leading tokens, where a token that holds a digit counts as variable. In a leaf, a token
stays constant at a place if enough documents have it there; all others become
variable. What results is the line's template. A template that occurs in enough
documents and is constant in at least half of its tokens is boilerplate, and its lines
are dropped from all documents.

A line of very many tokens needs no template to stand out: if two documents have it
word for word, it is boilerplate as it is.

Unlike a parser that reads a log line by line, nothing depends on the order of lines:
support is counted over the whole leaf. Only lines of leaves that enough documents
reach are looked at token by token, and equal lines are counted before that, so a line
that a third of all documents share is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm.shared import Stage

VARIABLE = "<*>"
_TRIVIAL = r"[\x20\x09\x0B-\x0D]{2,}|[\x09\x0B-\x0D]"
_WITH_DIGIT = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"


def masked_lines(text: Column) -> Column:
    """The lines of a text, tokens set apart by one space; tokens with an ASCII digit are variable.

    White space and digits are dealt with in the whole text, before it is cut into lines; most
    texts only need the look whether there is anything to replace.
    """
    spaced = F.when(text.contains("  ") | text.rlike(r"[\x09\x0B-\x0D]"), F.regexp_replace(text, _TRIVIAL, " ")).otherwise(text)
    return F.split(F.when(text.rlike("[0-9]"), F.regexp_replace(spaced, _WITH_DIGIT, VARIABLE)).otherwise(spaced), "\n")


def _size(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "))) + 1


def _leaf(depth: int) -> Column:
    """Number of tokens, and leading tokens."""
    return F.concat_ws(" ", _size(F.col("line")), F.substring_index("line", " ", depth))


def drop_boilerplate(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    depth: int = 3,
    min_docs: int = 5,
    min_constant: float = 0.5,
    long_tokens: int = 50,
    long_docs: int = 2,
) -> DataFrame:
    """``(id_col, n_lines, n_dropped, text)``: one row for every input row, with its remaining lines.

    Lines end at line feeds. Lines without tokens always stay. Support of a token at a
    place of a leaf is the number of (different line, document) pairs that have it. Lines of
    ``long_tokens`` tokens or more also go if ``long_docs`` documents have them with equal tokens.
    A null text counts as empty: one line, nothing dropped. Rows that share id and text
    are one document; an empty table gives no rows; other columns are not read.
    """
    stage = Stage(df.sparkSession, "templates")
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    key = F.unhex(F.md5(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit("\n"), F.col("text"))))
    rows = rows.withColumn("key", key)
    # First without the lines themselves: a hash of each line's leaf tells which lines can matter.
    lines = rows.select("key", F.posexplode(masked_lines(F.col("text"))).alias("at", "line")).withColumn("line", F.trim("line"))
    hashed = lines.where("line != ''").select("key", "at", F.xxhash64(_leaf(depth)).alias("leaf_hash"), (_size(F.col("line")) >= long_tokens).alias("long"))
    hashed = stage.table(hashed, "hashed")
    reached = hashed.select("leaf_hash", "long", "key").distinct().groupBy("leaf_hash", "long").agg(F.count(F.lit(1)).alias("docs"))
    reached = reached.where(F.col("docs") >= F.when(F.col("long"), min(min_docs, long_docs)).otherwise(min_docs))
    reached = reached.select("leaf_hash", "long", (F.col("docs") >= min_docs).alias("common"))
    wanted = hashed.join(reached, ["leaf_hash", "long"]).groupBy("key").agg(F.collect_set(F.struct("at", "common")).alias("places"))
    held = rows.join(wanted, "key").select("key", "places", masked_lines(F.col("text")).alias("lines"))
    picked = F.transform("places", lambda p: F.struct(p["at"].alias("at"), p["common"].alias("common"), F.trim(F.get("lines", p["at"])).alias("line")))
    held = held.select("key", F.size("lines").alias("n_lines"), F.explode(picked).alias("found")).select("key", "n_lines", "found.*")
    candidates = stage.table(held.select("key", "n_lines", "at", "common", _leaf(depth).alias("leaf"), "line"), "candidates")

    number = F.unhex(F.md5(F.concat("leaf", F.lit("\n"), "line")))
    different = candidates.groupBy("leaf", "common", "line").agg(F.countDistinct("key").alias("docs"))
    different = stage.table(different.withColumn("number", number), "different")
    spread = different.where("common").select("leaf", "number", "docs", F.posexplode(F.split("line", " ")).alias("place", "token"))
    support = spread.where(F.col("token") != VARIABLE).groupBy("leaf", "place", "token").agg(F.sum("docs").alias("support"))
    constant = support.where(F.col("support") >= min_docs).select("leaf", "place", "token", F.lit(True).alias("constant"))
    judged = spread.join(constant, ["leaf", "place", "token"], "left")
    templates = judged.groupBy("leaf", "number").agg(
        F.array_sort(F.collect_list(F.struct("place", F.when(F.col("constant"), F.col("token")).otherwise(VARIABLE).alias("token")))).alias("parts"),
        F.count("constant").alias("constants"),
        F.count(F.lit(1)).alias("n"),
    )
    templates = templates.where(F.col("constants") >= min_constant * F.col("n")).select(
        "number", F.unhex(F.md5(F.concat("leaf", F.lit("\n"), F.concat_ws(" ", "parts.token")))).alias("template")
    )
    numbered = candidates.select("key", "n_lines", "at", number.alias("number"))
    matched = stage.table(numbered.join(templates, "number").select("key", "n_lines", "at", "template"), "matched")
    recurring = matched.select("template", "key").distinct().groupBy("template").count().where(F.col("count") >= min_docs).select("template")
    by_template = matched.join(recurring, "template", "left_semi").select("key", "n_lines", "at")
    repeated = different.where((F.col("docs") >= long_docs) & (_size(F.col("line")) >= long_tokens)).select("number")
    as_they_are = numbered.join(repeated, "number", "left_semi").select("key", "n_lines", "at")
    dropped = stage.table(by_template.unionAll(as_they_are).distinct(), "dropped")

    # For documents that lose a line, a flag for each line, so that one join with the texts is enough.
    places = dropped.select("key", "n_lines").distinct().select("key", F.explode(F.sequence(F.lit(0), F.col("n_lines") - 1)).alias("at"))
    flagged = places.join(dropped.select("key", "at", F.lit(True).alias("gone")), ["key", "at"], "left")
    flags = flagged.groupBy("key").agg(
        F.count("gone").alias("n_dropped"),
        F.transform(F.array_sort(F.collect_list(F.struct("at", F.col("gone").isNull().alias("stays")))), lambda x: x["stays"]).alias("stay"),
    )
    left_over = F.array_join(F.filter(F.split("text", "\n"), lambda line, at: F.get("stay", at)), "\n")
    return rows.join(flags, "key", "left").select(
        F.col("id").alias(id_col),
        F.size(F.split("text", "\n")).cast("bigint").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("bigint").alias("n_dropped"),
        F.when(F.col("n_dropped").isNull(), F.col("text")).otherwise(left_over).alias("text"),
    )
