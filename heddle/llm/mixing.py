"""Mixing sources to target weights by weighted fair queueing.

Documents of a source queue in a shuffled order (the MD5 digest of the id). A document's
virtual finish time is the cumulative size of its source up to and including it,
divided by the source's target; further passes over a source continue the sum. All
documents merge in the order of finish time until the total budget is reached.

Running sums never put a source into one task: a source is dealt into buckets by the
leading digits of the digest, sums of buckets are accumulated (a bounded table for each
source), and only rows within one bucket are summed in order. The global cut is found
the same way: a histogram of finish times names the bucket in which the budget ends,
and only that bucket is ordered.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heddle.llm.shared import Stage, shuffle_width

_BUCKET_DIGITS = 3
_TICKS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(stage: Stage, sizes: DataFrame, weights: tuple[int, ...], share: float, max_repeats: int) -> DataFrame:
    """``(source, source_size, target)``: weights dealt to sources in code point order, null last.

    ``share`` of all sizes is split by weight; a target stops at ``max_repeats`` times its
    source's size and the excess is shared again by weight. That fixed point is
    ``min(cap, level * weight)`` with one level: what is left of the budget over the weight left, again and
    again until no further source is full. Sources are numbered within ranges, and the driver holds
    one number for each range, so any number of them will do.
    """
    width = shuffle_width(sizes.sparkSession)
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranged = by_source.repartitionByRange(width, F.asc_nulls_last("source")).withColumn("part", F.spark_partition_id())
    ranged = stage.table(ranged, "sources")
    counts = dict(map(tuple, ranged.groupBy("part").count().collect()))
    before = F.array(*[F.lit(n) for n in accumulate((counts.get(k, 0) for k in range(width)), initial=0)])
    number = F.element_at(before, F.col("part") + 1) + F.row_number().over(W.partitionBy("part").orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(number, F.lit(len(weights))).cast("int") + 1)
    ranked = ranged.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * max_repeats).alias("cap"))
    ranked = stage.table(ranked.withColumn("ratio", F.col("cap") / F.col("weight")), "ranked")
    total = (ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    level, full = 0.0, -1
    while True:
        is_full = F.col("ratio") < level
        now, spent, open_ = ranked.agg(F.count_if(is_full), F.sum(F.when(is_full, F.col("cap"))), F.sum(F.when(~is_full, F.col("weight")))).first()
        if now == full:
            break
        full, level = now, (total - (spent or 0)) / open_ if open_ else float("inf")
    target = F.when(F.col("ratio") < level, F.col("cap").cast("double")).otherwise(F.lit(level) * F.col("weight"))
    return ranked.select("source", "source_size", target.alias("target"))


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.0,
    max_repeats: int = 3,
) -> DataFrame:
    """``(id_col, size, source_size, target, taken)``: one row for every input row.

    Size is the number of words (null text: 0); null is a source of its own. ``taken`` is
    size times the passes in which the mix takes the document. Documents without words
    take nothing. Rows that share an id queue next to each other; a null id queues as the
    empty string. The order depends on ids, and on texts where ids are shared, so reruns agree.
    """
    found = _queued(df, id_col, text_col, source_col, weights, share, max_repeats)
    return found.select(F.col("id").alias(id_col), "size", "source_size", "target", "taken")


def _queued(df: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], share: float, max_repeats: int) -> DataFrame:
    """``(id, mark, source, size, source_size, target, taken)``, where ``mark`` is a hash of the text."""
    stage = Stage(df.sparkSession, "mix")
    text = F.col(text_col).cast("string")
    sizes = df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("mark"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"))
    sizes = stage.table(sizes.withColumn("turn", F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")))), "sizes")
    bucket = F.substring("turn", 1, _BUCKET_DIGITS)
    sums = sizes.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("sum"))
    base = F.sum("sum").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    bases = sums.select(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"), F.coalesce(base, F.lit(0)).alias("base"))
    within = F.sum("size").over(W.partitionBy("source", "bucket").orderBy("turn", "size", "mark").rowsBetween(W.unboundedPreceding, 0))
    queued = sizes.withColumn("bucket", bucket).withColumn("within", within)
    queued = queued.join(bases, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")))
    aims = targets(stage, sizes, weights, share, max_repeats).withColumnRenamed("source", "t_source")
    queued = queued.join(aims, F.col("source").eqNullSafe(F.col("t_source"))).select(
        "id", "mark", "source", "size", "turn", "source_size", "target", (F.col("base") + F.col("within")).alias("cum")
    )
    queued = stage.table(queued, "queued")

    def finish(p: Column | int) -> Column:
        return F.when(F.col("target") > 0, (F.col("source_size") * p + F.col("cum")) / F.col("target")).otherwise(F.lit(0.0))

    items = (
        queued.where("size > 0")
        .withColumn("pass", F.explode(F.array(*map(F.lit, range(max_repeats)))))
        .withColumn("finish", finish(F.col("pass")))
        .withColumn("tick", F.least(F.floor(F.col("finish") * _TICKS), F.lit(2 * _TICKS)))
    )
    budget = (sizes.agg(F.sum("size")).first()[0] or 0) * share
    # A histogram of 2 * _TICKS + 1 rows at most, whatever the input.
    histogram = sorted(map(tuple, items.groupBy("tick").agg(F.sum("size")).collect()))
    spent, edge = 0, None
    for tick, size in histogram:
        if spent + size > budget:
            edge = tick
            break
        spent += size
    order = ("finish", F.asc_nulls_last("source"), "turn", "size", "pass")
    last = None
    if edge is not None:
        running = F.sum("size").over(W.partitionBy("tick").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
        inside = items.where(F.col("tick") == edge).withColumn("spent", F.lit(spent) + running).where(F.col("spent") <= budget)
        last = inside.orderBy(F.desc("spent")).select("finish", "source", "turn", "size", "pass").first()

    def taken_in(p: int) -> Column:
        tick = F.least(F.floor(finish(p) * _TICKS), F.lit(2 * _TICKS))
        if edge is None:
            return F.lit(1)
        if last is None:
            return (tick < edge).cast("int")
        f, s = finish(p), F.col("source")
        later_source = F.lit(False) if last["source"] is None else (s.isNull() | (s > last["source"]))
        same_source = s.eqNullSafe(F.lit(last["source"]).cast("string"))
        after = (f > last["finish"]) | (
            (f == last["finish"])
            & (later_source | (same_source & (F.struct("turn", "size", F.lit(p)) > F.struct(F.lit(last["turn"]), F.lit(last["size"]).cast("bigint"), F.lit(last["pass"])))))
        )
        return ((tick < edge) | ((tick == edge) & ~after)).cast("int")

    passes = sum((taken_in(p) for p in range(max_repeats)), F.lit(0))
    return queued.select("id", "mark", "source", "size", "source_size", "target", (F.col("size") * passes).cast("bigint").alias("taken"))


def mixed_documents(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.0,
    max_repeats: int = 3,
) -> DataFrame:
    """The rows of ``df`` that the mix takes, once for each pass, with the columns of ``df``, whatever their names.

    Documents without words are left out, since they take nothing. Rows that share id, text and
    source stand next to each other in the queue; any of them may be the one that is taken more often.
    """
    plan = _queued(df, id_col, text_col, source_col, weights, share, max_repeats).where("size > 0")
    times = F.sort_array(F.collect_list((F.col("taken") / F.col("size")).cast("int")), False)
    plan = plan.groupBy("id", "mark", "source").agg(times.alias("times")).where("times[0] > 0")
    plan = Stage(df.sparkSession, "mixed").table(plan.select(*[F.col(c).alias(f"_p_{c}") for c in ("id", "mark", "source", "times")]), "times")
    held = df.select(
        F.col(id_col).alias("_id"),
        F.xxhash64(F.col(text_col).cast("string")).alias("_mark"),
        F.col(source_col).cast("string").alias("_source"),
        F.struct(*[df[c] for c in df.columns]).alias("_row"),
    )
    same = [F.col(f"_{c}").eqNullSafe(F.col(f"_p_{c}")) for c in ("id", "mark", "source")]
    taken = held.join(plan, same)
    turn = F.lit(1)
    if not plan.where(F.size("_p_times") > 1).isEmpty():
        turn = F.row_number().over(W.partitionBy("_id", "_mark", "_source").orderBy(F.xxhash64("_row")))
    copies = F.element_at("_p_times", turn)
    passes = F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>"))
    return taken.withColumn("_passes", passes).withColumn("_pass", F.explode("_passes")).select("_row.*")
