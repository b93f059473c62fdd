"""Connected components of an edge list, by alternating large-star and small-star rounds.

Each round rewires edges towards smaller neighbours until every component is a star
around its smallest node (Kiveris et al., "Connected Components in MapReduce and
Beyond", 2014). Minima are aggregated before they are joined back, so a node with very
many neighbours costs one row for each task before the shuffle, and the join on it is
one that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.shared import Stage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
    return both.where(F.col("v") > F.col("u")).join(least, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges come with ``u > v``."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least.withColumnRenamed("u", "x"), F.col("u") == F.col("x")).select("v", "m")
    return joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, stage: Stage) -> DataFrame:
    """``(node, component)`` for each node of ``edges (u, v)``; the component is its smallest node.

    Loops, repeated and two-way edges are fine; nodes without edges do not appear, and no
    edges give no rows. Each round is a written table, and rounds end when one changes nothing.
    """
    start = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    current, before = stage.table(start, "edges"), None
    while True:
        mark = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or mark[0] == 0:
            break
        before = mark
        following = stage.table(_small_star(_large_star(current)), "edges")
        stage.drop(current)
        current = following
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
