"""Cluster state: merging observations, state hashes, generations and indirect probes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heddle.operators.log import previous, running_counts
from heddle.schema import HEALTHY, LEFT


def merge_states(observations: DataFrame) -> DataFrame:
    """``(id, run_id, gen, status)``: one state for each node from many observations, in any order.

    A newer run wins; within a run, having left wins, then the higher generation, then the
    worse status. The generation is the highest seen in the winning run.
    """
    rank = F.struct("run_id", (F.col("status") == LEFT).alias("left"), "gen", "status")
    best = observations.groupBy("id").agg(F.max(rank).alias("best"))
    gens = observations.groupBy("id", "run_id").agg(F.max("gen").alias("top"))
    joined = best.select("id", F.col("best.run_id").alias("run_id"), F.col("best.status").alias("status")).join(gens, ["id", "run_id"])
    return joined.select("id", "run_id", F.col("top").alias("gen"), "status")


def state_hash(nodes: DataFrame) -> DataFrame:
    """One number for a whole state: the XOR of the nodes' hashes; status has no part in it."""
    return nodes.agg(F.bit_xor(F.xxhash64("id", "run_id", "gen")).alias("state_hash"))


def reachable(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("status") == HEALTHY)


def generations(signals: DataFrame) -> DataFrame:
    """``(node, seq, status, gen)``: the generation rises by one whenever a node's status changes (from healthy at first).

    Both the status before and the count of changes are found within blocks of ``seq``, so a
    node with very many signals is many small groups.
    """
    before = previous(signals, "node", "seq", "status", "before")
    changed = F.col("status") != F.coalesce("before", F.lit(HEALTHY))
    return running_counts(before, "node", "seq", {"gen": changed}).drop("before")


def indirect_verdicts(votes: DataFrame) -> DataFrame:
    """``(target, votes, verdict)``: healthy or unhealthy if all voters agree, else undecided."""
    agreed = F.when(F.bool_and("healthy"), "healthy").when(F.bool_and(~F.col("healthy")), "unhealthy").otherwise("undecided")
    return votes.groupBy("target").agg(F.count(F.lit(1)).alias("votes"), agreed.alias("verdict"))


def detect(direct: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``(target, status)``: a failed direct probe counts only if the indirect verdict does not call the target healthy."""
    joined = direct.join(verdicts, "target", "left")
    failed = ~F.col("reached") & (F.coalesce("verdict", F.lit("unhealthy")) != "healthy")
    return joined.select("target", F.when(failed, F.lit(2)).otherwise(F.lit(1)).alias("status"))


def pick_probers(nodes: DataFrame, per_target: int, seed: int = 0) -> DataFrame:
    """``(target, prober)``: up to ``per_target`` healthy other nodes for each target, by a hash that stands for chance."""
    healthy = reachable(nodes).select(F.col("id").alias("prober"))
    slots = nodes.select(F.col("id").alias("target"), F.explode(F.sequence(F.lit(1), F.lit(per_target))).alias("slot"))
    total = healthy.count()
    numbered = healthy.withColumn("n", F.row_number().over(W.orderBy("prober")) - 1)
    wanted = slots.withColumn("n", F.pmod(F.xxhash64("target", F.lit(seed)) + F.col("slot"), F.lit(max(1, total))).cast("int"))
    return wanted.join(numbered, "n").where("target != prober").select("target", "prober").distinct()
