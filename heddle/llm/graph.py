"""Near-duplicate embeddings by search in robust-pruned flat graphs.

Vectors of a label are dealt to overlapping cluster shards (the few nearest of its
centroids). Each shard builds a flat graph: a vector's candidate neighbours are thinned
so that no kept neighbour is much closer to another kept one than to the vector. The
lists that different shards make for a vector are united. Each vector of a shard is
then searched for greedily from the shard's medoid; a search that has reached the range
goes on from everything in range until nothing new turns up. Found pairs are verified
by their cosine in double precision. A shard audits the recall of its searches against brute force
on a share of its vectors, and searches again with a wider beam if it is short.

What no shard can see, a pair without a common cluster, is audited across shards: every
vector with an id divisible by 50 is compared with all vectors of its label. That sets the
overlap of each label before the search, and afterwards labels whose found links fall
short are searched again, with more clusters for each vector and wider beams, at the last by brute force.

Clustering has two levels. Centroids are fitted on a sample and bounded in number; a cluster with more
vectors than a shard may hold is dealt once more, to the nearest of pivots, vectors of its own whose
number grows with it. A shard that is still too large, as very many near copies make one, is cut
into blocks with a graph each, and its vectors are searched for in every block, a block of queries at a time.
What a block finds is a matrix of flags, so that memory depends on the size of blocks and not on the number of pairs.

Different vectors of a label are nodes with a number of their own, whatever their ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.components import connected_components
from heddle.llm.shared import Stage, sampled, shuffle_width

_QUERY_BLOCK = 256
_BACK, _BACK_MOST = 3, 32
_LEAST_AUDITED = 64  # queries a shard audits, if it has as many
_AUDIT_BYTES = 8 << 20  # vectors of a block of the audit across shards
_AUDIT_COLUMNS = 8192
_ROUNDING = 1e-5  # of cosines in single precision
_RANKS = 16  # nearest clusters of a vector that the audit looks at
_PAIRS = 20_000  # pairs that are looked at one by one together
_CLOSE = 1e-9  # cosines as near to the threshold are computed pair by pair, the same from both sides
_CHUNK = 10_000  # vectors of a large cluster that are dealt to pivots together
_CELLS = 1 << 21  # cosines with pivots that are sorted together


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def robust_prune(vectors: np.ndarray, degree: int, candidates: int, alpha: float) -> np.ndarray:
    """Out-neighbours of each unit vector, filled up with -1.

    In order of distance, one of the nearest vectors is kept unless a kept neighbour is
    ``alpha`` times closer to it than the vector itself is. A third of the degree goes to
    random vectors: long edges, without which a group of more near copies than the
    degree would be an island.
    """
    n = len(vectors)
    vectors = vectors.astype(np.float32)
    near = min(candidates, n - 1)
    long = degree // 3
    out = np.full((n, degree), -1, np.int64)
    if near < 1:
        return out
    out[:, degree - long :] = np.random.default_rng(n).integers(0, n, (n, long))
    degree -= long
    for start in range(0, n, _QUERY_BLOCK):
        rows = np.arange(start, min(n, start + _QUERY_BLOCK))
        cosine = vectors[rows] @ vectors.T
        cosine[np.arange(len(rows)), rows] = -np.inf
        top = np.argpartition(-cosine, near - 1, axis=1)[:, :near]
        distance = np.maximum(0.0, 2.0 - 2.0 * np.take_along_axis(cosine, top, axis=1))
        order = np.argsort(distance, axis=1)
        pool, distance = np.take_along_axis(top, order, axis=1), np.take_along_axis(distance, order, axis=1)
        points = vectors[pool]
        between = np.maximum(0.0, 2.0 - 2.0 * np.matmul(points, points.transpose(0, 2, 1)))
        alive = np.ones(distance.shape, bool)
        count = np.zeros(len(rows), np.int64)
        for k in range(pool.shape[1]):
            keep = np.nonzero(alive[:, k] & (count < degree))[0]
            out[rows[keep], count[keep]] = pool[keep, k]
            count[keep] += 1
            # Squared distances, hence alpha squared.
            alive[keep] &= alpha * alpha * between[keep, k] > distance[keep]
    return _with_way_back(out, _BACK)


def _with_way_back(graph: np.ndarray, nearest: int) -> np.ndarray:
    """Add an edge back from each vector's first ``nearest`` neighbours, so that few lack a way in from close by."""
    to, by = np.repeat(np.arange(len(graph)), nearest), graph[:, :nearest].ravel()
    to, by = to[by >= 0], by[by >= 0]
    order = np.argsort(by, kind="stable")
    to, by = to[order], by[order]
    slot = np.arange(len(by)) - np.searchsorted(by, by)
    to, by, slot = to[slot < _BACK_MOST], by[slot < _BACK_MOST], slot[slot < _BACK_MOST]
    back = np.full((len(graph), 1 + slot.max(initial=0)), -1, np.int64)
    back[by, slot] = to
    return np.concatenate([graph, back], axis=1)


def range_hits(vectors: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray, threshold: float, beam: int) -> Iterator[np.ndarray]:
    """For each block of queries, which vectors with a cosine of ``threshold`` or more greedy search reaches: a row of flags a query."""
    n = len(vectors)
    vectors, queries = vectors.astype(np.float32), queries.astype(np.float32)
    beam = min(beam, n)
    slack = threshold - _ROUNDING  # pairs are verified later
    edges = _by_target(graph)
    for start in range(0, len(queries), _QUERY_BLOCK):
        block = queries[start : start + _QUERY_BLOCK]
        b = len(block)
        seen = np.zeros((b, n), bool)
        cosine = np.full((b, n), -np.inf, np.float32)
        opened = np.zeros((b, n), bool)
        first = block @ vectors[entry]
        seen[:, entry], cosine[:, entry] = True, first
        pool = np.full((b, beam), -1, np.int64)
        pool_cos = np.full((b, beam), -np.inf, np.float32)
        pool[:, 0], pool_cos[:, 0] = entry, first
        live = np.arange(b)
        while len(live):
            # Of each beam, the nearest vector that was not opened.
            closed = (pool[live] < 0) | opened[live[:, None], np.maximum(pool[live], 0)]
            at = np.where(closed, -np.inf, pool_cos[live]).argmax(axis=1)
            going = ~closed[np.arange(len(live)), at]
            live, at = live[going], at[going]
            if not len(live):
                break
            node = pool[live, at]
            opened[live, node] = True
            _visit(vectors, graph, block, live, node, seen, cosine, pool, pool_cos)
        # Range expansion: open everything in range, also what did not fit the beam.
        hit = cosine >= slack
        new = hit & ~opened
        while new.any():
            reached = _across(edges, new) & ~seen
            seen |= reached
            at = np.nonzero(reached.any(axis=0))[0]
            new = np.zeros_like(hit)
            new[:, at] = reached[:, at] & (block @ vectors[at].T >= slack)
            hit |= new
        yield hit


def _by_target(graph: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges as (from, to), in order of ``to``."""
    by, slot = np.nonzero(graph >= 0)
    to = graph[by, slot]
    order = np.argsort(to, kind="stable")
    return by[order], to[order]


def _across(edges: tuple[np.ndarray, np.ndarray], marks: np.ndarray) -> np.ndarray:
    """For each query's row of marked vectors, the vectors that an edge leads to from a marked one.

    The queries of a block are the bits of a few words, so that an edge is followed once for all of them.
    """
    by, to = edges
    bits = np.zeros((marks.shape[1], _QUERY_BLOCK // 8), np.uint8)
    bits[:, : -(-len(marks) // 8)] = np.packbits(marks, axis=0).T
    words = bits.view(np.uint64)
    going = words.any(axis=1)[by]
    by, to = by[going], to[going]
    out = np.zeros_like(words)
    if len(to):
        first = np.nonzero(np.diff(to, prepend=-1))[0]
        out[to[first]] = np.bitwise_or.reduceat(words[by], first, axis=0)
    return np.unpackbits(out.view(np.uint8).T, axis=0, count=len(marks)).astype(bool)


def _visit(vectors, graph, block, live, node, seen, cosine, pool, pool_cos) -> None:
    """Open one vector for each live query: look at its neighbours and keep the best in the beam."""
    new = graph[node]
    fresh = (new >= 0) & ~seen[live[:, None], np.maximum(new, 0)]
    new = np.where(fresh, new, -1)
    value = np.matmul(vectors[np.maximum(new, 0)], block[live][:, :, None])[:, :, 0]
    value[~fresh] = -np.inf
    rows, columns = np.nonzero(fresh)
    seen[live[rows], new[rows, columns]] = True
    cosine[live[rows], new[rows, columns]] = value[rows, columns]
    joint, joint_cos = np.concatenate([pool[live], new], axis=1), np.concatenate([pool_cos[live], value], axis=1)
    best = np.argpartition(-joint_cos, pool.shape[1] - 1, axis=1)[:, : pool.shape[1]]
    pool[live], pool_cos[live] = np.take_along_axis(joint, best, axis=1), np.take_along_axis(joint_cos, best, axis=1)


def _close(queries: np.ndarray, vectors: np.ndarray, least: float) -> Iterator[np.ndarray]:
    """By brute force, for each block of queries, which vectors have a cosine of ``least`` or more."""
    for start in range(0, len(queries), _QUERY_BLOCK):
        yield queries[start : start + _QUERY_BLOCK] @ vectors.T >= least


def audited_hits(vectors, ids, graph, queries, query_ids, audit, threshold: float, beam: int, recall: float) -> Iterator[np.ndarray]:
    """Range search whose beam doubles until the audited recall is reached, as rows of flags for each block of queries.

    Audited are the queries flagged in ``audit``, and others spread evenly if those are few. Recall
    is the mean over audited queries that have a match other than themselves, so that no large group
    outweighs the rest. Without such a query nothing would be known of the searches, and the
    shard is compared by brute force, as it is by the widest beam.
    """
    entry = int((vectors @ vectors.mean(axis=0)).argmax())
    spread = np.linspace(0, max(0, len(queries) - 1), min(_LEAST_AUDITED, len(queries))).astype(np.int64)
    picked = np.nonzero(audit)[0]
    picked = np.union1d(picked, spread) if len(picked) < _LEAST_AUDITED else picked
    truth = np.concatenate(list(_close(queries[picked], vectors, threshold)))
    truth &= query_ids[picked][:, None] != ids[None, :]
    linked = truth.any(axis=1)
    picked, truth = picked[linked], truth[linked]
    while len(picked) and beam < len(vectors):
        hit = np.concatenate(list(range_hits(vectors, graph, entry, queries[picked], threshold, beam)))
        if ((hit & truth).sum(axis=1) / truth.sum(axis=1)).mean() >= recall:
            yield from range_hits(vectors, graph, entry, queries, threshold, beam)
            return
        beam *= 2
    yield from _close(queries, vectors, threshold - _ROUNDING)


def audited_search(vectors, ids, graph, queries, query_ids, audit, threshold: float, beam: int, recall: float) -> tuple[np.ndarray, np.ndarray]:
    """What ``audited_hits`` finds, as (query row, vector) pairs."""
    return np.nonzero(np.concatenate(list(audited_hits(vectors, ids, graph, queries, query_ids, audit, threshold, beam, recall))))


def _parts(hit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A matrix of flags a block of rows at a time, as the rows and columns with a flag and what stands there."""
    for start in range(0, len(hit), _QUERY_BLOCK):
        block = hit[start : start + _QUERY_BLOCK]
        r, c = np.nonzero(block.any(axis=1))[0], np.nonzero(block.any(axis=0))[0]
        if len(r):
            yield start + r, c, block[np.ix_(r, c)]


def keep_sure(hit: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> None:
    """Take back, in place, pairs whose cosine in double precision is below ``threshold``."""
    a, b = np.linalg.norm(left, axis=1), np.linalg.norm(right, axis=1)
    x, y = left / a[:, None], right / b[:, None]
    for r, c, part in _parts(hit):
        cosine = x[r] @ y[c].T
        sure = part & (cosine >= threshold)
        q, v = np.nonzero(part & (np.abs(cosine - threshold) < _CLOSE))
        for at in range(0, len(q), _PAIRS):
            i, j = q[at : at + _PAIRS], v[at : at + _PAIRS]
            sure[i, j] = np.einsum("ij,ij->i", left[r[i]], right[c[j]]) / (a[r[i]] * b[c[j]]) >= threshold
        hit[np.ix_(r, c)] = sure


def first_links(hit: np.ndarray, asking: pd.Series, own: pd.Series, shard: int, copies: np.ndarray) -> np.ndarray:
    """Rows that each query links with, of the pairs that have no smaller shard than this one in common.

    ``asking`` and ``own`` are the shards of the queries and of the vectors.
    """
    lower = np.concatenate(own.to_numpy())
    lower = np.unique(lower[lower < shard])
    a, b = _marks(asking, lower), _marks(own, lower)
    links = np.zeros(len(hit), np.int64)
    for r, c, part in _parts(hit):
        for word in range(a.shape[1]):
            part &= (a[r, word][:, None] & b[c, word]) == 0
        links[r] = part @ copies[c]
    return links


def _marks(shards: pd.Series, names: np.ndarray) -> np.ndarray:
    """For each row the bits of those ``names`` that are among its shards, in words."""
    out = np.zeros((len(shards), -(-len(names) // 64)), np.uint64)
    row, flat = np.repeat(np.arange(len(shards)), shards.map(len)), np.concatenate(shards.to_numpy())
    known = np.isin(flat, names)
    place = np.searchsorted(names, flat[known])
    np.bitwise_or.at(out, (row[known], place // 64), np.uint64(1) << (place % 64).astype(np.uint64))
    return out


def shared_width(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows of nearest clusters, how many of each row must be taken until both hold a cluster in common."""
    width = a.shape[1]
    rank = np.maximum.outer(np.arange(width), np.arange(width))
    return 1 + np.where(a[:, :, None] == b[:, None, :], rank, width).min(axis=(1, 2), initial=width)


def true_links(ranked: DataFrame, threshold: float) -> DataFrame:
    """``(label, node, width, n)``: links of every audited vector with all vectors of its label, by brute force.

    ``n`` counts the rows of the other vectors by the number of nearest clusters that a shard has to
    take in (``shared_width``). Audited vectors and vectors meet in pairs of blocks, a group each.
    """
    rows = F.greatest(F.lit(256), F.floor(_AUDIT_BYTES / (8 * F.size("vector"))))
    sizes = ranked.groupBy("label").agg(
        F.ceil(F.count(F.lit(1)) / F.min(rows)).cast("int").alias("data_blocks"), F.ceil(F.sum(F.col("audited").cast("int")) / F.min(rows)).cast("int").alias("query_blocks")
    )
    dealt = ranked.join(sizes.where("query_blocks > 0"), "label").withColumn("hash", F.xxhash64("key"))
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    own = lambda blocks: F.pmod("hash", F.col(blocks)).cast("int")
    columns = ["label", "node", "copies", "vector", "near", "is_query", "q_block", "d_block"]
    data = dealt.withColumn("is_query", F.lit(False)).withColumn("d_block", own("data_blocks")).withColumn("q_block", every("query_blocks"))
    asked = dealt.where("audited").withColumn("is_query", F.lit(True)).withColumn("q_block", own("query_blocks")).withColumn("d_block", every("data_blocks"))

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        asking = block["is_query"].to_numpy()
        if asking.all() or not asking.any():
            return pd.DataFrame({"label": [], "node": [], "width": [], "n": []})
        points, near, nodes, copies = _unit(_matrix(block["vector"])), np.stack(block["near"].to_numpy()), block["node"].to_numpy(), block["copies"].to_numpy()
        left, right = np.nonzero(asking)[0], np.nonzero(~asking)[0]
        counts = np.zeros((len(left), near.shape[1] + 2), np.int64)
        for i in range(0, len(left), _QUERY_BLOCK):
            for j in range(0, len(right), _AUDIT_COLUMNS):
                x, y = left[i : i + _QUERY_BLOCK], right[j : j + _AUDIT_COLUMNS]
                q, v = np.nonzero((points[x] @ points[y].T >= threshold) & (nodes[x][:, None] != nodes[y][None, :]))
                for at in range(0, len(q), _PAIRS):
                    a, b = q[at : at + _PAIRS], y[v[at : at + _PAIRS]]
                    np.add.at(counts, (i + a, shared_width(near[x[a]], near[b])), copies[b])
        q, width = np.nonzero(counts)
        return pd.DataFrame({"label": block["label"].iloc[0], "node": nodes[left[q]], "width": width, "n": counts[q, width]})

    blocks = data.select(columns).unionByName(asked.select(columns)).groupBy("label", "q_block", "d_block")
    found = blocks.applyInPandas(compare, "label string, node bigint, width int, n bigint")
    return found.groupBy("label", "node", "width").agg(F.sum("n").alias("n"))


def mean_recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """``(label, queries, recall)``: the mean over audited vectors with links of the share of their links that was found."""
    wanted = truth.groupBy("label", "node").agg(F.sum("n").alias("n"))
    got = found.groupBy("node").agg(F.sum("links").alias("links"))
    share = F.least(F.lit(1.0), F.coalesce("links", F.lit(0)) / F.col("n"))
    return wanted.join(got, "node", "left").groupBy("label").agg(F.count(F.lit(1)).alias("queries"), F.avg(share).alias("recall"))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64, copy=False)


def centroids(distinct: DataFrame, shard_rows: int, sample_rows: int, most: int, rounds: int = 5) -> dict[str, np.ndarray]:
    """Unit centroids for each label, from a sample of at most ``sample_rows`` vectors; ``most`` in all.

    A label gets one for each ``shard_rows`` of its vectors, or its part of ``most``.
    """
    sizes = dict(map(tuple, distinct.groupBy("label").count().collect()))
    wanted = {k: max(1, round(n / shard_rows)) for k, n in sizes.items()}
    squeeze = max(1.0, sum(wanted.values()) / most)
    sample = sampled(distinct, "key", sample_rows, sum(sizes.values())).select("label", "vector").toPandas()
    out = {}
    for label, n in wanted.items():
        own = sample[sample["label"] == label]
        points = _unit(_matrix(own["vector"])) if len(own) else np.zeros((0, 1))
        k = min(max(1, int(n / squeeze)), len(points))
        if k < 2:
            continue  # one shard, which needs no centroid
        centres = points[np.random.default_rng(k).choice(len(points), k, replace=False)]
        for _ in range(rounds):
            home = (points @ centres.T).argmax(axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, home, points)
            norm = np.linalg.norm(sums, axis=1)
            centres = np.where(norm[:, None] > 0, sums / np.where(norm > 0, norm, 1.0)[:, None], centres)
        out[label] = centres
    return out


def overlaps(truth: DataFrame, fitted: dict[str, np.ndarray], least: int, ranks: int, recall: float) -> dict[str, int]:
    """For each label with several clusters, the smallest overlap, ``least`` or more, whose mean recall is at least ``recall``.

    Recall is that of a perfect search in every shard; ``ranks`` is the most that ``truth`` tells apart.
    """
    share = truth.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("label", "node")))
    curve: dict[str, dict[int, float]] = {}
    for label, width, part in map(tuple, share.groupBy("label", "width").agg(F.sum("share")).collect()):
        curve.setdefault(label, {})[width] = part
    out = {}
    for label, centres in fitted.items():
        parts, most = curve.get(label, {}), min(ranks, len(centres))
        total = sum(parts.values())
        enough = (w for w in range(min(least, most), most) if sum(x for k, x in parts.items() if k <= w) >= recall * total)
        out[label] = next(enough, most)
    return out


def _pivot_shards(stage: Stage, large: DataFrame, overlap: int) -> DataFrame:
    """``(node, shards)`` of the vectors of large clusters: the nearest of each cluster's pivots.

    ``large`` has a row for each vector and cluster, with the cluster's size ``n`` and number of ``pivots``.
    """
    numbered = Window.partitionBy("label", "cluster").orderBy("key")
    chosen = large.where(F.pmod(F.xxhash64(F.lit("pivot"), "key"), F.col("n")) < F.col("pivots")).withColumn("number", F.row_number().over(numbered))
    chunks = F.ceil(F.col("n") / _CHUNK).cast("int")
    chosen = stage.table(chosen.select("label", "cluster", "n", "number", "vector"), "pivots")
    pivots = chosen.withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1))).select("label", "cluster", "chunk", "number", "vector")
    dealt = large.withColumn("chunk", F.pmod(F.xxhash64("key"), chunks).cast("int")).select("label", "cluster", "chunk", "node", "vector")

    def nearest(vectors: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        if not len(vectors):
            return pd.DataFrame({"node": [], "shards": []})
        first = np.int64(vectors["cluster"].iloc[0]) << 32
        shards = np.full((len(vectors), 1), first)
        if len(pivots):
            points, centres = _unit(_matrix(vectors["vector"])), _unit(_matrix(pivots["vector"]))
            rows = max(1, _CELLS // len(centres))
            order = [np.argsort(-(points[s : s + rows] @ centres.T), axis=1, kind="stable")[:, :overlap] for s in range(0, len(points), rows)]
            shards = first + pivots["number"].to_numpy()[np.concatenate(order)]
        return pd.DataFrame({"node": vectors["node"], "shards": list(shards)})

    keys = ("label", "cluster", "chunk")
    return dealt.groupBy(*keys).cogroup(pivots.groupBy(*keys)).applyInPandas(nearest, "node bigint, shards array<bigint>")


def _searched(spark, stage: Stage, ranked: DataFrame, widths: dict[str, int], overlap: int, threshold: float, shard_rows: int, block_rows: int, degree: int, candidates: int, alpha: float, beam: int, recall: float) -> DataFrame:
    """``(label, node, links, root)`` of each vector in each of its shards."""
    of_label = spark.createDataFrame(list(widths.items()), "label string, width int")
    taken = F.slice("near", F.lit(1), F.coalesce("width", F.lit(overlap)))
    assigned = ranked.join(F.broadcast(of_label), "label", "left").withColumn("clusters", taken).drop("near", "width")
    dealt = assigned.withColumn("cluster", F.explode("clusters"))
    sizes = stage.table(dealt.groupBy("label", "cluster").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.count(F.lit(1)) / shard_rows).alias("pivots")), "sizes")
    if sizes.where(F.col("n") > block_rows).isEmpty():
        assigned = assigned.withColumn("shards", F.array_sort(F.transform("clusters", lambda c: F.shiftleft(c.cast("bigint"), 32))))
    else:
        sized = dealt.drop("clusters").join(sizes, ["label", "cluster"])
        small = sized.where(F.col("n") <= block_rows).select("node", F.array(F.shiftleft(F.col("cluster").cast("bigint"), 32)).alias("shards"))
        every = small.unionAll(_pivot_shards(stage, sized.where(F.col("n") > block_rows), overlap))
        joint = every.groupBy("node").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("shards")))).alias("shards"))
        assigned = assigned.join(joint, "node")
    members = stage.table(assigned.drop("clusters").withColumn("shard", F.explode("shards")), "members")
    sizes = members.groupBy("label", "shard").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
    members = members.join(sizes, ["label", "shard"]).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))

    def build(shard: pd.DataFrame) -> pd.DataFrame:
        vectors = _unit(_matrix(shard["vector"]))
        graph = robust_prune(vectors, degree, candidates, alpha)
        nodes = shard["node"].to_numpy()
        return pd.DataFrame({"node": nodes, "near": [nodes[g[g >= 0]] for g in graph]})

    # A number of tasks by shards, as a shard's bytes say little about its work.
    tasks = max(shuffle_width(spark), min(10_000, sizes.agg(F.sum(F.col("blocks") * F.col("blocks"))).first()[0] or 1))
    lists = members.repartition(tasks, "label", "shard", "block").groupBy("label", "shard", "block").applyInPandas(build, "node bigint, near array<bigint>")
    united = stage.table(lists.groupBy("node").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))).alias("near")), "lists")

    # Blocks of a shard meet in pairs, a group each: a block's vectors with their united lists, and those of the block that asks.
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    data = members.join(united, "node", "left").withColumn("is_data", F.lit(True)).withColumn("asked_by", every)
    others = members.where("blocks > 1").withColumn("asked_by", F.col("block")).withColumn("to", every).where("to != asked_by")
    queries = others.withColumn("block", F.col("to")).drop("to").withColumn("near", F.lit(None).cast("array<bigint>")).withColumn("is_data", F.lit(False))
    columns = ["label", "shard", "block", "asked_by", "node", "copies", "vector", "audited", "shards", "near", "is_data"]
    searched = data.select(columns).unionByName(queries.select(columns)).repartition(tasks, "label", "shard", "block", "asked_by")

    def search(shard: pd.DataFrame) -> pd.DataFrame:
        own = shard[shard["is_data"]]
        inside = shard["block"].iloc[0] == shard["asked_by"].iloc[0]
        asking = own if inside else shard[~shard["is_data"]]
        if not len(own) or not len(asking):
            return pd.DataFrame({"label": [], "node": [], "links": [], "root": []})
        right, nodes = _matrix(own["vector"]), own["node"].to_numpy()
        left, ids = _matrix(asking["vector"]), asking["node"].to_numpy()
        place = {r: k for k, r in enumerate(nodes.tolist())}
        lists = [[place[x] for x in (near if near is not None else ()) if x in place] for near in own["near"]]
        graph = np.full((len(own), max([1, *map(len, lists)])), -1, np.int64)
        for k, near in enumerate(lists):
            graph[k, : len(near)] = near
        hit = np.concatenate(list(audited_hits(_unit(right), nodes, graph, _unit(left), ids, asking["audited"].to_numpy(), threshold, beam, recall)))
        if inside:
            np.fill_diagonal(hit, False)
            hit |= hit.T  # what one side of a pair found, both have
        keep_sure(hit, left, right, threshold)
        # A pair that shares several shards counts in the first of them.
        links = first_links(hit, asking["shards"], own["shards"], shard["shard"].iloc[0], own["copies"].to_numpy())
        # Links of the shard reduced to stars around their smallest nodes.
        return pd.DataFrame({"label": shard["label"].iloc[0], "node": ids, "links": links, "root": _roots(hit, ids, nodes)})

    return searched.groupBy("label", "shard", "block", "asked_by").applyInPandas(search, "label string, node bigint, links bigint, root bigint")


def near_duplicates(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = 0.98,
    overlap: int = 3,
    shard_rows: int = 500,
    block_rows: int = 6000,
    degree: int = 18,
    candidates: int = 36,
    alpha: float = 1.2,
    beam: int = 8,
    recall: float = 0.98,
    sample_rows: int = 20_000,
    most_centroids: int = 4096,
) -> DataFrame:
    """``(id_col, n_links, component_id, kept)``: one row for every input row.

    Rows link if their labels are equal and not null and the cosine of their vectors, in
    double precision, is at least ``threshold``. Vectors that are null, zero or that
    hold null or non-finite components link with nothing, and vectors of different
    lengths do not link with each other. Equal vectors are searched once and counted as often as they occur. Rows
    that share an id are vectors of their own in the counts, with the smallest id of their own component. An empty table gives no
    rows; other columns are not read.
    """
    spark = df.sparkSession
    stage = Stage(spark, "graph")
    values = F.col(vector_col).cast("array<double>")
    usable = F.col(label_col).isNotNull() & F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(values, lambda x: x != 0.0)
    rows = df.select(
        F.col(id_col).cast("bigint").alias("id"),
        F.when(usable, F.concat_ws(":", F.size(values), F.col(label_col).cast("string"))).alias("label"),
        F.when(usable, F.transform(values, lambda x: x + 0.0)).alias("vector"),
    )
    key = F.sha2(F.concat_ws(",", F.col("vector").cast("array<string>")), 256)
    rows = stage.table(rows.withColumn("key", key), "rows")
    distinct = rows.where("label IS NOT NULL").groupBy("label", "key").agg(
        F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector"), F.coalesce(F.max(F.col("id") % 50 == 0), F.lit(False)).alias("audited")
    )
    distinct = stage.table(distinct.withColumn("node", F.monotonically_increasing_id()), "distinct")
    fitted = centroids(distinct, shard_rows, sample_rows, most_centroids)
    centres = spark.sparkContext.broadcast(fitted)

    def ranking(ranks: int) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for label, part in frame.groupby("label"):
                    near = centres.value.get(label)
                    if near is None:
                        clusters = np.zeros((len(part), 1), np.int64)
                    else:
                        clusters = np.argsort(-(_unit(_matrix(part["vector"])) @ near.T), axis=1, kind="stable")[:, :ranks]
                    yield part.assign(near=list(clusters))

        columns = distinct.select("label", "key", "node", "copies", "vector", "audited")
        return columns.mapInPandas(run, "label string, key string, node bigint, copies bigint, vector array<double>, audited boolean, near array<int>")

    # Of each label with several clusters, the overlap under which the audited links share a cluster.
    ranks = max(2 * overlap, _RANKS)
    ranked = stage.table(ranking(ranks), "ranked")
    truth = stage.table(true_links(ranked, threshold), "truth")
    widths = overlaps(truth, fitted, overlap, ranks, recall)

    def search_all(some: DataFrame, widths: dict[str, int], beam: int) -> DataFrame:
        return stage.table(_searched(spark, stage, some, widths, overlap, threshold, shard_rows, block_rows, degree, candidates, alpha, beam, recall), "found")

    found = search_all(ranked, widths, beam)
    while short := [label for label, _, r in map(tuple, mean_recall(found, truth).where(F.col("recall") < recall).collect())]:
        beam *= 2
        widths |= {label: min(2 * widths.get(label, overlap), len(fitted[label])) for label in short if label in fitted}
        if max((widths[label] for label in short if label in fitted), default=0) > ranks:
            ranks *= 2
            ranked = stage.table(ranking(ranks), "ranked")
        again = F.broadcast(spark.createDataFrame([(label,) for label in short], "label string"))
        wider = search_all(ranked.join(again, "label", "left_semi"), widths, beam)
        found = stage.table(found.join(again, "label", "left_anti").unionByName(wider), "joint")
        if beam >= 2 * block_rows and all(widths[label] >= len(fitted[label]) for label in short if label in fitted):
            break  # brute force; what is left is rounding
    components = connected_components(found.select(F.col("node").alias("u"), F.col("root").alias("v")), stage)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    placed = (
        distinct.select("label", "key", "node", "first_id", "copies")
        .join(links, "node", "left")
        .join(components.withColumnRenamed("node", "c_node"), F.col("node") == F.col("c_node"), "left")
        .withColumn("root", F.coalesce("component", "node"))
    )
    least = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_key = placed.join(least, "root").select(
        F.col("label").alias("k_label"), F.col("key").alias("k_key"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    joined = rows.select("id", "label", "key").join(of_key, (F.col("label") == F.col("k_label")) & (F.col("key") == F.col("k_key")), "left")
    component = F.coalesce("component_id", "id")
    return joined.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept")
    )


def _roots(hit: np.ndarray, ids: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """For each row, the smallest node that the shard's pairs connect it with."""
    names, place = np.unique(np.concatenate([ids, nodes]), return_inverse=True)
    left, right = place[: len(ids)], place[len(ids) :]
    label, before = np.arange(len(names)), None
    while before is None or (label != before).any():
        before = label.copy()
        for r, c, part in _parts(hit):
            a, b = left[r], right[c]
            label[a] = np.minimum(label[a], np.where(part, label[b], len(names)).min(axis=1))
            label[b] = np.minimum(label[b], np.where(part, label[a][:, None], len(names)).min(axis=0))
        label = label[label]
    return names[label[left]]
