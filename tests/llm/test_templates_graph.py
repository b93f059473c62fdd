import os
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

from heddle.llm import graph, templates


def brute_templates(rows, depth=3, least=5, share=0.5, long=50):
    whole = defaultdict(set)
    lines, leaves = [], defaultdict(set)
    for n, (i, text) in enumerate(rows):
        for at, line in enumerate((text or "").split("\n")):
            tokens = ["<*>" if re.search("[0-9]", t) else t for t in re.split(r"[\x20\x09-\x0d]+", line) if t]
            leaf = (len(tokens), *tokens[:depth])
            lines.append(((i, text or ""), n, at, leaf, tuple(tokens)))
            if tokens:
                leaves[leaf].add((i, text or ""))
            if len(tokens) >= long:
                whole[tuple(tokens)].add((i, text or ""))
    different = defaultdict(set)
    for key, _, _, leaf, tokens in lines:
        if tokens and len(leaves[leaf]) >= least:
            different[leaf, tokens].add(key)
    support = Counter()
    for (leaf, tokens), keys in different.items():
        for place, t in enumerate(tokens):
            if t != "<*>":
                support[leaf, place, t] += len(keys)
    template = {}
    for leaf, tokens in different:
        made = tuple(t if support[leaf, p, t] >= least else "<*>" for p, t in enumerate(tokens))
        if sum(t != "<*>" for t in made) >= share * len(made):
            template[leaf, tokens] = (leaf, made)
    docs = defaultdict(set)
    for (leaf, tokens), keys in different.items():
        if (leaf, tokens) in template:
            docs[template[leaf, tokens]] |= keys
    out = []
    for n, (i, text) in enumerate(rows):
        kept, dropped = [], 0
        for at, line in enumerate((text or "").split("\n")):
            _, _, _, leaf, tokens = next(x for x in lines if x[1] == n and x[2] == at)
            if len(whole[tokens]) >= 2 or (leaf, tokens) in template and len(docs[template[leaf, tokens]]) >= least:
                dropped += 1
            else:
                kept.append(line)
        out.append((str(i), dropped + len(kept), dropped, "\n".join(kept)))
    return sorted(out)


def test_templates_against_brute_force(documents):
    rows = [(i, f"Own line number of document {'abcdefgh'[i % 8] * (i + 1)}\nLogged in at {i}:0{i} by user{i} from home\n\nShared footer line\nMore text here {i}") for i in range(12)]
    rows += [(50, None), (51, ""), (52, "\n\n"), (53, "Shared footer line"), (53, "Shared footer line"), (54, "Logged in at noon by nobody from work"), (None, "Shared footer line\nkept"), (55, "word " * 40_000), (56, "Shared\tfooter  line\r")]
    passage = " ".join(f"of{'abcdefgh'[k % 8]} words" for k in range(25))
    rows += [(60, f"{passage} 12\nown words"), (61, f" {passage}\t12a "), (62, passage), (63, f"{passage[9:]}\n{passage[9:]}"), (64, passage[:-1])]
    for least in (3, 5, 100):
        found = templates.drop_boilerplate(documents(rows, extra=True), min_docs=least).collect()
        assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.text) for r in found) == brute_templates(rows, least=least)
    assert templates.drop_boilerplate(documents([])).count() == 0


def brute_links(rows, threshold=0.98):
    """(id, links, component, kept) of each row."""
    out = []
    good = {}
    for k, (i, v, label) in enumerate(rows):
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[k] = np.array(v, float)
    adjacent = defaultdict(set)
    for a in good:
        for b in good:
            if a != b and rows[a][2] == rows[b][2] and len(good[a]) == len(good[b]):
                x, y = good[a], good[b]
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                    adjacent[a].add(b)
    for k, (i, _, _) in enumerate(rows):
        reach, todo = {k}, [k]
        while todo:
            for n in adjacent[todo.pop()] - reach:
                reach.add(n)
                todo.append(n)
        least = min(rows[n][0] for n in reach)
        out.append((i, len(adjacent[k]), least, least == i))
    return out


@pytest.mark.parametrize("options", [{}, {"shard_rows": 60, "block_rows": 50}, {"shard_rows": 60, "block_rows": 90, "most_centroids": 4}])
def test_graph_against_brute_force(spark, options):
    rng = np.random.default_rng(6)
    rows = []
    for label in (1, 2):
        for _ in range(60):
            base = rng.normal(size=16)
            for _ in range(int(rng.integers(1, 5))):
                rows.append((base + rng.normal(size=16) * 0.04, label))
        centre = rng.normal(size=16)
        rows += [(centre + rng.normal(size=16) * 0.02, label) for _ in range(80)]
        rows += [(centre, label)] * 10
    rows = [(100 + k, [float(np.float32(x)) for x in v], label) for k, (v, label) in enumerate(rows)]
    rows += [(1, None, 1), (2, [0.0] * 16, 1), (3, [float("nan")] + [1.0] * 15, 1), (4, [None] + [1.0] * 15, 1), (5, [float("inf")] * 16, 1), (6, rows[0][1], None), (7, [1.0, 2.0], 1), (8, [], 1), (9, [2.0 * x for x in rows[0][1]], 1)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id bigint, embedding array<float>, label int, key string, rep string").repartition(3)
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in graph.near_duplicates(df, **options).collect()}
    want = {i: rest for i, *rest in brute_links(rows)}
    want = {i: tuple(rest) for i, rest in want.items()}
    assert len(found) == len(rows)
    hit, there = sum(f[0] for f in found.values()), sum(w[0] for w in want.values())
    assert hit >= 0.97 * there and all(found[i][0] <= want[i][0] for i in want)
    assert np.mean([found[i][1:] == want[i][1:] for i in want]) > 0.98
    assert all(found[i] == want[i] for i in range(1, 9))


def test_rows_that_share_an_id_are_vectors_of_their_own(spark):
    rng = np.random.default_rng(5)
    a, b, c = rng.normal(size=(3, 16))
    rows = [(1, a, 0), (2, a * 1.01 + 0.001, 0), (1, b, 0), (3, b + 0.001, 0), (1, c, 1), (1, c, 1), (4, c, 1), (1, a, 1), (None, b, 1), (2, None, 0), (2, c, None)]
    rows += [(5 + k % 7, rng.normal(size=16), 0) for k in range(60)]
    rows = [(i, None if v is None else v.tolist(), label) for i, v, label in rows]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(3)
    order = lambda x: sorted(x, key=repr)
    found = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in graph.near_duplicates(df).collect()]
    known = [r for r in rows if r[0] is not None]
    assert order(f for f in found if f[0] is not None) == order(brute_links(known)) and len(found) == len(rows)


def test_graph_of_nothing(spark):
    schema = "vec_id bigint, embedding array<float>, label int"
    assert graph.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    assert [tuple(r) for r in graph.near_duplicates(spark.createDataFrame([(4, [1.0], 1)], schema)).collect()] == [(4, 0, 4, True)]


def pairs_at(rng, n, dim, cosine):
    """``n`` unit vectors and as many partners, each at this cosine."""
    a = rng.normal(size=(n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=(n, dim))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    return a, cosine * a + np.sqrt(1 - cosine * cosine) * b


def test_pairs_without_a_common_cluster_widen_the_overlap(spark):
    a, b = pairs_at(np.random.default_rng(3), 1500, 8, 0.981)
    rows = [(k, v.tolist(), 1) for k, v in enumerate(np.stack([a, b], axis=1).reshape(-1, 8))]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    found = {r.vec_id: r.n_links for r in graph.near_duplicates(df, shard_rows=15, overlap=1).collect()}
    unit = np.stack([v for _, v, _ in rows])
    want = (unit @ unit.T >= 0.98).sum(axis=1) - 1
    assert np.mean([found[k] / n for k, n in enumerate(want) if n]) >= 0.97
    assert all(found[k] <= n for k, n in enumerate(want))


def test_large_group_does_not_hide_lost_pairs():
    rng = np.random.default_rng(4)
    centre = rng.normal(size=16)
    group = centre + rng.normal(size=(300, 16)) * 0.01
    vectors = graph._unit(np.concatenate([group, *pairs_at(rng, 40, 16, 0.99)]))
    n = len(vectors)
    edges = np.full((n, 8), -1, np.int64)
    edges[:300] = rng.integers(0, 300, (300, 8))  # nothing leads to the pairs
    ids = np.arange(n)
    q, v = graph.audited_search(vectors, ids, edges, vectors, ids, ids % 50 == 0, 0.98, 16, 0.98)
    other = q != v
    assert other.sum() == (vectors @ vectors.T >= 0.98).sum() - n
    assert set(range(300, n)) <= set(q[other].tolist())


def test_shared_width():
    a = np.array([[4, 2, 7], [1, 2, 3], [5, 6, 7]])
    b = np.array([[4, 1, 0], [9, 8, 1], [1, 2, 3]])
    assert graph.shared_width(a, b).tolist() == [1, 3, 4]


def worker_peaks():
    """The most MB that each Python process below this one has held so far."""
    peak, parent = {}, {}
    for path in Path("/proc").glob("[0-9]*/status"):
        try:
            of = dict(line.split(":", 1) for line in path.read_text().splitlines() if ":" in line)
        except OSError:
            continue
        parent[int(path.parent.name)] = int(of["PPid"])
        if of["Name"].strip().startswith("python") and "VmHWM" in of:
            peak[int(path.parent.name)] = int(of["VmHWM"].split()[0]) / 1024

    def below(p):
        while p := parent.get(p):
            if p == os.getpid():
                return True
        return False

    return {p: mb for p, mb in peak.items() if below(p)}


def test_memory_does_not_follow_the_pairs_of_a_large_group(spark):
    rng = np.random.default_rng(8)
    group = rng.normal(size=64) + rng.normal(size=(1500, 64)) * 0.08
    unit = graph._unit(np.concatenate([group, *pairs_at(rng, 50, 64, 0.99)]))
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(unit)], "vec_id bigint, embedding array<double>, label int")
    before = worker_peaks()
    found = {r.vec_id: (r.n_links, r.component_id) for r in graph.near_duplicates(df).collect()}
    after = worker_peaks()
    want = (unit @ unit.T >= 0.98).sum(axis=1) - 1
    assert want[:1500].min() > 1400 and set(want[1500:]) == {1}
    assert np.mean([found[k][0] / n for k, n in enumerate(want)]) >= 0.99 and all(found[k][0] <= n for k, n in enumerate(want))
    assert {found[k][1] for k in range(1500)} == {0} and np.mean([found[k][1] == 1500 + k % 50 for k in range(1500, 1600)]) >= 0.9
    # Two million pairs, whose vectors alone are 2 GB.
    assert max(mb for p, mb in after.items() if mb > before.get(p, 0)) < 700


def test_flags_of_a_block():
    rng = np.random.default_rng(9)
    nodes, ids = rng.permutation(1000)[:400], 1000 + rng.permutation(1000)[:600]
    hit = rng.random((600, 400)) < 0.0015
    hit[300] = rng.random(400) < 0.5
    copies = rng.integers(1, 5, 400)
    lists = lambda n: [sorted({70, *rng.choice(200, 3).tolist()}) for _ in range(n)]
    asking, own = lists(600), lists(400)
    links, root = graph.first_links(hit, pd.Series(asking), pd.Series(own), 70, copies), graph._roots(hit, ids, nodes)
    for q in range(600):
        assert links[q] == sum(copies[v] for v in np.nonzero(hit[q])[0] if min({*asking[q]} & {*own[v]}) == 70)
        rows, columns = {q}, set()
        while True:
            more = {v for r in rows for v in np.nonzero(hit[r])[0]} - columns
            if not more:
                break
            columns |= more
            rows |= {r for v in columns for r in np.nonzero(hit[:, v])[0]}
        assert root[q] == min([ids[q], *(ids[r] for r in rows), *(nodes[v] for v in columns)])


def test_pairs_near_the_threshold_are_judged_alike_from_both_sides():
    a, b = pairs_at(np.random.default_rng(10), 300, 16, 0.98)
    a, b = a * np.linspace(0.1, 9, 300)[:, None], b * np.linspace(7, 0.2, 300)[:, None]
    want = np.einsum("ij,ij->i", a, b) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)) >= 0.98
    one, other = np.ones((300, 300), bool), np.ones((300, 300), bool)
    graph.keep_sure(one, a, b, 0.98)
    graph.keep_sure(other, b, a, 0.98)
    assert (one == other.T).all() and (one.diagonal() == want).all() and 0 < want.sum() < 300 and one.sum() == want.sum()


def test_range_expansion_follows_every_edge():
    rng = np.random.default_rng(11)
    vectors = graph._unit(rng.normal(size=16) + rng.normal(size=(700, 16)) * 0.045)
    edges = np.where(rng.random((700, 3)) < 0.6, rng.integers(0, 700, (700, 3)), -1)
    queries = vectors[:330]
    near = vectors.astype(np.float32) @ vectors.astype(np.float32).T >= 0.98 - 1e-5
    for start, hit in zip((0, 256), graph.range_hits(vectors, edges, 5, queries, 0.98, 1), strict=True):
        for k, row in enumerate(hit):
            q, seen, todo = start + k, {5}, [5]
            best = vectors @ vectors[q]
            # The beam of one walks to the nearest vector it sees; from all in range it goes on.
            at = 5
            while len(new := [v for v in edges[at] if v >= 0 and v not in seen]):
                seen |= {*new}
                if best[new].max() <= best[at]:
                    break
                at = max(new, key=lambda v: best[v])
            todo = [v for v in seen if near[q, v]]
            reached = set(seen)
            while todo:
                for v in edges[todo.pop()]:
                    if v >= 0 and v not in reached:
                        reached.add(v)
                        if near[q, v]:
                            todo.append(v)
            assert set(np.nonzero(row)[0]) == {v for v in reached if near[q, v]}
