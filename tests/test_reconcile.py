import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from heddle.operators.reconcile import append_version, covers, fold_writes, maximal_versions, siblings_by_anti_join

SCHEMA = "seq bigint, key string, tombstone boolean, version map<bigint,bigint>"


def write(version, tombstone=False, name=None):
    return (version, tombstone, name)


@pytest.mark.parametrize(
    ("state", "new", "want"),
    [
        ([], {1: 1}, [{1: 1}]),
        ([{1: 1}], {1: 2}, [{1: 2}]),
        ([{1: 1}, {2: 1}], {1: 2}, [{2: 1}, {1: 2}]),
        ([{1: 1}, {2: 1}], {1: 2, 2: 1}, [{1: 2, 2: 1}]),
        ([{1: 2}], {1: 1}, None),
        ([{1: 1}], {1: 1}, None),
    ],
)
def test_append(state, new, want):
    after = append_version([write(v) for v in state], write(new))
    assert (None if after is None else [a[0] for a in after]) == want


def test_tombstones():
    live, dead = write({1: 1}), write({2: 1}, True)
    assert append_version([live], dead) is None
    assert append_version([dead], live) == [live]
    assert append_version([dead], write({2: 2})) == [write({2: 2})]
    assert append_version([live], write({1: 2}, True)) == [write({1: 2}, True)]
    assert append_version([dead], write({1: 1}, True)) == [write({1: 1}, True)]


versions = st.dictionaries(st.integers(0, 2), st.integers(1, 4), max_size=3)


@given(st.lists(versions, max_size=12), st.randoms())
@settings(max_examples=200, deadline=None)
def test_without_tombstones_order_does_not_matter(found, rng):
    def fold(items):
        state = []
        for v in items:
            after = append_version(state, write(v))
            state = state if after is None else after
        return sorted(tuple(sorted((k, n) for k, n in s[0].items() if n)) for s in state)

    shuffled = found[:]
    rng.shuffle(shuffled)
    maximal = {tuple(sorted(v.items())) for v in found if not any(covers(o, v) and not covers(v, o) for o in found)}
    assert fold(found) == fold(shuffled) == sorted(maximal)


def reference_fold(rows):
    state, accepted = {}, {}
    for seq, key, tombstone, version in sorted(rows):
        after = append_version(state.get(key, []), (version, tombstone, seq))
        accepted[seq] = after is not None
        state[key] = state.get(key, []) if after is None else after
    return accepted, {s[2] for found in state.values() for s in found}


@pytest.fixture
def rows():
    rng = random.Random(5)
    make = lambda: {n: c for n in range(3) if (c := rng.randint(0, 4))}
    return [(i, rng.choice(["hot", "hot", "a", "b", ""]), rng.random() < 0.2, make()) for i in range(400)]


def test_fold_matches_plain_python(spark, rows):
    found = fold_writes(spark.createDataFrame(rows, SCHEMA).repartition(5), ["key"]).collect()
    accepted, alive = reference_fold(rows)
    assert {r.seq: r.accepted for r in found} == accepted
    assert {r.seq for r in found if r.surviving} == alive
    assert len(found) == len(rows)


def test_two_ways_to_maximal_versions(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    fast = {(r.key, r.seq) for r in maximal_versions(df, ["key"]).collect()}
    joined = {(r.key, r.seq) for r in siblings_by_anti_join(df, ["key"]).collect()}
    assert fast == joined and fast


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert fold_writes(none, ["key"]).count() == 0
    assert maximal_versions(none, ["key"]).count() == 0


def test_replayed_writes_change_nothing(spark, rows):
    twice = [r for r in rows if not r[2]]
    again = [(s + 10_000, k, t, v) for s, k, t, v in twice]
    once = {(r.key, r.seq) for r in fold_writes(spark.createDataFrame(twice, SCHEMA), ["key"]).where("surviving").collect()}
    both = {(r.key, r.seq) for r in fold_writes(spark.createDataFrame(twice + again, SCHEMA), ["key"]).where("surviving").collect()}
    assert once == both
