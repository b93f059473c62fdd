import pytest
from pyspark.sql import functions as F

from heddle.functions import vclock

MAP = "map<bigint,bigint>"


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def version(**counters):
    pairs = [x for k, v in counters.items() for x in (F.lit(int(k[1:])), F.lit(v))]
    return F.create_map(*pairs).cast(MAP)


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        (dict(n0=1, n1=1, n2=1), dict(n0=2, n1=1, n2=1), "before"),
        (dict(n0=3, n1=2, n2=1), dict(n0=2, n1=1, n2=1), "after"),
        (dict(n0=1, n1=1), dict(n0=1, n1=1, n2=0), "equal"),
        (dict(n0=1, n1=0), dict(n0=0, n1=1), "concurrent"),
        ({}, {}, "equal"),
        ({}, dict(n1=1), "before"),
    ],
)
def test_compare(spark, a, b, want):
    assert one(spark, vclock.compare(version(**a), version(**b))) == (want,)


def test_merge_and_increment(spark):
    merged, again = one(spark, vclock.merge(version(n1=10, n2=5), version(n1=5, n2=10, n3=100)), vclock.merge(version(n1=1), version(n1=1)))
    assert merged == {1: 10, 2: 10, 3: 100} and again == {1: 1}
    assert one(spark, vclock.increment(version(n1=1), F.lit(1)), vclock.increment(vclock.empty(), F.lit(7))) == ({1: 2}, {7: 1})


@pytest.mark.parametrize(
    ("counters", "text"), [({}, "{}"), (dict(n1=0), "{}"), (dict(n1=10), "{1=A}"), (dict(n1=10, n3=20, n2=5, n0=1, n10=36), "{0=1,1=A,2=5,3=K,10=10}")]
)
def test_encode(spark, counters, text):
    assert one(spark, vclock.to_string(version(**counters))) == (text,)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("", {}),
        ("{}", {}),
        ("{1=A}", {1: 10}),
        ("{0=1,1=a,2=5,3=K}", {0: 1, 1: 10, 2: 5, 3: 20}),
        ("{1=!Z,junk,1=2}", {1: 2}),
        ("invalid", None),
        ("{1=invalid}", None),
        ("{1=}", None),
        ("{1=1Z141Z3}", {1: 4294967295}),
        ("{1=1Z141Z4}", None),
    ],
)
def test_decode(spark, text, want):
    assert one(spark, vclock.from_string(F.lit(text))) == (want,)


def test_checked_raises(spark):
    with pytest.raises(Exception, match="invalid version"):
        one(spark, vclock.checked(F.lit("{1=invalid}")))


def test_merge_all_skips_empty_groups(spark):
    df = spark.createDataFrame([("a", {1: 1, 2: 5}), ("a", {1: 3}), ("b", {2: 1})], "key string, version map<bigint,bigint>")
    assert {r.key: r.version for r in vclock.merge_all(df, ["key"], "version").collect()} == {"a": {1: 3, 2: 5}, "b": {2: 1}}
