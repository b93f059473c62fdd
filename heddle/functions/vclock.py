"""Version vectors as ``map<bigint, bigint>`` columns: node to counter, where a missing node counts 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MAP = "map<bigint,bigint>"
#: Fixed value of the text form: counters are base 36, in upper case, and have 32 bits.
_COUNTER_MAX = (1 << 32) - 1


def empty() -> Column:
    return F.create_map().cast(_MAP)


def increment(version: Column, node: Column) -> Column:
    """``version`` with the counter of ``node`` one higher."""
    others = F.map_filter(version, lambda k, _: k != node)
    return F.map_concat(others, F.create_map(node.cast("bigint"), F.coalesce(F.element_at(version, node), F.lit(0)) + 1))


def compare(a: Column, b: Column) -> Column:
    """``before``, ``after``, ``equal`` or ``concurrent``."""
    sides = F.map_values(
        F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0)).cast("bigint") - F.coalesce(y, F.lit(0)).cast("bigint"))
    )
    more, less = F.exists(sides, lambda d: d > 0), F.exists(sides, lambda d: d < 0)
    return F.when(more & less, "concurrent").when(more, "after").when(less, "before").otherwise("equal")


def is_equal(a: Column, b: Column) -> Column:
    return compare(a, b) == "equal"


def merge(a: Column, b: Column) -> Column:
    """The larger counter of each node."""
    return F.map_zip_with(a, b, lambda _, x, y: F.greatest(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))))


def merge_all(df: DataFrame, by: list[str], version: str, name: str = "version") -> DataFrame:
    """One merged version for each group; maxima of (group, node) are combined before the shuffle."""
    nodes = df.select(*by, F.explode(version).alias("_node", "_counter"))
    top = nodes.groupBy(*by, "_node").agg(F.max("_counter").alias("_counter"))
    merged = F.map_from_entries(F.collect_list(F.struct("_node", "_counter")))
    return top.groupBy(*by).agg(merged.alias(name))


def to_string(version: Column) -> Column:
    """``{node=COUNTER,...}``: nodes in ascending order, counters in base 36, zeros left out."""
    entries = F.filter(F.array_sort(F.map_entries(version)), lambda e: e["value"] != 0)
    return F.concat(
        F.lit("{"),
        F.array_join(F.transform(entries, lambda e: F.concat(e["key"].cast("string"), F.lit("="), F.conv(e["value"].cast("string"), 10, 36))), ","),
        F.lit("}"),
    )


def is_valid(text: Column) -> Column:
    """Whether ``from_string`` can read a text: empty, or braces around nodes with counters of at most 32 bits.

    Parts without ``=`` are skipped and one ``!`` may stand before a counter.
    """
    parts = _parts(text)
    numbers = F.forall(parts, lambda p: p.rlike(r"^[0-9]{1,18}=!?[0-9A-Za-z]{1,12}$") & (_counter(p) <= _COUNTER_MAX))
    return (text == "") | (text.rlike(r"^\{.*\}$") & numbers)


def _parts(text: Column) -> Column:
    inner = F.substring(text, 2, F.greatest(F.length(text) - 2, F.lit(0)))
    return F.filter(F.split(inner, ","), lambda p: p.contains("="))


def _counter(part: Column) -> Column:
    return F.conv(F.regexp_replace(F.substring_index(part, "=", -1), "^!", ""), 36, 10).cast("decimal(20,0)")


def from_string(text: Column) -> Column:
    """The version of a text; null if it is not valid. Of repeated nodes the last one counts."""
    pairs = F.transform(_parts(text), lambda p: F.struct(F.substring_index(p, "=", 1).cast("bigint").alias("k"), _counter(p).cast("bigint").alias("v")))
    start = F.lit(None).cast(_MAP)
    folded = F.aggregate(
        pairs,
        empty(),
        lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["k"]), F.create_map(p["k"], p["v"])),
    )
    return F.when(is_valid(text), folded).otherwise(start)


def checked(text: Column) -> Column:
    """``from_string``, but an invalid text is an error."""
    return F.when(is_valid(text), from_string(text)).otherwise(
        F.raise_error(F.concat(F.lit("invalid version: "), F.coalesce(text, F.lit("null")))).cast(_MAP)
    )
