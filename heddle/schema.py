"""Fixed schemas. Node ids and counters are unsigned in other systems; here they are bigint and not negative."""

from __future__ import annotations

from pyspark.sql import types as T

VERSION = T.MapType(T.LongType(), T.LongType())
SIBLING = T.StructType(
    [T.StructField("version", VERSION), T.StructField("tombstone", T.BooleanType()), T.StructField("data", T.StringType())]
)
#: One row for each write; ``seq`` is the order of arrival.
WRITE = T.StructType([T.StructField("seq", T.LongType()), T.StructField("key", T.StringType()), *SIBLING.fields])
#: One row for each node that an observer reports.
NODE = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("run_id", T.LongType()),
        T.StructField("gen", T.LongType()),
        T.StructField("status", T.IntegerType()),
    ]
)
HEALTHY, UNHEALTHY, LEFT = 1, 2, 3
