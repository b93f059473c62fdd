"""Consistency levels, register bytes, bloom filter sizes, address lists."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def needed_acks(level: Column, total: Column) -> Column:
    """Acknowledgements that a level asks for; may exceed ``total``. Unknown levels ask as ``one`` does."""
    name = F.lower(level)
    return (
        F.when(name == "two", F.lit(2))
        .when(name == "quorum", F.floor(total / 2) + 1)
        .when(name == "all", total)
        .otherwise(F.lit(1))
        .cast("bigint")
    )


def known_level(level: Column) -> Column:
    return F.lower(level).isin("one", "two", "quorum", "all")


def register_bytes(timestamp: Column, value: Column) -> Column:
    """A register as bytes: little-endian 64-bit time, little-endian 32-bit length, value."""
    body = value.cast("binary")
    return F.concat(_little_endian(timestamp.cast("bigint"), 8), _little_endian(F.octet_length(body).cast("bigint"), 4), body)


def _little_endian(number: Column, size: int) -> Column:
    pairs = F.regexp_extract_all(F.lpad(F.hex(number), 16, "0"), F.lit("(..)"), F.lit(1))
    return F.unhex(F.array_join(F.slice(F.reverse(pairs), 1, size), ""))


def register_time(data: Column) -> Column:
    pairs = F.regexp_extract_all(F.hex(F.substring(data, 1, 8)), F.lit("(..)"), F.lit(1))
    return F.conv(F.array_join(F.reverse(pairs), ""), 16, -10).cast("bigint")


def register_value(data: Column) -> Column:
    return F.decode(F.substring(data, 13, 2147483647), "UTF-8")


def bloom_bits(n: Column, p: float) -> Column:
    """Bits for ``n`` keys at false-positive rate ``p``."""
    return F.floor(-n * math.log(p) / math.log(2) ** 2).cast("bigint")


def bloom_hashes(n: Column, p: float) -> Column:
    return F.floor(bloom_bits(n, p) / n * math.log(2)).cast("bigint")


def addresses(text: Column) -> Column:
    """Trimmed, not empty parts of a comma-separated list."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
