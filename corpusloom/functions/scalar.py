"""Scalar and vector column functions, all in built-in expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import UnknownMethodError

#: Two or more letters, digits or underscores.
TOKEN = r"[\p{L}\p{N}_]{2,}"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def portable_hash(key: Column, seed: int = 0) -> Column:
    """32 bits of the MD5 of ``key-seed``: the same number in any engine."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f"-{seed}")).cast("binary")), 1, 8), 16, 10).cast("long")


def portable_hash_sql(key: str, seed: int = 0) -> str:
    return f"CAST(('0x' || substr(md5(CAST({key} AS VARCHAR) || '-{seed}'), 1, 8)) AS BIGINT)"


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x > 0: recurrence up to 8 and more, then Stirling's series."""
    x = x.cast("double")
    shift = F.greatest(F.lit(0.0), F.ceil(8 - x).cast("double"))
    product = sum((F.when(shift > i, F.log(x + i)).otherwise(0.0) for i in range(8)), F.lit(0.0))
    z = x + shift
    series = 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * F.pow(z, F.lit(5.0))) - 1 / (1680 * F.pow(z, F.lit(7.0))) + 1 / (1188 * F.pow(z, F.lit(9.0))) - 691 / (360360 * F.pow(z, F.lit(11.0)))
    return (z - 0.5) * F.log(z) - z + F.lit(0.5 * math.log(2 * math.pi)) + series - product


def log_factorial(x: Column) -> Column:
    return log_gamma(x.cast("double") + 1)


def bin_distance(a: Column, b: Column) -> Column:
    """Chi-square distance of two vectors, bin by bin; bins empty in both count 0."""
    parts = F.zip_with(a, b, lambda x, y: F.coalesce(F.try_divide((x - y) * (x - y), 2 * (x + y)), F.lit(0.0)))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def match_distance(a: Column, b: Column) -> Column:
    """L1 distance of the running sums: earth mover's distance on a line."""
    start = F.struct(F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))
    step = lambda s, d: F.struct((s["run"] + d).alias("run"), (s["sum"] + F.abs(s["run"] + d)).alias("sum"))
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y).cast("double")), start, step)["sum"]


def distance(name: str, a: Column, b: Column) -> Column:
    if name == "bin":
        return bin_distance(a, b)
    if name == "match":
        return match_distance(a, b)
    raise UnknownMethodError(f"no distance named {name!r}")


def simplex(key: Column, parts: int, seed: int = 0) -> Column:
    """An array of ``parts`` shares that sum to 1, uniform, drawn from the key's hashes."""
    if parts == 1:
        return F.array(F.lit(1.0))
    cuts = F.array_sort(F.array(F.lit(0.0), F.lit(1.0), *[portable_hash(key, seed * 1000 + i) / F.lit(4294967296.0) for i in range(1, parts)]))
    return F.transform(F.sequence(F.lit(1), F.lit(parts)), lambda i: F.element_at(cuts, i + 1) - F.element_at(cuts, i))
