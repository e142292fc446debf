"""Closed-form statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c


def wilson(k: Column | str, n: Column | str, z: float = 1.96) -> Column:
    """struct<lo, hi>: the Wilson score interval of k out of n, within [0, 1]; null for n = 0."""
    k, n = _c(k).cast("double"), _c(n).cast("double")
    center = (k + z * z / 2) / (n + z * z)
    half = z / (n + z * z) * F.sqrt(k * (n - k) / F.nullif(n, F.lit(0.0)) + z * z / 4)
    return F.when(n > 0, F.struct(F.greatest(F.lit(0.0), center - half).alias("lo"), F.least(F.lit(1.0), center + half).alias("hi")))


def wilson_halfwidth(n: Column | str, z: float = 1.96) -> Column:
    """Half of the interval's width where it is widest, at n // 2 of n."""
    w = wilson(F.floor(_c(n) / 2), _c(n), z)
    return (w["hi"] - w["lo"]) / 2


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))
