"""Algebra of struct<x, y, z> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vec(x, y, z) -> Column:
    c = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.struct(c(x).alias("x"), c(y).alias("y"), c(z).alias("z"))


def sub(a: Column, b: Column) -> Column:
    return vec(a["x"] - b["x"], a["y"] - b["y"], a["z"] - b["z"])


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def cross(a: Column, b: Column) -> Column:
    return vec(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    n = F.nullif(norm(a), F.lit(0.0))
    return vec(a["x"] / n, a["y"] / n, a["z"] / n)


def distance(a: Column, b: Column) -> Column:
    return norm(sub(a, b))


def folded_angle(a: Column, b: Column) -> Column:
    """Degrees between two directions regardless of sense, 0 to 90; null if one is zero."""
    cos = F.abs(dot(a, b)) / F.nullif(norm(a) * norm(b), F.lit(0.0))
    return F.degrees(F.acos(F.when(cos > 1.0, 1.0).otherwise(cos)))  # least() would pass over a null
