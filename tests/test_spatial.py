"""Nearest distances by nested cells against all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import geometry as G


def brute(points, others):
    ok = lambda p: all(c is not None and c == c and abs(c) != math.inf for c in p)
    out = {}
    for g, *p in points:
        out.setdefault(g, None)
        for o in filter(ok, others if ok(p) else []):
            d = math.sqrt(sum((a - b) ** 2 for a, b in zip(p, o)))
            out[g] = d if out[g] is None else min(out[g], d)
    return out


@pytest.fixture(scope="module")
def cloud(spark):
    """A crowded cell, one place many times, far points, and coordinates that are none."""
    rnd = random.Random(1)
    others = [tuple(rnd.uniform(-10, 10) for _ in range(3)) for _ in range(200)] + [(rnd.gauss(0, 1e-4), rnd.gauss(0, 1e-4), 5.0) for _ in range(300)]
    others += [(1.0, 1.0, 1.0)] * 400 + [(None, 1.0, 1.0), (math.nan, 0.0, 0.0), (math.inf, 0.0, 0.0)]
    points = [(rnd.randrange(40) if rnd.random() < 0.95 else None, *[rnd.uniform(-30, 30) for _ in range(3)]) for _ in range(300)]
    points += [(100 + i, rnd.gauss(0, 1e-3), rnd.gauss(0, 1e-3), 5.0) for i in range(100)] + [(999, None, 1.0, 2.0), (1000, 1e9, 1e9, -1e9), (1001, 1.0, 1.0, 1.0)]
    return points, others, spark.createDataFrame(points, "g int, x double, y double, z double"), spark.createDataFrame(others, "x double, y double, z double")


@pytest.mark.parametrize("block", [2, 10_000])
def test_nearest_equals_all_pairs(cloud, block):
    points, others, p, o = cloud
    want = brute(points, others)
    got = {r["g"]: r["dist"] for r in G.min_distance(p, o, ("g",), block=block).collect()}
    assert not [(g, got.get(g), d) for g, d in want.items() if g not in got or (d is None) != (got[g] is None) or d is not None and abs(d - got[g]) > 1e-12 * d] and len(got) == len(want)
    assert got[None] is not None and got[999] is None and got[1001] == 0


def test_nearest_within(cloud):
    points, others, p, o = cloud
    got = {r["g"]: r["dist"] for r in G.min_distance(p, o, ("g",), most=2.0).collect()}
    want = {g: d if d is not None and d <= 2.0 else None for g, d in brute(points, others).items()}
    assert got.keys() == want.keys() and all((d is None) == (got[g] is None) and (d is None or abs(d - got[g]) <= 1e-12 * d) for g, d in want.items())


def test_nearest_of_nothing(cloud):
    points, _, p, o = cloud
    assert {r["dist"] for r in G.min_distance(p, o.limit(0), ("g",)).collect()} == {None}
    assert G.min_distance(p.limit(0), o, ("g",)).count() == 0


def test_few_pairs_meet(spark):
    """2,000 points in a crowd of 4,000 others: pairs that are written stay far below all of them."""
    rnd = random.Random(3)
    cloud = lambda n: spark.createDataFrame([(i, *[rnd.gauss(0, 1) for _ in range(3)]) for i in range(n)], "g int, x double, y double, z double")
    rows, table = [], G.Scratch.table

    def counted(self, df):
        out = table(self, df)
        rows.append(out.count() if "away" in df.columns else 0)
        return out

    G.Scratch.table = counted
    try:
        assert G.min_distance(cloud(2000), cloud(4000), ("g",)).count() == 2000
    finally:
        G.Scratch.table = table
    assert 0 < sum(rows) < 2000 * 4000 / 50


def test_few_groups_are_not_keys_of_pairs(spark):
    """Three groups with many points: pairs of points and cells are not dealt out by group, which would be a task for each."""
    from tidewatch.scratch import Scratch

    at = [F.sin(F.col("id") * k).alias(n) for k, n in ((1.3, "x"), (2.7, "y"), (3.1, "z"))]
    points, others = spark.range(3000).select((F.col("id") % 3).alias("label"), *at), spark.range(5000, 6500).select(*at)
    plans, table = [], Scratch.table
    Scratch.table = lambda self, df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or table(self, df)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "8k")
    try:
        assert G.min_distance(points, others, ("label",)).count() == 3
    finally:
        Scratch.table = table
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert any("away" in p for p in plans) and not any("SortMergeJoin [g#" in p for p in plans)
