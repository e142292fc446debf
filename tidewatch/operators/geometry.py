"""Distances and angles over poses, contacts over structures."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..scratch import Scratch

POSE_CUTOFF, CONTACT_CUTOFF = 3.0, 4.5


def nearest_nitrogen(atoms: Column, point: Column) -> Column:
    """Least distance of atoms whose name begins with N to a point; null if there is none."""
    return F.array_min(F.transform(F.filter(atoms, lambda a: a["atom"].startswith("N")), lambda a: V.distance(a, point)))


def pose_features(poses: DataFrame, point: tuple, normal: tuple | None = None, by: tuple[str, ...] = ("file", "model")) -> DataFrame:
    """Each pose's nitrogen nearest to a point: dist, and with a normal the folded angle theta and s = dist (1 + sin theta).

    poses: one row for each atom.  Poses without a nitrogen have nulls.
    """
    p = V.vec(*point)
    near = F.when(F.col("atom").startswith("N"), F.struct(V.distance(F.struct("x", "y", "z"), p).alias("d"), F.col("x").alias("x"), F.col("y").alias("y"), F.col("z").alias("z")))
    return _measured(poses.groupBy(*by).agg(F.min(near).alias("near")), p, normal)


def model_features(models: DataFrame, point: tuple, normal: tuple | None = None) -> DataFrame:
    """The same for rows that hold a pose each, as an array column atoms, which is dropped; nothing is shuffled."""
    p = V.vec(*point)
    near = F.array_min(F.transform(F.filter("atoms", lambda a: a["atom"].startswith("N")), lambda a: F.struct(V.distance(a, p).alias("d"), a["x"].alias("x"), a["y"].alias("y"), a["z"].alias("z"))))
    return _measured(models.withColumn("near", near), p, normal).drop("atoms")


def _measured(out: DataFrame, p: Column, normal: tuple | None) -> DataFrame:
    out = out.withColumn("dist", F.col("near.d"))
    if normal is not None:
        theta = V.folded_angle(V.sub(F.col("near"), p), V.vec(*normal))
        out = out.withColumn("theta", theta).withColumn("s", F.col("dist") * (1 + F.sin(F.radians(F.col("theta")))))
    return out.drop("near")


def independent_minima(features: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Least s, theta and dist, each over all poses by itself."""
    return features.groupBy(*by).agg(F.min("s").alias("s"), F.min("theta").alias("theta"), F.min("dist").alias("dist"))


def best_distance(features: DataFrame, by: tuple[str, ...] = ("molecule",)) -> DataFrame:
    return features.groupBy(*by).agg(F.min("dist").alias("dist"))


def with_scores(features: DataFrame, scores: DataFrame, by: tuple[str, ...] = ("file",)) -> DataFrame:
    """Poses with the score in the same place; poses or scores without a partner are left out."""
    return features.join(scores, [*by, "model"])


def constrained_best(scored: DataFrame, by: tuple[str, ...], cutoff: float = POSE_CUTOFF) -> DataFrame:
    """n_poses, n_passing (dist strictly below cutoff), best_dist, best_score among passing poses, and the least (score, model, dist)."""
    passing = F.col("dist") < cutoff
    return scored.groupBy(*by).agg(
        F.count("*").alias("n_poses"), F.count_if(passing).alias("n_passing"), F.min("dist").alias("best_dist"), F.min(F.when(passing, F.col("score"))).alias("best_score"),
        F.min(F.when(passing, F.struct("score", "model", "dist"))).alias("best"),
    )


def _finite(df: DataFrame) -> DataFrame:
    """Rows whose x, y and z are numbers."""
    ok = F.lit(True)
    for c in "xyz":
        ok = ok & F.col(c).isNotNull() & (F.abs(F.col(c)) < float("inf"))  # NaN counts as the greatest of all
    return df.where(ok)


class _Cells:
    """Nested cells over a set of points: level 0 is one cube, each level halves its edges, up to DEPTH."""

    DEPTH = 20

    def __init__(self, others: DataFrame, scratch: Scratch):
        found = _finite(others.select(*[F.col(c).cast("double").alias(c) for c in "xyz"]))
        box = found.agg(F.count("*").alias("n"), *[f(c).alias(f"{n}{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in "xyz"]).first()
        self.n = box["n"]
        if not self.n:
            return
        self.low = {c: box[f"lo{c}"] for c in "xyz"}
        self.edge = max(*[box[f"hi{c}"] - box[f"lo{c}"] for c in "xyz"]) / (1 << self.DEPTH) or 1.0
        self.points = scratch.table(found.distinct().select("*", *[self.place(c, F.col(c)).alias(f"i{c}") for c in "xyz"]))

    def place(self, axis: str, c: Column) -> Column:
        """Number of a coordinate's cell at the deepest level; it only has to be the same for equal coordinates."""
        at = F.floor((c - F.lit(self.low[axis])) / F.lit(self.edge))
        return F.greatest(F.least(at, F.lit((1 << self.DEPTH) - 1)), F.lit(-1)).cast("int")

    def at(self, level: int, names: str = "abc") -> list[Column]:
        return [F.shiftright(f"i{c}", self.DEPTH - level).alias(n) for c, n in zip("xyz", names)]

    def nodes(self, level: int, above: int) -> DataFrame:
        """Occupied cells of a level: their number in ``above``, count, bounds, and one of their points."""
        node = self.points.groupBy(*self.at(level)).agg(F.count("*").alias("held"), *[f(c).alias(f"{n}{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in "xyz"], F.min(F.struct("x", "y", "z")).alias("one"))
        return node.select(*[F.shiftright(c, level - above).alias(f"up_{c}") for c in "abc"], "*")


def min_distance(points: DataFrame, others: DataFrame, by: tuple[str, ...], block: int = 64, most: float | None = None) -> DataFrame:
    """Least distance from the points of each group to a set of others; null where there are none (or none within ``most``).

    A descent through nested cells.  First each point is held against one of the others in its own cell, which bounds its group's
    distance from above.  Then all points go down the cells together, two levels a round: a pair of point and cell stays
    only if the cell's bounds are no farther than the least bound its group has, and each cell's own
    point lowers that bound.  A cell of up to ``block`` points ends the descent: its points are compared one by one.
    So pairs are never made of all points and all others, crowded cells are split on, and far points
    see a few large cells only.  Every round is equi-joins on cells and aggregations by group, and its result is written.

    Equal others count once; coordinates that are null, not a number or infinite are left out on both sides.
    Groups may be null, and have a row also without a point.
    """
    scratch = Scratch(points.sparkSession, "cells")
    cells = _Cells(others, scratch)
    # a group is one struct, which is never null itself, so joins keep groups of nulls together
    group = F.struct(*[F.col(c).alias(f"by{i}") for i, c in enumerate(by)]).alias("g")
    named = [F.col("g")[f"by{i}"].alias(c) for i, c in enumerate(by)]
    groups = points.select(group).distinct()
    if not cells.n:
        return groups.select(*named, F.lit(None).cast("double").alias("dist"))
    limit = F.lit(float("inf") if most is None else float(most))
    point = F.struct(*[F.col(f"p{c}").alias(c) for c in "xyz"])
    outside = V.norm(V.vec(*[F.greatest(F.col(f"lo{c}") - F.col(f"p{c}"), F.col(f"p{c}") - F.col(f"hi{c}"), F.lit(0.0)) for c in "xyz"]))
    pair = ["g", "px", "py", "pz", "a", "b", "c"]

    def least(df: DataFrame, to: Column) -> DataFrame:
        return df.groupBy("g").agg(F.min(V.distance(point, to)).alias("bound"))

    start = _finite(points.select(group, *[F.col(c).cast("double").alias(c) for c in "xyz"])).select("g", *[F.col(c).alias(f"p{c}") for c in "xyz"], *[cells.place(c, F.col(c)).alias(f"i{c}") for c in "xyz"])
    level, block = 0, max(1, block)
    open_, found = start.select(*pair[:4], *[F.lit(0).alias(c) for c in "abc"], F.lit(cells.n).alias("held")), []
    seed = min(cells.DEPTH, math.ceil(math.log(cells.n, 8)))
    # written, so that the planner knows its size: a few groups are broadcast, instead of all pairs being dealt out by them
    bounds = scratch.table(least(start.select(*pair[:4], *cells.at(seed)).join(cells.nodes(seed, seed).select("a", "b", "c", "one"), ["a", "b", "c"]), F.col("one")))
    while True:
        if cells.n > block:
            nodes = cells.nodes(level + 2, level)
            # the first round has at most 64 cells
            below = open_.select(*pair[:4], *[F.col(c).alias(f"up_{c}") for c in "abc"]).join(F.broadcast(nodes) if level == 0 else nodes, ["up_a", "up_b", "up_c"]).withColumn("away", outside)
            near = below.join(bounds, "g", "left").withColumn("bound", F.coalesce("bound", limit)).where(F.col("away") <= F.least("bound", limit))
            near = scratch.table(near.select(*pair, "held", "away", F.least("bound", V.distance(point, F.col("one"))).alias("bound")))
            bounds = scratch.table(near.groupBy("g").agg(F.min("bound").alias("bound")))
            open_, level = near.drop("bound").join(bounds, "g").where(F.col("away") <= F.col("bound")).select(*pair, "held"), level + 2
        ends = (F.col("held") <= block) | F.lit(level == cells.DEPTH)
        close = least(open_.where(ends).join(cells.points.select("x", "y", "z", *cells.at(level)), ["a", "b", "c"]), F.struct("x", "y", "z"))
        open_ = open_.where(~ends)
        if cells.n <= block or level == cells.DEPTH or open_.isEmpty():
            found.append(close)
            break
        found.append(scratch.table(close))
        bounds = scratch.table(bounds.unionByName(found[-1]).groupBy("g").agg(F.min("bound").alias("bound")))
    dist = functools.reduce(DataFrame.unionByName, found).groupBy("g").agg(F.min("bound").alias("dist")).where(F.col("dist") <= limit)
    return groups.join(dist, "g", "left").select(*named, "dist")


def rmsd(a: DataFrame, b: DataFrame, on: tuple[str, ...] = ("atom",), by: tuple[str, ...] = ()) -> DataFrame:
    """Root mean square distance of atoms matched by name; n: how many."""
    left = a.select(*by, *on, F.struct("x", "y", "z").alias("p"))
    right = b.select(*by, *on, F.struct("x", "y", "z").alias("q"))
    d = V.distance(F.col("p"), F.col("q"))
    return left.join(right, [*by, *on]).groupBy(*by).agg(F.sqrt(F.avg(d * d)).alias("rmsd"), F.count("*").alias("n"))


def best_pose(features: DataFrame) -> DataFrame:
    """The pose with the least distance; ties by file and model."""
    return features.where("dist is not null").agg(F.min(F.struct("dist", "file", "model")).alias("best")).select("best.*")
