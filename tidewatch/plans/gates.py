"""Ranking gates and screens over folders of pose files."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import geometry as G
from ..operators import ranking as R
from ..scratch import Scratch
from ..sources import structures as S


def screen(spark: SparkSession, folder: str, receptor: str, axial: bool = False, parts: Callable[[Column], tuple[Column, Column]] = S.file_parts) -> DataFrame:
    """Poses of all files: file, molecule, seed, model, number, dist, score (null without one), and theta and s if axial.

    Files are read once, in splits; each model becomes one row of measures in the task that reads it, and only those
    are kept.  model is a pose's place in its file, number the one written there; the score is the one in the same place.
    parts: molecule and seed of a file's path.
    """
    rec = S.lines(spark, receptor)
    found = S.models(spark, folder).withColumn("atoms", S.model_atoms(F.col("text"))).drop("text")
    rows = S.placed(Scratch(spark, "screen").table(G.model_features(found, S.iron(rec), S.plane_normal(rec) if axial else None)))
    molecule, seed = parts(F.col("file"))
    poses = rows.where("closed").drop("split", "seq", "closed", "scores", "scored").join(S.placed_scores(rows), ["file", "model"], "left")
    return poses.withColumn("molecule", molecule).withColumn("seed", seed)


def rank_screen(poses: DataFrame) -> DataFrame:
    """Molecules by nearest distance, those without a pose last: rank, name, dist, score (the first in file), n_poses."""
    best = poses.groupBy(F.col("molecule").alias("name")).agg(F.min("dist").alias("dist"), F.min_by("score", F.struct("file", "model")).alias("score"), F.count("*").alias("n_poses"))
    return R.rank_rows(best, "dist")


def molecule_keys(poses: DataFrame, measure: str = "dist", how: str = "min") -> DataFrame:
    """(name, key): the least measure of each replicate, then over replicates its min or its exact median."""
    per = poses.groupBy("molecule", "seed").agg(F.min(measure).alias("v"))
    return per.groupBy(F.col("molecule").alias("name")).agg((F.median("v") if how == "median" else F.min("v")).alias("key"))


def gate(keys: DataFrame, actives: DataFrame, missing: str = "last") -> DataFrame:
    """One row: metrics, counts, missing actives, passed."""
    return gates(keys.withColumn("mode", F.lit("")), actives, ("mode",), missing).drop("mode")


def gates(lists: DataFrame, actives: DataFrame, by: tuple[str, ...], missing: str = "last") -> DataFrame:
    """gate() for many lists (by, name, key; a name once in each list): metrics, counts, missing actives, passed; one row for each list, from one sort of all of them."""
    named = actives.select("name").distinct().withColumn("is_active", F.lit(True))
    rows = lists.join(named, "name", "left").withColumn("is_active", F.coalesce("is_active", F.lit(False)))
    has = F.col("key").isNotNull()
    counts = rows.groupBy(*by).agg(F.count_if(has).alias("rankable"), F.count_if(~has).alias("unrankable"), F.count_if("is_active").alias("present"))
    m = R.metrics(R.rank_lists(rows.where(has) if missing == "drop" else rows, by), by=by).join(counts, [*by])
    return m.crossJoin(F.broadcast(named.agg(F.count("*").alias("known")))).withColumn("missing_actives", F.col("known") - F.col("present")).drop("known", "present").withColumn("passed", R.gate())


def gate_modes(poses: DataFrame, actives: DataFrame, seeds: bool = True) -> DataFrame:
    """The gate for each mode (mode, seed): distance, score, their combined rank, over replicates the least and the median distance, and with an
    axial measure its median; with seeds also the distance in each replicate by itself (mode seed).

    Poses are read once, for one row for each molecule and replicate; everything else follows from those.
    """
    measures = [c for c in ("dist", "s") if c in poses.columns]
    per = poses.groupBy(F.col("molecule").alias("name"), "seed").agg(*[F.min(c).alias(c) for c in measures], F.min(F.struct("file", "model", "score")).alias("first"))
    per = Scratch(poses.sparkSession, "gates").table(per)
    whole = per.groupBy("name").agg(F.min("dist").alias("dist"), F.min("first").getField("score").alias("score"), *[F.median(c).alias(f"median_{c}") for c in measures])
    modes = {"distance": "dist", "score": "score", "min": "dist", "median": "median_dist"} | ({"axial": "median_s"} if "s" in measures else {})
    of = lambda df, mode, key, seed=None: df.select(F.lit(mode).alias("mode"), F.lit(seed).cast("int").alias("seed") if seed is None else seed, "name", F.col(key).cast("double").alias("key"))
    lists = [of(whole, mode, key) for mode, key in modes.items()] + ([of(per, "seed", "dist", F.col("seed").cast("int").alias("seed"))] if seeds else [])
    lists.append(of(R.combined_key(whole, "dist", "score"), "combined", "combined"))
    return gates(functools.reduce(DataFrame.unionByName, lists).withColumn("seed", F.coalesce("seed", F.lit(-1))), actives, ("mode", "seed")).withColumn("seed", F.nullif("seed", F.lit(-1)))


def all_modes(poses: DataFrame, actives: DataFrame) -> DataFrame:
    """gate_modes() without the replicates by themselves."""
    return gate_modes(poses, actives, seeds=False).drop("seed")
