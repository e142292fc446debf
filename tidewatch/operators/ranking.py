"""Rankings with what can't be ranked last, and their early-recognition metrics.

Rows are numbered in two distributed passes: a range-partitioned sort whose result is
written, then offsets of its partitions; no task ever sees all rows.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch, fresh

FRACTIONS, ALPHA = (0.01, 0.05, 0.10), 20.0
MIN_AUC, MIN_EF1 = 0.70, 5.0


def numbered(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """df with out = 1, 2, ... in an order that decides between all rows."""
    at, part, before = fresh([*df.columns, out], "at", "part", "before")
    placed = Scratch(df.sparkSession, "rank").table(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()))
    placed = placed.withColumn(part, F.shiftright(at, 33))
    offsets, total = [], 0
    for r in placed.groupBy(part).count().orderBy(part).collect():  # one row for each partition
        offsets.append((r[part], total))
        total += r["count"]
    offsets = df.sparkSession.createDataFrame(offsets, f"{part} long, {before} long")
    number = (F.col(before) + F.col(at).bitwiseAND((1 << 33) - 1) + 1).cast("int" if total < 1 << 31 else "long")
    return placed.join(F.broadcast(offsets), part).withColumn(out, number).select(*df.columns, out)


def rank_rows(df: DataFrame, key: str = "key", name: str = "name", out: str = "rank") -> DataFrame:
    """df with out = 1, 2, ... by key ascending, nulls last, ties by name."""
    return numbered(df, [F.col(key).asc_nulls_last(), F.col(name).asc()], out)


def rank_lists(df: DataFrame, by: tuple[str, ...], key: str = "key", name: str = "name", out: str = "rank") -> DataFrame:
    """rank_rows() of many lists at once, a list for each value of ``by``: one range sort by (by, key, name).

    A list's first place in the common order is taken from the places of its rows, so a list may be of any size, and
    lists need not be of like size.
    """
    at, least = fresh([*df.columns, out], "at", "least")
    placed = numbered(df, [*[F.col(c).asc() for c in by], F.col(key).asc_nulls_last(), F.col(name).asc()], at)
    same = [F.col(c).alias(n) for c, n in zip(by, fresh(placed.columns, *[f"of_{c}" for c in by]))]
    first = placed.groupBy(*same).agg(F.min(at).alias(least))  # one row for each list
    on = functools.reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(by, first.columns)])
    return placed.join(first, on).withColumn(out, F.col(at) - F.col(least) + 1).select(*df.columns, out)


def metrics(ranked: DataFrame, rank: str = "rank", active: str = "is_active", by: tuple[str, ...] = ()) -> DataFrame:
    """One row (for each list, by ``by``): n, n_active, auc, ef1, ef5, ef10, bedroc of ranks 1..n, best first; null where all or no rows are active.

    Everything follows from the ranks of the actives: the AUC from their sum,
    enrichment from how many lie in the top, BEDROC from a sum of exponentials.
    """
    rk, a = F.col(rank).cast("double"), F.coalesce(F.col(active), F.lit(False))
    # ranks 1..n have no gap, so their number is known before any other term
    n_row = ranked.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(a).alias("n_active"))
    acts = ranked.where(a).select(*by, rk.alias("rk"))
    acts = acts.join(n_row, [*by]) if by else acts.crossJoin(F.broadcast(n_row))  # one row
    n = F.col("n").cast("double")
    top = lambda f: F.count_if(F.col("rk") <= F.ceil(n * F.lit(f).cast("double")))
    sums = acts.groupBy(*by).agg(F.sum("rk").alias("rank_sum"), *[top(f).alias(f"top{round(100 * f)}") for f in FRACTIONS], F.sum(F.exp(-ALPHA * F.col("rk") / n)).alias("exp_sum"))
    m = F.col("n_active").cast("double")
    ok = (F.col("n_active") > 0) & (F.col("n_active") < F.col("n"))
    # decoys above each active: rank - 1 - actives above; summed over actives
    auc = 1 - (F.col("rank_sum") - m * (m + 1) / 2) / F.nullif(m * (n - m), F.lit(0.0))
    ef = lambda f: F.col(f"top{round(100 * f)}") * n / F.nullif(F.ceil(n * F.lit(f).cast("double")) * m, F.lit(0))
    share, e = m / n, F.exp(F.lit(-ALPHA))
    rie = F.col("exp_sum") / m / ((1 - e) / (F.exp(ALPHA / n) - 1) / n)
    low = (1 - F.exp(ALPHA * share)) / (share * (1 - F.exp(F.lit(ALPHA))))
    high = (1 - F.exp(-ALPHA * share)) / (share * (1 - e))
    out = n_row.join(sums, [*by], "left") if by else n_row.crossJoin(sums)
    return out.select(*by, "n", "n_active", F.when(ok, auc).alias("auc"), *[F.when(ok, ef(f)).alias(f"ef{round(100 * f)}") for f in FRACTIONS], F.when(ok, (rie - low) / (high - low)).alias("bedroc"))


def report(df: DataFrame, key: str = "key", name: str = "name", active: str = "is_active", missing: str = "last", top: int = 15) -> tuple[DataFrame, DataFrame]:
    """(metrics with counts of rankable rows, top active rows).  missing: last keeps unrankable rows at the end, drop leaves them out."""
    rows = df.where(F.col(key).isNotNull()) if missing == "drop" else df
    ranked = rank_rows(rows, key, name)
    counts = df.agg(F.count_if(F.col(key).isNotNull()).alias("rankable"), F.count_if(F.col(key).isNull()).alias("unrankable"))
    return metrics(ranked, active=active).crossJoin(counts), ranked.where((F.col("rank") <= top) & F.col(active)).orderBy("rank")


def combined_key(df: DataFrame, first: str, second: str, name: str = "name", out: str = "combined") -> DataFrame:
    """df with the sum of a row's places (from 0) in two orders over rows that have the key, ties by name; null unless it has both."""
    row, one, two = fresh([*df.columns, out], "row", "one", "two")
    base = Scratch(df.sparkSession, "combined").table(df.withColumn(row, F.monotonically_increasing_id()))
    place = lambda k, n: numbered(base.where(F.col(k).isNotNull()).select(row, k, name), [F.col(k), F.col(name)], n).select(row, n)
    both = base.join(place(first, one), row, "left").join(place(second, two), row, "left")
    return both.withColumn(out, F.col(one) + F.col(two) - 2).select(*df.columns, out)


def gate(metrics_row: Column | None = None) -> Column:
    """Whether a metrics row passes the frozen bar."""
    return F.coalesce((F.col("auc") >= MIN_AUC) & (F.col("ef1") >= MIN_EF1), F.lit(False))


def loose_gate(metrics_of_modes: DataFrame) -> DataFrame:
    """The first bar: the best AUC and the best enrichment, each over modes by itself."""
    return metrics_of_modes.agg(F.max("auc").alias("auc"), F.max("ef1").alias("ef1")).withColumn("passed", gate())


def missing_actives(molecules: DataFrame, actives: DataFrame, name: str = "name") -> DataFrame:
    return actives.select(name).distinct().join(molecules.select(name), name, "left_anti")


def _uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) that depends on its parts only: 52 bits of their text's digest."""
    text = F.concat_ws(":", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def _above(ranked: DataFrame, rank: str, active: str, name: str) -> DataFrame:
    """(name, above): for each active the share of the others that stand before it; their mean is 1 - AUC."""
    a = F.coalesce(F.col(active), F.lit(False))
    total = ranked.agg((F.count("*") - F.count_if(a)).alias("_others"))
    acts = numbered(ranked.where(a).select(F.col(name).alias("name"), F.col(rank).cast("long").alias("_rank")), [F.col("_rank").asc(), F.col("name").asc()], "_at")
    return acts.crossJoin(F.broadcast(total)).select("name", ((F.col("_rank") - F.col("_at")) / F.nullif(F.col("_others"), F.lit(0))).alias("above"))  # one row


#: Cumulative probabilities of a Poisson variable of mean 1, up to where they reach 1 in double precision.
_POISSON = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(17)]


def bootstrap_auc(ranked: DataFrame, replicates: int = 2000, seed: int = 0, level: float = 0.95, rank: str = "rank", active: str = "is_active", name: str = "name") -> DataFrame:
    """One row: replicates, auc_mean, auc_lo, auc_hi, an interval of the AUC when the actives are drawn anew.

    In a replicate each active counts as often as a Poisson variable of mean 1 says, which follows from seed,
    replicate and name alone.  No replicate exists as a table: what is shuffled is one sum for each of them and task.
    Replicates without an active are left out; without actives or others all is null.
    """
    u = _uniform(F.lit(seed), "b", "name")
    weight = functools.reduce(Column.__add__, [(u >= F.lit(c)).cast("int") for c in _POISSON])
    drawn = _above(ranked, rank, active, name).withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("w", weight)
    per = drawn.groupBy("b").agg((1 - F.sum(F.col("w") * F.col("above")) / F.nullif(F.sum("w"), F.lit(0))).alias("auc"))
    tail = (1 - level) / 2
    return per.agg(F.count("auc").alias("replicates"), F.avg("auc").alias("auc_mean"), F.percentile("auc", F.lit(tail)).alias("auc_lo"), F.percentile("auc", F.lit(1 - tail)).alias("auc_hi"))


def permutation_test(ranked: DataFrame, replicates: int = 20_000, seed: int = 0, rank: str = "rank", active: str = "is_active") -> DataFrame:
    """One row: n, n_active, auc, replicates, p_value, the share of random places for the actives that are at least as good.

    A replicate draws as many different ranks as there are actives: the j-th is at random among the first n - m + j, or, where that
    is taken, n - m + j itself.  It is one row that becomes one sum, so neither rows nor replicates are multiplied; the draws of a replicate,
    as many as actives, are all it holds.  p_value counts the given ranking as one more draw, so it is never 0.
    """
    row = metrics(ranked, rank, active).select("n", "n_active", "auc").first()
    n, m, auc = row["n"], row["n_active"], row["auc"]
    spark = ranked.sparkSession
    if auc is None:
        return spark.createDataFrame([(n, m, None, 0, None)], "n long, n_active long, auc double, replicates int, p_value double")

    def draw(taken: Column, j: Column) -> Column:
        to = F.lit(n - m) + j
        at = F.least((F.floor(_uniform(F.lit(seed), F.col("id"), j) * to) + 1).cast("long"), to)
        return F.concat(taken, F.array(F.when(F.array_contains(taken, at), to).otherwise(at)))

    ranks = F.aggregate(F.sequence(F.lit(1).cast("long"), F.lit(m).cast("long")), F.array().cast("array<long>"), draw)
    total = spark.range(1, replicates + 1).select(F.aggregate(ranks, F.lit(0).cast("long"), lambda a, r: a + r).alias("total"))
    # a better AUC is a smaller sum of ranks
    given = round((1 - auc) * m * (n - m)) + m * (m + 1) // 2
    out = total.agg(F.count("*").cast("int").alias("replicates"), ((F.count_if(F.col("total") <= given) + 1) / (F.count("*") + 1)).alias("p_value"))
    return out.select(F.lit(n).cast("long").alias("n"), F.lit(m).cast("long").alias("n_active"), F.lit(auc).alias("auc"), "replicates", "p_value")


def replicate_stats(df: DataFrame, molecule: str, value: str) -> DataFrame:
    """Over replicates: n, min, spread (0 for up to one value), exact median; null values are skipped."""
    return df.groupBy(molecule).agg(F.count(value).alias("n"), F.min(value).alias("best"), F.coalesce(F.max(value) - F.min(value), F.lit(0.0)).alias("spread"), F.median(value).alias("median"))
