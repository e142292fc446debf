"""Replay of detection over history, deposit lags, prevalence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions import temporal as T
from ..functions import text as X
from . import emergence as E

MEDIAN_DAYS, WITHIN_DAYS, WITHIN_SHARE = 365, 365, 0.60
# fixed values: states of a record's call
RESOLVED = ("sra-recaller:called", "sra-recaller:wild-type")


def deposit_lags(records: DataFrame) -> DataFrame:
    """records with lag_days from collection to visibility; null where either date is unusable, negative ones are kept."""
    return records.withColumn("lag_days", F.datediff(T.parse_day("target_creation_date"), T.parse_day("collection_date")))


def lag_summary(lags: DataFrame, lag: str = "lag_days", within: int = WITHIN_DAYS) -> DataFrame:
    """One row: n, undatable, exact interpolated quartiles and 90th percentile, extremes, share within a number of days, negatives."""
    x = F.col(lag).cast("double")
    # one exact percentile over a histogram of distinct lags: state grows with distinct days, not rows
    by = lags.groupBy(lag).agg(F.count("*").alias("_n"))
    q = lambda p: F.percentile(x, F.lit(p), F.col("_n"))
    out = by.agg(
        F.coalesce(F.sum(F.when(x.isNotNull(), F.col("_n"))), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(x.isNull(), F.col("_n"))), F.lit(0)).alias("undatable"),
        q(0.25).alias("p25"), q(0.5).alias("median"), q(0.75).alias("p75"), q(0.9).alias("p90"), F.min(lag).alias("min"), F.max(lag).alias("max"),
        F.coalesce(F.sum(F.when(x <= within, F.col("_n"))), F.lit(0)).alias("within"), F.coalesce(F.sum(F.when(x < 0, F.col("_n"))), F.lit(0)).alias("negative"),
    )
    return out.withColumn("within_share", stats.ratio(F.col("within"), F.col("n"))).withColumn("arrives_in_time", arrival_verdict("n", "median", "within_share"))


def arrival_verdict(n: str, median: str, share: str) -> Column:
    """True, false, or null where there is no data."""
    return F.when(F.col(n) > 0, (F.col(median) <= MEDIAN_DAYS) & (F.col(share) >= WITHIN_SHARE))


def creation_range(records: DataFrame) -> DataFrame:
    day = T.parse_day("target_creation_date")
    return records.agg(F.min(day).alias("first"), F.max(day).alias("last"))


def steps(records: DataFrame) -> DataFrame:
    """as_of dates: the first of each month from the first to the last creation."""
    return creation_range(records).select(F.explode(T.month_steps("first", "last")).alias("as_of"))


def counts(records: DataFrame, weight: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a replay needs of records: (created, n), (day, called) and (token, day, n, datable, archival).

    A record counts ``weight`` times (once by default), so changes of a release are counts as well, with -1 for
    rows that are gone.  As long as days and tokens, not as records.
    """
    datable, archival = E.lag_years()
    day = F.try_to_date(T.iso_day("target_creation_date"), "yyyy-MM-dd")
    w = F.lit(1).cast("long") if weight is None else weight.cast("long")
    rows = records.select(w.alias("w"), T.parse_day("target_creation_date").alias("created"), day.alias("day"), X.is_called("erg11_call").alias("called"), X.tokens("erg11_call").alias("tokens"), datable.alias("datable"), archival.alias("archival"))
    known = rows.where("day is not null")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("w"))), F.lit(0))
    return (
        rows.where("created is not null").groupBy("created").agg(F.sum("w").alias("n")),
        known.where("called").groupBy("day").agg(F.sum("w").alias("called")),
        known.withColumn("token", F.explode("tokens")).groupBy("token", "day").agg(F.sum("w").alias("n"), total(F.col("datable")).alias("datable"), total(F.col("datable") & F.col("archival")).alias("archival")),
    )


def replay_signals(records: DataFrame, as_ofs: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """(coverage, signals) of every as_of date at once; cost is linear in records, not records times steps.  Options as for replay_counts()."""
    _, by_day, by_token = counts(records)
    return replay_counts(by_day, by_token, as_ofs, **options)


def replay_counts(by_day: DataFrame, by_token: DataFrame, as_ofs: DataFrame, window_days: int = E.WINDOW_DAYS, min_count: int = E.MIN_COUNT, min_delta: float = E.MIN_DELTA, backlog_fraction: float = E.BACKLOG_FRACTION) -> tuple[DataFrame, DataFrame]:
    """replay_signals() from counts().

    Counts up to a date are prefix sums.  A day's count adds once to the first step at
    or after it, and once to each of the few steps whose recent window
    holds it; a running sum over steps gives every baseline.  So any later part of the steps can be had by itself.
    """
    # steps are few (months); their sorted array is one literal-sized row
    line = as_ofs.agg(F.array_sort(F.collect_set("as_of")).alias("line"))

    def spread(df: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
        placed = df.crossJoin(F.broadcast(line))  # one row
        base = placed.withColumn("as_of", F.array_min(F.filter("line", lambda s: s >= F.col("day")))).where("as_of is not null")
        near = placed.withColumn("as_of", F.explode(F.filter("line", lambda s: (s < F.col("day")) & (F.date_add(s, window_days) >= F.col("day")))))
        first = measures[0]
        both = base.select(*keys, "as_of", F.col(first).alias("base"), *[F.lit(0).cast("long").alias(m) for m in measures]).unionByName(near.select(*keys, "as_of", F.lit(0).cast("long").alias("base"), *measures))
        summed = both.groupBy(*keys, "as_of").agg(F.sum("base").alias("base"), *[F.sum(m).alias(m) for m in measures])
        w = Window.partitionBy(*keys).orderBy("as_of").rowsBetween(Window.unboundedPreceding, 0)  # at most one row for each step
        return summed.withColumn("base", F.sum("base").over(w))

    cov = spread(by_day.withColumn("one", F.lit(1)), ["one"], ["called"]).select("as_of", F.col("base").alias("baseline_called"), F.col("called").alias("recent_called"))
    # a step that no record touches keeps the baseline of the step before
    w = Window.orderBy("as_of").rowsBetween(Window.unboundedPreceding, 0)
    cov = as_ofs.select("as_of").distinct().join(cov, "as_of", "left").select("as_of", F.coalesce(F.last("baseline_called", True).over(w), F.lit(0)).alias("baseline_called"), F.coalesce("recent_called", F.lit(0)).alias("recent_called"))
    tok = spread(by_token, ["token"], ["n", "datable", "archival"]).where(F.col("n") >= min_count)
    tok = tok.select("as_of", "token", F.col("base").alias("baseline_count"), F.col("n").alias("recent_count"), "datable", "archival").join(F.broadcast(cov), "as_of")
    return cov, E._judged(tok, min_delta, backlog_fraction)


def walk_forward(records: DataFrame, as_ofs: DataFrame | None = None, target: str | None = None, **options) -> DataFrame:
    """One row for each as_of: callable (something recent is called), n_signals, hit (the target, or any token, is flagged)."""
    return walked(*replay_signals(records, steps(records) if as_ofs is None else as_ofs, **options), target)


def walked(cov: DataFrame, signals: DataFrame, target: str | None = None) -> DataFrame:
    """Coverage and signals of steps as walk_forward() rows."""
    hit = (F.col("token") == target) if target else F.lit(True)
    found = signals.groupBy("as_of").agg(F.count("*").alias("n_signals"), F.bool_or(hit).alias("hit"))
    return cov.join(found, "as_of", "left").select("as_of", "baseline_called", "recent_called", (F.col("recent_called") > 0).alias("callable"), F.coalesce("n_signals", F.lit(0)).alias("n_signals"), F.coalesce("hit", F.lit(False)).alias("hit"))


def first_flag(walk: DataFrame, reference: str | None = None) -> DataFrame:
    """One row: steps, callable and flagged steps, the first flag, any_callable, and days from the flag to a reference date."""
    out = walk.agg(F.count("*").alias("steps"), F.count_if("callable").alias("callable_steps"), F.count_if("hit").alias("flagged_steps"), F.min(F.when(F.col("hit"), F.col("as_of"))).alias("first_flag"), F.coalesce(F.bool_or("callable"), F.lit(False)).alias("any_callable"))
    return out.withColumn("lead_days", T.lead_time_days("first_flag", F.to_date(F.lit(reference))) if reference else F.lit(None).cast("int"))


def resolution(source: str | Column) -> Column:
    """resolved, partial, failed or pending, by a record's source text."""
    s = X.ws_strip(F.coalesce(X._c(source), F.lit("")))
    return F.when(s.isin(*RESOLVED), "resolved").when(s.startswith("sra-recaller:partial"), "partial").when(s.startswith("sra-recaller:failed") | s.startswith("sra-recaller:refused"), "failed").otherwise("pending")


def prevalence(records: DataFrame, panel: dict, by: tuple[str, ...] = ()) -> DataFrame:
    """One row (or one for each value of ``by``, in one aggregation): totals, resolved and positive records, event frequency with its Wilson interval, and what is excluded."""
    hits = F.filter(X.tokens("erg11_call"), lambda t: X.is_panel_token(t, panel))
    rows = records.select(*by, resolution("resistance_source").alias("state"), F.size(hits).alias("hits"), X.is_called("erg11_call").alias("called"))
    ok = F.col("state") == "resolved"
    out = rows.groupBy(*by).agg(
        F.count("*").alias("n_total"), F.count_if(ok).alias("n_resolved"), F.count_if(ok & (F.col("hits") > 0)).alias("n_positive"),
        F.count_if(ok & (F.col("hits") == 0) & F.col("called")).alias("n_called_nonpanel"), *[F.count_if(F.col("state") == s).alias(f"excluded_{s}") for s in ("partial", "failed", "pending")],
    )
    ci = stats.wilson("n_positive", "n_resolved")
    return out.withColumn("event_frequency", stats.ratio(F.col("n_positive"), F.col("n_resolved"))).withColumn("ci_lo", ci["lo"]).withColumn("ci_hi", ci["hi"])


def panel_tokens(records: DataFrame, panel: dict) -> DataFrame:
    """(token, n) of panel tokens over resolved records, to be ordered by residue and token."""
    rows = records.where(resolution("resistance_source") == "resolved").select(F.explode(X.tokens("erg11_call")).alias("token"))
    return rows.where(X.is_panel_token("token", panel)).groupBy("token").agg(F.count("*").alias("n")).withColumn("residue", X.residue_number("token"))
