"""Tokens that newly appear or rise between a baseline and a recent window.

Shares are taken over called records only: an uncalled record is no negative.
Every count is a conditional aggregate with map-side combine, so no token's
carriers ever meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..functions import temporal as T
from ..functions import text as X
from .ranking import numbered

WINDOW_DAYS, MIN_COUNT, MIN_DELTA, BACKLOG_FRACTION, ARCHIVAL_YEARS = 180, 3, 0.05, 0.5, 2


def bucketed(records: DataFrame, as_of: str, window_days: int = WINDOW_DAYS) -> DataFrame:
    return records.withColumn("bucket", T.creation_bucket("target_creation_date", as_of, window_days)).withColumn("called", X.is_called("erg11_call"))


def coverage(records: DataFrame, as_of: str, window_days: int = WINDOW_DAYS) -> DataFrame:
    """One row: totals and called records of baseline and recent window, and undated records."""
    b = F.col("bucket")
    return bucketed(records, as_of, window_days).agg(
        F.count_if(b == "baseline").alias("baseline_total"), F.count_if((b == "baseline") & F.col("called")).alias("baseline_called"),
        F.count_if(b == "recent").alias("recent_total"), F.count_if((b == "recent") & F.col("called")).alias("recent_called"), F.count_if(b == "undated").alias("undated"),
    )


def exploded(records: DataFrame) -> DataFrame:
    """A row for each record and distinct token."""
    return records.withColumn("token", F.explode(X.tokens("erg11_call")))


def lag_years() -> tuple:
    """(datable, archival) conditions of a record: both years known, and visible long after collection."""
    collected, visible = T.year_of("collection_date"), T.year_of("target_creation_date")
    datable = collected.isNotNull() & visible.isNotNull()
    return datable, F.coalesce(visible - collected >= ARCHIVAL_YEARS, F.lit(False))


def detect(records: DataFrame, as_of: str, window_days: int = WINDOW_DAYS, min_count: int = MIN_COUNT, min_delta: float = MIN_DELTA, backlog_fraction: float = BACKLOG_FRACTION, ranked: bool = True) -> DataFrame:
    """Signals, one row for each flagged token, with their order in ``rank`` unless ranked is false.

    Flagged: at least min_count recent carriers, and unseen in the baseline
    (first_appearance) or risen by min_delta in share (rising).  possible_backlog:
    at least backlog_fraction of the recent carriers with both years known became visible two or
    more years after collection.  Nothing called in the recent window gives no signals.
    """
    datable, archival = lag_years()
    recent, baseline = F.col("bucket") == "recent", F.col("bucket") == "baseline"
    counts = exploded(bucketed(records, as_of, window_days).where("bucket in ('baseline', 'recent')")).groupBy("token").agg(
        F.count_if(baseline).alias("baseline_count"), F.count_if(recent).alias("recent_count"),
        F.count_if(recent & datable).alias("datable"), F.count_if(recent & archival).alias("archival"),
    ).where(F.col("recent_count") >= min_count)
    joined = counts.crossJoin(F.broadcast(coverage(records, as_of, window_days).select("baseline_called", "recent_called")))  # one row
    signals = _judged(joined, min_delta, backlog_fraction)
    return numbered(signals, [F.col("possible_backlog"), F.desc("delta"), F.desc("recent_count"), F.col("token")], "rank") if ranked else signals


def _judged(counts: DataFrame, min_delta: float, backlog_fraction: float) -> DataFrame:
    share = lambda k, n: F.coalesce(stats.ratio(F.col(k), F.col(n)), F.lit(0.0))
    out = counts.withColumn("baseline_prop", share("baseline_count", "baseline_called")).withColumn("recent_prop", share("recent_count", "recent_called"))
    out = out.withColumn("delta", F.col("recent_prop") - F.col("baseline_prop")).withColumn("first_appearance", F.col("baseline_count") == 0).withColumn("rising", F.col("delta") >= min_delta)
    lag = stats.ratio(F.col("archival"), F.col("datable"))
    return out.where("first_appearance or rising").withColumn("possible_backlog", F.coalesce(lag >= backlog_fraction, F.lit(False))).withColumn("canonical", X.is_substitution("token")).withColumn(
        "backlog_reason",
        F.when(F.col("datable") == 0, F.format_string("undatable (%d carriers lack a usable date pair)", F.col("recent_count")))
        .when(F.col("possible_backlog"), F.format_string("%d of %d datable carriers were deposited two or more years after collection: likely a backlog", "archival", "datable"))
        .otherwise(F.format_string("%d of %d datable carriers were deposited two or more years after collection: reads as recent", "archival", "datable")),
    )


def carriers(records: DataFrame, signals: DataFrame, as_of: str, window_days: int = WINDOW_DAYS) -> DataFrame:
    """(token, isolate_key) of the recent carriers of signals; rows, as an array could outgrow a task."""
    recent = exploded(bucketed(records, as_of, window_days).where("bucket = 'recent'"))
    return recent.join(signals.select("token"), "token", "left_semi").select("token", "isolate_key")


def note(coverage_row) -> str | None:
    """Said when nothing in the recent window is called."""
    return None if coverage_row["recent_called"] else "nothing in the recent window is called yet, so emergence cannot be judged; uncalled is not negative"
