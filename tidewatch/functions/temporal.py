"""Dates as feeds write them: full, month only, year only, or nothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c


def year_of(c: Column | str) -> Column:
    """Leading four digits, white space before them allowed; else null."""
    return F.nullif(F.regexp_extract(F.coalesce(_c(c), F.lit("")), r"^\s*(\d{4})", 1), F.lit("")).cast("int")


def iso_day(c: Column | str) -> Column:
    """The first ten characters if they look like a day (four digits and a hyphen in front), else null."""
    d = F.substring(_c(c), 1, 10)
    return F.when(d.rlike(r"^\d{4}-[\s\S]{5}$"), d)


def day_prefix(c: Column | str) -> Column:
    """The looser guard of baselines: ten characters that begin with four digits."""
    d = F.substring(_c(c), 1, 10)
    return F.when(d.rlike(r"^\d{4}[\s\S]{6}$"), d)


def parse_day(c: Column | str) -> Column:
    """A date from YYYY-MM-DD or YYYY-MM (its first day) in front of the text; a bare year or an impossible date is null."""
    full, month = F.regexp_extract(_c(c), r"^(\d{4}-\d{2}-\d{2})", 1), F.regexp_extract(_c(c), r"^(\d{4}-\d{2})(?!-\d{2})", 1)
    return F.coalesce(F.try_to_date(F.nullif(full, F.lit("")), "yyyy-MM-dd"), F.try_to_date(F.concat(F.nullif(month, F.lit("")), F.lit("-01")), "yyyy-MM-dd"))


def creation_bucket(created: Column | str, as_of: str | Column, window_days: int = 180) -> Column:
    """baseline (up to as_of), recent (after it, up to window_days later), later, or undated; compared as ISO text."""
    day, asof = iso_day(created), F.lit(as_of) if isinstance(as_of, str) else as_of
    end = F.date_format(F.date_add(F.to_date(F.substring(asof, 1, 10)), window_days), "yyyy-MM-dd")
    return F.when(day.isNull(), "undated").when(day <= F.substring(asof, 1, 10), "baseline").when(day <= end, "recent").otherwise("later")


def month_steps(first: Column | str, last: Column | str) -> Column:
    """First days of all months from first to last, both included; an empty array where there is none."""
    a, z = F.trunc(_c(first), "MM"), F.trunc(_c(last), "MM")
    return F.when(a <= z, F.sequence(a, z, F.expr("interval 1 month"))).otherwise(F.expr("cast(array() as array<date>)"))


def lead_time_days(flagged: Column | str, reference: Column | str) -> Column:
    return F.datediff(_c(reference), _c(flagged))
