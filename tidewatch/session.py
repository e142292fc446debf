"""Session settings the package relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, app: str = "tidewatch", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ANSI mode stays on, so faults surface instead of turning null."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()
