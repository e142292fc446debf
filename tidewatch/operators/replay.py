"""A replay of detection that is kept up to date: releases change it where they change history.

Kept are counts by day and by (token, day), and the coverage and signals of every step.  A release comes as
its changes: rows with weight 1 or -1 (``store.changes``).  Their counts are added to the kept ones, and only steps
that a changed day can touch are computed again, from the counts: those from the first changed day less the recent window
on.  Earlier steps stay.  Work follows changes, days and tokens, never records times steps.

Every update is a version, a folder of tables that is complete once its last file, a mark, is there; the version before
it is deleted then.  An update that dies leaves the version before it, from which it can be run again.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import temporal as T
from ..scratch import hadoop
from . import backtest as B
from . import emergence as E

TABLES = ("created", "days", "tokens", "coverage", "signals")


class Replay:
    """The replay in a folder that all executors share; target and options as for walk_forward()."""

    def __init__(self, spark: SparkSession, path: str, target: str | None = None, window_days: int = E.WINDOW_DAYS, **options):
        self.spark, self.path, self.target, self.window = spark, path.rstrip("/"), target, window_days
        self.options = {"window_days": window_days, **options}
        #: The first step that the last update computed again; None: none.
        self.touched: datetime.date | None = None

    def _fs(self, path: str):
        return hadoop(self.spark, path)

    def version(self) -> int:
        """The newest complete version; 0: none."""
        fs, at = self._fs(self.path)
        if not fs.exists(at):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()]
        found = [int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()]
        return max([v for v in found if fs.exists(self._fs(f"{self.path}/v{v}/done")[1])], default=0)

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v{self.version()}/{name}")

    def coverage(self) -> DataFrame:
        return self._table("coverage")

    def signals(self) -> DataFrame:
        return self._table("signals")

    def walk(self) -> DataFrame:
        """walk_forward() rows of all releases so far."""
        return B.walked(self.coverage(), self.signals(), self.target)

    def update(self, changed: DataFrame) -> Replay:
        """Take a release's changes (records with weight) into the replay."""
        spark, before = self.spark, self.version()
        folder = f"{self.path}/v{before + 1}"
        fs, at = self._fs(folder)
        fs.delete(at, True)  # of an update that died
        put = lambda df, name: df.write.parquet(f"{folder}/{name}")
        new = lambda name: spark.read.parquet(f"{folder}/{name}")

        # the changes, often a join of two releases, are worked out once; counts of equal records add up
        what = ["target_creation_date", "collection_date", "erg11_call"]
        put(changed.groupBy(*what).agg(F.sum("weight").alias("weight")).where("weight != 0"), "changed")
        deltas = dict(zip(TABLES, B.counts(new("changed"), F.col("weight"))))
        first = []
        for name, keys, day in (("created", ["created"], "created"), ("days", ["day"], "day"), ("tokens", ["token", "day"], "day")):
            delta = deltas[name]
            measures = [c for c in delta.columns if c not in keys]
            some = F.lit(False)
            for m in measures:
                some = some | (F.col(m) != 0)
            put(delta.where(some), f"delta_{name}")
            if name != "created":
                first.append(new(f"delta_{name}").agg(F.min(day)).first()[0])
            every = new(f"delta_{name}") if not before else self._table(name).unionByName(new(f"delta_{name}"))
            put(every.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures]).where(some), name)

        fs.delete(self._fs(f"{folder}/changed")[1], True)

        span = new("created").agg(F.min("created").alias("first"), F.max("created").alias("last"))
        steps = [r["as_of"] for r in span.select(F.explode(T.month_steps("first", "last")).alias("as_of")).collect()]  # months
        known = {r["as_of"] for r in self.coverage().select("as_of").collect()} if before else set()
        changed_days = [d for d in first if d is not None]
        from_day = min(changed_days) - datetime.timedelta(days=self.window) if changed_days else None
        again = [s for s in steps if s not in known or from_day is not None and s >= from_day]
        self.touched = min(again, default=None)
        stay = [s for s in steps if s not in set(again)]
        dates = lambda some: spark.createDataFrame([(s,) for s in some], "as_of date")
        cov, signals = B.replay_counts(new("days"), new("tokens"), dates(again), **self.options)
        for name, df in (("coverage", cov), ("signals", signals)):
            kept = self._table(name).join(F.broadcast(dates(stay)), "as_of", "left_semi") if before else None
            put(df if kept is None else kept.unionByName(df.select(*kept.columns)), name)
        fs.create(self._fs(f"{folder}/done")[1]).close()
        for v in range(before, max(0, before - 2), -1):
            fs.delete(self._fs(f"{self.path}/v{v}")[1], True)
        return self
