"""Commands: python -m tidewatch.cli <command> ...; each runs one plan on a Spark session and prints or writes its result."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import alerts as A
from .operators import backtest as B
from .operators import emergence as E
from .operators import seqcall as C
from .operators import store as S
from .plans import surveillance as W
from .session import session
from .sources import feeds, sinks, structures


def _records(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return feeds.read_records(spark, snapshot=a.snapshot, tsv=a.tsv, url=a.url)


def _lines(df: DataFrame) -> str:
    """Rows as JSON lines; for results of bounded size (summaries, signals, alerts)."""
    return "\n".join(json.dumps(r.asDict(True), sort_keys=True, default=str) for r in df.collect())


def _structure(spark: SparkSession, a: argparse.Namespace) -> W.Structure:
    rec = structures.lines(spark, a.receptor)
    return W.Structure(structures.residues(structures.select_chain(rec)), structures.ligand_atoms(structures.lines(spark, a.ligand)), structures.iron(rec))


def pull(spark, a) -> str:
    return sinks.write_parts(_records(spark, a), a.out)


def baseline(spark, a) -> str:
    return sinks.write_parts(S.baseline_as_of(_records(spark, a), a.as_of), a.out)


def diff(spark, a) -> str:
    return _lines(W.release_summary(feeds.read_snapshot(spark, a.old), feeds.read_snapshot(spark, a.new)).orderBy("status"))


def lag(spark, a) -> str:
    return _lines(B.lag_summary(B.deposit_lags(_records(spark, a))))


def replay(spark, a) -> str:
    return _lines(W.backtest(_records(spark, a), a.reference, a.target, window_days=a.window))


def prevalence(spark, a) -> str:
    return _lines(B.prevalence(_records(spark, a), C.AZOLE_PANEL))


def detect(spark, a) -> str:
    return _lines(E.detect(_records(spark, a), a.as_of, a.window).orderBy("rank"))


def alert(spark, a) -> str:
    found = A.compose(_records(spark, a), _structure(spark, a).verdicts, a.as_of, window_days=a.window)
    return A.render_json(found) if a.json else A.render_markdown(found, a.as_of)


def deliver(spark, a) -> str:
    """Prints a digest where there is news; the state file is a small JSON text, read and rewritten."""
    try:
        with open(a.state, encoding="utf-8") as f:
            text = f.read()
    except FileNotFoundError:
        text = ""
    state = spark.createDataFrame([(text,)], "s string").select(F.explode(feeds.read_state(F.col("s"))).alias("token", "tier"))
    d = W.deliver(_records(spark, a), state, _structure(spark, a), a.as_of, a.dry_run, window_days=a.window)
    if d.digest is None:
        return "no news"
    if not a.dry_run:
        new = A.dumps_state(d.state, a.as_of)
        with open(a.state, "w", encoding="utf-8") as f:
            f.write(new)
    return f"{d.title}\n\n{d.digest}"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidewatch", description=__doc__)
    commands = p.add_subparsers(dest="command", required=True)

    def add(f, *options: str, source: bool = True) -> None:
        c = commands.add_parser(f.__name__, help=f.__doc__)
        c.set_defaults(run=f)
        if source:
            for x in ("--snapshot", "--tsv", "--url"):
                c.add_argument(x)
        for x in options:
            if x in ("--json", "--dry-run"):
                c.add_argument(x, action="store_true")
            elif x == "--window":
                c.add_argument(x, type=int, default=E.WINDOW_DAYS)
            else:
                c.add_argument(x, required=x not in ("--reference", "--target"))

    add(pull, "--out")
    add(baseline, "--out", "--as-of")
    add(diff, "--old", "--new", source=False)
    add(lag)
    add(replay, "--reference", "--target", "--window")
    add(prevalence)
    add(detect, "--as-of", "--window")
    add(alert, "--as-of", "--window", "--receptor", "--ligand", "--json")
    add(deliver, "--as-of", "--window", "--receptor", "--ligand", "--state", "--dry-run")
    return p


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> str:
    a = parser().parse_args(arguments)
    out = a.run(spark or session(), a)
    print(out)
    return out


if __name__ == "__main__":
    main()
