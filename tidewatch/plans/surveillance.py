"""From a feed to delivered alerts, and from sequences to filled snapshots."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import alerts as A
from ..operators import backtest as B
from ..operators import emergence as E
from ..operators import seqcall as C
from ..operators import store as S
from ..operators import verdict as V


@dataclass
class Structure:
    """A modelled pocket: residues, ligand atoms, iron."""

    residues: DataFrame
    ligand: DataFrame
    iron: tuple

    def verdicts(self, tokens: DataFrame) -> DataFrame:
        return V.estimate(V.map_tokens(tokens, self.residues, self.ligand, self.iron))


@dataclass
class Delivery:
    """What a run delivers: nothing at all (digest None) when it has no news."""

    alerts: DataFrame
    fresh: DataFrame
    state: DataFrame
    digest: str | None
    title: str | None
    note: str | None


def deliver(records: DataFrame, state: DataFrame, structure: Structure, as_of: str, dry_run: bool = False, **options) -> Delivery:
    """Detect, map, compose, and render only news; a dry run renders but keeps the state."""
    found = A.compose(records, structure.verdicts, as_of, **options)
    note = E.note(E.coverage(records, as_of, options.get("window_days", E.WINDOW_DAYS)).first())
    fresh = A.new_alerts(found, state)
    if fresh.isEmpty():
        return Delivery(found, fresh, state, None, None, note)
    return Delivery(found, fresh, state if dry_run else A.next_state(found, state), A.render_digest(found, fresh, as_of), A.issue_title(fresh, as_of), note)


def fill(records: DataFrame, consensus: DataFrame, reference: str, seed: int, n: int = 0) -> DataFrame:
    """A new version of a snapshot: a seeded choice of pending records gets calls from consensus (isolate_key, sequence).

    A chosen record without a sequence is marked failed, never dropped.
    """
    chosen = S.seeded_sample(S.pending_with_run(records), "isolate_key", seed, n).select("isolate_key")
    calls = C.formatted(C.call(chosen.join(consensus, "isolate_key", "left"), "sequence", reference))
    return S.fill_calls(records, calls)


def release_summary(old: DataFrame, new: DataFrame) -> DataFrame:
    return S.diff(old, new).groupBy("status").agg(F.count("*").alias("n"))


def backtest(records: DataFrame, reference_date: str | None = None, target: str | None = None, **options) -> DataFrame:
    return B.first_flag(B.walk_forward(records, target=target, **options), reference_date)
