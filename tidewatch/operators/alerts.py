"""Alerts from signals and verdicts, and their delivery only when there is news."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import emergence as E

# fixed values: tiers, most urgent first
TIERS = ("act-now", "watch", "context")


def tier_rank(tier: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, TIERS)), tier) - 1


def priority(backlog: Column, direction: Column, confidence: Column) -> Column:
    """context for a backlog, act-now for a defensible weaker fit, else watch."""
    return F.when(backlog, "context").when((direction == "weaker-fit") & confidence.isin("measured", "estimate"), "act-now").otherwise("watch")


def first_seen(records: DataFrame) -> DataFrame:
    """Each token's carriers over all records: how many, and the least non-blank collection and creation text."""
    text = lambda c: F.min(F.when(F.trim(c) != "", F.col(c)))
    return E.exploded(records).groupBy("token").agg(F.count("*").alias("n_carriers_total"), F.coalesce(text("collection_date"), F.lit("")).alias("first_collected"), F.coalesce(text("target_creation_date"), F.lit("")).alias("first_visible"))


def regions(records: DataFrame, signals: DataFrame, as_of: str, window_days: int) -> DataFrame:
    """Sorted distinct countries of each signal's recent carriers (as many as there are countries)."""
    recent = E.exploded(E.bucketed(records, as_of, window_days).where("bucket = 'recent'"))
    pairs = recent.join(signals.select("token"), "token", "left_semi").where(F.trim("country") != "").select("token", "country").distinct()
    return pairs.groupBy("token").agg(F.array_sort(F.collect_list("country")).alias("regions"))


def compose(records: DataFrame, verdicts: DataFrame, as_of: str, window_days: int = E.WINDOW_DAYS, **options) -> DataFrame:
    """Alerts in order, one row for each signal.  verdicts: a function of a frame of tokens, or estimates by token."""
    signals = E.detect(records, as_of, window_days, ranked=False, **options)
    fit = verdicts(signals.select("token")) if callable(verdicts) else verdicts
    fit = fit.select("token", "evidence_class", "confidence", "direction", "verdict")
    out = signals.join(fit, "token").join(first_seen(records), "token", "left").join(regions(records, signals, as_of, window_days), "token", "left")
    out = out.withColumn("regions", F.coalesce("regions", F.array().cast("array<string>"))).withColumn("n_regions", F.size("regions")).withColumn("priority", priority(F.col("possible_backlog"), F.col("direction"), F.col("confidence")))
    kind = F.when(F.col("first_appearance") & F.col("rising"), "new and rising").when(F.col("first_appearance"), "new").otherwise("rising")
    where = F.when(F.col("n_regions") > 0, F.concat(F.lit("in "), F.array_join("regions", ", "))).otherwise("in no stated region")
    since = F.coalesce(F.nullif("first_collected", F.lit("")), F.nullif("first_visible", F.lit("")), F.lit("an unknown date"))
    out = out.withColumn("headline", F.concat("token", F.lit(": "), kind, F.format_string(", %d recent carriers ", "recent_count"), where, F.lit(", first seen "), since, F.when(F.col("possible_backlog"), " (possibly a backlog)").otherwise(""), F.lit("; fit: "), "direction", F.lit(" ("), "confidence", F.lit(")")))
    return out.orderBy(tier_rank(F.col("priority")), F.desc("delta"), F.desc("recent_count"), "token")


def new_alerts(alerts: DataFrame, state: DataFrame) -> DataFrame:
    """Alerts never delivered, or more urgent than they ever were; state: token, tier.  Adds prior (null: new)."""
    prior = state.where(F.col("tier").isin(*TIERS)).select("token", F.col("tier").alias("prior"))
    return alerts.join(prior, "token", "left").where(F.col("prior").isNull() | (tier_rank(F.col("priority")) < tier_rank(F.col("prior"))))


def is_noop(alerts: DataFrame, state: DataFrame) -> bool:
    return new_alerts(alerts, state).isEmpty()


def next_state(alerts: DataFrame, state: DataFrame) -> DataFrame:
    """(token, tier): the most urgent tier ever of every token ever alerted."""
    both = state.where(F.col("tier").isin(*TIERS)).select("token", "tier").unionByName(alerts.select("token", F.col("priority").alias("tier")))
    return both.groupBy("token").agg(F.min(tier_rank(F.col("tier"))).alias("r")).select("token", F.element_at(F.array(*map(F.lit, TIERS)), (F.col("r") + 1).cast("int")).alias("tier"))


# what follows renders a few collected rows on the driver


def dumps_state(state: DataFrame, updated: str) -> str:
    return json.dumps({"delivered": {r["token"]: r["tier"] for r in state.collect()}, "updated": updated}, indent=2, sort_keys=True) + "\n"


def render_json(alerts: DataFrame) -> str:
    return json.dumps([r.asDict(True) for r in alerts.collect()], indent=2, sort_keys=True, default=str) + "\n"


def render_markdown(alerts: DataFrame, as_of: str, said: str | None = None) -> str:
    out = [f"# Alerts as of {as_of}", ""] + ([said, ""] if said else [])
    rows = alerts.collect()
    if not rows:
        return "\n".join([*out, "No alerts.", ""])
    out += ["| tier | token | recent | baseline | delta | regions | fit |", "|---|---|---|---|---|---|---|"]
    out += [f"| {r['priority'].upper()} | {r['token']} | {r['recent_count']}/{r['recent_called']} | {r['baseline_count']}/{r['baseline_called']} | {r['delta']:+.3f} | {', '.join(r['regions']) or '-'} | {r['direction']} ({r['confidence']}) |" for r in rows]
    for r in rows:
        out += ["", f"## {r['token']}", "", r["headline"], "", f"- first collected {r['first_collected'] or 'unknown'}, first visible {r['first_visible'] or 'unknown'}, {r['n_carriers_total']} carriers in all", f"- {r['verdict']}", f"- {r['backlog_reason']}"]
    return "\n".join([*out, ""])


def render_digest(alerts: DataFrame, fresh: DataFrame, as_of: str) -> str:
    rows = fresh.collect()
    news = [f"- {r['token']}: {'new' if r['prior'] is None else 'was ' + r['prior'].upper()}, now {r['priority'].upper()}" for r in rows]
    return "\n".join([f"# Digest of {as_of}", "", f"{len(rows)} new or escalated", "", *news, "", "---", "", render_markdown(alerts, as_of)])


def issue_title(fresh: DataFrame, as_of: str) -> str:
    tiers = {r["priority"] for r in fresh.select("priority").distinct().collect()}
    n = fresh.count()
    return f"{n} new alert{'' if n == 1 else 's'} ({'/'.join(t.upper() for t in TIERS if t in tiers)}), {as_of}"
