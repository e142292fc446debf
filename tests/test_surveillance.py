import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tests.cohorts import AS_OF, FIELDS, demo, replay
from tidewatch.functions import stats
from tidewatch.functions import temporal as T
from tidewatch.functions import text as X
from tidewatch.operators import alerts as A
from tidewatch.operators import backtest as B
from tidewatch.operators import emergence as E
from tidewatch.operators import seqcall as C
from tidewatch.operators import store as S


def frame(spark, rows, fields=FIELDS):
    return spark.createDataFrame(rows, ", ".join(f"{f} string" for f in fields))


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize("value,want", [(" a\t", "a"), ("Not Collected ", ""), (None, ""), ("N/A", ""), ("0", "0")])
def test_clean(spark, value, want):
    assert one(spark, X.clean_nullish, value) == want


def test_tokens_are_a_set_in_order(spark):
    assert one(spark, X.tokens, " y132f, k143r;Y132F|tr34/x  z,") == ["Y132F", "K143R", "TR34", "X", "Z"]
    assert one(spark, X.tokens, ",") == [] and one(spark, X.is_called, ",") is True and one(spark, X.tokens, None) == []


def test_three_rules_for_substitutions(spark):
    assert one(spark, X.is_substitution, "Y132B") and one(spark, X.parse_substitution, "Y132B") is None
    assert one(spark, X.is_substitution, "y132f") is False and tuple(one(spark, X.parse_substitution, " y132f ")) == ("TYR", 132, "PHE")
    assert tuple(one(spark, X.parse_substitution, "Y132*")) == ("TYR", 132, "*")
    panel = lambda c: X.is_panel_token(c, C.AZOLE_PANEL)
    assert one(spark, panel, "y132f") and one(spark, panel, "Y0132F") and not one(spark, panel, "Y132H") and not one(spark, panel, "TR34")


@pytest.mark.parametrize("value,want", [("2024-03-05", "2024-03-05"), ("2024-03-05T10:00", "2024-03-05"), ("2024-03", "2024-03-01"), ("2024", None), ("2024-13-01", None), ("2024-02-30", None), ("", None), (None, None)])
def test_parse_day(spark, value, want):
    got = one(spark, T.parse_day, value)
    assert (got and got.isoformat()) == want


def test_two_date_guards_differ(spark):
    assert one(spark, T.iso_day, "20240305xy") is None and one(spark, T.day_prefix, "20240305xy") == "20240305xy"
    assert one(spark, T.year_of, "  2019-01") == 2019 and one(spark, T.year_of, "x2019") is None


def test_month_steps(spark):
    df = spark.sql("select date'2023-11-20' a, date'2024-02-01' z")
    assert [d.isoformat() for d in df.select(T.month_steps("a", "z").alias("m")).first()["m"]] == ["2023-11-01", "2023-12-01", "2024-01-01", "2024-02-01"]
    assert df.select(T.month_steps("z", "a").alias("m")).first()["m"] == []


def test_normalize_and_versions(spark):
    rows = [("PDT1.2", "R1", "USA: California", "2024-01-01"), ("PDT1.10", "null", "USA", "2024-01-02"), (None, "R", "", ""), (" NULL ", "R", "", ""), ("PDT2.1", "", "null", "NULL")]
    raw = frame(spark, rows, ("target_acc", "Run", "geo_loc_name", "target_creation_date")).select("*", *[F.lit(None).cast("string").alias(c) for c in ("collection_date", "biosample_acc", "asm_acc", "lat_lon")])
    seen = __import__("pyspark.sql", fromlist=["Observation"]).Observation("n")
    got = {r["isolate_key"]: r for r in S.normalize(raw, observe=seen).collect()}
    assert seen.get == {"rows": 5, "dropped": 2}
    assert got["PDT1"]["target_acc"] == "PDT1.2" and got["PDT1"]["country"] == "USA" and got["PDT1"]["resistance_source"] == S.PENDING_READS  # text order: .2 beats .10
    assert got["PDT2"]["country"] == "" and got["PDT2"]["resistance_source"] == S.PENDING_NONE and got["PDT2"]["target_creation_date"] == ""
    assert S.normalize(raw, numeric_version=True).where("isolate_key = 'PDT1'").first()["target_acc"] == "PDT1.10"


def test_diff_and_as_of(spark):
    f = ("isolate_key", "target_acc")
    got = {r["isolate_key"]: r["status"] for r in S.diff(frame(spark, [("1", "a"), ("2", "a.1")], f), frame(spark, [("2", "a.2"), ("3", "b")], f)).collect()}
    assert got == {"1": "removed", "2": "revised", "3": "added"}
    rec = frame(spark, [("a", "2024-01-01"), ("b", "2024-01-02T5"), ("c", "2024"), ("d", "")], ("isolate_key", "target_creation_date"))
    assert {r["isolate_key"]: r["placed"] for r in S.as_of(rec, "2024-01-01").collect()} == {"a": "baseline", "b": "later", "c": "unplaceable", "d": "unplaceable"}


def test_sample_is_seeded_and_limits_after_the_shuffle(spark):
    df = spark.range(50).selectExpr("cast(id as string) as k")
    a, b = ([r["k"] for r in S.seeded_sample(df.repartition(p), "k", 7).collect()] for p in (1, 5))
    assert a == b and sorted(a, key=int) == [str(i) for i in range(50)] and a != sorted(a, key=int)
    assert [r["k"] for r in S.seeded_sample(df, "k", 7, 5).collect()] == a[:5] and [r["k"] for r in S.seeded_sample(df, "k", 8, 5).collect()] != a[:5]


def test_emergence_on_the_demo_cohort(spark):
    records = frame(spark, demo())
    cov = E.coverage(records, AS_OF).first()
    assert (cov["baseline_total"], cov["baseline_called"], cov["recent_total"], cov["recent_called"], cov["undated"]) == (8, 5, 14, 12, 0)
    got = E.detect(records, AS_OF).orderBy("rank").collect()
    # M220K 2/5 to 9/12 (four of nine are old: no backlog), H147Y 0 to 3/12, DUP46 0 to 4/12 (all old); G54W is gone
    assert [(r["token"], r["baseline_count"], r["recent_count"], r["first_appearance"], r["rising"], r["possible_backlog"], r["canonical"]) for r in got] == [
        ("M220K", 2, 9, False, True, False, True), ("H147Y", 0, 3, True, True, False, True), ("DUP46", 0, 4, True, True, True, False)]
    assert [round(r["delta"], 6) for r in got] == [0.35, 0.25, 0.333333]
    assert E.carriers(records, E.detect(records, AS_OF), AS_OF).where("token = 'DUP46'").count() == 4
    assert E.note(cov) is None and "uncalled" in E.note({"recent_called": 0})
    assert E.detect(records.withColumn("erg11_call", F.lit("")), AS_OF).count() == 0


def naive_signals(rows, as_of, window, min_count, min_delta):
    import datetime as dt

    day = lambda s: dt.date.fromisoformat(s)
    end = day(as_of) + dt.timedelta(days=window)
    base = [r for r in rows if day(r[1]) <= day(as_of)]
    recent = [r for r in rows if day(as_of) < day(r[1]) <= end]
    nb, nr = sum(bool(r[3]) for r in base), sum(bool(r[3]) for r in recent)
    out = set()
    for t in {t for r in recent for t in r[3].split(",") if t}:
        k, b = sum(t in r[3].split(",") for r in recent), sum(t in r[3].split(",") for r in base)
        if k >= min_count and (b == 0 or k / nr - (b / nb if nb else 0) >= min_delta):
            lag = [int(r[1][:4]) - int(r[2]) >= 2 for r in recent if t in r[3].split(",")]
            out.add((t, b, k, sum(lag) / len(lag) >= 0.5))
    return nb, nr, out


@pytest.mark.parametrize("seed", [1, 2])
def test_detection_and_replay_against_a_naive_evaluation(spark, seed):
    rnd = random.Random(seed)
    tokens = ["A1B", "C2D", "E3F", "G4H"]
    rows = []
    for i in range(150):
        m = rnd.randrange(1, 13)
        rows.append((f"k{i}", f"202{rnd.randrange(2, 4)}-{m:02d}-{rnd.randrange(1, 29):02d}", str(rnd.randrange(2018, 2024)), ",".join(rnd.sample(tokens, rnd.randrange(0, 4))), "X", ""))
    records = frame(spark, rows)
    steps = B.steps(records)
    cov, sig = B.replay_signals(records, steps, window_days=90, min_count=3, min_delta=0.05)
    got: dict = {r["as_of"].isoformat(): (r["baseline_called"], r["recent_called"], set()) for r in cov.collect()}
    for r in sig.collect():
        got[r["as_of"].isoformat()][2].add((r["token"], r["baseline_count"], r["recent_count"], r["possible_backlog"]))
    assert len(got) == steps.count()
    for as_of, found in got.items():
        assert found == naive_signals(rows, as_of, 90, 3, 0.05), as_of
    some = sorted(got)[len(got) // 2]
    one_step = {(r["token"], r["baseline_count"], r["recent_count"], r["possible_backlog"]) for r in E.detect(records, some, 90, 3, 0.05).collect()}
    assert one_step == got[some][2]


def test_replay_cohort(spark):
    # three carriers lie within 180 days of the first days of August to December; in January two are left
    walk = B.walk_forward(frame(spark, replay()), target="L98H")
    assert [r["as_of"].isoformat()[:7] for r in walk.where("hit").orderBy("as_of").collect()] == ["2021-08", "2021-09", "2021-10", "2021-11", "2021-12"]
    r = B.first_flag(walk, "2022-06-01").first()
    assert (r["steps"], r["flagged_steps"], r["first_flag"].isoformat(), r["lead_days"], r["any_callable"]) == (14, 5, "2021-08-01", 304, True)


def test_lags(spark):
    f = ("collection_date", "target_creation_date")
    lags = lambda days: B.deposit_lags(spark.createDataFrame([(d,) for d in days], "d int").select(F.lit("2023-01-01").alias(f[0]), F.date_format(F.date_add(F.lit("2023-01-01").cast("date"), F.col("d")), "yyyy-MM-dd").alias(f[1])))
    r = B.lag_summary(lags([0, 100, 200, 400])).first()
    assert (r["n"], r["median"], r["within"], r["arrives_in_time"]) == (4, 150.0, 3, True)
    assert B.lag_summary(lags([-31])).first()["negative"] == 1
    empty = B.lag_summary(B.deposit_lags(frame(spark, [("2023", "2024-01-01")], f))).first()
    assert (empty["n"], empty["undatable"], empty["median"], empty["arrives_in_time"]) == (0, 1, None, None)


def test_prevalence(spark):
    rows = [("a", "sra-recaller:called", "Y132F,K143R"), ("b", "sra-recaller:called", "Y132F"), ("c", "sra-recaller:called", "A5C"), ("d", "sra-recaller:partial(x)", "Y132F"), ("e", "sra-recaller:failed(z)", ""), ("f", "pending:sra-recaller", "")]
    df = frame(spark, rows, ("isolate_key", "resistance_source", "erg11_call"))
    r = B.prevalence(df, C.AZOLE_PANEL).first()
    assert (r["n_total"], r["n_resolved"], r["n_positive"], r["n_called_nonpanel"], r["excluded_partial"], r["excluded_failed"], r["excluded_pending"]) == (6, 3, 2, 1, 1, 1, 1)
    assert [(x["token"], x["n"]) for x in B.panel_tokens(df, C.AZOLE_PANEL).orderBy("residue", "token").collect()] == [("Y132F", 2), ("K143R", 1)]
    w = spark.sql("select 160 k, 199 n, 0 z").select(stats.wilson("k", "n").alias("w"), stats.wilson("z", "z").alias("none"), stats.wilson_halfwidth(F.lit(200)).alias("h")).first()
    assert w["none"] is None and math.isclose(w["w"]["lo"], 0.74333, abs_tol=1e-5) and math.isclose(w["w"]["hi"], 0.85319, abs_tol=1e-5) and round(w["h"], 3) == 0.069


def verdicts(tokens):
    known = F.col("token") == "M220K"
    return tokens.select("token", F.lit("e").alias("evidence_class"), F.when(known, "measured").otherwise("none").alias("confidence"), F.when(known, "weaker-fit").otherwise("uncertain").alias("direction"), F.lit("v").alias("verdict"))


def test_alerts_and_three_deliveries(spark):
    records = frame(spark, demo())
    a = A.compose(records, verdicts, AS_OF)
    rows = a.collect()
    assert [(r["token"], r["priority"]) for r in rows] == [("M220K", "act-now"), ("H147Y", "watch"), ("DUP46", "context")]
    top = rows[0]
    assert top["regions"] == ["Chile", "Kenya"] and top["n_carriers_total"] == 11 and top["first_collected"] == "2018" and top["first_visible"] == "2023-03-05"
    none = spark.createDataFrame([], "token string, tier string")
    assert A.new_alerts(a, none).count() == 3
    state = A.next_state(a, none)
    assert A.is_noop(a, state)
    newer = records.withColumn("collection_date", F.when(F.col("collection_date") == "2018", "2023").otherwise(F.col("collection_date")))
    b = A.compose(newer, verdicts, AS_OF)
    fresh = A.new_alerts(b, state).collect()
    assert [(r["token"], r["prior"], r["priority"]) for r in fresh] == [("DUP46", "context", "watch")]
    after = {r["token"]: r["tier"] for r in A.next_state(a, A.next_state(b, state)).collect()}
    assert after["DUP46"] == "watch"  # the most urgent ever
    assert json.loads(A.dumps_state(state, "d"))["delivered"]["M220K"] == "act-now"
    assert "ACT-NOW" in A.render_markdown(a, AS_OF) and "was CONTEXT" in A.render_digest(b, A.new_alerts(b, state), "x") and A.issue_title(A.new_alerts(b, state), "x").startswith("1 new alert (WATCH)")
    assert [x["token"] for x in json.loads(A.render_json(a))] == ["M220K", "H147Y", "DUP46"]
    unknown = spark.createDataFrame([("M220K", "nonsense")], "token string, tier string")
    assert A.new_alerts(a, unknown).count() == 3


def test_fill_plan(spark):
    rows = [("a", "R1,R2", S.PENDING_READS), ("b", "", S.PENDING_NONE), ("c", "R3", "sra-recaller:called"), ("d", "R1", S.PENDING_READS)]
    df = frame(spark, rows, ("isolate_key", "run_acc", "resistance_source"))
    assert {r["isolate_key"] for r in S.pending_with_run(df).collect()} == {"a", "d"}
    p = S.plan_counts(df, 1).first()
    assert (p["total"], p["pending"], p["without_run"], p["ready"], p["distinct_runs"], p["attempted"]) == (4, 3, 1, 2, 1, 1)
