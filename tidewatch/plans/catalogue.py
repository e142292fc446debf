"""The registered queries: each operator on the driver's tables, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions import temporal as T
from ..functions import text as X
from ..functions import vectors as V
from ..operators import alerts as A
from ..operators import backtest as B
from ..operators import emergence as E
from ..operators import geometry as G
from ..operators import library as L
from ..operators import ranking as R
from ..operators import seqcall as C
from ..operators import store as S

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, *names: str):
    got = [spark.read.parquet(f"{sf}/{n}.parquet") for n in names]
    return got[0] if len(got) == 1 else got


def _r(c, n: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


# events as records: who and what, when visible, when collected, and a token unless the event failed
def _records(spark: SparkSession, sf: str) -> DataFrame:
    ts, year = F.col("ts"), F.year("ts")
    return _t(spark, sf, "events").select(
        F.concat_ws("-", "user_id", "event_id").alias("isolate_key"), F.date_format(ts, "yyyy-MM-dd").alias("target_creation_date"), (year - F.col("event_id") % 5).cast("string").alias("collection_date"),
        F.when(F.col("event_type") != "error", F.concat(F.lit("K"), F.get_json_object("props", "$.k"), F.lit("R"))).otherwise("").alias("erg11_call"), F.col("event_type").alias("country"),
    )


_RECORDS = """records as (select user_id || '-' || event_id as isolate_key, strftime(ts, '%Y-%m-%d') as created, (year(ts) - event_id % 5) as collected_year, year(ts) as visible_year,
  case when event_type <> 'error' then 'K' || json_extract_string(props, '$.k') || 'R' else '' end as call, event_type as country from events)"""
_AS_OF, _DAYS, _DELTA = "2024-01-15", 10, 0.002
_BUCKETS = f"""{_RECORDS},
b as (select *, case when created <= '{_AS_OF}' then 'baseline' when created <= '2024-01-25' then 'recent' else 'later' end as bucket from records),
cov as (select count(*) filter (bucket = 'baseline') as baseline_total, count(*) filter (bucket = 'baseline' and call <> '') as baseline_called, count(*) filter (bucket = 'recent') as recent_total, count(*) filter (bucket = 'recent' and call <> '') as recent_called, 0::bigint as undated from b),
tok as (select call as token, count(*) filter (bucket = 'baseline') as baseline_count, count(*) filter (bucket = 'recent') as recent_count, count(*) filter (bucket = 'recent' and visible_year - collected_year >= 2) as archival, min(created) as first_visible, min(collected_year::varchar) as first_collected from b where call is not null and call <> '' group by 1),
sig as (select token, baseline_count, recent_count, baseline_called, recent_called, coalesce(baseline_count / nullif(baseline_called, 0)::double, 0) as bp, recent_count / recent_called::double as rp, recent_count as datable, archival, archival / recent_count::double >= 0.5 as possible_backlog from tok, cov where recent_count >= 3),
signals as (select *, rp - bp as delta, baseline_count = 0 as first_appearance, rp - bp >= {_DELTA} as rising from sig where baseline_count = 0 or rp - bp >= {_DELTA})"""
_OPTIONS = {"window_days": _DAYS, "min_count": 3, "min_delta": _DELTA}


@query(f"""with {_BUCKETS}
select token, baseline_count, recent_count, baseline_called, recent_called, round(bp, 6) as baseline_prop, round(rp, 6) as recent_prop, round(delta, 6) as delta, first_appearance, rising, possible_backlog, archival, datable,
  regexp_full_match(token, '[A-Z][0-9]+[A-Z*]') as canonical, row_number() over (order by possible_backlog, delta desc, recent_count desc, token)::int as rank from signals""")
def emergence_signals(spark, sf):
    s = E.detect(_records(spark, sf), _AS_OF, **_OPTIONS)
    return s.select("token", "baseline_count", "recent_count", "baseline_called", "recent_called", *[_r(c).alias(c) for c in ("baseline_prop", "recent_prop", "delta")], "first_appearance", "rising", "possible_backlog", "archival", "datable", "canonical", "rank")


@query(f"with {_BUCKETS} select * from cov")
def emergence_coverage(spark, sf):
    return E.coverage(_records(spark, sf), _AS_OF, _DAYS)


@query(f"with {_BUCKETS} select s.token, b.isolate_key from signals s join b on b.call = s.token and b.bucket = 'recent'")
def signal_carriers(spark, sf):
    r = _records(spark, sf)
    return E.carriers(r, E.detect(r, _AS_OF, **_OPTIONS), _AS_OF, _DAYS)


_LAST_SQL = """select user_id, event_type, max(event_id) as event_id, arg_max(value, event_id) as value from events group by 1, 2"""


@query(_LAST_SQL)
def snapshot_latest(spark, sf):
    e = _t(spark, sf, "events").withColumn("k", F.concat_ws("|", "user_id", "event_type")).select("k", "event_id", "value", "user_id", "event_type")
    return S.latest_version(e, "k", "event_id").select("user_id", "event_type", "event_id", "value")


@query("""with o as (select o_orderkey, o_orderstatus from orders where o_orderdate < '1998-01-01' and o_orderkey % 7 <> 0), n as (select o_orderkey, case when o_orderkey % 11 = 0 then 'X' else o_orderstatus end as o_orderstatus from orders where o_orderdate < '1999-01-01' and o_orderkey % 5 <> 0)
select coalesce(o.o_orderkey, n.o_orderkey) as o_orderkey, case when o.o_orderkey is null then 'added' when n.o_orderkey is null then 'removed' else 'revised' end as status from o full join n on o.o_orderkey = n.o_orderkey where o.o_orderkey is null or n.o_orderkey is null or o.o_orderstatus <> n.o_orderstatus""")
def snapshot_diff(spark, sf):
    o = _t(spark, sf, "orders")
    old = o.where("o_orderdate < '1998-01-01' and o_orderkey % 7 <> 0")
    new = o.where("o_orderdate < '1999-01-01' and o_orderkey % 5 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 11 == 0, "X").otherwise(F.col("o_orderstatus")))
    return S.diff(old, new, "o_orderkey", "o_orderstatus")


@query("""select case when o_orderkey % 13 = 0 then 'unplaceable' when strftime(o_orderdate, '%Y-%m-%d') <= '1997-06-30' then 'baseline' else 'later' end as placed, count(*) as n from orders group by 1""")
def baseline_as_of(spark, sf):
    o = _t(spark, sf, "orders").withColumn("target_creation_date", F.when(F.col("o_orderkey") % 13 == 0, F.date_format("o_orderdate", "yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm")))
    return S.as_of(o, "1997-06-30").groupBy("placed").agg(F.count("*").alias("n"))


_RAW_SQL = """raw as (select conv_id, turn, case when turn % 5 = 4 then ' NULL ' when turn % 3 = 2 then null else 'PDT' || conv_id || '.' || turn end as target_acc, case when turn % 2 = 0 then ' R' || turn else 'not collected' end as run, role || ': ' || conv_id as geo from conversations),
clean as (select case when lower(trim(target_acc)) = 'null' or target_acc is null then '' else target_acc end as target_acc, case when run = 'not collected' then '' else trim(run) end as run_acc, split_part(geo, ':', 1) as country, geo as geo_loc_name from raw)"""


def _raw(spark, sf):
    turn = F.col("turn")
    return _t(spark, sf, "conversations").select(
        F.when(turn % 5 == 4, " NULL ").when(turn % 3 == 2, F.lit(None)).otherwise(F.concat(F.lit("PDT"), "conv_id", F.lit("."), "turn")).alias("target_acc"), F.when(turn % 2 == 0, F.concat(F.lit(" R"), "turn")).otherwise("not collected").alias("Run"),
        F.concat("role", F.lit(": "), "conv_id").alias("geo_loc_name"), *[F.lit("n/a").alias(c) for c in ("target_creation_date", "collection_date", "biosample_acc", "asm_acc", "lat_lon")],
    )


@query(f"""with {_RAW_SQL}, best as (select split_part(target_acc, '.', 1) as isolate_key, max(target_acc) as target_acc from clean where target_acc <> '' group by 1)
select b.isolate_key, b.target_acc, max(c.run_acc) as run_acc, max(c.country) as country, max(c.geo_loc_name) as geo_loc_name, case when max(c.run_acc) <> '' then 'pending:sra-recaller' else 'pending:no-reads' end as resistance_source, '' as collection_date from best b join clean c using (target_acc) group by 1, 2""")
def normalize_records(spark, sf):
    return S.normalize(_raw(spark, sf)).select("isolate_key", "target_acc", "run_acc", "country", "geo_loc_name", "resistance_source", "collection_date")


@query(f"with {_RAW_SQL} select count(*) as rows, count(*) filter (target_acc = '') as dropped from clean")
def unkeyable_rows(spark, sf):
    # counted in the same scan that normalises
    seen = Observation("feed")
    S.normalize(_raw(spark, sf), observe=seen).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["rows"], seen.get["dropped"])], "rows long, dropped long")


@query("select token, count(*) as n from (select p_partkey, unnest(list_distinct(list_filter(regexp_split_to_array(upper(p_type || ', ' || p_brand || ' ' || p_name), '[,;/|\\s]+'), lambda x: x <> ''))) as token from part) group by 1")
def tokenise_explode(spark, sf):
    p = _t(spark, sf, "part").select(F.explode(X.tokens(F.concat("p_type", F.lit(", "), "p_brand", F.lit(" "), "p_name"))).alias("token"))
    return p.groupBy("token").agg(F.count("*").alias("n"))


@query("""with t as (select case p_partkey % 6 when 0 then ' y' || p_size || 'f' when 1 then 'Y' || p_size || 'B' when 2 then 'TR' || p_size when 3 then 'K0' || p_size || 'r' when 4 then 'Q' || p_size || '*' else null end as token from part),
u as (select token, regexp_extract(upper(trim(coalesce(token, ''))), '^([A-Z])([0-9]+)([A-Z*])$', ['a', 'p', 'b']) as g from t)
select count(*) as n, count(*) filter (regexp_full_match(token, '[A-Z][0-9]+[A-Z*]')) as loose, count(*) filter (g.a <> '' and g.a in ('A','R','N','D','C','E','Q','G','H','I','L','K','M','F','P','S','T','W','Y','V') and g.b in ('*','A','R','N','D','C','E','Q','G','H','I','L','K','M','F','P','S','T','W','Y','V')) as strict,
  count(*) filter (g.a || nullif(ltrim(g.p, '0'), '') || g.b in ('Y22F', 'K7R')) as panel, sum(case when g.a <> '' and g.a in ('A','R','N','D','C','E','Q','G','H','I','L','K','M','F','P','S','T','W','Y','V') and g.b in ('*','A','R','N','D','C','E','Q','G','H','I','L','K','M','F','P','S','T','W','Y','V') then try_cast(g.p as int) end)::bigint as positions from u""")
def substitution_tests(spark, sf):
    k, size = F.col("p_partkey") % 6, F.col("p_size").cast("string")
    token = F.when(k == 0, F.concat(F.lit(" y"), size, F.lit("f"))).when(k == 1, F.concat(F.lit("Y"), size, F.lit("B"))).when(k == 2, F.concat(F.lit("TR"), size)).when(k == 3, F.concat(F.lit("K0"), size, F.lit("r"))).when(k == 4, F.concat(F.lit("Q"), size, F.lit("*")))
    p = _t(spark, sf, "part").select(token.alias("token"))
    s = X.parse_substitution("token")
    return p.agg(F.count("*").alias("n"), F.count_if(X.is_substitution("token")).alias("loose"), F.count_if(s.isNotNull()).alias("strict"), F.count_if(X.is_panel_token("token", {22: ("Y", {"F"}), 7: ("K", {"R"})})).alias("panel"), F.sum(s["pos"]).alias("positions"))


@query("""select l_returnflag, count(*) as datable, count(*) filter (year(l_shipdate) - year(o_orderdate) >= 2) as archival, round(count(*) filter (year(l_shipdate) - year(o_orderdate) >= 2) / count(*)::double, 6) as share from lineitem join orders on l_orderkey = o_orderkey group by 1""")
def backlog_share(spark, sf):
    l, o = _t(spark, sf, "lineitem", "orders")
    j = l.select("l_orderkey", "l_returnflag", "l_shipdate").join(o.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.select("l_returnflag", F.date_format("l_shipdate", "yyyy-MM-dd").alias("target_creation_date"), F.date_format("o_orderdate", "yyyy").alias("collection_date"))
    datable, archival = E.lag_years()
    out = j.groupBy("l_returnflag").agg(F.count_if(datable).alias("datable"), F.count_if(archival).alias("archival"))
    return out.withColumn("share", _r(stats.ratio(F.col("archival"), F.col("datable"))))


@query("""with x as (select case when l_linenumber = 7 then null else date_diff('day', o_orderdate::date, l_shipdate::date) end as d from lineitem join orders on l_orderkey = o_orderkey)
select count(d) as n, count(*) filter (d is null) as undatable, quantile_cont(d::double, 0.25) as p25, quantile_cont(d::double, 0.5) as median, quantile_cont(d::double, 0.75) as p75, quantile_cont(d::double, 0.9) as p90, min(d)::int as min, max(d)::int as max, count(*) filter (d <= 365) as within, count(*) filter (d < 0) as negative, round(count(*) filter (d <= 365) / count(d)::double, 6) as within_share,
  quantile_cont(d::double, 0.5) <= 365 and count(*) filter (d <= 365) / count(d)::double >= 0.6 as arrives_in_time from x""")
def deposit_lag_summary(spark, sf):
    l, o = _t(spark, sf, "lineitem", "orders")
    j = l.select("l_orderkey", "l_linenumber", "l_shipdate").join(o.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = j.select(F.date_format("l_shipdate", "yyyy-MM-dd").alias("target_creation_date"), F.when(F.col("l_linenumber") == 7, F.date_format("o_orderdate", "yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("collection_date"))
    return B.lag_summary(B.deposit_lags(rows)).withColumn("within_share", _r("within_share"))


@query("select strftime(o_orderdate, '%Y-%m') as month, count(*) as n from orders group by 1")
def month_hist(spark, sf):
    return S.month_histogram(_t(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("d")), "d")


@query("select value, n from (select case when n_nationkey % 6 = 0 then 'NULL' else n_name end as value, count(*) as n from customer join nation on c_nationkey = n_nationkey group by 1) order by n desc, value limit 5")
def topk_nations(spark, sf):
    c, n = _t(spark, sf, "customer", "nation")
    j = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.when(F.col("n_nationkey") % 6 == 0, " unknown ").otherwise(F.col("n_name")).alias("n_name"))
    return S.top_values(j, "n_name", 5)


def _order_records(spark, sf, *more: str):
    return _t(spark, sf, "orders").select(*more, F.date_format("o_orderdate", "yyyy-MM-dd").alias("target_creation_date"), F.date_format("o_orderdate", "yyyy").alias("collection_date"), F.when(F.col("o_orderkey") % 9 == 0, "").otherwise(F.concat(F.substring("o_orderpriority", 1, 1), F.lit("7"), "o_orderstatus")).alias("erg11_call"))


@query("""with r as (select o_orderdate::date as d, case when o_orderkey % 9 = 0 then '' else substr(o_orderpriority, 1, 1) || '7' || o_orderstatus end as call from orders),
s as (select unnest(generate_series(date_trunc('month', (select min(d) from r)), date_trunc('month', (select max(d) from r)), interval 1 month))::date as as_of),
cov as (select as_of, count(*) filter (d <= as_of) as baseline_called, count(*) filter (d > as_of and d <= as_of + 60) as recent_called from s left join r on call <> '' group by 1),
tok as (select as_of, call as token, count(*) filter (d <= as_of) as bc, count(*) filter (d > as_of and d <= as_of + 60) as rc from s, r where call <> '' group by 1, 2),
sig as (select t.as_of, token from tok t join cov c using (as_of) where rc >= 3 and (bc = 0 or rc / recent_called::double - coalesce(bc / nullif(baseline_called, 0)::double, 0) >= 0.02)),
agg as (select as_of, count(*) as n_signals, bool_or(token = '17O') as hit from sig group by 1)
select strftime(as_of, '%Y-%m-%d') as as_of, baseline_called, recent_called, recent_called > 0 as callable, coalesce(n_signals, 0) as n_signals, coalesce(hit, false) as hit from cov left join agg using (as_of)""")
def walk_forward(spark, sf):
    return B.walk_forward(_order_records(spark, sf), target="17O", window_days=60, min_delta=0.02).withColumn("as_of", F.date_format("as_of", "yyyy-MM-dd"))


@query("""with r as (select case when quality = 1 then 'sra-recaller:called' when doc_id % 3 = 0 then 'sra-recaller:partial(x)' when doc_id % 3 = 1 then 'sra-recaller:failed(y)' else '' end as source, lang, toxic from labels join documents using (doc_id)),
g as (select lang, count(*) as n_total, count(*) filter (source = 'sra-recaller:called') as n, count(*) filter (source = 'sra-recaller:called' and toxic = 1) as k, count(*) filter (source like 'sra-recaller:partial%') as partial, count(*) filter (source like 'sra-recaller:failed%') as failed, count(*) filter (source = '') as pending from r group by 1)
select lang, n_total, n as n_resolved, k as n_positive, partial as excluded_partial, failed as excluded_failed, pending as excluded_pending, round(k / nullif(n, 0)::double, 6) as event_frequency,
  case when n > 0 then round(greatest(0, (k + 1.9208) / (n + 3.8416) - 1.96 / (n + 3.8416) * sqrt(k * (n - k) / nullif(n, 0)::double + 0.9604)), 6) end as ci_lo, case when n > 0 then round(least(1, (k + 1.9208) / (n + 3.8416) + 1.96 / (n + 3.8416) * sqrt(k * (n - k) / nullif(n, 0)::double + 0.9604)), 6) end as ci_hi from g""")
def prevalence_wilson(spark, sf):
    l, d = _t(spark, sf, "labels", "documents")
    m = F.col("doc_id") % 3
    r = l.join(d.select("doc_id", "lang"), "doc_id").select("lang", F.when(F.col("quality") == 1, "sra-recaller:called").when(m == 0, "sra-recaller:partial(x)").when(m == 1, "sra-recaller:failed(y)").otherwise("").alias("resistance_source"), F.when(F.col("toxic") == 1, "Y132F,A1B").otherwise("A1B").alias("erg11_call"))
    out = B.prevalence(r, C.AZOLE_PANEL, ("lang",))
    return out.select("lang", "n_total", "n_resolved", "n_positive", "excluded_partial", "excluded_failed", "excluded_pending", *[_r(c).alias(c) for c in ("event_frequency", "ci_lo", "ci_hi")])


_RANKED_SQL = """m as (select d.doc_id as name, case when lang <> 'es' then n_chars::double end as key, coalesce(quality = 1, false) as a, length(source)::double + doc_id % 17 as key2 from documents d left join labels l using (doc_id)),
rk as (select *, row_number() over (order by key nulls last, name) as r from m), c as (select count(*)::double as n, count(*) filter (a)::double as k from rk),
s as (select sum(r) filter (a) as rs, count(*) filter (a and r <= ceil(c.n * 0.01::double)) as t1, count(*) filter (a and r <= ceil(c.n * 0.05::double)) as t5, count(*) filter (a and r <= ceil(c.n * 0.1::double)) as t10, sum(exp(-20 * r / c.n)) filter (a) as es, count(key) as rankable, count(*) - count(key) as unrankable from rk, c),
met as (select n::bigint as n, k::bigint as n_active, round(1 - (rs - k * (k + 1) / 2) / (k * (n - k)), 6) as auc, round(t1 * n / (ceil(n * 0.01::double) * k), 6) as ef1, round(t5 * n / (ceil(n * 0.05::double) * k), 6) as ef5, round(t10 * n / (ceil(n * 0.1::double) * k), 6) as ef10,
  round((es / k / ((1 - exp(-20)) / (exp(20 / n) - 1) / n) - (1 - exp(20 * k / n)) / (k / n * (1 - exp(20)))) / ((1 - exp(-20 * k / n)) / (k / n * (1 - exp(-20))) - (1 - exp(20 * k / n)) / (k / n * (1 - exp(20)))), 6) as bedroc, rankable, unrankable from s, c)"""


def _cohort(spark, sf):
    d, l = _t(spark, sf, "documents", "labels")
    return d.select("doc_id", "lang", "n_chars", "source").join(l, "doc_id", "left").select(F.col("doc_id").alias("name"), F.when(F.col("lang") != "es", F.col("n_chars").cast("double")).alias("key"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("is_active"), (F.length("source") + F.col("doc_id") % 17).cast("double").alias("key2"))


@query(f"with {_RANKED_SQL} select * from met")
def rank_metrics(spark, sf):
    m, _ = R.report(_cohort(spark, sf))
    return m.select("n", "n_active", *[_r(c).alias(c) for c in ("auc", "ef1", "ef5", "ef10", "bedroc")], "rankable", "unrankable")


@query(f"with {_RANKED_SQL} select name, r::int as rank from rk where a and r <= 15")
def top_actives(spark, sf):
    return R.report(_cohort(spark, sf))[1].select("name", "rank")


_POISSON_SQL = " + ".join(f"(u >= {c!r}::double)::int" for c in R._POISSON)


@query(f"""with {_RANKED_SQL}, act as (select name, (r - row_number() over (order by r)) / (n - k) as above from rk, c where a),
drawn as (select b, above, ('0x' || substr(md5('7:' || b || ':' || name), 1, 13))::bigint / 4503599627370496.0::double as u from act, range(1, 201) t(b)),
w as (select b, above, {_POISSON_SQL} as w from drawn), per as (select b, 1 - sum(w * above) / nullif(sum(w), 0) as auc from w group by 1)
select count(auc)::bigint as replicates, round(avg(auc), 6) as auc_mean, round(quantile_cont(auc, 0.025), 6) as auc_lo, round(quantile_cont(auc, 0.975), 6) as auc_hi from per""")
def gate_interval(spark, sf):
    found = R.bootstrap_auc(R.rank_rows(_cohort(spark, sf)), 200, 7)
    return found.select("replicates", *[_r(c).alias(c) for c in ("auc_mean", "auc_lo", "auc_hi")])


@query(f"with {_RANKED_SQL} select auc, ef1, coalesce(auc >= 0.7 and ef1 >= 5, false) as passed from met")
def ranking_gate(spark, sf):
    return R.metrics(R.rank_rows(_cohort(spark, sf))).withColumn("passed", R.gate()).select(_r("auc").alias("auc"), _r("ef1").alias("ef1"), "passed")


@query(f"with {_RANKED_SQL} select name, (x.p1 + y.p2)::int as combined from (select name, row_number() over (order by key, name) - 1 as p1 from m where key is not null) x join (select name, row_number() over (order by key2, name) - 1 as p2 from m where key2 is not null) y using (name)")
def combined_rank(spark, sf):
    return R.combined_key(_cohort(spark, sf), "key", "key2").where("combined is not null").select("name", "combined")


@query("select l_partkey, count(v) as n, min(v) as best, coalesce(max(v) - min(v), 0) as spread, median(v) as median from (select l_partkey, l_linenumber, min(case when l_discount < 0.09 then l_extendedprice end) as v from lineitem group by 1, 2) group by 1")
def replicate_statistics(spark, sf):
    l = _t(spark, sf, "lineitem").groupBy("l_partkey", "l_linenumber").agg(F.min(F.when(F.col("l_discount") < 0.09, F.col("l_extendedprice"))).alias("v"))
    return R.replicate_stats(l, "l_partkey", "v")


@query("select l_partkey, count(*) as n_poses, count(*) filter (l_discount < 0.03) as n_passing, min(l_discount) as best_dist, min(l_extendedprice) filter (l_discount < 0.03) as best_score from lineitem group by 1")
def constrained_best(spark, sf):
    l = _t(spark, sf, "lineitem").select("l_partkey", F.col("l_discount").alias("dist"), F.col("l_extendedprice").alias("score"), F.col("l_linenumber").alias("model"))
    return G.constrained_best(l, ("l_partkey",), 0.03).drop("best")


# every vector as a body of points: its numbers in threes, what is missing at the end is 0
def _points(spark, sf):
    e, i = F.col("embedding"), F.col("i")
    at = _t(spark, sf, "embeddings").select("vec_id", "label", "embedding", F.explode(F.sequence(F.lit(0), F.floor((F.size(e) - 1) / 3).cast("int"))).alias("i"))
    return at.select("vec_id", "label", "i", *[F.coalesce(F.get(e, 3 * i + k).cast("double"), F.lit(0.0)).alias(n) for k, n in enumerate("xyz")])


_POINTS_SQL = "p as (select vec_id, label, i, coalesce(embedding[3 * i + 1], 0)::double as x, coalesce(embedding[3 * i + 2], 0)::double as y, coalesce(embedding[3 * i + 3], 0)::double as z from (select *, unnest(range(0, (len(embedding) + 2) // 3)) as i from embeddings))"


@query(f"with {_POINTS_SQL} select label, round(min(case when vec_id % 2 = 0 then sqrt(x*x + y*y + z*z) end), 6) as dist from p group by 1")
def nearest_distance(spark, sf):
    p = _points(spark, sf).withColumn("atom", F.when(F.col("vec_id") % 2 == 0, "N1").otherwise("C1"))
    return G.pose_features(p, (0.0, 0.0, 0.0), by=("label",)).select("label", _r("dist").alias("dist"))


@query(f"with {_POINTS_SQL} select label, round(dist, 6) as dist, dist <= 0.05 as contact from (select a.label, min(sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z))) as dist from p a, p b where a.vec_id % 50 <> 0 and b.vec_id % 50 = 0 group by 1)")
def contact_join(spark, sf):
    p = _points(spark, sf)
    return G.min_distance(p.where("vec_id % 50 <> 0"), p.where("vec_id % 50 = 0").select("x", "y", "z"), ("label",)).select("label", _r("dist").alias("dist"), (F.col("dist") <= 0.05).alias("contact"))


@query(f"""with {_POINTS_SQL}, e as (select vec_id, label, sqrt(x*x + y*y + z*z) as d, degrees(acos(least(1, abs(x*0.6 + z*0.8) / nullif(sqrt(x*x + y*y + z*z), 0)))) as t from p),
d as (select vec_id, label, min(d) as d, arg_min(t, d) as t from e group by 1, 2)
select label, round(min(d * (1 + sin(radians(t)))), 6) as s, round(min(t), 4) as theta, round(min(d), 6) as dist from d group by 1""")
def axial_feature(spark, sf):
    f = G.pose_features(_points(spark, sf).withColumn("atom", F.lit("N")), (0.0, 0.0, 0.0), (0.6, 0.0, 0.8), by=("label", "vec_id"))
    return G.independent_minima(f, ("label",)).select("label", _r("s").alias("s"), _r("theta", 4).alias("theta"), _r("dist").alias("dist"))


@query("""with a as (select l_orderkey, l_linenumber, min(l_quantity) as q, min(l_discount) as d from lineitem group by 1, 2)
select x.l_orderkey as k, round(sqrt(avg((x.q - y.q) * (x.q - y.q) + (x.d - y.d) * (x.d - y.d))), 6) as rmsd, count(*) as n from a x join a y on y.l_orderkey = x.l_orderkey + 1 and y.l_linenumber = x.l_linenumber group by 1""")
def name_matched_rmsd(spark, sf):
    a = _t(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("x"), F.min("l_discount").alias("y"), F.lit(0.0).alias("z"))
    left = a.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("atom"), "x", "y", "z")
    return G.rmsd(left, left.withColumn("k", F.col("k") - 1), by=("k",)).select("k", _r("rmsd").alias("rmsd"), "n")


_REF = "MKTAYIAKQR"


@query(f"""with s as (select doc_id, regexp_replace(translate(coalesce(text, ''), 'ehilmoprsuEHILMOPRSU', 'ACGTACGTACACGTACGTAC'), '[^\\x00-\\x7F]', 'N', 'g') as t from documents),
q as (select doc_id, translate(upper(trim(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), 'U', 'T') as seq from s),
r as (select doc_id, seq, rtrim(array_to_string(list_transform(range(0, length(seq) // 3), lambda i: case when regexp_full_match(substr(seq, (3 * i + 1)::int, 3), '[ACGT]{{3}}') then substr('{C.CODE}', (1 + 16 * (strpos('TCAG', seq[(3 * i + 1)::int]) - 1) + 4 * (strpos('TCAG', seq[(3 * i + 2)::int]) - 1) + strpos('TCAG', seq[(3 * i + 3)::int]) - 1)::int, 1) else 'X' end), ''), '*') as prot from q),
w as (select *, case when seq = '' then 'empty consensus' when length(seq) % 3 <> 0 then 'length ' || length(seq) || ' is no multiple of 3: a frame shift is refused, not guessed' when length(prot) <> 10 then 'protein length ' || length(prot) || ' instead of 10: insertions and deletions are refused' end as reason from r)
select doc_id, case when reason is null then 'ok' else 'refused' end as status, reason,
  case when reason is null then array_to_string(list_filter(list_transform(range(1, 11), lambda i: case when prot[i] <> 'X' and prot[i] <> ('{_REF}')[i] then ('{_REF}')[i] || i || prot[i] end), lambda x: x is not null), ',') else '' end as call,
  (case when reason is null then length(replace(prot, 'X', '')) else 0 end)::int as n_covered from w""")
def codon_call(spark, sf):
    # whole texts of all documents; what is not ASCII is an uncertain base, white space at the ends is the caller's to strip
    seq = F.regexp_replace(F.translate("text", "ehilmoprsuEHILMOPRSU", "ACGTACGTACACGTACGTAC"), r"[^\x00-\x7F]", "N")
    return C.formatted(C.call(_t(spark, sf, "documents").select("doc_id", seq.alias("seq")), "seq", _REF)).select("doc_id", "status", "reason", "call", "n_covered")


_LETTERS = "ehilmoprsubdfjknqvwxyzEHILMOPRSUBDFJKNQVWXYZ"
_BASES = "ACGTACGTACACACACACACAC" * 2
_WINDOW_REF = "MKTAYIAKQRNDGLSVEHWFPCKIARTMYQGLDSNVPEHW"
#: Positions of the windows that count as a panel: wild type and known changes.
_WINDOW_PANEL = {4: ("A", {"R", "S", "T"}), 10: ("R", {"L", "P"}), 33: ("D", {"S", "R"})}
_PANEL_SQL = " or ".join(f"c = '{wt}{pos}{x}'" for pos, (wt, muts) in _WINDOW_PANEL.items() for x in sorted(muts))


@query(f"""with s as (select doc_id, upper(translate(regexp_replace(regexp_replace(coalesce(text, ''), '[\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]', '', 'g'), '[^\\x00-\\x7F]', 'N', 'g'), '{_LETTERS}', '{_BASES}')) as t from documents),
q as (select doc_id, unnest(range(0, greatest(1, (length(t) + 119) // 120))) as part, t from s), v as (select doc_id, part, substr(t, (120 * part + 1)::int, 120) as seq from q),
r as (select doc_id, part, seq, rtrim(array_to_string(list_transform(range(0, length(seq) // 3), lambda i: case when contains(substr(seq, (3 * i + 1)::int, 3), 'N') then 'X' else substr('{C.CODE}', (1 + 16 * (strpos('TCAG', seq[(3 * i + 1)::int]) - 1) + 4 * (strpos('TCAG', seq[(3 * i + 2)::int]) - 1) + strpos('TCAG', seq[(3 * i + 3)::int]) - 1)::int, 1) end), ''), '*') as prot from v),
w as (select *, case when seq = '' then 'empty consensus' when length(seq) % 3 <> 0 then 'length ' || length(seq) || ' is no multiple of 3: a frame shift is refused, not guessed' when length(prot) <> 40 then 'protein length ' || length(prot) || ' instead of 40: insertions and deletions are refused' end as reason from r),
c as (select *, case when reason is null then list_filter(list_transform(range(1, 41), lambda i: case when prot[i] <> 'X' and prot[i] <> ('{_WINDOW_REF}')[i] then ('{_WINDOW_REF}')[i] || i || prot[i] end), lambda x: x is not null) else [] end as calls, case when reason is null then list_filter([4, 10, 33], lambda i: prot[i] = 'X') else [] end as lost from w)
select doc_id, part::int as part, case when reason is null then 'ok' else 'refused' end as status, reason, array_to_string(calls, ',') as call, array_to_string(list_filter(calls, lambda c: {_PANEL_SQL}), ',') as panel, (case when reason is null then length(replace(prot, 'X', '')) else 0 end)::int as n_covered,
  case when reason is not null then 'failed' when len(lost) > 0 then 'partial(panel-uncalled:' || array_to_string(lost, '+') || ')' when len(calls) > 0 then 'called' else 'wild-type' end as source from c""")
def codon_windows(spark, sf):
    """Every text as consecutive sequences of the reference's length; letters beyond ASCII are uncertain bases, the rest of a text is too short and refused."""
    seq = F.translate(F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x00-\x40\x5B-\x60\x7B-\x7F]+", ""), r"[^\x00-\x7F]", "N"), _LETTERS, _BASES)
    d = _t(spark, sf, "documents").select("doc_id", F.posexplode_outer(F.regexp_extract_all(seq, F.lit("(?s).{1,120}"), F.lit(0))).alias("part", "seq"))
    got = C.formatted(C.call(d.withColumn("part", F.coalesce("part", F.lit(0))), "seq", _WINDOW_REF, _WINDOW_PANEL))
    source = F.regexp_replace(F.regexp_replace("source", "^sra-recaller:", ""), r"^failed.*", "failed")
    return got.select("doc_id", "part", "status", "reason", "call", F.array_join("panel_hits", ",").alias("panel"), "n_covered", source.alias("source"))


@query("""select active, decoy from (select a.p_partkey as active, b.p_partkey as decoy, row_number() over (partition by a.p_partkey order by b.p_partkey, b.p_name) as n from part a join part b on a.p_brand = 'Brand#11' and b.p_brand <> 'Brand#11' and abs(a.p_retailprice - b.p_retailprice) <= 25 and abs(a.p_size - b.p_size) <= 2) where n <= 5""")
def theta_match(spark, sf):
    # the parts of one brand are the actives: they grow with the table
    p = _t(spark, sf, "part").select(F.col("p_partkey").alias("name"), F.col("p_partkey").alias("line"), "p_brand", F.col("p_retailprice").alias("mw"), F.col("p_size").alias("rotb"))
    return L.matches(p.where("p_brand = 'Brand#11'"), p.where("p_brand <> 'Brand#11'"), 5, tolerance={"rotb": 2}).select("active", F.col("name").alias("decoy"))


@query("""with b as (select list_distinct(list_filter(string_split(lower(coalesce(text, '')), ' '), lambda x: x <> '')) as w from benchmark), d as (select doc_id, list_distinct(list_filter(string_split(lower(coalesce(text, '')), ' '), lambda x: x <> '')) as w from documents),
t as (select doc_id, max(case when len(d.w) + len(b.w) = 0 then 0 else len(list_intersect(d.w, b.w)) / (len(d.w) + len(b.w) - len(list_intersect(d.w, b.w)))::double end) as top from d, b group by 1)
select doc_id, round(top, 6) as top from t where top < 0.35""")
def similarity_anti(spark, sf):
    # every document against every benchmark item
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), " "), lambda x: x != "")).alias("fp")
    d, b = _t(spark, sf, "documents", "benchmark")
    return L.best_similarity(d.select("doc_id", words), b.select(words), "doc_id", enough=L.MAX_SIMILARITY).where(F.col("top") < L.MAX_SIMILARITY).select("doc_id", _r("top").alias("top"))


@query("select reason, count(*) as n from (select case when lang = 'fr' then 'unparseable' when n_chars // 50 > 45 then 'too many heavy atoms' when doc_id % 3 = 0 then 'no aromatic nitrogen' else 'kept' end as reason from documents) group by 1")
def domain_filter(spark, sf):
    d = _t(spark, sf, "documents").select(F.when(F.col("lang") != "fr", F.floor(F.col("n_chars") / 50)).alias("heavy_atoms"), (F.col("doc_id") % 3).alias("aromatic_n"))
    return d.groupBy(L.domain_reason().alias("reason")).agg(F.count("*").alias("n"))


def _fit(tokens: DataFrame) -> DataFrame:
    n = X.residue_number("token")
    return tokens.select("token", F.lit("x").alias("evidence_class"), F.when(n % 3 == 0, "measured").when(n % 3 == 1, "estimate").otherwise("none").alias("confidence"), F.when(n % 2 == 0, "weaker-fit").otherwise("uncertain").alias("direction"), F.lit("v").alias("verdict"))


_ALERT_SQL = f"""{_BUCKETS}, a as (select s.*, regexp_extract(token, '[0-9]+')::int as k from signals s),
alerts as (select a.*, case when possible_backlog then 'context' when k % 2 = 0 and k % 3 < 2 then 'act-now' else 'watch' end as priority from a),
state as (select token, case regexp_extract(token, '[0-9]+')::int % 4 when 0 then 'act-now' when 1 then 'watch' when 2 then 'context' else 'nonsense' end as tier from (select distinct call as token from records where call <> '' and regexp_extract(call, '[0-9]+')::int % 5 < 3)),
t(tier, r) as (values ('act-now', 0), ('watch', 1), ('context', 2))"""


def _state(records: DataFrame) -> DataFrame:
    n = X.residue_number("erg11_call")
    tier = F.when(n % 4 == 0, "act-now").when(n % 4 == 1, "watch").when(n % 4 == 2, "context").otherwise("nonsense")
    return records.where((F.col("erg11_call") != "") & (n % 5 < 3)).select(F.col("erg11_call").alias("token"), tier.alias("tier")).distinct()


@query(f"""with {_ALERT_SQL}
select token, priority, round(delta, 6) as delta, n_regions, regions, first_collected, first_visible, total as n_carriers_total from alerts join (select call as token, array_to_string(list_sort(list(distinct country)), ',') as regions, count(distinct country)::int as n_regions from b where bucket = 'recent' group by 1) using (token)
join (select call as token, min(collected_year::varchar) as first_collected, min(created) as first_visible, count(*) as total from b group by 1) using (token)""")
def priority_tiers(spark, sf):
    a = A.compose(_records(spark, sf), _fit, _AS_OF, **_OPTIONS)
    return a.select("token", "priority", _r("delta").alias("delta"), "n_regions", F.array_join("regions", ",").alias("regions"), "first_collected", "first_visible", "n_carriers_total")


@query(f"with {_ALERT_SQL} select a.token, a.priority, s.tier as prior from alerts a left join (state s0 join t ts using (tier)) s on s.token = a.token join t tp on tp.tier = a.priority where s.tier is null or tp.r < s.r")
def delivery_new(spark, sf):
    r = _records(spark, sf)
    return A.new_alerts(A.compose(r, _fit, _AS_OF, **_OPTIONS), _state(r)).select("token", "priority", "prior")


@query(f"with {_ALERT_SQL} select token, ['act-now', 'watch', 'context'][(min(r) + 1)::int] as tier from (select token, r from state join t using (tier) union all select token, r from alerts a join t on t.tier = a.priority) group by 1")
def delivery_state(spark, sf):
    r = _records(spark, sf)
    return A.next_state(A.compose(r, _fit, _AS_OF, **_OPTIONS), _state(r))


@query("select r_name, strftime(min(o_orderdate), '%Y-%m-%d') as first_seen, array_to_string(list_sort(list(distinct n_name)), ',') as nations from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1")
def first_seen_regions(spark, sf):
    o, c, n, r = _t(spark, sf, "orders", "customer", "nation", "region")
    small = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")  # 25 rows
    who = c.select("c_custkey", "c_nationkey").join(F.broadcast(small), F.col("c_nationkey") == F.col("n_nationkey"))
    j = o.select("o_custkey", "o_orderdate").join(who, F.col("o_custkey") == F.col("c_custkey"))
    by = j.groupBy("r_name", "n_name").agg(F.min("o_orderdate").alias("d"))
    return by.groupBy("r_name").agg(F.date_format(F.min("d"), "yyyy-MM-dd").alias("first_seen"), F.array_join(F.array_sort(F.collect_set("n_name")), ",").alias("nations"))


@query("select o_orderkey from orders order by md5(o_orderkey || ':7'), o_orderkey limit 100")
def seeded_sample(spark, sf):
    return S.seeded_sample(_t(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 7, 100)


@query("select 'PDG.' || n_nationkey as release_tag, n_name as path from nation where n_nationkey not in (select r_regionkey from region) union all select 'PDG.' || r_regionkey, r_name from region")
def index_upsert(spark, sf):
    n, r = _t(spark, sf, "nation", "region")
    tag = lambda k: F.concat(F.lit("PDG."), F.col(k)).alias("release_tag")
    return S.upsert(n.select(tag("n_nationkey"), F.col("n_name").alias("path")), r.select(tag("r_regionkey"), F.col("r_name").alias("path")))


@query("select count(*) as n, count(*) filter (event_type <> 'error') as event_type, count(*) filter (json_extract_string(props, '$.k')::int % 10 <> 0) as k from events")
def fill_rates(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    e = _t(spark, sf, "events").select(F.when(F.col("event_type") == "error", " Not Collected").otherwise(F.col("event_type")).alias("event_type"), F.when(k % 10 == 0, "n/a").otherwise(k.cast("string")).alias("k"))
    return S.fill_rates(e, ["event_type", "k"])


@query("select event_type as outcome, count(*) as n from events where json_extract_string(props, '$.k')::int % 7 <> 0 group by 1")
def json_log(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    line = F.when(k % 7 == 0, "{broken").otherwise(F.to_json(F.struct(F.col("event_type").alias("status"), F.lit("e").alias("kind"))))
    runs = _t(spark, sf, "events").select(F.from_json(line, "kind string, status string").alias("r")).where("r.kind is not null").select("r.*")
    return C.outcomes(runs.withColumnRenamed("status", "outcome"))


@query("""select event_id, case when event_id % 4 = 0 then strftime(ts, '%Y-%m-%d') when event_id % 4 = 1 then strftime(ts, '%Y-%m-01') else null end as day, year(ts)::int as year from events""")
def parse_dates(spark, sf):
    m = F.col("event_id") % 4
    raw = F.when(m == 0, F.date_format("ts", "yyyy-MM-dd HH:mm")).when(m == 1, F.date_format("ts", "yyyy-MM")).when(m == 2, F.date_format("ts", "yyyy")).otherwise(F.concat(F.date_format("ts", "yyyy"), F.lit("-13-45")))
    return _t(spark, sf, "events").select("event_id", F.date_format(T.parse_day(raw), "yyyy-MM-dd").alias("day"), T.year_of(raw).alias("year"))


@query("select state, count(*) as n from (select case event_id % 6 when 0 then 'resolved' when 1 then 'resolved' when 2 then 'partial' when 3 then 'failed' when 4 then 'failed' else 'pending' end as state from events) group by 1")
def resolution_buckets(spark, sf):
    m = F.col("event_id") % 6
    src = F.when(m == 0, " sra-recaller:called").when(m == 1, "sra-recaller:wild-type").when(m == 2, "sra-recaller:partial(panel-uncalled:132)").when(m == 3, "sra-recaller:failed(x)").when(m == 4, "sra-recaller:refused").otherwise("sra-fks1-recaller:HS1=called")
    return _t(spark, sf, "events").groupBy(B.resolution(src).alias("state")).agg(F.count("*").alias("n"))


@query("select o_orderpriority, wt.n, round(wt.w, 6) as halfwidth from (select o_orderpriority, count(*) as n, 1.96 / (count(*) + 3.8416) * sqrt((count(*) // 2) * (count(*) - count(*) // 2) / count(*)::double + 0.9604) as w from orders group by 1) wt")
def wilson_planning(spark, sf):
    o = _t(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return o.withColumn("halfwidth", _r(stats.wilson_halfwidth("n")))


@query("""select o_orderkey, expected_lost as lost, case when o_orderkey % 4 = 0 then 'inconclusive' when expected_lost = 0 then 'pass' else 'fail' end as outcome from (select o_orderkey, (case when o_orderkey % 3 = 0 then 1 else 0 end)::int as expected_lost from orders)""")
def sanity_outcomes(spark, sf):
    k = F.col("o_orderkey")
    o = _t(spark, sf, "orders").select("o_orderkey", F.lit("Y132F, K143R").alias("expected"), F.when(k % 3 == 0, F.array(F.lit("Y132F"), F.lit("A5C"))).otherwise(F.array(F.lit("K143R"), F.lit("Y132F"))).alias("tokens"), F.when(k % 4 == 0, "refused").otherwise("ok").alias("status"), F.array().cast("array<int>").alias("uncalled_panel"))
    return C.sanity(o).select("o_orderkey", F.size("lost").alias("lost"), "outcome")


@query(f"""with {_POINTS_SQL}
select label, round(min(x*x + y*y + z*z), 6) as least, round(sum(abs(y*0.8 - z*0)), 4) as crossed from p group by 1""")
def vector_algebra(spark, sf):
    p = F.struct("x", "y", "z")
    c = V.cross(p, V.vec(0.0, 0.0, 0.8))
    return _points(spark, sf).groupBy("label").agg(_r(F.min(V.dot(p, p))).alias("least"), _r(F.sum(F.abs(c["x"])), 4).alias("crossed"))


@query("""with x as (select l_orderkey, list(l_linenumber::int order by l_linenumber) as a, list(l_quantity order by l_linenumber) filter (l_discount >= 0.02) as b from lineitem group by 1)
select l_orderkey, sum(a[i] * b[i]) as v, count(*) as n from (select *, unnest(range(1, least(len(a), coalesce(len(b), 0)) + 1)) as i from x) group by 1""")
def positional_join(spark, sf):
    # poses and scores by place: what has no partner on either side is left out; rows of one line number stay in the table's order
    l = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", F.col("_metadata.file_path").alias("part"), F.col("_metadata.row_index").alias("row"))
    by = ["l_linenumber", "part", "row"]
    w = Window.partitionBy("file").orderBy(*by)
    place = lambda df, v, n: df.select(F.col("l_orderkey").alias("file"), *by, F.col(v).alias(n)).withColumn("model", F.row_number().over(w)).drop(*by)
    both = G.with_scores(place(l.withColumn("line", F.col("l_linenumber")), "line", "dist"), place(l.where("l_discount >= 0.02"), "l_quantity", "score"))
    return both.groupBy(F.col("file").alias("l_orderkey")).agg(F.sum(F.col("dist") * F.col("score")).alias("v"), F.count("*").alias("n"))


_CALLS_SQL = """calls as (select doc_id, case when quality = 1 then 'sra-recaller:called' else 'pending:sra-recaller' end as source, case doc_id % 4 when 0 then 'Y132F,K143R' when 1 then 'k143r;Y132H' when 2 then 'F126L F126L' else '' end as call from labels)"""


@query(f"""with {_CALLS_SQL}, t as (select doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(upper(call), '[,;/|\\s]+'), lambda x: x <> ''))) as token from calls where source = 'sra-recaller:called')
select token, count(*) as n, regexp_extract(token, '[0-9]+')::int as residue from t where token in ('Y132F', 'K143R', 'F126L', 'V125A') group by 1""")
def panel_token_counts(spark, sf):
    m = F.col("doc_id") % 4
    call = F.when(m == 0, "Y132F,K143R").when(m == 1, "k143r;Y132H").when(m == 2, "F126L F126L").otherwise("")
    rows = _t(spark, sf, "labels").select(F.when(F.col("quality") == 1, "sra-recaller:called").otherwise("pending:sra-recaller").alias("resistance_source"), call.alias("erg11_call"))
    return B.panel_tokens(rows, C.AZOLE_PANEL)


@query("""with w as (select * from (""" + SQL["walk_forward"] + """))
select count(*) as steps, count(*) filter (callable) as callable_steps, count(*) filter (hit) as flagged_steps, min(as_of) filter (hit) as first_flag, bool_or(callable) as any_callable, date_diff('day', (min(as_of) filter (hit))::date, date '2000-01-01')::int as lead_days from w""")
def first_flag(spark, sf):
    walk = B.walk_forward(_order_records(spark, sf), target="17O", window_days=60, min_delta=0.02)
    return B.first_flag(walk, "2000-01-01").withColumn("first_flag", F.date_format("first_flag", "yyyy-MM-dd"))


@query("select count(*) as records, count(*) filter (o_orderkey % 3 = 0) as with_reads, count(*) filter (o_orderkey % 5 <> 0) as dated from orders")
def pull_stats(spark, sf):
    k = F.col("o_orderkey")
    return S.pull_stats(_t(spark, sf, "orders").select(F.when(k % 3 == 0, "R1").otherwise(" ").alias("run_acc"), F.when(k % 5 == 0, F.date_format("o_orderdate", "yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM")).alias("target_creation_date")))


@query(f"with {_RANKED_SQL} select name, r::int as rank, case when key is null then 'no_pose' else printf('%.3f', key) end as dist, case when key2 = 6 then 'NA' else printf('%.1f', key2) end as score from rk where r <= 50 or key is null")
def ranked_output(spark, sf):
    from ..sources.sinks import ranked_table

    r = R.rank_rows(_cohort(spark, sf)).where("rank <= 50 or key is null").select("name", "rank", F.col("key").alias("dist"), F.when(F.col("key2") != 6, F.col("key2")).alias("score"))
    return ranked_table(r)


@query("""select round(avg(p_size) filter (p_brand = 'Brand#11'), 6) as size_active, round(avg(p_retailprice) filter (p_brand = 'Brand#11'), 4) as price_active, round(avg(p_size) filter (p_brand <> 'Brand#11'), 6) as size_decoy, round(avg(p_retailprice) filter (p_brand <> 'Brand#11'), 4) as price_decoy,
  round(abs(avg(p_size) filter (p_brand = 'Brand#11') - avg(p_size) filter (p_brand <> 'Brand#11')), 6) as size_diff from part""")
def match_quality(spark, sf):
    p = _t(spark, sf, "part").select("p_brand", F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))
    q = L.match_quality(p.where("p_brand = 'Brand#11'"), p.where("p_brand <> 'Brand#11'"), ("size", "price"))
    return q.select(_r("size_active").alias("size_active"), _r("price_active", 4).alias("price_active"), _r("size_decoy").alias("size_decoy"), _r("price_decoy", 4).alias("price_decoy"), _r("size_diff").alias("size_diff"))


def _window_sql(name: str, first: int) -> str:
    aa = lambda i: f"substr('{C.CODE}', (1 + 16 * (strpos('TCAG', {name}[{3 * i + 1}]) - 1) + 4 * (strpos('TCAG', {name}[{3 * i + 2}]) - 1) + strpos('TCAG', {name}[{3 * i + 3}]) - 1)::int, 1)"
    return ", ".join(f"case when length({name}) = 9 and {aa(i)} <> '{r}' then '{r}{first + i}' || {aa(i)} end" for i, r in enumerate("TYS"))


@query(f"""with s as (select doc_id, upper(translate(regexp_replace(text, '[^a-zA-Z]', '', 'g'), '{_LETTERS}', '{_BASES}')) as seq from documents),
c as (select doc_id, substr(seq, 28, 9) as near, substr(seq, 598, 9) as far from s),
t as (select doc_id, near, far, list_filter([{_window_sql("near", 10)}], lambda x: x is not null) as n, list_filter([{_window_sql("far", 200)}], lambda x: x is not null) as f from c)
select doc_id, case when near is null then 'missing' when length(near) <> 9 then 'refused' when len(n) > 0 then 'called' else 'wild-type' end as near, case when far is null then 'missing' when length(far) <> 9 then 'refused' when len(f) > 0 then 'called' else 'wild-type' end as far, array_to_string(list_concat(n, f), ',') as call from t""")
def window_calls(spark, sf):
    # two fixed windows of the whole text of every document; a text that ends before or within a window is refused there
    ws = (C.Window("near", 10, 12, 11, "Y"), C.Window("far", 200, 202, 201, "Y"))
    d = _t(spark, sf, "documents").select("doc_id", F.translate(F.regexp_replace("text", "[^a-zA-Z]", ""), _LETTERS, _BASES).alias("seq"))
    d = d.select("doc_id", F.create_map(*[x for w in ws for x in (F.lit(w.name), w.cut(F.col("seq")))]).alias("seqs"))
    return C.call_windows(d, "seqs", "X" * 9 + "TYS" + "X" * 187 + "TYS", ws).select("doc_id", *[F.col("windows")[w.name]["status"].alias(w.name) for w in ws], "call")
