"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are pattern matches with their places.  Places come from matches
alone: the pattern is matched together with the gap before it, anchored where
the last match ended, and running sums of gap and match lengths are code-point
offsets; each text is passed a fixed number of times and its matches are sorted, never
compared with each other.  Each candidate value is hashed; the hash is counted
over distinct owners and distinct repositories (documents, where docs have no such column).

A value is a copied example when many owners hold it, or when several owners
hold it in very many repositories.  A value of one owner is specific to that owner and
looks live, in however many of their repositories it lies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, all_of, fresh

#: Distinct owners from which a value counts as a widely copied example; and distinct repositories from which two owners are enough.
COPIED_OWNERS, COPIED_REPOSITORIES = 3, 8
#: kind: (pattern, group of the value, least length of the value, cheap test that any text with a match passes)
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE_KINDS = ("assign", "access", "hex")
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Added by the method: long mixed runs that stand free; only those of few owners are reported.
_BARE = r"(?<![A-Za-z0-9+/_=.-])(?=[A-Za-z0-9+/_=-]*[0-9])(?=[A-Za-z0-9+/_=-]*[a-z])(?=[A-Za-z0-9+/_=-]*[A-Z])[A-Za-z0-9+/_=-]{20,}"


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


_MATCH = "array<struct<kind:int,step:int,len:int,ok:boolean,hash:string>>"
KINDS = (*BASE_KINDS, "bare")


def _matches(text: Column, kind: int, pattern: str, value_group: int, least: int) -> Column:
    """The matches of a kind in order: their length, the step from the end of the one before to their own end, and their value's hash."""
    # group 1: the gap before the match; group 2: the match
    whole = F.lit(r"\G([\s\S]*?)(" + pattern + ")")
    value = lambda m: F.regexp_extract(m, pattern, value_group) if value_group else m
    return F.zip_with(F.regexp_extract_all(text, whole, 1), F.regexp_extract_all(text, whole, 2), lambda g, m: F.struct(
        F.lit(kind).alias("kind"), (F.length(g) + F.length(m)).alias("step"), F.length(m).alias("len"), (F.length(value(m)) >= least).alias("ok"), F.sha2(value(m).cast("binary"), 256).alias("hash"))).cast(_MATCH)


def _candidates(text: Column) -> Column:
    none = F.expr(f"cast(array() as {_MATCH})")
    low = _lower(text)
    may = F.lit(False)
    for w in _ASSIGN_WORDS:
        may = may | low.contains(w)
    assign = F.when(may, _matches(text, 0, "(?i:" + ASSIGN + ")", 2, 6)).otherwise(none)
    # runs of 16 or 24 and more are what the patterns with + find, less what their length bound drops
    access = F.when(text.contains("AKIA"), _matches(text, 1, "AKIA[A-Z0-9]{16,}", 0, 20)).otherwise(none)
    hexes = F.when(text.rlike("[0-9a-f]{24}"), _matches(text, 2, "[0-9a-f]{24,}", 0, 24)).otherwise(none)
    bare = F.when(text.rlike("[A-Za-z0-9+/_=-]{20}"), _matches(text, 3, _BARE, 0, 20)).otherwise(none)
    return F.concat(assign, access, hexes, bare)


def _judged(found: DataFrame, copied_owners: int, copied_repositories: int, scratch: Scratch) -> DataFrame:
    """(row, start, end, kind number, owners, repositories, live) of the matches in found: row, owner, repo, found."""
    each = found.where(F.size("found") > 0).select("row", "owner", "repo", F.posexplode("found").alias("i", "x")).select("row", "owner", "repo", "i", "x.*")
    # everything of one text is sorted in one place, so one shuffle serves all windows
    each = each.repartition("row").withColumn("end", F.sum("step").over(Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)).cast("int")).where("ok")
    each = each.select("row", "owner", "repo", "kind", "hash", (F.col("end") - F.col("len")).alias("start"), "end")
    # a free-standing run that a base span already covers adds nothing: no base span that begins up to it ends in it, none begins in it
    base = F.col("kind") < len(BASE_KINDS)
    upto = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    onward = Window.partitionBy("row").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("past", F.max(F.when(base, F.col("end"))).over(upto)).withColumn("next", F.min(F.when(base, F.col("start"))).over(onward))
    free = (F.coalesce("past", F.lit(0)) <= F.col("start")) & (F.coalesce("next", F.col("end")) >= F.col("end"))
    each = scratch.table(each.where(base | free).drop("past", "next"))
    # distinct pairs first, so that a value in a third of all rows shrinks before it meets in one place
    owners = each.groupBy("hash", "owner").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("*").alias("owners"))
    repos = each.groupBy("hash", "repo").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("*").alias("repositories"))
    # a written table, so that a hot value's rows can be split when they are joined to it
    known = scratch.table(owners.join(repos, "hash"))
    copied = (F.col("owners") >= copied_owners) | ((F.col("owners") > 1) & (F.col("repositories") >= copied_repositories))
    return each.join(known, "hash").withColumn("live", ~copied).where(base | F.col("live")).select("row", "start", "end", "kind", "owners", "repositories", "live")


def _found(docs: DataFrame, owner: str, repository: str | None, row: Column, more: list[Column]) -> DataFrame:
    repo = F.col(repository) if repository else F.col("doc_id")
    return docs.select(row.alias("row"), F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"), F.coalesce(repo.cast("string"), F.lit("")).alias("repo"), _candidates(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("found"), *more)


def scan(docs: DataFrame, owner: str = "source", repository: str | None = None, copied_owners: int = COPIED_OWNERS, copied_repositories: int = COPIED_REPOSITORIES) -> DataFrame:
    """Secrets of each text: doc_id, spans (array of start, end, kind, owners, repositories, live); one row per row of docs.

    docs: doc_id, text, the owner column and, if named, the repository column
    (otherwise each doc_id is its own repository); others are ignored.  start
    and end are code points, end exclusive.  kind: assign, access, hex, and bare,
    which the method adds: a free-standing mixed run of 20 or more characters
    that overlaps no other span and is live.  live: fewer than ``copied_owners`` owners hold the
    value, and it isn't so that two or more of them hold it in ``copied_repositories`` or more repositories.

    Null texts are empty; null owners count as one owner together, null repositories as one; a value
    repeated in a text counts once for its owner; repeated rows give repeated rows.  A very long text is
    passed a fixed number of times; spans of one text are as many as it holds.  Empty tables give empty results.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    found = scratch.table(_found(docs, owner, repository, F.monotonically_increasing_id(), [F.col("doc_id").cast("long").alias("doc_id")]))
    held = _judged(found, copied_owners, copied_repositories, scratch)
    spans = held.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "owners", "repositories", "live"))).alias("spans"))
    names = F.array(*map(F.lit, KINDS))
    spans = spans.select("row", F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.element_at(names, x["kind"] + 1).alias("kind"), x["owners"].alias("owners"), x["repositories"].alias("repositories"), x["live"].alias("live"))).alias("spans"))
    none = F.expr("cast(array() as array<struct<start:int,end:int,kind:string,owners:bigint,repositories:bigint,live:boolean>>)")
    return found.select("row", "doc_id").join(spans, "row", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def report(docs: DataFrame, **options) -> DataFrame:
    """scan() as counts and digests: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied; one row per row of docs.

    Nulls, empty and very long texts, ties, repeated rows, empty tables and further columns as in scan();
    a text without spans has zeros, the digest of '' and empty spans.
    """
    said = lambda c: F.concat_ws(",", F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE_KINDS))
    n = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan(docs, **options).select(
        "doc_id", n("assign"), n("access"), n("hex"), F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda x: x["live"])).cast("long").alias("n_live"), F.size(F.filter("spans", lambda x: ~x["live"])).cast("long").alias("n_copied"),
    )


def redact(docs: DataFrame, owner: str = "source", repository: str | None = None, mask: str = "[secret]", copied_owners: int = COPIED_OWNERS, copied_repositories: int = COPIED_REPOSITORIES) -> DataFrame:
    """docs with live-looking secrets masked in their texts; widely copied examples stay.

    All rows and columns stay as they are, whatever the columns' names, null and empty texts too.  Of overlapping spans
    the first is masked from its start, and nothing of the others is left.  Spans are found again by
    doc_id (null is a value) and a digest of the text, so rows that share an id but not a text are masked each by its own spans,
    and repeated rows alike.
    """
    scratch = Scratch(docs.sparkSession, "redact")
    ident, digest = F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    found = scratch.table(_found(docs, owner, repository, F.monotonically_increasing_id(), [ident.alias("ident"), digest.alias("digest")]))
    live = _judged(found, copied_owners, copied_repositories, scratch).where("live").select("row", "start", "end")
    # from: where the text goes on before this mask; a span that begins before an earlier one ends has no mask of its own
    before = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    cuts = live.withColumn("from", F.coalesce(F.max("end").over(before), F.lit(0)))
    cuts = cuts.groupBy("row").agg(F.array_sort(F.collect_list(F.when(F.col("start") >= F.col("from"), F.struct("from", "start")))).alias("cuts"), F.max("end").alias("rest"))
    names = dict(zip(("ident", "digest", "cuts", "rest"), fresh(docs.columns, "ident", "digest", "cuts", "rest")))
    cuts = found.select("row", "ident", "digest").join(cuts, "row").dropDuplicates(["ident", "digest"]).select(*[F.col(k).alias(v) for k, v in names.items()])
    cuts = scratch.table(cuts)
    joined = docs.withColumn(names["ident"], ident).withColumn(names["digest"], digest).join(cuts, [names["ident"], names["digest"]], "left")
    cut, rest, text = F.col(names["cuts"]), F.col(names["rest"]), F.col("text").cast("string")
    # finding a place counts letters from the front: a text with many masks is taken apart into letters once
    few = F.concat(F.array_join(F.transform(cut, lambda x: F.concat(F.substring(text, x["from"] + 1, x["start"] - x["from"]), F.lit(mask))), ""), F.substring(text, rest + 1, F.length(text)))
    part = lambda l, a, n: F.array_join(F.slice(l, a + 1, n), "")
    # the letters are one element of an array, so that they are made once and not for each mask
    many = F.transform(F.array(F.split(text, "")), lambda l: F.concat(F.array_join(F.transform(cut, lambda x: F.concat(part(l, x["from"], x["start"] - x["from"]), F.lit(mask))), ""), part(l, rest, F.size(l))))[0]
    masked = F.when(cut.isNull(), F.col("text")).when(F.size(cut) <= 64, few).otherwise(many)
    return joined.select([masked.alias(c) if c.lower() == "text" else col for c, col in zip(docs.columns, all_of(joined, docs.columns))])


def _sql_runs(name: str, pattern: str, value: str) -> str:
    """Matches of a pattern with places: what stands between matches, and the matches, add up."""
    return f"""
{name}_parts as (select rid, unnest(range(len(m))) as i, unnest(m) as m, unnest(g[1:len(m)]) as g from (select rid, regexp_extract_all(text, '{pattern}') as m, string_split_regex(text, '{pattern}') as g from d where regexp_matches(text, '{pattern}'))),
{name}_at as (select rid, m, {value} as v, sum(length(g) + length(m)) over (partition by rid order by i) - length(m) as s, sum(length(g) + length(m)) over (partition by rid order by i) as e from {name}_parts)"""


_SQL_ASSIGN = "(?i:" + ASSIGN.replace("'", "''") + ")"
SQL = f"""
with d as (select row_number() over () as rid, doc_id, coalesce(source, '') as owner, coalesce(text, '') as text from documents),
{_sql_runs("assign", _SQL_ASSIGN, f"regexp_extract(m, '{_SQL_ASSIGN}', 2)")},
{_sql_runs("access", "AKIA[A-Z0-9]+", "m")},
{_sql_runs("hex", "[0-9a-f]+", "m")},
{_sql_runs("run", "[A-Za-z0-9+/_=.-]+", "split_part(m, '.', 1)")},
base as (
  select rid, 0 as o, 'assign' as kind, s, e, v from assign_at where length(v) >= 6
  union all select rid, 1, 'access', s, e, v from access_at where length(v) >= 20
  union all select rid, 2, 'hex', s, e, v from hex_at where length(v) >= 24),
bare as (select rid, 3 as o, 'bare' as kind, s, s + length(v) as e, v from run_at where length(v) >= 20 and regexp_matches(v, '[0-9]') and regexp_matches(v, '[a-z]') and regexp_matches(v, '[A-Z]')),
cand as (select * from base union all select * from bare x where not exists (select 1 from base b where b.rid = x.rid and b.s < x.e and x.s < b.e)),
owned as (select v, not (count(distinct owner) >= {COPIED_OWNERS} or count(distinct owner) > 1 and count(distinct doc_id) >= {COPIED_REPOSITORIES}) as live from cand join d using (rid) group by 1),
spans as (select c.*, o.live from cand c join owned o using (v) where c.kind <> 'bare' or o.live),
agg as (
  select rid, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
    string_agg(kind || ':' || s || ':' || e, ',' order by s, o) filter (kind <> 'bare') as base, string_agg(kind || ':' || s || ':' || e, ',' order by s, o) as spans,
    count(*) filter (live) as n_live, count(*) filter (not live) as n_copied
  from spans group by 1)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_live, 0) as n_live, coalesce(n_copied, 0) as n_copied
from d left join agg using (rid)
"""
