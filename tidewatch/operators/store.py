"""Versioned snapshots of records: normalise, compare, rebuild as of a date, sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import temporal as T
from ..functions import text as X

# fixed values: the snapshot's columns in order
SNAPSHOT_COLUMNS = (
    "isolate_key", "target_acc", "biosample_acc", "run_acc", "asm_acc", "collection_date", "target_creation_date", "country",
    "geo_loc_name", "lat_lon", "erg11_call", "resistance_source",
)
INDEX_COLUMNS = ("release_tag", "path", "sha256", "records", "dropped", "retrieved", "source")
PENDING_READS, PENDING_NONE = "pending:sra-recaller", "pending:no-reads"


def normalize(raw: DataFrame, numeric_version: bool = False, observe: Observation | None = None) -> DataFrame:
    """Raw feed rows as snapshot records, one for each isolate.

    Rows without an accession have no key and are dropped; an Observation counts
    them (metrics ``rows`` and ``dropped``) in the same scan.  Of several versions
    of an accession the greatest stays: as text by default (so .2 beats .10),
    or as a number.  Input columns: target_acc, Run, geo_loc_name,
    target_creation_date, collection_date, biosample_acc, asm_acc, lat_lon.
    """
    target, run, geo = X.clean_nullish("target_acc"), X.clean_nullish("Run"), X.clean_nullish("geo_loc_name")
    rows = raw.select(
        X.isolate_key(target).alias("isolate_key"), target.alias("target_acc"), X.clean_nullish("biosample_acc").alias("biosample_acc"), run.alias("run_acc"),
        X.clean_nullish("asm_acc").alias("asm_acc"), X.clean_nullish("collection_date").alias("collection_date"), X.clean_nullish("target_creation_date").alias("target_creation_date"),
        X.country(geo).alias("country"), geo.alias("geo_loc_name"), X.clean_nullish("lat_lon").alias("lat_lon"), F.lit("").alias("erg11_call"),
        F.when(run != "", PENDING_READS).otherwise(PENDING_NONE).alias("resistance_source"),
    )
    if observe is not None:
        rows = rows.observe(observe, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("isolate_key") == "").alias("dropped"))
    return latest_version(rows.where("isolate_key != ''"), "isolate_key", "target_acc", numeric_version).select(*SNAPSHOT_COLUMNS)


def latest_version(df: DataFrame, key: str, version: str, numeric: bool = False) -> DataFrame:
    """One row of each key: the one with the greatest version; ties by the whole row, so the result is stable."""
    by = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(version, r"\.(\d+)$", 1), F.lit("")), F.lit("999999999999")), F.lit(0)) if numeric else F.col(version)
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max(F.struct(by.alias("_by"), *[F.col(c) for c in rest])).alias("_row")).select(key, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def diff(old: DataFrame, new: DataFrame, key: str = "isolate_key", version: str = "target_acc") -> DataFrame:
    """(key, status) of keys that are added, removed, or revised (present in both, version changed)."""
    a, b = old.select(key, F.col(version).alias("_old"), F.lit(True).alias("_in_old")), new.select(key, F.col(version).alias("_new"), F.lit(True).alias("_in_new"))
    status = F.when(F.col("_in_old").isNull(), "added").when(F.col("_in_new").isNull(), "removed").when(~F.col("_old").eqNullSafe(F.col("_new")), "revised")
    return a.join(b, key, "full_outer").select(key, status.alias("status")).where("status is not null")


def changes(old: DataFrame, new: DataFrame, key: str = "isolate_key") -> DataFrame:
    """Rows of new that old lacks with weight 1 and rows of old that new lacks with weight -1, by whole rows: what added, removed and revised records change.

    key: rows are compared key by key, so both sides meet in one join on it; a key stands once in a snapshot.
    """
    row = lambda df, n: df.select(F.col(key).alias("_k"), F.struct(*df.columns).alias(n))
    both = row(old, "_old").join(row(new.select(*old.columns), "_new"), "_k", "full_outer").where(~F.col("_old").eqNullSafe(F.col("_new")))
    sides = F.filter(F.array(F.struct(F.col("_old").alias("r"), F.lit(-1).alias("weight")), F.struct(F.col("_new").alias("r"), F.lit(1).alias("weight"))), lambda x: x["r"].isNotNull())
    return both.select(F.explode(sides).alias("c")).select("c.r.*", "c.weight")


def as_of(records: DataFrame, date: str, created: str = "target_creation_date") -> DataFrame:
    """records with placed: baseline (created up to date), later, or unplaceable (no usable date)."""
    day = T.day_prefix(created)
    return records.withColumn("placed", F.when(day.isNull(), "unplaceable").when(day <= date[:10], "baseline").otherwise("later"))


def baseline_as_of(records: DataFrame, date: str) -> DataFrame:
    """What was known on a date."""
    return as_of(records, date).where("placed = 'baseline'").drop("placed")


def upsert(index: DataFrame, row: DataFrame, key: str = "release_tag") -> DataFrame:
    """index with rows of equal key replaced, ordered by the number that ends the key."""
    number = F.try_to_number(F.nullif(F.regexp_extract(key, r"(\d+)$", 1), F.lit("")), F.lit("999999999999"))
    return index.join(row, key, "left_anti").unionByName(row).orderBy(number.asc_nulls_first(), key)


def seeded_sample(df: DataFrame, key: str, seed: int, n: int = 0) -> DataFrame:
    """The first n rows (0: all) in an order that depends on key and seed only, never on partitions."""
    ordered = df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary")), key)
    return ordered.limit(n) if n else ordered


def pending_with_run(records: DataFrame) -> DataFrame:
    """Records that wait for a call and have reads."""
    return records.where((F.col("resistance_source") == PENDING_READS) & (X.ws_strip(F.coalesce("run_acc", F.lit(""))) != ""))


def plan_counts(records: DataFrame, n: int = 0) -> DataFrame:
    """One row: total, pending, without_run, attempted and distinct runs of a fill."""
    pending = F.col("resistance_source").startswith("pending")
    ready = (F.col("resistance_source") == PENDING_READS) & (X.ws_strip(F.coalesce("run_acc", F.lit(""))) != "")
    out = records.agg(F.count("*").alias("total"), F.count_if(pending).alias("pending"), F.count_if(pending & ~ready).alias("without_run"), F.count_if(ready).alias("ready"), F.count_distinct(F.when(ready, X.first_run("run_acc"))).alias("distinct_runs"))
    return out.withColumn("attempted", F.least("ready", F.lit(n)) if n else F.col("ready"))


def fill_calls(records: DataFrame, calls: DataFrame) -> DataFrame:
    """A new version of records with calls (isolate_key, call, source) put in; others stay as they are."""
    c = calls.select("isolate_key", F.col("call").alias("_call"), F.col("source").alias("_source"))
    out = records.join(c, "isolate_key", "left")
    return out.withColumn("erg11_call", F.coalesce("_call", "erg11_call")).withColumn("resistance_source", F.coalesce("_source", "resistance_source")).select(*records.columns)


def resume(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What of todo has no output yet."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def fill_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: n, and how many rows have each column filled."""
    return df.agg(F.count("*").alias("n"), *[F.count_if(X.filled(c)).alias(c) for c in columns])


def pull_stats(records: DataFrame) -> DataFrame:
    """One row: records, those with reads, and those with a usable creation date."""
    return records.agg(F.count("*").alias("records"), F.count_if(X.ws_strip(F.coalesce("run_acc", F.lit(""))) != "").alias("with_reads"), F.count_if(T.parse_day("target_creation_date").isNotNull()).alias("dated"))


def month_histogram(df: DataFrame, column: str) -> DataFrame:
    """(month, n) of values that begin with a four-digit year and have a month."""
    v = F.col(column)
    return df.where((F.length(v) >= 7) & v.rlike(r"^\d{4}")).groupBy(F.substring(v, 1, 7).alias("month")).agg(F.count("*").alias("n"))


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values (blank: NULL), ties by value."""
    return df.groupBy(F.when(X.filled(column), F.col(column)).otherwise("NULL").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k)
