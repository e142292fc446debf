"""Sinks: canonical snapshots, digests, ranked tables, split outputs."""

from __future__ import annotations

import csv
import hashlib
import io
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.store import SNAPSHOT_COLUMNS
from ..scratch import fresh, hadoop


def canonical_lines(records: DataFrame, columns: tuple[str, ...] = SNAPSHOT_COLUMNS, key: str = "isolate_key") -> Iterator[str]:
    """Byte-stable tab-separated text, ordered by key; streamed, one partition at a time."""
    def line(values) -> str:
        out = io.StringIO()
        csv.writer(out, delimiter="\t", lineterminator="\n").writerow(values)
        return out.getvalue()

    yield line(columns)
    for r in records.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]).orderBy(key, *[c for c in columns if c != key]).toLocalIterator():
        yield line(r)


def snapshot_sha256(records: DataFrame, **options) -> str:
    h = hashlib.sha256()
    for x in canonical_lines(records, **options):
        h.update(x.encode())
    return h.hexdigest()


def write_snapshot(records: DataFrame, path: str, **options) -> str:
    """Write the canonical text, return its sha256.  The working copy for queries is write_working_copy()."""
    h = hashlib.sha256()
    with open(path, "w", encoding="utf-8", newline="") as f:
        for x in canonical_lines(records, **options):
            h.update(x.encode())
            f.write(x)
    return h.hexdigest()


def write_parts(records: DataFrame, path: str, columns: tuple[str, ...] = SNAPSHOT_COLUMNS, key: str = "isolate_key") -> str:
    """The canonical text as part files whose names follow the order of key, each with the header; returns content_digest().

    For snapshots of any size: a range-partitioned sort, written by tasks.  write_snapshot() makes one file for small ones.
    """
    text = records.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])
    order = [key, *[c for c in columns if c != key]]
    text.repartitionByRange(*order).sortWithinPartitions(*order).write.csv(path, sep="\t", header=True, escape='"', emptyValue="")
    return content_digest(text, columns)


def content_digest(records: DataFrame, columns: tuple[str, ...] = SNAPSHOT_COLUMNS) -> str:
    """A digest of the rows that depends on neither order nor partitions: sums over the rows' own digests, taken by tasks."""
    row = F.sha2(F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])), 256)
    part = lambda i: F.sum(F.conv(row.substr(15 * i + 1, 15), 16, 10).cast("decimal(38,0)")).alias(f"p{i}")
    sums = records.agg(F.count("*").alias("n"), *[part(i) for i in range(4)]).first()
    return hashlib.sha256(":".join(map(str, sums)).encode()).hexdigest()


def write_working_copy(records: DataFrame, path: str, release: str) -> None:
    """Parquet, partitioned by release; a release that is written again replaces itself only."""
    records.withColumn("release", F.lit(release)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("release").parquet(path)


def write_index(index: DataFrame, path: str) -> str:
    return write_snapshot(index, path, columns=tuple(index.columns), key=index.columns[0])


def ranked_table(ranked: DataFrame, distance: str = "dist", score: str = "score") -> DataFrame:
    """Columns as text: distance with three decimals or no_pose, score with one or NA."""
    fixed = lambda c, n: F.format_string(f"%.{n}f", F.col(c).cast("double"))
    return ranked.withColumn(distance, F.when(F.col(distance).isNull(), "no_pose").otherwise(fixed(distance, 3))).withColumn(score, F.when(F.col(score).isNull(), "NA").otherwise(fixed(score, 1)))


def write_split(df: DataFrame, keep: Column, kept: str, excluded: str) -> None:
    """Rows to two places, each row to exactly one (null counts as excluded), in one pass over df; both places are replaced."""
    spark, (side,) = df.sparkSession, fresh(df.columns, "kept")
    staging = f"{kept.rstrip('/')}.{uuid.uuid4().hex[:12]}.staging"
    fs, at = hadoop(spark, staging)
    df.withColumn(side, F.coalesce(keep, F.lit(False))).write.partitionBy(side).parquet(staging)
    for value, path in (("true", kept), ("false", excluded)):
        part, place = hadoop(spark, f"{staging}/{side}={value}")[1], hadoop(spark, path)[1]
        fs.delete(place, True)
        if not fs.exists(part):
            spark.createDataFrame([], df.schema).write.parquet(path)
        elif not (fs.exists(place.getParent()) or fs.mkdirs(place.getParent())) or not fs.rename(part, place):
            raise OSError(f"{path} can't be written")
    fs.delete(at, True)


def candidate_report(ranked: DataFrame, top: int = 10, listed: int = 1000) -> str:
    """A table of the first ``listed`` ranked rows and details of the first ``top``; no more reach the driver, all are counted."""
    rows, total = [r.asDict() for r in ranked.where(F.col("rank") <= listed).orderBy("rank").collect()], ranked.count()
    cols = list(rows[0]) if rows else ranked.columns
    out = ["# Candidates", "", f"{total} rows" + (f", the first {listed} of them" if total > listed else ""), "", "| " + " | ".join(cols) + " |", "|" + "---|" * len(cols)]
    out += ["| " + " | ".join("" if r[c] is None else str(r[c]) for c in cols) + " |" for r in rows]
    for r in rows[:top]:
        out += ["", f"## {r['rank']}. {r.get('name', '')}", *[f"- {c}: {r[c]}" for c in cols if c not in ("rank", "name")]]
    return "\n".join([*out, ""])


def key_values(path: str, **values) -> None:
    """Append key=value lines, as build steps read them."""
    with open(path, "a", encoding="utf-8") as f:
        f.writelines(f"{k}={v}\n" for k, v in values.items())


def shell_assignments(config: dict[str, dict]) -> str:
    return "; ".join(f"{k.upper()}={' '.join(map(str, v)) if isinstance(v, list) else v}" for section in config.values() for k, v in section.items())
