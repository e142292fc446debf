"""Canonical releases of any size: ordered part files, committed as a whole, with a digest that tasks compute.

The parts of a release, one after the other, are byte for byte the canonical text that ``sinks.write_snapshot`` writes
through the driver: a header, then rows by key.  Parts are written to a folder beside the release's, which takes the
release's name once all of them and the manifest are there; a release is therefore whole or absent, whatever tasks or
drivers are lost.

The digest is a tree.  Leaves are the SHA-256 of consecutive blocks of the text, cut by bytes and not by parts,
so any number of parts gives the same leaves; nodes are the SHA-256 of up to FAN digests below them as text (or one node is that
of all leaves); the root takes in the length.  It is computed from the files, by tasks that each read some blocks, for releases and for any other files.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import SNAPSHOT_COLUMNS
from ..scratch import Scratch, hadoop, importable

LEAF_BYTES, FAN = 1 << 20, 1024
MANIFEST = "manifest.json"


def _line(columns: tuple[str, ...]) -> Column:
    """A row as canonical text: fields with a tab, a quote or a line end are quoted."""
    def field(c: str) -> Column:
        v = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
        return F.when(v.rlike('[\\t\\n\\r"]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)

    return F.concat_ws("\t", *map(field, columns))


def parts(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the data files of a folder, or of one file; numbers in names count as numbers."""
    fs, at = hadoop(spark, path)
    found = [(str(s.getPath().toString()), int(s.getLen())) for s in fs.listStatus(at) if s.isFile()]
    natural = lambda p: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", p.rpartition("/")[2])]
    return sorted([f for f in found if not f[0].rpartition("/")[2].startswith(("_", ".", MANIFEST))], key=lambda f: natural(f[0]))


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), re.sub("^file:/*", "/", path)
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _leaves(files, leaf_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, ends = files.value
        for batch in batches:
            out = []
            for i in batch.column("id").to_pylist():
                at, to, h = i * leaf_bytes, min((i + 1) * leaf_bytes, int(ends[-1])), hashlib.sha256()
                k = int(np.searchsorted(ends, at, side="right"))
                while at < to:
                    fs, p = _open(paths[k])
                    first = int(ends[k - 1]) if k else 0
                    n = min(to, int(ends[k])) - at
                    with fs.open_input_file(p) as f:
                        got = f.read_at(n, at - first)
                    if len(got) != n:
                        raise OSError(f"{paths[k]} is shorter than listed")
                    h.update(got)
                    at, k = at + n, k + 1
                out.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.string())], names=["id", "digest"])

    return run


def _flat(level: DataFrame) -> str:
    """The SHA-256 of all leaf digests in order.  A hash of one text can't be parted, so they are streamed, in rows of FAN digests and one partition at a time."""
    scratch, h = Scratch(level.sparkSession, "leaves"), hashlib.sha256()
    leaves = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "digest"))), lambda x: x["digest"]), "")
    rows = scratch.table(level.groupBy(F.expr(f"id div {FAN}").alias("id")).agg(leaves.alias("leaves")))
    for r in rows.sort("id").toLocalIterator():
        h.update(r["leaves"].encode())
    scratch.drop(rows)
    return h.hexdigest()


def tree_digest(spark: SparkSession, files: list[tuple[str, int]], leaf_bytes: int = LEAF_BYTES, fan: int | None = FAN) -> str:
    """Root over files (path, bytes) as if they were one; no files count as no bytes.  fan: None for one node over all leaves."""
    importable(spark)
    ends = np.cumsum([0, *[n for _, n in files]])[1:]
    total = int(ends[-1]) if len(ends) else 0
    n, top = -(-total // leaf_bytes), hashlib.sha256(b"").hexdigest()
    if n:
        held = spark.sparkContext.broadcast(([p for p, _ in files], ends))
        level = spark.range(0, n, 1, min(n, max(spark.sparkContext.defaultParallelism, n // 64))).mapInArrow(_leaves(held, leaf_bytes), "id long, digest string")
        while fan:
            node = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "digest"))), lambda x: x["digest"]), "")
            level, n = level.groupBy(F.expr(f"id div {fan}").alias("id")).agg(F.sha2(node, 256).alias("digest")), -(-n // fan)
            if n == 1:
                break
        top = level.first()["digest"] if fan else _flat(level)
        held.unpersist()
    return hashlib.sha256(f"{total}:{leaf_bytes}:{top}".encode()).hexdigest()


def file_digests(spark: SparkSession, path: str, leaf_bytes: int = LEAF_BYTES) -> dict[str, str]:
    """The root of each file of a folder; a file of any size is read by many tasks."""
    return {f[0]: tree_digest(spark, [f], leaf_bytes) for f in parts(spark, path)}


def write_release(records: DataFrame, path: str, columns: tuple[str, ...] = SNAPSHOT_COLUMNS, key: str = "isolate_key", partitions: int | None = None, leaf_bytes: int = LEAF_BYTES, fan: int | None = FAN) -> dict:
    """Write the canonical text of records as a release; returns its manifest: digest, bytes, leaf_bytes, parts.

    A release that is there already is replaced by the whole new one, or stays if anything fails.
    """
    spark = records.sparkSession
    order = [key, *[c for c in columns if c != key]]
    rows = records.select(F.lit(1).alias("kind"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])
    head = spark.range(1, numPartitions=1).select(F.lit(0).alias("kind"), *[F.lit(c).alias(c) for c in columns])
    every, by = head.unionByName(rows), ["kind", *order]
    dealt = every.repartitionByRange(partitions, *by) if partitions else every.repartitionByRange(*by)
    staging = f"{path.rstrip('/')}.{uuid.uuid4().hex[:12]}.staging"
    fs, at = hadoop(spark, staging)
    try:
        dealt.sortWithinPartitions(*by).select(_line(columns).alias("value")).write.text(staging)
        files = parts(spark, staging)
        manifest = {"digest": tree_digest(spark, files, leaf_bytes, fan), "bytes": sum(n for _, n in files), "leaf_bytes": leaf_bytes, "fan": fan, "parts": [[p.rpartition("/")[2], n] for p, n in files], "columns": list(columns)}
        out = fs.create(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{staging}/{MANIFEST}"))
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        place, old = hadoop(spark, path)[1], hadoop(spark, f"{staging}.old")[1]
        had = fs.exists(place)
        if had and not fs.rename(place, old):
            raise OSError(f"{path} can't be replaced")
        if not fs.rename(at, place):
            if had:
                fs.rename(old, place)
            raise OSError(f"{path} can't be written")
        if had:
            fs.delete(old, True)
    except BaseException:
        fs.delete(at, True)
        raise
    return manifest


def read_manifest(spark: SparkSession, path: str) -> dict:
    text = spark.read.text(f"{path}/{MANIFEST}", wholetext=True).first()
    return json.loads(text["value"])


def verify_release(spark: SparkSession, path: str) -> str:
    """ok, changed (other bytes or parts than the manifest's) or missing."""
    fs, at = hadoop(spark, f"{path}/{MANIFEST}")
    if not fs.exists(at):
        return "missing"
    want, files = read_manifest(spark, path), parts(spark, path)
    same = [[p.rpartition("/")[2], n] for p, n in files] == want["parts"] and tree_digest(spark, files, want["leaf_bytes"], want.get("fan", FAN)) == want["digest"]
    return "ok" if same else "changed"


def read_release(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a release; empty fields stay empty text.  Its header stands in the first part only."""
    columns = read_manifest(spark, path)["columns"]
    schema = ", ".join(f"`{c}` string" for c in columns)
    rows = spark.read.schema(schema).csv(path, sep="\t", header=False, multiLine=True, escape='"', lineSep="\n", pathGlobFilter="part-*").na.fill("")
    is_head = F.lit(True)
    for c in columns:
        is_head = is_head & (F.col(f"`{c}`") == c)
    return rows.where(~is_head)
