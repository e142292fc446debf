"""What several operators need: Arrow chunks, written components (scratch tables come from ``tidewatch.scratch``)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch, fresh, importable, shared_dir  # noqa: F401  operators take them from here

#: Bytes of text handled at once in a Python worker (a longer text is one chunk).
CHUNK_BYTES = 1 << 20


def all_of(df: DataFrame, columns: list[str]) -> list:
    """Columns by name, whatever characters the names have."""
    return [df["`" + c.replace("`", "``") + "`"] for c in columns]


def chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of batch with about ``most`` bytes of text each, at least one row."""
    n = batch.num_rows
    if not n:
        return
    col = batch.column(column)
    sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
    at = size = 0
    for i in range(n):
        if i > at and size + sizes[i] > most:
            yield batch.slice(at, i - at)
            at, size = i, 0
        size += int(sizes[i])
    yield batch.slice(at)


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over edges (a, b), for nodes with an edge.

    Alternating large-star and small-star rounds; every round is aggregations
    with map-side combine and equi-joins, and its result is written.  The edge
    set ends as a forest of stars whose centres are the smallest nodes; a centre is a hot
    key, so what is joined to its edges is a written table too: adaptive execution can
    then split the hot side, or broadcast a table that its size shows to be small.  A round
    whose edge set equals the one before it (count and order-free hash) is the last.
    """
    a, b = F.col("a"), F.col("b")
    cur = scratch.table(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())

    def mark(df: DataFrame):
        return df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()

    before = mark(cur)
    while True:
        # large star: every larger neighbour of a node is tied to the node's smallest neighbour
        both = cur.select("u", "v").unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low_u = scratch.table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = cur.select(F.col("v").alias("u"), F.col("u").alias("w")).join(low_u, "u").select(F.col("w").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        # small star: a node and its smaller neighbours are tied to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(low.select("u", F.col("m").alias("v")))
        new = scratch.table(small.distinct())
        scratch.drop(cur, low_u)
        cur, after = new, mark(new)
        if after == before:
            break
        before = after
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
