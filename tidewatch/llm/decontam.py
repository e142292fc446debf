"""Benchmark decontamination: a broadcast hash set of test n-grams, scanned over all training windows.

Words are runs of digits, lower-cased letters and anything beyond ASCII.  A
window is ``n`` consecutive words of a benchmark item; an item of fewer words,
but not none, is one window.  The distinct windows, with the items that have
them, are broadcast in blocks of bounded size: the blocks' bytes are summed on
the executors before anything is collected, and a benchmark beyond one block is
scanned in several passes, one block at a time: a pass writes its hits and its
broadcast is destroyed before the next one is built.  A hit by hash is verified word
for word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from .shared import Scratch, all_of, chunks, fresh

U = np.uint64
WINDOW = 10
#: Bytes of windows and item ids in one broadcast.
BLOCK_BYTES = 64 << 20
_BITS = 22


def _benchmark_windows(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                words = bt.Words(part.column("text"), bt.ALNUM)
                ids, of, size = part.column("item_id").to_pylist(), [], []
                text: list[bytes] = []
                for i in range(words.rows):
                    a, z = int(words.first[i]), int(words.first[i + 1])
                    k = min(n, z - a)
                    for j in range(a, z - k + 1) if k else ():
                        text.append(words.text(j, j + k))
                        of.append(ids[i])
                        size.append(k)
                yield pa.RecordBatch.from_arrays([pa.array(of, pa.string()), pa.array(text, pa.binary()), pa.array(size, pa.int32())], names=["item_id", "window", "k"])

    return run


class WindowSet:
    """Windows by length: sorted hashes, a bit map over their leading bits, the windows' text and items."""

    def __init__(self, rows: list[tuple[bytes, int, list[str]]]):
        self.items = sorted({x for _, _, ids in rows for x in ids})
        number = {x: i for i, x in enumerate(self.items)}
        self.by_length = {}
        for k in sorted({r[1] for r in rows}):
            text = [r[0] for r in rows if r[1] == k]
            words = bt.Words(pa.array(text, pa.binary()), bt.ALNUM)
            h, _ = bt.windows(words, words.hashes(), k)
            order = np.argsort(h, kind="stable")
            bits = np.zeros(1 << _BITS, dtype=bool)
            bits[(h >> U(64 - _BITS)).astype(np.int64)] = True
            ids = [[number[x] for x in r[2]] for r in rows if r[1] == k]
            self.by_length[k] = (h[order], bits, [text[i] for i in order], [ids[i] for i in order])

    def hits(self, words: bt.Words, h: np.ndarray) -> tuple[np.ndarray, dict[int, set[int]]]:
        """A mark for each word inside a window, and the items found in each row."""
        edge = np.zeros(len(h) + 1, dtype=np.int64)
        found: dict[int, set[int]] = {}
        for k, (known, bits, text, items) in self.by_length.items():
            w, at = bt.windows(words, h, k)
            maybe = np.flatnonzero(bits[(w >> U(64 - _BITS)).astype(np.int64)])
            place = np.searchsorted(known, w[maybe])
            same = place < len(known)
            same[same] = known[place[same]] == w[maybe[same]]
            for m, p in zip(at[maybe[same]].tolist(), place[same].tolist()):
                got = words.text(m, m + k)
                while p < len(known) and text[p] != got and p + 1 < len(known) and known[p + 1] == known[p]:
                    p += 1
                if text[p] == got:
                    edge[m] += 1
                    edge[m + k] -= 1
                    found.setdefault(int(words.doc[m]), set()).update(items[p])
        return np.cumsum(edge[:-1]) > 0, found


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    """Runs of marked words as [first, past last)."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


_SCAN = "row long, doc_id long, n_words long, runs array<struct<first:int,last:int,from:int,to:int>>, items array<string>"


def _scan(broadcast):
    run_type = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("from", pa.int32()), ("to", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: WindowSet = broadcast.value
        for batch in batches:
            for part in chunks(batch, "text"):
                words = bt.Words(part.column("text"), bt.ALNUM)
                hit, found = known.hits(words, words.hashes())
                runs, items = [], []
                any_hit = np.add.reduceat(np.concatenate([hit, [False]]).astype(np.int64), np.minimum(words.first[:-1], len(hit))) if words.rows else []
                for i in range(words.rows):
                    a, z = int(words.first[i]), int(words.first[i + 1])
                    if z > a and any_hit[i]:
                        # runs as words, and as bytes of the text
                        base = int(words.offsets[i])
                        runs.append([{"first": s, "last": e, "from": int(words.start[a + s]) - base, "to": int(words.end[a + e - 1]) - base} for s, e in _runs(hit[a:z])])
                    else:
                        runs.append([])
                    items.append([known.items[x] for x in sorted(found.get(i, ()))])
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), pa.array(words.counts, pa.int64()), pa.array(runs, run_type), pa.array(items, pa.list_(pa.string()))], names=["row", "doc_id", "n_words", "runs", "items"])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Where benchmark windows occur in docs: doc_id, n_words, runs, items; one row per row of docs.

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored.
    runs are the maximal runs of hit words, as words [first, last) and as UTF-8
    bytes [from, to) of the text; items the sorted ids (as strings) of items
    with a window in the text.  Null and wordless texts have no words and no hits;
    null and wordless items have no windows; items that share a window are all
    found; an item without an id counts as the id ''.  Repeated rows give repeated rows; very long texts are scanned
    whole; without docs there are no rows, without items no hits.
    """
    scratch = Scratch(docs.sparkSession, "decontam")
    known, blocks = _known(benchmark, n, block_bytes, scratch)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # several passes find each other's rows by a number that a written table fixes
    text = scratch.table(text.withColumn("row", F.monotonically_increasing_id())) if blocks > 1 else text.withColumn("row", F.lit(0).cast("long"))
    return _passes(text, known, blocks, scratch).drop("row")


def _known(benchmark: DataFrame, n: int, block_bytes: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """Distinct windows with the items that have them, written; and how many broadcasts they take."""
    item = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text"))
    known = scratch.table(item.mapInArrow(_benchmark_windows(n), "item_id string, window binary, k int").groupBy("window", "k").agg(F.array_sort(F.collect_set("item_id")).alias("items")))
    size = known.agg(F.sum(F.octet_length("window") + F.lit(64) + F.aggregate("items", F.lit(0), lambda a, x: a + F.octet_length(x) + 8))).first()[0] or 0
    return known, max(1, math.ceil(size / block_bytes))


def _set(known: DataFrame, blocks: int, block: int):
    """The window set of one block, as a broadcast variable."""
    mine = known if blocks == 1 else known.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == block)
    return known.sparkSession.sparkContext.broadcast(WindowSet([(bytes(r["window"]), r["k"], r["items"]) for r in mine.toLocalIterator()]))


def _passes(text: DataFrame, known: DataFrame, blocks: int, scratch: Scratch) -> DataFrame:
    """row, doc_id, n_words, runs, items of text (row, doc_id, text), over all blocks."""
    scan = lambda held: text.select("row", "doc_id", "text").mapInArrow(_scan(held), _SCAN)
    if blocks == 1:
        return scan(_set(known, 1, 0))
    hits = None
    for b in range(blocks):
        held = _set(known, blocks, b)
        # every row once, then only rows with hits
        found = scratch.table(scan(held) if b == 0 else scan(held).where(F.size("items") > 0).withColumn("n_words", F.lit(None).cast("long")))
        held.destroy()
        hits = found if hits is None else hits.unionByName(found)
    # runs of several passes can touch or overlap: flatten, order, merge
    flat = hits.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    last = lambda a: F.get(a, F.size(a) - 1)
    merged = F.aggregate(
        "runs", F.expr("cast(array() as array<struct<first:int,last:int,from:int,to:int>>)"),
        lambda a, x: F.when((F.size(a) > 0) & (last(a)["last"] >= x["first"]), F.concat(
            F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))),
            F.array(F.struct(last(a)["first"].alias("first"), F.greatest(last(a)["last"], x["last"]).alias("last"), last(a)["from"].alias("from"), F.greatest(last(a)["to"], x["to"]).alias("to"))))).otherwise(F.concat(a, F.array(x))),
    )
    return scratch.table(flat.select("row", "doc_id", "n_words", merged.alias("runs"), "items"))


def report(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, **options) -> DataFrame:
    """contamination() as counts: doc_id, n_words, n_hit, n_items, items_sha256, contaminated; one row per row of docs.

    Nulls, empty and very long texts, ties, repeated rows, empty tables and further columns as in contamination();
    a text without hits has zeros and the digest of ''.
    """
    n_hit = F.aggregate("runs", F.lit(0), lambda a, r: a + r["last"] - r["first"]).cast("long")
    found = contamination(docs, benchmark, n, **options)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256).alias("items_sha256")).withColumn("contaminated", F.col("n_hit") > 0)


def _kept_text(text: str, runs: list[tuple[int, int]], words: int, hit: int, share: float | None) -> str | None:
    """text without its runs of bytes; None if too many of its words are hit."""
    if share is not None and hit > share * words:
        return None
    raw, out, at = text.encode(), [], 0
    for a, z in runs:
        out.append(raw[at:a])
        at = z
    return b"".join([*out, raw[at:]]).decode()


def _rewritten(part: pa.RecordBatch, texts: list, keep: np.ndarray, names: list[str]) -> pa.RecordBatch:
    cols = [pa.array(texts, pa.string()) if name == "text" else part.column(name) for name in names]
    return pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(keep))


def _clean(broadcast, share: float | None):
    """Scan and cut in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: WindowSet = broadcast.value
        for batch in batches:
            for part in chunks(batch, "text"):
                words = bt.Words(part.column("text"), bt.ALNUM)
                hit, found = known.hits(words, words.hashes())
                texts, keep = part.column("text").to_pylist(), np.ones(part.num_rows, dtype=bool)
                for i in found:
                    a, z = int(words.first[i]), int(words.first[i + 1])
                    base = int(words.offsets[i])
                    runs = [(int(words.start[a + s]) - base, int(words.end[a + e - 1]) - base) for s, e in _runs(hit[a:z])]
                    texts[i] = _kept_text(texts[i], runs, z - a, int(hit[a:z].sum()), share)
                    keep[i] = texts[i] is not None
                yield _rewritten(part, texts, keep, part.schema.names)

    return run


def _cut(share: float | None, names: list[str], n_words: str, found: str):
    """Cut by runs that were found in several passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                texts, keep = part.column("text").to_pylist(), np.ones(part.num_rows, dtype=bool)
                for i, (n, runs) in enumerate(zip(part.column(n_words).to_pylist(), part.column(found).to_pylist())):
                    if runs:
                        texts[i] = _kept_text(texts[i], [(r["from"], r["to"]) for r in runs], n, sum(r["last"] - r["first"] for r in runs), share)
                        keep[i] = texts[i] is not None
                yield _rewritten(part, texts, keep, names)

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, drop_share: float | None = 0.5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with benchmark passages cut out of their texts, and without documents that are mostly benchmark.

    A document goes when more than ``drop_share`` of its words are hit (None: none
    goes); from others the hit words are removed, with what stands between them.  All columns
    stay as they are, whatever their names; null and wordless texts stay; very long texts are cut like
    others; repeated rows are treated alike; without docs or benchmark items nothing changes.
    """
    scratch = Scratch(docs.sparkSession, "decontam")
    known, blocks = _known(benchmark, n, block_bytes, scratch)
    if blocks == 1:
        return docs.mapInArrow(_clean(_set(known, 1, 0), drop_share), docs.schema)
    row, n_words, runs = fresh(docs.columns, "row", "n_words", "runs")
    rows = scratch.table(docs.withColumn(row, F.monotonically_increasing_id()))
    found = _passes(rows.select(F.col(row).alias("row"), F.lit(None).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), known, blocks, scratch)
    hit = found.where(F.size("runs") > 0).select(F.col("row").alias(row), F.col("n_words").alias(n_words), F.col("runs").alias(runs))
    joined = rows.join(hit, row, "left")
    return joined.select(*all_of(joined, docs.columns), n_words, runs).mapInArrow(_cut(drop_share, docs.columns, n_words, runs), docs.schema)


SQL = r"""
with low as (select doc_id, regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g') as t, row_number() over () as rid from documents),
doc as (select rid, doc_id, list_filter(string_split(t, ' '), lambda x: x <> '') as w from low),
item as (select cast(item_id as varchar) as item_id, list_filter(string_split(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') as w from benchmark),
bw as (select distinct item_id, least(len(w), 10) as k, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) as g from item where len(w) > 0),
ks as (select distinct k from bw),
dw as (select d.rid, ks.k, unnest(range(1, len(d.w) - ks.k + 2)) as i, unnest(list_transform(range(1, len(d.w) - ks.k + 2), lambda i: array_to_string(d.w[i:i + ks.k - 1], ' '))) as g from doc d, ks where len(d.w) >= ks.k),
hit as (select dw.rid, dw.i, dw.k, bw.item_id from dw join bw on dw.k = bw.k and dw.g = bw.g),
places as (select distinct rid, unnest(range(i, i + k)) as p from (select distinct rid, i, k from hit)),
n as (select rid, count(*) as n_hit from places group by 1),
m as (select rid, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as ids from hit group by 1)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n.n_hit, 0)::bigint as n_hit, coalesce(m.n_items, 0)::bigint as n_items, sha256(coalesce(m.ids, '')) as items_sha256, coalesce(n.n_hit, 0) > 0 as contaminated
from doc d left join n on n.rid = d.rid left join m on m.rid = d.rid
"""
