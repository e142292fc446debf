"""Repeated passages across documents: winnowed anchors, windows grown around them, words removed.

A window is ``size`` consecutive words; a word goes if a window that covers it also stands in a document with a smaller id.

Seeds.  Of the ``size - ANCHOR + 1`` runs of ANCHOR words inside a window the one with the smallest hash is the window's
anchor.  Equal windows choose equal anchors, so a window that stands in two documents has an anchor that does.  One
aggregation over the distinct anchors of all documents (the smallest and the largest id of each) tells which those are.

Extension.  Around each seed the match is grown word by word both ways as far as ``size`` words reach: every
window that chose this anchor is one way to grow it.  Documents are not joined in pairs, for a passage with n
copies would make n * n of them: windows grown from seeds are sorted by hash and id over all partitions,
and in that order the first row of equal windows has the smallest id, so each row is held against that
one alone.  Windows next to each other that are found so make up the maximal repeats, which are never shorter than ``size``.

Hot passages.  A range sort by (hash, id) cuts the copies of one window wherever a partition is full; a partition
only has to know how the one before it ended, which is one row for each partition.

Which anchors are seeds is told to the tasks by a bit map of at most 2**MAX_BITS bits (sixteen for each seed, as
long as that suffices).  It has no false negatives, so it decides only about work: beyond its bound more windows are grown
than have to be, and at worst all of them are sorted; the result is the same.  Windows are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from .shared import Scratch, all_of, chunks, fresh

U = np.uint64
SIZE, ANCHOR = 13, 5
MAX_BITS = 29
#: A row's place: 32 bits of its text's hash, 31 bits for the window's first word.
_PLACE_BITS = 31
_NONE = np.iinfo(np.uint64).max


def _anchors(words: bt.Words, h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of each window, and the hash of its anchor."""
    k = min(ANCHOR, size)
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U)
    grams, at = bt.windows(words, h, k)
    every = np.full(len(h), _NONE, dtype=U)
    every[at] = grams
    least = every[:n].copy()
    for j in range(1, size - k + 1):
        np.minimum(least, every[j : n + j], out=least)
    ok = np.flatnonzero(words.doc[:n] == words.doc[size - 1 :])
    return ok, least[ok]


def _seed_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                words = bt.Words(part.column("text"), lower=False)
                first, anchor = _anchors(words, words.hashes(), size)
                ids = part.column("doc_id").to_numpy()[words.doc[first]] if len(first) else np.zeros(0, np.int64)
                new = np.ones(len(first), dtype=bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (ids[1:] != ids[:-1])
                anchor, ids = anchor[new], ids[new]
                order = np.argsort(anchor)
                anchor, ids = anchor[order], ids[order]
                at = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(anchor) else np.zeros(0, np.int64)
                low, high = (np.minimum.reduceat(ids, at), np.maximum.reduceat(ids, at)) if len(at) else (ids, ids)
                yield pa.RecordBatch.from_arrays([pa.array(anchor[at].view(np.int64)), pa.array(low, pa.int64()), pa.array(high, pa.int64())], names=["h", "low", "high"])

    return run


class _Bits:
    """Whether the leading bits of a hash are those of a seed."""

    def __init__(self, bits: int, pages: list[tuple[int, bytes]]):
        self.shift = U(64 - bits)
        self.map = np.zeros(1 << (bits - 3), dtype=np.uint8)
        for page, held in pages:
            self.map[page * 4096 : page * 4096 + len(held)] = np.frombuffer(held, dtype=np.uint8)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        at = (h >> self.shift).astype(np.int64)
        return (self.map[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _bits(seeds: DataFrame, most: int) -> _Bits:
    """The bit map of written seeds (h); its pages are made by an aggregation, and bounded by 2**most bits."""
    bits = min(most, max(15, math.ceil(math.log2(16 * max(1, seeds.count())))))
    at = F.shiftrightunsigned("h", 64 - bits) + 1  # numbered from 1 by the functions
    pages = seeds.select(F.bitmap_bucket_number(at).alias("page"), F.bitmap_bit_position(at).alias("at")).groupBy("page").agg(F.bitmap_construct_agg("at").alias("held"))
    return _Bits(bits, [(r["page"] - 1, bytes(r["held"])) for r in pages.collect()])


def _window_rows(size: int, seeds):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: _Bits = seeds.value
        for batch in batches:
            for part in chunks(batch, "text"):
                words = bt.Words(part.column("text"), lower=False)
                h = words.hashes()
                first, anchor = _anchors(words, h, size)
                keep = known(anchor)
                first = first[keep]
                window = bt.windows(words, h, size)[0][keep]
                doc = words.doc[first]
                text = part.column("digest").to_numpy().view(U) & U(0xFFFFFFFF)
                place = (text[doc] << U(_PLACE_BITS)) | (first - words.first[doc]).astype(U)
                yield pa.RecordBatch.from_arrays([pa.array(window.view(np.int64)), pa.array(part.column("doc_id").to_numpy()[doc], pa.int64()), pa.array(place.view(np.int64))], names=["h", "doc_id", "place"])

    return run


_LATER = "kind int, doc_id long, place long, part int, first long, first_id long, last long, last_id long"


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (h, doc_id): kind 0 are those with a smaller id before them among equal h.

    kind 1: rows of the partition's first h without one in this partition.  kind 2: how the partition begins and ends
    (h, smallest id), one row.
    """
    part = TaskContext.get().partitionId()
    begin = last = None
    names = [x.split()[0] for x in _LATER.split(", ")]
    for batch in batches:
        if not batch.num_rows:
            continue
        h, ids, place = (batch.column(c).to_numpy() for c in ("h", "doc_id", "place"))
        new = np.concatenate([[True], h[1:] != h[:-1]])
        at = np.flatnonzero(new)
        least = ids[at].copy()
        if last is not None and last[0] == h[0]:
            least[0] = last[1]
        if begin is None:
            begin = (int(h[0]), int(least[0]))
        last = (int(h[-1]), int(least[-1]))
        hit = ids > least[np.cumsum(new) - 1]
        keep = np.flatnonzero(hit | (h == begin[0]))
        kind = np.where(hit[keep], 0, 1).astype(np.int32)
        where, none = pa.array(np.full(len(keep), part, dtype=np.int32)), pa.nulls(len(keep), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(ids[keep]), pa.array(place[keep]), where, none, none, none, none], names=names)
    if begin:
        one = lambda x: pa.array([x], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), one(None), one(None), pa.array([part], pa.int32()), one(begin[0]), one(begin[1]), one(last[0]), one(last[1])], names=names)


def _continued(borders: list) -> list[int]:
    """Partitions whose first h began in an earlier one with a smaller id."""
    out, held = [], None
    for r in sorted(borders, key=lambda r: r["part"]):
        if held and held[0] == r["first"]:
            if held[1] < r["first_id"]:
                out.append(r["part"])
            if r["first"] == r["last"]:
                continue
        held = (r["last"], r["last_id"])
    return out


def _with_hits(docs: DataFrame, size: int, max_bits: int) -> tuple[DataFrame, str]:
    """docs with a column of the first words of their windows that also stand in a document with a smaller id, and its name."""
    scratch = Scratch(docs.sparkSession, "substrings")
    sc = docs.sparkSession.sparkContext
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    seeds = scratch.table(texts.mapInArrow(_seed_rows(size), "h long, low long, high long").groupBy("h").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("h"))
    known = sc.broadcast(_bits(seeds, max_bits))
    scratch.drop(seeds)
    rows = texts.withColumn("digest", F.xxhash64("text")).mapInArrow(_window_rows(size, known), "h long, doc_id long, place long")
    found = scratch.table(rows.repartitionByRange("h", "doc_id").sortWithinPartitions("h", "doc_id").mapInArrow(_later, _LATER))
    known.unpersist()
    goes_on = _continued(found.where("kind = 2").collect())  # one row for each partition
    hits = found.where((F.col("kind") == 0) | ((F.col("kind") == 1) & F.col("part").isin(goes_on)))
    ident, digest, firsts = fresh(docs.columns, "ident", "digest", "firsts")
    hits = hits.groupBy(F.col("doc_id").alias(ident), F.expr(f"shiftright(place, {_PLACE_BITS})").alias(digest)).agg(F.collect_set((F.col("place").bitwiseAND((1 << _PLACE_BITS) - 1)).cast("int")).alias(firsts))
    mine = docs.withColumn(ident, F.col("doc_id").cast("long")).withColumn(digest, F.xxhash64(F.col("text").cast("string")).bitwiseAND(0xFFFFFFFF))
    joined = mine.join(hits, [ident, digest], "left")
    return joined.select(*all_of(joined, docs.columns), firsts), firsts


def _covered(n: int, firsts: list[int] | np.ndarray, size: int) -> np.ndarray:
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, firsts, 1)
    np.add.at(edge, np.asarray(firsts) + size, -1)
    return np.cumsum(edge[:-1]) > 0


def _spans(mark: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mark.astype(np.int8), [0]])))
    return [{"first": a, "last": z} for a, z in zip(edge[::2].tolist(), edge[1::2].tolist())]


def _cut(size: int, firsts: str, names: list[str] | None):
    """Rows of _with_hits(): their figures and kept words, or (names) the rows themselves with the kept words as text."""
    spans = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                texts, n_words, repeats = [], [], []
                hits = part.column(firsts)
                for i, text in enumerate(part.column("text").cast(pa.large_binary()).to_pylist()):
                    words, found = (text or b"").split(), hits[i].values  # bytes split at ASCII white space
                    n_words.append(len(words))
                    if found is None:
                        repeats.append([])
                        texts.append(text if names else b" ".join(words))
                    else:
                        mark = _covered(len(words), found.to_numpy(), size)
                        repeats.append(_spans(mark))
                        texts.append(b" ".join([words[j] for j in np.flatnonzero(~mark).tolist()]))
                kept = pa.array(texts, pa.binary()).cast(pa.string())
                if names:
                    yield pa.RecordBatch.from_arrays([kept if name == "text" else part.column(name) for name in names], names=names)
                else:
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(repeats, spans), kept], names=["doc_id", "n_words", "repeats", "kept"])

    return run


def repeats(docs: DataFrame, size: int = SIZE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, n_words, repeats (maximal runs of removed words [first, last)) and kept (the other words, joined by one space); one row per row of docs.

    docs: doc_id, text; other columns, whatever their names, are ignored.  Words are what ASCII white space
    separates, unchanged.  Null and wordless texts have no words; texts of less than ``size`` words have no
    window and stay whole; very long texts are read whole.  Of documents with one passage that with the smallest id keeps it; rows
    that share an id don't remove each other's words, and a repeated row gives a repeated result.  A row without an
    id is compared with nothing and stays whole.  An empty table gives an empty one.
    """
    marked, firsts = _with_hits(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), size, max_bits)
    return marked.mapInArrow(_cut(size, firsts, None), "doc_id long, n_words long, repeats array<struct<first:int,last:int>>, kept string")


def remove_repeats(docs: DataFrame, size: int = SIZE, max_bits: int = MAX_BITS) -> DataFrame:
    """docs without the words repeats() finds; texts that lose words have the others joined by one space, other texts stay as they are.

    All columns stay, whatever their names; a text that loses all words becomes empty, its row stays.
    """
    marked, firsts = _with_hits(docs, size, max_bits)
    return marked.mapInArrow(_cut(size, firsts, docs.columns), docs.schema)


def report(docs: DataFrame, size: int = SIZE, max_bits: int = MAX_BITS) -> DataFrame:
    """repeats() as counts and a digest of the kept words."""
    gone = F.aggregate("repeats", F.lit(0).cast("long"), lambda a, r: a + r["last"] - r["first"])
    return repeats(docs, size, max_bits).select("doc_id", "n_words", gone.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
with doc as (select row_number() over () as rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select rid, doc_id, unnest(range(1, len(w) - 11)) as i, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) as g from doc where len(w) >= 13),
low as (select g, min(doc_id) as doc_id from win group by 1),
gone as (select distinct rid, unnest(range(i, i + 13)) as i from win join low using (g) where win.doc_id > low.doc_id),
n as (select rid, count(*) as n, list(i) as at from gone group by 1)
select doc.doc_id, len(w)::bigint as n_words, coalesce(n.n, 0)::bigint as n_removed,
  sha256(array_to_string(case when n.n is null then w else list_filter(list_transform(range(1, len(w) + 1), lambda i: case when not list_contains(n.at, i) then w[i] end), lambda x: x is not null) end, ' ')) as kept_sha256
from doc left join n using (rid)
"""
