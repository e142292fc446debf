"""Collocations: phrases of several words that occur together more than their parts would suggest.

Counting.  Every task adds the n-grams of its texts to a count-min sketch of its own; sketches are merged cell by
cell, in blocks that are shuffled and summed.  A merged cell never holds less than any of its n-grams
occurs, so an n-gram with a cell below ``least`` is rare for certain.  Cells stop counting at ``least``, hence
what the second pass needs is one bit for each cell.  That pass reads the texts again and counts the n-grams
whose cells are all full, exactly and as text, with partial aggregation before the shuffle; of those the
ones below ``least`` (let through by shared cells) are dropped.  Nothing frequent can be lost.

The sketch has about a cell for each 32 bytes of text in each of its rows, up to 2**MAX_CELL_BITS.  Beyond
that bound it lets more rare n-grams through to the exact counts, which stay right.

Scores.  Each phrase asks for the counts of its parts at every cut by joins on (lang, part); the cut that scores
lowest counts.  Phrases that mostly occur within one longer phrase are subsumed by it.  Ranks within a language come from
a window whose limit every task applies to its own rows first.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytetext as bt
from .shared import Scratch, chunks

U = np.uint64
LEAST, LONGEST, TOP, SHARE = 10, 3, 2000, 50
SKETCH_ROWS, MAX_CELL_BITS = 2, 27
#: Bytes of text that a task counts at least, where there are so many for each core.
TASK_BYTES = 64 << 20
#: Cells of a block of the sketch.
BLOCK = 1 << 16
#: Bytes of text at once: sketched, and counted (more of a phrase before the shuffle).
_SKETCH_CHUNK, _CHUNK = 1 << 20, 4 << 20
#: Counts that a task hands over at once.
_ROWS = 1 << 16

#: Bytes that end a piece, and bytes of words.
PIECE_END = np.zeros(256, dtype=bool)
PIECE_END[[ord(c) for c in ".,;:!?"]] = PIECE_END[10:14] = True
IN_WORD = ~PIECE_END
IN_WORD[[32, 9]] = False


class _Grams:
    """Words of a chunk, the language of each, and its n-grams within pieces."""

    def __init__(self, part: pa.RecordBatch, longest: int):
        self.words = w = bt.Words(part.column("text"), IN_WORD)
        langs = part.column("lang").dictionary_encode()
        self.langs = langs.dictionary.to_pylist()
        self.lang = langs.indices.to_numpy()[w.doc] if len(w.start) else np.zeros(0, np.int32)
        salt = np.array([bt.mix(np.array([int.from_bytes(hashed[:8], "little")], dtype=U))[0] for hashed in map(_name, self.langs)], dtype=U)
        h = w.hashes()
        # joined: whether a word goes on in the piece of the word before it
        ends = np.flatnonzero(PIECE_END[w.buf])
        joined = np.zeros(len(h), dtype=bool)
        joined[1:] = (np.searchsorted(ends, w.start[1:]) == np.searchsorted(ends, w.end[:-1])) & (w.doc[1:] == w.doc[:-1])
        self.by_size = {}
        acc, ok = h * bt._MULTIPLIERS[0], np.ones(len(h), dtype=bool)
        for k in range(1, longest + 1):
            if k > 1:
                acc = acc[:-1] + h[k - 1 :] * bt._MULTIPLIERS[k - 1]
                ok = ok[:-1] & joined[k - 1 :]
            at = np.flatnonzero(ok)
            self.by_size[k] = (bt.mix((acc[at] + U(k)) ^ salt[self.lang[at]]) if len(at) else np.zeros(0, U), at)

    def text(self, at: np.ndarray, k: int) -> pa.Array:
        parts = [bt.strings(self.words, at + j) for j in range(k)]
        return pc.binary_join_element_wise(*parts, " ") if k > 1 else parts[0]


def _name(lang: str) -> bytes:
    raw = (lang or "").encode()
    return int(sum((b + 1) * pow(257, i, 1 << 61) for i, b in enumerate(raw)) % (1 << 61)).to_bytes(8, "little")


def _cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (bt.mix(h + U(0x9E3779B97F4A7C15 * (row + 1) % 2**64)) >> U(64 - bits)).astype(np.int64)


def _packed(block: np.ndarray) -> bytes:
    """A block as a bit for each cell and the counts of those that aren't empty, both as Huffman codes."""
    some = np.packbits(block > 0).tobytes()
    code = zlib.compressobj(strategy=zlib.Z_HUFFMAN_ONLY)
    return code.compress(len(block).to_bytes(4, "little") + some + block[block > 0].tobytes()) + code.flush()


def _unpacked(cells: bytes, kind: type) -> np.ndarray:
    raw = zlib.decompress(cells)
    n = int.from_bytes(raw[:4], "little")
    some = np.unpackbits(np.frombuffer(raw, dtype=np.uint8, count=-(-n // 8), offset=4), count=n).astype(bool)
    out = np.zeros(n, dtype=np.uint64)
    out[some] = np.frombuffer(raw, dtype=kind, offset=4 + -(-n // 8))
    return out


def _sketch(longest: int, least: int, rows: int, bits: int):
    """One sketch of a task's texts, as compressed blocks that aren't empty."""
    kind = np.uint8 if least < 256 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((rows, 1 << bits), dtype=kind)
        for batch in batches:
            for part in chunks(batch, "text", _SKETCH_CHUNK):
                grams = _Grams(part, longest)
                h, n = np.unique(np.concatenate([g for g, _ in grams.by_size.values()]), return_counts=True)
                n = np.minimum(n, least)
                for r in range(rows):
                    at = _cells(h, r, bits)
                    order = np.argsort(at)
                    at, m = at[order], n[order]
                    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
                    if len(first):
                        table[r, at[first]] = np.minimum(table[r, at[first]].astype(np.int64) + np.add.reduceat(m, first), least).astype(kind)
        size = min(BLOCK, 1 << bits)
        for r in range(rows):
            for b in range((1 << bits) // size):
                block = table[r, b * size : (b + 1) * size]
                if block.any():
                    yield pa.RecordBatch.from_arrays([pa.array([r * ((1 << bits) // size) + b], pa.int32()), pa.array([_packed(block)], pa.binary())], names=["block", "cells"])

    return run


def _merge(least: int):
    """Blocks of one number come one after the other: their sums, as one bit for each cell that is full."""
    kind = np.uint8 if least < 256 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, None

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(sums >= least).tobytes()], pa.binary())], names=["block", "cells"])

        for batch in batches:
            for block, cells in zip(batch.column("block").to_pylist(), batch.column("cells").to_pylist()):
                got = _unpacked(cells, kind)
                if block == now:
                    sums = np.minimum(sums + got, least)
                    continue
                if now is not None:
                    yield full()
                now, sums = block, got
        if now is not None:
            yield full()

    return run


class _Full:
    """Whether all cells of an n-gram are full."""

    def __init__(self, rows: int, bits: int, blocks: list[tuple[int, bytes]]):
        self.bits = bits
        size = min(BLOCK, 1 << bits) // 8
        flat = np.zeros(rows * (1 << bits) // 8, dtype=np.uint8)
        for b, held in blocks:
            flat[b * size : b * size + len(held)] = np.frombuffer(held, dtype=np.uint8)
        self.rows = flat.reshape(rows, -1)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), dtype=bool)
        for r, held in enumerate(self.rows):
            at = _cells(h, r, self.bits)
            out &= (held[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
        return out


def _survivors(longest: int, full):
    """(lang, phrase, f) of the n-grams that may be frequent, and with an empty phrase the number of words; counted within chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: _Full = full.value
        for batch in batches:
            for part in chunks(batch, "text", _CHUNK):
                grams = _Grams(part, longest)
                langs = pa.array(grams.langs, pa.string())

                def rows(lang: np.ndarray, phrase: pa.Array, f: np.ndarray) -> pa.RecordBatch:
                    return pa.RecordBatch.from_arrays([langs.take(pa.array(lang)), phrase.cast(pa.string()), pa.array(f, pa.int64())], names=["lang", "phrase", "f"])

                n = np.bincount(grams.lang, minlength=len(grams.langs))
                some = np.flatnonzero(n)
                yield rows(some, pa.array([""] * len(some), pa.string()), n[some])
                for k, (h, at) in grams.by_size.items():
                    h, first, n = np.unique(h, return_index=True, return_counts=True)
                    keep = known(h)
                    at, n = at[first[keep]], n[keep]
                    for i in range(0, len(at), _ROWS):
                        some = at[i : i + _ROWS]
                        yield rows(grams.lang[some], grams.text(some, k), n[i : i + _ROWS])

    return run


def frequent(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, sketch_rows: int = SKETCH_ROWS, max_cell_bits: int = MAX_CELL_BITS, task_bytes: int = TASK_BYTES) -> tuple[DataFrame, Scratch]:
    """(lang, phrase, size, f): exact counts of all n-grams of up to ``longest`` words with at least ``least`` occurrences, and with size 0 the words of each lang."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "collocations")
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(max_cell_bits, max(10, math.ceil(math.log2(max(1, size / 32)))))
    # larger tasks count more of a phrase before the shuffle, and send fewer sketches
    texts = texts.coalesce(max(spark.sparkContext.defaultParallelism, math.ceil(size / task_bytes)))
    blocks = texts.mapInArrow(_sketch(longest, least, sketch_rows, bits), "block int, cells binary")
    merged = blocks.repartition("block").sortWithinPartitions("block").mapInArrow(_merge(least), "block int, cells binary")
    held = spark.sparkContext.broadcast(_Full(sketch_rows, bits, [(r["block"], bytes(r["cells"])) for r in merged.collect()]))
    counted = texts.mapInArrow(_survivors(longest, held), "lang string, phrase string, f long")
    exact = counted.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("phrase") == ""))
    out = scratch.table(exact.withColumn("size", F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " ")))))
    held.unpersist()
    return out, scratch


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, share: int = SHARE, **options) -> DataFrame:
    """All phrases of 2 to ``longest`` words that aren't subsumed: lang, phrase, a, l, r, n, score.

    docs: text, lang; other columns, whatever their names, are ignored.  Texts are lower-cased (A-Z), pieces end at one of
    .,;:!? and at line breaks, words are what blanks and tabs separate in a piece; phrases don't cross pieces.
    a, l, r: occurrences of the phrase, of its words before the cut and of those after it; n: words of the lang.
    score: floor(10**6 a a / (l r)) at the cut where it is lowest (ties: the first).  A phrase goes if a longer one of at
    least ``least`` occurrences contains its words and has ``share`` percent of its occurrences.  A null lang counts as 'und',
    null and wordless texts as none, very long texts are read whole, repeated rows count again; no texts give no rows.
    """
    f, scratch = frequent(docs, least, longest, **options)
    f = f.withColumn("w", F.split("phrase", " "))
    words = lambda first, last: F.array_join(F.slice("w", F.lit(first), F.lit(last - first + 1)), " ")  # noqa: E731  words first to last, from 1
    counts = f.where("size > 0").select("lang", F.col("phrase").alias("part"), F.col("f").alias("of"))
    scored = []
    for k in range(2, longest + 1):
        here = f.where(F.col("size") == k).select("lang", "phrase", "size", F.col("f").alias("a"), "w")
        for cut in range(1, k):
            here = here.withColumn("part", words(1, cut)).join(counts, ["lang", "part"]).drop("part").withColumnRenamed("of", f"l{cut}")
            here = here.withColumn("part", words(cut + 1, k)).join(counts, ["lang", "part"]).drop("part").withColumnRenamed("of", f"r{cut}")
        wide = lambda c: F.col(c).cast("decimal(15,0)")
        each = [F.struct(F.expr(f"cast(a as decimal(15,0)) * cast(a as decimal(15,0)) * 1000000 div (cast(l{c} as decimal(15,0)) * cast(r{c} as decimal(15,0)))").alias("score"), F.lit(c).alias("cut"), F.col(f"l{c}").alias("l"), F.col(f"r{c}").alias("r")) for c in range(1, k)]
        scored.append(here.withColumn("best", F.array_min(F.array(*each))).select("lang", "phrase", "a", "best.l", "best.r", "best.score"))
    inside = []
    for k in range(3, longest + 1):
        longer = f.where(F.col("size") == k)
        inside += [longer.select("lang", words(i, i + m - 1).alias("phrase"), "f") for m in range(2, k) for i in range(1, k - m + 2)]
    found = reduce(DataFrame.unionByName, scored)
    if inside:
        holders = reduce(DataFrame.unionByName, inside).groupBy("lang", "phrase").agg(F.max("f").alias("held"))
        found = found.join(holders, ["lang", "phrase"], "left").where(F.col("held").isNull() | (100 * F.col("held") < share * F.col("a"))).drop("held")
    total = f.where("size = 0").select("lang", F.col("f").alias("n"))
    return found.join(total, "lang").select("lang", "phrase", "a", "l", "r", "n", "score")


def top_collocations(docs: DataFrame, top: int = TOP, **options) -> DataFrame:
    """The first ``top`` collocations of each lang by score, then a, then phrase (in order of bytes): lang, rank, phrase, a, l, r, n, score."""
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc())
    return collocations(docs, **options).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
with piece as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as p from documents),
w as (select lang, regexp_extract_all(p, '[^\x20\x09]+') as w from piece),
g as (select lang, 1 as k, unnest(w) as phrase from w
  union all select lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from w where len(w) >= 2
  union all select lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) from w where len(w) >= 3),
n as (select lang, count(*) as n from g where k = 1 group by 1),
f as materialized (select lang, k, phrase, count(*) as f, string_split(phrase, ' ') as s from g group by 1, 2, 3 having count(*) >= 10),
parts as (select lang, k, phrase, f as a, 1 as cut, s[1] as x, case k when 2 then s[2] else s[2] || ' ' || s[3] end as y from f where k > 1
  union all select lang, k, phrase, f, 2, s[1] || ' ' || s[2], s[3] from f where k = 3),
cuts as (select p.*, l.f as l, r.f as r, (a::hugeint * a * 1000000) // (l.f::hugeint * r.f) as score from parts p join f l on l.lang = p.lang and l.phrase = x join f r on r.lang = p.lang and r.phrase = y),
best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
held as (select lang, phrase, max(f) as f from (select lang, s[1] || ' ' || s[2] as phrase, f from f where k = 3 union all select lang, s[2] || ' ' || s[3], f from f where k = 3) group by 1, 2),
kept as (select b.* from best b left join held h on b.k = 2 and h.lang = b.lang and h.phrase = b.phrase where h.f is null or 100 * h.f < 50 * b.a)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score::bigint as score from kept join n using (lang) qualify rank <= 2000
"""
