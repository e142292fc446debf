"""Periodic runs of words: aligned blocks found again at a distance, extended both ways.

A run is a stretch of consecutive words with smallest period q, at least ``least`` words and
two periods long, that no neighbouring word extends with that period.  Such a stretch of
length L has L - q words that stand again q words later.  An aligned block of 2**k words fits into
any 2 * 2**k - 1 words, so each distance has a scale: the largest block that must lie whole within those
L - q words.  For each scale the document's aligned blocks, as sequences of word numbers, are the
keys of an Aho-Corasick automaton, which is run over the words where a block could stand again;
an occurrence at a distance of that scale is a seed.  Seeds are extended word by word in both
directions, and stretches that are long enough and whose period isn't a multiple of a smaller one are the runs.

Work.  Before blocks become keys, those go that can't stand again in reach: some word of theirs doesn't
come again within the scale's greatest distance, or they lie deep inside a run with a period
that a block holds whole, where all seeds belong to multiples of that period.  Keys go into
automata of bounded size, so a scale costs time and memory linear in the words, and there are about log2(n) scales.

Each text is handled by itself in one pass over the rows, without a shuffle.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import chunks, importable

LEAST = 12
#: Words in the keys of one automaton (a single longer block is one by itself).
LETTERS = 1 << 18


def scales(n: int, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(block, first distance, last distance) for all distances up to n / 2, ascending."""
    out: list[tuple[int, int, int]] = []
    q = 1
    while q <= n // 2:
        room = max(q, least - q)
        block = 1 << ((room + 1).bit_length() - 2)
        last = min(n // 2, 4 * block - 2) if q >= least - q else q
        if out and out[-1][0] == block and out[-1][2] == q - 1:
            out[-1] = (block, out[-1][1], last)
        else:
            out.append((block, q, last))
        q = last + 1
    return out


def _seeds(words: list[int], blocks: list[int], size: int, first: int, last: int) -> list[tuple[int, int]]:
    """(distance, place) of blocks that stand again at a distance of first to last."""
    out = []
    many = max(1, LETTERS // size)
    for g in range(0, len(blocks), many):
        places: dict[tuple, list[int]] = {}
        for i in blocks[g : g + many]:
            places.setdefault(tuple(words[i : i + size]), []).append(i)
        known = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, at in places.items():
            known.add_word(key, at)
        known.make_automaton()
        # where these blocks can stand again
        stretches: list[list[int]] = []
        for i in blocks[g : g + many]:
            a, z = i + first, min(len(words), i + last + size)
            if stretches and a <= stretches[-1][1]:
                stretches[-1][1] = z
            else:
                stretches.append([a, z])
        for a, z in stretches:
            for end, at in known.iter(tuple(words[a:z])):
                p = a + end - size + 1
                out += [(p - i, i) for i in at[bisect_left(at, p - last) : bisect_right(at, p - first)]]
    out.sort()
    return out


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common beginning of two arrays, read in growing steps."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        differ = np.flatnonzero(a[at : min(n, at + step)] != b[at : min(n, at + step)])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, step * 4
    return n


def _primitive(root: np.ndarray) -> bool:
    """Whether a root isn't a shorter one repeated."""
    d = len(root)
    rest, p = d, 2
    while rest > 1:
        if p * p > rest:
            p = rest
        if rest % p == 0:
            if (root[d // p :] == root[: d - d // p]).all():
                return False
            while rest % p == 0:
                rest //= p
        p += 1
    return True


def find_runs(words: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """All runs of an array of word numbers as (start, length, period), by start, then period."""
    n = len(words)
    if n < max(2, least):
        return []
    order = np.argsort(words, kind="stable")
    again = np.full(n, n, dtype=np.int64)
    same = words[order[1:]] == words[order[:-1]]
    again[order[:-1][same]] = (order[1:] - order[:-1])[same]
    listed: list[int] | None = None
    runs: list[tuple[int, int, int]] = []
    for size, first, last in scales(n, least):
        near = np.zeros(n + 1, dtype=np.int64)
        np.cumsum(again <= last, out=near[1:])
        if near[n] < size:
            continue
        at = np.arange(0, n - first - size + 1, size)
        at = at[near[at + size] - near[at] == size]
        if len(at) and runs:
            known = np.array(sorted(runs), dtype=np.int64)
            to = known[:, 0] + known[:, 1]
            widest = np.maximum.accumulate(to)
            # the run that reaches farthest of those that begin up to here
            holder = np.maximum.accumulate(np.where(to == widest, np.arange(len(to)), 0))
            j = np.searchsorted(known[:, 0], at, side="right") - 1
            k = holder[np.maximum(j, 0)]
            at = at[~((j >= 0) & (to[k] >= np.minimum(at + last + size, n)) & (known[k, 2] <= size))]
        if not len(at):
            continue
        listed = listed or words.tolist()
        distance = done = 0
        for d, i in _seeds(listed, at.tolist(), size, first, last):
            if d != distance:
                distance, done = d, 0
            if i < done:
                continue
            done = i + _agree(words[i:], words[i + d :])
            start = i - _agree(words[:i][::-1], words[: i + d][::-1])
            if done - start + d >= max(least, 2 * d) and _primitive(words[start : start + d]):
                runs.append((start, done - start + d, d))
    return sorted(set(runs), key=lambda r: (r[0], r[2]))


def _scan(least: int):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                counts, runs, kept = [], [], []
                for text in part.column("text").cast(pa.large_binary()).to_pylist():
                    words = (text or b"").split()  # bytes split at ASCII white space
                    number: dict[bytes, int] = {}
                    found = find_runs(np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64), least)
                    counts.append(len(words))
                    runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                    if found:
                        edge = np.zeros(len(words) + 1, dtype=np.int64)
                        for s, n, q in found:
                            edge[s + q] += 1
                            edge[s + n] -= 1
                        words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(runs, kind), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed; one row per row of docs.

    docs: doc_id, text; other columns, whatever their names, are ignored.  Words are what ASCII white space
    separates, unchanged.  collapsed has the words joined by one space, without those that any run contains
    after its first period.  Null, empty and wordless texts have no words, no runs and an empty collapsed
    text; very long texts are searched whole; repeated rows give repeated rows; equal
    runs found at several places of a period are one; an empty table gives an empty one.
    """
    importable(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scan(least), "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def _digest(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def report(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """periodic_runs() as figures of the longest run (ties: smallest start, then period) and digests of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("less"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    return periodic_runs(docs, least).withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.back")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.less")).alias("period"),
        F.expr("1000 * best.length div -best.less").alias("exponent_milli"),
        _digest(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")).alias("runs_sha256"), _digest(F.col("collapsed")).alias("collapsed_sha256"),
    )


def with_repeats(docs: DataFrame) -> DataFrame:
    """docs with the texts the query is asked for: of every tenth document by the checksum of its id, the words from some place on repeat.

    With h = crc32(doc_id as text) and g = h div 10, documents with h % 10 = 0 and n > 0 words have, from
    word a = g % n on, the p = 1 + (n - a) div (3 + g % 8) words from there again and again, up to n words.  A null
    doc_id leaves the text as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select("doc_id", "text", F.when(h % 10 == 0, F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)")).alias("w"), F.expr("crc32(cast(cast(doc_id as string) as binary)) div 10").alias("g"))
    placed = chosen.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.expr("cast(g % n as int)"))).withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    again = F.expr("concat_ws(' ', slice(w, 1, a), slice(flatten(array_repeat(slice(w, a + 1, p), cast((n - a) div p + 1 as int))), 1, n - a))")
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), again).otherwise(F.col("text")).alias("text"))


SQL = r"""
with ids as (select row_number() over () as rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
crc as (select rid, doc_id, w, len(w) as n, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) as h from ids),
place as (select rid, doc_id, w, n, h % 10 = 0 and n > 0 as hit, (h // 10) % greatest(n, 1) as a, h // 10 as g from crc),
doc as (select rid, doc_id, n, case when hit then list_transform(range(n), lambda i: w[1 + case when i < a then i else a + (i - a) % (1 + (n - a) // (3 + g % 8)) end]) else w end as w from place),
wd as (select rid, n, unnest(w) as word, unnest(range(n)) as i from doc),
pair as (select x.rid, x.i, y.i - x.i as q from wd x join wd y on x.rid = y.rid and x.word = y.word and y.i > x.i and 2 * (y.i - x.i) <= x.n),
isle as (select rid, q, i, i - row_number() over (partition by rid, q order by i) as grp from pair),
stretch as (select rid, q, min(i) as s, count(*) + q as len from isle group by rid, q, grp having count(*) + q >= greatest(12, 2 * q)),
runs as (select * from stretch a where not exists (select 1 from stretch b where b.rid = a.rid and b.q < a.q and b.s <= a.s and b.s + b.len >= a.s + a.len)),
gone as (select distinct rid, unnest(range(s + q, s + len)) as i from runs),
kept as (select rid, string_agg(word, ' ' order by i) as t from wd where not exists (select 1 from gone where gone.rid = wd.rid and gone.i = wd.i) group by rid),
agg as (select rid, count(*) as n_runs, first(struct_pack(s := s, len := len, q := q) order by len desc, s, q) as best, string_agg(s || ',' || len || ',' || q || chr(10), '' order by s, q) as lines from runs group by rid)
select d.doc_id, coalesce(n_runs, 0)::bigint as n_runs, best.s::bigint as start, best.len::bigint as length, best.q::bigint as period, (1000 * best.len // best.q)::bigint as exponent_milli, sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(t, '')) as collapsed_sha256
from doc d left join agg using (rid) left join kept using (rid)
"""
