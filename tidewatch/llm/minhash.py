"""Near-duplicate texts by fast similarity sketching, banding and exact verification.

Sketch.  A set of shingle hashes gets ``coordinates`` values.  In round i of the
first ``coordinates`` rounds every element is hashed into one bin with a value
of leading part i; in the rounds after that, round i puts every element into the
bin of that round.  So each coordinate is filled, earlier rounds always win, and
the share of equal coordinates of two sketches estimates their Jaccard
similarity with Chernoff-type bounds.  Work stops once all bins are filled.

Search.  Equal shingle sets become one class (their smallest doc_id is its
node).  Classes that share a band of the sketch share a bucket.  No bucket emits
its pairs.  First each bucket ties its members to one pivot, the member that meets most
others over all buckets; these pairs are verified and give components.  Then
only buckets whose members lie in several components are looked at again: in
tiles of bounded size, members outside the bucket's largest component are
compared with all members of other components, by whole sketches and by what they
share with the pivot, and pairs that may be links are verified.  Members
already joined need no comparison: a further link could not change anything.
So one stray text in a bucket of a million joined copies costs a million comparisons.

Hot keys.  Buckets are counted with map-side combine and joined to written
tables, whose hot keys adaptive execution splits; a text that many pairs name is
dealt in copies of up to ``FAN`` pairs each.

Verification takes whole shingle sets of whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytetext as bt
from .shared import Scratch, all_of, chunks, components, fresh

U = np.uint64
WORDS, THRESHOLD = 5, 0.8
#: 48 bands of 5 coordinates: a pair of similarity 0.8 is missed with probability 5e-9.
BANDS, BAND_ROWS = 48, 5
#: Members of a tile, and how far below the threshold (in standard deviations) a sketch may agree.
TILE, DEVIATIONS = 1024, 5.0
#: Pairs that one copy of a text serves when pairs are verified.
FAN = 1024
_EMPTY = np.iinfo(np.uint64).max


def sketch(elements: np.ndarray, coordinates: int) -> np.ndarray:
    """The similarity sketch of a non-empty set of distinct 64-bit hashes."""
    out = np.full(coordinates, _EMPTY, dtype=U)
    step, i = max(1, 4096 // len(elements)), 0
    while i < 2 * coordinates:
        rounds = np.arange(i, min(i + step, coordinates if i < coordinates else 2 * coordinates), dtype=U)
        x = bt.mix(elements[None, :] ^ bt.mix(rounds + U(0x5851F42D4C957F2D))[:, None])
        if i < coordinates:
            np.minimum.at(out, (((x >> U(32)) * U(coordinates)) >> U(32)).astype(np.int64).ravel(), ((rounds << U(32))[:, None] | (x & U(0xFFFFFFFF))).ravel())
        else:
            at = (rounds - U(coordinates)).astype(np.int64)
            out[at] = np.minimum(out[at], ((rounds << U(32))[:, None] | (x & U(0xFFFFFFFF))).min(axis=1))
        i += len(rounds)
        if out.max() != _EMPTY:
            break
    return out


def _lists(rows: list[np.ndarray | None]) -> pa.Array:
    """Arrays of numbers as an Arrow list column; None is null."""
    offsets = np.cumsum([0, *(0 if x is None else len(x) for x in rows)])
    values = np.concatenate([np.zeros(0, np.int64), *(x for x in rows if x is not None)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values), mask=pa.array([x is None for x in rows]))


def _scan(words: int, bands: int, band_rows: int):
    t = bands * band_rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = bt.mix(np.arange(bands, dtype=U) + U(1))
        for batch in batches:
            for part in chunks(batch, "text"):
                n, c1, c2, sig, keys = [], [], [], [], []
                for s in bt.shingle_sets(part.column("text"), words):
                    n.append(len(s))
                    a, b = bt.mix(s ^ U(0x1D8E4E27C47D124F)), bt.mix(s + U(0xEB44ACCAB455D165))
                    c1.append(a.sum(dtype=U))
                    c2.append(b.sum(dtype=U))
                    if len(s):
                        m = bt.mix(sketch(s, t))
                        sig.append((m >> U(17)).astype(np.uint8).tobytes())
                        keys.append(bt.mix((m.reshape(bands, band_rows) * bt._MULTIPLIERS[:band_rows]).sum(axis=1, dtype=U) + salt).view(np.int64))
                    else:
                        sig.append(None)
                        keys.append(None)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(np.array(c1, dtype=U).view(np.int64)), pa.array(np.array(c2, dtype=U).view(np.int64)), pa.array(sig, pa.binary()), _lists(keys)],
                    names=["doc_id", "n_shingles", "c1", "c2", "sig", "bands"],
                )

    return run


def _relate(words: int, percent: int, with_rest: bool):
    """Exact sizes of pairs of texts a and b, and which pairs are links.

    rest: 16-bit hashes of what a has beyond b, given from a similarity of a half on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text_a", 1 << 19):
                sizes, rest = [], []
                for x, y in zip(bt.shingle_sets(part.column("text_a"), words), bt.shingle_sets(part.column("text_b"), words)):
                    shared = np.intersect1d(x, y, assume_unique=True)
                    both, union = len(shared), len(x) + len(y) - len(shared)
                    sizes.append((len(x), both, union > 0 and 100 * both >= percent * union))
                    rest.append((np.setdiff1d(x, shared, assume_unique=True) >> U(48)).astype(np.uint16).tobytes() if with_rest and 2 * both >= union else None)
                n, both, link = zip(*sizes)
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(n, pa.int64()), pa.array(both, pa.int64()), pa.array(link, pa.bool_()), pa.array(rest, pa.binary())], names=["a", "b", "n", "both", "link", "rest"])

    return run


def _tiles(coordinates: int, least: float, percent: int):
    """Rows of a tile, sorted by it: pairs of different components that may be links.

    side 0 are members outside the largest component, side 1 all members of one block
    (out: outside the largest component too, so the pair comes up twice and the smaller node's turn counts).

    Two filters.  Sketches must agree in ``least`` coordinates.  And with p the
    bucket's pivot, x and y share at most min(|x & p|, |y & p|) shingles inside p,
    and outside p at most as many as y's rest has hashes among those of x's rest;
    where even that is too little for a link, the pair is none.
    """

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        _, node, comp, side, out, sig, n, both, rest = zip(*rows)
        node, comp, side, out, n, both = (np.array(x) for x in (node, comp, side, out, n, both))
        s = np.frombuffer(b"".join(sig), dtype=np.uint8).reshape(len(node), coordinates)
        known = np.array([x is not None for x in rest])
        # each rest with one hash in front that no rest can have, so that none is empty
        flat = [np.concatenate([[1 << 16], np.frombuffer(x or b"", dtype=np.uint16)]) for x in rest]
        starts = np.concatenate([[0], np.cumsum([len(x) for x in flat])[:-1]])
        flat = np.concatenate(flat).astype(np.int64)
        mark = np.zeros((1 << 16) + 1, dtype=np.int64)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        found: set[tuple[int, int]] = set()
        for i in left:
            other = right[(comp[right] != comp[i]) & (~out[right] | (node[right] > node[i]))]
            other = other[(s[other] == s[i]).sum(axis=1) >= least]
            if len(other) and known[i]:
                mine = flat[starts[i] + 1 : starts[i + 1] if i + 1 < len(starts) else len(flat)]
                mark[mine] = 1
                most = np.minimum(both[i], both[other]) + np.add.reduceat(mark[flat], starts)[other]
                mark[mine] = 0
                other = other[~known[other] | (100 * most >= percent * (n[i] + n[other] - most))]
            found.update((min(int(node[i]), int(node[j])), max(int(node[i]), int(node[j]))) for j in other)
        a, b = zip(*found) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and r[0] != rows[0][0]:
                    yield flush(rows)
                    rows = []
                rows.append(r)
        if rows:
            yield flush(rows)

    return run


def near_duplicates(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, bands: int = BANDS, band_rows: int = BAND_ROWS, tile: int = TILE) -> DataFrame:
    """Classes of near-duplicate texts: doc_id, n_shingles, component_id, kept; one row per row of docs.

    docs: doc_id, text and any other columns, which are ignored.  Words are runs
    of anything but ASCII white space, with A-Z lower-cased.  Two texts are
    linked when their shingle sets have at least ``threshold`` similarity;
    component_id is the smallest doc_id reachable over links.

    An empty table gives an empty one; very long texts are read whole.  Null and blank texts have no shingles and link with nothing.  Rows that share a doc_id count as one
    document (all get the same component), and repeated rows give repeated rows.  A null
    doc_id joins its class's component, or has none (null), and is kept only then.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    t = bands * band_rows
    percent = round(100 * threshold)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scan = scratch.table(text.mapInArrow(_scan(words, bands, band_rows), "doc_id long, n_shingles long, c1 long, c2 long, sig binary, bands array<long>"))

    classes = scan.where("n_shingles > 0 and doc_id is not null").groupBy("c1", "c2", "n_shingles").agg(F.min("doc_id").alias("node"))
    classes = scratch.table(classes)
    # one row of each class, by its smallest doc_id; equal keys on both sides, so no class is a hot key
    reps = scan.join(classes.withColumn("doc_id", F.col("node")), ["c1", "c2", "n_shingles", "doc_id"]).dropDuplicates(["node", "c1", "c2"]).select("node", "n_shingles", "sig", "bands")
    reps = scratch.table(reps)
    keyed = reps.select("node", F.explode("bands").alias("key"))
    sizes = scratch.table(keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
    members = scratch.table(keyed.join(sizes, "key").distinct())
    texts = scratch.table(text.join(members.select(F.col("node").alias("doc_id")).distinct(), "doc_id").distinct())

    def related(pairs: DataFrame, with_rest: bool = False) -> DataFrame:
        pairs = scratch.table(pairs)
        dealt = pairs
        for side, other in ("ab", "ba"):
            fans = scratch.table(pairs.groupBy(side).agg(F.ceil(F.count("*") / FAN).cast("int").alias("fan")))
            copies = texts.join(fans, F.col("doc_id") == F.col(side)).select(side, F.col("text").alias(f"text_{side}"), F.explode(F.sequence(F.lit(0), F.col("fan") - 1)).alias("turn"))
            dealt = dealt.join(fans, side).withColumn("turn", F.pmod(F.xxhash64(other), "fan").cast("int")).drop("fan").join(copies, [side, "turn"]).drop("turn")
        return scratch.table(dealt.select("a", "b", "text_a", "text_b").mapInArrow(_relate(words, percent, with_rest), "a long, b long, n long, both long, link boolean, rest binary"))

    # first: each bucket's members with its pivot
    central = scratch.table(members.groupBy("node").agg(F.sum("size").alias("met")))
    pivots = members.join(central, "node").groupBy("key").agg(F.max(F.struct("met", (-F.col("node")).alias("low"))).alias("top")).select("key", (-F.col("top.low")).alias("pivot"))
    pivots = scratch.table(pivots)
    star = related(members.join(pivots, "key").where("node != pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct(), True)
    links = star.where("link").select("a", "b")
    comps = scratch.table(components(scratch, links))

    # second: buckets that still hold several components, in tiles
    placed = members.join(comps, "node", "left").select("key", "node", F.coalesce("component", "node").alias("comp"))
    largest = placed.groupBy("key", "comp").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", (-F.col("comp")).alias("low"))).alias("top"), F.sum("n").alias("size"))
    blocks = lambda n: F.ceil(n / tile).cast("int")
    open_ = scratch.table(largest.where("top.n < size").select("key", (-F.col("top.low")).alias("main"), blocks(F.col("size") - F.col("top.n")).alias("lefts"), blocks(F.col("size")).alias("rights")))
    least = t * threshold - DEVIATIONS * (t * threshold * (1 - threshold)) ** 0.5
    # what each member shares with its bucket's pivot; the pivot itself has no rest
    rows = placed.join(open_, "key").join(pivots, "key").join(star.select(F.col("a").alias("node"), F.col("b").alias("pivot"), "both", "rest"), ["node", "pivot"], "left").join(reps.select("node", "sig", "n_shingles"), "node")
    rest = F.when(F.col("node") == F.col("pivot"), F.lit(b"")).otherwise(F.col("rest"))
    out = F.col("comp") != F.col("main")
    mine = lambda k: F.pmod(F.xxhash64("node"), F.col(k)).cast("int")
    at = lambda side, l, r: F.struct(F.lit(side).alias("side"), l.alias("l"), r.alias("r"))
    left = F.when(out, F.transform(F.sequence(F.lit(0), F.col("rights") - 1), lambda r: at(0, mine("lefts"), r))).otherwise(F.expr("cast(array() as array<struct<side:int,l:int,r:int>>)"))
    right = F.transform(F.sequence(F.lit(0), F.col("lefts") - 1), lambda l: at(1, l, mine("rights")))
    rows = rows.select("key", "node", "comp", out.alias("out"), "sig", "n_shingles", F.coalesce("both", "n_shingles").alias("both"), rest.alias("rest"), F.explode(F.concat(left, right)).alias("at"))
    rows = rows.select(F.xxhash64("key", "at.l", "at.r").alias("tile"), "node", "comp", "at.side", "out", "sig", "n_shingles", "both", "rest")
    more = rows.repartition("tile").sortWithinPartitions("tile").mapInArrow(_tiles(t, least, percent), "a long, b long").distinct()
    more = related(scratch.table(more)).where("link").select("a", "b")
    if not more.isEmpty():
        old = comps
        comps = scratch.table(components(scratch, links.unionByName(more)))
        scratch.drop(old)
    scratch.drop(texts, members, reps, star, pivots, sizes, central, open_)

    final = classes.join(comps, "node", "left").select("c1", "c2", "n_shingles", F.coalesce("component", "node").alias("component"))
    out = scan.select("doc_id", "n_shingles", "c1", "c2").join(final, ["c1", "c2", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs without near duplicates: of each component the row with the smallest doc_id; all columns stay as they are.

    Every row is judged by its own text, also where rows share a doc_id or have none: of a
    group of equal or near-equal texts one row stays, that with the smallest doc_id (null last; among
    equal ids any one).  Rows with null, empty or blank texts link with nothing and
    all stay; so does each row of another text, whatever its length.  An empty table stays empty.  Columns may have any names.
    """
    scratch = Scratch(docs.sparkSession, "keep")
    (row,) = fresh(docs.columns, "row")
    rows = scratch.table(docs.withColumn(row, F.monotonically_increasing_id()))
    found = near_duplicates(rows.select(F.col(row).alias("doc_id"), F.col("text").cast("string").alias("text")), **options)
    names = rows.select(F.col(row).alias("doc_id"), F.col("doc_id").cast("long").alias("id"))
    best = found.select("doc_id", "component_id").join(names, "doc_id").groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "doc_id")).alias("best"))
    return rows.join(best.select(F.col("best.doc_id").alias(row)), row, "left_semi").select(all_of(rows, docs.columns))


SQL = r"""
with words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) end as s
  from words),
classes as (select list_sort(s) as s, min(doc_id) as node from sets where len(s) > 0 group by 1),
items as (select node, len(s) as n, unnest(s) as x from classes),
pairs as (select a.node as a, b.node as b, count(*) as shared, any_value(a.n) as na, any_value(b.n) as nb from items a join items b on a.x = b.x and a.node < b.node group by 1, 2),
links as (select a, b from pairs where 100 * shared >= 80 * (na + nb - shared)),
edges as (select a, b from links union all select b, a from links),
reach as (
  with recursive r(node, root) as (select node, node from classes union select e.b, r.root from r join edges e on e.a = r.node)
  select node, min(root) as component from r group by 1)
select s.doc_id, len(s.s)::bigint as n_shingles, coalesce(r.component, s.doc_id) as component_id, s.doc_id = coalesce(r.component, s.doc_id) as kept
from sets s left join classes c on len(s.s) > 0 and list_sort(s.s) = c.s left join reach r on r.node = c.node
"""
