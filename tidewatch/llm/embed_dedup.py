"""Near-duplicate vectors by sorted projection passes.

In each pass a vector's key is the signs of random projections, concatenated; rows
are range-sorted by (pass, label, key) with their vectors, and each is compared in
place with its neighbours: all rows of its block and a window of rows after that.
Rows at the ends of a partition are written aside and compared across the border.
Verified pairs are united over all passes.  Vectors of large labels are
centred by their label's mean first.

Passes and windows are measured.  The first pass shows, for windows of several widths, how many
leading bits it takes until a vector's window covers all that share them, and so how likely a pair at the threshold
meets; each label takes the width and the number of passes that reach the probability ``recall`` with the fewest
comparisons.  Where vectors crowd, windows grow before passes do.  Both are bounded: a pass compares
a vector with at most BLOCK rows and the widest window, whatever the label's size, so work stays linear, and a
label so crowded that even the most passes fall short of ``recall`` has the recall those give.  A label that fits into a block is
whole in its window at once: rows of such a label are never dealt to two partitions.

A window is bounded, a group of copies is not.  So windows only have to tie a
group together: they yield spanning links, at most one for each row of a block.
Links are then counted within components.  Every component has a pivot; members
so near the pivot that the triangle inequality on angles proves them linked to
each other are counted by their number, and only the others are compared, in
tiles, with all members.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytetext import mix
from .shared import Scratch, components

COSINE = 0.93
WINDOW, BLOCK, BITS, RECALL, TILE = 64, 512, 62, 0.995, 1024
#: Windows a label may take, as multiples of the narrowest.
WIDTHS = (1, 4, 16)
#: Numbers of passes a label may take.
LADDER = [2 * k for k in (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64)]
#: Rows from which on a label's vectors are centred by its mean.
CENTRED = 4096
#: Passes whose rows are sorted at once; each holds all vectors.
TOGETHER = 2
U = np.uint64


def _planes(seed: int, bits: int, dims: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(1000 + seed)).standard_normal((dims, bits))


def _numbers(col: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, their numbers as a matrix) for each length among the lists of a column; null lists are left out, nulls inside are NaN."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    size = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = col.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    start = np.cumsum(size) - size
    out = []
    for n in np.unique(size[size > 0]):
        rows = np.flatnonzero(size == n)
        out.append((rows, flat[start[rows][:, None] + np.arange(n)] if len(rows) < len(size) else flat.reshape(-1, n)))
    return out


def _scaled(v: np.ndarray) -> np.ndarray:
    v = v / np.maximum(np.abs(v).max(axis=1, keepdims=True), 1e-300)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _unit(col: pa.Array) -> np.ndarray:
    """Rows of unit length; all rows of the column have equally many numbers."""
    return _scaled(_numbers(col)[0][1]) if len(col) else np.zeros((0, 1))


def passes_needed(rows: int, cosine: float, window: int, recall: float) -> int:
    """Passes after which a pair at the threshold was within a window with probability ``recall``, for vectors spread evenly."""
    agree = 1 - math.acos(cosine) / math.pi
    bits = max(1.0, math.log2(max(2.0, rows / window)))
    return max(3, math.ceil(math.log(1 - recall) / math.log(1 - agree**bits)))


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, label, v) with their group (label and length) and two hashes of label and numbers; null where v is unusable."""
    salt: dict[str, tuple[int, int]] = {}
    for batch in batches:
        label = batch.column("label").to_pylist()
        grp = np.full(batch.num_rows, None, dtype=object)
        c = np.zeros((2, batch.num_rows), dtype=U)
        for rows, v in _numbers(batch.column("v")):
            n = v.shape[1]
            ok = np.isfinite(v).all(axis=1) & v.any(axis=1) & np.array([label[i] is not None for i in rows])
            rows, v = rows[ok], v[ok] + 0.0
            names = [f"{label[i]}/{n}" for i in rows]
            for name in set(names) - set(salt):
                h = hashlib.sha256(name.encode()).digest()
                salt[name] = int.from_bytes(h[:8], "little"), int.from_bytes(h[8:16], "little")
            bits = v.view(U)
            for k in range(2):
                of = mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(k))
                c[k, rows] = mix(mix(bits ^ of).sum(axis=1, dtype=U) + np.array([salt[x][k] for x in names], dtype=U)) if len(rows) else 0
            grp[rows] = names
        none = np.array([x is None for x in grp], dtype=bool)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(grp, pa.string()), *(pa.array(x.view(np.int64), mask=none) for x in c), batch.column("v")], names=["vec_id", "grp", "c1", "c2", "v"])


def _by(groups: np.ndarray) -> Iterator[tuple]:
    """(group, first row, row past the last) of runs of equal values."""
    cuts = np.concatenate([[0], np.flatnonzero(groups[1:] != groups[:-1]) + 1, [len(groups)]]) if len(groups) else []
    for a, z in zip(cuts[:-1], cuts[1:]):
        yield groups[a], int(a), int(z)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of unit vectors by group, a row for each place."""
    for batch in batches:
        grp = np.array(batch.column("grp").to_pylist())
        for g in np.unique(grp):
            total = _unit(batch.filter(pa.array(grp == g)).column("v")).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(total)), pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["grp", "at", "total"])


def _keys(seeds: list[int], bits: int, means, cosine: float):
    """Rows (grp, node, v, n) once for each pass, with their key; rows without n belong to labels that one pass covers whole.

    slice: by what rows are dealt to partitions, the key, or nothing for labels that stay together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict = {}
        for batch in batches:
            grp = np.array(batch.column("grp").to_pylist())
            for g in np.unique(grp):
                rows = batch.filter(pa.array(grp == g))
                whole = rows.column("n")[0].as_py() is None
                v = _unit(rows.column("v")) - means.value.get(g, 0.0)
                dim = v.shape[1]
                # the chance that a pair at the threshold agrees in a bit, from its distance and the vector's length here
                far = 1 - np.minimum(2.0, (1 - cosine) / np.maximum((v * v).sum(axis=1), 1e-12))
                agree = pa.array(1 - np.arccos(far) / np.pi)
                for s in seeds[:1] if whole else seeds:
                    if (s, dim) not in planes:
                        planes[s, dim] = _planes(s, bits, dim)
                    key = ((v @ planes[s, dim]) > 0) @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), s), pa.int32()), rows.column("grp"), pa.array(np.zeros_like(key) if whole else key), pa.array(key), rows.column("node"), agree, rows.column("v")], names=["pass", "grp", "slice", "key", "node", "agree", "v"])

    return run


def _forest(node: np.ndarray, v: np.ndarray, cosine: float) -> list[tuple[int, int]]:
    """A spanning forest of the links among vectors of unit length."""
    link = np.concatenate([v[at : at + BLOCK] @ v.T >= cosine for at in range(0, len(v), BLOCK)])
    some = np.flatnonzero(link.sum(axis=1) > 1)
    unseen, out = np.ones(len(v), dtype=bool), []
    for s in some:
        todo = [s] if unseen[s] else []
        unseen[s] = False
        while todo:
            x = todo.pop()
            new = np.flatnonzero(link[x] & unseen)
            unseen[new] = False
            out += [(int(node[x]), int(node[y])) for y in new]
            todo += new.tolist()
    return out


_PLACED = "a long, b long, meets array<double>, border int, place int, grp string, v array<{}>"


def _neighbours(cosine: float, window: int, measure: tuple[int, ...], kind: pa.DataType, size: int):
    """Of a sorted partition: spanning links within blocks of ``size`` rows and windows (a, b); each row's chance to meet a
    pair at the threshold with each of the windows in measure (a, meets); and its first and last rows, to be compared across borders (border, place, grp, a, v)."""
    names = ["a", "b", "meets", "border", "place", "grp", "v"]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.int32(), pa.int32(), pa.string(), pa.list_(kind)]

    def batch_of(n: int, **cols) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([cols[x].cast(k) if x in cols else pa.nulls(n, k) for x, k in zip(names, kinds)], names=names)

    def block(t: pa.Table) -> Iterator[pa.RecordBatch]:
        node = t["node"].to_numpy()
        links = _forest(node, _unit(t["v"]), cosine)
        if links:
            a, b = zip(*links)
            yield batch_of(len(a), a=pa.array(a), b=pa.array(b))
        if measure:
            key, agree = t["key"].to_numpy(), t["agree"].to_numpy()
            chances = np.ones((len(node), len(measure)))
            for m, w in enumerate(measure):
                bits = np.zeros(len(node))
                if len(node) > w:
                    # leading bits shared with the rows just at the window's ends; all that share more lie within
                    shared = BITS - np.frexp((key[w:] ^ key[:-w]).astype(float))[1] + 1
                    bits[:-w] = shared
                    bits[w:] = np.maximum(bits[w:], shared)
                chances[:, m] = agree**bits
            yield batch_of(len(node), a=pa.array(node), meets=pa.ListArray.from_arrays(pa.array(np.arange(len(node) + 1) * len(measure), pa.int32()), pa.array(chances.ravel())))

    def border(t: pa.Table, number: int, last: bool) -> pa.RecordBatch:
        n = t.num_rows
        place = np.arange(n, 0, -1) * -1 if last else np.arange(n)
        return batch_of(n, a=t["node"].combine_chunks(), border=pa.array(np.full(n, number)), place=pa.array(place), grp=t["run"].combine_chunks(), v=t["v"].combine_chunks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        me, first, held, tail, of = TaskContext.get().partitionId(), [], None, None, None
        missing = window
        for batch in batches:
            said = [f"{p}/{g}" for p, g in zip(batch.column("pass").to_pylist(), batch.column("grp").to_pylist())]
            whole = pa.Table.from_batches([batch]).append_column("run", pa.array(said))
            if missing and batch.num_rows:
                first.append(whole.slice(0, missing))
                missing = max(0, missing - batch.num_rows)
            if batch.num_rows:
                tail = whole.slice(max(0, batch.num_rows - window)) if tail is None else pa.concat_tables([tail, whole]).slice(max(0, tail.num_rows + batch.num_rows - window))
            for g, a, z in _by(np.array(said)):
                if held is not None and g != of:
                    yield from block(held)
                    held = None
                part = whole.slice(a, z - a)
                held, of = part if held is None else pa.concat_tables([held, part]), g
                # a window is measured only where the block holds rows beyond it
                while held.num_rows >= 2 * size + max([window, *measure]):
                    yield from block(held.slice(0, size + max([window, *measure])))
                    held = held.slice(size)
        if held is not None:
            yield from block(held)
        if first and me:
            yield border(pa.concat_tables(first), me - 1, False)
        if tail is not None:
            yield border(tail, me, True)

    return run


def _across(cosine: float, window: int):
    """Rows of a border: links of rows before it (place < 0) with rows after it, at most ``window`` apart and of one run."""

    def flush(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows)
        node, place, grp = t["a"].to_numpy(), t["place"].to_numpy(), np.array(t["grp"].to_pylist())
        out = []
        for g in np.unique(grp):
            at = np.flatnonzero(grp == g)
            before, after = at[place[at] < 0], at[place[at] >= 0]
            if len(before) and len(after):
                link = (_unit(t["v"].take(pa.array(before))) @ _unit(t["v"].take(pa.array(after))).T >= cosine) & (place[after][None, :] - place[before][:, None] <= window)
                out += [(int(node[before[i]]), int(node[after[j]])) for i, j in zip(*np.nonzero(link))]
        return _pairs(out)

    return _by_first(flush, "border")


def _pairs(out: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*out) if out else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _by_first(flush, key: str):
    """Batches of rows sorted by a key, as calls of flush with the batches of one key's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            k = batch.column(key).to_numpy(zero_copy_only=False)
            for g, a, z in _by(k):
                if held and g != last:
                    yield flush(held)
                    held = []
                held.append(batch.slice(a, z - a))
                last = g
        if held:
            yield flush(held)

    return run


def _angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cos = np.zeros(batch.num_rows)
        for (rows, v), (_, p) in zip(_numbers(batch.column("v")), _numbers(batch.column("pivot_v"))):
            cos[rows] = (_scaled(v) * _scaled(p)).sum(axis=1)
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("component"), batch.column("size"), pa.array(np.arccos(np.clip(cos, -1, 1)))], names=["node", "component", "size", "angle"])


def _tile_counts(cosine: float):
    """Rows of a tile: side 0 are members to count for (rim), side 1 all members of one block; partial degrees of both."""

    def flush(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows)
        node, size, rim, side = (t[x].to_numpy() for x in ("node", "size", "rim", "side"))
        v = _unit(t["v"])
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        n = np.zeros(len(node), dtype=np.int64)
        for at in range(0, len(left), 512):
            some = left[at : at + 512]
            link = (v[some] @ v[right].T >= cosine) & (node[some][:, None] != node[right][None, :])
            n[some] += link @ size[right]
            # a core member has no tiles of its own: rim members are counted for it here
            n[right] += np.where(rim[right], 0, size[some] @ link)
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(n)], names=["node", "n"])

    return _by_first(flush, "tile")


def _links(firsts: DataFrame, scratch: Scratch, kind: str, cosine: float, window: int, recall: float, size: int) -> DataFrame:
    """(a, b): links that tie nodes together, for firsts (node, grp, v)."""
    spark = firsts.sparkSession
    # labels that a block doesn't hold are fewer than rows / size
    large = {r["grp"]: r["n"] for r in firsts.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") > size).collect()}
    of = lambda names: F.broadcast(spark.createDataFrame([(g, large[g]) for g in names], "grp string, n long"))
    taken = scratch.table(firsts.select("grp", "node", "v").join(of(large), "grp", "left"))
    sums: dict[str, dict[int, float]] = {}
    for r in taken.where(F.col("n") > CENTRED).select("grp", "v").mapInArrow(_sums, "grp string, at int, total double").groupBy("grp", "at").agg(F.sum("total").alias("total")).collect():
        sums.setdefault(r["grp"], {})[r["at"]] = r["total"]
    means = spark.sparkContext.broadcast({g: np.array([t for _, t in sorted(x.items())]) / large[g] for g, x in sums.items()})
    arrow = pa.float32() if kind == "float" else pa.float64()
    widths = tuple(window * w for w in WIDTHS)
    found: list[DataFrame] = []

    def compared(rows: DataFrame, seeds: list[int], width: int, measure: tuple[int, ...] = ()) -> DataFrame:
        """Passes over rows; their links are added to found."""
        keyed = rows.mapInArrow(_keys(seeds, BITS, means, cosine), f"pass int, grp string, slice long, key long, node long, agree double, v array<{kind}>")
        dealt = keyed.repartitionByRange("pass", "grp", "slice").sortWithinPartitions("pass", "grp", "key", "node")
        placed = scratch.table(dealt.mapInArrow(_neighbours(cosine, width, measure, arrow, size), _PLACED.format(kind)))
        across = placed.where("border is not null").repartition("border").sortWithinPartitions("border").mapInArrow(_across(cosine, width), "a long, b long")
        found.extend([placed.where("b is not null").select("a", "b"), scratch.table(across)])
        return placed

    first = compared(taken, list(range(TOGETHER)), window, widths)
    needed: dict[tuple[int, int], list[str]] = {}
    if large:
        meets = first.where("meets is not null").groupBy("a").agg(*[F.avg(F.col("meets")[m]).alias(f"m{m}") for m in range(len(widths))]).join(taken.where("n is not null").select(F.col("node").alias("a"), "grp"), "a")
        missed = meets.groupBy("grp").agg(*[F.avg(F.pow(1 - F.col(f"m{m}"), F.lit(k))).alias(f"p{m}_{k}") for m in range(len(widths)) for k in LADDER])
        for r in missed.collect():  # one row for each large label
            ways = []
            for m, width in enumerate(widths):
                enough = next((k for k in LADDER if r[f"p{m}_{k}"] <= 1 - recall and k >= passes_needed(large[r["grp"]], cosine, width, recall)), None)
                if enough:
                    ways.append(((enough - (TOGETHER if not m else 0)) * (size + 2 * width), enough, width))
            _, enough, width = min(ways, default=(0, LADDER[-1], widths[-1]))
            needed.setdefault((enough, width), []).append(r["grp"])
    for width in widths:
        at = TOGETHER
        while going := [g for (k, w), names in needed.items() if w == width and k > at - (TOGETHER if width > window else 0) for g in names]:
            compared(taken.drop("n").join(of(going), "grp"), list(range(at, at + TOGETHER)), width)
            at += TOGETHER
    return functools.reduce(DataFrame.unionByName, found)


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, window: int = WINDOW, recall: float = RECALL, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """Links of vectors of equal label: vec_id, n_links, component_id, kept; one row per row of vectors.

    vectors: vec_id, embedding (array of numbers), label; others are ignored.  Vectors
    that are null, empty, zero or hold null or non-finite numbers, and rows with
    a null label, link with nothing; so do vectors of different lengths.  Rows of equal vectors are linked.  Rows
    that share a vec_id are separate vectors with one name; repeated rows
    give repeated rows.  A null vec_id is counted in n_links, and has its class's component.
    An empty table gives an empty one.  Pairs of one cosine with the threshold are linked.
    """
    scratch = Scratch(vectors.sparkSession, "embed")
    given = vectors.schema["embedding"].dataType
    kind = "float" if isinstance(given, T.ArrayType) and isinstance(given.elementType, T.FloatType) else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast(f"array<{kind}>").alias("v"))
    ids = scratch.table(rows.mapInArrow(_classes, f"vec_id long, grp string, c1 long, c2 long, v array<{kind}>"))
    # equal vectors of a label are one class, named by its hash
    firsts = ids.where("grp is not null").groupBy("c1", "c2").agg(F.min("vec_id").alias("low"), F.count("*").alias("size"), F.any_value("grp").alias("grp"), F.any_value("v").alias("v"))
    firsts = scratch.table(firsts.withColumn("node", F.col("c1")))
    comps = scratch.table(components(scratch, _links(firsts.select("node", "grp", "v"), scratch, kind, cosine, window, recall, block)))

    # links within components: by the pivot's angles where these prove them, by tiles for the rest
    members = scratch.table(comps.join(firsts.select("node", "size", "low", "v"), "node"))
    pivots = members.where("node = component").select("component", F.col("v").alias("pivot_v"))
    angles = members.join(pivots, "component").select("node", "component", "size", "v", "pivot_v").mapInArrow(_angles, "node long, component long, size long, angle double")
    half = math.acos(cosine) / 2 - 1e-7
    angles = scratch.table(angles.withColumn("rim", F.col("angle") > half))
    per = scratch.table(angles.groupBy("component").agg(F.sum(F.when(F.col("rim"), 0).otherwise(F.col("size"))).alias("core"), F.count_if("rim").alias("rims"), F.count("*").alias("all")))
    rows_ = angles.join(per.where("rims > 0"), "component").select("node", "component", "size", "rim", F.ceil(F.col("rims") / tile).cast("int").alias("lefts"), F.ceil(F.col("all") / tile).cast("int").alias("rights"))
    mine = lambda k: F.pmod(F.xxhash64("node"), F.col(k)).cast("int")
    left = rows_.where("rim").select("node", "component", "size", "rim", F.lit(0).alias("side"), mine("lefts").alias("l"), F.explode(F.sequence(F.lit(0), F.col("rights") - 1)).alias("r"))
    right = rows_.select("node", "component", "size", "rim", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("lefts") - 1)).alias("l"), mine("rights").alias("r"))
    tiles = left.unionByName(right).withColumn("tile", F.xxhash64("component", "l", "r")).join(members.select("node", "v"), "node")
    counted = scratch.table(tiles.select("tile", "node", "size", "rim", "side", "v").repartition("tile").sortWithinPartitions("tile").mapInArrow(_tile_counts(cosine), "node long, n long").groupBy("node").agg(F.sum("n").alias("tiled")))
    degree = angles.join(per.select("component", "core"), "component").join(counted, "node", "left").select(
        "node", "component", (F.coalesce("tiled", F.lit(0)) + F.when(F.col("rim"), 0).otherwise(F.col("core") - F.col("size"))).alias("others"))
    # components are named by their smallest vec_id
    named = scratch.table(members.groupBy("component").agg(F.min("low").alias("name")))
    degree = scratch.table(degree.join(named, "component").select("node", "others", "name"))
    known = firsts.select("c1", "c2", "node", "low", "size").join(degree, "node", "left")
    known = scratch.table(known.select("c1", "c2", F.when(F.col("others").isNull(), F.col("low")).otherwise(F.col("name")).alias("component_id"), (F.coalesce("others", F.lit(0)) + F.col("size") - 1).alias("n_links")))
    linked = ids.where("grp is not null").select("vec_id", "c1", "c2").join(known, ["c1", "c2"]).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    alone = ids.where("grp is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))


SQL = """
with v as (select row_number() over () as rid, vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings),
ok as (select * from v where label is not null and e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
links as (select a.rid as a, b.rid as b from ok a join ok b on a.label = b.label and a.rid <> b.rid and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.93),
reach as (
  with recursive r(rid, root) as (select rid, rid from v union select l.b, r.root from r join links l on l.a = r.rid)
  select r.rid, min(x.vec_id) as component from r join v x on x.rid = r.root group by 1),
n as (select a as rid, count(*) as n_links from links group by 1)
select v.vec_id, coalesce(n.n_links, 0)::bigint as n_links, r.component as component_id, v.vec_id = r.component as kept
from v join reach r using (rid) left join n using (rid)
"""


def with_copies(vectors: DataFrame) -> DataFrame:
    """vectors with changed copies (vec_id + 10**9, a tenth of each next component added) of those whose vec_id is divisible by 3, and copies of those copies of every ninth."""
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    copy = lambda df: df.select((F.col("vec_id") + 10**9).alias("vec_id"), "label", F.transform("embedding", lambda x, i: x + 0.1 * F.get("embedding", (i + 1) % F.size("embedding"))).alias("embedding"))
    once = copy(rows.where("vec_id % 3 = 0"))
    return rows.unionByName(once).unionByName(copy(once.where("(vec_id - 1000000000) % 9 = 0")))


COPIES_SQL = SQL.replace("from embeddings)", "from given)").replace("with v as", """with e0 as (select vec_id, label, list_transform(embedding, lambda x: x::double) as embedding from embeddings),
e1 as (select vec_id + 1000000000 as vec_id, label, list_transform(range(1, len(embedding) + 1), lambda i: embedding[i] + 0.1::double * embedding[i % len(embedding) + 1]) as embedding from e0 where vec_id % 3 = 0),
e2 as (select vec_id + 1000000000 as vec_id, label, list_transform(range(1, len(embedding) + 1), lambda i: embedding[i] + 0.1::double * embedding[i % len(embedding) + 1]) as embedding from e1 where (vec_id - 1000000000) % 9 = 0),
given as (select * from e0 union all select * from e1 union all select * from e2),
v as""", 1)
