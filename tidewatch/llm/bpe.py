"""Byte-level BPE encoding and decoding.

A word's parts and the ranks of adjacent parts lie in two short lists.  The
minimum rank is found by a scan, its boundary is deleted and the ranks beside it
are refreshed.  Words of many bytes would scan too often; they use a heap over
the same boundaries instead, with equal results.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import chunks, importable
from .vocab import Merges, merges

#: Words a worker keeps encoded, the longest it keeps, and bytes from which a word uses the heap.
KEPT_WORDS, KEPT_LENGTH, LONG = 300_000, 48, 128
_NONE = 1 << 60
#: The pattern that splits text before the merges (a fixed value of the vocabulary).
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def merge_short(m: Merges, word: bytes) -> list[int]:
    """ids of a word by repeated scans of its contiguous rank array."""
    parts = [m.first[b] for b in word]
    pair = m.rank.get
    none = (_NONE, -1)
    ranks = [pair(p, none)[0] for p in zip(parts, parts[1:])]
    while ranks:
        low = min(ranks)
        if low == _NONE:
            break
        i = ranks.index(low)
        parts[i] = pair((parts[i], parts[i + 1]))[1]
        del parts[i + 1], ranks[i]
        if i:
            ranks[i - 1] = pair((parts[i - 1], parts[i]), none)[0]
        if i < len(ranks):
            ranks[i] = pair((parts[i], parts[i + 1]), none)[0]
    return parts


def merge_long(m: Merges, word: bytes) -> list[int]:
    """The same ids through a heap of (rank, place), for words of many bytes."""
    parts = [m.first[b] for b in word]
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(m.rank[p][0], i, p) for i, p in enumerate(zip(parts, parts[1:])) if p in m.rank]
    heapq.heapify(heap)
    while heap:
        _, i, p = heapq.heappop(heap)
        j = after[i] if parts[i] >= 0 else n
        if j >= n or (parts[i], parts[j]) != p:
            continue
        parts[i], parts[j] = m.rank[p][1], -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (q := (parts[i], parts[k])) in m.rank:
                heapq.heappush(heap, (m.rank[q][0], i, q))
        if (h := before[i]) >= 0 and (q := (parts[h], parts[i])) in m.rank:
            heapq.heappush(heap, (m.rank[q][0], h, q))
    return [p for p in parts if p >= 0]


class Codec:
    """Encodes and decodes whole texts; ids are decimal strings here, as digests and joins need them."""

    def __init__(self, m: Merges):
        self.m = m
        self.kept: dict[str, str] = {}
        self.bytes_of = {str(i): b for i, b in m.bytes_of.items()}
        self.special = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(m.special, key=len, reverse=True)) + ")")

    def word(self, w: str) -> str:
        raw = w.encode()
        return ",".join(map(str, (merge_short if len(raw) < LONG else merge_long)(self.m, raw)))

    def encode(self, text: str) -> str:
        """The ids of text, comma-joined."""
        if "<|" in text and self.special.search(text):
            out = []
            for i, part in enumerate(self.special.split(text)):
                if part:
                    out.append(str(self.m.special[part]) if i % 2 else self.encode_ordinary(part))
            return ",".join(out)
        return self.encode_ordinary(text)

    def encode_ordinary(self, text: str) -> str:
        kept = self.kept
        words = PIECES.findall(text)
        try:
            return ",".join(map(kept.__getitem__, words))
        except KeyError:
            pass
        long = {}
        for w in set(words).difference(kept):
            (kept if len(w) <= KEPT_LENGTH else long)[w] = self.word(w)
        out = ",".join([kept[w] if w in kept else long[w] for w in words] if long else map(kept.__getitem__, words))
        if len(kept) > KEPT_WORDS:
            kept.clear()
        return out

    def decode(self, ids: str) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.split(","))).decode("utf-8", "replace") if ids else ""


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(merges(path))


def _apply(df: DataFrame, column: str, fields: dict[str, pa.DataType], make):
    """df with further columns, made of each chunk's column by make(list) -> lists."""
    importable(df.sparkSession)
    kinds = {pa.int64(): "long", pa.string(): "string", pa.list_(pa.int32()): "array<int>"}
    out = df
    for name, kind in fields.items():
        out = out.withColumn(name, F.lit(None).cast(kinds[kind]))
    schema = out.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, column) if pa.types.is_string(batch.schema.field(column).type) else [batch]:
                made = dict(zip(fields, make(part.column(column).to_pylist())))
                cols = {name: part.column(name) for name in part.schema.names} | {name: pa.array(made[name], kind) for name, kind in fields.items()}
                yield pa.RecordBatch.from_arrays([cols[f.name] for f in schema.fields], names=[f.name for f in schema.fields])

    return df.mapInArrow(run, schema)


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """docs with token_ids (array of int) and n_tokens of text; null texts are empty, special strings in texts become their ids.

    Empty texts have no ids; very long texts and words are encoded whole; equal texts and repeated rows have equal ids, row
    by row; an empty table stays empty.  A column of docs that has one of these names is replaced, all others stay.
    """

    def make(texts):
        ids = [codec(vocabulary).encode(t or "") for t in texts]
        lists = [list(map(int, x.split(","))) if x else [] for x in ids]
        return lists, [len(x) for x in lists]

    return _apply(docs.drop("token_ids", "n_tokens"), "text", {"token_ids": pa.list_(pa.int32()), "n_tokens": pa.int64()}, make)


def decode(df: DataFrame, vocabulary: str) -> DataFrame:
    """df with decoded, the text of token_ids; null or no ids give an empty text; other columns and rows stay, a column named decoded is replaced."""

    def make(ids):
        return ([codec(vocabulary).decode(",".join(map(str, x or []))) for x in ids],)

    return _apply(df.drop("decoded"), "token_ids", {"decoded": pa.string()}, make)


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encoding and decoding each text; one row per row of docs.

    Null texts are empty (no ids, the digest of nothing); repeated rows give repeated rows; very long texts are
    encoded whole; an empty table gives an empty one; further columns, whatever their names, are ignored.
    """

    def make(texts):
        c = codec(vocabulary)
        n, ids_sha, text_sha = [], [], []
        for t in texts:
            ids = c.encode(t or "")
            n.append(ids.count(",") + 1 if ids else 0)
            ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
            text_sha.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
        return n, ids_sha, text_sha

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _apply(text, "text", {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}, make).drop("text")
