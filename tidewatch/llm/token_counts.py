"""Token counts by rank-synchronous merging of batched pre-tokens.

All pre-tokens of a batch that were not counted before lie in one ragged numpy
array.  In each round every sequence finds its lowest-ranked pair, and all its
non-overlapping occurrences merge at once; sequences without a ranked pair are
done, and their surviving symbols are the count.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import chunks, importable
from .vocab import Merges, merges

#: Words whose counts a worker keeps, and the longest word it keeps.
KEPT_WORDS, KEPT_LENGTH = 300_000, 64
LIMIT = 2048
_NONE = np.iinfo(np.int64).max
#: The pre-tokens of the lower-cased vocabulary (a fixed value).
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_SPACE = regex.compile(r"[\t-\r \x85\xa0  -     　]+")
_NOT_SPLIT_ALIKE = regex.compile(r"[\x1c-\x1f]")


def count_merged(table: tuple[np.ndarray, np.ndarray, np.ndarray], symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many symbols survive in each sequence; symbols: all sequences, one after another (sizes > 0)."""
    keys, ranks, results = table
    done = np.zeros(len(sizes), dtype=np.int64)
    alive = np.arange(len(sizes))
    while len(alive):
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        seq = np.repeat(np.arange(len(sizes)), sizes)
        pair = (symbols[:-1] << 32) | symbols[1:]
        at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
        known = (keys[at] == pair) & (seq[:-1] == seq[1:])
        rank = np.full(len(symbols), _NONE)
        rank[:-1][known] = ranks[at[known]]
        lowest = np.minimum.reduceat(rank, starts)
        over = lowest == _NONE
        done[alive[over]] = sizes[over]
        hit = (rank == lowest[seq]) & (rank != _NONE)
        # of a run of overlapping hits (equal symbols), every second one from the left
        place = np.flatnonzero(hit)
        if len(place):
            new_run = np.concatenate([[True], (np.diff(place) > 1) | (seq[place[1:]] != seq[place[:-1]])])
            run_start = place[np.maximum.accumulate(np.where(new_run, np.arange(len(place)), 0))]
            place = place[(place - run_start) % 2 == 0]
            symbols[place] = results[at[place]]
        keep = ~over[seq]
        keep[place + 1] = False
        symbols = symbols[keep]
        sizes = np.bincount(seq[keep], minlength=len(sizes))[~over]
        alive = alive[~over]
    return done


class Counter:
    """Counts of white-space words, kept over batches up to a bound."""

    def __init__(self, m: Merges):
        self.m = m
        self.kept: dict[str, int] = {}
        self.special = regex.compile("|".join(regex.escape(x) for x in sorted(m.special, key=len, reverse=True))) if m.special else None
        self.first, self.final = np.array(m.first, dtype=np.int64), np.array(m.final, dtype=np.int64)

    def learn(self, words: Iterable[str]) -> dict[str, int]:
        words = list(words)
        pieces = [PIECES.findall(w) for w in words]
        known = {p: i for i, p in enumerate({p for ps in pieces for p in ps})}
        raw = [p.encode() for p in known]
        n = np.zeros(len(raw), dtype=np.int64)
        at = 0
        while at < len(raw):  # ragged arrays of about a megabyte of bytes
            to, size = at, 0
            while to < len(raw) and (to == at or size + len(raw[to]) <= 1 << 18):
                size += len(raw[to])
                to += 1
            flat = np.frombuffer(b"".join(raw[at:to]), dtype=np.uint8)
            sizes = np.array([len(x) for x in raw[at:to]], dtype=np.int64)
            symbols = self.first[flat]
            last = np.cumsum(sizes) - 1
            symbols[last] = self.final[flat[last]]
            n[at:to] = count_merged(self.m.table, symbols, sizes)
            at = to
        return {w: int(sum(n[known[p]] for p in ps)) for w, ps in zip(words, pieces)}

    def words(self, text: str) -> tuple[list[str], int]:
        """Normalised words, and the number of special strings."""
        parts = self.special.split(text) if self.special and "<|" in text else [text]
        out: list[str] = []
        for p in parts:
            if not p.isascii():
                p = unicodedata.normalize("NFC", p).replace("Σ", "σ")
            p = p.lower()
            out += [w for w in _SPACE.split(p) if w] if _NOT_SPLIT_ALIKE.search(p) else p.split()
        return out, len(parts) - 1

    def counts(self, texts: list[str | None]) -> list[int]:
        split = [self.words(t or "") for t in texts]
        new = set().union(*(w for w, _ in split)) - self.kept.keys()
        if len(self.kept) + len(new) > KEPT_WORDS:
            self.kept = {}
            new = set().union(*(w for w, _ in split))
        long = {w for w in new if len(w) > KEPT_LENGTH}
        self.kept |= self.learn(new - long)
        if not long:
            return [sum(map(self.kept.__getitem__, w)) + s for w, s in split]
        both = self.kept | self.learn(long)
        return [sum(map(both.__getitem__, w)) + s for w, s in split]


@functools.lru_cache(maxsize=2)
def _counter(path: str) -> Counter:
    return Counter(merges(path))


def token_counts(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit``); one row per row of docs.

    docs: doc_id, text; other columns are ignored.  vocabulary: path of a
    lower-casing word-end BPE file.  Special strings in a text count as one token
    each; nothing is added.  Null texts are empty; empty texts have no tokens;
    repeated rows give repeated rows; very long texts are counted whole; an empty table gives an empty one.
    """
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(vocabulary)
        for batch in batches:
            for part in chunks(batch, "text"):
                text = part.column("text")
                n = pa.array(counter.counts(text.to_pylist()), pa.int64())
                size = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), size, n, pc.greater(n, limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return text.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
