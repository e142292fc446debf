"""Language-model scores from subword lattices.

A text is words, each a blank and its bytes, and one end.  A word's probability
is the sum over all its segmentations into pieces of an existing vocabulary,
computed by forward recursion in log space over byte places; single bytes are
pieces too, so every word has one.  The vocabulary's scores (its ranks, as a Zipf law)
give the pieces' weights: those that the first round starts from, and in every round ``PRIOR``
counts in their proportion, to which the expected counts of all distinct training words are
added (forward-backward, ``rounds`` times).
A training word is also one segment of its own: it has the share of its count,
less a discount, and what all discounts free is spread by the lattice.

A corpus of several languages has several such models, one for each class of
training rows.  A text's class is not given when it is scored: its probability
is summed over the classes as it is over segmentations, so the class column only
teaches.  All probabilities of texts sum to one.

Distinct words are counted once over the corpus and scored once for each class.
Texts then look words up: the most frequent ones, up to a fixed number, in a
broadcast table, all others by a join.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytetext as bt
from .shared import Scratch, chunks

U = np.uint64
#: Rounds of re-estimation, frequent words that are broadcast, and how many expected counts the vocabulary's own scores weigh.
ROUNDS, HEAD_WORDS, PRIOR = 3, 1 << 19, 2000.0
#: Words of more bytes are summed over one by one, in linear time, with scaled numbers instead of logarithms.
LONG_BYTES = 256
#: Classes with a model of their own, the most frequent ones; all other rows share one more.
CLASSES = 8
#: Words that a task takes at once, so that those of one length make long arrays.
TOGETHER = 1 << 16
_SLOTS = 22
BLANK = "▁"


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> tuple[list[bytes], np.ndarray]:
    """Byte strings of the vocabulary that can occur in a lower-cased word (a blank only in front), and their starting probabilities."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out: dict[bytes, float] = {bytes([b]): 0.0 for b in range(256)}
    scores = [sp.get_score(i) for i in range(sp.get_piece_size())]
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i):
            continue
        p = sp.id_to_piece(i)
        raw = p.replace(BLANK, " ").encode()
        if BLANK in p[1:] or any(65 <= b <= 90 for b in raw):
            continue
        out[raw] = 1 / (10 - min(0.0, scores[i]))  # the score of a merge is its negated rank
    low = min(v for v in out.values() if v > 0) / 10
    weights = np.array([max(v, low) for v in out.values()])
    return list(out), weights / weights.sum()


class Lattice:
    """Forward and backward sums over all segmentations of many words at once."""

    def __init__(self, strings: list[bytes]):
        self.longest = max(map(len, strings))
        words = bt.Words(pa.array(strings, pa.binary()), np.ones(256, dtype=bool))
        self.hash = words.hashes()
        self.slots = [np.full(1 << _SLOTS, -1, dtype=np.int32) for _ in range(2)]
        for i, h in enumerate(self.hash.tolist()):
            for slots, at in zip(self.slots, self._places(h)):
                if slots[at] < 0:
                    slots[at] = i
                    break
            else:
                raise ValueError("two pieces share both slots")

    @staticmethod
    def _places(h):
        return h >> (64 - _SLOTS), h & ((1 << _SLOTS) - 1)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers of hashes, -1 for none."""
        out = np.full(h.shape, -1, dtype=np.int32)
        for slots, at in zip(self.slots, (h >> U(64 - _SLOTS), h & U((1 << _SLOTS) - 1))):
            got = slots[at.astype(np.int64)]
            ok = (got >= 0) & (self.hash[got] == h)
            out[ok] = got[ok]
        return out

    def _arcs(self, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For words of one length, a row each: (place, length, row, piece) of all pieces in them, by place and length."""
        n, size = letters.shape
        up, down = bt.powers(size + 1)
        sums = np.zeros((n, size + 1), dtype=U)
        np.cumsum(bt._TABLE[letters] * up[:size], axis=1, out=sums[:, 1:])
        found = []
        for k in range(1, min(self.longest, size) + 1):
            got = self.find(bt.mix((sums[:, k:] - sums[:, :-k]) * down[: size - k + 1] + U(k * 0xA24BAED4963EE407 % 2**64)))
            at, row = np.nonzero(got.T >= 0)
            found.append((at, np.full(len(at), k), row, got.T[at, row]))
        at, k, row, got = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(at * (self.longest + 1) + k, kind="stable")
        return at[order], k[order], row[order], got[order]

    def arcs(self, letters: np.ndarray) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
        """At each place, (length, rows, pieces) of the pieces that begin there."""
        at, k, row, got = self._arcs(letters)
        cuts = np.concatenate([[0], np.flatnonzero((at[1:] != at[:-1]) | (k[1:] != k[:-1])) + 1, [len(at)]])
        out: list[list] = [[] for _ in range(letters.shape[1])]
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            out[at[a]].append((int(k[a]), row[a:z], got[a:z]))
        return out

    def forward(self, arcs, n: int, log_p: np.ndarray) -> np.ndarray:
        """log_p: a number for each piece, or a row of them, one for each class."""
        a = np.full((len(arcs) + 1, n, *log_p.shape[1:]), -np.inf)
        a[0] = 0
        for i, here in enumerate(arcs):
            for k, rows, got in here:
                a[i + k, rows] = np.logaddexp(a[i + k, rows], a[i, rows] + log_p[got])
        return a

    def expected(self, arcs, n: int, log_p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected counts of the pieces in these words."""
        a = self.forward(arcs, n, log_p)
        b = np.full((len(arcs) + 1, n), -np.inf)
        b[-1] = 0
        total = np.zeros(len(log_p))
        for i in range(len(arcs) - 1, -1, -1):
            for k, rows, got in arcs[i]:
                tail = log_p[got] + b[i + k, rows]
                b[i, rows] = np.logaddexp(b[i, rows], tail)
                total += np.bincount(got, counts[rows] * np.exp(a[i, rows] + tail - a[-1, rows]), minlength=len(log_p))
        return total

    def _swept(self, size: int, ends: np.ndarray, k: np.ndarray, p: np.ndarray, back: bool) -> tuple[np.ndarray, np.ndarray]:
        """Scaled forward (or backward) sums of one word at all places, and the logarithms of their scales; p: a row for each arc."""
        f, scale = np.zeros((size + 1, p.shape[1])), np.zeros((size + 1, p.shape[1]))
        f[size if back else 0] = 1
        held = np.zeros(p.shape[1])
        for i in range(size - 1, -1, -1) if back else range(size):
            a, z = ends[i], ends[i + 1]
            if back:
                f[i] = (p[a:z] * f[i + k[a:z]]).sum(axis=0)
            else:
                f[i + k[a:z]] += f[i] * p[a:z]
            scale[i] = held
            if i % 8 == 0:  # what the next steps read, and write, gets a common scale
                near = slice(i, i + self.longest + 1) if back else slice(i + 1, i + self.longest + 1)
                most = f[near].max(axis=0)
                f[near] /= most
                held = held + np.log(most)
                scale[near] = held
        if not back:
            scale[size] = held
        return f, scale

    def _one(self, letters: np.ndarray):
        at, k, _, got = self._arcs(letters[None, :])
        return np.searchsorted(at, np.arange(len(letters) + 1)), at, k, got

    def log_sums(self, letters: np.ndarray, log_p: np.ndarray) -> np.ndarray:
        """Log-probabilities of words of one length, a row for each; log_p: a row for each piece, a column for each class."""
        n, size = letters.shape
        if size <= LONG_BYTES:
            return self.forward(self.arcs(letters), n, log_p)[-1]
        out = []
        for word in letters:
            ends, _, k, got = self._one(word)
            f, scale = self._swept(size, ends, k, np.exp(log_p)[got], False)
            out.append(np.log(f[-1]) + scale[-1])
        return np.array(out)

    def counts(self, letters: np.ndarray, log_p: np.ndarray) -> np.ndarray:
        """Expected counts of the pieces in words of one length, each word counting once."""
        n, size = letters.shape
        if size <= LONG_BYTES:
            return self.expected(self.arcs(letters), n, log_p, np.ones(n))
        total = np.zeros(len(log_p))
        for word in letters:
            ends, at, k, got = self._one(word)
            p = np.exp(log_p)[got][:, None]
            f, up = self._swept(size, ends, k, p, False)
            b, down = self._swept(size, ends, k, p, True)
            share = (f[at] * p * b[at + k])[:, 0] * np.exp(up[at] + down[at + k] - np.log(f[-1]) - up[-1])[:, 0]
            total += np.bincount(got, share, minlength=len(log_p))
        return total


@functools.lru_cache(maxsize=2)
def lattice(path: str) -> Lattice:
    return Lattice(pieces(path)[0])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches joined up to TOGETHER rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= TOGETHER:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _by_length(words: list[str], most: int = 8192) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words with their blank as letter matrices of one length each, with their places."""
    raw = [b" " + w.encode() for w in words]
    size = np.array([len(x) for x in raw])
    order = np.argsort(size, kind="stable")
    cuts = np.flatnonzero(np.diff(size[order])) + 1
    for group in np.split(order, cuts) if len(order) else ():
        step = max(1, min(most, (1 << 18) // int(size[group[0]])))
        for at in range(0, len(group), step):
            some = group[at : at + step]
            yield some, np.frombuffer(b"".join(raw[i] for i in some), dtype=np.uint8).reshape(len(some), -1)


def _known(n: int) -> list[str]:
    return [f"known_{k}" for k in range(n)]


def _count(classes: int):
    """Counts of distinct words in all rows, and in the training rows of each class (cls; none: -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", 2 << 20):
                words = bt.Words(part.column("text"))
                cls = part.column("cls").to_numpy()[words.doc]
                _, first, back = np.unique(words.hashes(), return_index=True, return_inverse=True)
                known = [pa.array(np.bincount(back[cls == k], minlength=len(first)), pa.int64()) for k in range(classes)]
                yield pa.RecordBatch.from_arrays([bt.strings(words, first), pa.array(np.bincount(back, minlength=len(first)), pa.int64()), *known], names=["word", "n", *_known(classes)])

    return run


def _expect(path: str, log_p):
    """Expected counts of pieces in each class, each distinct word counting once: it is rare words that the lattice is for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat, p = lattice(path), log_p.value
        total = np.zeros(p.shape)
        for batch in _gathered(batches):
            for k, name in enumerate(_known(p.shape[1])):
                for rows, letters in _by_length(batch.column("word").filter(pc.greater(batch.column(name), 0)).to_pylist()):
                    total[:, k] += lat.counts(letters, p[:, k])
        at, k = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(k, pa.int32()), pa.array(total[at, k])], names=["piece", "cls", "expected"])

    return run


def _score_words(path: str, log_p, word_mass: np.ndarray, discount: np.ndarray, tokens: np.ndarray, spread: np.ndarray):
    """log10_p of each word in each class: its own discounted share, and the lattice's share of what is spread."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat, p = lattice(path), log_p.value
        for batch in _gathered(batches):
            out = np.zeros((batch.num_rows, p.shape[1]))
            for rows, letters in _by_length(batch.column("word").to_pylist()):
                out[rows] = lat.log_sums(letters, p)
            known = np.stack([batch.column(x).to_numpy() for x in _known(p.shape[1])], axis=1)
            with np.errstate(divide="ignore"):
                own = np.log(np.maximum(known - discount, 0) / np.maximum(1, tokens))
            out = (np.logaddexp(own, out + np.log(spread)) + np.log(word_mass)) / math.log(10)
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(known.sum(axis=1)), batch.column("n"), *map(pa.array, out.T)], names=["word", "known", "n", *(f"p_{k}" for k in range(p.shape[1]))])

    return run


def _hash_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        w = bt.Words(batch.column("word"))
        yield pa.RecordBatch.from_arrays([pa.array(w.hashes().view(np.int64)), *batch.columns[1:]], names=["h", *batch.schema.names[1:]])


def _score_texts(head):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_h, known, log_p = head.value
        log_c = np.log10(known + 1.0)
        for batch in batches:
            for part in chunks(batch, "text"):
                words = bt.Words(part.column("text"))
                h, back = np.unique(words.hashes(), return_inverse=True)
                at = np.minimum(np.searchsorted(known_h, h), max(0, len(known_h) - 1))
                hit = (known_h[at] == h) if len(known_h) else np.zeros(len(h), dtype=bool)
                per = lambda v: np.bincount(words.doc, np.where(hit, v[at], 0)[back], minlength=words.rows) if len(known_h) else np.zeros(words.rows)
                rare = np.flatnonzero(~hit[back])
                cut = np.searchsorted(rare, words.first).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(words.counts, pa.int64()), pa.array(per((known > 0).astype(float)).astype(np.int64)), pa.array(per(log_c)), *(pa.array(per(x)) for x in log_p), pa.ListArray.from_arrays(pa.array(cut), bt.strings(words, rare))],
                    names=["doc_id", "held_out", "n_words", "n_known", "log_c", *(f"p_{k}" for k in range(len(log_p))), "rare"],
                )

    return run


def _classes(docs: DataFrame, column: str | None, taught, most: int) -> list[str]:
    """The most frequent values of a column among training rows; more than ``most`` values never reach the driver."""
    if column is None or column not in docs.columns:
        return []
    sizes = docs.where(taught).groupBy(F.coalesce(F.col(column).cast("string"), F.lit("")).alias("c")).count()
    return [r["c"] for r in sizes.orderBy(F.col("count").desc(), "c").limit(most).collect()]


def score(docs: DataFrame, vocabulary: str, hold_out=(7, 2), rounds: int = ROUNDS, head_words: int = HEAD_WORDS, class_column: str | None = "lang", classes: int = CLASSES) -> DataFrame:
    """Log10 probabilities of texts: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; one row per row of docs.

    docs: doc_id, text, and class_column, of which only training rows are read (null is a
    value; without such a column there is one class); others are ignored.  vocabulary: path of a sentencepiece
    model.  Rows whose crc32(doc_id) modulo hold_out[0] is hold_out[1] are held out: nothing is learnt
    from them; a null doc_id is not held out.  base_score is the add-one unigram word model,
    score the lattice model.  Null and empty texts are one end token; words of any length are summed over
    whole, in linear time; repeated
    rows teach and are scored each; an empty table gives an empty one.

    To the driver come at most ``head_words`` words with a number for each class (2**19 of 16 + 8 * 9 bytes: 46 MB),
    a number for each piece and class, and counts of counts; however large the corpus is.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    taught = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % hold_out[0] != hold_out[1], F.lit(True))
    names = _classes(docs, class_column, taught, classes)
    cls = F.lit(len(names))
    for k, name in enumerate(names):
        cls = F.when(F.coalesce(F.col(class_column).cast("string"), F.lit("")) == name, k).otherwise(cls)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (~taught).alias("held_out"), F.when(taught, cls).otherwise(-1).cast("int").alias("cls"))
    ends = np.zeros(len(names) + 1)
    for r in text.where("cls >= 0").groupBy("cls").count().collect():
        ends[r["cls"]] = r["count"]
    if len(names) and not ends[-1]:  # no row is outside the named classes
        ends = ends[:-1]
    n_cls, every = len(ends), int(ends.sum())
    known = _known(n_cls)
    counted = text.select("text", "cls").mapInArrow(_count(n_cls), "word string, n long, " + ", ".join(f"{x} long" for x in known))
    words = scratch.table(counted.groupBy("word").agg(*(F.sum(x).alias(x) for x in ("n", *known))))
    any_known = F.lit(False)
    for x in known:
        any_known = any_known | (F.col(x) > 0)
    zero_sum = lambda x: F.coalesce(F.sum(x), F.lit(0))
    got = words.agg(F.count_if(any_known), *(f(F.col(x)) for x in known for f in (zero_sum, lambda c: F.count_if(c > 0), lambda c: F.count_if(c == 1), lambda c: F.count_if(c == 2)))).first()
    tokens, types, once, twice = np.array(got[1:], dtype=float).reshape(n_cls, 4).T
    total, distinct = int(tokens.sum()) + every, got[0] + (every > 0)

    strings, prior = pieces(vocabulary)
    p = np.repeat(prior[:, None], n_cls, axis=1)
    for _ in range(rounds):
        held = spark.sparkContext.broadcast(np.log(p))
        # at most one row for each piece of the vocabulary and class
        t = words.where(any_known).select("word", *known).mapInArrow(_expect(vocabulary, held), "piece int, cls int, expected double").groupBy("piece", "cls").agg(F.sum("expected").alias("expected")).toArrow()
        n = PRIOR * np.repeat(prior[:, None], n_cls, axis=1)
        n[t["piece"].to_numpy(), t["cls"].to_numpy()] += t["expected"].to_numpy()
        p = n / n.sum(axis=0)
    # a word begins with a piece that has the blank, and lasts while pieces have none
    begins = np.array([x[:1] == b" " for x in strings])
    going_on = p[~begins].sum(axis=0)
    p = np.where(begins[:, None], p / p[begins].sum(axis=0) * (1 - going_on), p)
    held = spark.sparkContext.broadcast(np.log(p))
    end = (ends + 0.5) / (tokens + ends + 1)
    discount = (once + 1) / (once + 2 * twice + 2)
    spread = np.where(tokens > 0, discount * types / np.maximum(1, tokens), 1.0)
    per_class = [f"p_{k}" for k in range(n_cls)]
    doubles = ", ".join(f"{x} double" for x in per_class)
    scored = scratch.table(words.select("word", "n", *known).mapInArrow(_score_words(vocabulary, held, 1 - end, discount, tokens, spread), f"word string, known long, n long, {doubles}"))
    scratch.drop(words)

    # the least count from which on words fit into the head: counts of counts are few rows
    least, room = 1, head_words
    sizes = scored.groupBy("n").count().orderBy(F.col("n").desc())
    for r in sizes.toLocalIterator():
        room -= r["count"]
        if room < 0:
            least = r["n"] + 1
            break
    common = scored.where(F.col("n") >= least).select("word", "known", *per_class).mapInArrow(_hash_words, f"h long, known long, {doubles}").toArrow()
    h = common["h"].to_numpy().astype(np.int64).view(U)
    order = np.argsort(h)
    head = spark.sparkContext.broadcast((h[order], common["known"].to_numpy().astype(float)[order], [common[x].to_numpy().astype(float)[order] for x in per_class]))
    del common
    first = text.select("doc_id", "text", "held_out").mapInArrow(_score_texts(head), f"doc_id long, held_out boolean, n_words long, n_known long, log_c double, {doubles}, rare array<string>")
    first = scratch.table(first.withColumn("row", F.monotonically_increasing_id()))
    rare = first.where(F.size("rare") > 0).select("row", F.explode("rare").alias("word")).groupBy("row", "word").agg(F.count("*").alias("times"))
    rest = rare.join(scored.where(F.col("n") < least), "word").groupBy("row").agg(
        F.sum(F.when(F.col("known") > 0, F.col("times")).otherwise(0)).alias("k"), F.sum(F.col("times") * F.log10(F.col("known") + 1.0)).alias("c"), *(F.sum(F.col("times") * F.col(x)).alias(f"rest_{x}") for x in per_class))
    out = first.drop("rare").join(rest, "row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    n_tokens = F.col("n_words") + 1
    shares = (ends + 0.5) / (ends + 0.5).sum()
    in_class = [F.col(x) + zero(f"rest_{x}") + float(np.log10(end[k] * shares[k])) for k, x in enumerate(per_class)]
    best = F.greatest(*in_class) if n_cls > 1 else in_class[0]
    out = out.select("*", best.alias("best"), F.array(*in_class).alias("each"))
    return out.select(
        "doc_id", "held_out", n_tokens.alias("n_tokens"), (F.col("n_known") + zero("k") + int(every > 0)).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("log_c") + zero("c") + math.log10(every + 1) - n_tokens * math.log10(total + distinct + 1)).alias("base_score"),
        (F.col("best") + F.log10(F.aggregate("each", F.lit(0.0), lambda a, x: a + F.pow(F.lit(10.0), x - F.col("best"))))).alias("score"),
    )
