"""Toxicity of texts by noisy-channel restoration and word evidence.

1. A character trigram model is counted over all documents.
2. Disguised tokens (leetspeak, letters spaced apart, repeated letters) become
   lattices: each character offers what it may stand for, with a channel cost,
   and repeats and separators may vanish.  Viterbi search over trigram states
   gives the likeliest restored token.
3. Words of the restored text are looked up, as words and as word beginnings,
   among those that occur with the label in labelled rows.  Their shrunken
   log-odds are summed up in a few numbers for each text and a logistic model
   turns these into a probability.

Labels come from a sample of labelled rows of bounded size (``fit_rows``); all
else covers all rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Collection, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import LOWER
from .shared import Scratch, all_of, chunks, fresh

#: Labelled texts a model is fitted on at most (about, by a hash of doc_id and text).
FIT_ROWS = 60_000
THRESHOLD = 0.3
#: Fitted rows a word needs, and weight of the prior.  Features are as many as fitted rows give, hence bounded by FIT_ROWS.
LEAST_ROWS, PRIOR_ROWS = 5, 4.0
KEPT_WORDS = 400_000
PREFIXES = (4, 5, 6)

# fixed values: what characters stand for in disguised words
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}

EDGE, OTHER, SYMBOLS = 26, 27, 28
_SYMBOL = np.full(256, EDGE, dtype=np.int64)
_SYMBOL[97:123] = np.arange(26)
_SYMBOL[128:] = OTHER
#: Costs; a letter written twice is often meant, one written more often is not.
SUBSTITUTE, DOUBLE, REPEAT, KEEP, SPLIT = 1.5, 3.0, 0.3, 6.0, 0.5

# letters apart, of any number; a sign beside a letter; a letter twice
_LETTERS_APART = r"(?<![a-z0-9@$|])[a-z0-9@$!|+](?:[ .\-_*]+[a-z0-9@$!|+])+(?![a-z0-9@$|])"
_APART = re.compile(_LETTERS_APART)
_SUSPECT = re.compile(_LETTERS_APART + r"|[0-9@$!|+][a-z]|[a-z][0-9@$!|+]|([a-z])\1")
_TWICE = re.compile(r"(.)[ .\-_*]*\1")
#: Ways of reading, as they stand before a token's name in the memory of readings.
DOUBLED, APART = "2 ", "1 "
_PLAIN = frozenset("abcdefghijklmnopqrstuvwxyz")
_LETTER = re.compile("[a-z]")
#: Letters with nothing but punctuation around them.
_ONE = re.compile(r"[^\w@$!|+]*([a-z]+)[^\w@$!|+]*")
_PAIR, _TRIPLE = re.compile(r"([a-z])\1"), re.compile(r"([a-z])\1\1")
_TOKEN_CHAR = frozenset("abcdefghijklmnopqrstuvwxyz0123456789@$!|+")
_WORD = re.compile(r"[^\W\d_]+")


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SYMBOLS**3, dtype=np.int64)
    for batch in batches:
        for part in chunks(batch, "text"):
            joined = "  ".join(part.column("text").fill_null("").to_pylist()).encode()
            s = _SYMBOL[LOWER[np.frombuffer(b"  " + joined + b"  ", dtype=np.uint8)]]
            total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["gram", "n"])


def language_model(docs: DataFrame) -> np.ndarray:
    """Log-probabilities [a, b, c] of symbol c after a and b, counted over all texts; at most 28**3 rows reach the driver."""
    n = np.zeros(SYMBOLS**3)
    for r in docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_count_trigrams, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        n[r["gram"]] = r["n"]
    n = n.reshape(SYMBOLS, SYMBOLS, SYMBOLS) + 0.1
    return np.log(n / n.sum(axis=2, keepdims=True))


def options_of(raw: str, way: str = "") -> list[list[tuple[int | None, str, float]]]:
    """The lattice of a disguised token: for each place the (symbol, written, cost) it may stand for; no symbol: nothing is written."""
    spaced = not all(c in _TOKEN_CHAR for c in raw)
    out = []
    before = earlier = ""
    for i, c in enumerate(raw):
        if spaced and c in " .-_*":
            if raw[i - 1] in " .-_*":
                continue
            # a separator is dropped, or the edge of a word
            options = [(EDGE, " ", SPLIT)] if way == APART and i == 1 else [(None, "", 0.0), (EDGE, " ", SPLIT)]
        elif "a" <= c <= "z":
            options = [(ord(c) - 97, c, 0.0)]
        else:
            options = [(ord(x) - 97, x, SUBSTITUTE) for x in LEET.get(c, "")] + [(EDGE, c, KEEP)]
        if c == before and not (spaced and c in " .-_*"):
            single = earlier != c and raw[i + 1 : i + 2] != c
            if not (single and way == DOUBLED):
                options.append((None, "", DOUBLE + SUBSTITUTE * (c not in _PLAIN) if single else REPEAT))
        earlier, before = before, c
        out.append(options)
    return out


class Remembered(dict):
    """What a function gives for a key; forgotten as a whole beyond KEPT_WORDS entries."""

    def __init__(self, function):
        self.function = function

    def __missing__(self, key):
        found = self.function(key)
        if len(key) <= 40:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[key] = found
        return found


class Restorer:
    def __init__(self, model: np.ndarray):
        self.model = model.tolist()
        self.kept: dict[str, str] = {}
        self.units = Remembered(self.unit)

    def token(self, raw: str, way: str = "") -> str:
        """The likeliest reading of one disguised token (lower case); way: of those with letters doubled, or the first letter apart."""
        if way + raw in self.kept:
            return self.kept[way + raw]
        if _PLAIN.issuperset(raw) and not _TRIPLE.search(raw):
            return raw if way == DOUBLED else self._letters(raw)
        model = self.model
        states: dict[tuple[int, int], tuple[float, tuple]] = {(EDGE, EDGE): (0.0, ())}
        for options in options_of(raw, way):
            new: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (score, path) in states.items():
                for sym, out, cost in options:
                    key, s, p = ((a, b), score - cost, path) if sym is None else ((b, sym), score - cost + model[a][b][sym], (path, out))
                    if key not in new or s > new[key][0]:
                        new[key] = (s, p)
            states = new
        best = max(states.items(), key=lambda x: (x[1][0] + model[x[0][0]][x[0][1]][EDGE], x[0]))[1][1]
        out = []
        while best:
            best, c = best
            out.append(c)
        text = "".join(reversed(out))
        if len(raw) <= 40:
            if len(self.kept) >= KEPT_WORDS:
                self.kept.clear()
            self.kept[way + raw] = text
        return text

    def _letters(self, raw: str) -> str:
        """The likeliest reading of letters none of which stands more than twice in a row: what token() finds by search.

        Whether the second of a pair is kept or not, the state after the next letter is the same, so each pair is
        decided by itself, by the trigrams that differ.
        """
        out, at, model = [], 0, self.model
        for m in _PAIR.finditer(raw):
            i = m.start()
            c, before = ord(raw[i]) - 97, ord(raw[i - 1]) - 97 if i else EDGE
            after = ord(raw[i + 2]) - 97 if i + 2 < len(raw) else EDGE
            if model[before][c][after] - DOUBLE > model[before][c][c] + model[c][c][after]:
                out.append(raw[at : i + 1])
                at = i + 2
        return "".join([*out, raw[at:]]) if at else raw

    def text(self, low: str, others: set[str] | None = None) -> str:
        """Lower-cased text with its disguised tokens restored; one linear pass.  Other readings of tokens go to others."""
        out, at = [], 0
        for m in _SUSPECT.finditer(low):
            if m.start() < at:
                continue
            s, e = m.span()
            if not _LETTER.search(m.group()):
                continue
            if not any(c in " .-_*" for c in m.group()):
                while s > at and low[s - 1] in _TOKEN_CHAR:
                    s -= 1
                while e < len(low) and low[e] in _TOKEN_CHAR:
                    e += 1
            raw = low[s:e]
            likeliest, *rest = self.readings(raw)
            out += [low[at:s], likeliest]
            if others is not None:
                others.update(rest)
            at = e
        return "".join([*out, low[at:]]) if at else low

    def readings(self, raw: str) -> list[str]:
        """All readings of a disguised token, the likeliest first."""
        found = [self.token(raw)]
        if _TWICE.search(raw) and (doubled := self.token(raw, DOUBLED)) != found[0]:
            found.append(doubled)
        if len(raw) > 2 and raw[1] in " .-_*":
            found.append(self.token(raw, APART))
        return found

    def unit(self, unit: str) -> tuple[str, ...]:
        """Distinct words of a lower-cased text without white space, in all readings."""
        if (m := _ONE.fullmatch(unit)) and not _TRIPLE.search(word := m[1]):
            short = self._letters(word)
            return (word,) if short == word else (word, short)
        if not _SUSPECT.search(unit):
            return (unit,) if unit.isalpha() else tuple(set(_WORD.findall(unit)))
        others: set[str] = set()
        back = self.text(unit, others)
        return tuple({w for t in (unit, back, *others) for w in _WORD.findall(t)})

    def words(self, text: str | None) -> set[str]:
        """Distinct words of a text as written and as restored, in all readings: a wrong one hides none.

        Only letters with spaces between them reach over white space; all else is read once for each distinct unit.
        """
        low = (text or "").lower()
        found: set[str] = set().union(*map(self.units.__getitem__, set(low.split())))
        out, at = [], 0
        for m in _APART.finditer(low):
            if " " in (raw := m.group()) and _LETTER.search(raw):
                likeliest, *rest = self.readings(raw)
                out += [low[at : m.start()], likeliest]
                at = m.end()
                found.update(*map(_WORD.findall, rest))
        return found.union(_WORD.findall("".join([*out, low[at:]]))) if at else found


def features(word: str) -> list[str]:
    """The word, and its beginnings of 4 to 6 letters where it is longer."""
    return [word, *(f"{word[:k]}*" for k in PREFIXES if len(word) > k)]


def _read(model):
    """Texts with labels to their distinct words, in all readings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model.value)
        for batch in batches:
            for part in chunks(batch, "text"):
                words = [list(restorer.words(t)) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.string())), part.column("toxic")], names=["words", "toxic"])

    return run


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n: tuple[Counter, Counter] = Counter(), Counter()
        for words, toxic in zip(batch.column("words").to_pylist(), batch.column("toxic").to_pylist()):
            n[toxic].update(set(words).union(*([f"{w[:k]}*" for w in words if len(w) > k] for k in PREFIXES)))
        found = [*n[0].keys() | n[1].keys()]
        counts = [pa.array([n[label][f] for f in found], pa.int64()) for label in (1, 0)]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), *counts], names=["feature", "toxic", "clean"])


class Scorer:
    def __init__(self, model: np.ndarray, known: dict[str, tuple[int, int]], prior: float, weights: list[float] | None):
        self.restorer, self.known, self.prior, self.weights = Restorer(model), known, prior, weights
        # a word has evidence only if it is known or begins like a known beginning
        self.starts = {f[: PREFIXES[0]] for f in known if f.endswith("*")}
        self.evidence = {own: Remembered(partial(self.word, own=own)) for own in (None, 0, 1)}
        self.base = np.log(prior / (1 - prior))

    def odds(self, toxic: float, clean: float) -> float:
        """Log-odds against the prior, shrunken towards none; only evidence for the label counts."""
        p = (toxic + PRIOR_ROWS * self.prior) / (toxic + clean + PRIOR_ROWS)
        return max(0.0, float(np.log(p / (1 - p)) - self.base))

    def word(self, w: str, own: int | None = None) -> float:
        """Evidence of a word; own: the label of the row it stands in, if that row was counted (it is left out then)."""
        best = 0.0
        for f in features(w):
            if n := self.known.get(f):
                best = max(best, self.odds(n[0] - (own == 1), n[1] - (own == 0)))
        return best

    def numbers(self, words: Collection[str], own: int | None = None) -> list[float]:
        known, starts, evidence = self.known, self.starts, self.evidence[own]
        found = [x for w in words if (w in known or w[: PREFIXES[0]] in starts) and (x := evidence[w]) > 0]
        found.sort(reverse=True)
        top = found[:2] + [0.0] * (2 - len(found[:2]))
        return [1.0, top[0], top[1], float(np.log1p(sum(found))), float(np.log1p(len(words))) / 10]

    def score(self, text: str | None) -> float:
        z = float(np.dot(self.weights, self.numbers(self.restorer.words(text))))
        return 1 / (1 + np.exp(-z)) if z > -700 else 0.0


#: The fitted values this Python worker last scored with, and its scorer: what it has read serves all its tasks.
_scoring: list = [None, None]


def _scorer(fitted: tuple) -> Scorer:
    if _scoring[0] is not fitted:
        _scoring[:] = [fitted, Scorer(*fitted)]
    return _scoring[1]


def _numbers(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*broadcast.value, None)
        for batch in batches:
            y = batch.column("toxic").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([scorer.numbers(w, own) for w, own in zip(batch.column("words").to_pylist(), y)], pa.list_(pa.float64())), pa.array(y, pa.int32())], names=["x", "y"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> list[float]:
    """Ridge logistic regression by Newton steps; the first column is the constant."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty) + 1e-9 * np.eye(len(w)), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, hold_out=(4, 2), fit_rows: int = FIT_ROWS):
    """(trigram model, features with row counts, prior, weights), as one broadcast variable.

    Labels of rows whose crc32(doc_id) modulo hold_out[0] is hold_out[1] are never read; rows without a
    label or a doc_id teach nothing; conflicting labels of one doc_id both count; rows of equal doc_id and text teach once.
    """
    spark = docs.sparkSession
    model = language_model(docs)
    rows = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("toxic")).where("_id is not null and toxic in (0, 1)")
    rows = rows.where(F.crc32(F.col("_id").cast("string").cast("binary")) % hold_out[0] != hold_out[1]).distinct()
    there = rows.count()
    if there > fit_rows:
        rows = rows.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(1_000_000 * fit_rows / there))
    # at most about fit_rows small rows: a bound that does not grow with the data
    taught = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(rows), "_id")
    # an id may name many rows: equal ones teach once, and different texts are bounded as well
    place = F.xxhash64("_id", "text")
    taught = scratch.table(taught.withColumn("_at", place).groupBy("_id", "_at", "toxic").agg(F.first("text").alias("text")))
    there = taught.count()
    if there > 1.1 * fit_rows:
        taught = taught.where(F.pmod("_at", F.lit(1_000_000)) < int(1_000_000 * fit_rows / there))
    lm = spark.sparkContext.broadcast(model)
    # texts are read once; what follows needs their words only
    texts, taught = taught, scratch.table(taught.select("text", "toxic").mapInArrow(_read(lm), "words array<string>, toxic int"))
    scratch.drop(texts)
    n, toxic = taught.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    prior = (toxic + 0.5) / (n + 1)
    counted = taught.mapInArrow(_count_features, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    strong = counted.where((F.col("toxic") + F.col("clean") >= LEAST_ROWS) & (F.col("toxic") >= 2 * prior * (F.col("toxic") + F.col("clean"))))
    known = {r["feature"]: (r["toxic"], r["clean"]) for r in strong.collect()}
    parts = spark.sparkContext.broadcast((model, known, prior))
    got = taught.mapInArrow(_numbers(parts), "x array<double>, y int").collect()
    x, y = np.array([r["x"] for r in got]).reshape(-1, 5), np.array([r["y"] for r in got], dtype=float)
    weights = _logistic(x, y) if len(y) else [float(np.log(prior / (1 - prior))), 1.0, 0.0, 0.0, 0.0]
    return spark.sparkContext.broadcast((model, known, prior, weights))


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, hold_out=(4, 2), fit_rows: int = FIT_ROWS) -> DataFrame:
    """docs' columns with score (0 to 1) and predicted (1 from threshold on); one row per row of docs.

    Only text enters a score.  Null and empty texts get the score of a text
    without words; a very long text is read whole, in one pass; equal texts have equal scores, and repeated rows
    are scored each.  Without usable labels all scores follow from the prior; an empty table stays
    empty.  Columns of docs named score or predicted, in any case, are replaced; others of any name stay.  Ties: a
    score that equals the threshold counts as toxic.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    fitted = fit(docs, labels, scratch, hold_out, fit_rows)
    docs = docs.drop("score", "predicted")
    schema = docs.withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(fitted.value)
        for batch in batches:
            for part in chunks(batch, "text"):
                s = np.array([scorer.score(t) for t in part.column("text").to_pylist()], dtype=float)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*part.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, schema)


def report(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs; a null doc_id is not held out.

    Nulls, empty and very long texts, repeated rows, empty tables as in score(); further columns are ignored.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), labels, **options).select("doc_id", held.alias("held_out"), "score", "predicted")


def reject(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs that are not predicted toxic, with all their columns as they were, whatever these are named.

    Null and empty texts stay unless texts without words are predicted toxic; very long texts are judged whole; repeated
    rows stay or go together; an empty table stays empty, and without usable labels nothing goes.
    """
    taken = [c for c in docs.columns if c.lower() in ("score", "predicted")]
    own = dict(zip(taken, fresh(docs.columns, *taken)))
    kept = score(docs.withColumnsRenamed(own), labels, **options).where("predicted = 0").drop("score", "predicted")
    kept = kept.withColumnsRenamed({v: k for k, v in own.items()})
    return kept.select(all_of(kept, docs.columns))
