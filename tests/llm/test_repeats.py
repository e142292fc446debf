"""Periodic runs, repeated passages and collocations against brute force, on small and messy rows."""

import collections
import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import bytetext, collocations, periodic, substring_dedup

CLASHING = ("runs", "n_words", "collapsed", "h", "place", "digest", "ident", "firsts", "kept", "part", "phrase", "f", "size", "best", "w", "g", "a", "p", "row", "doc")


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def with_clashes(df):
    return df.select("*", *[F.lit(i).alias(n) for i, n in enumerate(CLASHING) if n not in df.columns])


# ---- periodic runs


def brute_runs(w, least=12):
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            length = i - s + q
            if i > s and length >= max(least, 2 * q) and not any(a <= s and a + n >= s + length for a, n, _ in out):
                out.append((s, length, q))
            i += i == s
    return sorted(out, key=lambda r: (r[0], r[2]))


def random_words(rnd):
    n, k = rnd.randrange(0, 120), rnd.choice([1, 2, 2, 3, 5, 30])
    w = [rnd.randrange(k) for _ in range(n)]
    if n and rnd.random() < 0.6:
        a = rnd.randrange(n)
        p = rnd.randrange(1, n - a + 1)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w * rnd.choice([1, 1, 3])


@pytest.mark.parametrize("least", [2, 5, 12, 30])
def test_runs_equal_brute_force(least):
    rnd = random.Random(least)
    for _ in range(500):
        w = random_words(rnd)
        assert periodic.find_runs(np.array(w, dtype=np.int64), least) == brute_runs(w, least), w


def test_scales_cover_every_distance_once():
    for least in (2, 5, 12, 30):
        for n in range(2, 300):
            got = [q for size, a, z in periodic.scales(n, least) for q in range(a, z + 1)]
            assert got == list(range(1, n // 2 + 1))
            assert all(2 * size - 1 <= max(q, least - q) < 4 * size - 1 for size, a, z in periodic.scales(n, least) for q in range(a, z + 1))


def test_runs_with_small_automata():
    rnd = random.Random(9)
    letters, periodic.LETTERS = periodic.LETTERS, 8
    try:
        for _ in range(200):
            w = random_words(rnd)
            assert periodic.find_runs(np.array(w, dtype=np.int64)) == brute_runs(w)
    finally:
        periodic.LETTERS = letters


def test_long_texts_with_nested_runs():
    w = [0 if i % 21 else 1 for i in range(30_000)]
    got = periodic.find_runs(np.array(w))
    assert got[0] == (0, 30_000, 21) and set(got[1:]) == {(21 * j + 1, 20, 1) for j in range(1428)} | ({(21 * 1428 + 1, 30_000 - 21 * 1428 - 1, 1)} if 30_000 - 21 * 1428 - 1 >= 12 else set())
    assert periodic.find_runs(np.arange(40_000) % 16_000) == [(0, 40_000, 16_000)]


def periodic_rows():
    rnd = random.Random(2)
    rows = [(i, rnd.choice([" ", "\n", " \t "]).join(f"w{x}" for x in random_words(rnd))) for i in range(150)]
    return rows + [(1000, None), (1001, ""), (1002, " \n\t\x0b "), (None, "a b " * 20), (None, None), rows[5], rows[5], (5, "Ä ä " * 9 + "x"), (1003, "\x1c \x85 " * 8), (1004, "long " * 30_000), (-7, "p q r " * 10)]


def expected_report(i, w):
    runs = brute_runs(w) if len(w) < 10_000 else [(0, len(w), 1)]
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    gone = {x for s, n, q in runs for x in range(s + q, s + n)}
    return (i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for j, x in enumerate(w) if j not in gone)))


def test_report_of_runs(spark):
    rows = periodic_rows()
    got = [tuple(r) for r in periodic.report(with_clashes(spark.createDataFrame(rows, "doc_id long, text string"))).collect()]
    assert sorted(got, key=str) == sorted([expected_report(i, words(t)) for i, t in rows], key=str)
    assert periodic.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeats_that_the_query_adds(spark):
    rows = [(i, t) for i, t in periodic_rows() if t is None or len(t) < 5000] + [(i, " ".join(f"v{j}" for j in range(i % 90))) for i in range(2000, 2200)]
    got = collections.Counter((r["doc_id"], " ".join(words(r["text"]))) for r in periodic.with_repeats(with_clashes(spark.createDataFrame(rows, "doc_id long, text string"))).collect())
    want = collections.Counter()
    for i, t in rows:
        w = words(t)
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
        want[i, " ".join(w)] += 1
    assert got == want


# ---- repeated passages


def passage_rows():
    rnd = random.Random(4)
    pool = [f"w{i}" for i in range(400)] + ["Étude", "中文", "W1"]
    some = lambda n: [rnd.choice(pool) for _ in range(n)]
    shared = [some(n) for n in (12, 13, 14, 30, 60)]
    rows = []
    for i in range(60):
        w = some(rnd.randrange(0, 80))
        for _ in range(rnd.randrange(0, 3)):
            at = rnd.randrange(len(w) + 1)
            w[at:at] = rnd.choice(shared)
        rows.append((i, rnd.choice([" ", "\n"]).join(w)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (3, rows[3][1]), (3, rows[7][1]), (3, " ".join(shared[4] + some(5))), (None, " ".join(shared[3])), (None, None), (102, None), (103, ""), (104, " \n "), (105, " ".join(shared[1]).upper())]
    return rows + [(106, "same " * 20_000), (107, "same " * 14 + "end"), (-5, " ".join(shared[2])), (108, " ".join(some(6) * 9))] + [(200 + i, " ".join(some(4) + shared[3] + some(4))) for i in range(150)]


def brute_repeats(rows, size=13):
    low = {}
    for i, t in rows:
        w = words(t)
        for j in range(len(w) - size + 1) if i is not None else ():
            key = tuple(w[j : j + size])
            low[key] = min(low.get(key, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for j in range(len(w) - size + 1) if i is not None else ():
            if low[tuple(w[j : j + size])] < i:
                gone |= set(range(j, j + size))
        out.append((i, len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone))))
    return sorted(out, key=str)


@pytest.mark.parametrize("max_bits, size, partitions", [(29, 13, 4), (15, 13, 60), (29, 5, 4), (29, 3, 7)])
def test_repeats_equal_brute_force(spark, max_bits, size, partitions):
    """Also with a bit map that lets strangers through, short windows, and windows whose copies fill many partitions."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = passage_rows()
        d = with_clashes(spark.createDataFrame(rows, "doc_id long, text string"))
        assert sorted([tuple(r) for r in substring_dedup.report(d, size, max_bits).collect()], key=str) == brute_repeats(rows, size)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_remove_repeats_keeps_columns(spark):
    rows = passage_rows()
    d = with_clashes(spark.createDataFrame(rows, "doc_id long, text string"))
    out = substring_dedup.remove_repeats(d)
    assert out.columns == d.columns
    got = out.collect()
    assert len(got) == len(rows) and all(r[n] == i for r in got for i, n in enumerate(CLASHING))
    assert collections.Counter((r["doc_id"], len(words(r["text"]))) for r in got) == collections.Counter((i, n - m) for i, n, m, _ in brute_repeats(rows))
    assert sum(r["text"] is None for r in got) == 2
    spans = {r["doc_id"]: r["repeats"] for r in substring_dedup.repeats(d).collect()}
    assert [tuple(x) for x in spans[200]] == [(4, 34)] and all(z - a >= 13 for found in spans.values() for a, z in found)


def test_repeats_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup.report(empty).count() == 0 and substring_dedup.remove_repeats(empty).count() == 0
    short = spark.createDataFrame([(1, "a b"), (2, "a b")], "doc_id long, text string")
    assert [r["n_removed"] for r in substring_dedup.report(short).collect()] == [0, 0]


# ---- collocations


def collocation_rows():
    rnd = random.Random(6)
    pool = ["the", "of", "new", "york", "city", "Été", "x-y", "a\x85b", "中文", "big", "apple"]
    rows = []
    for i in range(120):
        w = []
        for _ in range(rnd.randrange(0, 40)):
            w += rnd.choice([["New", "york", "city"], ["new", "YORK"], ["of", "the"], ["big", "apple"], [rnd.choice(pool)], [rnd.choice(pool)]])
        text = "".join(x + rnd.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "!?", "\x0b"]) for x in w)
        rows.append((i, text, rnd.choice(["en", "en", "de", None, "und"])))
    return rows + [(1, None, "en"), (2, "", "xx"), (3, " .,;\n", "xx"), (4, "tick tock " * 5000, "tt"), (None, "new york city", None), rows[0], rows[0]]


def brute_collocations(rows, least, longest, share, top):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = collections.Counter(), collections.Counter()
    for _, t, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (t or "").translate(low)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    cand = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    out = collections.defaultdict(list)
    for (lang, w), a in cand.items():
        inside = lambda v, k=len(w), w=w: any(v[i : i + k] == w for i in range(len(v) - k + 1))
        if any(o == lang and len(v) > len(w) and 100 * b >= share * a and inside(v) for (o, v), b in cand.items()):
            continue
        score, _, l, r = min((10**6 * a * a // (f[lang, w[:c]] * f[lang, w[c:]]), c, f[lang, w[:c]], f[lang, w[c:]]) for c in range(1, len(w)))
        out[lang].append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top]))


@pytest.mark.parametrize("least, longest, share, top, bits", [(10, 3, 50, 2000, 27), (10, 3, 50, 5, 3), (2, 3, 30, 2000, 10), (3, 4, 50, 2000, 27), (300, 2, 50, 10, 27), (1, 3, 101, 50, 27)])
def test_collocations_equal_brute_force(spark, least, longest, share, top, bits):
    """Also with sketches of very few cells, longer phrases, counts beyond a byte, and nothing subsumed."""
    rows = collocation_rows()
    d = with_clashes(spark.createDataFrame(rows, "doc_id long, text string, lang string")).repartition(5)
    got = collocations.top_collocations(d, top=top, least=least, longest=longest, share=share, max_cell_bits=max(bits, 3))
    assert sorted(tuple(r) for r in got.collect()) == brute_collocations(rows, least, longest, share, top)


def test_scores_are_exact_beyond_64_bits(spark):
    """a * a * 10**6 passes 64 bits from about 4.3 million occurrences on: the same expression over given counts."""
    a, l, r = 5_000_000_007, 7_000_000_001, 9_000_000_011
    row = spark.createDataFrame([(a, l, r)], "a long, l1 long, r1 long").selectExpr("cast(a as decimal(15,0)) * cast(a as decimal(15,0)) * 1000000 div (cast(l1 as decimal(15,0)) * cast(r1 as decimal(15,0))) as s").first()
    assert row["s"] == 10**6 * a * a // (l * r)


def test_collocations_of_nothing(spark):
    assert collocations.top_collocations(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0
    assert collocations.top_collocations(spark.createDataFrame([(1, None, None), (2, " ", "en")], "doc_id long, text string, lang string")).count() == 0


def test_collocations_take_bounded_memory():
    """Sketches and counts of a task: numpy's peak over 8 MB of text; hashes of words stay what they are in any block."""
    rnd = random.Random(5)
    some = ["".join(rnd.choices("abcdefgh", k=rnd.randrange(1, 9))) + rnd.choice(["", "", "", ",", "\n"]) for _ in range(3000)]
    texts = [" ".join(rnd.choices(some, k=4000)) for _ in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), pa.array(texts)], names=["lang", "text"])

    class Every:
        value = staticmethod(lambda h: np.ones(len(h), dtype=bool))

    for run in (collocations._sketch(3, 10, 2, 16), collocations._survivors(3, Every)):
        tracemalloc.start()
        for out in run(iter([batch])):
            assert out.num_rows <= 1 << 16
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 130e6, f"{peak / 1e6:.0f} MB"
    words = bytetext.Words(pa.array([*texts[:3], "x" * 1000, "", "a b"]))
    whole = words.hashes()
    for size in (1, 7, 999):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(bytetext, "HASH_BYTES", size, raising=False)
            assert (words.hashes() == whole).all()
    assert len(set(whole.tolist())) == len({words.text(i, i + 1) for i in range(len(whole))})
