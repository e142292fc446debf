"""Greatest similarities against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import library as L
from tidewatch.operators import similarity


def share(x, y):
    return len(x & y) / max(1, len(x | y))


@pytest.fixture(scope="module")
def sets():
    """Known sets that all have one word, most have a second, and some are equal, empty or short; rows of all sizes."""
    rnd = random.Random(5)
    pool = [f"w{i}" for i in range(300)]
    known = [{"the", *(["of"] if rnd.random() < 0.8 else []), *rnd.sample(pool, rnd.randrange(0, 30))} for _ in range(400)] + [set(), {"the"}, {"w1", "w2"}, {"w1", "w2"}]
    rows = [{*(["the"] if rnd.random() < 0.9 else []), *(["of"] if rnd.random() < 0.9 else []), *rnd.sample(pool, rnd.randrange(0, 60)), *[f"x{j}" for j in range(rnd.randrange(0, 80))]} for _ in range(300)]
    return known, [*rows, set(), {"the"}, {"x1"}, {"w1", "w2"}, {"of", "the"}, *known[:20]]


@pytest.mark.parametrize("step", [1, 16, 256, 10**9])
def test_index_equals_all_pairs(sets, step):
    known, rows = sets
    index = similarity.Index([sorted(x) for x in known])
    before, similarity.STEP = similarity.STEP, step
    try:
        for x in rows:
            want = max(share(x, y) for y in known)
            assert index.top(x, len(x)) == pytest.approx(want)
            for t in (0.05, 0.35, 0.9):
                assert (index.top(x, len(x), t, t) < t) == (want < t)
                got = index.top(x, len(x), t)
                assert got == pytest.approx(want) if want < t else got >= t
    finally:
        similarity.STEP = before


@pytest.mark.parametrize("largest", [150, 10_000])
def test_dissimilar_equals_all_pairs(spark, sets, largest):
    known, rows = sets
    pool = spark.createDataFrame([(i, sorted(x)) for i, x in enumerate(rows)] + [(-1, None)], "id int, fp array<string>").withColumn("top", F.lit("kept"))
    acts = spark.createDataFrame([(sorted(x),) for x in known], "fp array<string>")
    out = L.dissimilar(pool, acts, 0.2, largest)
    assert out.columns == pool.columns and {r["top"] for r in out.collect()} == {"kept"}
    want = {i: max(share(x, y) for y in known) for i, x in enumerate(rows)} | {-1: 0.0}
    assert {r["id"] for r in out.collect()} == {i for i, t in want.items() if t < 0.2}
    best = {r["id"]: r["top"] for r in L.best_similarity(pool, acts, "id", largest).collect()}
    assert best == pytest.approx(want)
    assert L.dissimilar(pool, acts.limit(0)).count() == len(rows) + 1 and L.dissimilar(pool.limit(0), acts).count() == 0


def test_a_word_in_every_set_costs_little(sets):
    """A row that shares a rare word and the common ones with the known sets reads few postings."""
    known = [{"the", f"r{i}", f"s{i}", f"t{i}"} for i in range(5000)]
    index = similarity.Index([sorted(x) for x in known])
    read = []
    index.posting = type("Counted", (), {"__getitem__": lambda self, s, p=index.posting: (read.append(s.stop - s.start), p[s])[1]})()
    assert index.top({"the", "r7", "s7", "t7"}, 4) == 1.0 and sum(read) < 10
