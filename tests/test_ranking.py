import pytest
from pyspark.sql import functions as F

from tidewatch.operators import library as L
from tidewatch.operators import ranking as R

GOLDEN = [
    ({3, 8, 29, 43, 49, 124, 274}, 0.79392, 12.6786, 5.6349, 4.2262, 0.32539),
    ({7, 16, 42, 46, 50, 79, 264}, 0.80460, 0.0, 5.6349, None, 0.23480),
    ({7, 10, 18, 33, 41, 53, 201}, 0.86248, 0.0, 8.4524, 5.6349, 0.33997),
]


@pytest.mark.parametrize("ranks,auc,ef1,ef5,ef10,bedroc", GOLDEN)
def test_published_rankings(spark, ranks, auc, ef1, ef5, ef10, bedroc):
    m = R.metrics(spark.range(1, 356).select(F.col("id").alias("rank"), F.col("id").isin(*ranks).alias("is_active"))).first()
    assert m["auc"] == pytest.approx(auc, abs=1e-5) and m["ef1"] == pytest.approx(ef1, abs=1e-4) and m["ef5"] == pytest.approx(ef5, abs=1e-4) and m["bedroc"] == pytest.approx(bedroc, abs=1e-5)
    assert ef10 is None or m["ef10"] == pytest.approx(ef10, abs=1e-4)


def rows(spark, data):
    return spark.createDataFrame(data, "name string, key double, is_active boolean")


def test_unrankable_goes_last_or_is_dropped(spark):
    df = rows(spark, [("a", 1.0, True), ("d1", 2.0, False), ("d2", 3.0, False), ("b", None, True)])
    assert R.report(df)[0].first()["auc"] == 0.5 and R.report(df, missing="drop")[0].first()["auc"] == 1.0
    r = R.report(df)[0].first()
    assert (r["rankable"], r["unrankable"]) == (3, 1)


@pytest.mark.parametrize("flags", ["1100", "0011", "1010"])
def test_auc_of_flag_lists(spark, flags):
    df = rows(spark, [(str(i), float(i), c == "1") for i, c in enumerate(flags)])
    assert R.metrics(R.rank_rows(df)).first()["auc"] == {"1100": 1.0, "0011": 0.0, "1010": 0.75}[flags]


def test_no_or_only_actives_have_no_metrics(spark):
    for active in (True, False):
        m = R.metrics(R.rank_rows(rows(spark, [("a", 1.0, active), ("b", 2.0, active)]))).first()
        assert m["auc"] is None and m["bedroc"] is None
        assert R.metrics(R.rank_rows(rows(spark, [("a", 1.0, active)]))).withColumn("p", R.gate()).first()["p"] is False


def test_ranks_are_those_of_one_sort(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("name"), F.when(F.col("id") % 7 != 0, F.col("id") % 13).cast("double").alias("key"), F.when(F.col("id") % 5 != 0, -F.col("id")).alias("other"), F.lit(1).alias("at"))
    rows = df.collect()
    want = sorted(rows, key=lambda r: (r["key"] is None, r["key"] or 0, r["name"]))
    ranked = R.rank_rows(df.repartition(7))
    assert {r["name"]: r["rank"] for r in ranked.collect()} == {r["name"]: i for i, r in enumerate(want, 1)} and ranked.columns == [*df.columns, "rank"]
    places = [{r["name"]: i for i, r in enumerate(sorted((r for r in rows if r[k] is not None), key=lambda r: (r[k], r["name"])))} for k in ("key", "other")]
    got = {r["name"]: r["combined"] for r in R.combined_key(df, "key", "other").collect()}
    assert got == {r["name"]: places[0][r["name"]] + places[1][r["name"]] if r["name"] in places[0] and r["name"] in places[1] else None for r in rows}
    assert R.rank_rows(df.limit(0)).count() == 0
    # no window, so no task that sorts all rows
    assert "Window" not in R.rank_rows(df)._jdf.queryExecution().toString()


def test_replicates(spark):
    df = spark.createDataFrame([("m", 3.1), ("m", 3.0), ("m", None), ("m", 3.2), ("x", 1.0), ("y", None)], "molecule string, v double")
    got = {r["molecule"]: r for r in R.replicate_stats(df, "molecule", "v").collect()}
    assert got["m"]["median"] == 3.1 and got["m"]["best"] == 3.0 and got["m"]["spread"] == pytest.approx(0.2) and got["x"]["spread"] == 0 and got["y"]["best"] is None and got["y"]["spread"] == 0


def test_library(spark):
    m = spark.createDataFrame([("a", 10, 1), ("b", 50, 1), ("c", 10, 0), ("d", None, None)], "name string, heavy_atoms int, aromatic_n int")
    kept, out = L.split_domain(m)
    assert [r["name"] for r in kept.collect()] == ["a"] and {r["name"]: r["reason"] for r in out.collect()} == {"b": "too many heavy atoms", "c": "no aromatic nitrogen", "d": "unparseable"}
    kinds = "name string, smiles string, line int, mw double, logp double, rotb int, hbd int, hba int, fp array<int>"
    acts = spark.createDataFrame([("A", "sa", 0, 300.0, 2.0, 3, 1, 4, [1, 2, 3, 4])], kinds)
    pool = spark.createDataFrame([("p", "s1", 0, 310.0, 2.5, 4, 1, 5, [9]), ("q", "s2", 1, 324.0, 2.0, 3, 1, 4, [1, 2, 3]), ("r", "s3", 2, 326.0, 2.0, 3, 1, 4, []), ("t", "s1", 3, 276.0, 1.2, 1, 2, 2, [7, 8])], kinds)
    found = L.candidates(acts, pool)
    assert {r["name"] for r in found.collect()} == {"p", "q", "t"}
    far = L.dissimilar(found, acts)
    assert {r["name"] for r in far.collect()} == {"p", "t"}
    assert [r["name"] for r in L.best_matches(far, 1).collect()] == ["p"]
    turns = spark.createDataFrame([("A", 0)], "active string, turn int")
    assert [tuple(r) for r in L.greedy_matches(far, turns).collect()] == [("A", "p")]  # t is the same molecule


def test_greedy_rounds_equal_taking_turns(spark):
    import random

    rnd = random.Random(4)
    rows = [(f"a{a}", f"s{s}", f"n{s}_{i}", rnd.randrange(30)) for a in range(8) for s in range(40) for i in range(2) if rnd.random() < 0.4]
    turns = [(f"a{a}", (a * 5) % 8) for a in range(8)]
    used, want = set(), set()
    for active, _ in sorted(turns, key=lambda t: t[1]):
        n = 0
        for _, s, name, _ in sorted((r for r in rows if r[0] == active), key=lambda r: (r[3], r[2])):
            if n < 6 and s not in used:
                used.add(s)
                want.add((active, name))
                n += 1
    got = L.greedy_matches(spark.createDataFrame(rows, "active string, smiles string, name string, line int"), spark.createDataFrame(turns, "active string, turn int"), per_active=6)
    assert {tuple(r) for r in got.collect()} == want


def test_more_actives_than_one_broadcast(spark):
    pool, acts = spark.createDataFrame([(1, ["a", "b"]), (2, ["z"]), (3, [])], "id int, fp array<string>"), spark.createDataFrame([(["a"],), (["a", "b", "c"],)], "fp array<string>")
    a, b = ({r["id"]: r["top"] for r in L.best_similarity(pool, acts, "id", largest=n).collect()} for n in (1, 10))
    assert a == b == {1: pytest.approx(2 / 3), 2: 0, 3: 0}
    points = spark.createDataFrame([(i % 3, float(i), 0.0, 0.0) for i in range(30)], "g int, x double, y double, z double")
    from tidewatch.operators import geometry as G

    near = lambda n: {r["g"]: r["dist"] for r in G.min_distance(points.where("x > 9"), points.where("x < 9").select("x", "y", "z"), ("g",), block=n).collect()}
    assert near(2) == near(100) == {0: 4.0, 1: 2.0, 2: 3.0}


def test_best_similarity_judges_every_row(spark):
    rows = [(1, ["a", "b"]), (2, [str(i) for i in range(5000)] + ["a"]), (3, []), (4, ["z"]), (5, None), (None, ["a", "b", "c"]), (6, ["z"]), (6, ["a"])]
    items = [["a", "b"], ["a"], [], ["c", "d"]]
    share = lambda x, y: len(set(x or []) & set(y)) / max(1, len(set(x or []) | set(y)))
    want = {}
    for k, x in rows:
        want[k] = max([want.get(k, 0.0), *(share(x, y) for y in items)])
    pool, acts = spark.createDataFrame(rows, "id int, fp array<string>"), spark.createDataFrame([(x,) for x in items], "fp array<string>")
    got = {r["id"]: r["top"] for r in L.best_similarity(pool, acts, "id").collect()}
    assert got == pytest.approx(want)


def test_long_documents_are_judged(spark, tmp_path):
    from tidewatch.plans import catalogue

    docs = [(1, "far away " * 400, 3600), (2, "the item itself", 15), (3, "no length", None)]
    spark.createDataFrame(docs, "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("the item itself",)], "text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(r["doc_id"] for r in catalogue.QUERIES["similarity_anti"](spark, str(tmp_path)).collect()) == [1, 3]
