"""Pose files read in splits, lists ranked together, and gates of all modes, against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import geometry as G
from tidewatch.operators import ranking as R
from tidewatch.plans import gates
from tidewatch.sources import structures as S
from tests.test_structures import RECEPTOR, atom


def plain(text):
    """(number, atoms) of each closed model, and all scores, line by line."""
    models, scores, number, now = [], [], None, []
    for line in text.split("\n"):
        line = line.rstrip("\r")
        if line.startswith("MODEL"):
            number, now = int(line.split()[1]), []
        elif line.startswith("ENDMDL") and number is not None:
            models.append((number, now))
        elif line.startswith("REMARK VINA RESULT"):
            scores.append(float(line.split()[3]))
        elif line.startswith(("ATOM", "HETATM")):
            name, element = line[12:16].strip(), line[76:78].strip()
            if (element or name[0]).upper() != "H":
                now.append((name, float(line[30:38]), float(line[38:46]), float(line[46:54])))
    return models, scores


def written(rnd, k, models=60):
    """A pose file: numbers that don't begin at 1, scores that are left out, models without an end, a preamble, either line end."""
    out = ["REMARK VINA RESULT:   -1.5   0 0", "REMARK x"] if k % 3 == 1 else []
    for m in range(models):
        out.append(f"MODEL {m * 2 + k}")
        out += [f"REMARK VINA RESULT:   {-rnd.randrange(20, 99) / 10}   0.0  0.0"] if rnd.random() < 0.8 else []
        for i in range(rnd.randrange(0, 6)):
            name, element = rnd.choice([("N1", "N"), ("C1", "C"), ("H1", "H"), ("NA", "")])
            out.append(atom(i, name, "LIG", 1, *[rnd.uniform(-20, 20) for _ in range(3)], element, rnd.choice(["ATOM", "HETATM"])))
        out += ["TER", "ENDMDL"] if rnd.random() < 0.85 else []
    return ("\r\n" if k % 2 else "\n").join(out) + ("" if k % 4 == 3 else "\n")


@pytest.fixture(scope="module")
def screens(tmp_path_factory):
    d, rnd, texts = tmp_path_factory.mktemp("screens"), random.Random(11), {}
    (d / "receptor.pdb").write_text("\n".join(RECEPTOR))
    for seed in (1, 2, 3):
        (d / "screen" / f"s{seed}").mkdir(parents=True)
        for k in range(8):
            text = written(rnd, k) if k != 5 else "" if seed == 1 else "REMARK nothing\n"
            (d / "screen" / f"s{seed}" / f"m{k}_out.pdbqt").write_bytes(text.encode())
            texts[f"m{k}", seed] = text
    return d, texts


@pytest.mark.parametrize("split", ["64", "1000", "128m"])
def test_models_of_splits(spark, screens, split):
    """However files are cut, the models are those of reading line by line."""
    d, texts = screens
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        found = S.models(spark, str(d / "screen"))
        assert split == "128m" or found.rdd.getNumPartitions() > len(texts)
        got = {}
        for r in S.placed(found.withColumn("atoms", S.model_atoms(F.col("text")))).withColumn("m", S.file_parts(F.col("file"))[0]).withColumn("s", S.file_parts(F.col("file"))[1]).collect():
            got.setdefault((r["m"], r["s"]), []).append(r)
        scores = {}
        for r in S.placed_scores(S.placed(found)).withColumn("m", S.file_parts(F.col("file"))[0]).withColumn("s", S.file_parts(F.col("file"))[1]).collect():
            scores.setdefault((r["m"], r["s"]), []).append((r["model"], r["score"]))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    for at, text in texts.items():
        models, want = plain(text)
        mine = sorted((r for r in got.get(at, []) if r["closed"]), key=lambda r: r["model"])
        assert [r["model"] for r in mine] == list(range(1, len(models) + 1))
        assert [(r["number"], [tuple(a) for a in r["atoms"]]) for r in mine] == models
        assert sorted(scores.get(at, [])) == list(enumerate(want, 1))


def test_features_of_arrays_equal_those_of_rows(spark, screens):
    d, _ = screens
    found = S.models(spark, str(d / "screen")).where("closed").withColumn("atoms", S.model_atoms(F.col("text")))
    point, normal = (0.5, 1.0, -2.0), (0.6, 0.0, 0.8)
    keys = ("file", "split", "seq")
    rows = found.select(*keys, F.explode("atoms").alias("a")).select(*keys, "a.*")
    a = {r[:3]: r[3:] for r in map(tuple, G.model_features(found.select(*keys, "atoms"), point, normal).collect())}
    b = {r[:3]: r[3:] for r in map(tuple, G.pose_features(rows, point, normal, keys).collect())}
    assert len(a) > 1000 and all(b.get(k, (None,) * 3) == v for k, v in a.items())


def test_lists_ranked_together(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["a", "b", None, "one"] if i % 50 else ["one"]), f"n{i:04d}", rnd.choice([None, 1.0, 2.0, rnd.random()]), rnd.random() < 0.2) for i in range(900)] + [("single", "x", None, True)]
    df = spark.createDataFrame(rows, "list string, name string, key double, is_active boolean").repartition(9)
    ranked = R.rank_lists(df, ("list",))
    assert ranked.columns == [*df.columns, "rank"]
    got, m = {}, {r["list"]: r for r in R.metrics(ranked.where("list is not null"), by=("list",)).collect()}
    for r in ranked.collect():
        got.setdefault(r["list"], []).append((r["rank"], r["name"], r["is_active"]))
    for name in {r[0] for r in rows}:
        want = sorted((r for r in rows if r[0] == name), key=lambda r: (r[2] is None, r[2] or 0, r[1]))
        assert [x[1] for x in sorted(got[name])] == [r[1] for r in want] and [x[0] for x in sorted(got[name])] == list(range(1, len(want) + 1))
        if name not in (None, "single"):
            one = R.metrics(R.rank_rows(df.where(F.col("list") == name))).first()
            assert [m[name][c] for c in one.asDict()] == pytest.approx(list(one))
    assert m["single"]["auc"] is None and m["single"]["n"] == m["single"]["n_active"] == 1


def median(v):
    v = sorted(v)
    return None if not v else (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2


def test_gate_modes_equal_loops(spark, screens):
    d, texts = screens
    iron, per, whole = (0.0, 0.0, 10.0), {}, {}
    for (m, seed), text in sorted(texts.items()):
        models, scores = plain(text)
        dist = [min((math.dist(a[1:], iron) for a in atoms if a[0].startswith("N")), default=None) for _, atoms in models]
        if models:
            per[m, seed] = min((x for x in dist if x is not None), default=None), scores[0] if scores else None
    for m in {m for m, _ in per}:
        mine = [per[k] for k in sorted(per) if k[0] == m]
        found = [x for x, _ in mine if x is not None]
        whole[m] = min(found, default=None), mine[0][1], median(found)
    place = lambda i: {m: n for n, m in enumerate(sorted((m for m in whole if whole[m][i] is not None), key=lambda m: (whole[m][i], m)))}
    one, two = place(0), place(1)
    lists = {("distance", None): {m: v[0] for m, v in whole.items()}, ("min", None): {m: v[0] for m, v in whole.items()}, ("score", None): {m: v[1] for m, v in whole.items()}, ("median", None): {m: v[2] for m, v in whole.items()}}
    lists["combined", None] = {m: one[m] + two[m] if m in one and m in two else None for m in whole}
    lists |= {("seed", s): {m: v[0] for (m, x), v in per.items() if x == s} for s in (1, 2, 3)}
    acts = {"m1", "m4", "m6", "gone"}
    poses = gates.screen(spark, str(d / "screen"), str(d / "receptor.pdb"))
    got = {(r["mode"], r["seed"]): r for r in gates.gate_modes(poses, spark.createDataFrame([(a,) for a in acts], "name string")).collect()}
    assert got.keys() == lists.keys()
    for k, keys in lists.items():
        order = sorted(keys, key=lambda m: (keys[m] is None, keys[m] or 0, m))
        ranks = [i for i, m in enumerate(order, 1) if m in acts]
        n, a = len(order), len(ranks)
        assert (got[k]["n"], got[k]["n_active"], got[k]["missing_actives"], got[k]["unrankable"]) == (n, a, 4 - a, sum(v is None for v in keys.values()))
        assert got[k]["auc"] == pytest.approx(1 - (sum(ranks) - a * (a + 1) / 2) / (a * (n - a)))


def test_poses_are_read_once(spark, screens):
    d, _ = screens
    poses = gates.screen(spark, str(d / "screen"), str(d / "receptor.pdb"))
    plan = gates.gate_modes(poses, spark.createDataFrame([("m1",)], "name string"))._jdf.queryExecution().toString()
    assert "screen/s1" not in plan and "Scan text" not in plan
