"""Releases and paged pools read by several tasks, equal to reading them whole."""

import csv
import json
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.sources import feeds


@pytest.fixture(scope="module")
def release(tmp_path_factory):
    rnd, path = random.Random(2), tmp_path_factory.mktemp("feed") / "r.tsv"
    columns = ["other", *feeds.RAW_COLUMNS[:3], "more", *feeds.RAW_COLUMNS[3:]]
    rows = [[rnd.choice(["", "x", "é中", "a b", 'in "quotes"', "India: Delhi"]) + str(i % 7) for _ in columns] for i in range(800)]
    with open(path, "w", encoding="utf-8", newline="") as f:
        w = csv.writer(f, delimiter="\t", lineterminator="\r\n")
        w.writerow(columns)
        w.writerows(rows)
    with open(path, "a") as f:
        f.write("short\trow")  # no line end, fields missing
    want = [tuple(r[columns.index(c)] for c in feeds.RAW_COLUMNS) for r in rows] + [("row", *[None] * 7)]
    return path, want


def read(spark, path, split, schema=None, push="false"):
    spark.dataSource.register(feeds.ReleaseSource)
    r = spark.read.format("release").option("url", f"file:{path}").option("split_bytes", split).option("push_filters", push)
    return (r.schema(schema) if schema else r).load()


@pytest.mark.parametrize("split", [97, 1000, 10**9])
def test_ranges_equal_the_whole(spark, release, split):
    path, want = release
    df = read(spark, path, split)
    assert df.rdd.getNumPartitions() == max(1, -(-path.stat().st_size // split))
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)


def test_columns_and_filters(spark, release):
    path, want = release
    place = {c: i for i, c in enumerate(feeds.RAW_COLUMNS)}
    some = read(spark, path, 5000, "Run string, nothing string")
    assert sorted((r["Run"], r["nothing"]) for r in some.where("Run is not null").collect()) == sorted((w[place["Run"]], None) for w in want if w[place["Run"]] is not None)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        for cond, f in (("Run = 'x3'", lambda r: r == "x3"), ("Run in ('x3', 'a b1')", lambda r: r in ("x3", "a b1")), ("Run is null", lambda r: r is None), ("Run like 'India%'", lambda r: r is not None and r.startswith("India")), ("Run > 'x'", lambda r: r is not None and r > "x")):
            got = read(spark, path, 5000, push="true").where(cond)
            assert got.count() == sum(bool(f(w[place["Run"]])) for w in want)
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert ("Filter (" in plan) == (cond == "Run > 'x'")  # all others are the source's
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_an_empty_release(spark, tmp_path):
    (tmp_path / "e.tsv").write_text("")
    assert read(spark, tmp_path / "e.tsv", 100).count() == 0
    (tmp_path / "h.tsv").write_text("Run\ttarget_acc\n")
    assert read(spark, tmp_path / "h.tsv", 3).count() == 0


def test_pages_of_a_pool(spark, tmp_path):
    items = [{"id": f"m{i}", "structures": {"smiles": f"C{i}"} if i % 5 else None, "weight": i} for i in range(47)]
    for at in range(0, 47, 10):
        (tmp_path / f"p{at}-10.json").write_text(json.dumps({"meta": {"total": 47}, "molecules": items[at : at + 10]}))
    (tmp_path / "p30-10.json").write_text("{broken")
    spark.dataSource.register(feeds.PoolSource)
    pool = spark.read.format("pool").schema("name string, smiles string, weight string").options(url=f"file:{tmp_path}/p{{offset}}-{{limit}}.json", limit=10, total="meta.total", items="molecules", paths="name=id, smiles=structures.smiles")
    df = pool.load()
    assert df.rdd.getNumPartitions() == 5
    assert sorted(map(tuple, df.collect())) == sorted((f"m{i}", f"C{i}", str(i)) for i in range(47) if i % 5 and not 30 <= i < 40)
    with pytest.raises(Exception, match="Expecting|JSON"):
        pool.option("strict", "true").load().collect()
    assert spark.read.format("pool").option("url", f"file:{tmp_path}/none").load().where(F.col("name") == "x").count() == 0
