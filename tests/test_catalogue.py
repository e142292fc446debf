"""Every registered query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidewatch.plans import catalogue, catalogue_files

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return c


def plain(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 5) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query(spark, con, name):
    got = catalogue.QUERIES[name](spark, DATA)
    cols = sorted(got.columns)
    want = con.execute(catalogue.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    key = lambda r: tuple(str(x) for x in r)
    a = sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=key)
    b = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=key)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(p == q or isinstance(p, float) and q is not None and math.isclose(p, float(q), abs_tol=2e-5) for p, q in zip(x, y)), (x, y)


def test_greedy_decoys(spark):
    """Against a walk over the actives in turn."""
    parts = spark.read.parquet(f"{DATA}/part.parquet").orderBy("p_partkey").collect()
    used, want = set(), set()
    for a in (p for p in parts if p["p_brand"] == "Brand#11"):
        near = [p["p_partkey"] for p in parts if p["p_brand"] != "Brand#11" and abs(p["p_retailprice"] - a["p_retailprice"]) <= 25 and abs(p["p_size"] - a["p_size"]) <= 2 and p["p_partkey"] not in used][:5]
        used |= set(near)
        want |= {(str(a["p_partkey"]), str(k)) for k in near}
    assert {tuple(r) for r in catalogue_files.greedy_decoys(spark, DATA).collect()} == want


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns and df.count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_places_follow_the_table(spark, tmp_path):
    """Rows of one line number are placed in the table's order, whichever part is read first: Spark reads the larger part first."""
    schema = "l_orderkey long, l_linenumber int, l_quantity double, l_discount double"
    made = [[(1, 1, 10.0, 0.0), (1, 2, 20.0, 0.5)], [(1, 2, 30.0, 0.5), (1, 2, 40.0, 0.0), (1, 3, 50.0, 0.5), *[(k, 1, float(k), 0.5) for k in range(2, 5000)]]]
    for i, rows in enumerate(made):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/x{i}")
        os.makedirs(f"{tmp_path}/lineitem.parquet", exist_ok=True)
        os.rename(glob.glob(f"{tmp_path}/x{i}/part-*.parquet")[0], f"{tmp_path}/lineitem.parquet/part-{i}.parquet")
    # lines 1, 2, 2, 2, 3 against scores 20, 30, 50
    got = catalogue.QUERIES["positional_join"](spark, str(tmp_path)).where("l_orderkey = 1").collect()
    assert [(r["v"], r["n"]) for r in got] == [(1 * 20 + 2 * 30 + 2 * 50, 3)]
