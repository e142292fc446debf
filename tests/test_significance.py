"""Interval and test of a gate against plain loops over the same draws."""

import hashlib
import random

import pytest

from tidewatch.operators import ranking as R


def uniform(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 2**52


@pytest.fixture(scope="module")
def ranked(spark):
    rnd = random.Random(5)
    rows = [(f"m{i}", i, rnd.random() < (0.3 if i < 40 else 0.05)) for i in range(1, 121)]
    return rows, spark.createDataFrame(rows, "name string, rank int, is_active boolean")


def test_bootstrap_equals_a_loop(ranked):
    rows, df = ranked
    acts = [r for r in rows if r[2]]
    above = {r[0]: sum(not x[2] for x in rows[: r[1] - 1]) / (len(rows) - len(acts)) for r in acts}
    draws = []
    for b in range(1, 301):
        w = {n: sum(uniform(3, b, n) >= c for c in R._POISSON) for n in above}
        if sum(w.values()):
            draws.append(1 - sum(w[n] * above[n] for n in w) / sum(w.values()))
    draws.sort()
    at = lambda q: draws[int(q * (len(draws) - 1))] + (q * (len(draws) - 1) % 1) * (draws[min(len(draws) - 1, int(q * (len(draws) - 1)) + 1)] - draws[int(q * (len(draws) - 1))])
    got = R.bootstrap_auc(df, 300, 3, 0.9).first()
    assert got["replicates"] == len(draws) and got["auc_mean"] == pytest.approx(sum(draws) / len(draws))
    assert got["auc_lo"] == pytest.approx(at(0.05)) and got["auc_hi"] == pytest.approx(at(0.95))
    assert got["auc_lo"] < R.metrics(df).first()["auc"] < got["auc_hi"]


def test_permutation_equals_a_loop(ranked):
    rows, df = ranked
    n, ranks = len(rows), [r[1] for r in rows if r[2]]
    m, better = len(ranks), 0
    for b in range(1, 401):
        taken = []
        for j in range(1, m + 1):
            at = min(int(uniform(9, b, j) * (n - m + j)) + 1, n - m + j)
            taken.append(n - m + j if at in taken else at)
        assert len(set(taken)) == m and max(taken) <= n
        better += sum(taken) <= sum(ranks)
    got = R.permutation_test(df, 400, 9).first()
    assert (got["n"], got["n_active"], got["replicates"]) == (n, m, 400) and got["p_value"] == pytest.approx((better + 1) / 401)


def test_chance_is_no_signal_and_a_perfect_ranking_is(spark):
    frame = lambda hit: spark.createDataFrame([(f"m{i}", i, hit(i)) for i in range(1, 201)], "name string, rank int, is_active boolean")
    assert R.permutation_test(frame(lambda i: i <= 10), 500).first()["p_value"] == pytest.approx(1 / 501)
    assert R.permutation_test(frame(lambda i: i % 20 == 10), 500).first()["p_value"] > 0.2
    none = frame(lambda i: False)
    assert R.permutation_test(none, 10).first()["p_value"] is None and R.bootstrap_auc(none, 10).first()["auc_lo"] is None
