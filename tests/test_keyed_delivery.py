"""The memory of deliveries as keyed state."""

import random

from tidewatch.operators.alerts import TIERS
from tidewatch.streaming import delivery

KIND = "token string, tier string, release string, headline string"


def run(spark, tmp_path, rows=None):
    if rows:
        spark.createDataFrame(rows, KIND).write.mode("append").parquet(f"{tmp_path}/alerts")
    delivery.deliver_news(spark.readStream.schema(KIND).parquet(f"{tmp_path}/alerts"), f"{tmp_path}/news", f"{tmp_path}/memory").awaitTermination()
    return sorted(tuple(r) for r in spark.read.schema(KIND + ", prior string").parquet(f"{tmp_path}/news").collect())


def test_all_new_no_news_one_escalation(spark, tmp_path):
    """Each release comes to a query that is started again; the memory lives in the checkpoint."""
    before = spark.conf.get(delivery.PROVIDER)
    first = [("Y132F", "act-now", "1", "y"), ("K143R", "watch", "1", "k"), ("TR34", "context", "1", "t"), (None, "watch", "1", "n"), ("F126L", "someday", "1", "f")]
    got = run(spark, tmp_path, first)
    assert [(r[0], r[4]) for r in got] == [("K143R", None), ("TR34", None), ("Y132F", None)]
    assert run(spark, tmp_path, [("Y132F", "act-now", "2", "y2"), ("K143R", "watch", "2", "k2"), ("TR34", "context", "2", "t2")]) == got
    more = run(spark, tmp_path, [("TR34", "watch", "3", "t3"), ("Y132F", "context", "3", "y3"), ("K143R", "watch", "3", "k3")])
    assert set(more) - set(got) == {("TR34", "watch", "3", "t3", "context")} and len(more) == 4
    assert run(spark, tmp_path) == more  # nothing new at all
    assert {tuple(r) for r in delivery.remembered(spark, f"{tmp_path}/memory").collect()} == {("Y132F", "act-now"), ("K143R", "watch"), ("TR34", "watch")}
    assert spark.conf.get(delivery.PROVIDER) == before


def test_releases_of_one_batch_are_taken_in_order(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(f"t{rnd.randrange(20)}", rnd.choice(TIERS), f"{rnd.randrange(6)}", "h") for _ in range(150)]
    want, held = set(), {}
    for token, tier, release, _ in sorted(rows, key=lambda r: (r[2], TIERS.index(r[1]))):
        if token not in held or TIERS.index(tier) < TIERS.index(held[token]):
            want.add((token, tier, release, "h", held.get(token)))
            held[token] = tier
    assert set(run(spark, tmp_path, rows)) == want
