"""A replay that is kept up to date equals one over all records, after every release."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import backtest as B
from tidewatch.operators import store as S
from tidewatch.operators.replay import Replay

KIND = "isolate_key string, target_creation_date string, collection_date string, erg11_call string"


def release(rnd, before):
    """Records leave, change (call, either date, both) and come; some have no usable date or no call."""
    day = lambda: rnd.choice([f"20{rnd.randrange(20, 24)}-{rnd.randrange(1, 13):02d}-{rnd.randrange(1, 29):02d}"] * 9 + ["", "2021", None])
    some = lambda k: (k, day(), rnd.choice(["2019", "2022-05", "", None]), rnd.choice(["Y132F", "K143R", "Y132F,K143R", "Y132F, Y132F", "", None]))
    rows = {k: some(k) if rnd.random() < 0.1 else r for k, r in before.items() if rnd.random() < 0.9}
    for _ in range(60):
        k = f"i{rnd.randrange(400)}"
        rows.setdefault(k, some(k))
    return rows


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_replay_follows_releases(spark, tmp_path):
    rnd, held = random.Random(4), {}
    kept = Replay(spark, str(tmp_path / "replay"), "Y132F", window_days=90, min_count=2)
    frame = lambda rows: spark.createDataFrame(sorted(rows.values()), KIND) if rows else spark.createDataFrame([], KIND)
    for n in range(1, 5):
        new = release(rnd, held) if n != 4 else {k: r for k, r in held.items() if k < "i2"}
        kept.update(S.changes(frame(held), frame(new)))
        held = new
        full = frame(held)
        assert rows_of(kept.walk()) == rows_of(B.walk_forward(full, target="Y132F", window_days=90, min_count=2))
        _, signals = B.replay_signals(full, B.steps(full), window_days=90, min_count=2)
        assert rows_of(kept.signals()) == rows_of(signals.select(kept.signals().columns))
        assert kept.version() == n and os.listdir(tmp_path / "replay") == [f"v{n}"]


def test_only_touched_steps_are_computed_again(spark, tmp_path):
    rows = [(f"i{i}", f"20{20 + i // 12}-{i % 12 + 1:02d}-10", "2019", "Y132F") for i in range(48)]
    old, late = spark.createDataFrame(rows, KIND), spark.createDataFrame([("z", "2023-11-20", "2019", "K143R")], KIND)
    kept = Replay(spark, str(tmp_path / "r"), window_days=60).update(S.changes(old.limit(0), old))
    assert kept.touched == datetime.date(2020, 1, 1)
    kept.update(S.changes(old, old.unionByName(late)))
    assert kept.touched == datetime.date(2023, 10, 1) and rows_of(kept.walk()) == rows_of(B.walk_forward(old.unionByName(late), window_days=60))
    kept.update(S.changes(old, old))
    assert kept.touched is None and rows_of(kept.walk()) == rows_of(B.walk_forward(old.unionByName(late), window_days=60))


def test_an_update_that_died_is_run_again(spark, tmp_path):
    rows = [(f"i{i}", f"2021-{i % 12 + 1:02d}-10", "2019", "Y132F") for i in range(30)]
    old, new = spark.createDataFrame(rows[:20], KIND), spark.createDataFrame(rows[5:], KIND)
    kept = Replay(spark, str(tmp_path / "r"), window_days=60).update(S.changes(old.limit(0), old))
    broken = S.changes(old, new).withColumn("weight", F.when(F.col("isolate_key") == "i25", F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("weight")))
    with pytest.raises(Exception, match="lost"):
        kept.update(broken)
    assert kept.version() == 1 and rows_of(kept.walk()) == rows_of(B.walk_forward(old, window_days=60))
    Replay(spark, str(tmp_path / "r"), window_days=60).update(S.changes(old, new))
    assert kept.version() == 2 and rows_of(kept.walk()) == rows_of(B.walk_forward(new, window_days=60))


def test_changes(spark):
    a = spark.createDataFrame([("1", "x"), ("2", "y"), ("3", None), ("4", "z")], "isolate_key string, v string")
    b = spark.createDataFrame([("1", "x"), ("2", "Y"), ("3", None), ("5", "w")], "isolate_key string, v string")
    assert rows_of(S.changes(a, b)) == sorted([("2", "y", -1), ("2", "Y", 1), ("4", "z", -1), ("5", "w", 1)], key=str)


def test_an_update_works_out_its_changes_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    weigh = F.udf(lambda k: seen.add(1) or 1, "int")
    rows = [(f"i{i}", f"2021-{i % 12 + 1:02d}-10", "2019", "Y132F") for i in range(30)]
    records = spark.createDataFrame(rows, KIND)
    kept = Replay(spark, str(tmp_path / "r"), window_days=60).update(records.withColumn("weight", weigh("isolate_key")))
    assert seen.value == len(rows) and rows_of(kept.walk()) == rows_of(B.walk_forward(records, window_days=60))
