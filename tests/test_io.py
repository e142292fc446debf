import json

import pytest
from pyspark.sql import functions as F

from tests.cohorts import AS_OF, demo
from tidewatch import provenance as P
from tidewatch.operators.store import SNAPSHOT_COLUMNS, upsert
from tidewatch.plans import surveillance as W
from tidewatch.sources import feeds, sinks
from tidewatch.streaming import releases


def records(spark):
    rows = [tuple({"isolate_key": k, "target_creation_date": v, "collection_date": c, "erg11_call": call, "country": land, "resistance_source": s}.get(col, "") for col in SNAPSHOT_COLUMNS) for k, v, c, call, land, s in demo()]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in SNAPSHOT_COLUMNS))


def test_snapshot_round_trip_is_byte_stable(spark, tmp_path):
    r = records(spark).withColumn("lat_lon", F.when(F.col("isolate_key") == "P001", 'a "b"\tc').otherwise(""))
    sha = sinks.write_snapshot(r, str(tmp_path / "a.tsv"))
    assert sha == sinks.snapshot_sha256(r.repartition(5)) == sinks.write_snapshot(feeds.read_snapshot(spark, str(tmp_path / "a.tsv")), str(tmp_path / "b.tsv"))
    assert (tmp_path / "a.tsv").read_bytes() == (tmp_path / "b.tsv").read_bytes()
    sinks.write_working_copy(r, str(tmp_path / "p"), "R1")
    sinks.write_working_copy(r.limit(3), str(tmp_path / "p"), "R2")
    assert spark.read.parquet(str(tmp_path / "p")).groupBy("release").count().count() == 2


def test_feed_sources(spark, tmp_path):
    (tmp_path / "f.tsv").write_text("other\ttarget_acc\tRun\tgeo_loc_name\ttarget_creation_date\tcollection_date\nx\tPDT1.1\tR1\tIndia: Delhi\t2024-01-01\t2023\ny\tNULL\t\t\t\t\n")
    path = str(tmp_path / "f.tsv")
    a, b = feeds.read_records(spark, tsv=path).collect(), feeds.read_records(spark, url=f"file:{path}").collect()
    assert a == b and len(a) == 1 and a[0]["country"] == "India"
    with pytest.raises(ValueError):
        feeds.read_records(spark)
    listing = spark.createDataFrame([('<a href="PDG000000067.99/">',), ('<a href="PDG000000067.671/"> <a href="PDG000000067.670/">',)], "value string")
    assert feeds.latest_release(listing) == "PDG000000067.671"
    with pytest.raises(ValueError):
        feeds.latest_release(listing.limit(0))


def test_index_upsert(spark):
    df = lambda *r: spark.createDataFrame(list(r), "release_tag string, path string")
    got = upsert(df(("P.9", "a"), ("P.10", "b")), df(("P.9", "c"), ("P.11", "d"))).collect()
    assert [tuple(r) for r in got] == [("P.9", "c"), ("P.10", "b"), ("P.11", "d")]


def test_run_log(spark, tmp_path):
    log = str(tmp_path / "runs.jsonl")
    assert feeds.read_runs(spark, log).count() == 0
    with P.recorded(log, "fill", {"none": ["no-such-tool"]}) as run:
        run.add(key="a", outcome="called")
    with open(log, "a") as f:
        f.write("{broken\n")
    with pytest.raises(RuntimeError), P.recorded(log, "fill"):
        raise RuntimeError("x")
    got = feeds.read_runs(spark, log, "fill").collect()
    assert sorted(r["status"] for r in got) == ["error", "ok"] and json.loads(open(log).readline())["items"] == [{"key": "a", "outcome": "called"}]
    with P.recorded(str(tmp_path / "no" / "log"), "x"):
        pass  # only warned of


def test_config_and_digests(spark, tmp_path):
    text = "box:  # pocket\n  size: [20, 20.5, 22]\n  seed: 7\n  name: 'x'\nbar:\n  auc: 0.7\n"
    p = P.load_protocol(text, P.text_digest(text)[:8])
    assert p["sections"] == {"box": {"size": [20, 20.5, 22], "seed": 7, "name": "x"}, "bar": {"auc": 0.7}} and p["frozen"] == "ok"
    assert P.check_digest(text + " ", p["sha256"]) == "changed" and P.check_digest(None, "x") == "missing" and P.check_digest(text, None) == "unpinned"
    for bad in ("  a: 1\n", "a: 1\n", "a\n", "a:\n  b: 1\n  b: 2\n"):
        with pytest.raises(ValueError):
            feeds.parse_config(bad)
    assert "SEED=7" in sinks.shell_assignments(p["sections"])
    (tmp_path / "f").write_text("abc")
    assert P.digests(spark, str(tmp_path / "f")).first()["sha256"] == P.text_digest("abc")


def test_molecules_and_tables(spark, tmp_path):
    (tmp_path / "l.smi").write_text("C\ta\nCC\nCCC\tb\tx\nN\tc\n")
    got = feeds.read_molecules(spark, str(tmp_path / "l.smi")).orderBy("line").collect()
    assert [(r["name"], r["status"]) for r in got] == [("a", "ok"), (None, "malformed"), (None, "malformed"), ("c", "ok")]
    (tmp_path / "t.tsv").write_text("# note\n\nname\texpected\na\tY132F\n")
    assert feeds.read_commented(spark, str(tmp_path / "t.tsv")).collect()[0]["expected"] == "Y132F"
    state = spark.createDataFrame([('{"delivered": {"a": "watch", "b": "odd"}}',), ("",), (None,)], "s string").select(feeds.read_state(F.col("s")).alias("m")).collect()
    assert [r["m"] for r in state] == [{"a": "watch"}, {}, {}]
    table = sinks.ranked_table(spark.createDataFrame([("a", 1.0, -9.95), ("b", None, None)], "name string, dist double, score double")).collect()
    assert [(r["dist"], r["score"]) for r in table] == [("1.000", "-9.9"), ("no_pose", "NA")] or table[0]["score"] == "-10.0"
    assert "2 rows" in sinks.candidate_report(spark.createDataFrame([(1, "a"), (2, "b")], "rank int, name string"))


class Fixed:
    def verdicts(self, tokens):
        return tokens.select("token", *[F.lit(x).alias(n) for n, x in (("evidence_class", "e"), ("confidence", "measured"), ("direction", "weaker-fit"), ("verdict", "v"))])


def test_delivery(spark):
    none = spark.createDataFrame([], "token string, tier string")
    d = W.deliver(records(spark), none, Fixed(), AS_OF)
    assert d.digest and d.title.startswith("3 new alerts") and d.note is None
    again = W.deliver(records(spark), d.state, Fixed(), AS_OF)
    assert again.digest is None and again.title is None
    dry = W.deliver(records(spark), none, Fixed(), AS_OF, dry_run=True)
    assert dry.digest and dry.state.count() == 0


def test_fill(spark):
    r = records(spark).withColumn("run_acc", F.lit("R1"))
    got = W.fill(r, spark.createDataFrame([("P007", "ATGTTTAAACGT")], "isolate_key string, sequence string"), "MYKR", 1)
    rows = {x["isolate_key"]: x for x in got.collect()}
    assert len(rows) == 22 and rows["P007"]["erg11_call"] == "Y2F" and rows["P008"]["resistance_source"].startswith("sra-recaller:failed(") and rows["P001"]["erg11_call"] == "G54W"


def test_stream_delivers_each_release_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    head = "target_acc\tRun\tgeo_loc_name\ttarget_creation_date\tcollection_date\tbiosample_acc\tasm_acc\tlat_lon\n"
    body = "".join(f"PDT{i}.1\tR\tX\t2025-01-0{1 + i % 5}\t2024\t\t\t\n" for i in range(6))
    (tmp_path / "in/1.tsv").write_text(head + body)
    (tmp_path / "in/2.tsv").write_text(head + body)
    seen = []
    q = releases.deliver_stream(releases.release_stream(spark, str(tmp_path / "in")), str(tmp_path / "state"), Fixed(), "2024-12-31", lambda a, b: seen.append((b, [r["token"] for r in a.collect()])), str(tmp_path / "cp"), transform=lambda d: d.withColumn("erg11_call", F.lit("Y132F")))
    q.awaitTermination()
    assert seen == [(0, ["Y132F"]), (1, [])]


def test_windowed_stream(spark, tmp_path):
    spark.sql("select timestamp_ntz'2024-01-01 10:00:00' + make_interval(0,0,0,id) as ts, 'a' as token from range(20)").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("ts timestamp_ntz, token string").parquet(str(tmp_path / "in"))
    q = releases.windowed_tokens(s, "ts", "token").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(r["n"] for r in spark.table("w").collect()) == 20
