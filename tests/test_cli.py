import json

from pyspark.sql import functions as F

from tests.cohorts import AS_OF
from tests.test_io import records
from tests.test_structures import LIGAND, RECEPTOR
from tidewatch import cli
from tidewatch.sources import feeds, sinks


def test_commands(spark, tmp_path):
    r, at = records(spark), str(tmp_path)
    assert sinks.write_parts(r, f"{at}/a") == sinks.content_digest(feeds.read_snapshot(spark, f"{at}/a").repartition(3))
    assert sinks.content_digest(r) != sinks.content_digest(r.withColumn("country", F.lit("")))
    (tmp_path / "rec.pdb").write_text("\n".join(RECEPTOR))
    (tmp_path / "lig.pdb").write_text("\n".join(LIGAND))
    run = lambda *x: cli.main([str(y) for y in x], spark)
    run("baseline", "--snapshot", f"{at}/a", "--as-of", AS_OF, "--out", f"{at}/b")
    assert feeds.read_snapshot(spark, f"{at}/b").count() == 8
    assert json.loads(run("diff", "--old", f"{at}/b", "--new", f"{at}/a")) == {"n": 14, "status": "added"}
    assert [json.loads(x)["token"] for x in run("detect", "--snapshot", f"{at}/a", "--as-of", AS_OF).splitlines()] == ["M220K", "H147Y", "DUP46"]
    assert json.loads(run("lag", "--snapshot", f"{at}/a"))["undatable"] == 22 and json.loads(run("prevalence", "--snapshot", f"{at}/a"))["n_resolved"] == 17
    assert json.loads(run("replay", "--snapshot", f"{at}/a", "--target", "H147Y"))["flagged_steps"] > 0
    both = ("--receptor", f"{at}/rec.pdb", "--ligand", f"{at}/lig.pdb", "--snapshot", f"{at}/a", "--as-of", AS_OF)
    assert len(json.loads(run("alert", *both, "--json"))) == 3
    assert run("deliver", *both, "--state", f"{at}/s.json", "--dry-run").startswith("3 new alerts") and not (tmp_path / "s.json").exists()
    assert run("deliver", *both, "--state", f"{at}/s.json").startswith("3 new alerts") and run("deliver", *both, "--state", f"{at}/s.json") == "no news"
