"""Releases: byte equality with the canonical text, the tree digest, and commits that are whole or absent."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.sources import release as L
from tidewatch.sources import sinks

COLUMNS = ("key", "a", "b")


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(3)
    odd = ["", None, "x", 'q"uote', "tab\there", "line\nend", "cr\rhere", "é中", " blank ", '"', "key"]
    made = [(f"k{rnd.randrange(500):04d}", rnd.choice(odd), rnd.choice(odd)) for _ in range(1500)] + [("", "", ""), (None, "1", "2")]
    return spark.createDataFrame(made, "key string, a string, b string")


def plain(text: bytes, leaf: int, fan: int) -> str:
    level = [hashlib.sha256(text[i : i + leaf]).hexdigest() for i in range(0, len(text), leaf)]
    if not level:
        level = [hashlib.sha256(b"").hexdigest()]
    else:
        while True:
            level = [hashlib.sha256("".join(level[i : i + fan]).encode()).hexdigest() for i in range(0, len(level), fan)]
            if len(level) == 1:
                break
    return hashlib.sha256(f"{len(text)}:{leaf}:{level[0]}".encode()).hexdigest()


def text_of(spark, path):
    return b"".join(open(p.replace("file:", ""), "rb").read() for p, _ in L.parts(spark, path))


def test_parts_are_the_canonical_text(spark, rows, tmp_path):
    want = "".join(sinks.canonical_lines(rows, COLUMNS, "key")).encode()
    digests = set()
    for n in (1, 7, 60):
        m = L.write_release(rows.repartition(5), f"{tmp_path}/r{n}", COLUMNS, "key", n, leaf_bytes=1000)
        assert text_of(spark, f"{tmp_path}/r{n}") == want and m["bytes"] == len(want) and (len(m["parts"]) > 1) == (n > 1)
        digests.add(m["digest"])
        assert L.verify_release(spark, f"{tmp_path}/r{n}") == "ok"
    assert digests == {plain(want, 1000, L.FAN)}
    back = L.read_release(spark, f"{tmp_path}/r7")
    tuples = lambda df: sorted(tuple(x or "" for x in r) for r in df.collect())
    assert back.columns == list(COLUMNS) and tuples(back) == tuples(rows)


@pytest.mark.parametrize("leaf, fan", [(1, 2), (64, 3), (1 << 20, 1024)])
def test_tree_of_any_files(spark, tmp_path, leaf, fan):
    rnd = random.Random(5)
    data = [rnd.randbytes(rnd.choice([0, 1, 63, 64, 65, 200])) for _ in range(12)]
    for i, d in enumerate(data):
        (tmp_path / f"part-{i}").write_bytes(d)
    (tmp_path / "_ignored").write_bytes(b"x")
    files = L.parts(spark, str(tmp_path))
    assert [n for _, n in files] == [len(d) for d in data]  # part-10 after part-9
    assert L.tree_digest(spark, files, leaf, fan) == plain(b"".join(data), leaf, fan)
    assert L.tree_digest(spark, [], leaf, fan) == plain(b"", leaf, fan)
    assert L.file_digests(spark, str(tmp_path), leaf)[files[5][0]] == plain(data[5], leaf, L.FAN)


def test_a_failed_write_leaves_the_old_release(spark, rows, tmp_path):
    path = f"{tmp_path}/r"
    first = L.write_release(rows, path, COLUMNS, "key")
    with pytest.raises(Exception, match="lost"):
        L.write_release(rows.withColumn("b", F.when(F.col("key") > "k0400", F.raise_error(F.lit("lost"))).otherwise(F.col("b"))), path, COLUMNS, "key")
    assert os.listdir(tmp_path) == ["r"] and L.verify_release(spark, path) == "ok" and L.read_manifest(spark, path) == first
    second = L.write_release(rows.limit(10), path, COLUMNS, "key")
    assert os.listdir(tmp_path) == ["r"] and second["digest"] != first["digest"] and L.verify_release(spark, path) == "ok"
    part = L.parts(spark, path)[0][0].replace("file:", "")
    raw = bytearray(open(part, "rb").read())
    raw[-2] ^= 1
    with open(part, "wb") as f:
        f.write(raw)
    assert L.verify_release(spark, path) == "changed" and L.verify_release(spark, f"{tmp_path}/none") == "missing"


def test_split_in_one_pass(spark, tmp_path):
    """Each row to one place, null to the excluded; a place without rows is an empty table, and old rows go."""
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, kept string")
    for cond, want in ((F.col("k") == 1, ["a"]), (F.col("k") > 0, ["a", "b"]), (F.lit(True), ["a", "b", "c"])):
        sinks.write_split(df, cond, f"{tmp_path}/x/kept", f"{tmp_path}/x/out")
        got = [sorted(r["kept"] for r in spark.read.schema(df.schema).parquet(f"{tmp_path}/x/{n}").collect()) for n in ("kept", "out")]
        assert got == [want, [x for x in "abc" if x not in want]]
    assert sorted(os.listdir(tmp_path / "x")) == ["kept", "out"]


def test_one_node_over_many_leaves(spark, rows, tmp_path):
    """More leaves than a node of the tree takes: one node over all of them, in their order, which the manifest remembers."""
    m = L.write_release(rows, f"{tmp_path}/flat", COLUMNS, "key", 3, 8, None)
    text = text_of(spark, f"{tmp_path}/flat")
    leaves = [hashlib.sha256(text[i : i + 8]).hexdigest() for i in range(0, len(text), 8)]
    assert len(leaves) > L.FAN and m["fan"] is None
    assert m["digest"] == hashlib.sha256(f"{len(text)}:8:{hashlib.sha256(''.join(leaves).encode()).hexdigest()}".encode()).hexdigest()
    assert L.verify_release(spark, f"{tmp_path}/flat") == "ok"
