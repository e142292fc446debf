"""Operators on conversations, pages and vectors, and the pipeline."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewatch.llm import chat, embed_dedup, minhash, queries, warc
from tidewatch.llm.shared import Scratch


def legal(roles):
    """An optional system turn, then user and assistant turns in turn, beginning with user."""
    rest = roles[1:] if roles[:1] == ["system"] else roles
    return all(r == ("user", "assistant")[i % 2] for i, r in enumerate(rest))


def cheapest(given):
    """The least cost over all ways to merge, relabel and insert, by search over whole sequences with a cost table of its own."""
    best = [10**9]

    def rec(i, roles, cost):
        if cost >= best[0]:
            return
        if i == len(given):
            best[0] = cost
            return
        for role in ("system", "user", "assistant"):
            new = cost + (0 if role == given[i] else 2 if given[i] == "unknown" else 4)
            if roles and roles[-1] == role:
                rec(i + 1, roles, new + 1)
            if legal([*roles, role]):
                rec(i + 1, [*roles, role], new)
            for mid in ("system", "user", "assistant"):
                if legal([*roles, mid, role]):
                    rec(i + 1, [*roles, mid, role], new + 3)

    rec(0, [], 0)
    return best[0]


def test_repair_is_cheapest():
    names = ("unknown", "system", "user", "assistant")
    rnd = random.Random(1)
    for _ in range(150):
        given = [rnd.randrange(4) for _ in range(rnd.randrange(0, 6))]
        cost, path = chat.repair(given)
        assert cost == cheapest([names[g] for g in given]) == sum(p[0] for p in path)
        roles = []
        for g, (_, new, action, inserted) in zip(given, path):
            roles += [names[inserted]] if inserted else []
            assert action != "merge" or roles[-1] == names[new]
            assert (action == "keep") <= (new == g)
            roles += [] if action == "merge" else [names[new]]
        assert legal(roles)


def rendered(rows):
    own = sorted(rows, key=lambda r: ((r[1] is not None, r[1]), (r[2] is not None, r[2]), (r[3] is not None, r[3])))
    cost, path = chat.repair([chat._number(r[2]) for r in own])
    text = ""
    for i, (r, (_, state, action, inserted)) in enumerate(zip(own, path)):
        if action == "merge":
            text += "\n\n"
        else:
            text += "<|im_end|>\n" if i else ""
            text += f"<|im_start|>{chat.ROLES[inserted]}\n<|im_end|>\n" if inserted else ""
            text += f"<|im_start|>{chat.ROLES[state]}\n"
        text += r[3] or ""
    return cost, text + "<|im_end|>\n"


def test_chat(spark):
    rnd = random.Random(2)
    rows = [(None if c == 9 else c, rnd.choice([t, None]) if c == 3 else t, rnd.choice(["user", "assistant", "system", " Human", "x", None]), rnd.choice(["hi", "", None, "long " * 20])) for c in range(12) for t in range(900 if c == 5 else rnd.randrange(1, 8))]
    rows += [rows[0], rows[0]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit(1)).withColumn("n", F.lit(2)).withColumn("at", F.lit(3))
    got = {}
    for r in sorted(chat.render(df, part_turns=100, group_parts=3).collect(), key=lambda r: r["part"]):
        cost, text = got.get(r["conv_id"], (0, ""))
        got[r["conv_id"]] = (cost + r["cost"], text + r["text"])
    assert got == {c: rendered([r for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    assert chat.render(df).where("conv_id = 5").count() == 1 and chat.render(df.limit(0)).count() == 0
    assert chat.repaired_turns(df).count() == chat.repaired_turns(df, 100).count() == len(rows)
    assert {r["conv_id"]: r["c"] for r in chat.repaired_turns(df, 7, 2).groupBy("conv_id").agg(F.sum("cost").alias("c")).collect()} == {c: rendered([r for r in rows if r[0] == c])[0] for c in got}


def pages(spark):
    rnd = random.Random(4)
    rows = [(i, f"http://x/{i} é\r\n", "same" if i % 3 == 0 else "".join(rnd.choice("abcé<>") for _ in range(rnd.randrange(1, 3000)))) for i in range(60)]
    rows += [(60, None, None), (61, "", ""), (None, "u", "same"), (62, "u", "\x1f\x8b\x08 WARC/1.1\r\n\r\n"), rows[5], (63, "z", "y" * 2_000_000)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("size", F.lit(1)).withColumn("sha1", F.lit("x")).withColumn("path", F.lit("p"))


@pytest.mark.parametrize("split", [700, 1 << 20])
def test_warc(spark, split):
    rows, df = pages(spark)
    s = Scratch(spark, "t")
    files = s.table(warc.write_archives(df, s.new_path(), file_bytes=20_000))
    assert files.count() > 1 and files.agg(F.sum("records")).first()[0] == len(rows)
    got = warc.read_archives(spark, files, split).collect()
    best = {}
    for i, _, h in rows:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    want = sorted(((i, "response" if i == best[h or ""] else "revisit", len((h or "").encode()), warc.digest((h or "").encode()), None if i == best[h or ""] else best[h or ""]) for i, _, h in rows), key=str)
    assert sorted(((r["page_id"], r["record_type"], r["payload_bytes"], r["payload_digest"], r["refers_to"]) for r in got), key=str) == want
    assert all(r["digest_ok"] for r in got) and {bytes(r["payload"]).decode() for r in got if r["payload"] is not None} == {h or "" for _, _, h in rows}


def test_warc_survives_damage_and_empty_tables(spark, tmp_path):
    _, df = pages(spark)
    files = warc.write_archives(df.where("page_id < 20"), str(tmp_path / "a")).collect()
    largest = max(files, key=lambda r: r["bytes"])
    path = largest["path"].removeprefix("file://")
    raw = bytearray(open(path, "rb").read())
    raw[len(raw) // 2 : len(raw) // 2 + 40] = b"\0" * 40
    open(path, "wb").write(raw)
    n = warc.read_archives(spark, spark.createDataFrame([(path, len(raw))], "path string, bytes long"), 500).count()
    assert max(0, largest["records"] - 3) <= n < largest["records"]
    assert warc.round_trip(df.limit(0)).count() == 0
    assert warc.round_trip(df, revisit_bytes=5).where("record_type = 'revisit'").count() == 0  # of pages with equal long payloads all have the largest id


def vectors():
    rnd = np.random.default_rng(7)
    out = []
    hot = rnd.standard_normal(16)
    for i in range(150):  # a large tight group, with some members at its rim
        out.append((i, (hot + rnd.standard_normal(16) * (0.45 if i % 10 == 0 else 0.12)).tolist(), 1))
    for i in range(150, 300):
        out.append((i, rnd.standard_normal(16).tolist(), int(rnd.integers(0, 3))))
    for i in range(300, 330):
        out.append((i, (np.array(out[i - 120][1]) * 3 + rnd.standard_normal(16) * 0.3).tolist(), out[i - 120][2]))
    out += [(400, out[0][1], 1), (401, out[0][1], 1), (402, out[0][1], 2), (402, out[0][1], 2), (None, out[0][1], 1), (403, None, 1), (404, [], 1), (405, [0.0] * 16, 1), (406, [float("nan")] * 16, 1), (407, [None] + [1.0] * 15, 1), (408, out[0][1], None), (409, out[0][1][:8], 1), (410, [float("inf")] + [1.0] * 15, 1), (411, [1e-200] * 16, 0), (412, [1e-200] * 16, 0)]
    return out


@pytest.mark.parametrize("tile,block", [(16, 32), (1024, 512)])
def test_embeddings(spark, tile, block):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit(1)).withColumn("size", F.lit(1)).withColumn("component", F.lit(1)).withColumn("v", F.lit(1))
    got = sorted(map(tuple, embed_dedup.near_duplicates(df, window=16, block=block, tile=tile, recall=0.9999).collect()), key=str)

    def usable(r):
        return r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])

    n = len(rows)
    unit = [np.array(r[1]) / np.abs(r[1]).max() if usable(r) else None for r in rows]
    unit = [u / np.linalg.norm(u) if u is not None else None for u in unit]
    root, links = list(range(n)), [0] * n

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(n):
            if i != j and unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93:
                links[i] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    low = {}
    for i in range(n):
        if rows[i][0] is not None:
            low[find(i)] = min(low.get(find(i), 10**9), rows[i][0])
    want = sorted(((r[0], links[i], low.get(find(i)), r[0] == low.get(find(i)) if r[0] is not None else low.get(find(i)) is None) for i, r in enumerate(rows)), key=str)
    assert got == want
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("block,window", [(128, 8), (512, 64)])
def test_pairs_of_a_dense_topic_are_found(spark, block, window):
    rnd = np.random.default_rng(7)
    n, pairs = 2000, 100
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    topic, own = unit(rnd.standard_normal(64)), unit(rnd.standard_normal((n, 64)))
    v = unit(np.sqrt(0.85) * topic + np.sqrt(0.15) * own)
    side = rnd.standard_normal((pairs, 64))
    side = unit(side - (side * v[:pairs]).sum(axis=1, keepdims=True) * v[:pairs])
    v[n - pairs :] = 0.94 * v[:pairs] + np.sqrt(1 - 0.94**2) * side
    link = np.triu(v @ v.T >= 0.93, 1)
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)]
    got = {r["vec_id"]: r["n_links"] for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), window=window, block=block).collect()}
    want = (link | link.T).sum(axis=1)
    assert sum(got.values()) >= 0.99 * want.sum() and all(got[i] <= want[i] for i in range(n))


def test_recall_of_sorted_passes_at_default_settings(spark):
    """Pairs just above the threshold, spread and crowded, and a group far larger than a window: nine in ten links at least are found."""
    rnd = np.random.default_rng(11)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    n, pairs = 9000, 600
    v = unit(rnd.standard_normal((n, 64)))
    v[:3000] = unit(0.8 * unit(rnd.standard_normal(64)) + 0.6 * v[:3000])
    v[3000:3400] = unit(unit(rnd.standard_normal(64)) + 0.15 * v[3000:3400])
    at = rnd.permutation(n)[: 2 * pairs]
    side = rnd.standard_normal((pairs, 64))
    base = v[at[:pairs]]
    side = unit(side - (side * base).sum(axis=1, keepdims=True) * base)
    cos = rnd.uniform(0.931, 0.95, (pairs, 1))
    v[at[pairs:]] = cos * base + np.sqrt(1 - cos**2) * side
    v = v.astype(np.float32).astype(float)
    link = np.triu(unit(v) @ unit(v).T >= 0.93, 1)
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)]
    got = {r["vec_id"]: r["n_links"] for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    want = (link | link.T).sum(axis=1)
    assert all(got[i] <= want[i] for i in range(n)) and sum(got.values()) >= 0.9 * want.sum()
    planted = [i for i in at if want[i]]
    assert np.mean([got[i] == want[i] for i in planted]) >= 0.98


def test_ties_at_the_threshold_in_a_label_of_many_rows(spark):
    """Pairs whose cosine is the threshold itself are links, just below it are none; in a label larger than a block."""
    rnd = np.random.default_rng(5)
    n = 700
    v = rnd.standard_normal((n, 16)) * np.r_[np.zeros(4), np.ones(12)]
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)]
    e = np.eye(16)
    pairs = [(e[0] * 5, e[0] * 4 + e[1] * 3), (e[2] * 5, e[2] * 4 + e[3] * 3.0001)]  # cosines 0.8, and a little less
    rows += [(1000 + 2 * k + j, x.tolist(), 1) for k, p in enumerate(pairs) for j, x in enumerate(p)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed_dedup.near_duplicates(d, cosine=0.8, block=128).collect()}
    assert got[1000] == (1, 1000) and got[1001] == (1, 1000) and got[1002] == (0, 1002) and got[1003] == (0, 1003)


def test_passes_follow_the_number_of_rows():
    a, b, c = (embed_dedup.passes_needed(n, 0.93, 64, 0.995) for n in (1_000, 1_000_000, 1_000_000_000))
    assert a < b < c


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "bpe"]
    out = corpus_pipeline.run(spark, sf).collect()
    ids = [r["doc_id"] for r in out]
    assert 0 < len(ids) == len(set(ids)) < docs.count() and all(len(r["token_ids"]) == r["n_tokens"] for r in out)
    assert all(r["n_chars"] == len(r["text"]) for r in out)
    # no two of what is left are near duplicates of each other (texts were cut afterwards, so look at their originals)
    left = docs.join(spark.createDataFrame([(i,) for i in ids], "doc_id long"), "doc_id")
    assert minhash.near_duplicates(left).where("not kept").count() == 0


def test_stages_on_an_empty_and_an_odd_table(spark):
    sf = "/root/testdata/sf0.001"
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "x y", "en", "s", 3), (2, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, sf).count() == 3 and stage(spark, odd.limit(0), sf).count() == 0


def test_every_query_is_registered():
    assert sorted(n.split("_")[0] for n in queries.QUERIES if n.startswith("op")) == sorted(f"op{i}" for i in range(1, 14)) and set(queries.SQL) <= set(queries.QUERIES)
