import itertools

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import geometry as G
from tidewatch.operators import seqcall as C
from tidewatch.operators import verdict as V
from tidewatch.plans import catalogue_files, gates
from tidewatch.sources import structures as S


def atom(n, name, res, pos, x, y, z, element="", record="ATOM", chain="A"):
    return f"{record:<6}{n:>5} {name:<4} {res:>3} {chain}{pos:>4}    {x:8.3f}{y:8.3f}{z:8.3f}{'':22}{element:>2}"


RECEPTOR = [
    atom(1, "CA", "TYR", 132, 0, 0, 0, "C"), atom(2, "OH", "TYR", 132, 3, 0, 0, "O"), atom(3, "H1", "TYR", 132, 0, 0, 1, "H"), atom(4, "CA", "LYS", 143, 0, 9, 0, "C"), atom(5, "CB", "PHE", 126, 3, 1, 0, "C"),
    atom(6, "CG1", "VAL", 125, 20, 0, 0, "C"), atom(7, "FE", "HEM", 600, 0, 0, 10, "FE", "HETATM"),
    *[atom(8 + i, n, "HEM", 600, x, y, 10, "N", "HETATM") for i, (n, x, y) in enumerate((("NA", 1, 0), ("NB", 0, 1), ("NC", -1, 0), ("ND", 0, -1)))],
]
LIGAND = [atom(1, "C1", "LIG", 1, 6, 0, 0, "C", "HETATM")]


def pose(*models):
    out = []
    for i, (score, atoms, closed) in enumerate(models, 1):
        out += [f"MODEL {i}", f"REMARK VINA RESULT:    {score}      0.000      0.000", *atoms] + (["ENDMDL"] if closed else [])
    return "\n".join(out)


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("s")
    (d / "receptor.pdb").write_text("\n".join(RECEPTOR))
    (d / "ligand.pdb").write_text("\n".join(LIGAND))
    n = lambda z, name="N1": atom(1, name, "LIG", 1, 0, 0, z, "N", "HETATM")
    c = atom(2, "C1", "LIG", 1, 0, 0, 11, "C", "HETATM")
    h = atom(3, "H1", "LIG", 1, 0, 0, 10.1, "H", "HETATM")
    for seed, shift in ((1, 0), (2, 1)):
        p = d / "screen" / f"s{seed}"
        p.mkdir(parents=True)
        (p / "close_out.pdbqt").write_text(pose((-9.9, [n(12 + shift), c, h], True), (-8.1, [c], True)))
        (p / "far_out.pdbqt").write_text(pose((-7.0, [n(15)], True), (-6.0, [n(10.5)], False)))
        (p / "nopose_out.pdbqt").write_text(pose((-5.0, [c], True)))
    return d


def test_poses_and_screen(spark, files):
    poses = gates.screen(spark, str(files / "screen"), str(files / "receptor.pdb"), axial=True)
    got = {(r["molecule"], r["seed"], r["model"]): r for r in poses.collect()}
    assert got["close", 1, 1]["dist"] == 2.0 and got["close", 1, 1]["score"] == -9.9 and got["close", 1, 2]["dist"] is None and got["close", 1, 1]["theta"] == pytest.approx(0)
    assert ("far", 1, 2) not in got  # no ENDMDL
    ranked = gates.rank_screen(poses).orderBy("rank").collect()
    assert [r["name"] for r in ranked] == ["close", "far", "nopose"] and ranked[2]["dist"] is None
    acts = spark.createDataFrame([("close",), ("gone",)], "name string")
    modes = {r["mode"]: r for r in gates.all_modes(poses, acts).collect()}
    assert set(modes) == {"distance", "score", "combined", "min", "median", "axial"} and modes["distance"]["auc"] == 1.0 and modes["distance"]["missing_actives"] == 1
    assert {r["key"] for r in gates.molecule_keys(poses, how="median").where("name = 'close'").collect()} == {2.5}
    assert sorted(r["scores"] for r in S.score_lists(spark, str(files / "screen/s1/*")).collect()) == [[-9.9, -8.1], [-7.0, -6.0], [-5.0]]


def test_structure(spark, files):
    rec = S.lines(spark, str(files / "receptor.pdb"))
    assert S.iron(rec) == (0, 0, 10) and S.plane_normal(rec) == pytest.approx((0, 0, 1), abs=1e-9) or S.plane_normal(rec) == pytest.approx((0, 0, -1))
    with pytest.raises(ValueError):
        S.iron(S.lines(spark, str(files / "ligand.pdb")))
    res = S.residues(rec)
    assert {r["pos"]: len(r["atoms"]) for r in res.collect()} == {132: 2, 143: 1, 126: 1, 125: 1}
    assert S.same_atoms(rec, rec).first()["mismatches"] == 0 and S.same_atoms(rec, rec.where("line != 2")).first()["mismatches"] > 0
    mutant = S.mutate(rec, 132, ("OH",), "PHE")
    assert S.residues(mutant).where("pos = 132").first()["resname"] == "PHE" and S.residues(mutant).where("pos = 132").select(F.size("atoms")).first()[0] == 1


def test_mutation_specs():
    assert S.parse_mutation("Y132F") == ("TYR", 132, "PHE") and S.parse_mutation(" k143a ") == ("LYS", 143, "ALA")
    for spec in ("", "Y132", "132F", "Y132W", "Y-1F", "Y132F, K143A"):
        with pytest.raises(ValueError):
            S.parse_mutation(spec)


def test_verdict_branches(spark, files):
    rec, lig = S.lines(spark, str(files / "receptor.pdb")), S.ligand_atoms(S.lines(spark, str(files / "ligand.pdb")))
    tokens = spark.createDataFrame([("y132f",), ("K143R",), ("F126L",), ("V125A",), ("TR34",), ("Y133F",), ("K132R",), (None,)], "token string")
    mapped = V.map_tokens(tokens, S.residues(rec), lig, S.iron(rec))
    got = {r["token"]: r for r in V.estimate(mapped).collect()}
    assert got["Y132F"]["branch"] == "measured" and [x["atom"] for x in got["Y132F"]["lost_contacts"]] == ["OH"] and got["Y132F"]["dist_to_ligand"] == 3.0
    assert {t: got[t]["branch"] for t in ("F126L", "K143R", "V125A", "TR34", "Y133F", "K132R", "")} == {"F126L": "contact", "K143R": "second-shell", "V125A": "deletion-none", "TR34": "unmappable", "Y133F": "unmappable", "K132R": "unmappable", "": "unmappable"}
    assert {r["token"]: r["branch"] for r in V.estimate(mapped, {}).collect()}["Y132F"] == "deletion-lost" and "125-143" in got["Y133F"]["reason"] and "TYR" in got["K132R"]["reason"]
    assert got["F126L"]["canonical"] and not got["TR34"]["canonical"]


def test_rmsd_and_cutoffs(spark):
    a = spark.createDataFrame([("x", 0.0, 0.0, 0.0), ("y", 1.0, 0.0, 0.0), ("z", 5.0, 5.0, 5.0)], "atom string, x double, y double, z double")
    r = G.rmsd(a, a.withColumn("x", F.col("x") + 3).where("atom != 'z'")).first()
    assert r["rmsd"] == 3.0 and r["n"] == 2
    s = spark.createDataFrame([("m", 1, 3.0, -9.0), ("m", 2, 2.9, -7.0)], "file string, model int, dist double, score double")
    c = G.constrained_best(s, ("file",)).first()
    assert c["n_passing"] == 1 and c["best_score"] == -7.0 and c["best_dist"] == 2.9  # strict at 3.0


REF = "ATGTATAAACGTTAA"  # M Y K R and a stop


def called(spark, seqs):
    df = spark.createDataFrame(list(enumerate(seqs)), "i int, seq string")
    return [r for r in C.formatted(C.call(df, "seq", "MYKR", {2: ("Y", {"F"})})).orderBy("i").collect()]


def test_calls(spark):
    cds, protein = C.check_reference(REF, None, {2: "Y"})
    assert protein == "MYKR"
    with pytest.raises(C.ReferenceFault):
        C.check_reference(REF, None, {2: "F"}, waive_digest=True)
    with pytest.raises(C.ReferenceFault):
        C.check_reference(REF, "00", {})
    r = called(spark, [REF, "atguuuaaacgt", "ATGTNTAAACGTTAA", "ATGTATAAACG", "ATGTATAAACGTCGT", "", None, "ATGTATTAACGT"])
    assert [(x["status"], x["call"]) for x in r] == [("ok", ""), ("ok", "Y2F"), ("ok", ""), ("refused", ""), ("refused", ""), ("refused", ""), ("refused", ""), ("ok", "K3*")]
    assert [x["source"] for x in r[:3]] == ["sra-recaller:wild-type", "sra-recaller:called", "sra-recaller:partial(panel-uncalled:2)"] and r[1]["panel_hits"] == ["Y2F"] and r[2]["uncalled"] == [2] and r[2]["n_covered"] == 3
    assert all(x["source"].startswith("sra-recaller:failed(") and "," not in x["source"] for x in r[3:7])


def test_windows(spark):
    ws = (C.Window("W1", 2, 3, 2, "Y", {2: ("Y", {"F"})}), C.Window("W2", 4, 4, 4, "R"))
    maps = [{"W1": "TATAAA", "W2": "CGT"}, {"W1": "TTTAAA"}, {"W1": "TANAAA", "W2": ""}, {"W1": "TATAA", "W2": "CGTCGT"}]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(maps)], "i int, seqs map<string,string>")
    got = C.call_windows(df, "seqs", "MYKR", ws).orderBy("i").collect()
    assert [(r["windows"]["W1"]["status"], r["windows"]["W2"]["status"]) for r in got] == [("wild-type", "wild-type"), ("called", "missing"), ("partial", "refused"), ("refused", "refused")]
    assert got[1]["call"] == "Y2F" and got[1]["panel_hits"] == ["Y2F"] and got[2]["uncalled_panel"] == [2] and got[1]["source"] == "sra-fks1-recaller:W1=called,W2=missing"
    cut = C.slice_windows(spark.createDataFrame([(REF,), ("ATG",)], "s string"), "s", 15, ws).collect()
    assert cut[0]["window_seqs"] == {"W1": "TATAAA", "W2": "CGT"} and cut[1]["window_seqs"] is None and "anchored" in cut[1]["reason"]


def test_sequences(spark, tmp_path):
    (tmp_path / "one.fa").write_text(">a x\nacg\nTT\n")
    (tmp_path / "two.fa").write_text(">a\nAC\n>b\nGT\n")
    got = {r["file"][-6:]: r for r in S.sequences(spark, str(tmp_path)).collect()}
    assert got["one.fa"]["sequence"] == "ACGTT" and got["one.fa"]["name"] == "a" and got["two.fa"]["status"] == "refused"
    assert {r["sequence"] for r in S.sequences(spark, str(tmp_path), single=False).collect()} == {"ACGTT", "ACGT"}


def test_long_sequences_and_white_space_are_called(spark):
    cases = ["\n " + REF + "\t", REF + "TAA" * 20_000, REF * 10_000, "é" * 15, "", None, " " * 9, REF[:-1]]
    want = []
    for x in cases:
        s = (x or "").strip(" \t\n").upper()
        protein = C.protein_of(s).rstrip("*")
        want.append("ok" if s and len(s) % 3 == 0 and len(protein) == 4 else "refused")
    got = C.call(spark.createDataFrame(list(enumerate(cases)), "i int, seq string"), "seq", "MYKR").orderBy("i").collect()
    assert [r["status"] for r in got] == want and want.count("ok") == 2
    assert "protein length" in got[2]["reason"]


def test_sequence_queries_read_all_documents(spark, tmp_path):
    from tidewatch.plans import catalogue

    long = "\n" + "the long text of " * 300
    docs = [(1, long, "en"), (2, "kurz", "de"), (3, "hier ist noch ein ganz langer text " * 40, "de")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in catalogue.QUERIES["codon_call"](spark, str(tmp_path)).collect()}
    n = len(long.strip())
    assert sorted(got) == [1, 2, 3] and (str(n) in got[1]["reason"] or n % 3 == 0)
    near = {r["doc_id"]: r for r in catalogue.QUERIES["window_calls"](spark, str(tmp_path)).collect()}
    assert near[1]["far"] in ("called", "wild-type") and near[2]["near"] == "refused" and near[3]["far"] in ("called", "wild-type")


def test_positions_beyond_four_digits(spark):
    """Hybrid-36 fields, as structures with more than 9,999 residues have them; written, read and mutated by position."""
    known = {"  -1": -1, "9999": 9999, "A000": 10_000, "A001": 10_001, "A00Z": 10_035, "ZZZZ": 1_223_055, "a000": 1_223_056, "zzzz": 2_436_111}
    rows = spark.createDataFrame(list(known.items()), "f string, n int")
    got = rows.select("f", "n", S.position(F.trim("f")).alias("read"), S.position_field(F.col("n")).alias("written")).collect()
    assert all(r["read"] == r["n"] and r["written"] == r["f"] for r in got)
    assert [r[0] for r in spark.createDataFrame([("A0",), ("Aa00",), ("",), ("1B",)], "f string").select(S.position(F.col("f"))).collect()] == [None] * 4
    made = spark.createDataFrame([(k, 9_998 + k) for k in range(4)], "line int, n int").withColumn("text", catalogue_files._atom_line(F.lit(1), F.lit("OH"), F.lit("TYR"), F.col("n"), F.lit(1.5), F.lit(-2.0), F.lit(3.25)))
    read = S.atoms(S.mutate(made, 10_001, (), "PHE")).select("pos", "resname", "x", "y", "z").orderBy("pos").collect()
    assert [tuple(r) for r in read] == [(p, "PHE" if p == 10_001 else "TYR", 1.5, -2.0, 3.25) for p in range(9_998, 10_002)]


def test_codons_are_translated_by_text_functions(spark):
    """Every codon with any base unknown, beside python's own translation; no function is called codon by codon."""
    codons = ["".join(c) for c in itertools.product("ACGTNé😀", repeat=3)]
    rows = [(i, "".join(codons[i:] + codons[:i]) + "ACGTA"[: i % 3]) for i in range(0, len(codons), 7)] + [(-1, ""), (-2, "AC")]
    got = spark.createDataFrame(rows, "i long, s string").select("i", "s", C.translate(F.col("s")).alias("p"), C.residues_of(F.col("s")).alias("t"))
    for r in got.collect():
        assert "".join(r["p"]) == r["t"] == C.protein_of(r["s"]) and len(r["p"]) == len(r["s"]) // 3
    plan = got.select("t")._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan
    padded = spark.createDataFrame([(" \t\n\x0b\x0c\r acgu \r\n",), (None,), (" ",)], "s string").select(C.clean(F.col("s")))
    assert [r[0] for r in padded.collect()] == ["ACGT", "", ""]
