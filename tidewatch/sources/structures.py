"""Fixed-width structure and pose files as rows, and sequences.

Lines are cut with substring expressions, so all parsing runs in the JVM.  Files are read in parts: as records, one
for each model, that a task finds in any part of a pose file (models), or as numbered lines (lines).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text) of text files, which many tasks may read; lines are numbered from 0 in their file.

    A line's number is its place in the part of the file that its task reads, and what earlier parts hold: one row for each part.
    """
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("seq"), F.regexp_replace("value", "\r$", "").alias("text"))
    per = raw.groupBy("file", "split").agg(F.min("seq").alias("first"), F.count("*").alias("n"))
    above = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("file", "split", "first", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("before"))
    return raw.join(per, ["file", "split"]).select("file", (F.col("seq") - F.col("first") + F.col("before")).cast("int").alias("line"), "text")


def _cut(start: int, length: int) -> Column:
    return F.trim(F.substring("text", start, length))


def position(field: Column) -> Column:
    """Number of a four-column residue field in hybrid-36: decimal up to 9999, then A000 to ZZZZ, then a000 to zzzz; else null."""
    first = 10 * 36**3
    past = F.when(field.rlike("^[A-Z][0-9A-Z]{3}$"), 10_000 - first).when(field.rlike("^[a-z][0-9a-z]{3}$"), 10_000 + 16 * 36**3)
    return F.when(past.isNotNull(), F.conv(field, 36, 10).try_cast("int") + past).otherwise(F.nullif(field, F.lit("")).try_cast("int"))


def position_field(pos: Column) -> Column:
    """The four columns that position() reads; a number that no field holds, below -999 or beyond zzzz, is an error."""
    n = pos.cast("long")
    upper, lower = (F.conv((n - 10_000 + past).cast("string"), 10, 36) for past in (10 * 36**3, -16 * 36**3))
    return F.when(n.between(-999, 9_999), F.lpad(n.cast("string"), 4, " ")).when(n.between(10_000, 9_999 + 26 * 36**3), upper).when(n.between(10_000, 9_999 + 52 * 36**3), F.lower(lower)).otherwise(F.raise_error(F.format_string("residue %d has no field", n)))


def atoms(df: DataFrame, heavy: bool = True) -> DataFrame:
    """Atom rows of lines: record, atom name, residue name and position, chain, element, x, y, z.

    The element is in columns 77-78, else the first letter of the name; heavy
    leaves hydrogens out.
    """
    record = F.trim(F.substring("text", 1, 6))
    name, element = _cut(13, 4), _cut(77, 2)
    number = lambda a, n: F.nullif(_cut(a, n), F.lit("")).try_cast("double")
    out = df.where(record.isin("ATOM", "HETATM")).select(
        *[c for c in df.columns if c != "text"], record.alias("record"), name.alias("atom"), _cut(18, 3).alias("resname"), _cut(22, 1).alias("chain"), position(_cut(23, 4)).alias("pos"),
        F.upper(F.when(element != "", element).otherwise(F.substring(name, 1, 1))).alias("element"), number(31, 8).alias("x"), number(39, 8).alias("y"), number(47, 8).alias("z"), "text",
    )
    return out.where("element != 'H'") if heavy else out


def poses(df: DataFrame) -> DataFrame:
    """Heavy atoms of pose files with their model number; atoms of a model that no ENDMDL closes are left out.

    A MODEL line begins a model anew.  model counts MODEL lines of the file from 1.
    """
    w = Window.partitionBy("file").orderBy("line")
    kind = F.trim(F.substring("text", 1, 6))
    marked = df.withColumn("model", F.sum((kind == "MODEL").cast("int")).over(w))
    # an atom belongs to a pose if the next MODEL or ENDMDL after it is an ENDMDL
    ahead = F.first(F.when(kind.isin("MODEL", "ENDMDL"), kind), True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return atoms(marked.withColumn("closed", F.coalesce(ahead == "ENDMDL", F.lit(False))).where("closed and model > 0").drop("closed")).drop("text")


def scores(df: DataFrame) -> DataFrame:
    """(file, model, score): fourth word of each score remark, in file order."""
    rows = df.where(F.col("text").rlike(r"^REMARK\s+VINA\s+RESULT"))
    w = Window.partitionBy("file").orderBy("line")
    return rows.select("file", F.row_number().over(w).alias("model"), F.get(F.split(F.trim("text"), r"\s+"), F.lit(3)).try_cast("double").alias("score"))


def score_lists(spark: SparkSession, path: str) -> DataFrame:
    """(file, scores): the same as an array for each file, without splitting lines."""
    got = F.regexp_extract_all("value", F.lit(r"(?m)^REMARK\s+VINA\s+RESULT:?\s+(\S+)"), 1)
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.transform(got, lambda x: x.try_cast("double")).alias("scores"))


def models(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, seq, number, closed, text, scores): one row for each model of pose files, which many tasks may read.

    Records end where a line begins with MODEL, so a task finds the models that begin in its part of a
    file.  split is where that part begins, and (split, seq) is their order in the file.  number is the one
    written after MODEL.  text has the model's lines up to its last ENDMDL; a model that no ENDMDL
    closes has none and isn't closed.  scores are the fourth words of all score remarks of the record; one more record,
    without a number, has those before a file's first MODEL.
    """
    raw = spark.read.option("lineSep", "\nMODEL").option("recursiveFileLookup", True).option("pathGlobFilter", "*").text(path)
    v = F.col("value")
    number = F.nullif(F.regexp_extract(v, r"^(?:MODEL)?[ \t]+(\d+)", 1), F.lit("")).try_cast("int")
    upto = F.length(v) - F.length(F.substring_index(v, "\nENDMDL", -1)) - len("\nENDMDL")
    closed = number.isNotNull() & v.contains("\nENDMDL")
    got = F.regexp_extract_all(v, F.lit(r"(?m)^REMARK\s+VINA\s+RESULT:?\s+(\S+)"), 1)
    return raw.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("seq"), number.alias("number"),
        closed.alias("closed"), F.when(closed, F.substring(v, F.lit(1), upto)).alias("text"), F.transform(got, lambda x: x.try_cast("double")).alias("scores"),
    )


def model_atoms(text: Column) -> Column:
    """Heavy atoms of a model's text as an array of (atom, x, y, z)."""
    cut = lambda line, start, n: F.trim(F.substring(line, F.lit(start), F.lit(n)))
    number = lambda line, start: F.nullif(cut(line, start, 8), F.lit("")).try_cast("double")
    element = lambda line: F.upper(F.when(cut(line, 77, 2) != "", cut(line, 77, 2)).otherwise(F.substring(cut(line, 13, 4), 1, 1)))
    mine = F.filter(F.split(text, "\r?\n"), lambda line: cut(line, 1, 6).isin("ATOM", "HETATM") & (element(line) != "H"))
    return F.transform(mine, lambda line: F.struct(cut(line, 13, 4).alias("atom"), number(line, 31).alias("x"), number(line, 39).alias("y"), number(line, 47).alias("z")))


def placed(found: DataFrame) -> DataFrame:
    """Rows (file, split, seq, closed, scores, ...) with model, the place among the closed models of the file from 1, and scored, how many scores stand in the file before.

    Places are counted within splits, which are of bounded size, and added up over the splits of a file, of which there are few.
    """
    here = Window.partitionBy("file", "split").orderBy("seq")
    n = F.coalesce(F.size("scores"), F.lit(0)).cast("long")
    counted = found.withColumn("model", F.sum(F.col("closed").cast("long")).over(here)).withColumn("scored", F.sum(n).over(here) - n)
    above = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    per = found.groupBy("file", "split").agg(F.sum(F.col("closed").cast("long")).alias("m"), F.sum(n).alias("s"))
    per = per.select("file", "split", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"_{c}") for c in "ms"])
    return counted.join(per, ["file", "split"]).withColumn("model", F.when(F.col("closed"), F.col("model") + F.col("_m")).cast("int")).withColumn("scored", F.col("scored") + F.col("_s")).drop("_m", "_s")


def placed_scores(rows: DataFrame) -> DataFrame:
    """(file, model, score): the scores of placed() rows by their place in the file."""
    return rows.select("file", "scored", F.posexplode("scores").alias("at", "score")).select("file", (F.col("scored") + F.col("at") + 1).cast("int").alias("model"), "score")


def iron(df: DataFrame):
    """(x, y, z) of the first HETATM whose element is FE; a structure without one is an error."""
    row = atoms(df).where("record = 'HETATM' and element = 'FE'").agg(F.min_by(F.struct("x", "y", "z"), "line").alias("p")).first()["p"]
    if row is None:
        raise ValueError("the structure has no iron")
    return tuple(row)


def residues(df: DataFrame) -> DataFrame:
    """(pos, resname, atoms) of the protein: heavy ATOM rows by position; the name is the first one seen."""
    a = atoms(df).where("record = 'ATOM'")
    return a.groupBy("pos").agg(F.min_by("resname", "line").alias("resname"), F.transform(F.array_sort(F.collect_list(F.struct("line", "atom", "x", "y", "z"))), lambda s: s.dropFields("line")).alias("atoms"))


def ligand_atoms(df: DataFrame) -> DataFrame:
    return atoms(df).select("x", "y", "z")


def plane_normal(df: DataFrame):
    """Unit normal of the four ring nitrogens NA, NB, NC, ND of residue HEM: along (NC - NA) x (ND - NB)."""
    got = {r["atom"]: r["p"] for r in atoms(df).where("resname = 'HEM' and atom in ('NA', 'NB', 'NC', 'ND')").groupBy("atom").agg(F.min_by(F.struct("x", "y", "z"), "line").alias("p")).collect()}
    if len(got) < 4:
        raise ValueError("a ring nitrogen is missing")
    u = [c - a for a, c in zip(got["NA"], got["NC"])]
    v = [d - b for b, d in zip(got["NB"], got["ND"])]
    n = (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])
    size = sum(x * x for x in n) ** 0.5
    return tuple(x / size for x in n)


def file_parts(file: Column) -> tuple[Column, Column]:
    """(molecule, seed) of a pose file's path: its base name, and the number of a folder s<digits> around it, if any."""
    return F.regexp_extract(file, r"([^/]+?)(?:_out)?\.pdbqt$", 1), F.nullif(F.regexp_extract(file, r"/s(\d+)/[^/]+$", 1), F.lit("")).cast("int")


def select_chain(df: DataFrame, chain: str = "A", kept: tuple[str, ...] = ("HEM",)) -> DataFrame:
    """Lines of one chain: its ATOM rows, and its HETATM rows of the residues kept."""
    kind, of = F.trim(F.substring("text", 1, 6)), F.substring("text", 22, 1)
    return df.where((of == chain) & ((kind == "ATOM") | ((kind == "HETATM") & _cut(18, 3).isin(*kept))))


def same_atoms(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: counts of both, and mismatches of atom keys by place."""
    key = F.struct("record", "atom", "resname", "chain", "pos", F.round("x", 3), F.round("y", 3), F.round("z", 3))
    at = lambda df, n: df.select(F.row_number().over(Window.partitionBy("file").orderBy("line")).alias("at"), key.alias(n))
    return at(atoms(a, False), "a").join(at(atoms(b, False), "b"), "at", "full_outer").agg(F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("mismatches"))


# fixed values: residues that a mutant can be asked for by one letter
MUTABLE = {"A": "ALA", "F": "PHE", "H": "HIS", "K": "LYS", "L": "LEU", "V": "VAL", "Y": "TYR"}


def parse_mutation(spec: str) -> tuple[str, int, str]:
    """(wild type, position, mutant) in three-letter codes of a spec such as V5A; anything else is an error."""
    m = re.fullmatch(r"([A-Z])(\d+)([A-Z])", spec.strip().upper())
    if not m or m[1] not in MUTABLE or m[3] not in MUTABLE:
        raise ValueError(f"{spec!r} names no mutation that can be built here")
    return MUTABLE[m[1]], int(m[2]), MUTABLE[m[3]]


def mutate(df: DataFrame, pos: int, deleted: tuple[str, ...], resname: str, chain: str = "A") -> DataFrame:
    """Lines with some atoms of one residue deleted and the residue renamed (a structure's deletion mutant)."""
    here = (F.trim(F.substring("text", 1, 6)) == "ATOM") & (F.substring("text", 22, 1) == chain) & (position(_cut(23, 4)) == pos)
    renamed = F.concat(F.substring("text", 1, 17), F.lpad(F.lit(resname), 3, " "), F.expr("substring(text, 21)"))
    return df.where(~F.coalesce(here & _cut(13, 4).isin(*deleted), F.lit(False))).withColumn("text", F.when(here, renamed).otherwise(F.col("text")))


def model_lines(df: DataFrame, model: int) -> DataFrame:
    """The lines of one model of a pose file."""
    w = Window.partitionBy("file").orderBy("line")
    kind = F.trim(F.substring("text", 1, 6))
    return df.withColumn("model", F.sum((kind == "MODEL").cast("int")).over(w)).where((F.col("model") == model) & ~kind.isin("MODEL")).drop("model")


def sequences(spark: SparkSession, path: str, single: bool = True) -> DataFrame:
    """(file, name, sequence, status): records of FASTA files with their lines joined, upper case.

    single: a file with none or several records has status refused and no sequence (consensus files); otherwise
    all records of a file are joined into one (reference files).
    """
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    records = F.filter(F.split("value", r"(?m)^>"), lambda x: F.trim(x) != "")
    body = lambda r: F.upper(F.regexp_replace(F.regexp_replace(r, r"^[^\n]*\n?", ""), r"\s+", ""))
    name = F.regexp_extract(F.get(records, F.lit(0)), r"^(\S*)", 1)
    joined = F.array_join(F.transform(records, body), "")
    ok = (F.size(records) == 1) if single else (F.size(records) > 0)
    return whole.select("file", name.alias("name"), F.when(ok, joined).alias("sequence"), F.when(ok, "ok").otherwise("refused").alias("status"))
