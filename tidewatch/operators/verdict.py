"""From a token to its place in a structure, and to what is known about its effect on fit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from .geometry import CONTACT_CUTOFF, min_distance

# fixed values: mutants whose side chain is a part of the wild type's, and the atoms that go
DELETIONS = {("TYR", "PHE"): ("OH",), ("VAL", "ALA"): ("CG1", "CG2")}
# fixed values: mutants that were measured by docking
MEASURED = {"Y132F": {"direction": "weaker-fit", "gate": "FAIL", "auc": 0.805, "ef1": 0.00, "ef5": 5.63}}


def map_tokens(tokens: DataFrame, residues: DataFrame, ligand: DataFrame, iron: tuple, cutoff: float = CONTACT_CUTOFF) -> DataFrame:
    """tokens (column token) placed in a structure.

    Adds canonical, wt, pos, mut, mappable, reason (why not), dist_to_ligand,
    dist_to_iron, contact (within cutoff, inclusive), build_class (deletion or
    needs-repacker), lost_contacts (deleted atoms within the cutoff, nearest first)
    and summary.  Refused: no point substitution, a residue that the model lacks,
    another wild type than the token's.  residues: pos, resname, atoms; distances to the
    ligand are looked up for atoms of residues that tokens name, both of any number.
    """
    span = residues.agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    sub = X.parse_substitution("token")
    t = tokens.withColumn("token", F.upper(X.ws_strip(F.coalesce("token", F.lit(""))))).withColumn("_s", sub).withColumn("canonical", F.col("_s").isNotNull()).withColumn("wt", F.col("_s.wt")).withColumn("pos", F.col("_s.pos")).withColumn("mut", F.col("_s.mut")).drop("_s")
    named = residues.join(t.select("pos").distinct(), "pos", "left_semi").select("pos", F.posexplode("atoms").alias("k", "a"))
    near = min_distance(named.select("pos", "k", "a.x", "a.y", "a.z"), ligand, ("pos", "k"))
    reach = named.join(near, ["pos", "k"]).groupBy("pos").agg(F.min("dist").alias("dist_to_ligand"), F.array_sort(F.collect_list(F.struct("dist", "a.atom"))).alias("reach"))
    t = t.join(residues, "pos", "left").join(reach, "pos", "left").crossJoin(F.broadcast(span))  # one row
    reason = F.when(~F.col("canonical"), "not a point substitution: it has no single residue").when(
        F.col("resname").isNull(), F.format_string("residue %d is not in the model (%d-%d)", "pos", "lo", "hi")
    ).when(F.col("resname") != F.col("wt"), F.format_string("position %d is %s in the model, the token says %s", "pos", "resname", "wt"))
    build = F.when(F.col("canonical"), F.when(F.concat_ws(">", "wt", "mut").isin(*[f"{a}>{b}" for a, b in DELETIONS]), "deletion").otherwise("needs-repacker"))
    out = t.withColumn("reason", reason).withColumn("mappable", F.col("reason").isNull()).withColumn("build_class", build)
    at = lambda c: F.when(F.col("mappable"), c)
    out = out.withColumn("dist_to_ligand", at(F.col("dist_to_ligand"))).withColumn("dist_to_iron", at(F.array_min(F.transform("atoms", lambda a: V.distance(a, V.vec(*iron))))))
    out = out.withColumn("contact", F.coalesce(F.col("dist_to_ligand") <= cutoff, F.lit(False)))
    gone = F.create_map(*[x for (a, b), names in DELETIONS.items() for x in (F.lit(f"{a}>{b}"), F.array(*map(F.lit, names)))])
    names = F.coalesce(F.try_element_at(gone, F.concat_ws(">", "wt", "mut")), F.array().cast("array<string>"))
    lost = F.filter("reach", lambda x: F.array_contains(names, x["atom"]) & (x["dist"] <= cutoff))
    out = out.withColumn("lost_contacts", F.coalesce(at(lost), F.expr("cast(array() as array<struct<dist:double,atom:string>>)")))
    place = F.when(F.col("contact"), F.format_string("lines the pocket, %.2f from the ligand", "dist_to_ligand")).otherwise(F.format_string("second shell, %.2f from the ligand", "dist_to_ligand"))
    out = out.withColumn("summary", F.when(F.col("mappable"), F.concat_ws("; ", F.concat("wt", F.col("pos").cast("string"), "mut"), place, F.format_string("%.2f from the iron", "dist_to_iron"), F.when(F.col("build_class") == "deletion", "the mutant can be built by deletion").otherwise("the mutant needs a repacker"))))
    return out.drop("atoms", "reach", "lo", "hi").withColumnRenamed("resname", "observed_wt")


def estimate(mapped: DataFrame, measured: dict = MEASURED) -> DataFrame:
    """map_tokens() rows with evidence_class, confidence, direction and verdict.

    In this order: unmappable, measured, deletion with or without lost contacts,
    contact, second shell.
    """
    m = F.col("mappable")
    done = F.col("token").isin(*measured) if measured else F.lit(False)
    directions = F.create_map(*[F.lit(x) for k, v in measured.items() for x in (k, v["direction"])]) if measured else F.create_map().cast("map<string,string>")
    built, lost = F.col("build_class") == "deletion", F.size("lost_contacts") > 0
    branch = F.when(~m, "unmappable").when(done, "measured").when(built & lost, "deletion-lost").when(built, "deletion-none").when(F.col("contact"), "contact").otherwise("second-shell")
    out = mapped.withColumn("branch", branch)
    b = F.col("branch")
    return out.select(
        "*", F.when(b == "measured", "empirical-dock").when(b.startswith("deletion"), "geometric-estimate").otherwise("no-call").alias("evidence_class"),
        F.when(b == "measured", "measured").when(b.startswith("deletion"), "estimate").otherwise("none").alias("confidence"),
        F.when(b == "measured", F.try_element_at(directions, F.col("token"))).when(b == "deletion-lost", "weaker-fit").when(b == "deletion-none", "minimal-direct-effect").otherwise("uncertain").alias("direction"),
        F.when(b == "unmappable", F.concat(F.lit("no structural call: "), "reason"))
        .when(b == "measured", F.concat("token", F.lit(": measured by docking")))
        .when(b == "deletion-lost", F.concat("token", F.lit(": estimate, weaker fit; lost contacts "), F.array_join(F.transform("lost_contacts", lambda x: x["atom"]), ", "), F.format_string(", the closest at %.2f", F.try_element_at("lost_contacts", F.lit(1))["dist"])))
        .when(b == "deletion-none", F.concat("token", F.lit(": estimate, only second-shell atoms go, minimal direct effect")))
        .when(b == "contact", F.concat("token", F.lit(": no confident call; on the contact surface, but the mutant can't be built")))
        .otherwise(F.concat("token", F.lit(": no confident call; second shell, and the mutant can't be built"))).alias("verdict"),
    )


def confidence_counts(estimates: DataFrame) -> DataFrame:
    return estimates.groupBy("confidence").agg(F.count("*").alias("n"))
