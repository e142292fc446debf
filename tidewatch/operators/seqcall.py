"""Substitution calls from sequences: whole coding sequences and windows of them.

What can't be placed is refused in a status column; an uncertain codon is
uncalled, never wild type.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

# fixed values: the standard genetic code, bases in the order TCAG
BASES = "TCAG"
CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = {a + b + c: CODE[16 * i + 4 * j + k] for i, a in enumerate(BASES) for j, b in enumerate(BASES) for k, c in enumerate(BASES)}
# fixed values: substitutions known for resistance, position: (wild type, mutants)
AZOLE_PANEL = {125: ("V", {"A"}), 126: ("F", {"L"}), 132: ("Y", {"F"}), 143: ("K", {"R"})}


@dataclass(frozen=True)
class Window:
    """Residues start to end (1-based, inclusive), an anchor whose wild type the reference must show, and a panel."""

    name: str
    start: int
    end: int
    anchor: int
    anchor_wt: str
    panel: dict = field(default_factory=dict, hash=False)

    @property
    def residues(self) -> int:
        return self.end - self.start + 1

    @property
    def bases(self) -> int:
        return 3 * self.residues

    def cut(self, cds):
        """The window's bases of a sequence, as text or as a column."""
        return F.substring(cds, 3 * (self.start - 1) + 1, self.bases) if isinstance(cds, Column) else cds[3 * (self.start - 1) : 3 * self.end]

    def region(self, contig: str) -> str:
        """Its place for tools that take 1-based base ranges."""
        return f"{contig}:{3 * (self.start - 1) + 1}-{3 * self.end}"


# fixed values: two windows of the echinocandin target
WINDOWS = (Window("HS1", 635, 643, 639, "S", {639: ("S", {"F", "P", "Y"})}), Window("HS2", 1350, 1358, 1354, "R"))
ECHINOCANDIN_PANEL = {pos: entry for w in WINDOWS for pos, entry in w.panel.items()}


#: Codons as one character each, and their residues: bases, N among them, are hexadecimal digits, and a codon is 0 and three of these.
_DIGITS = dict(zip(f"{BASES}N", "12345"))
_CODED = {chr(int("".join(_DIGITS[x] for x in (a, b, c)), 16)): CODONS.get(a + b + c, "X") for a in _DIGITS for b in _DIGITS for c in _DIGITS}


def residues_of(cds: Column) -> Column:
    """A sequence's residues as text: X for any codon with an uncertain base; a partial codon at the end is left out."""
    # codons become single characters by way of UTF-16, so that one translate() in generated code maps them all; a function
    # for each codon is interpreted, and takes several times as long
    bases = F.translate(F.regexp_replace(cds, "(?s)[^ACGT]", "N"), "".join(_DIGITS), "".join(_DIGITS.values()))
    packed = F.regexp_replace(F.substring(bases, F.lit(1), F.length(bases) - F.length(bases) % 3), "(...)", "0$1")
    return F.translate(F.decode(F.unhex(packed), "UTF-16BE"), "".join(_CODED), "".join(_CODED.values()))


def translate(cds: Column) -> Column:
    """residues_of() as an array."""
    return _each(residues_of(cds))


def _each(residues: Column) -> Column:
    return F.when(residues == "", F.array().cast("array<string>")).otherwise(F.split(residues, ""))


def clean(seq: Column) -> Column:
    return F.replace(F.upper(F.trim(F.coalesce(seq, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))), F.lit("U"), F.lit("T"))


def protein_of(cds: str) -> str:
    return "".join(CODONS.get(cds[i : i + 3], "X") for i in range(0, len(cds) - 2, 3))


class ReferenceFault(ValueError):
    """The pinned reference is not what it must be."""


def check_reference(cds: str, sha256: str | None, anchors: dict[int, str], waive_digest: bool = False) -> tuple[str, str]:
    """(cds, protein without its trailing stop) of a reference; its digest may be waived, its numbering never."""
    cds = "".join(cds.split()).upper()
    if not cds or set(cds) - set("ACGT"):
        raise ReferenceFault("the reference has letters other than ACGT, or none")
    if sha256 and not waive_digest and hashlib.sha256(cds.encode()).hexdigest() != sha256:
        raise ReferenceFault("the reference's digest is not the pinned one")
    if len(cds) % 3:
        raise ReferenceFault("the reference's length is no multiple of 3")
    protein = protein_of(cds).rstrip("*")
    for pos, wt in anchors.items():
        if protein[pos - 1 : pos] != wt:
            raise ReferenceFault(f"residue {pos} of the reference is not {wt}")
    return cds, protein


def _differ(residues: Column, protein: str, first: int) -> Column:
    """Tokens of residues that aren't the reference's, from position ``first`` on."""
    ref = F.array(*[F.struct(F.lit(x).alias("r"), F.lit(f"{x}{i}").alias("at")) for i, x in enumerate(protein, first)])
    return F.array_compact(F.zip_with(ref, residues, lambda r, o: F.when((o != "X") & (o != r["r"]), F.concat(r["at"], o))))


def _uncalled(residues: Column, protein: str, first: int) -> Column:
    return F.array_compact(F.zip_with(F.array(*[F.lit(i) for i in range(first, first + len(protein))]), residues, lambda i, o: F.when(o == "X", i)))


def _hits(tokens: Column, panel: dict) -> Column:
    hits = [f"{wt}{pos}{x}" for pos, (wt, muts) in panel.items() for x in muts]
    return F.filter(tokens, lambda t: t.isin(*hits) if hits else F.lit(False))


def _compared(residues: Column, protein: str, first: int, panel: dict) -> Column:
    """struct<tokens, panel_hits, uncalled> of residues against the reference's, from position ``first`` on."""
    tokens = _differ(residues, protein, first)
    return F.struct(tokens.alias("tokens"), _hits(tokens, panel).alias("panel_hits"), _uncalled(residues, protein, first).alias("uncalled"))


def call(df: DataFrame, seq: str, reference: str, panel: dict | None = None) -> DataFrame:
    """df with status (ok or refused), reason, tokens, panel_hits, uncalled, uncalled_panel, n_covered, n_residues.

    reference: a checked protein.  Refused: nothing there, a length that is no
    multiple of 3, or another protein length (trailing stops don't count).
    """
    panel = AZOLE_PANEL if panel is None else panel
    s, whole, n = F.col("_s"), F.col("_whole"), len(reference)
    # trailing stops go.  Only a sequence that ends with one, or that has the right length, has to be translated
    stops = F.substring(s, -3, 3).isin(*[k for k, v in CODONS.items() if v == "*"])
    wanted = (F.length(s) % 3 == 0) & (stops | (F.length(s) == 3 * n))
    residues = F.when(stops, F.length(F.rtrim(whole, F.lit("*")))).otherwise(F.expr("length(_s) div 3").cast("int"))
    reason = F.when(s == "", "empty consensus").when(F.length(s) % 3 != 0, F.format_string("length %d is no multiple of 3: a frame shift is refused, not guessed", F.length(s))).when(residues != n, F.format_string("protein length %d instead of %d: insertions and deletions are refused", residues, F.lit(n)))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    ok = F.col("reason").isNull()
    out = df.withColumn("_s", clean(F.col(seq))).withColumn("_whole", F.when(wanted, residues_of(s))).withColumn("reason", reason).withColumn("_whole", F.substring(whole, 1, n))
    out = out.withColumn("_tokens", F.when(ok, _differ(_each(whole), reference, 1)).otherwise(none("string")))
    out = out.withColumn("_uncalled", F.when(ok & F.contains(whole, F.lit("X")), _uncalled(_each(whole), reference, 1)).otherwise(none("int")))
    out = out.select(
        *df.columns, F.when(ok, "ok").otherwise("refused").alias("status"), "reason", F.col("_tokens").alias("tokens"), _hits(F.col("_tokens"), panel).alias("panel_hits"), F.col("_uncalled").alias("uncalled"),
        F.when(ok, n - F.size("_uncalled")).otherwise(0).alias("n_covered"), F.lit(n).alias("n_residues"),
    )
    return out.withColumn("uncalled_panel", F.filter("uncalled", lambda p: p.isin(*panel) if panel else F.lit(False)))


def formatted(df: DataFrame) -> DataFrame:
    """call() rows as (call, source) of a snapshot; a refused row's source says failed."""
    source = F.when(F.col("status") == "refused", F.concat(F.lit("sra-recaller:failed("), X.short_error(F.col("reason")), F.lit(")"))).when(
        F.size("uncalled_panel") > 0, F.concat(F.lit("sra-recaller:partial(panel-uncalled:"), F.array_join(F.transform("uncalled_panel", lambda p: p.cast("string")), "+"), F.lit(")"))
    ).when(F.size("tokens") > 0, "sra-recaller:called").otherwise("sra-recaller:wild-type")
    return df.withColumn("call", F.array_join("tokens", ",")).withColumn("source", source)


def call_window(seq: Column, w: Window, protein: str) -> Column:
    """struct<status, tokens, panel_hits, uncalled, reason, n_covered, n_residues> of one window's sequence; null is missing."""
    s = clean(seq)
    reason = F.when(s == "", "empty window consensus").when(F.length(s) % 3 != 0, F.format_string("length %d not a multiple of 3: a frame shift is refused, not guessed", F.length(s))).when(
        F.length(s) != w.bases, F.format_string(f"length %d instead of {w.bases} for {w.name} ({w.start}-{w.end}): insertions and deletions are refused", F.length(s)))
    got = _compared(translate(s), protein[w.start - 1 : w.end], w.start, w.panel)
    ok = seq.isNotNull() & reason.isNull()
    none = lambda kind: F.array().cast(f"array<{kind}>")
    status = F.when(seq.isNull(), "missing").when(reason.isNotNull(), "refused").when(F.size(got["uncalled"]) > 0, "partial").when(F.size(got["tokens"]) > 0, "called").otherwise("wild-type")
    return F.struct(
        status.alias("status"), F.when(ok, got["tokens"]).otherwise(none("string")).alias("tokens"), F.when(ok, got["panel_hits"]).otherwise(none("string")).alias("panel_hits"), F.when(ok, got["uncalled"]).otherwise(none("int")).alias("uncalled"),
        F.when(seq.isNotNull(), reason).alias("reason"), F.when(ok, w.residues - F.size(got["uncalled"])).otherwise(0).alias("n_covered"), F.lit(w.residues).alias("n_residues"),
    )


def call_windows(df: DataFrame, seqs: str, protein: str, windows: tuple[Window, ...] = WINDOWS) -> DataFrame:
    """df with windows (map of name to result), tokens, panel_hits, uncalled_panel, call, source; seqs: a map column of window name to sequence."""
    out = df
    for w in windows:
        out = out.withColumn(f"_{w.name}", call_window(F.try_element_at(F.col(seqs), F.lit(w.name)), w, protein))
    cols = [F.col(f"_{w.name}") for w in windows]
    panel = {p: e for w in windows for p, e in w.panel.items()}
    every = lambda f: F.concat(*[c[f] for c in cols])
    said = lambda w, c: F.concat(F.lit(f"{w.name}="), F.when(c["status"] == "partial", F.concat(F.lit("partial(uncalled:"), F.array_join(F.transform(c["uncalled"], lambda p: p.cast("string")), "+"), F.lit(")"))).when(c["status"] == "refused", F.concat(F.lit("refused("), c["reason"], F.lit(")"))).otherwise(c["status"]))
    return out.select(
        *df.columns, F.create_map(*[x for w, c in zip(windows, cols) for x in (F.lit(w.name), c)]).alias("windows"), X.by_residue(every("tokens")).alias("tokens"), X.by_residue(every("panel_hits")).alias("panel_hits"),
        F.array_sort(F.filter(every("uncalled"), lambda p: p.isin(*panel) if panel else F.lit(False))).alias("uncalled_panel"), F.concat(F.lit("sra-fks1-recaller:"), F.concat_ws(",", *[said(w, c) for w, c in zip(windows, cols)])).alias("source"),
    ).withColumn("call", F.array_join("tokens", ","))


def slice_windows(df: DataFrame, cds: str, reference_bases: int, windows: tuple[Window, ...] = WINDOWS) -> DataFrame:
    """df with window_seqs, cut from a full sequence; null (and a reason) where its length is not the reference's."""
    s = clean(F.col(cds))
    ok = F.length(s) == reference_bases
    return df.withColumn("window_seqs", F.when(ok, F.create_map(*[x for w in windows for x in (F.lit(w.name), w.cut(s))]))).withColumn("reason", F.when(~ok, F.format_string(f"length %d instead of {reference_bases}: windows can't be anchored", F.length(s))))


def sanity(calls: DataFrame, expected: str = "expected") -> DataFrame:
    """Outcome of known samples: inconclusive if not called, else pass if all expected tokens were found (more may be), else fail."""
    want = X.tokens(expected)
    lost = F.array_except(want, F.col("tokens"))
    return calls.withColumn("lost", lost).withColumn("extra", F.array_except("tokens", want)).withColumn(
        "outcome", F.when((F.col("status") != "ok") | (F.size("uncalled_panel") > 0), "inconclusive").when(F.size("lost") == 0, "pass").otherwise("fail"))


def outcomes(df: DataFrame, column: str = "outcome") -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))
