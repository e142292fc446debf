"""Cleaning and parsing of text columns; all JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: spellings of "nothing" in feeds, compared in lower case
NULLISH = ("", "null", "missing", "not provided", "not collected", "not applicable", "n/a", "na", "unknown", "not determined")
# fixed values: the twenty amino acids
AMINO_ACIDS = {
    "A": "ALA", "R": "ARG", "N": "ASN", "D": "ASP", "C": "CYS", "E": "GLU", "Q": "GLN", "G": "GLY", "H": "HIS", "I": "ILE",
    "L": "LEU", "K": "LYS", "M": "MET", "F": "PHE", "P": "PRO", "S": "SER", "T": "THR", "W": "TRP", "Y": "TYR", "V": "VAL",
}


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ws_strip(c: Column | str) -> Column:
    """Without white space of any kind at both ends (trim() takes blanks only)."""
    return F.regexp_replace(_c(c), r"^\s+|\s+$", "")


def clean_nullish(c: Column | str) -> Column:
    """Stripped text; '' for null and for every spelling of nothing."""
    s = ws_strip(F.coalesce(_c(c), F.lit("")))
    return F.when(F.lower(s).isin(*NULLISH), "").otherwise(s)


def filled(c: Column | str) -> Column:
    return clean_nullish(c) != ""


def isolate_key(accession: Column | str) -> Column:
    """An accession without its version."""
    return F.split_part(_c(accession), F.lit("."), F.lit(1))


def country(geo: Column | str) -> Column:
    """The part of a geography before a colon."""
    return ws_strip(F.split_part(_c(geo), F.lit(":"), F.lit(1)))


def tokens(call: Column | str) -> Column:
    """Distinct upper-case tokens of a call, in order of appearance; separators are , ; / | and white space."""
    return F.array_distinct(F.filter(F.split(F.upper(F.coalesce(_c(call), F.lit(""))), r"[,;/|\s]+"), lambda x: x != ""))


def is_called(call: Column | str) -> Column:
    """A non-blank call, which may still hold no token."""
    return ws_strip(F.coalesce(_c(call), F.lit(""))) != ""


def is_substitution(token: Column | str) -> Column:
    """Letter, number, letter or stop; case counts and letters need not be amino acids."""
    return _c(token).rlike(r"^[A-Z][0-9]+[A-Z*]$")


def parse_substitution(token: Column | str) -> Column:
    """struct<wt, pos, mut> in three-letter codes (a stop stays *), or null if the token is no point substitution."""
    s = F.upper(ws_strip(F.coalesce(_c(token), F.lit(""))))
    part = lambda i: F.regexp_extract(s, r"^([A-Z])([0-9]{1,9})([A-Z*])$", i)
    codes = F.create_map(*[F.lit(x) for k, v in AMINO_ACIDS.items() for x in (k, v)])
    wt, mut = F.element_at(codes, F.nullif(part(1), F.lit(""))), F.when(part(3) == "*", "*").otherwise(F.element_at(codes, F.nullif(part(3), F.lit(""))))
    return F.when(wt.isNotNull() & mut.isNotNull(), F.struct(wt.alias("wt"), F.nullif(part(2), F.lit("")).cast("int").alias("pos"), mut.alias("mut")))


def is_panel_token(token: Column | str, panel: dict[int, tuple[str, set[str]]]) -> Column:
    """Whether a token is one of a panel's substitutions {position: (wild type, mutants)}; any case."""
    names = sorted(f"{wt}{pos}{m}" for pos, (wt, muts) in panel.items() for m in muts)
    s = F.upper(ws_strip(F.coalesce(_c(token), F.lit(""))))
    # leading zeros of the position don't matter
    plain = F.regexp_replace(s, r"^([A-Z])0+([0-9])", "$1$2")
    return plain.isin(*names) if names else F.lit(False)


def residue_number(token: Column | str) -> Column:
    return F.try_to_number(F.nullif(F.regexp_extract(_c(token), r"(\d+)", 1), F.lit("")), F.lit("999999999")).cast("int")


def by_residue(tokens_: Column) -> Column:
    """Tokens ordered by residue number, then by text."""
    return F.transform(F.array_sort(F.transform(tokens_, lambda t: F.struct(residue_number(t).alias("n"), t.alias("t")))), lambda x: x["t"])


def version(c: Column | str) -> Column:
    """struct<major, minor> of the first number.number, else null."""
    part = lambda i: F.nullif(F.regexp_extract(_c(c), r"(\d+)\.(\d+)", i), F.lit("")).cast("int")
    return F.when(part(1).isNotNull(), F.struct(part(1).alias("major"), part(2).alias("minor")))


def short_error(c: Column | str, most: int = 80) -> Column:
    """First line of a message, without commas, at most ``most`` characters."""
    return F.translate(F.substring(F.split_part(_c(c), F.lit("\n"), F.lit(1)), 1, most), ",", ";")


def first_run(c: Column | str) -> Column:
    """The first of several linked runs."""
    return ws_strip(F.split_part(F.coalesce(_c(c), F.lit("")), F.lit(","), F.lit(1)))
