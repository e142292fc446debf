"""Small record sets of our own, with answers that follow from the rules."""

FIELDS = ("isolate_key", "target_creation_date", "collection_date", "erg11_call", "country", "resistance_source")
#: (records, visible, collected, call, country); detection is asked as of AS_OF.
AS_OF = "2023-06-30"
GROUPS = (
    (3, "2023-02-10", "2022", "G54W", "Chile"),
    (2, "2023-03-05", "2022", "M220K", "Peru"),
    (3, "2023-04-01", "2022", "", "Chile"),
    (5, "2023-08-15", "2023", "M220K", "Chile"),
    (3, "2023-09-01", "2023", "H147Y", "Peru"),
    (4, "2023-09-20", "2018", "DUP46;m220k", "Kenya"),
    (2, "2023-10-02", "2023", "", "Peru"),
)


def demo() -> list[tuple]:
    every = [g[1:] for g in GROUPS for _ in range(g[0])]
    return [(f"P{i:03d}", *g, "sra-recaller:called" if g[2] else "pending:sra-recaller") for i, g in enumerate(every, 1)]


def replay() -> list[tuple]:
    """A background of four early months, then four carriers of one token in winter."""
    early = [("2021-01-10", "S3T"), ("2021-02-10", "S3T"), ("2021-03-10", ""), ("2021-04-10", "")]
    late = [(d, "L98H") for d in ("2021-11-20", "2021-12-05", "2022-01-12", "2022-02-01")]
    return [(f"R{i}", d, "2021", call, "X", "") for i, (d, call) in enumerate(early + late)]
