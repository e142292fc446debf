"""Tabular sources: raw feeds, snapshots, commented tables, run logs, molecule lists."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, IsNull, StringStartsWith

from ..operators.store import INDEX_COLUMNS, SNAPSHOT_COLUMNS
from ..scratch import importable
from .structures import lines

RAW_COLUMNS = ("target_acc", "Run", "geo_loc_name", "target_creation_date", "collection_date", "biosample_acc", "asm_acc", "lat_lon")
RUN_LOG = "kind string, status string, started string, finished string, git_commit string, tools map<string,string>, items array<map<string,string>>, error string"


def _strings(columns) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Raw feed (tab-separated, header, any columns); only the columns that are used are parsed."""
    df = spark.read.csv(path, sep="\t", header=True, multiLine=True, escape='"', encoding="UTF-8")
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in RAW_COLUMNS])


class _Lines:
    """Lines of a text behind a URL that begin in a range of its bytes, read from there on only."""

    def __init__(self, url: str):
        import urllib.parse
        import urllib.request

        self.url, self.local = url, urllib.parse.urlparse(url).scheme == "file"
        self.open = urllib.request.urlopen
        self.request = urllib.request.Request

    def size(self) -> int | None:
        """Length in bytes, if the text can be read from any place."""
        with self.open(self.url if self.local else self.request(self.url, method="HEAD")) as f:
            n = f.headers.get("Content-Length")
            return int(n) if n and (self.local or f.headers.get("Accept-Ranges") == "bytes") else None

    def read(self, first: int = 0, last: int | None = None):
        """Lines that begin in [first, last) as bytes without their ends."""
        at = max(0, first - 1)  # one byte before: a line that begins at first has a line end there
        if at and not self.local:
            f = self.open(self.request(self.url, headers={"Range": f"bytes={at}-"}))
        else:
            f = self.open(self.url)
            if at:
                f.read(at) if not f.seekable() else f.seek(at)
        with f:
            if first:
                at += len(f.readline())
            while last is None or at < last:
                line = f.readline()
                if not line:
                    return
                at += len(line)
                yield line.rstrip(b"\r\n")


class _Range(InputPartition):
    def __init__(self, first: int, last: int | None):
        self.first, self.last = first, last


class ReleaseSource(DataSource):
    """A feed's release as a batch source: format("release") with a ``url`` that urllib opens (file: included).

    The text is read in ranges of ``split_bytes`` bytes, one a task, where its server tells the length and serves ranges,
    else by one task.  A task owns the lines that begin in its range; a record is a line, with fields in quotes unquoted.
    Only columns of the given schema are made (by default all that are used).  With option
    ``push_filters`` (and spark.sql.python.filterPushdown.enabled, which Spark asks for) =, in, is (not) null and
    starts-with on text columns are tested before a row is handed over.
    """

    SPLIT_BYTES = 32 << 20

    @classmethod
    def name(cls) -> str:
        return "release"

    def schema(self) -> str:
        return ", ".join(f"`{c}` string" for c in RAW_COLUMNS)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        kind = _FilteringReader if self.options.get("push_filters", "false").lower() == "true" else _ReleaseReader
        return kind(self.options["url"], int(self.options.get("split_bytes", self.SPLIT_BYTES)), schema.names)


class _ReleaseReader(DataSourceReader):
    def __init__(self, url: str, split: int, names: list[str]):
        self.url, self.split, self.names, self.tests = url, max(1, split), names, []

    def partitions(self):
        size = _Lines(self.url).size()
        if size is None:
            return [_Range(0, None)]
        return [_Range(at, min(size, at + self.split)) for at in range(0, max(size, 1), self.split)]

    def read(self, partition):
        import csv

        text = _Lines(self.url)
        header = next(iter(text.read()), b"").decode("utf-8", "replace").removeprefix("\ufeff")
        place = {c: i for i, c in enumerate(next(csv.reader([header], delimiter="\t"), []))}
        at = [place.get(c) for c in self.names]
        tests = [(place.get(c), kind, v) for c, kind, v in self.tests]

        def passes(row: list) -> bool:
            for i, kind, v in tests:
                x = row[i] if i is not None and i < len(row) else None
                if not (x in v if kind == "in" else x is not None and x.startswith(v) if kind == "starts" else (x is not None) == (kind == "known")):
                    return False
            return True

        lines = text.read(partition.first, partition.last)
        if partition.first == 0:
            next(lines, None)  # the header
        for row in csv.reader((x.decode("utf-8", "replace") for x in lines if x), delimiter="\t"):
            if passes(row):
                yield tuple(row[i] if i is not None and i < len(row) else None for i in at)


class _FilteringReader(_ReleaseReader):
    def pushFilters(self, filters):  # noqa: N802  the interface's name
        """Keep the filters that a row can be tested by here; hand back the others."""
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if column not in self.names:
                yield f
            elif isinstance(f, EqualTo) and isinstance(f.value, str):
                self.tests.append((column, "in", (f.value,)))
            elif isinstance(f, In) and all(isinstance(x, str) for x in f.value):
                self.tests.append((column, "in", tuple(f.value)))
            elif isinstance(f, StringStartsWith):
                self.tests.append((column, "starts", f.value))
            elif isinstance(f, IsNotNull):
                self.tests.append((column, "known", None))
            elif isinstance(f, IsNull):
                self.tests.append((column, "unknown", None))
            else:
                yield f


class PoolSource(DataSource):
    """A paged service as a batch source: format("pool") with a ``url`` that has {offset} and {limit}; a page is a task.

    A page is a JSON object with a list under ``items`` (by default "items") and, on the first page, the number of all items under
    the dotted path ``total``.  Columns are those of the given schema, read by dotted paths in option ``paths`` (column=path, ...) or by
    their names.  A page that can't be read gives no rows and is counted as none, as a screen goes on without it, unless ``strict``.
    """

    @classmethod
    def name(cls) -> str:
        return "pool"

    def schema(self) -> str:
        return "name string, smiles string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _PoolReader(dict(self.options), schema.names)


def _at(value, path: str):
    for key in path.split("."):
        value = value.get(key) if isinstance(value, dict) else None
    return value


class _PoolReader(DataSourceReader):
    def __init__(self, options: dict, names: list[str]):
        self.options, self.names = options, names
        self.limit = int(options.get("limit", 1000))
        self.strict = str(options.get("strict", "false")).lower() == "true"
        self.paths = dict(x.strip().split("=", 1) for x in options.get("paths", "").split(",") if "=" in x)

    def _page(self, offset: int) -> dict:
        import json
        import urllib.request

        try:
            with urllib.request.urlopen(self.options["url"].format(offset=offset, limit=self.limit), timeout=60) as f:
                return json.load(f)
        except (OSError, ValueError):
            if self.strict:
                raise
            return {}

    def partitions(self):
        total = _at(self._page(0), self.options.get("total", "total")) or 0
        return [_Range(at, None) for at in range(0, max(int(total), 1), self.limit)]

    def read(self, partition):
        for item in _at(self._page(partition.first), self.options.get("items", "items")) or []:
            row = [_at(item, self.paths.get(c, c)) for c in self.names]
            if all(x is not None for x in row):
                yield tuple(str(x) for x in row)


def latest_release(listing: DataFrame, column: str = "value", prefix: str = r"PDG\d+") -> str:
    """The release with the numerically greatest suffix among all links of a listing."""
    tag = F.explode(F.regexp_extract_all(column, F.lit(rf"({prefix}\.\d+)"), 1))
    best = listing.select(tag.alias("tag")).agg(F.max_by("tag", F.split_part("tag", F.lit("."), F.lit(-1)).cast("long")).alias("tag")).first()["tag"]
    if best is None:
        raise ValueError("the listing names no release")
    return best


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """A canonical snapshot; empty fields stay empty text."""
    return spark.read.schema(_strings(SNAPSHOT_COLUMNS)).csv(path, sep="\t", header=True, multiLine=True, escape='"').na.fill("")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_strings(INDEX_COLUMNS)).csv(path, sep="\t", header=True, escape='"').na.fill("")


def read_records(spark: SparkSession, snapshot: str | None = None, tsv: str | None = None, url: str | None = None) -> DataFrame:
    """Records of the first source that is given: a snapshot, else a raw file, else a live release."""
    from ..operators.store import normalize

    if snapshot:
        return read_snapshot(spark, snapshot)
    if tsv:
        return normalize(read_feed(spark, tsv))
    if url:
        importable(spark)
        spark.dataSource.register(ReleaseSource)
        return normalize(spark.read.format("release").option("url", url).load())
    raise ValueError("name a snapshot, a tsv or a url")


def read_commented(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated table whose first line that is neither blank nor a # comment is its header."""
    return spark.read.csv(path, sep="\t", header=True, comment="#")


def read_runs(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """A run log, oldest first; malformed lines are left out, a missing file has no runs."""
    try:
        df = spark.read.schema(RUN_LOG).json(path, mode="DROPMALFORMED")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        df = spark.createDataFrame([], RUN_LOG)
    return (df.where(F.col("kind") == kind) if kind else df).orderBy("started")


def read_molecules(spark: SparkSession, path: str) -> DataFrame:
    """A molecule list: file, line (as text order), smiles, name; lines without exactly two fields come with status malformed."""
    parts = F.split("text", "\t")
    ok = F.size(parts) == 2
    return lines(spark, path).where("text != ''").select("file", "line", F.when(ok, F.get(parts, F.lit(0))).alias("smiles"), F.when(ok, F.get(parts, F.lit(1))).alias("name"), F.when(ok, "ok").otherwise("malformed").alias("status"))


def read_state(column):
    """Delivery memory {token: tier} of a JSON text; blank text and unknown tiers give nothing."""
    from ..operators.alerts import TIERS

    j = F.from_json(F.coalesce(F.nullif(F.trim(column), F.lit("")), F.lit("{}")), "delivered map<string,string>, updated string")
    return F.map_filter(F.coalesce(j["delivered"], F.create_map().cast("map<string,string>")), lambda k, v: v.isin(*TIERS))


def parse_config(text: str) -> dict[str, dict]:
    """A strict two-level configuration: ``section:`` lines, then indented ``key: value`` lines."""
    out: dict[str, dict] = {}
    section = None
    for n, raw in enumerate(text.splitlines(), 1):
        line = re.sub(r"(^|\s)#.*$", "", raw).rstrip()
        if not line.strip():
            continue
        key, colon, value = line.strip().partition(":")
        if not colon:
            raise ValueError(f"line {n}: no colon")
        if line[0].isspace():
            if section is None:
                raise ValueError(f"line {n}: a value outside any section")
            if key.strip() in out[section]:
                raise ValueError(f"line {n}: {key.strip()} again")
            out[section][key.strip()] = _scalar(value.strip())
        else:
            if value.strip():
                raise ValueError(f"line {n}: a section with a value")
            section = key.strip()
            out[section] = {}
    return out


def _scalar(text: str):
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    if text[:1] == "[" and text[-1:] == "]":
        return [_scalar(x.strip()) for x in text[1:-1].split(",") if x.strip()]
    return text.strip("\"'")
