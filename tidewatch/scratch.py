"""Written intermediate tables in the folder that all executors share.

Intermediate tables are Parquet files in the folder the cluster names in
``spark.checkpoint.dir``; a lost executor therefore never loses them.  They are
deleted by ``Scratch.drop`` as soon as a later table replaces them, and what a
returned frame still reads is deleted when the application ends.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import uuid

from pyspark.sql import DataFrame, SparkSession

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package, also when the driver only has it on sys.path."""
    env = spark.sparkContext.environment
    if REPO not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (REPO, env.get("PYTHONPATH")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's own; on one machine one we set where none is set; else an error."""
    sc = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(os.path.join(os.path.abspath("spark-warehouse"), "checkpoints"))
    found = spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


#: Whether shuffle files go as soon as the query that wrote them has ended.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _cleaned(spark: SparkSession):
    """Within: a query's shuffle files are removed when it ends, not when the driver happens to collect garbage."""
    before = spark.conf.get(_CLEAN, None)
    if before is None:  # not in this version of Spark
        yield
        return
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before)


_left: list[tuple[SparkSession, str]] = []


def hadoop(spark: SparkSession, path: str):
    """(file system, path) as Hadoop's own objects."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _delete(spark: SparkSession, path: str) -> None:
    fs, at = hadoop(spark, path)
    fs.delete(at, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _left:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone by now
            pass
    _left.clear()


class Scratch:
    """Written intermediate tables of one operator call."""

    def __init__(self, spark: SparkSession, name: str):
        importable(spark)
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        _left.append((spark, self.path))

    def new_path(self) -> str:
        self.n += 1
        return f"{self.path}/{self.n}"

    def table(self, df: DataFrame) -> DataFrame:
        """Write df, return the written table: computed once, and safe from lost executors.  What df shuffled is removed."""
        path, schema = self.new_path(), df.schema
        with _cleaned(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables nothing will read again."""
        for t in tables:
            if path := getattr(t, "_scratch_path", None):
                _delete(self.spark, path)


def fresh(taken: list[str], *names: str) -> list[str]:
    """Names that no column of ``taken`` has, whatever its case, nor each other."""
    used, out = {c.lower() for c in taken}, []
    for n in names:
        while n.lower() in used:
            n = f"_{n}"
        used.add(n.lower())
        out.append(n)
    return out
