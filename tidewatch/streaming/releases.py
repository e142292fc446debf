"""Snapshot releases as a stream: each new file is normalised, and delivers its news once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alerts as A
from ..operators.store import normalize
from ..plans.surveillance import Structure
from ..sources.feeds import RAW_COLUMNS


def release_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Raw rows of releases that arrive in a folder, one file for each."""
    schema = ", ".join(f"`{c}` string" for c in RAW_COLUMNS)
    return spark.readStream.schema(schema).option("sep", "\t").option("header", True).option("maxFilesPerTrigger", 1).csv(folder)


def deliver_stream(stream: DataFrame, state_path: str, structure: Structure, as_of: str, emit: Callable[[DataFrame, int], None], checkpoint: str, transform=lambda df: df):
    """A query that runs detection on every release and hands new alerts to emit(alerts, batch).

    The state is a Parquet table with a version for each batch, so a batch that is run again
    starts from the state before it and ends in the same place.
    """
    spark = stream.sparkSession

    def state_before(batch: int) -> DataFrame:
        empty = spark.createDataFrame([], "token string, tier string")
        for b in range(batch - 1, -1, -1):
            try:
                return spark.read.parquet(f"{state_path}/batch={b}")
            except Exception as e:  # noqa: BLE001
                if "PATH_NOT_FOUND" not in str(e):
                    raise
        return empty

    def each(df: DataFrame, batch: int) -> None:
        records = transform(normalize(df))
        state = state_before(batch)
        found = A.compose(records, structure.verdicts, as_of)
        emit(A.new_alerts(found, state), batch)
        A.next_state(found, state).write.mode("overwrite").parquet(f"{state_path}/batch={batch}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_tokens(stream: DataFrame, time: str, token: str, window: str = "7 days", late: str = "2 days") -> DataFrame:
    """Counts of tokens by event-time window with a watermark; a timestamp without zone is read as UTC."""
    return stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late).groupBy(F.window("_t", window), token).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), token, "n")
