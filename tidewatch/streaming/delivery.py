"""Delivery with a memory by token: a stream of alerts gives its news, each once.

The memory is keyed state: for every token ever alerted the most urgent tier it ever had, in the stream's state
store.  A batch reads and writes the tokens it has alerts for and no others, whatever the size of the memory, and a
query that is started again goes on from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.alerts import TIERS
from ..scratch import importable

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class MostUrgent(StatefulProcessor):
    """Rows (token, tier, release, ...) of one token, by release: those more urgent than all before, with the tier before (prior; null: new)."""

    def __init__(self, names: list[str]):
        self.names = names

    def init(self, handle) -> None:
        self.held = handle.getValueState("urgency", "rank int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803  the interface's names
        best = self.held.get()[0] if self.held.exists() else None
        before = best
        by_release = sorted((r.asDict() for r in rows if r["tier"] in TIERS), key=lambda r: (r["release"], TIERS.index(r["tier"])))
        for r in by_release:
            rank = TIERS.index(r["tier"])
            if best is None or rank < best:
                yield Row(**{n: r[n] for n in self.names}, prior=None if best is None else TIERS[best])
                best = rank
        if best != before:
            self.held.update((best,))

    def close(self) -> None:
        pass


def news(alerts: DataFrame) -> DataFrame:
    """Of a stream of alerts (token, tier, release, more columns) those that are new or more urgent than ever, with prior.

    Alerts of a token are taken by release within a batch; a release's alert that comes again is no news; unknown tiers
    and null tokens are left out.
    """
    importable(alerts.sparkSession)
    schema = StructType([*alerts.schema.fields, StructField("prior", StringType())])
    known = alerts.where(F.col("token").isNotNull() & F.col("release").isNotNull())
    return known.groupBy("token").transformWithState(MostUrgent(alerts.columns), schema, "Append", "None")


def deliver_news(alerts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the news of a stream of alerts to Parquet, each once, for all that is there now."""
    spark = alerts.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return news(alerts).writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def remembered(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(token, tier): the memory of a delivery, read from its checkpoint."""
    kept = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "urgency").load()
    return kept.select("key.token", F.element_at(F.array(*map(F.lit, TIERS)), F.col("value.rank") + 1).alias("tier"))
