"""Streaming forms: source health, alert ingestion and the ledger, fed by file streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from rolescape import alerts
from rolescape.operators.ledger import health_latest
from rolescape.store import Store


def landed(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """Parquet files as they land."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def health(attempts: DataFrame) -> DataFrame:
    """Running source health; use in update or complete mode. Its state is one row for each source."""
    return health_latest(attempts)


def once_each(stream: DataFrame, key: str, known: Callable[[], DataFrame | None], sink: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """Micro-batches of rows whose key is new, to a sink that gets the batch's number.

    known() gives what has been stored. A batch that is run again after a failure carries its old number, under which
    the sink replaces what it wrote, so a row enters once.
    """

    def each(batch: DataFrame, number: int) -> None:
        fresh, before = batch.dropDuplicates([key]), known()
        if before is not None:
            fresh = fresh.join(before.select(key).distinct(), key, "left_anti")
        sink(fresh, number)

    return stream.writeStream.foreachBatch(each)


def late_windows(events: DataFrame, at: str, key: str, delay: str = "48 hours", width: str = "1 day") -> DataFrame:
    """Counts in event-time windows; what is later than the delay is left out once its window has been given."""
    return events.withWatermark(at, delay).groupBy(F.window(at, width), key).agg(F.count("*").alias("n"))


def ledger(stream: DataFrame, root: str, writer: str = "ledger", seq: str = "seq") -> DataStreamWriter:
    """Job rows with an arrival number, merged into the versioned ledger below root as they come.

    A batch is a version. It carries the writer's name and its number as a mark, so a batch that is run again after a
    failure, or after it was stored, enters once. A stream that begins anew with another checkpoint folder takes another
    writer's name; it goes on from the newest version.
    """

    def each(batch: DataFrame, number: int) -> None:
        Store(batch.sparkSession, root).upsert(batch, seq=seq, mark=f"{writer}:{number}")

    return stream.writeStream.foreachBatch(each)


def messages(stream: DataFrame, root: str, writer: str = "alerts") -> DataStreamWriter:
    """Alert messages with their candidate jobs, into jobs, messages and links of one ledger version for each batch."""

    def each(batch: DataFrame, number: int) -> None:
        alerts.ingest(Store(batch.sparkSession, root), batch, f"{writer}:{number}")

    return stream.writeStream.foreachBatch(each)
