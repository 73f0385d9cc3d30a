"""Shared pieces of the training-data operators: reading, Arrow loops, shared folders and block stores."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows that one Arrow batch hands to Python: with texts of 100 kB a batch stays near 50 MB.
ARROW_ROWS = 512
#: Bytes of text that operators on blocks take up at a time; a longer text stands alone.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the rows of an Arrow batch to ARROW_ROWS, so long texts cannot fill a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > ARROW_ROWS or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder below the cluster's spark.checkpoint.dir; where that is unset, below a temporary one on a local master
    (tests), and an error on a cluster, whose executors would not see it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext.getCheckpointDir() if hasattr(spark.sparkContext, "getCheckpointDir") else None
        if not found and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        root = found or "file://" + tempfile.mkdtemp(prefix="rolescape-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """A table written to the shared folder and read back: its lineage ends there, and it is computed once."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session, the unit by which operators size their buckets."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def per_batch(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow with a function of one batch; empty batches are skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out

    bounded_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The batch's texts, null as empty."""
    return ["" if x is None else x for x in batch.column(column).to_pylist()]


def slim(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the columns an operator needs, so others with clashing names cannot disturb it."""
    return docs.select(*[docs[c] for c in columns])


def filesystem(uri: str):
    """The file system and path of a URI, for tasks that read or write shared files themselves."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


class BlockStore:
    """A copy of a table in the shared folder, one Parquet file for each task that wrote it.

    Tasks address a row by (block, row): the file's number and the row's place in it. The operators that need
    the texts several times read a block's file again instead of shuffling the texts, and a task that is lost
    with its executor finds the same file when it is run again.
    """

    def __init__(self, spark: SparkSession, files: list[str]):
        self.spark, self.files = spark, files

    @classmethod
    def write(cls, df: DataFrame, purpose: str) -> BlockStore:
        spark = df.sparkSession
        path = shared_dir(spark, purpose)
        df.write.option("compression", "zstd").option("maxRecordsPerFile", 0).parquet(path)
        return cls(spark, sorted(spark.read.schema(df.schema).parquet(path).inputFiles()))

    def frame(self) -> DataFrame:
        """(block, file), a row for each block, dealt one to a task."""
        rows = [(i, f) for i, f in enumerate(self.files)]
        n = max(1, len(rows))
        df = self.spark.createDataFrame(rows, "block int, file string")
        return df.repartitionById(n, F.col("block")) if rows else df


def by_bytes(batch: pa.RecordBatch, text: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in slices whose texts hold at most `limit` bytes together, or one text that is longer."""
    import numpy as np
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto = np.cumsum(size)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(upto, limit + (upto[at - 1] if at else 0), side="right")))
        yield batch.slice(at, end - at)
        at = end


def read_block(uri: str, columns: list[str] | None = None, rows: int = ARROW_ROWS, text: str | None = None) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(first row, batch) of a block's file, in the file's order; with `text`, batches are bounded by that column's bytes."""
    import urllib.parse

    import pyarrow.parquet as pq

    system, path = filesystem(uri)
    if uri.startswith("file:"):
        path = urllib.parse.unquote(path)
    with system.open_input_file(path) as f:
        at = 0
        for batch in pq.ParquetFile(f).iter_batches(batch_size=rows, columns=columns):
            for part in by_bytes(batch, text) if text else [batch]:
                yield at, part
                at += part.num_rows
