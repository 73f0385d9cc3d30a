"""Shards by jump consistent hashing: the stable key and the number of shards alone decide a row's shard.

No ring table exists; adding a shard moves only the rows that the new shard takes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolescape.llm.common import per_batch

#: Parts of a shard that are numbered apart, so no task holds a whole shard. A documented constant of the numbering.
LANES = 64
NULL_KEY = 0x9E3779B97F4A7C15


def mixed(keys: np.ndarray) -> np.ndarray:
    """Keys spread over 64 bits (the splitmix64 finalizer)."""
    x = keys.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key among `shards` shards."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    state = mixed(keys)
    shard = np.zeros(len(state), np.int64)
    ahead = np.zeros(len(state), np.int64)
    todo = np.arange(len(state))
    while len(todo):
        shard[todo] = ahead[todo]
        with np.errstate(over="ignore"):
            state[todo] = state[todo] * np.uint64(2862933555777941757) + np.uint64(1)
        step = (1 << 31) / ((state[todo] >> np.uint64(33)).astype(np.float64) + 1)
        ahead[todo] = ((shard[todo] + 1) * step).astype(np.int64)
        todo = todo[ahead[todo] < shards]
    return shard


def shard(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, law, shard, slot, grown_shard for each row of docs.

    size is the text's UTF-8 bytes plus 16; a null text counts as none. All rows with a null key share one shard.
    Slots number a shard's rows from 0 without gaps, by lane (a hash of key and text) and in it by key and text, so
    repeated rows get neighbouring slots. An empty table gives an empty result.
    """
    raw = F.coalesce(docs[text], F.lit("")).cast("binary")
    rows = docs.select(docs[key].cast("long").alias("doc_id"), (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column("doc_id")
        keys = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64).copy()
        keys[ids.is_null().to_numpy(zero_copy_only=False)] = NULL_KEY
        crc = batch.column("text_crc32").to_numpy().astype(np.uint64)
        lane = (mixed(keys ^ (crc << np.uint64(20))) % np.uint64(LANES)).astype(np.int32)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(jump_hash(keys, shards).astype(np.int32)), pa.array(jump_hash(keys, shards + 1).astype(np.int32)), pa.array(lane)], [*batch.schema.names, "shard", "grown_shard", "lane"])

    dealt = per_batch(rows, run, "doc_id long, size long, text_crc32 long, shard int, grown_shard int, lane int")
    in_lane = Window.partitionBy("shard", "lane").orderBy("doc_id", "text_crc32", "size")
    # shards x LANES rows at most: the counts of lanes, and of the lanes before
    counts = dealt.groupBy("shard", "lane").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("shard").alias("s"), F.col("lane").alias("l"), before.alias("before"))
    numbered = dealt.withColumn("nth", F.row_number().over(in_lane) - 1)
    placed = numbered.join(F.broadcast(starts), (F.col("shard") == F.col("s")) & (F.col("lane") == F.col("l")))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("nth")).alias("slot"), "grown_shard")
