"""Packing of token sequences: minimum bin slack over a histogram of lengths.

Only lengths matter to a packing, and there are at most `capacity` of them. The pieces of all documents are
counted by length; the driver fills one bin after the other from that histogram: the largest length left is
placed, and a subset-sum dynamic program over the lengths left (a big integer as bitset) finds the fullest
combination for the rest. The combination is then used as often as the counts allow, so the work depends on the
number of lengths, not of documents. Pieces get their rank among those of their length and look up the bin and
place of that rank.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolescape.llm.common import per_batch, shared_dir, slim, texts
from rolescape.llm.wordpieces import word_pieces

CAPACITY = 2048
END_ID = 0


@dataclass(frozen=True)
class Combination:
    """parts: (length, how many of it in a bin), largest first; bins: how many bins are filled so, from number `first`."""

    parts: tuple[tuple[int, int], ...]
    first: int
    bins: int


def fullest(room: int, lengths: list[int], counts: dict[int, int]) -> list[tuple[int, int]]:
    """(length, copies) whose sum is the largest that is at most room, larger lengths preferred.

    Bit s of the integer says that s can be reached with the lengths so far; the search ends when room itself can.
    """
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in lengths:
        if length > room:
            continue
        copies, left, unit = min(counts[length], room // length), 0, 1
        while copies > 0:  # copies in lots of 1, 2, 4, ...
            left = min(unit, copies)
            copies -= left
            unit *= 2
            steps.append((length, left, reach))
            reach |= (reach << (length * left)) & mask
            if reach >> room & 1:
                copies = 0
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for length, lot, before in reversed(steps):
        if not before >> at & 1:
            at -= length * lot
            used[length] = used.get(length, 0) + lot
    return sorted(used.items(), reverse=True)


def minimum_bin_slack(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Combination]:
    """Combinations that place every item of a histogram {length: count}; lengths are 1 to capacity."""
    left = {k: v for k, v in histogram.items() if v > 0}
    if any(not 0 < k <= capacity for k in left):
        raise ValueError("a length is outside 1..capacity")
    lengths, plan, first = sorted(left, reverse=True), [], 0
    while lengths:
        top = lengths[0]
        left[top] -= 1
        parts = dict(fullest(capacity - top, lengths, left)) if top < capacity else {}
        left[top] += 1
        parts[top] = parts.get(top, 0) + 1
        bins = min(left[k] // n for k, n in parts.items())
        plan.append(Combination(tuple(sorted(parts.items(), reverse=True)), first, bins))
        first += bins
        for k, n in parts.items():
            left[k] -= n * bins
            if not left[k]:
                lengths.remove(k)
    return plan


@dataclass(frozen=True)
class Places:
    """For each length, runs of ranks: starts[i] is the first rank of a run whose bins begin at bins[i]; each bin of it
    holds copies[i] of the length from offset offsets[i] on."""

    starts: np.ndarray
    bins: np.ndarray
    copies: np.ndarray
    offsets: np.ndarray


def places(plan: list[Combination]) -> dict[int, Places]:
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    seen: dict[int, int] = {}
    for c in plan:
        offset = 0
        for length, n in c.parts:
            runs.setdefault(length, []).append((seen.get(length, 0), c.first, n, offset))
            seen[length] = seen.get(length, 0) + n * c.bins
            offset += n * length
    return {k: Places(*(np.array(x, np.int64) for x in zip(*v, strict=True))) for k, v in runs.items()}


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents' pieces: key, piece, start, length, ids_crc32, and task, nth: the place among the task's pieces of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, nth, encoder = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), word_pieces(vocabulary)
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            keys, rows = [], []
            for k, x in zip(batch.column(key).to_pylist(), texts(batch, text), strict=True):
                raw = encoder.encode(x) + end
                for i, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    n = len(part) // 4
                    keys.append(k)
                    rows.append((i, at // 4, n, zlib.crc32(part), nth[n]))
                    nth[n] += 1
            if rows:
                c = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(c[0], pa.int32()), *(pa.array(x, pa.int64()) for x in c[1:4]), pa.array([task] * len(keys), pa.int32()), pa.array(c[4], pa.int64())], [key, "piece", "start", "length", "ids_crc32", "task", "nth"])

    from rolescape.llm.common import bounded_batches

    bounded_batches(docs.sparkSession)
    return slim(docs, key, text).mapInArrow(run, f"{key} long, piece int, start long, length long, ids_crc32 long, task int, nth long")


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's pieces with the sequence and offset where they are placed.

    A null or empty text is the end id alone. Repeated rows are packed as often as they occur; a null key stays
    null. An empty table gives an empty result. The pieces are written once to the shared folder, so that the ranks
    that later stages count on cannot change when a task is run again.
    """
    spark = docs.sparkSession
    path = shared_dir(spark, "pieces")
    cut = pieces(docs, vocabulary, capacity, key, text)
    cut.write.parquet(path)
    cut = spark.read.schema(cut.schema).parquet(path)
    by_task = cut.groupBy("length", "task").agg(F.count("*").alias("n"))
    # at most `capacity` rows reach the driver, whatever the input
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    placed = places(minimum_bin_slack(histogram, capacity))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    starts = by_task.select("length", "task", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = cut.join(starts, ["length", "task"]).select(key, "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
        sequence, offset = np.empty_like(rank), np.empty_like(rank)
        order = np.argsort(length, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
            n = int(length[rows[0]])
            p = placed[n]
            r = rank[rows]
            i = np.searchsorted(p.starts, r, side="right") - 1
            within = r - p.starts[i]
            sequence[rows] = p.bins[i] + within // p.copies[i]
            offset[rows] = p.offsets[i] + within % p.copies[i] * n
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in (key, "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], [key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return per_batch(ranked, run, f"{key} long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
