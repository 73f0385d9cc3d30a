"""Exchange of 64-bit names between the blocks of a block store.

A block is one file of a BlockStore. `shared_names` finds, for each block, which of its names also occur in another
block (or twice in itself): a block sends each name once, however many of its rows have it, to the bucket that the
name's high bits choose; the bucket answers each block with the names that came more than once. A name that a third
of all rows have costs one entry for each block, and no task sees more than its share of the names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rolescape.llm.common import BlockStore, partitions


def pack_names(names: np.ndarray) -> bytes:
    """Ascending names as their differences, compressed byte by byte of the difference."""
    gaps = np.diff(names, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(gaps.T).tobytes())


def unpack_names(raw: bytes) -> np.ndarray:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.cumsum(np.ascontiguousarray(data.reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def squeeze(*parts: bytes) -> bytes:
    """Byte strings in one compressed message."""
    sizes = np.array([len(parts), *map(len, parts)], "<u8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(sizes + b"".join(parts))


def expand(raw: bytes) -> list[bytes]:
    data = zstandard.ZstdDecompressor().decompress(raw)
    n = int.from_bytes(data[:8], "little")
    sizes = np.frombuffer(data, "<u8", n, 8).tolist()
    out, at = [], 8 + 8 * n
    for s in sizes:
        out.append(data[at : at + s])
        at += s
    return out


def bucket_edges(buckets: int) -> np.ndarray:
    """First name of each bucket but the lowest: equal ranges of the 64-bit names."""
    return np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)


def split_by_bucket(names: np.ndarray, edges: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(bucket, slice) for the buckets that hold any of the ascending names."""
    cuts = np.concatenate([[0], np.searchsorted(names, edges), [len(names)]])
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        yield b, slice(int(cuts[b]), int(cuts[b + 1]))


def table_of(rows: Iterable[tuple], schema: pa.Schema) -> pa.Table:
    rows = list(rows)
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def map_blocks(store: BlockStore, fn: Callable[[int, str], Iterator[tuple]], schema: pa.Schema, ddl: str) -> DataFrame:
    """fn(block, file) for each block; its rows become the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, file in zip(batch.column("block").to_pylist(), batch.column("file").to_pylist(), strict=True):
                for row in fn(block, file):
                    yield from table_of([row], schema).to_batches()

    return store.frame().mapInArrow(run, ddl)


def answer_blocks(store: BlockStore, answers: DataFrame, fn: Callable[[int, str, list[dict]], Iterator[pa.RecordBatch]], ddl: str | StructType, every: bool = False) -> DataFrame:
    """fn(block, file, rows of answers with that block) for each block that has any; `every` calls it for the others too.

    answers has a column block; a block's answers are gathered in one task, and are of the size of the block.
    """
    files, n = store.files, max(1, len(store.files))
    names = [f.name for f in answers.schema.fields if f.name != "block"]
    dealt = answers.select("block", *names)
    if every:
        none = store.frame().select("block", *[F.lit(None).cast(answers.schema[c].dataType).alias(c) for c in names])
        dealt = dealt.unionByName(none)
    # a block's place among the tasks is its number, so that no two blocks meet in a task
    dealt = dealt.repartitionById(n, F.col("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, list[dict]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                rows.setdefault(row.pop("block"), []).append(row)
        for block, found in sorted(rows.items()):
            yield from fn(block, files[block], [r for r in found if any(v is not None for v in r.values())])

    return dealt.mapInArrow(run, ddl)


def buckets_for(store: BlockStore) -> int:
    """As many as the session's shuffle partitions, and at least as many as blocks, so that a bucket is no larger than a block."""
    return max(partitions(store.spark), len(store.files))


def gather_buckets(sent: DataFrame, buckets: int, fn: Callable[[int, list[dict]], Iterator[tuple | pa.RecordBatch]], schema: pa.Schema, ddl: str) -> DataFrame:
    """fn(bucket, rows of sent with that bucket) for each bucket; it gives rows, or batches of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, list[dict]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                rows.setdefault(row.pop("bucket"), []).append(row)
        for bucket in sorted(rows):
            for row in fn(bucket, rows.pop(bucket)):
                yield from [row] if isinstance(row, pa.RecordBatch) else table_of([row], schema).to_batches()

    return sent.repartitionById(buckets, F.col("bucket")).mapInArrow(run, ddl)


SENT = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("names", pa.binary()), ("twice", pa.binary())])
SHARED = pa.schema([("block", pa.int32()), ("names", pa.binary())])


def shared_names(store: BlockStore, names_of: Callable[[str], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(block, names): the names of each block that occur elsewhere too, or that names_of says occur twice in the block.

    names_of(file) gives the block's names, ascending and each once, and for each whether the block holds it twice.
    """
    buckets = buckets_for(store)

    def send(block: int, file: str) -> Iterator[tuple]:
        names, twice = names_of(file)
        for b, part in split_by_bucket(names, bucket_edges(buckets)):
            yield b, block, pack_names(names[part]), np.packbits(twice[part]).tobytes()

    def meet(_: int, rows: list[dict]) -> Iterator[tuple]:
        each = [unpack_names(r["names"]) for r in rows]
        every = np.concatenate(each)
        every.sort()
        many = np.unique(every[1:][every[1:] == every[:-1]])
        for r, names in zip(rows, each, strict=True):
            own = np.unpackbits(np.frombuffer(r["twice"], np.uint8), count=len(names)).astype(bool)
            at = np.searchsorted(many, names)
            met = own if not len(many) else own | (many[np.minimum(at, len(many) - 1)] == names)
            if met.any():
                yield r["block"], pack_names(names[met])

    sent = map_blocks(store, send, SENT, "bucket int, block int, names binary, twice binary")
    return gather_buckets(sent, buckets, meet, SHARED, "block int, names binary")


def joined_names(rows: list[dict]) -> np.ndarray:
    """All names of a block's answers, ascending."""
    parts = [unpack_names(r["names"]) for r in rows]
    return np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def member(names: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which names are in an ascending array."""
    if not len(among):
        return np.zeros(len(names), bool)
    return among[np.minimum(np.searchsorted(among, names), len(among) - 1)] == names
