"""Token-id files with Elias-Fano document boundaries.

A shard file holds, in this order: a header, the Elias-Fano index of the documents' keys, the Elias-Fano index of
the documents' starts, and the ids of all documents in a row (two bytes each if the vocabulary allows it, else
four). An Elias-Fano index of n non-decreasing numbers below u keeps their low bits packed, about log2(u/n) each,
and their high parts in unary in a bit vector of at most 3n bits; select on that vector gives any number back.
Select samples every 256th one, so a number is found by reading a few bytes.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolescape.llm.common import bounded_batches, filesystem, partitions, shared_dir, slim, texts
from rolescape.llm.wordpieces import word_pieces

MAGIC = b"RSTOK1\0\0"
HEADER = struct.Struct("<8sIIQQQQqQ")
SAMPLE = 256
END_ID = 1
#: Bytes of ids after which a file ends and the shard goes on in the next one; a longer document stands alone.
FILE_BYTES = 64 << 20


@dataclass(frozen=True)
class EliasFano:
    """n non-decreasing numbers in about n * (2 + log2(u / n)) bits."""

    n: int
    low_bits: int
    low: bytes
    high: bytes
    samples: bytes

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        if not n:
            return cls(0, 0, b"", b"", b"")
        width = max(0, int(v[-1]) // n).bit_length()
        width = max(0, width - 1) if int(v[-1]) // n else 0
        shifts = np.arange(width, dtype=np.uint64)
        low = np.packbits(((v[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little").tobytes() if width else b""
        ones = (v >> np.uint64(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1, np.uint8)
        bits[ones] = 1
        return cls(n, width, low, np.packbits(bits, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u8").tobytes())

    def dump(self) -> bytes:
        return struct.pack("<QQQQQ", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples)) + self.low + self.high + self.samples

    @classmethod
    def load(cls, raw: bytes) -> EliasFano:
        n, width, a, b, c = struct.unpack_from("<QQQQQ", raw)
        return cls(n, width, raw[40 : 40 + a], raw[40 + a : 40 + a + b], raw[40 + a + b : 40 + a + b + c])

    def select(self, i: int) -> int:
        """The i-th number: from the nearest sample, the high vector is read until its i-th one bit."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(np.frombuffer(self.samples, "<u8")[i // SAMPLE])
        byte, skip = at // 8, i % SAMPLE
        word = self.high[byte] & (0xFF << (at % 8)) & 0xFF
        while word.bit_count() <= skip:
            skip -= word.bit_count()
            byte += 1
            word = self.high[byte]
        for _ in range(skip):
            word &= word - 1
        high = byte * 8 + (word & -word).bit_length() - 1 - i
        start = i * self.low_bits
        end = start + self.low_bits
        low = int.from_bytes(self.low[start // 8 : (end + 7) // 8], "little") >> (start % 8) & ((1 << self.low_bits) - 1)
        return high << self.low_bits | low

    def all(self) -> np.ndarray:
        """Every number, as one scan over both parts."""
        if not self.n:
            return np.zeros(0, np.int64)
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)).astype(np.int64) << self.low_bits
        if self.low_bits:
            bits = np.unpackbits(np.frombuffer(self.low, np.uint8), count=self.n * self.low_bits, bitorder="little").reshape(self.n, self.low_bits)
            out |= bits.astype(np.int64) @ (np.int64(1) << np.arange(self.low_bits, dtype=np.int64))
        return out


def file_image(keys: list[int | None], lengths: list[int], ids: bytes, width: int) -> bytes:
    """A shard file: keys ascending with nulls first, lengths in ids, ids as packed numbers of `width` bytes."""
    nulls = sum(k is None for k in keys)
    known = np.array([k for k in keys if k is not None], np.int64)
    base = int(known[0]) if len(known) else 0
    index = EliasFano.build((known - base).astype(np.uint64)).dump()
    starts = EliasFano.build(np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])).dump()
    return HEADER.pack(MAGIC, 1, width, len(keys), nulls, len(index), len(starts), base, len(ids)) + index + starts + ids


class TokenFile:
    """A shard file opened for reading: keys, starts and any document's ids."""

    def __init__(self, raw: bytes):
        magic, version, self.width, self.n, self.nulls, a, b, self.base, size = HEADER.unpack_from(raw)
        if magic != MAGIC or version != 1:
            raise ValueError("not a token file")
        at = HEADER.size
        self.index, self.starts = EliasFano.load(raw[at : at + a]), EliasFano.load(raw[at + a : at + a + b])
        self.ids = np.frombuffer(raw, f"<u{self.width}", count=size // self.width, offset=at + a + b)

    def key(self, i: int) -> int | None:
        return None if i < self.nulls else self.index.select(i - self.nulls) + self.base

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.starts.select(i) : self.starts.select(i + 1)]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """key, start and ids of every document, each number found by select; a document's end is the next one's start."""
        start = self.starts.select(0)
        for i in range(self.n):
            end = self.starts.select(i + 1)
            yield self.key(i), start, self.ids[start:end]
            start = end


def id_ranges(docs: DataFrame, buckets: int, key: str) -> list[int]:
    """Cut points of the key into ranges of about equal rows; reads the key column alone. At most buckets - 1 numbers."""
    wanted = [i / buckets for i in range(1, buckets)]
    if not wanted:
        return []
    found = docs.select(F.percentile_approx(F.col(key).cast("long"), wanted, 20 * buckets).alias("q")).first()["q"]
    return sorted(set(found or []))


def bucket_of(column, cuts: list[int]):
    """The range of a key among ascending cut points, by binary search: 0 for null or below the first."""
    if not cuts:
        return F.lit(0)
    at = F.array(*[F.lit(c).cast("long") for c in cuts])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda low, step: F.when(F.get(at, low + step - 1) <= column, low + step).otherwise(low))


def write_files(docs: DataFrame, vocabulary: str, end_id: int = END_ID, key: str = "doc_id", text: str = "text") -> tuple[str, DataFrame]:
    """Encode docs and write shard files in ascending key order; the folder, and a manifest (file number, documents, ids, file, base).

    base counts the ids of all files before. A shard is a range of keys, in files of about FILE_BYTES, so a task holds
    no more than one of them. A file is written under a name of its own and renamed, so that a task run twice leaves
    one whole file. Null keys come first; repeated keys are ordered by text. Only the manifest, a row for each file,
    is gathered.
    """
    spark = docs.sparkSession
    folder, n = shared_dir(spark, "tokens"), partitions(spark)
    cuts = id_ranges(docs, n, key)
    rows = docs.select(docs[key].cast("long").alias("key"), docs[text].alias("text"))
    rows = rows.withColumn("shard", bucket_of(F.col("key"), cuts))
    dealt = rows.repartitionById(len(cuts) + 1, F.col("shard")).sortWithinPartitions("shard", F.asc_nulls_first("key"), F.asc_nulls_first("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_pieces(vocabulary)
        width = 2 if encoder.library.get_vocab_size() <= 1 << 16 else 4
        end = np.array([end_id], f"<u{width}").tobytes()
        system, path = filesystem(folder)
        shard, part, keys, lengths, ids = None, 0, [], [], bytearray()

        def flush() -> tuple:
            target = f"{path}/shard-{shard:08d}-{part:06d}.tok"
            system.create_dir(path, recursive=True)
            own = f"{target}.{uuid.uuid4().hex}"
            with system.open_output_stream(own) as f:
                f.write(file_image(keys, lengths, bytes(ids), width))
            system.move(own, target)
            return shard, part, len(keys), sum(lengths), target

        done = []
        for batch in batches:
            for s, k, x in zip(batch.column("shard").to_pylist(), batch.column("key").to_pylist(), texts(batch), strict=True):
                if s != shard or len(ids) >= FILE_BYTES:
                    if shard is not None:
                        done.append(flush())
                    shard, part, keys, lengths, ids = s, part + 1 if s == shard else 0, [], [], bytearray()
                raw = encoder.encode(x)
                packed = (raw if width == 4 else np.frombuffer(raw, "<u4").astype("<u2").tobytes()) + end
                keys.append(k)
                lengths.append(len(packed) // width)
                ids += packed
        if shard is not None:
            done.append(flush())
        if done:
            c = list(zip(*done, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(c, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["shard", "part", "documents", "ids", "file"])

    bounded_batches(spark)
    manifest, base = [], 0
    for i, r in enumerate(sorted(dealt.select("shard", "key", "text").mapInArrow(run, "shard int, part int, documents long, ids long, file string").collect())):
        manifest.append((i, r["documents"], r["ids"], r["file"], base))
        base += r["ids"]
    return folder, spark.createDataFrame(manifest, "number int, documents long, ids long, file string, base long")


def read_files(folder: str, manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, start, n_tokens, ids_crc32 of every document in the files; a null key reads back as null, an empty manifest gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = filesystem(folder)
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with system.open_input_file(name) as f:
                    file = TokenFile(f.read())
                found = [(k, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for k, start, ids in file.documents()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], [key, "start", "n_tokens", "ids_crc32"])

    rows = max(1, manifest.count())
    return manifest.select("file", "base", "number").repartitionById(rows, F.col("number")).mapInArrow(run, f"{key} long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, vocabulary: str, end_id: int = END_ID, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write docs as token files and read every document's boundaries and ids back.

    A null or empty text is the end id alone. An empty table writes no file and gives an empty result.
    """
    folder, manifest = write_files(docs, vocabulary, end_id, key, text)
    return read_files(folder, manifest, key)
