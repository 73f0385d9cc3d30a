"""Document fingerprints from prefix polynomial hashes.

A text's prefix array holds, for every position i, the sum of c[j] * x^j over the code points before i, modulo a
31-bit prime (two of them). From it any span's hash is one subtraction and one product, two spans are equal when
their hashes are, and the longest common extension of two positions is found by binary search over its length.

The fingerprint takes every span of SPAN code points, or of fewer in a text that is shorter than three of them: those
whose (mixed) hash is smallest are kept, KEPT at most, and with them the hash of the whole text. Two fingerprints of
one span width estimate the share of spans that two texts have in common from the smallest hashes of their union;
equal texts have equal fingerprints. Texts of different widths are compared by spans of the shorter text's width.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolescape.llm.common import bounded_batches, partitions, texts
from rolescape.llm.tokenfile import bucket_of, id_ranges

PRIMES = (2147483647, 2147483629)
BASES = (1000003937, 1600000111)
SPAN = 24
#: Span widths; a text has the first that it holds three times, else single code points.
WIDTHS = (SPAN, 8, 2)
KEPT = 64


def span_width(n: int) -> int:
    """The span width for a text of n code points."""
    return next((w for w in WIDTHS if n >= 3 * w), 1)


@lru_cache(maxsize=4)
def powers(base: int, prime: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo prime, by doubling."""
    out = np.ones(n, np.uint64)
    have, step = 1, base % prime
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(step) % np.uint64(prime)
        have += more
        step = step * step % prime
    return out


def room(n: int) -> int:
    """Lengths of power tables: powers of two, so that few are ever built."""
    return 1 << max(12, n.bit_length())


class Prefixes:
    """Prefix hashes of a text's code points."""

    def __init__(self, text: str):
        self.text = text
        self.n = len(text)
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.sums = []
        for base, prime in zip(BASES, PRIMES, strict=True):
            terms = codes * powers(base, prime, room(self.n))[: self.n] % np.uint64(prime)
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms) % np.uint64(prime)]))

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit names of spans, the same for equal spans wherever they stand."""
        names = []
        for (base, prime), s in zip(zip(BASES, PRIMES, strict=True), self.sums, strict=True):
            back = powers(pow(base, -1, prime), prime, room(self.n))
            names.append((s[end] + np.uint64(prime) - s[start]) % np.uint64(prime) * back[start] % np.uint64(prime))
        return names[0] << np.uint64(32) | names[1]

    def span(self, start: int, end: int) -> int:
        return int(self.spans(np.array([start]), np.array([end]))[0])

    def equal(self, i: int, other: Prefixes, j: int, length: int) -> bool:
        """Whether two spans of a length are equal; spans beyond an end are not."""
        return i + length <= self.n and j + length <= other.n and self.span(i, i + length) == other.span(j, j + length)

    def common_extension(self, i: int, other: Prefixes, j: int) -> int:
        """Length of the longest common extension to the right of position i here and j there."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.equal(i, other, j, mid) else (low, mid - 1)
        return low

    def sketch(self, width: int | None = None) -> np.ndarray:
        """The KEPT smallest mixed names of the text's spans of a width (by default its own), ascending; an empty text has none."""
        if not self.n:
            return np.zeros(0, np.uint64)
        width = min(width or span_width(self.n), self.n)
        start = np.arange(self.n - width + 1)
        names = self.spans(start, start + width)
        with np.errstate(over="ignore"):
            names = (names ^ (names >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        names ^= names >> np.uint64(29)
        near = 4 * KEPT  # a text that repeats itself needs more of its smallest names for KEPT different ones
        while True:
            found = np.unique(names if near >= len(names) else np.partition(names, near)[:near])
            if len(found) >= KEPT or near >= len(names):
                return found[:KEPT]
            near *= 8


def whole(p: Prefixes) -> str:
    return f"{p.n:x}-{p.span(0, p.n):016x}"


def fingerprint(p: Prefixes) -> tuple[str, np.ndarray]:
    """The fingerprint as text (the whole text's hash, then the sketch), and its sketch."""
    sketch = p.sketch()
    return f"{whole(p)}:" + "".join(f"{x:016x}" for x in sketch.tolist()), sketch


def parse(text: str) -> tuple[str, np.ndarray]:
    head, _, rest = text.partition(":")
    return head, np.array([int(rest[i : i + 16], 16) for i in range(0, len(rest), 16)], np.uint64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of spans in common, from two sketches; two empty ones are alike."""
    if not len(a) and not len(b):
        return 1.0
    union = np.union1d(a, b)[:KEPT]
    return float(np.isin(union, np.intersect1d(a, b)).sum() / len(union))


def alike(p: Prefixes, sketch_p: np.ndarray, q: Prefixes, sketch_q: np.ndarray) -> float:
    """likeness() of two texts, given their own sketches, by spans of the shorter text's width."""
    width = span_width(min(p.n, q.n))
    return likeness(*[own if span_width(x.n) == width else x.sketch(width) for x, own in ((p, sketch_p), (q, sketch_q))])


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as many of the first code points of another (or all it has)."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third] if third else text


def neighbours(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(bucket, own, doc_id, text): rows dealt by ranges of the key, each range led in from the next lower one.

    Sorted by bucket and descending doc_id, a row's next document is the one after it; a bucket's last row is a copy
    (own = false) of the first of the next lower bucket, or after the lowest, of the first of all. Repeated keys are
    ordered by text, null keys come last. One shuffle of the texts, and one copied row for each bucket.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[key].cast("long").alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text"))
    cuts = id_ranges(docs, 4 * partitions(spark), key)
    at = rows.withColumn("bucket", bucket_of(F.col("doc_id"), cuts))
    # the first of each bucket by (doc_id, hash of the text), found from the id column and then from few rows
    tops = [r for r in at.select("bucket", "doc_id").groupBy("bucket").agg(F.max("doc_id").alias("top")).orderBy("bucket").collect()]
    if not tops:
        return at.select("bucket", F.lit(True).alias("own"), "doc_id", "text")
    lead = {r["bucket"]: tops[(i + 1) % len(tops)]["bucket"] for i, r in enumerate(tops)}
    top_of = {r["bucket"]: r["top"] for r in tops}
    pairs = spark.createDataFrame([(b, top_of[b], to) for b, to in lead.items()], "b int, top long, to int")
    # one row for each bucket: bounded by the number of buckets
    is_top = (at["bucket"] == pairs["b"]) & at["doc_id"].eqNullSafe(pairs["top"])
    first = at.join(F.broadcast(pairs), is_top).withColumn("nth", F.row_number().over(Window.partitionBy("b").orderBy(F.desc("text"))))
    copies = first.where("nth = 1").select(F.col("to").alias("bucket"), F.lit(False).alias("own"), "doc_id", "text")
    return at.select("bucket", F.lit(True).alias("own"), "doc_id", "text").unionByName(copies)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, kept_prefix for each row.

    kept_prefix is the longest common extension of the text and its edited text from their starts. A null text is
    empty: its fingerprint is that of no spans, and its edited text is itself. A table of one row is followed by
    itself. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    # buckets are numbered from 0, so each gets a task of its own
    dealt = neighbours(docs, key, text).repartitionById(4 * partitions(spark), F.col("bucket")).sortWithinPartitions("bucket", F.desc("own"), F.desc_nulls_last("doc_id"), F.desc("text"))
    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "kept_prefix"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        for batch in batches:
            rows = []
            for bucket, own, k, x in zip(batch.column("bucket").to_pylist(), batch.column("own").to_pylist(), batch.column("doc_id").to_pylist(), texts(batch), strict=True):
                p = Prefixes(x)
                mark, sketch = fingerprint(p)
                if last and last[0] == bucket:
                    _, k0, p0, mark0, sketch0 = last
                    new = edited(p0.text, x)
                    e = Prefixes(new)
                    mark_e, sketch_e = fingerprint(e)
                    rows.append((k0, p0.n, hashlib.sha256(new.encode()).hexdigest(), mark0, mark_e, alike(p0, sketch0, e, sketch_e), alike(p0, sketch0, p, sketch), p0.common_extension(0, e, 0)))
                last = (bucket, k, p, mark, sketch) if own else None
            if rows:
                c = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), *(pa.array(x, pa.string()) for x in c[2:5]), pa.array(c[5]), pa.array(c[6]), pa.array(c[7], pa.int64())], names)

    bounded_batches(spark)
    return dealt.select("bucket", "own", "doc_id", "text").mapInArrow(run, f"{key} long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, kept_prefix long")
