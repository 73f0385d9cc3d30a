"""Quality rules: compression bands over whole texts and fixed chunks, on top of a few word counts.

A text that repeats itself compresses far better than prose of its length and noise far worse. The ratio
compressed/raw of prose falls with the length, so the limits depend on it; long texts are also compressed chunk
by chunk, where one repetitive passage in a long clean text shows that the whole-text ratio hides.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rolescape.llm.common import per_batch, slim, texts

SYMBOLS = "#*$%&|<>"
BASE_MIN_WORDS = 50
BASE_MAX_REPEATED_PERCENT = 50


@dataclass(frozen=True)
class Bands:
    """Limits on compressed size / raw size, by raw bytes.

    floor and ceiling: (bytes, ratio) knots, between which the limit is interpolated over log(bytes). A whole text
    outside its band is rejected. A chunk outside the chunk band counts as bad, and a text with more than
    max_bad_chunks of its chunks bad is rejected. A text shorter than the first knot has no band.
    """

    floor: Sequence[tuple[int, float]] = ((100, 0.50), (200, 0.48), (350, 0.475), (500, 0.47), (1000, 0.445), (2000, 0.430), (4000, 0.410), (8000, 0.390), (16000, 0.375), (130000, 0.345))
    ceiling: Sequence[tuple[int, float]] = ((100, 1.25), (200, 1.05), (500, 0.90), (1000, 0.85), (4000, 0.80))
    chunk_bytes: int = 2048
    chunk_floor: float = 0.35
    chunk_ceiling: float = 0.80
    max_bad_chunks: float = 0.25
    level: int = 3

    def limit(self, knots: Sequence[tuple[int, float]], n: int) -> float:
        x, y = zip(*knots, strict=True)
        return float(np.interp(np.log(n), np.log(x), y))


def covered_by_repeats(ids: np.ndarray, width: int = 3) -> int:
    """How many positions lie in a window of `width` ids that occurs at least twice."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    name = ids[:n].astype(np.int64)
    for k in range(1, width):
        # ranks stay below the number of positions, so the product cannot overflow
        _, name = np.unique(name * (int(ids.max()) + 1) + ids[k : k + n], return_inverse=True)
    twice = np.bincount(name)[name] > 1
    mark = np.zeros(len(ids), bool)
    for k in range(width):
        mark[k : k + n] |= twice
    return int(mark.sum())


def word_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    raw = text.encode()
    words = raw.split()
    first: dict[bytes, int] = {}
    ids = np.fromiter((first.setdefault(w, len(first)) for w in words), np.int64, len(words))
    word_chars = len(text) - sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return len(words), word_chars, sum(raw.count(c.encode()) for c in SYMBOLS), len(lines) - len(set(lines)), covered_by_repeats(ids)


def verdict(raw: bytes, bands: Bands, compressor) -> tuple[float, int, int, bool]:
    """ratio of the whole text, chunks, bad chunks, and whether the text lies in its bands."""
    n = len(raw)
    if not n:
        return 0.0, 0, 0, True
    ratio = len(compressor.compress(raw)) / n
    ok = n < bands.floor[0][0] or bands.limit(bands.floor, n) <= ratio <= bands.limit(bands.ceiling, n)
    size = bands.chunk_bytes
    chunks = bad = 0
    if n >= 2 * size:
        for at in range(0, n - size + 1, size):
            r = len(compressor.compress(raw[at : at + size if at + 2 * size <= n else n])) / (size if at + 2 * size <= n else n - at)
            chunks += 1
            bad += not bands.chunk_floor <= r <= bands.chunk_ceiling
    return ratio, chunks, bad, ok and bad <= bands.max_bad_chunks * chunks


def quality_rules(docs: DataFrame, bands: Bands = Bands(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: counts, base_failed, ratio, chunks, bad_chunks, kept.

    A null or empty text has no words and fails the base rule. Null keys and repeated rows are carried through.
    Every text is compressed whole; nothing is cut. There is no shuffle.
    """
    schema = f"{key} long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, chunks long, bad_chunks long"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        import zstandard

        compressor, rows = zstandard.ZstdCompressor(level=bands.level), []
        for x in texts(batch, text):
            counts = word_counts(x)
            failed = counts[0] < BASE_MIN_WORDS or 100 * counts[4] > BASE_MAX_REPEATED_PERCENT * counts[0]
            ratio, chunks, bad, ok = verdict(x.encode(), bands, compressor)
            rows.append((*counts, failed, ok and not failed, ratio, chunks, bad))
        cols = list(zip(*rows, strict=True))
        arrays = [batch.column(key).cast(pa.int64())] + [pa.array(c, pa.int64()) for c in cols[:5]] + [pa.array(c, pa.bool_()) for c in cols[5:7]] + [pa.array(cols[7], pa.float64())] + [pa.array(c, pa.int64()) for c in cols[8:]]
        return pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in schema.split(", ")])

    return per_batch(slim(docs, key, text), run, schema)


def passing(docs: DataFrame, bands: Bands = Bands(), text: str = "text") -> DataFrame:
    """The rows of docs, with all columns, that quality_rules keeps.

    A null or empty text has no words and goes. Null keys and repeated rows are judged by their text alone; an empty
    table gives an empty result.
    """

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        import zstandard

        compressor = zstandard.ZstdCompressor(level=bands.level)

        def ok(x: str) -> bool:
            n, *_, repeated = word_counts(x)
            return n >= BASE_MIN_WORDS and 100 * repeated <= BASE_MAX_REPEATED_PERCENT * n and verdict(x.encode(), bands, compressor)[3]

        yield batch.filter(pa.array([ok(x) for x in texts(batch, text)]))

    return per_batch(docs, run, docs.schema)
