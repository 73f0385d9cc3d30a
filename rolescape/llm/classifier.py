"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters slide over all bytes of a text. Their outputs are max-pooled over chunks of CHUNK bytes that overlap
by half; the mean, the largest and the smallest pooled output of each filter over the chunks are combined by a
logistic layer into one probability. A filter of a byte sequence is a sum of WIDTH table rows, so scoring needs no
matrix product. The network is trained on the driver from a bounded sample of labelled rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolescape.llm.common import per_batch, slim, texts

WIDTH = 6
FILTERS = 24
CHUNK = 512
HALF = CHUNK // 2
#: Labelled rows of each class that training takes at most; rows whose texts are longer than SAMPLE_BYTES are not drawn.
#: Texts are trained on whole. The driver holds 2 * SAMPLE_ROWS * SAMPLE_BYTES at most, about 200 MB.
SAMPLE_ROWS = 1500
SAMPLE_BYTES = 1 << 16
EPOCHS = 6
#: Steps of training at least, however few rows there are.
LEAST_STEPS = 240
SEED = 20240501
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2


def fold(key: int | None) -> int:
    """crc32 of the key as text, modulo FOLDS; a null key counts as empty text."""
    return zlib.crc32(b"" if key is None else str(key).encode()) % FOLDS


@dataclass
class Network:
    """tables: WIDTH x 256 x FILTERS; bias: FILTERS; weights: 3 * FILTERS (mean, largest, smallest); offset: one number."""

    tables: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    offset: float
    trained: bool = False

    @classmethod
    def fresh(cls) -> Network:
        rng = np.random.default_rng(SEED)
        return cls(rng.normal(0, 0.1, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), np.zeros(3 * FILTERS, np.float32), 0.0)

    def halves(self, raw: bytes, places: bool = False):
        """Largest output of each filter in every half chunk; with places, also where it stands."""
        n = max(2, -(-len(raw) // HALF))
        data = np.zeros(n * HALF + WIDTH - 1, np.uint8)
        data[: len(raw)] = np.frombuffer(raw, np.uint8)
        best, at = [], []
        for first in range(0, n, 64):  # a bounded stretch at a time
            size = min(64, n - first) * HALF
            start = first * HALF
            out = self.tables[0][data[start : start + size]]
            for j in range(1, WIDTH):
                out += self.tables[j][data[start + j : start + j + size]]
            out = out.reshape(-1, HALF, FILTERS)
            if places:
                where = out.argmax(axis=1)
                best.append(np.take_along_axis(out, where[:, None], 1)[:, 0])
                at.append(where + start + HALF * np.arange(len(out))[:, None])
            else:
                best.append(out.max(axis=1))
        return (np.concatenate(best), np.concatenate(at), data) if places else np.concatenate(best)

    def features(self, halves: np.ndarray) -> np.ndarray:
        """Pooled chunks' outputs: chunk i is halves i and i + 1."""
        return np.maximum(np.maximum(halves[:-1], halves[1:]) + self.bias, 0)

    def score(self, text: str) -> float:
        c = self.features(self.halves(text.encode()))
        z = float(np.concatenate([c.mean(0), c.max(0), c.min(0)]) @ self.weights) + self.offset
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def train(rows: list[tuple[bytes, int]], epochs: int = EPOCHS) -> Network:
    """A network fitted to (bytes, label) rows by Adam on the logistic loss; without rows, one that says 0.5."""
    net, rng = Network.fresh(), np.random.default_rng(SEED + 1)
    params = [net.tables, net.bias, net.weights, np.zeros(1, np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    if rows:
        net.trained = True
        epochs = max(epochs, -(-LEAST_STEPS // -(-len(rows) // 32)))
        net.weights[:] = rng.normal(0, 0.05, 3 * FILTERS)
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 32):
            grads = [np.zeros_like(p) for p in params]
            part = order[at : at + 32]
            for i in part.tolist():
                raw, y = rows[i]
                halves, where, data = net.halves(raw, places=True)
                upper = halves[1:] > halves[:-1]
                c = net.features(halves)
                top, low = c.argmax(0), c.argmin(0)
                f = np.arange(FILTERS)
                x = np.concatenate([c.mean(0), c[top, f], c[low, f]])
                z = np.clip(float(x @ net.weights) + float(params[3][0]), -30, 30)
                g = (1 / (1 + np.exp(-z)) - y) / len(part)
                grads[2] += g * x
                grads[3] += g
                gx = g * net.weights
                gc = np.repeat(gx[None, :FILTERS] / len(c), len(c), 0)
                gc[top, f] += gx[FILTERS : 2 * FILTERS]
                gc[low, f] += gx[2 * FILTERS :]
                gc *= c > 0
                grads[1] += gc.sum(0)
                place = np.where(upper, where[1:], where[:-1])
                fs = np.broadcast_to(f, place.shape)
                for j in range(WIDTH):
                    np.add.at(grads[0][j], (data[place + j], fs), gc)
            step += 1
            rate = 0.01 * 0.5 ** (3 * epoch / epochs)
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    net.offset = float(params[3][0])
    return net


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, label: str = "quality", key: str = "doc_id", text: str = "text") -> Network:
    """Train on at most `rows` labelled documents of each class outside the held-out fold, each with its whole text.

    The sample is the rows with the smallest hash of their key, without texts longer than SAMPLE_BYTES, so it is the
    same on every run. Its ids are joined to docs as a broadcast of at most 2 * rows numbers. A key with both labels
    teaches neither; a null key or another label is left out; of several texts of a key the smallest counts, and a
    null text is empty. Without any such row (an empty table) the network stays untrained and says 0.5.
    """
    known = labels.select(labels[key].cast("long").alias("k"), labels[label].cast("int").alias("y")).where(F.col("k").isNotNull() & F.col("y").isin(0, 1))
    known = known.where(F.crc32(F.col("k").cast("string").cast("binary")) % FOLDS != HELD_OUT).groupBy("k").agg(F.min("y").alias("y"), F.max("y").alias("other")).where("y = other")
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(rows).select("k", "y")
        chosen = part if chosen is None else chosen.unionByName(part)
    ids = [(r["k"], r["y"]) for r in chosen.collect()]
    if not ids:
        return train([])
    picked = docs.sparkSession.createDataFrame(ids, "k long, y int")
    found = docs.select(docs[key].cast("long").alias("key"), F.coalesce(docs[text], F.lit("")).alias("text")).where(F.octet_length("text") <= SAMPLE_BYTES)
    got = found.join(F.broadcast(picked), F.col("key") == F.col("k")).groupBy("key", "y").agg(F.min("text").alias("text")).collect()
    return train([(r["text"].encode(), r["y"]) for r in sorted(got, key=lambda r: r["key"])])


def classify(docs: DataFrame, net: Network, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score, predicted for each row of docs, from the whole text alone.

    A null or empty text is scored as a stretch of zero bytes. Null keys and repeated rows are kept; an empty table
    gives an empty result. There is no shuffle.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = batch.column(key).cast(pa.int64())
        scores = [net.score(x) for x in texts(batch, text)]
        return pa.RecordBatch.from_arrays([keys, pa.array([fold(k) == HELD_OUT for k in keys.to_pylist()]), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], [key, "held_out", "score", "predicted"])

    return per_batch(slim(docs, key, text), run, f"{key} long, held_out boolean, score double, predicted int")


def good(docs: DataFrame, net: Network, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of docs, with all columns, that the network predicts to be good; one without training rejects nothing.

    A null or empty text is scored like any other; repeated rows and null keys are judged by their text alone; an
    empty table gives an empty result.
    """
    if not net.trained:
        return docs

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield batch.filter(pa.array([net.score(x) >= threshold for x in texts(batch, text)]))

    return per_batch(docs, run, docs.schema)
