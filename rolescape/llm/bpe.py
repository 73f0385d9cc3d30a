"""BPE encoding and decoding of a table of texts through the tokenization automaton."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from rolescape.llm.automaton import codec
from rolescape.llm.common import per_batch, slim, texts


def encode(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids for each row of docs; a null or empty text has no ids. Null keys and repeated rows are kept."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(vocabulary)
        return pa.RecordBatch.from_arrays([batch.column(key).cast(pa.int64()), pa.array([c.encode(x) for x in texts(batch, text)], pa.list_(pa.int32()))], [key, "ids"])

    return per_batch(slim(docs, key, text), run, f"{key} long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str, key: str = "doc_id") -> DataFrame:
    """key, text for rows of key, ids; null ids decode to the empty text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(vocabulary)
        return pa.RecordBatch.from_arrays([batch.column(key).cast(pa.int64()), pa.array([c.decode(x or ()) for x in batch.column("ids").to_pylist()], pa.string())], [key, "text"])

    return per_batch(slim(encoded, key, "ids"), run, f"{key} long, text string")


def digests(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256: the ids and the text decoded from them, as digests.

    The ids stay in the worker between encoding and decoding. Nulls and empty texts have no ids; a null key stays
    null; repeated rows give repeated results; an empty table gives an empty result. There is no shuffle.
    """

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        c, rows = codec(vocabulary), []
        decimal = c.decimal.__getitem__
        for x in texts(batch, text):
            ids = c.encode(x)
            rows.append((len(ids), hashlib.sha256(",".join(map(decimal, ids)).encode()).hexdigest(), hashlib.sha256(c.decode(ids).encode()).hexdigest()))
        n, a, b = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([batch.column(key).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return per_batch(slim(docs, key, text), run, f"{key} long, n_tokens long, ids_sha256 string, decoded_sha256 string")
