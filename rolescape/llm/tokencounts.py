"""Token counts without token ids: every distinct pre-token is encoded once, and documents add up their pre-tokens' counts.

A task numbers the pre-tokens it meets, and each of its documents becomes a frequency list over those numbers, written to
one file for each task. The tasks' pre-tokens, each once, are joined to the counts of the distinct ones, and the answers
meet the frequency lists of their file again, which are read in place and not shuffled. A pre-token that every document
has costs one row for each task, never one for each document or occurrence.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolescape.llm.automaton import CHUNK, RARE_SPACE, SPLIT
from rolescape.llm.common import bounded_batches, read_block, texts, written

#: Pre-tokens that a task numbers before it forgets them and numbers anew, from the next number on.
KEPT_PIECES = 600_000
#: Runs between white space that a block keeps split; beyond them, and for longer ones, runs are split each time.
KEPT_RUNS = 400_000
KEPT_LENGTH = 64


class Numbering:
    """The pre-tokens of a task, numbered as they are met; split_special cuts out the special tokens' strings."""

    def __init__(self, pattern, split_special, base: int = 0):
        self.pattern, self.split_special, self.base = pattern, split_special, base
        self.ids: dict[str, int] = {}
        self.runs: dict[str, list[int]] = {}

    def numbers(self, text: str) -> list[int]:
        ids, base = self.ids, self.base
        return [ids.setdefault(p, base + len(ids)) for p in self.pattern.findall(text)]

    def plain(self, text: str) -> list[int]:
        if RARE_SPACE.search(text):
            return self.numbers(text)
        runs, out = self.runs, []
        for run in CHUNK.findall(text):
            found = runs.get(run)
            if found is None:
                found = self.numbers(run)
                if len(run) <= KEPT_LENGTH and len(runs) < KEPT_RUNS:
                    runs[run] = found
            out += found
        return out

    def numbers_of_special(self, token: str) -> list[int]:
        return [self.ids.setdefault(token, self.base + len(self.ids))]

    def frequencies(self, text: str) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """The numbers of a text's pre-tokens, ascending, how often each occurs, and the pre-tokens met here first."""
        before = len(self.ids)
        found: list[int] = []
        for part, special in self.split_special(text):
            found += self.numbers_of_special(part) if special else self.plain(part)
        numbers, times = np.unique(np.array(found, np.int64), return_counts=True)
        return numbers, times, list(islice(reversed(self.ids), len(self.ids) - before))[::-1]


@cache
def special_tokens(vocabulary: str) -> tuple[str, ...]:
    """The special tokens' strings of a byte-level vocabulary file; an error for files whose pre-tokens this module doesn't know."""
    with open(vocabulary, encoding="utf-8") as f:
        said = json.load(f)
    split = said.get("pre_tokenizer") or {}
    if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or said.get("normalizer"):
        raise ValueError(f"{vocabulary}: only byte-level vocabularies without normalizer and added prefix are counted by pre-tokens")
    return tuple(x["content"] for x in said.get("added_tokens", []))


@cache
def library(vocabulary: str):
    """The tokenizers library over a vocabulary file, opened once a worker."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary)
    t.no_truncation()
    t.no_padding()
    return t


def special_splitter(special: Sequence[str]):
    """text -> (part, whether it is a special token's string) in order."""
    if not special:
        return lambda text: [(text, False)]
    cut = re.compile("(" + "|".join(re.escape(x) for x in sorted(special, key=len, reverse=True)) + ")")
    return lambda text: [(part, i % 2 == 1) for i, part in enumerate(cut.split(text)) if part] if any(x in text for x in special) else [(text, False)]


LISTS = "task int, key long, n_bytes long, gaps binary, times binary, first long, pieces array<string>"


def frequency_lists(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """task, key, n_bytes, gaps, times, first, pieces for each row of docs.

    gaps and times are little-endian 32-bit arrays: the ascending numbers of the document's pre-tokens as differences, and
    how often each occurs. pieces are the pre-tokens first met here; their numbers begin with first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        task, pattern, cut = TaskContext.get().partitionId(), regex.compile(SPLIT), special_splitter(special_tokens(vocabulary))
        numbering = Numbering(pattern, cut)
        for batch in batches:
            rows = []
            for k, x in zip(batch.column("key").to_pylist(), texts(batch), strict=True):
                if len(numbering.ids) > KEPT_PIECES:
                    numbering = Numbering(pattern, cut, numbering.base + len(numbering.ids))
                first = numbering.base + len(numbering.ids)
                numbers, times, pieces = numbering.frequencies(x)
                rows.append((task, k, len(x.encode()), np.diff(numbers, prepend=0).astype("<u4").tobytes(), times.astype("<u4").tobytes(), first, pieces))
            if rows:
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["task", "key", "n_bytes", "gaps", "times", "first", "pieces"])

    bounded_batches(docs.sparkSession)
    return docs.select(docs[key].cast("long").alias("key"), docs[text].alias("text")).mapInArrow(run, LISTS)


def piece_counts(pieces: DataFrame, vocabulary: str) -> DataFrame:
    """piece, n: how many tokens the library gives for each distinct pre-token, of a table with a piece in each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = library(vocabulary)
        for batch in batches:
            found = [len(t.encode(p, add_special_tokens=False)) for p in batch.column("piece").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("piece"), pa.array(found, pa.int64())], ["piece", "n"])

    # what else is in the row goes along, so that the join beside it reads the same shuffle
    others = [c for c in pieces.columns if c != "piece"]
    each = pieces.groupBy("piece").agg(*[F.min(c).alias(c) for c in others]) if others else pieces.distinct()
    return each.mapInArrow(run, "piece string, n long")


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_tokens, over_limit for each row of docs.

    A null or empty text has no bytes and no tokens. Null keys are carried through, repeated rows give repeated results,
    texts of any length are counted whole, and an empty table gives an empty result. Special tokens' strings inside a
    text count as the library counts them, one token each. The frequency lists are written to the shared folder once.
    """
    special_tokens(vocabulary)
    lists = written(frequency_lists(docs, vocabulary, key, text), "frequencies")
    met = lists.where(F.size("pieces") > 0).select("task", "first", F.posexplode("pieces").alias("at", "piece"))
    # one shuffle by pre-token serves both the distinct ones and the join
    met = met.select("task", (F.col("first") + F.col("at")).alias("number"), "piece").where("piece IS NOT NULL").repartition("piece")
    answers = met.join(piece_counts(met, vocabulary), "piece").select("task", "number", "n", F.lit(None).cast("string").alias("file"))
    # a row for each file, so that files without any pre-token are read too
    files = lists.select("task", F.col("_metadata.file_path").alias("file")).distinct().select("task", F.lit(0).cast("long").alias("number"), F.lit(0).cast("long").alias("n"), "file")

    def add(found: pa.Table) -> pa.Table:
        number, tokens = found.column("number").to_numpy(), np.zeros(0, np.int64)
        if len(number):
            tokens = np.zeros(int(number.max()) + 1, np.int64)
            # a file's own row has the number 0 and adds nothing to it
            np.add.at(tokens, number, found.column("n").to_numpy())
        out = []
        for file in found.column("file").drop_null().to_pylist():
            for _, batch in read_block(file, ["key", "n_bytes", "gaps", "times"]):
                total = [int(tokens[np.cumsum(np.frombuffer(g, "<u4"), dtype=np.int64)] @ np.frombuffer(t, "<u4").astype(np.int64)) for g, t in zip(batch.column("gaps").to_pylist(), batch.column("times").to_pylist(), strict=True)]
                out.append(pa.table([batch.column("key"), batch.column("n_bytes"), pa.array(total, pa.int64())], [key, "n_bytes", "n_tokens"]))
        return pa.concat_tables(out)

    counted = answers.unionByName(files).groupBy("task").applyInArrow(add, f"{key} long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
