"""Ranked lexical search: the k best documents of every query text, exactly, by a threshold-seeded join.

An impact is what one occurrence pattern of a term adds to a document's score, before the term's weight. For every query
term the k highest impacts are stored with their documents. The k-th of them times the term's weight is a lower bound of
a query's k-th score; exact scores of the documents stored for a query's best terms raise it. With the bound, a query's
terms are ordered by the most they can add: as long as the sum of the smallest ones stays below the bound, a document
that has only these cannot be among the k best. Documents that hold one of the other terms are candidates; those whose
partial score and the bound of the rest reach the threshold are scored exactly.

Queries are taken up in blocks of about QUERY_BYTES of text, so what is sent to every task has a bound; the documents,
of which an index is written for each block, are never collected.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rolescape.llm.common import bounded_batches, written

#: Bytes of query text in a block.
QUERY_BYTES = 1 << 20
#: Terms of a query, those with the highest k-th impacts, whose stored documents are scored to raise its threshold.
SEED_TERMS = 8
#: Partial scores (document and query) and added numbers that are held at a time; impacts gathered before they are cut to k.
CELLS = 1 << 21
GATHERED = 1 << 20
#: Sums below this are exact in doubles.
EXACT = 1 << 53

#: A-Z become a-z, other bytes that no term holds become blanks.
FOLD = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A or 0x30 <= b <= 0x39 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def terms_of(raw: bytes) -> list[bytes]:
    """The maximal runs of digits, letters A-Z, a-z and characters beyond ASCII, with A-Z lower-cased."""
    return raw.translate(FOLD).split()


def length_norm(n: np.ndarray, documents: int, words: int) -> np.ndarray:
    """10 + floor(90 * n * documents / words) of documents of n words, exactly."""
    if 90 * int(n.max(initial=0)) * documents < 1 << 62:
        return 10 + 90 * n * documents // words
    return np.array([10 + 90 * int(x) * documents // words for x in n], np.int64)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) if df else 0


class Queries:
    """A block of queries: their distinct terms, and which query has which."""

    def __init__(self, texts: list[bytes]):
        self.n = len(texts)
        self.vocabulary: dict[bytes, int] = {}
        own = [sorted({self.vocabulary.setdefault(t, len(self.vocabulary)) for t in terms_of(x)}) for x in texts]
        self.query = np.repeat(np.arange(self.n), [len(x) for x in own])
        self.term = np.array([t for x in own for t in x], np.int64)


class Plan:
    """For given thresholds, each query's essential terms, by term, and its other terms, by query."""

    def __init__(self, queries: Queries, weights: np.ndarray, highest: np.ndarray, thresholds: np.ndarray):
        n, terms = queries.n, len(queries.vocabulary)
        self.n, self.weights, self.thresholds = n, weights, thresholds
        bound = weights[queries.term] * highest[queries.term]
        order = np.lexsort((bound, queries.query))
        query, term, bound = queries.query[order], queries.term[order], bound[order]
        total = np.cumsum(bound)
        first = np.searchsorted(query, np.arange(n))
        before = np.where(first > 0, total[np.maximum(first - 1, 0)], 0) if len(total) else np.zeros(n, np.int64)
        upto = total - before[query]
        rest = upto < thresholds[query]
        #: what a query's terms that are no candidates' reason can add together
        self.rest = np.zeros(n, np.int64)
        np.maximum.at(self.rest, query[rest], upto[rest])
        by_term = np.argsort(term[~rest], kind="stable")
        self.queries = query[~rest][by_term]
        self.starts = np.searchsorted(term[~rest][by_term], np.arange(terms + 1))
        self.others = np.split(term[rest], np.searchsorted(query[rest], np.arange(1, n))) if n else []
        self.exact = int(upto.max(initial=0)) < EXACT

    def scores(self, lengths: np.ndarray, ids: np.ndarray, added: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(document's place, query, score) of all documents whose score reaches the query's threshold.

        lengths are the documents' numbers of terms; ids and added are their terms and what each adds, one after the other.
        """
        upto = np.concatenate([[0], np.cumsum(lengths)])
        reach = np.concatenate([[0], np.cumsum(self.starts[ids + 1] - self.starts[ids])])
        table = np.zeros(len(self.starts) - 1, np.int64)
        low = 0
        while low < len(lengths):
            # as many documents as fit the table of partial scores and the list of additions, one at least
            high = min(low + max(1, CELLS // max(1, self.n)), int(np.searchsorted(reach[upto], reach[upto[low]] + CELLS, side="right")) - 1, len(lengths))
            high = max(high, low + 1)
            own, extra = ids[upto[low] : upto[high]], added[upto[low] : upto[high]]
            times = self.starts[own + 1] - self.starts[own]
            ends = np.cumsum(times)
            if len(ends) and ends[-1]:
                places = np.repeat(np.repeat(np.arange(high - low), lengths[low:high]), times)
                at = np.arange(ends[-1]) - np.repeat(ends - times, times) + np.repeat(self.starts[own], times)
                cells = places * self.n + self.queries[at]
                if self.exact:
                    partial = np.bincount(cells, np.repeat(extra, times).astype(np.float64), (high - low) * self.n).astype(np.int64)
                else:
                    partial = np.zeros((high - low) * self.n, np.int64)
                    np.add.at(partial, cells, np.repeat(extra, times))
                met = np.flatnonzero(partial)
                met = met[partial[met] + self.rest[met % self.n] >= self.thresholds[met % self.n]]
                doc = -1
                for cell in met.tolist():
                    d, q = divmod(cell, self.n)
                    if d != doc:
                        if doc >= 0:
                            table[ids[upto[low + doc] : upto[low + doc + 1]]] = 0
                        doc = d
                        table[ids[upto[low + d] : upto[low + d + 1]]] = added[upto[low + d] : upto[low + d + 1]]
                    score = int(partial[cell]) + int(table[self.others[q]].sum())
                    if score >= self.thresholds[q]:
                        yield low + d, q, score
                if doc >= 0:
                    table[ids[upto[low + doc] : upto[low + doc + 1]]] = 0
            low = high


def index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """row, doc_id, n, ids, tfs of the documents that have a term at all, of docs with doc_id, raw: the query terms in
    each as little-endian 32-bit arrays, ascending, with how often each occurs; n counts all its terms."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, row = sent.value, TaskContext.get().partitionId() << 33
        for batch in batches:
            rows = []
            for k, raw in zip(batch.column("doc_id").to_pylist(), batch.column("raw").to_pylist(), strict=True):
                terms = terms_of(raw)
                row += 1
                if terms:
                    ids, tfs = np.unique(np.array([known[t] for t in terms if t in known], np.uint32), return_counts=True)
                    rows.append((row, k, len(terms), ids.astype("<u4").tobytes(), tfs.astype("<u4").tobytes()))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["row", "doc_id", "n", "ids", "tfs"])

    return docs.mapInArrow(run, "row long, doc_id long, n long, ids binary, tfs binary")


def flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """n and number of query terms of each document; ids and tfs one after the other."""
    ids, tfs = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").astype(np.int64) for c in ("ids", "tfs"))
    lengths = np.array([len(x) // 4 for x in batch.column("ids").to_pylist()], np.int64)
    return batch.column("n").to_numpy(), lengths, ids, tfs


def term_documents(found: DataFrame, terms: int) -> tuple[int, int, np.ndarray]:
    """Documents and words in all, and documents of each query term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows, words = np.zeros(terms, np.int64), 0, 0
        for batch in batches:
            n, _, ids, _ = flat(batch)
            df += np.bincount(ids, minlength=terms)
            rows, words = rows + len(n), words + int(n.sum())
        met = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *met.tolist()], pa.int64()), pa.array([rows, words, *df[met].tolist()], pa.int64())], ["id", "n"])

    # a row for each query term, and two
    got = {r["id"]: r["n"] for r in found.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()}
    df = np.zeros(terms, np.int64)
    for i, n in got.items():
        if i >= 0:
            df[i] = n
    return got.get(-2, 0), got.get(-1, 0), df


def highest_impacts(found: DataFrame, documents: int, words: int, k: int) -> DataFrame:
    """id, impact, row: the k highest impacts of each query term and the documents they come from."""

    def cut(parts: list[np.ndarray]) -> list[np.ndarray]:
        every = np.concatenate(parts, axis=1)
        every = every[:, np.lexsort((every[2], -every[1], every[0]))]
        start = np.searchsorted(every[0], every[0])
        return [every[:, np.arange(every.shape[1]) - start < k]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [np.zeros((3, 0), np.int64)], 0
        for batch in batches:
            n, lengths, ids, tfs = flat(batch)
            parts.append(np.stack([ids, impacts(tfs, np.repeat(length_norm(n, documents, words), lengths)), np.repeat(batch.column("row").to_numpy(), lengths)]))
            size += len(ids)
            if size > GATHERED:
                parts, size = cut(parts), 0
        best = cut(parts)[0]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in best], ["id", "impact", "row"])

    order = Window.partitionBy("id").orderBy(F.desc("impact"), "row")
    each = found.mapInArrow(run, "id long, impact long, row long")
    return each.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k).drop("nth")


def reaching(found: DataFrame, plan: Plan, documents: int, words: int, k: int) -> DataFrame:
    """query, row, doc_id, score: each query's k best documents that reach its threshold, ranked by score and doc_id."""
    sent = found.sparkSession.sparkContext.broadcast(plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Plan = sent.value
        best: dict[int, list[tuple]] = {}
        for batch in batches:
            n, lengths, ids, tfs = flat(batch)
            added = p.weights[ids] * impacts(tfs, np.repeat(length_norm(n, documents, words), lengths))
            keys, rows = batch.column("doc_id").to_pylist(), batch.column("row").to_pylist()
            for d, q, score in p.scores(lengths, ids, added):
                own = best.setdefault(q, [])
                own.append((-score, keys[d] is None, keys[d] or 0, rows[d], keys[d]))
                if len(own) >= 4 * k:
                    own.sort()
                    del own[k:]
        out = [(q, r, key, -score) for q, own in best.items() for score, _, _, r, key in sorted(own)[:k]]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out, strict=True)], ["query", "row", "doc_id", "score"])

    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    each = found.mapInArrow(run, "query long, row long, doc_id long, score long")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, texts: list[bytes], k: int) -> DataFrame:
    """query, doc_id, score, rank of the k best documents, of docs with doc_id, raw, for a block of queries."""
    spark, queries = docs.sparkSession, Queries(texts)
    found = written(index(docs, queries.vocabulary), "term-index")
    documents, words, df = term_documents(found, len(queries.vocabulary))
    weights = np.array([weight(documents, int(n)) for n in df], np.int64)
    stored = written(highest_impacts(found, documents, words, k), "high-impacts")
    highest, kth = np.zeros(len(weights), np.int64), np.zeros(len(weights), np.int64)
    # a row for each query term
    for r in stored.groupBy("id").agg(F.max("impact").alias("highest"), F.when(F.count("*") >= k, F.min("impact")).otherwise(0).alias("kth")).collect():
        highest[r["id"]], kth[r["id"]] = r["highest"], r["kth"]

    seeds = weights[queries.term] * kth[queries.term]
    thresholds = np.zeros(queries.n, np.int64)
    np.maximum.at(thresholds, queries.query, seeds)
    order = np.lexsort((-seeds, queries.query))
    nth = np.arange(len(order)) - np.searchsorted(queries.query[order], queries.query[order])
    best = np.unique(queries.term[order][nth < SEED_TERMS])
    if len(best):
        rows = stored.join(spark.createDataFrame([(int(i),) for i in best], "id long"), "id").select("row").distinct()
        met = found.join(rows, "row", "left_semi")
        for r in reaching(met, Plan(queries, weights, highest, thresholds), documents, words, k).where(F.col("rank") == k).select("query", "score").collect():
            thresholds[r["query"]] = max(int(thresholds[r["query"]]), r["score"])
    # a score of 0 is no match, so at least 1 is asked for
    return reaching(found, Plan(queries, weights, highest, np.maximum(thresholds, 1)), documents, words, k).select("query", "doc_id", "score", "rank")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """item, rank, key, score: for each row of items its k best rows of docs with a score above 0.

    Equal scores are ranked by ascending key, null keys last. Null or empty texts have no terms: such documents count
    nowhere, such items have no rows. Repeated rows of docs are documents of their own, repeated rows of items are ranked
    each. Whole texts are searched; where either table is empty, so is the result. The items are taken up in blocks of about
    query_bytes of text (an item of any length is in one block); the documents are read once for each block.
    """
    spark: SparkSession = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(docs[key].cast("long").alias("doc_id"), F.coalesce(docs[text], F.lit("")).cast("binary").alias("raw"))
    wanted = written(items.select(items[item].alias("item"), F.coalesce(items[item_text], F.lit("")).cast("binary").alias("raw")), "queries")
    wanted = written(wanted.withColumn("at", F.monotonically_increasing_id()), "numbered-queries")
    size = wanted.agg(F.coalesce(F.sum(F.octet_length("raw")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-size // query_bytes))

    def block(b: int) -> DataFrame:
        # a block of bounded size; its texts go to every task
        own = wanted.where(F.pmod(F.xxhash64("at"), F.lit(blocks)) == b).orderBy("at").select("at", "raw").collect()
        if not any(terms_of(bytes(r["raw"])) for r in own):
            return none
        numbers = spark.createDataFrame([(i, r["at"]) for i, r in enumerate(own)], "query long, at long")
        return search(rows, [bytes(r["raw"]) for r in own], k).join(numbers, "query").drop("query")

    none = spark.createDataFrame([], "doc_id long, score long, rank int, at long")
    add: Callable[[DataFrame, DataFrame], DataFrame] = lambda a, b: a.unionByName(b)
    hits = reduce(add, [block(b) for b in range(blocks)])
    return hits.join(wanted.select("at", "item"), "at").select(F.col("item").alias(item), "rank", F.col("doc_id").alias(key), "score")
