"""Source divergence audit: how far the sources of a language differ in their terms, and by which terms.

Each partition counts its terms in byte radix tries, one for each language, whose leaves hold the documents and the
occurrences by source. The tries' leaves are dealt to ranges of (language, term); a range merges what it gets in tries
again and walks them in UTF-8 order, in blocks of kept terms. Totals of those blocks give every group its probabilities;
a second walk over the blocks adds up the divergence of each pair of sources and streams each group's best terms.

All numbers are integers. Shares p = 1 + floor(SCALE * (count + 1) / (N + V)) are found by long division in steps of
1000, which is exact in 64 bits up to N + V of 9.2e15.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolescape.llm.common import bounded_batches, partitions, written
from rolescape.llm.tries import Trie, edges, from_columns, merge, summed, walk

#: Fixed values of the audit: documents that a kept term is in, the scale of shares, the ranks of terms.
MIN_DOCS = 3
SCALE_STEPS = (1000, 1000, 1000)
TERM_RANKS = 200
#: Occurrences that a partition gathers before they go into its tries, and counters that its tries hold before they are sent.
GATHERED = 2_000_000
HELD = 2_000_000
SENT_LEAVES = 10_000
#: Leaves for each range of the merge, and kept terms in a block; numbers that a block's table of counts holds at a time.
RANGE_LEAVES = 100_000
BLOCK_TERMS = 1024
TABLE_CELLS = 1 << 21

#: A-Z become a-z, other bytes that no term holds become blanks.
FOLD = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def terms_of(raw: bytes) -> list[bytes]:
    """The maximal runs of letters A-Z, a-z and characters beyond ASCII in UTF-8 text, with A-Z lower-cased."""
    return raw.translate(FOLD).split()


class Numbers(dict):
    """term -> its number, given when it is first asked for."""

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


class Gatherer:
    """The occurrences of a language's terms in a partition, by document and source, and the trie of those before."""

    def __init__(self):
        self.names = Numbers()
        self.trie: Trie | None = None
        self.clear()

    def clear(self) -> None:
        self.numbers, self.said, self.source, self.waiting = Numbers(), [], [], 0

    def add(self, source: str, terms: list[bytes]) -> None:
        self.said.append(np.fromiter(map(self.numbers.__getitem__, terms), np.int64, len(terms)))
        self.source.append(self.names[source])
        self.waiting += len(terms)

    def settle(self) -> None:
        """Turns what has been gathered into leaves of the trie."""
        if not self.said:
            return
        lengths, terms, every = [len(x) for x in self.said], len(self.numbers), np.concatenate(self.said)
        of_doc = np.sort(np.repeat(np.arange(len(lengths)), lengths) * terms + every)
        of_doc = of_doc[np.diff(of_doc, prepend=-1) > 0] % terms
        by_source, counts = np.unique(np.repeat(np.array(self.source, np.int64), lengths) * terms + every, return_counts=True)
        new = Trie(pa.array(list(self.numbers), pa.binary()), np.bincount(of_doc, minlength=terms), by_source % terms, by_source // terms, counts, list(self.names))
        self.trie = new if self.trie is None else merge([self.trie, new])
        self.clear()


LEAF = pa.schema([("lang", pa.string()), ("term", pa.binary()), ("docs", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])


def batches_of(rows: Iterator[tuple], schema: pa.Schema, size: int) -> Iterator[pa.RecordBatch]:
    """Rows in batches of at most `size`."""
    for part in iter(lambda: list(islice(rows, size)), []):
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)


def leaves(docs: DataFrame) -> DataFrame:
    """lang, term, docs, sources, counts: the leaves of each partition's tries, of docs with lang, source, raw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages: dict[str, Gatherer] = {}

        def send() -> Iterator[pa.RecordBatch]:
            for lang, g in languages.items():
                g.settle()
                for low in range(0, len(g.trie), SENT_LEAVES):
                    high = min(low + SENT_LEAVES, len(g.trie))
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * (high - low), pa.string()), *g.trie.columns(low, high)], schema=LEAF)
            languages.clear()

        for batch in batches:
            for lang, source, raw in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "raw")), strict=True):
                if terms := terms_of(raw):
                    languages.setdefault(lang, Gatherer()).add(source, terms)
                    if sum(g.waiting for g in languages.values()) > GATHERED:
                        for g in languages.values():
                            g.settle()
                        if sum(len(g.trie.counts) for g in languages.values()) > HELD:
                            yield from send()
        yield from send()

    return docs.mapInArrow(run, "lang string, term binary, docs long, sources array<string>, counts array<long>")


BLOCK = pa.schema([("lang", pa.string()), ("n", pa.int64()), ("depths", pa.list_(pa.int32())), ("labels", pa.list_(pa.binary())), ("places", pa.list_(pa.int32())), ("owners", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64())), ("sources", pa.list_(pa.string())), ("totals", pa.list_(pa.int64()))])


def block_row(lang: str, trie: Trie, kept: np.ndarray) -> tuple:
    """A block of kept leaves as a trie of its own: its edges, the counters as (leaf's place, source's place, count), and
    the sources with their totals."""
    times = trie.starts[kept + 1] - trie.starts[kept]
    places = np.repeat(np.arange(len(kept)), times)
    at = np.repeat(trie.starts[kept] - np.cumsum(times) + times, times) + np.arange(times.sum())
    met, owners = np.unique(trie.source[at], return_inverse=True)
    depths, labels = edges(trie.terms.take(pa.array(kept)).to_pylist())
    return lang, len(kept), depths, labels, places, owners, trie.counts[at], [trie.names[i] for i in met], summed(owners, trie.counts[at], len(met))


def kept_blocks(sent: DataFrame, ranges: int, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, n, depths, labels, places, owners, counts, sources, totals: the merged leaves of min_docs documents or more, in
    blocks. A range of (language, term) is merged in one task; a term comes once from each partition that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches, schema=LEAF).combine_chunks()

        def rows() -> Iterator[tuple]:
            for lang in table.column("lang").unique().to_pylist():
                own = table.filter(pc.equal(table.column("lang"), lang)).combine_chunks()
                trie = from_columns(*(pa.concat_arrays(own.column(c).chunks) for c in ("term", "docs", "sources", "counts")))
                kept = trie.kept(min_docs)
                for low in range(0, len(kept), BLOCK_TERMS):
                    yield block_row(lang, trie, kept[low : low + BLOCK_TERMS])

        yield from batches_of(rows(), BLOCK, 1)

    return sent.repartitionByRange(ranges, "lang", "term").mapInArrow(run, "lang string, n long, depths array<int>, labels array<binary>, places array<int>, owners array<int>, counts array<long>, sources array<string>, totals array<long>")


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * (count + 1) / total), exactly: long division, three decimal digits at a time."""
    out, rest = np.divmod(counts + 1, total)
    for step in SCALE_STEPS:
        digit, rest = np.divmod(rest * step, total)
        out = out * step + digit
    return out + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def block_parts(lang: str, terms: list[bytes], places: np.ndarray, owners: np.ndarray, counts: np.ndarray, own: list[str], sources: list[str], totals: list[int], kept: int, ranks: int = TERM_RANKS) -> Iterator[tuple]:
    """(lang, source, part, item, value) of a block: its share of every pair's sum, and each group's best terms in it.

    sources and totals are all groups of the language and the occurrences of kept terms in each; kept is their number V.
    """
    at = {s: i for i, s in enumerate(sources)}
    column = np.array([at[s] for s in own], np.int64)[owners]
    total = np.array(totals, np.int64) + kept
    of_all = int(sum(totals)) + kept
    sums = np.zeros((len(sources), len(sources)), np.int64)
    best: list[list[tuple[int, int]]] = [[] for _ in sources]
    step = max(1, TABLE_CELLS // max(1, len(sources)))
    for low in range(0, len(terms), step):
        n = min(step, len(terms) - low)
        here = (places >= low) & (places < low + n)
        table = np.zeros((n, len(sources)), np.int64)
        table[places[here] - low, column[here]] = counts[here]
        p = shares(table, total)
        for j in range(len(sources)):
            sums[:, j] += distance(p, p[:, j : j + 1]).sum(0)
        q = shares(table.sum(1), np.int64(of_all))
        for i in range(len(sources)):
            met = np.flatnonzero((table[:, i] > 0) & (p[:, i] > q))
            value = distance(p[met, i], q[met])
            first = np.argsort(-value, kind="stable")[:ranks]
            best[i] = sorted(best[i] + list(zip((-value[first]).tolist(), (met[first] + low).tolist(), strict=True)))[:ranks]
    for i, a in enumerate(sources):
        for j, b in enumerate(sources):
            if i != j:
                yield lang, a, "pair", b, int(sums[i, j])
        for value, term in best[i]:
            yield lang, a, "term", terms[term].decode(), -value


PART = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, ranks: int = TERM_RANKS, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank: every pair of a language's sources, and each source's terms to rank `ranks`.

    Null text, lang and source are read as ''. Each row is a document, so rows that repeat count as often as they occur.
    A group without terms has pairs with the other sources of its language; where no term is kept, their value is 0. Equal
    values are ranked by the item's UTF-8 bytes. Whole texts are counted; an empty table gives an empty result. The leaves
    and the blocks of kept terms are written to the shared folder.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    blank = F.lit("")
    rows = docs.select(F.coalesce(docs[lang], blank).alias("lang"), F.coalesce(docs[source], blank).alias("source"), F.coalesce(docs[text], blank).cast("binary").alias("raw"))

    sent = written(leaves(rows), "leaves")
    blocks = written(kept_blocks(sent, max(partitions(spark), -(-sent.count() // RANGE_LEAVES)), min_docs), "kept-terms")

    groups = rows.select("lang", "source").distinct()
    said = blocks.select("lang", F.explode(F.arrays_zip("sources", "totals")).alias("t")).groupBy("lang", F.col("t.sources").alias("source")).agg(F.sum("t.totals").alias("total"))
    each = written(groups.join(said, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total")), "groups")
    kept = blocks.groupBy("lang").agg(F.sum("n").alias("kept"))
    # one row for each language: its sources in order with their totals
    languages = each.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "total"))).alias("g"))
    languages = languages.join(kept, "lang", "left").select("lang", F.col("g.source").alias("all_sources"), F.col("g.total").alias("all_totals"), F.coalesce("kept", F.lit(0)).alias("kept"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1)
                numbers = [r.column(c).flatten().to_numpy() for c in ("places", "owners", "counts")]
                said = [r.column(c)[0].as_py() for c in ("sources", "all_sources", "all_totals", "kept")]
                terms = list(walk(r.column("depths")[0].as_py(), r.column("labels")[0].as_py()))
                yield from batches_of(block_parts(r.column("lang")[0].as_py(), terms, *numbers, *said, ranks), PART, 10_000)

    parts = written(blocks.drop("n", "totals").join(languages, "lang").mapInArrow(run, "lang string, source string, part string, item string, value long"), "parts")
    # a language without kept terms has no block: its pairs are worth 0
    a, b = each.select("lang", "source"), each.select("lang", F.col("source").alias("item"))
    bare = a.join(b, "lang").where("source <> item").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    summed = parts.where("part = 'pair'").unionByName(bare).groupBy("lang", "source", "part", "item").agg(F.sum("value").cast("long").alias("value"))
    best = parts.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks)
    return summed.withColumn("rank", F.row_number().over(order)).unionByName(best).select("lang", "source", "part", "item", "value", "rank")
