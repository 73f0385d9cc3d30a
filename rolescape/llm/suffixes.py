"""Removal of byte strings that an earlier document holds too, by bucket-pointer refinement of suffixes.

A string of WIDTH bytes that starts in a document with a smaller key is removed from a document. Suffixes that can
share such a string are brought together first: every window of WIDTH bytes names its anchor, the least hashed
GRAM-gram in it (the leftmost on ties), so equal windows have equal anchors at the same place. Blocks exchange the
names of their anchors (exchange.py), and only windows around anchors that occur elsewhere, or twice, go on; equal
stretches of a block go once, with their smallest and largest key.

In a bucket the stretches' suffixes are sorted by refinement. They begin in buckets of their first eight bytes; a
bucket is refined by sorting on the bucket identifiers of the suffixes eight bytes on, which makes it exact for
sixteen, then by the identifiers so updated sixteen on, and so forth up to WIDTH; only suffixes that still share their
bucket are sorted again. Suffixes that stand in one bucket then share WIDTH bytes, and the bucket's smallest key
decides for all of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rolescape.llm.common import BlockStore, read_block, shared_dir
from rolescape.llm.exchange import answer_blocks, bucket_edges, buckets_for, expand, gather_buckets, joined_names, member, shared_names, split_by_bucket, squeeze

WIDTH = 50
GRAM = 20
#: Bytes of stretches that are sorted at a time; stretches of one anchor stay together.
SORTED_BYTES = 1 << 21
LAST = np.iinfo(np.int64).max
PLACE_BITS = np.uint64(28)
#: Windows whose anchors are found at a time: few enough for a core's cache, and below 2 ** PLACE_BITS.
PART = 1 << 15


def words_at(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 8 and the 4 bytes that start at each position, as numbers (zeros beyond the end)."""
    a = np.concatenate([data, np.zeros(8, np.uint8)])
    two = a[:-1].astype(np.uint16) | a[1:].astype(np.uint16) << np.uint16(8)
    four = two[:-2].astype(np.uint32) | two[2:].astype(np.uint32) << np.uint32(16)
    eight = four[:-4].astype(np.uint64) | four[4:].astype(np.uint64) << np.uint64(32)
    return eight[: len(data)], four[: len(data)]


def gram_names(data: np.ndarray) -> np.ndarray:
    """A 64-bit name of the GRAM bytes at each position that has so many after it."""
    eight, four = words_at(data)
    n = max(0, len(data) - GRAM + 1)
    with np.errstate(over="ignore"):
        x = eight[:n] * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        x = (x + eight[8 : n + 8]) * np.uint64(0xC2B2AE3D27D4EB4F)
        x ^= x >> np.uint64(29)
        x = (x + four[16 : n + 16]) * np.uint64(0x165667B19E3779F9)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
    return x


def runs_of(data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """name, place, first window, last window of every anchor of the windows of data that `inside` marks; places have PLACE_BITS."""
    names = gram_names(data)
    place = np.arange(len(names), dtype=np.uint64)
    least = names >> PLACE_BITS << PLACE_BITS | place
    wide, span = 1, WIDTH - GRAM + 1
    while 2 * wide <= span:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    if wide < span:
        least = np.minimum(least[: len(least) - (span - wide)], least[span - wide :])
    windows = np.flatnonzero(inside)
    at = (least[windows] & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (windows[1:] != windows[:-1] + 1)])[: len(at)])
    last = np.concatenate([first[1:], [len(windows)]])[: len(first)] - 1
    return names[at[first]], at[first], windows[first], windows[last]


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """name, first window, last window of every anchor, in order, of documents that stand in a row in data and end at `ends`.

    Windows are taken in parts of PART at most, which overlap by the bytes of a window. A window's anchor depends on
    its bytes alone, so the parts change nothing, and places are counted in a part: data may have any length.
    """
    none = np.zeros(0, np.int64)
    if len(data) < WIDTH:
        return none.astype(np.uint64), none, none
    inside = np.ones(len(data) - WIDTH + 1, bool)
    for e in ends[:-1].tolist():
        inside[max(0, e - WIDTH + 1) : e] = False
    step = min(PART, (1 << int(PLACE_BITS)) - WIDTH)
    parts = []
    for a in range(0, len(inside), step):
        name, *places = runs_of(data[a : a + step + WIDTH - 1], inside[a : a + step])
        parts.append((name, *(x + a for x in places)))
    name, at, first, last = (np.concatenate(x) for x in zip(*parts, strict=True))
    # an anchor whose windows go on in the next part is one
    begins = np.concatenate([[True], (at[1:] != at[:-1]) | (first[1:] != last[:-1] + 1)])[: len(at)]
    name, first, last = name[begins], first[begins], last[np.concatenate([begins[1:], [True]])[: len(at)]]
    # anchors are the least of their windows' names; mixed again they spread evenly over the buckets
    with np.errstate(over="ignore"):
        spread = name * np.uint64(0x9E3779B97F4A7C15)
        spread = (spread ^ (spread >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return spread ^ (spread >> np.uint64(29)), first, last


def refined(data: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Bucket of the suffix at each position: equal ones share their first `width` bytes (zeros follow the end).

    A bucket's identifier is the place where it begins among the sorted suffixes, so that splitting one leaves all
    others as they are. Suffixes that stand alone are done with; the others are sorted on their bucket and the bucket
    of the suffix as many bytes on as buckets are deep, and the identifiers so updated serve the next pass.
    """
    eight, _ = words_at(data)
    order = np.argsort(eight)
    new = np.concatenate([[True], eight[order[1:]] != eight[order[:-1]]])[: len(order)]
    starts = np.flatnonzero(new)
    size = np.diff(starts, append=len(order))
    bucket = np.empty(len(data), np.int64)
    bucket[order] = np.repeat(starts, size)
    open_, depth = order[np.repeat(size > 1, size)], min(8, width)
    while depth < width and len(open_):
        step = min(depth, width - depth)
        on = open_ + step
        behind = np.where(on < len(data), bucket[np.minimum(on, len(data) - 1)] + 1, 0)
        # identifiers are below the number of positions, so the pair fits in 64 bits
        pair = bucket[open_] * np.int64(len(data) + 1) + behind
        order = np.argsort(pair, kind="stable")
        open_, pair = open_[order], pair[order]
        starts = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        size = np.diff(starts, append=len(pair))
        # a part of a bucket begins as far behind the bucket's place as members stand before it
        was = bucket[open_[starts]]
        head = np.flatnonzero(np.concatenate([[True], was[1:] != was[:-1]]))
        begins = was + starts - np.repeat(starts[head], np.diff(head, append=len(was)))
        bucket[open_] = np.repeat(begins, size)
        open_ = open_[np.repeat(size > 1, size)]
        depth += step
    return bucket


def batches_of(file: str, key: str, text: str, columns: list[str] | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(batch, keys, bytes of its texts in a row, their ends)."""
    for _, batch in read_block(file, columns, text=text):
        raw = [("" if x is None else x).encode() for x in batch.column(text).to_pylist()]
        keys = np.array([LAST if k is None else k for k in batch.column(key).to_pylist()], np.int64)
        yield batch, keys, np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(x) for x in raw], dtype=np.int64)


STRETCHES = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("stretches", pa.binary())])
VERDICTS = pa.schema([("block", pa.int32()), ("verdicts", pa.binary())])


def stretches(file: str, shared: np.ndarray, key: str, text: str) -> dict[tuple[int, bytes], list[int]]:
    """(anchor's name, bytes of its windows) -> [smallest key, largest key], of a block's anchors with a shared name."""
    found: dict[tuple[int, bytes], list[int]] = {}
    for _, keys, data, ends in batches_of(file, key, text, [key, text]):
        names, first, last = anchors(data, ends)
        use = member(names, shared)
        raw = data.tobytes()
        owner = keys[np.searchsorted(ends, first[use], side="right")]
        for name, a, b, k in zip(names[use].tolist(), first[use].tolist(), (last[use] + WIDTH).tolist(), owner.tolist(), strict=True):
            have = found.setdefault((name, raw[a:b]), [k, k])
            if k < have[0]:
                have[0] = k
            elif k > have[1]:
                have[1] = k
    return found


def verdicts_of_bucket(rows: list[dict]) -> Iterator[tuple]:
    """For each block, the stretches with a window that a smaller key has: name, hash, and each window's smallest key."""
    sent = []
    for r in rows:
        names, sizes, data, low, high = expand(r["stretches"])
        sizes = np.frombuffer(sizes, "<u2").astype(np.int64)
        names = np.frombuffer(names, "<u8")
        sent.append((r["block"], names.tolist(), names, np.concatenate([[0], np.cumsum(sizes)]).tolist(), data, np.frombuffer(high, "<i8"), np.frombuffer(low, "<i8").tolist()))
    every = np.sort(np.concatenate([x[2] for x in sent]))
    total = sum(len(x[4]) for x in sent)
    cuts = every[np.linspace(0, len(every), max(1, total // SORTED_BYTES) + 1).astype(int)[1:-1]] if len(every) else every
    places = [np.concatenate([[0], np.searchsorted(x[2], cuts), [len(x[1])]]) for x in sent]
    out: dict[int, list[list]] = {}
    for part in range(len(cuts) + 1):
        unique: dict[bytes, int] = {}
        low: list[int] = []
        named: list[int] = []
        for x, place in zip(sent, places, strict=True):
            ends, least_key, own = x[3], x[6], x[1]
            for i in range(place[part], place[part + 1]):
                j = unique.setdefault(x[4][ends[i] : ends[i + 1]], len(low))
                if j == len(low):
                    low.append(least_key[i])
                    named.append(own[i])
                elif least_key[i] < low[j]:
                    low[j] = least_key[i]
        if not unique:
            continue
        sizes = np.array([len(p) - WIDTH + 1 for p in unique], np.int64)
        at = np.concatenate([[0], np.cumsum(sizes)])
        least = np.repeat(np.array(low, np.int64), sizes)
        # equal windows have one anchor: where all pieces of a name are equal there is nothing to sort
        _, of, n = np.unique(np.array(named, np.uint64), return_inverse=True, return_counts=True)
        several = np.flatnonzero(n[of] > 1)
        if len(several):
            pieces = list(unique)
            data = np.frombuffer(b"".join(pieces[j] for j in several.tolist()), np.uint8)
            count = sizes[several]
            begins = np.cumsum(count + WIDTH - 1) - (count + WIDTH - 1)
            inner = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            bucket = refined(data)[np.repeat(begins, count) + inner]
            own = np.repeat(at[several], count) + inner
            smallest = np.full(len(data), LAST, np.int64)
            np.minimum.at(smallest, bucket, least[own])
            least[own] = smallest[bucket]
        smallest = np.minimum.reduceat(least, at[:-1]).tolist()
        at = at.tolist()
        for x, place in zip(sent, places, strict=True):
            ends, high = x[3], x[5].tolist()
            for i in range(place[part], place[part + 1]):
                j = unique[x[4][ends[i] : ends[i + 1]]]
                if smallest[j] < high[i]:
                    out.setdefault(x[0], []).append((x[1][i], x[4][ends[i] : ends[i + 1]], least[at[j] : at[j + 1]]))
    for block, found in out.items():
        yield block, squeeze(np.array([f[0] for f in found], "<u8").tobytes(), np.array([xxhash.xxh64_intdigest(f[1]) for f in found], "<u8").tobytes(), np.array([len(f[2]) for f in found], "<u2").tobytes(), np.concatenate([f[2] for f in found]).astype("<i8").tobytes())


def covered(data: np.ndarray, ends: np.ndarray, keys: np.ndarray, names: np.ndarray, verdicts: dict[tuple[int, int], np.ndarray]) -> np.ndarray:
    """Which bytes of the documents in a row are to be removed."""
    change = np.zeros(len(data) + 1, np.int32)
    if len(names):
        found, first, last = anchors(data, ends)
        use = member(found, names)
        owner = keys[np.searchsorted(ends, first[use], side="right")]
        raw = data.tobytes()
        for name, a, b, k in zip(found[use].tolist(), first[use].tolist(), last[use].tolist(), owner.tolist(), strict=True):
            m = verdicts.get((name, xxhash.xxh64_intdigest(raw[a : b + WIDTH])))
            if m is not None:
                hit = np.flatnonzero(m < k)
                if len(hit):
                    if hit[-1] - hit[0] == len(hit) - 1:
                        change[a + hit[0]] += 1
                        change[a + hit[-1] + WIDTH] -= 1
                    else:
                        np.add.at(change, a + hit, 1)
                        np.add.at(change, a + hit + WIDTH, -1)
    return np.cumsum(change[:-1]) > 0


def removal(docs: DataFrame, digest: bool, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Digest rows (key, n_bytes, n_removed, n_spans, kept_sha256), or docs with the remaining text in place of the text.

    Strings are judged on the input. Copies of a key count as one document; a null key counts as larger than every
    other and as one document. A null or empty text, and one shorter than WIDTH bytes, loses nothing; a null stays
    null. Where a removal cuts a character, the rest of its bytes is dropped from the text (the digest has the bytes
    as they are). An empty table gives an empty result.
    """
    spark = docs.sparkSession
    store = BlockStore.write(docs.select(docs[key].cast("long").alias(key), docs[text]) if digest else docs, "suffix-blocks")
    buckets = buckets_for(store)

    def names_of(file: str) -> tuple[np.ndarray, np.ndarray]:
        parts = [anchors(data, ends)[0] for _, _, data, ends in batches_of(file, key, text, [key, text])]
        names, n = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint64), return_counts=True)
        return names, n > 1

    def send(block: int, file: str, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        found = sorted(stretches(file, joined_names(rows), key, text).items(), key=lambda x: x[0][0])
        names = np.array([k[0] for k, _ in found], np.uint64)
        for b, part in split_by_bucket(names, bucket_edges(buckets)):
            own = found[part]
            parts = (names[part].astype("<u8").tobytes(), np.array([len(k[1]) for k, _ in own], "<u2").tobytes(), b"".join(k[1] for k, _ in own), np.array([v[0] for _, v in own], "<i8").tobytes(), np.array([v[1] for _, v in own], "<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([block], pa.int32()), pa.array([squeeze(*parts)], pa.binary())], schema=STRETCHES)

    sent = answer_blocks(store, shared_names(store, names_of), send, "bucket int, block int, stretches binary")
    verdicts = gather_buckets(sent, buckets, lambda _, rows: verdicts_of_bucket(rows), VERDICTS, "block int, verdicts binary")

    schema = T.StructType([T.StructField(key, T.LongType()), *[T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")], T.StructField("kept_sha256", T.StringType())]) if digest else docs.schema
    names_out = schema.names

    def apply(_: int, file: str, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        table: dict[tuple[int, int], np.ndarray] = {}
        for r in rows:
            names, hashes, sizes, least = expand(r["verdicts"])
            ends, least = np.cumsum(np.frombuffer(sizes, "<u2"), dtype=np.int64), np.frombuffer(least, "<i8")
            for name, h, a, b in zip(np.frombuffer(names, "<u8").tolist(), np.frombuffer(hashes, "<u8").tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                table[name, h] = least[a:b]
        wanted = np.unique(np.array([k[0] for k in table], np.uint64))
        for batch, keys, data, ends in batches_of(file, key, text):
            gone = covered(data, ends, keys, wanted, table)
            # a run ends with its document
            begins = gone & ~np.concatenate([[False], gone[:-1]])
            starts = np.concatenate([[0], ends[:-1]])
            inner = starts[starts < len(gone)]
            begins[inner] = gone[inner]
            removed, spans = (np.concatenate([[0], np.cumsum(x)]) for x in (gone, begins))
            kept = [data[a:b][~gone[a:b]].tobytes() if removed[b] > removed[a] else data[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            if digest:
                sha = [hashlib.sha256(x).hexdigest() for x in kept]
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(ends - starts), pa.array(removed[ends] - removed[starts]), pa.array(spans[ends] - spans[starts]), pa.array(sha)], names_out)
            else:
                was = batch.column(text).to_pylist()
                now = [x if len(raw) == b - a else raw.decode("utf-8", errors="ignore") for x, raw, a, b in zip(was, kept, starts.tolist(), ends.tolist(), strict=True)]
                at = names_out.index(text)
                yield pa.RecordBatch.from_arrays([pa.array(now, batch.schema.field(text).type) if i == at else batch.column(n) for i, n in enumerate(names_out)], names_out)

    # written once: the last stage reads it for every block
    path = shared_dir(spark, "suffix-verdicts")
    verdicts.write.parquet(path)
    return answer_blocks(store, spark.read.schema(verdicts.schema).parquet(path), apply, schema, every=True)


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs; see removal()."""
    return removal(docs, True, key, text)


def clean(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the remaining text of each row in place of its text; see removal().

    Every row stays, repeated ones and those with a null key too; a null text stays null, and one that is removed
    whole becomes empty. An empty table gives an empty result.
    """
    return removal(docs, False, key, text)
