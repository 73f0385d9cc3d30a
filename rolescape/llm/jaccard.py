"""N-gram Jaccard join by parity sketches.

A document's set holds the 64-bit hashes of its distinct five-word shingles. Sets of a and b shingles with Jaccard
similarity of at least 0.8 differ in at most (a + b) / 9 shingles. Sizes are dealt into bands, each a quarter wider
than the one before, so linked sets lie in one band or in neighbours, and each set takes part in its own band and
the next. In a band, shingles are dealt by hash into more segments than a linked pair can differ in, and each
segment is the XOR of its shingles' hashes: by the pigeonhole principle linked sets agree in a segment. Spare
segments let a set leave out those with few shingles, which many unrelated sets share. A segment's name has 48 bits;
names meet only within a band, and a name that two segments share by chance costs comparisons, never a link.

Sets that agree in a segment are compared by parity sketches, in which each shingle flips one bit: their Hamming
distance never exceeds the number of differing shingles. Pairs that pass are verified on the sets themselves. Equal
sets are known by a digest of 128 bits over their shingle hashes and stand for one; in a block only their first goes on.

No group is expanded into pairs. A first round takes of each set the few smallest of its shared names alone and pairs
the members of their groups with one of them, first within each block, which sends on at most FEW members of a name;
verified links become components. Names whose sets then all lie in one component are done with. A second round takes
of each set few of the other names and pairs it, in each group, with the nearest member of another component: a
family that the stars have left in parts grows together by as many pairs as it has members. The third round is the
exact one: the groups of the names that still have several components give all pairs of different components whose
sketches pass. A pair left out is in one component already. A group of more than HOT sets is cut into chunks, and
each two chunks meet in a task of their own, so no task holds more than 2 * HOT sets of a name.
In the later rounds the names whose sets have the same smallest component go to the same bucket, so that a family meets
in few places and each of its pairs comes up few times; a component with many entries is spread over several.
Blocks exchange only names that occur elsewhere (exchange.py); sets travel for pairs alone, and of the links that a
block verifies only those go on that connect something.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolescape.llm.common import BlockStore, read_block, shared_dir
from rolescape.llm.exchange import answer_blocks, bucket_edges, buckets_for, expand, gather_buckets, joined_names, member, pack_names, shared_names, split_by_bucket, squeeze, unpack_names

SHINGLE = 5
#: A link needs 100 * intersection >= PERCENT * union; the bounds below (a quarter, a ninth) follow from 80.
PERCENT = 80
#: Bytes of a word up to which words are hashed together, eight bytes at a time.
TOGETHER = 256
WORD_BYTE = np.ones(256, bool)
WORD_BYTE[[9, 10, 11, 12, 13, 32]] = False
LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
ROW_BITS = 32
ROWS = (1 << ROW_BITS) - 1
NO_KEY = LAST = np.iinfo(np.int64).max
#: Names of a set that the first and the second round take, and members of a name that a block sends on in the first.
FIRST_NAMES = 4
NEAR_NAMES = 8
FEW = 4
#: Sets of a name that later rounds compare in one task; more are cut into chunks of as many.
HOT = 8192
#: Entries of later rounds that names with the same smallest component bring to one bucket, about.
FAMILY = 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the texts' words with A-Z lower-cased, all in a row, and the number of words of each text."""
    raw = [x.encode().lower() if x else b"" for x in texts]
    joined = b" ".join([b"", *raw, b"       "])
    data = np.frombuffer(joined, np.uint8)
    inside = WORD_BYTE[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    eight = np.ndarray((max(0, len(data) - 7),), "<u8", joined, 0, (1,))
    size = ends - starts
    h = size.astype(np.uint64)
    which, left, at = np.arange(len(starts)), size, starts
    for _ in range(TOGETHER // 8):
        h[which] = mix(h[which] * np.uint64(0x9E3779B97F4A7C15) ^ eight[at] & LOW_BYTES[np.minimum(left, 8)])
        on = left > 8
        if not on.any():
            break
        which, left, at = which[on], left[on] - 8, at[on] + 8
    for i in np.flatnonzero(size > TOGETHER).tolist():
        h[i] = xxhash.xxh64_intdigest(joined[starts[i] : ends[i]])
    upto = np.searchsorted(starts, np.cumsum([len(x) + 1 for x in raw]) + 1)
    return h, np.diff(upto, prepend=0)


def rolled(w: np.ndarray, k: int) -> np.ndarray:
    """The hash of every k word hashes in a row."""
    n = len(w) - k + 1
    h = np.full(n, k, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            h *= np.uint64(0x9E3779B97F4A7C15)
            h += w[i : i + n]
    return mix(h)


def shingle_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The sets of texts, one after the other, each ascending, and their sizes.

    A set holds the hashes of the distinct shingles; with fewer words, of the whole sequence; without words, none.
    """
    w, n = word_hashes(texts)
    size = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    first = np.concatenate([[0], np.cumsum(n)])[:-1]
    starts, ends = np.cumsum(size) - size, np.cumsum(size)
    h = rolled(np.concatenate([w, np.zeros(SHINGLE - 1, np.uint64)]), SHINGLE)
    h = h[np.repeat(first - starts, size) + np.arange(int(size.sum()))]
    for i in np.flatnonzero((n > 0) & (n < SHINGLE)).tolist():
        h[starts[i]] = rolled(w[first[i] : first[i] + n[i]], int(n[i]))[0]
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        h[a:b].sort()
    fresh = np.ones(len(h), bool)
    fresh[1:] = h[1:] != h[:-1]
    fresh[starts[size > 0]] = True
    upto = np.concatenate([[0], np.cumsum(fresh)])
    return h[fresh], upto[ends] - upto[starts]


def shingle_set(text: str | None) -> np.ndarray:
    """Ascending hashes of one text's distinct shingles."""
    return shingle_sets([text])[0]


def each_set(hashes: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    ends = np.cumsum(sizes)
    for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
        yield hashes[a:b]


@lru_cache(maxsize=4096)
def band_start(b: int) -> int:
    """Smallest size of a band: each starts a quarter above the one before."""
    return 1 if b == 0 else max(band_start(b - 1) + 1, band_start(b - 1) * 5 // 4)


_STARTS = np.array([band_start(b) for b in range(100)], np.int64)


def bands_of(sizes: np.ndarray) -> np.ndarray:
    """The band of each size (sizes are below the start of the hundredth band, 4 * 10 ** 9)."""
    return np.searchsorted(_STARTS, sizes, side="right") - 1


@lru_cache(maxsize=4096)
def shape(b: int) -> tuple[int, int, int, int]:
    """Segments of a band, spare ones among them, and bits of its parity sketches in the first round and in later ones."""
    largest = band_start(b + 1) - 1
    differ = 2 * largest // 9
    spare = -(-differ * 3 // 20)
    return differ + 1 + spare, spare, 64 * min(64, max(4, -(-largest // 32))), 64 * min(256, max(8, -(-largest // 8)))


def segment_names(hashes: np.ndarray, sizes: np.ndarray, bands: np.ndarray, mixed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(names, owners): the names under which each of the sets stands in its band of `bands`, one for each segment it
    doesn't leave out. Sets must not be empty."""
    mixed = mix(hashes) if mixed is None else mixed
    known, which = np.unique(bands, return_inverse=True)
    segments, spare = (np.array([shape(b)[i] for b in known.tolist()], np.int64)[which] for i in (0, 1))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    # sets ascend, so a segment's shingles stand in a row
    at = (hashes >> np.uint64(32)) * segments.astype(np.uint64)[owner] >> np.uint64(32)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    held = np.diff(first, append=len(at))
    owner, at = owner[first], at[first]
    x = np.bitwise_xor.reduceat(mixed, first) if len(first) else mixed[:0]
    empty = segments - np.bincount(owner, minlength=len(sizes))
    single = np.bincount(owner[held == 1], minlength=len(sizes))
    use = ~((empty + single <= spare)[owner] & (held == 1))
    owner, at, x = owner[use], at[use], x[use]
    # a set with more empty segments than spare ones leaves out none
    for i in np.flatnonzero(empty > spare).tolist():
        none = np.setdiff1d(np.arange(segments[i], dtype=np.uint64), at[owner == i])
        owner, at, x = np.concatenate([owner, np.full(len(none), i)]), np.concatenate([at, none]), np.concatenate([x, np.zeros(len(none), np.uint64)])
    with np.errstate(over="ignore"):
        salt = mix((bands.astype(np.uint64) << np.uint64(32))[owner] + at + np.uint64(1))
        # the high 48 bits do, and travel in less space
        return mix(x + salt) >> np.uint64(16) << np.uint64(16), owner


def names_in_bands(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(names, owners, steps): the sets' names in their own band (step 0) and the next (step 1)."""
    bands, mixed = bands_of(sizes), mix(hashes)
    own, following = segment_names(hashes, sizes, bands, mixed), segment_names(hashes, sizes, bands + 1, mixed)
    return np.concatenate([own[0], following[0]]), np.concatenate([own[1], following[1]]), np.repeat(np.array([0, 1], np.uint8), [len(own[0]), len(following[0])])


def sketch(h: np.ndarray, b: int, later: bool = False) -> bytes:
    """The parity sketch of a set in a band: each shingle flips one bit."""
    bits = shape(b)[3 if later else 2]
    return np.packbits(np.bincount((mix(h + np.uint64(b + 1)) % np.uint64(bits)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def block_sets(file: str, key: str, text: str, rows: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, list, np.ndarray, np.ndarray]]:
    """(rows, keys, sets, sizes) of stretches of a block's documents, of all or of certain rows (ascending)."""
    for first, batch in read_block(file, [key, text], text=text):
        own = np.arange(batch.num_rows)
        if rows is not None:
            own = rows[np.searchsorted(rows, first) : np.searchsorted(rows, first + batch.num_rows)] - first
            if not len(own):
                continue
            batch = batch.take(pa.array(own))
        yield own + first, batch.column(key).to_pylist(), *shingle_sets(batch.column(text).to_pylist())


def set_by_set(file: str, key: str, text: str, rows: np.ndarray) -> Iterator[tuple[int, int | None, np.ndarray]]:
    """(row, key, set) of certain rows of a block."""
    for own, keys, hashes, sizes in block_sets(file, key, text, np.sort(rows)):
        yield from zip(own.tolist(), keys, each_set(hashes, sizes), strict=True)


def digests(hashes: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    return [xxhash.xxh3_128_digest(h) for h in each_set(hashes, sizes)]


def first_sets(hashes: np.ndarray, sizes: np.ndarray, seen: set[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(places, sets, sizes, digests of all): of the sets that are not empty, those not seen before."""
    marks = digests(hashes, sizes)
    use = np.zeros(len(sizes), bool)
    for i, mark in enumerate(marks):
        if sizes[i] and mark not in seen:
            seen.add(mark)
            use[i] = True
    return np.flatnonzero(use), hashes[np.repeat(use, sizes)], sizes[use], marks


def names_of_block(file: str, key: str, text: str) -> tuple[np.ndarray, np.ndarray]:
    seen: set[bytes] = set()
    parts = [np.zeros(0, np.uint64)]
    for _, _, hashes, sizes in block_sets(file, key, text):
        _, hashes, sizes, _ = first_sets(hashes, sizes, seen)
        parts.append(names_in_bands(hashes, sizes)[0])
    names = np.sort(np.concatenate(parts))
    first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]])[: len(names)])
    return names[first], np.diff(first, append=len(names)) > 1


SIDE = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("groups", pa.binary()), ("pairs", pa.binary()), ("side", pa.binary())])
SIDE_DDL = "bucket int, block int, groups binary, pairs binary, side binary"
GROUPS_DDL = "bucket int, block int, groups binary, pairs binary"


def least_names(names: np.ndarray, owners: np.ndarray, few: int) -> np.ndarray:
    """Which entries are of the `few` smallest (mixed) names of their owner, as ascending places."""
    if not len(names):
        return np.zeros(0, np.int64)
    order = np.lexsort((mix(names), owners))
    o = owners[order]
    start = np.maximum.accumulate(np.where(np.concatenate([[True], o[1:] != o[:-1]]), np.arange(len(o)), 0))
    return np.sort(order[np.arange(len(o)) - start < few])


def side_table(block: int, file: str, shared: np.ndarray, buckets: int, key: str, text: str) -> Iterator[pa.RecordBatch]:
    """What later rounds need of a block (key and size of each set, and which shared names the first of equal sets has),
    and its part in the first round: entries of FIRST_NAMES names of each set, and the pairs within the block."""
    seen: set[bytes] = set()
    keys, sizes, marks = [], [np.zeros(0, np.int64)], []
    names, owners, steps = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)]
    drawn: dict[tuple[int, int], bytes] = {}
    for rows, own_keys, hashes, own_sizes in block_sets(file, key, text):
        keys += [NO_KEY if k is None else k for k in own_keys]
        sizes.append(own_sizes)
        at, hashes, own_sizes, own_marks = first_sets(hashes, own_sizes, seen)
        marks += own_marks
        name, owner, step = names_in_bands(hashes, own_sizes)
        met = member(name, shared)
        name, owner, step = name[met], owner[met], step[met]
        names.append(name)
        owners.append(rows[at[owner]])
        steps.append(step)
        few = least_names(name, owner, FIRST_NAMES)
        ends = np.cumsum(own_sizes)
        bands = bands_of(own_sizes)
        for x in np.unique(owner[few] << np.int64(1) | step[few]).tolist():
            i, b = x >> 1, int(bands[x >> 1]) + (x & 1)
            drawn[int(rows[at[i]]), b] = sketch(hashes[ends[i] - own_sizes[i] : ends[i]], b)
    n, o, s = (np.concatenate(x) for x in (names, owners, steps))
    order = np.argsort(n, kind="stable")
    n, o, s, sizes = n[order], o[order], s[order], np.concatenate(sizes)
    blob = squeeze(np.array(keys, "<i8").tobytes(), sizes.astype("<u4").tobytes(), pack_names(n), o.astype("<u4").tobytes(), s.tobytes())
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int32()), pa.array([block], pa.int32()), pa.array([None], pa.binary()), pa.array([None], pa.binary()), pa.array([blob], pa.binary())], schema=SIDE)
    for r in first_groups(Side(block, blob), np.frombuffer(b"".join(marks), "V16"), drawn, buckets):
        yield pa.RecordBatch.from_arrays([*r.columns, pa.nulls(len(r), pa.binary())], schema=SIDE)


class Side:
    """A block's side table, opened; names ascend, owners are the rows that have them, bands those in which they do."""

    def __init__(self, block: int, blob: bytes):
        keys, sizes, names, owners, steps = expand(blob)
        self.block = block
        self.keys, self.sizes = np.frombuffer(keys, "<i8"), np.frombuffer(sizes, "<u4").astype(np.int64)
        self.owners = np.frombuffer(owners, "<u4").astype(np.int64)
        self.names = unpack_names(names)
        self.bands = bands_of(self.sizes)[self.owners] + np.frombuffer(steps, np.uint8)

    def place(self, rows: np.ndarray) -> np.ndarray:
        return (np.int64(self.block) << np.int64(ROW_BITS)) + rows


def roots_by_row(rows: list[dict], side: Side) -> np.ndarray:
    """The root of each row of a block: its own place where it has no link yet."""
    out = side.place(np.arange(len(side.keys), dtype=np.int64))
    for r in rows:
        if r["roots"] is not None:
            nodes, own = (np.frombuffer(x, "<i8") for x in expand(r["roots"]))
            out[nodes & ROWS] = own
    return out


PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("equal", pa.bool_())])
GROUPS = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("groups", pa.binary()), ("pairs", pa.binary())])


def pair_batch(a: np.ndarray, b: np.ndarray, equal: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(a, np.int64)), pa.array(np.asarray(b, np.int64)), pa.array(np.full(len(a), equal))], schema=PAIRS)


def bucket_of(names: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket that a name's high bits choose."""
    return np.searchsorted(bucket_edges(buckets), names, side="right")


def group_blobs(side: Side, names: np.ndarray, owners: np.ndarray, bands: np.ndarray, to: np.ndarray, roots: np.ndarray | None, marks: np.ndarray | None, sketches: dict[tuple[int, int], bytes]) -> Iterator[pa.RecordBatch]:
    """A block's entries for each bucket of `to`: ascending names with the row, size, band and sketch of their sets, and
    their roots or (in the first round) their digests."""
    order = np.lexsort((names, to))
    cuts = cut_groups(to[order])
    for first, last in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        part = order[first:last]
        b = int(to[part[0]])
        used, local = np.unique(bands[part] << np.int64(ROW_BITS) | owners[part], return_inverse=True)
        rows, band = used & ROWS, used >> ROW_BITS
        blob = squeeze(
            pack_names(names[part]), local.astype("<u4").tobytes(), rows.astype("<u4").tobytes(), side.sizes[rows].astype("<u4").tobytes(), band.astype("<u2").tobytes(),
            b"" if roots is None else roots[rows].astype("<i8").tobytes(), b"" if marks is None else marks[rows].tobytes(), b"".join(sketches[k] for k in zip(rows.tolist(), band.tolist(), strict=True)),
        )
        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([side.block], pa.int32()), pa.array([blob], pa.binary()), pa.array([None], pa.binary())], schema=GROUPS)


def cut_groups(*columns: np.ndarray) -> np.ndarray:
    """Where rows begin that differ from the one before in any column, and the end."""
    n = len(columns[0])
    new = np.ones(n + 1, bool)
    if n:
        new[1:-1] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new) if n else np.zeros(1, np.int64)


def first_groups(side: Side, marks: np.ndarray, drawn: dict[tuple[int, int], bytes], buckets: int) -> Iterator[pa.RecordBatch]:
    """A block's part in the first round."""
    # the first row of the block with an equal set; empty sets are equal to none
    lead = np.arange(len(side.keys))
    full = np.flatnonzero(side.sizes > 0)
    _, first, which = np.unique(marks[full], return_index=True, return_inverse=True)
    lead[full] = full[first[which]]
    copies = np.flatnonzero(lead != np.arange(len(lead)))
    pairs = [pair_batch(side.place(lead[copies]), side.place(copies), True)]
    use = least_names(side.names, side.owners, FIRST_NAMES)
    use = use[np.lexsort((side.bands[use], side.names[use]))]
    names, owners, bands = side.names[use], side.owners[use], side.bands[use]
    cuts = cut_groups(names, bands)
    goes = np.ones(len(use), bool)
    for i in np.flatnonzero(np.diff(cuts) > FEW).tolist():
        a, b = cuts[i], cuts[i + 1]
        group = np.unique(owners[a:b])
        sk = np.frombuffer(b"".join(drawn[r, int(bands[a])] for r in group.tolist()), np.uint64).reshape(len(group), -1)
        middle, members = star(side.sizes[group], sk)
        goes[a:b] = False
        goes[a + int(np.flatnonzero(owners[a:b] == group[middle])[0])] = True
        pairs.append(pair_batch(side.place(np.minimum(group[middle], group[members])), side.place(np.maximum(group[middle], group[members])), False))
    found = pa.Table.from_batches(pairs)
    if len(found):
        found = found.group_by(["a", "b"]).aggregate([("equal", "max")]).rename_columns(PAIRS.names).combine_chunks()
        blob = squeeze(found.to_batches()[0].serialize().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array([side.block % buckets], pa.int32()), pa.array([side.block], pa.int32()), pa.array([None], pa.binary()), pa.array([blob], pa.binary())], schema=GROUPS)
    yield from group_blobs(side, names[goes], owners[goes], bands[goes], bucket_of(names[goes], buckets), None, marks, drawn)


NAMED = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("named", pa.binary())])


def named_roots(side: Side, roots: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """For each bucket, a block's names with the smallest and largest root among their sets, and their number."""
    if not len(side.names):
        return
    own = roots[side.owners]
    cuts = cut_groups(side.names)
    first = cuts[:-1]
    names, low, high, n = side.names[first], np.minimum.reduceat(own, first), np.maximum.reduceat(own, first), np.diff(cuts)
    for b, part in split_by_bucket(names, bucket_edges(buckets)):
        blob = squeeze(pack_names(names[part]), low[part].astype("<i8").tobytes(), high[part].astype("<i8").tobytes(), n[part].astype("<u4").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([side.block], pa.int32()), pa.array([blob], pa.binary())], schema=NAMED)


OPEN = pa.schema([("block", pa.int32()), ("names", pa.binary())])


def open_names(rows: list[dict], buckets: int) -> Iterator[tuple]:
    """(block, names) of those whose sets have more than one root, with the number of chunks (0: not cut), of the sets
    that earlier blocks have, and the bucket where they meet."""
    rows = sorted(rows, key=lambda r: r["block"])
    parts = [expand(r["named"]) for r in rows]
    each = [unpack_names(p[0]) for p in parts]
    names = np.concatenate(each)
    low, high = (np.concatenate([np.frombuffer(p[i], "<i8") for p in parts]) for i in (1, 2))
    n = np.concatenate([np.frombuffer(p[3], "<u4") for p in parts]).astype(np.int64)
    order = np.argsort(names, kind="stable")
    cuts = cut_groups(names[order])
    first, size = cuts[:-1], np.diff(cuts)
    least = np.minimum.reduceat(low[order], first)
    split = least != np.maximum.reduceat(high[order], first)
    total = np.add.reduceat(n[order], first)
    before = np.cumsum(n[order]) - n[order]
    # a bucket sees an even share of a component's names, and so how many entries it has in all
    _, home = np.unique(least, return_inverse=True)
    spread = 1 + (np.bincount(home, weights=total * split)[home] * buckets).astype(np.uint64) // np.uint64(FAMILY)
    with np.errstate(over="ignore"):
        to = bucket_of(mix(least.astype(np.uint64) + np.uint64(1) + mix(names[order][first]) % spread * np.uint64(0x9E3779B97F4A7C15)), buckets)
    chunks, offset, opened, bucket = (np.empty(len(names), np.int64) for _ in range(4))
    opened[order], bucket[order] = np.repeat(split, size), np.repeat(to, size)
    chunks[order] = np.repeat(np.where(total > HOT, -(-total // HOT), 0), size)
    offset[order] = before - np.repeat(before[first], size)
    ends = np.cumsum([len(x) for x in each])
    for r, own, b in zip(rows, each, ends.tolist(), strict=True):
        part = slice(b - len(own), b)
        met = opened[part] > 0
        if met.any():
            yield r["block"], squeeze(pack_names(own[met]), chunks[part][met].astype("<u4").tobytes(), offset[part][met].astype("<i8").tobytes(), bucket[part][met].astype("<u4").tobytes())


def chunked(names: np.ndarray, wanted: np.ndarray, chunks: np.ndarray, offset: np.ndarray, bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which, names, buckets): entries of ascending names by number, those of a cut name once for every chunk that theirs
    meets, each time under another name in the bucket of that."""
    at = np.searchsorted(wanted, names)
    plain = chunks[at] == 0
    which, out, to = [np.flatnonzero(plain)], [names[plain]], [bucket[at[plain]]]
    for i in np.flatnonzero(chunks).tolist():
        a, b = np.searchsorted(names, wanted[i]), np.searchsorted(names, wanted[i], side="right")
        own = (offset[i] + np.arange(b - a)) // HOT
        for other in range(int(chunks[i])):
            with np.errstate(over="ignore"):
                met = np.minimum(own, other) * chunks[i] + np.maximum(own, other)
                out.append(mix(wanted[i] + mix(met.astype(np.uint64) + np.uint64(1))) >> np.uint64(16) << np.uint64(16))
            to.append(bucket_of(out[-1], buckets))
            which.append(np.arange(a, b))
    return np.concatenate(which), np.concatenate(out), np.concatenate(to)


def later_groups(side: Side, file: str, roots: np.ndarray, answers: list[bytes], few: int | None, buckets: int, key: str, text: str) -> Iterator[pa.RecordBatch]:
    """Entries of the names with several roots, of all or of few for each set, with the sketches of their sets."""
    parts = [expand(x) for x in answers]
    wanted = np.concatenate([unpack_names(p[0]) for p in parts])
    chunks, offset, bucket = (np.concatenate([np.frombuffer(p[i], kind) for p in parts]).astype(np.int64) for i, kind in ((1, "<u4"), (2, "<i8"), (3, "<u4")))
    order = np.argsort(wanted)
    wanted, chunks, offset, bucket = wanted[order], chunks[order], offset[order], bucket[order]
    use = np.flatnonzero(member(side.names, wanted))
    which, names, to = chunked(side.names[use], wanted, chunks, offset, bucket, buckets)
    which = use[which]
    if few is not None:
        least = np.zeros(len(side.names), bool)
        least[use[least_names(side.names[use], side.owners[use], few)]] = True
        which, names, to = which[least[which]], names[least[which]], to[least[which]]
    if not len(names):
        return
    owners, bands = side.owners[which], side.bands[which]
    need: dict[int, list[int]] = {}
    for x in np.unique(owners << np.int64(16) | bands).tolist():
        need.setdefault(x >> 16, []).append(x & 0xFFFF)
    drawn = {(row, b): sketch(h, b, True) for row, _, h in set_by_set(file, key, text, np.array(list(need), np.int64)) for b in need[row]}
    yield from group_blobs(side, names, owners, bands, to, roots, None, drawn)


def could_link(sizes: np.ndarray, sketches: np.ndarray, i: int | np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the others could link with member i (one for all, or one for each), by size and by Hamming distance; and that distance."""
    n, m = sizes[i], sizes[others]
    differ = np.bitwise_count(sketches[others] ^ sketches[i]).sum(axis=1, dtype=np.int64)
    return (100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)) & (9 * differ <= n + m), differ


def star(sizes: np.ndarray, sketches: np.ndarray) -> tuple[int, np.ndarray]:
    """The member of middle size, and the others that could link with it."""
    middle = int(np.argsort(sizes, kind="stable")[len(sizes) // 2])
    fits, _ = could_link(sizes, sketches, middle, np.arange(len(sizes)))
    fits[middle] = False
    return middle, np.flatnonzero(fits)


def met_pairs(names: np.ndarray, members: np.ndarray, sizes: np.ndarray, sketches: np.ndarray, roots: np.ndarray | None, same: np.ndarray | None, nearest: bool) -> tuple[set[tuple[int, int]], set[tuple[int, int]]]:
    """Pairs to verify, and pairs of equal sets, of the groups of one band.

    names ascend; members are numbers into the other columns. Without roots it is the first round: each group gives a
    star, in which equal sets stand for one. With them a group gives the pairs of different roots that pass, or
    with `nearest`, for each member outside the most frequent root, the nearest of them.
    """
    check: set[tuple[int, int]] = set()
    equal: set[tuple[int, int]] = set()
    cuts = cut_groups(names)
    size = np.diff(cuts)
    two = cuts[:-1][size == 2]
    x, y = np.minimum(members[two], members[two + 1]), np.maximum(members[two], members[two + 1])
    pairs = np.unique((x << np.int64(32) | y)[x != y])
    x, y = pairs >> 32, pairs & ROWS
    if roots is not None:
        x, y = (z[roots[x] != roots[y]] for z in (x, y))
    else:
        alike = same[x] == same[y]
        equal.update(zip(x[alike].tolist(), y[alike].tolist(), strict=True))
        x, y = x[~alike], y[~alike]
    for a in range(0, len(x), 1 << 16):
        p, q = x[a : a + (1 << 16)], y[a : a + (1 << 16)]
        fits, _ = could_link(sizes, sketches, p, q)
        check.update(zip(p[fits].tolist(), q[fits].tolist(), strict=True))
    groups: set[bytes] = set()
    for a, b in zip(cuts[:-1][size > 2].tolist(), cuts[1:][size > 2].tolist(), strict=True):
        group = np.unique(members[a:b])
        if len(group) < 2 or (mark := group.tobytes()) in groups:
            continue
        groups.add(mark)
        if roots is None:
            group = group[np.argsort(same[group], kind="stable")]
            again = np.concatenate([[False], same[group[1:]] == same[group[:-1]]])
            leader = group[np.maximum.accumulate(np.where(again, 0, np.arange(len(group))))]
            equal.update(zip(leader[again].tolist(), group[again].tolist(), strict=True))
            group = group[~again]
            middle, others = star(sizes[group], sketches[group])
            check.update((int(group[middle]), j) for j in group[others].tolist())
            continue
        # members of the most frequent root need no comparing with each other
        _, kind, n = np.unique(roots[group], return_inverse=True, return_counts=True)
        group = group[np.argsort(kind != n.argmax(), kind="stable")]
        for i in range(int(n.max()), len(group)):
            others = group if nearest else group[:i]
            others = others[roots[others] != roots[group[i]]]
            fits, differ = could_link(sizes, sketches, int(group[i]), others)
            if nearest and fits.any():
                fits = [int(np.argmin(np.where(fits, differ, LAST)))]
            check.update((min(j, int(group[i])), max(j, int(group[i]))) for j in others[fits].tolist())
    return check, equal


def pairs_of_bucket(rows: list[dict], nearest: bool) -> Iterator[pa.RecordBatch]:
    """Pairs to verify (or known equal) from a bucket's groups, and those that blocks found themselves."""
    names, local, columns, drawn = [], [], [], []
    base = 0
    for r in rows:
        if r["pairs"] is not None:
            yield pa.ipc.read_record_batch(pa.py_buffer(expand(r["pairs"])[0]), PAIRS)
            continue
        name, own, row, size, band, root, mark, raw = expand(r["groups"])
        row, size, band = np.frombuffer(row, "<u4").astype(np.int64), np.frombuffer(size, "<u4").astype(np.int64), np.frombuffer(band, "<u2").astype(np.int64)
        names.append(unpack_names(name))
        local.append(np.frombuffer(own, "<u4").astype(np.int64) + base)
        columns.append(((np.int64(r["block"]) << np.int64(ROW_BITS)) + row, size, band, np.frombuffer(root, "<i8"), np.frombuffer(mark, "V16")))
        drawn.append(raw)
        base += len(row)
    if not columns:
        return
    names, local = np.concatenate(names), np.concatenate(local)
    place, size, band, roots, marks = (np.concatenate(x) for x in zip(*columns, strict=True))
    same = np.unique(marks, return_inverse=True)[1] if len(marks) else None
    # a blob's rows ascend by band, so that its sketches of a band stand in a row
    sketches: dict[int, list[np.ndarray]] = {}
    for (_, _, own, *_), raw in zip(columns, drawn, strict=True):
        at = 0
        for b, n in zip(*(x.tolist() for x in np.unique(own, return_counts=True)), strict=True):
            width = shape(b)[2 if same is not None else 3] // 8
            sketches.setdefault(b, []).append(np.frombuffer(raw, np.uint64, n * width // 8, at).reshape(n, -1))
            at += n * width
    own_band = band[local]
    for b in np.unique(band).tolist():
        of = np.flatnonzero(band == b)
        entries = np.flatnonzero(own_band == b)
        entries = entries[np.argsort(names[entries], kind="stable")]
        check, equal = met_pairs(names[entries], np.searchsorted(of, local[entries]), size[of], np.concatenate(sketches[b]), roots[of] if len(roots) else None, same[of] if same is not None else None, nearest)
        for found, known in ((check, False), (equal, True)):
            if found:
                p, q = (place[of[np.array(x, np.int64)]] for x in zip(*found, strict=True))
                yield pair_batch(np.minimum(p, q), np.maximum(p, q), known)


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the edges connect what earlier ones have not connected: they have the same components as all."""
    parent: dict[int, int] = {}
    out = np.zeros(len(a), bool)
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        while (p := parent.setdefault(y, y)) != y:
            parent[y] = y = parent[p]
        if x != y:
            parent[y], out[i] = x, True
    return out


#: Edges of which a task finds the forest at a time.
FOREST_EDGES = 1 << 19


def thinned(edges: DataFrame) -> DataFrame:
    """edges (a, b) without those that close a circle among others of their task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                found = pa.Table.from_batches(held)
                a, b = (found.column(c).to_numpy() for c in ("a", "b"))
                use = forest(a, b)
                held.clear()
                yield pa.RecordBatch.from_arrays([pa.array(a[use]), pa.array(b[use])], ["a", "b"])

        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= FOREST_EDGES:
                yield from flush()
        yield from flush()

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


SETS = pa.schema([("block", pa.int32()), ("sets", pa.binary())])


def verified(store: BlockStore, pairs: DataFrame, key: str, text: str) -> DataFrame:
    """Of the pairs (a, b) those whose sets link, as far as they connect something. Each a's set goes once to each block
    that has a b for it."""
    to_a = pairs.groupBy(F.shiftright("a", ROW_BITS).cast("int").alias("block"), "a", F.shiftright("b", ROW_BITS).cast("int").alias("to")).agg(F.collect_list("b").alias("b"))

    def fetch(_: int, file: str, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        wanted: dict[int, list[dict]] = {}
        for r in rows:
            wanted.setdefault(r["a"] & ROWS, []).append(r)
        to, blobs = [], []
        for row, _, h in set_by_set(file, key, text, np.array(list(wanted), np.int64)):
            for r in wanted[row]:
                to.append(r["to"])
                blobs.append(squeeze(h.astype("<u8").tobytes(), np.array([r["a"], *r["b"]], "<i8").tobytes()))
            if len(to) >= 256:
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(blobs, pa.binary())], schema=SETS)
                to, blobs = [], []
        if to:
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(blobs, pa.binary())], schema=SETS)

    def compare(block: int, file: str, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        # sets of a are kept compressed; each is opened once for each b that is met
        wanted: dict[int, list[bytes]] = {}
        for r in rows:
            for b in np.frombuffer(expand(r["sets"])[1], "<i8")[1:].tolist():
                wanted.setdefault(b & ROWS, []).append(r["sets"])
        opened: dict[int, tuple[np.ndarray, int]] = {}
        out = []
        for row, _, h in set_by_set(file, key, text, np.array(list(wanted), np.int64)):
            for raw in wanted[row]:
                have = opened.get(id(raw))
                if have is None:
                    if len(opened) > 256:
                        opened.clear()
                    x, who = expand(raw)
                    have = opened[id(raw)] = (np.frombuffer(x, "<u8"), int(np.frombuffer(who, "<i8", 1)[0]))
                both = int(member(h, have[0]).sum())
                if 100 * both >= PERCENT * (len(h) + len(have[0]) - both):
                    out.append((have[1], block << ROW_BITS | row))
        if out:
            a, b = (np.array(x, np.int64) for x in zip(*out, strict=True))
            use = forest(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(a[use]), pa.array(b[use])], ["a", "b"])

    sets = answer_blocks(store, to_a, fetch, T.StructType([T.StructField("block", T.IntegerType()), T.StructField("sets", T.BinaryType())]))
    return answer_blocks(store, sets, compare, "a long, b long")


def kept(df: DataFrame, purpose: str) -> DataFrame:
    """df written to the shared folder and read again, so that later rounds don't run it anew."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b), root being the smallest node that can be reached.

    Alternates large stars (each node links its larger neighbours to the smallest one) and small stars (the same for
    its smaller neighbours) until nothing changes: O(log^2 n) rounds, each linear in the edges.
    """
    e = kept(thinned(edges).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.where("x > m").select(F.col("x").alias("u"), F.col("m").alias("v"))).distinct()
        low = large.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
        small = large.join(low, F.col("u") == F.col("x")).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select(F.col("x").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        e = kept(small, "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")).first()
        if state == now or now[0] == now[2] and not e.join(e.select(F.col("u").alias("x")), F.col("v") == F.col("x"), "left_semi").take(1):
            break
        state = now
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def by_block(roots: DataFrame) -> DataFrame:
    """(block, roots): the components (node, root), packed for their nodes' blocks."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, root = batch.column("node").to_numpy(), batch.column("root").to_numpy()
            blocks = node >> ROW_BITS
            for b in np.unique(blocks).tolist():
                at = blocks == b
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([squeeze(node[at].astype("<i8").tobytes(), root[at].astype("<i8").tobytes())], pa.binary())], ["block", "roots"])

    return roots.mapInArrow(packed, "block int, roots binary")


def components_by_block(store: BlockStore, key: str, text: str) -> DataFrame:
    """(block, side, roots): each block's side table, and the components of its linked sets, by the rounds told above."""
    buckets = buckets_for(store)
    shared = shared_names(store, lambda file: names_of_block(file, key, text))
    sides = kept(answer_blocks(store, shared, lambda block, file, rows: side_table(block, file, joined_names(rows), buckets, key, text), SIDE_DDL, every=True), "side-tables")
    side = sides.where("side is not null").select("block", "side")
    blank = lambda c: F.lit(None).cast("binary").alias(c)

    checked: list[DataFrame] = []

    def linked(sent: DataFrame, nearest: bool) -> DataFrame:
        pairs = gather_buckets(sent, buckets, lambda _, rows: pairs_of_bucket(rows, nearest), PAIRS, "a long, b long, equal boolean")
        pairs = pairs.groupBy("a", "b").agg(F.max("equal").alias("equal"))
        for earlier in checked:
            pairs = pairs.join(earlier.select("a", "b"), ["a", "b"], "left_anti")
        checked.append(pairs := kept(pairs, "pairs"))
        return kept(verified(store, pairs.where("not equal"), key, text).unionByName(pairs.where("equal").select("a", "b")), "links")

    def known_of(roots: DataFrame) -> DataFrame:
        return kept(side.select("block", "side", blank("roots")).unionByName(by_block(roots).select("block", blank("side"), "roots")), "roots")

    def opened(block: int, rows: list[dict]) -> tuple[Side, np.ndarray]:
        own = Side(block, next(r["side"] for r in rows if r["side"] is not None))
        return own, roots_by_row(rows, own)

    roots = components(linked(sides.where("bucket is not null").select("bucket", "block", "groups", "pairs"), False))
    known = known_of(roots)
    for few in (NEAR_NAMES, None):
        asked = answer_blocks(store, known, lambda block, _, rows: named_roots(*opened(block, rows), buckets), "bucket int, block int, named binary")
        many = gather_buckets(asked, buckets, lambda _, rows: open_names(rows, buckets), OPEN, "block int, names binary")
        both = known.select("block", "side", "roots", blank("names")).unionByName(many.select("block", blank("side"), blank("roots"), "names"))

        def again(block: int, file: str, rows: list[dict], few: int | None = few) -> Iterator[pa.RecordBatch]:
            answers = [r["names"] for r in rows if r["names"] is not None]
            if answers:
                own, of = opened(block, [r for r in rows if r["names"] is None])
                yield from later_groups(own, file, of, answers, few, buckets, key, text)

        found = linked(answer_blocks(store, both, again, GROUPS_DDL), few is not None)
        if found.take(1):
            roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found))
            known = known_of(roots)
    return known


def membership(store: BlockStore, key: str, text: str) -> DataFrame:
    """(block, side, roots, root, component, first): each block's side table and components, and of each component that
    it has a part of, the smallest key and the place that leads it (which has that key)."""
    known = components_by_block(store, key, text)

    def leads(block: int, _: str, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        own = Side(block, next(r["side"] for r in rows if r["side"] is not None))
        parts = [[np.frombuffer(x, "<i8") for x in expand(r["roots"])] for r in rows if r["roots"] is not None]
        if parts:
            node, root = (np.concatenate(x) for x in zip(*parts, strict=True))
            keys = own.keys[node & ROWS]
            order = np.lexsort((node, keys, root))
            first = order[cut_groups(root[order])[:-1]]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), block, np.int32)), pa.array(root[first]), pa.array(keys[first]), pa.array(node[first])], ["block", "root", "k", "node"])

    # a block has one row for each component, however many of its sets belong to it
    part = kept(answer_blocks(store, known, leads, "block int, root long, k long, node long"), "leads")
    lead = part.groupBy("root").agg(F.min(F.struct("k", "node")).alias("lead"))
    told = part.select("block", "root").join(lead, "root").select("block", F.lit(None).cast("binary").alias("side"), F.lit(None).cast("binary").alias("roots"), "root", F.col("lead.k").alias("component"), F.col("lead.node").alias("first"))
    return known.select("block", "side", "roots", *[F.lit(None).cast("long").alias(c) for c in ("root", "component", "first")]).unionByName(told)


def own_components(rows: list[dict], side: Side) -> tuple[np.ndarray, np.ndarray]:
    """The smallest key of each row's component, and whether the row leads it."""
    roots = roots_by_row(rows, side)
    component, first = side.keys.copy(), np.ones(len(roots), bool)
    told = sorted((r["root"], r["component"], r["first"]) for r in rows if r["root"] is not None)
    if told:
        root, smallest, lead = (np.array(x, np.int64) for x in zip(*told, strict=True))
        of = np.minimum(np.searchsorted(root, roots), len(root) - 1)
        met = root[of] == roots
        component[met] = smallest[of][met]
        first[met] = lead[of][met] == side.place(np.flatnonzero(met))
    return component, first


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id for each row of docs.

    component_id is the smallest key that can be reached by links, the row's own included. A text without words has
    no shingles, links with nothing and is its own component; a null key is larger than every other, and the
    component of rows that all have none is null. Repeated rows link with each other. An empty table gives an empty
    result.
    """
    store = BlockStore.write(docs.select(docs[key].cast("long").alias(key), docs[text].alias(text)), "jaccard-blocks")

    def finish(block: int, _: str, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        own = Side(block, next(r["side"] for r in rows if r["side"] is not None))
        known = [pa.array(x, pa.int64(), mask=x == NO_KEY) for x in (own.keys, own_components(rows, own)[0])]
        yield pa.RecordBatch.from_arrays([known[0], pa.array(own.sizes), known[1]], [key, "n_shingles", "component_id"])

    return answer_blocks(store, membership(store, key, text), finish, f"{key} long, n_shingles long, component_id long")


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, with all columns, that lead their component: the smallest key, of repeated ones the first stored.

    A null key is larger than every other. Texts that are null or have no words link with nothing and stay. An empty
    table gives an empty result.
    """
    store = BlockStore.write(docs, "jaccard-blocks")

    def finish(block: int, file: str, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        own = Side(block, next(r["side"] for r in rows if r["side"] is not None))
        keep = pa.array(own_components(rows, own)[1])
        for first, batch in read_block(file):
            yield batch.filter(keep[first : first + batch.num_rows])

    return answer_blocks(store, membership(store, key, text), finish, docs.schema)
