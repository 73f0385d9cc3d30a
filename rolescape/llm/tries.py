"""Mergeable radix tries over byte strings, in columns.

A trie is kept in preorder, which is the byte order of its terms: leaf i shares the first depths[i] bytes with the leaf
before it and goes on with its own label, so each edge of the radix trie is stored once. A leaf counts the documents that
hold its term and, by source, the occurrences. Tries are merged by adding the counters of equal terms.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class Trie:
    """Terms ascending, each once; docs by leaf; the counters of leaf i are at starts[i] to starts[i + 1]: the source as a
    place in names, and its occurrences."""

    def __init__(self, terms: pa.Array, docs: np.ndarray, leaf: np.ndarray, source: np.ndarray, counts: np.ndarray, names: Sequence[str]):
        """From terms in any order, which may repeat: documents of each, and counters (term's place, source's place, count)."""
        coded = terms.dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        at = place[coded.indices.to_numpy()]
        self.names = list(names)
        self.terms = coded.dictionary.take(pa.array(order))
        self.docs = summed(at, docs, len(order))
        key, back = np.unique(at[leaf] * max(1, len(self.names)) + source, return_inverse=True)
        own, self.source = np.divmod(key, max(1, len(self.names)))
        self.counts = summed(back, counts, len(key))
        self.starts = np.searchsorted(own, np.arange(len(order) + 1))

    def __len__(self) -> int:
        return len(self.terms)

    def columns(self, low: int, high: int) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array]:
        """terms, docs, sources and counts of some leaves, the latter two as lists."""
        a, b = int(self.starts[low]), int(self.starts[high])
        offsets = pa.array((self.starts[low : high + 1] - a).astype(np.int32))
        sources = pa.DictionaryArray.from_arrays(pa.array(self.source[a:b].astype(np.int32)), pa.array(self.names, pa.string())).cast(pa.string())
        return self.terms.slice(low, high - low), pa.array(self.docs[low:high]), pa.ListArray.from_arrays(offsets, sources), pa.ListArray.from_arrays(offsets, pa.array(self.counts[a:b]))

    def kept(self, min_docs: int) -> np.ndarray:
        """The leaves of so many documents or more."""
        return np.flatnonzero(self.docs >= min_docs)


def summed(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of whole numbers by place, exact below 2^53."""
    return np.bincount(at, values, n).astype(np.int64)


def from_columns(terms: pa.Array, docs: pa.Array, sources: pa.ListArray, counts: pa.ListArray) -> Trie:
    """The merged trie of leaves that came from many tries."""
    coded = sources.flatten().dictionary_encode()
    leaf = np.repeat(np.arange(len(terms)), sources.value_lengths().to_numpy())
    return Trie(terms, docs.to_numpy(), leaf, coded.indices.to_numpy().astype(np.int64), counts.flatten().to_numpy(), coded.dictionary.to_pylist())


def merge(tries: Iterable[Trie]) -> Trie:
    parts = [t.columns(0, len(t)) for t in tries]
    return from_columns(*(pa.concat_arrays(c) for c in zip(*parts, strict=True)))


def edges(terms: Sequence[bytes]) -> tuple[list[int], list[bytes]]:
    """depths and labels of ascending terms."""
    depths, labels, last = [], [], b""
    for t in terms:
        n = min(len(last), len(t))
        if last[:n] == t[:n]:
            depth = n
        else:
            low, high = 0, n
            while low + 1 < high:
                middle = (low + high) // 2
                low, high = (middle, high) if last[:middle] == t[:middle] else (low, middle)
            depth = low
        depths.append(depth)
        labels.append(t[depth:])
        last = t
    return depths, labels


def walk(depths: Sequence[int], labels: Sequence[bytes]) -> Iterator[bytes]:
    """The terms in byte order."""
    term = b""
    for depth, label in zip(depths, labels, strict=True):
        term = term[:depth] + label
        yield term
