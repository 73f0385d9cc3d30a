"""Byte-level BPE through a tokenization automaton.

The automaton begins as one state with a loop for every byte. Each merge, in order of rank, adds a gadget: a token
that may no longer be followed by the merge's right part gets a state of its own without that arc, and every state
with an arc for the left part gets one for the merged token, into the state behind the right part. In the result a
string has exactly one path, and its arc labels are the BPE tokens.

A gadget is stored as what it changes: the state behind a token (which state it was copied from, when, and the arcs
it has lost) and the origin of a token's arcs (the left part's, as they were when the merge came). Arcs are resolved
from these records when first asked for and then stand in a table. Words are encoded by table transitions from
each position along the tokens that match there; every prefix has one path, so no choice is ever undone.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from itertools import chain

#: The vocabulary's split pattern, and the chunks that it never joins.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CHUNK = re.compile(r"[ \t\n\r\x0b\x0c]*[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+")
RARE_SPACE = re.compile("[\u001c-\u001f\u0085\u00a0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
#: Chunks, words and arcs that a worker keeps; then it starts anew. Longer ones than KEPT_LENGTH are not kept.
KEPT_CHUNKS = 400_000
KEPT_LENGTH = 64
KEPT_ARCS = 2_000_000
NEVER = 1 << 60


class Automaton:
    """The tokenization automaton of a merge list; labels[t] is the byte string of token t."""

    def __init__(self, labels: dict[int, bytes], merges: Iterable[tuple[int, int, int]]):
        self.labels = labels
        #: behind[t]: (token whose state was copied, at which merge); lost[t]: {next token: merge that removed its arc}
        self.behind: dict[int, tuple[int, int]] = {}
        self.lost: dict[int, dict[int, int]] = {}
        #: origin[t]: (left part whose arcs were copied, at which merge)
        self.origin: dict[int, tuple[int, int]] = {}
        self.table: dict[int, bool] = {}
        self.trie: dict[int, list] = {}
        for time, (left, right, made) in enumerate(merges):
            self.gadget(time, left, right, made)
        for token, label in labels.items():
            if label:
                self.insert(label, token)

    def gadget(self, time: int, left: int, right: int, made: int) -> None:
        """Merge number `time`: the arc `right` leaves the state behind `left`; `made` gets arcs where `left` has them."""
        self.lost.setdefault(left, {}).setdefault(right, time)
        self.origin.setdefault(made, (left, time))
        self.behind.setdefault(made, (right, time))

    def insert(self, label: bytes, token: int) -> None:
        node = self.trie
        for b in label[:-1]:
            node = node.setdefault(b, [{}, -1])[0]
        node.setdefault(label[-1], [{}, -1])[1] = token

    def arc(self, state: int, token: int) -> bool:
        """Whether the state behind one token has an arc for another."""
        key = state << 20 | token
        found = self.table.get(key)
        if found is None:
            if len(self.table) > KEPT_ARCS:
                self.table.clear()
            found = self.table[key] = self.resolve(state, token)
        return found

    def resolve(self, state: int, token: int) -> bool:
        """Follow the gadget records back in time: an arc lost by then, or a copy's origin."""
        before = NEVER
        while True:
            if self.lost.get(state, {}).get(token, NEVER) < before:
                return False
            copied, s_time = self.behind.get(state, (0, -1))
            origin, t_time = self.origin.get(token, (0, -1))
            s_time, t_time = (s_time if s_time < before else -1), (t_time if t_time < before else -1)
            if s_time < 0 and t_time < 0:
                return True
            # whichever copy was made last is undone first; a merge takes its arc away before it copies arcs
            if t_time >= s_time:
                token, before = origin, t_time + 1
            else:
                state, before = copied, s_time

    def encode(self, word: bytes) -> list[int]:
        """The labels on the word's path."""
        n = len(word)
        state = [-1] * (n + 1)
        came = [0] * (n + 1)
        trie, table = self.trie, self.table
        for i in range(n):
            node, s, j = trie, state[i], i
            while j < n:
                step = node.get(word[j])
                if step is None:
                    break
                node, token = step
                j += 1
                if token >= 0 and state[j] < 0:
                    if i:
                        ok = table.get(s << 20 | token)
                        if ok is None:
                            ok = self.arc(s, token)
                        if not ok:
                            continue
                    state[j], came[j] = token, i
        out = []
        while n:
            out.append(state[n])
            n = came[n]
        return out[::-1]


class ByteCodec:
    """Encodes and decodes whole texts as the vocabulary file prescribes."""

    def __init__(self, path: str):
        import regex

        from rolescape.llm.wordpieces import byte_chars

        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        vocabulary, merges = data["model"]["vocab"], data["model"]["merges"]
        raw = {c: b for b, c in byte_chars().items()}
        labels = {i: bytes(raw[c] for c in token) for token, i in vocabulary.items() if all(c in raw for c in token)}
        self.special = {x["content"]: x["id"] for x in data.get("added_tokens", [])}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        for x, i in self.special.items():
            labels.pop(i, None)
        self.automaton = Automaton(labels, ((vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in pairs))
        self.emit = labels | {i: x.encode() for x, i in self.special.items()}
        self.decimal = {i: str(i) for i in self.emit}
        self.split = regex.compile(SPLIT)
        self.marks = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.chunks: dict[str, tuple[int, ...]] = {}
        self.words: dict[str, list[int]] = {}

    def word(self, word: str) -> list[int]:
        found = self.words.get(word)
        if found is None:
            found = self.automaton.encode(word.encode())
            if len(word) <= KEPT_LENGTH:
                if len(self.words) > KEPT_CHUNKS:
                    self.words.clear()
                self.words[word] = found
        return found

    def chunk(self, chunk: str) -> tuple[int, ...]:
        found = tuple(chain.from_iterable(map(self.word, self.split.findall(chunk))))
        if len(chunk) <= KEPT_LENGTH:
            if len(self.chunks) > KEPT_CHUNKS:
                self.chunks.clear()
            self.chunks[chunk] = found
        return found

    def plain(self, text: str) -> list[int]:
        if RARE_SPACE.search(text):
            return list(chain.from_iterable(map(self.word, self.split.findall(text))))
        known, out = self.chunks, []
        for chunk in CHUNK.findall(text):
            found = known.get(chunk)
            out.extend(self.chunk(chunk) if found is None else found)
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of a text; strings of special tokens become their ids."""
        if self.marks is None or "<|" not in text and not any(x in text for x in self.special):
            return self.plain(text)
        out: list[int] = []
        for part in self.marks.split(text):
            out.extend([self.special[part]] if part in self.special else self.plain(part))
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The arcs' labels in a row; bytes that are no UTF-8 become the replacement character."""
        return b"".join(map(self.emit.__getitem__, ids)).decode("utf-8", errors="replace")


_OPEN: dict[str, ByteCodec] = {}


def codec(path: str) -> ByteCodec:
    """The worker's codec for a vocabulary file, compiled once."""
    if path not in _OPEN:
        _OPEN[path] = ByteCodec(path)
    return _OPEN[path]
