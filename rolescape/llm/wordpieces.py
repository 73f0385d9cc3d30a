"""Ids of the word-end BPE vocabulary for whole texts, at several times the speed of encoding text by text.

The vocabulary's normalizer turns white space into separators that no piece crosses, so the ids of a text are the
ids of its white-space separated chunks in a row. Each worker keeps the chunks it has met; a chunk of plain Latin
characters is split by the vocabulary's own pattern and each piece goes through the tokenizers library's model,
any other chunk through the whole library. Texts with rare separators go through the library unsplit.
"""

from __future__ import annotations

import re
from array import array

#: Chunks that a worker keeps; then it starts anew. About 150 bytes each; those longer than KEPT_LENGTH are not kept.
KEPT_CHUNKS = 500_000
KEPT_LENGTH = 64
#: White space of either kind (Unicode, Python) beyond the ASCII ones: such texts aren't split here.
RARE_SPACE = re.compile("[\u001c-\u001f\u0085\u00a0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
LATIN = re.compile("[\x21-\x7e\xa1-\xac\xae-\xff]*")
#: The vocabulary file's split pattern.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_chars() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for U+0100 upward in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(rest)) for b in range(256)}


class WordPieces:
    """encode(text) gives the ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.pieces = regex.compile(PIECES)
        self.alphabet = byte_chars()
        self.chunks: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def piece(self, piece: str) -> bytes:
        found = self.known.get(piece)
        if found is None:
            symbols = piece.encode().decode("latin-1").translate(self.alphabet)
            found = array("I", [t.id for t in self.model.tokenize(symbols)]).tobytes()
            if len(piece) <= KEPT_LENGTH:
                self.known[piece] = found
        return found

    def chunk(self, chunk: str) -> bytes:
        if LATIN.fullmatch(chunk) and "<|" not in chunk:
            found = b"".join(map(self.piece, self.pieces.findall(chunk.lower())))
        else:
            found = self.whole(chunk)
        if len(chunk) <= KEPT_LENGTH:
            self.chunks[chunk] = found
        return found

    def encode(self, text: str) -> bytes:
        if RARE_SPACE.search(text):
            return self.whole(text)
        if len(self.chunks) > KEPT_CHUNKS:
            self.chunks.clear()
        if len(self.known) > KEPT_CHUNKS:
            self.known.clear()
        known, out = self.chunks, []
        for chunk in text.split():
            found = known.get(chunk)
            out.append(self.chunk(chunk) if found is None else found)
        return b"".join(out)


_OPEN: dict[str, WordPieces] = {}


def word_pieces(path: str) -> WordPieces:
    """The worker's encoder for a vocabulary file, opened once."""
    if path not in _OPEN:
        _OPEN[path] = WordPieces(path)
    return _OPEN[path]
