"""Dictionary phrases in one pass over a text, however many there are.

A few phrases are searched by a regular expression each, which stays in generated code. A larger dictionary becomes one
automaton that finds all its phrases while a text is read once; texts go to it as Arrow batches, and what comes back are
the places of the phrases found, from which the groups are chosen by expressions again.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from rolescape.functions.text import contains_phrase

Groups = tuple[tuple[str, tuple[str, ...]], ...]
#: Dictionaries of so many phrases are searched by expressions.
FEW = 2
WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def spaced(text: str) -> str:
    """Runs of ASCII white space as one space."""
    for c in "\t\n\x0b\f\r":
        text = text.replace(c, " ")
    while "  " in text:
        text = text.replace("  ", " ")
    return text


def plain(phrase: str) -> str:
    return " ".join(phrase.lower().split())


@cache
def automaton(phrases: tuple[str, ...]):
    """The automaton of a dictionary; each phrase leads to its length and its places, as one can stand there twice."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for phrase in set(map(plain, phrases)) - {""}:
        out.add_word(phrase, (len(phrase), tuple(i for i, p in enumerate(phrases) if plain(p) == phrase)))
    out.make_automaton()
    return out


def places(text: str | None, phrases: tuple[str, ...]) -> list[int]:
    """The places of the phrases that stand in a lower-cased text between other characters than a-z and 0-9."""
    found: set[int] = set()
    if text:
        text = spaced(text)
        last = len(text) - 1
        for end, (n, at) in automaton(phrases).iter(text):
            start = end - n + 1
            if at[0] not in found and (start == 0 or text[start - 1] not in WORD) and (end == last or text[end + 1] not in WORD):
                found.update(at)
    return sorted(found)


def found(lowered: Column, phrases: Sequence[str]) -> Column:
    """The places (from 0, ascending) of the phrases that a text holds, as an array; a null text holds none."""
    phrases = tuple(phrases)
    if len(phrases) <= FEW:
        return F.array_compact(F.array(*[F.when(contains_phrase(lowered, p), F.lit(i)) for i, p in enumerate(phrases)]).cast("array<int>"))

    @F.pandas_udf("array<int>")
    def search(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: places(x, phrases))

    return search(F.coalesce(lowered, F.lit("")))


class Dictionary:
    """Phrases of several groupings that are searched in the same text at once."""

    def __init__(self, *groupings: Groups, terms: Sequence[str] = ()):
        self.phrases = tuple(dict.fromkeys([a for groups in groupings for _, aliases in groups for a in aliases] + list(terms)))
        self.at = {p: i for i, p in enumerate(self.phrases)}

    def found(self, lowered: Column) -> Column:
        return found(lowered, self.phrases)

    def any(self, hits: Column, terms: Sequence[str]) -> Column:
        """Whether one of the terms was found."""
        return F.arrays_overlap(hits, F.array(*[F.lit(self.at[t]) for t in terms])) if terms else F.lit(False)

    def every(self, hits: Column, groups: Groups, separator: str = "; ") -> Column:
        """Every group with an alias that was found, in declared order, joined."""
        return F.array_join(F.array(*[F.when(self.any(hits, aliases), F.lit(name)) for name, aliases in groups]), separator) if groups else F.lit("")

    def first(self, hits: Column, groups: Groups) -> Column:
        """The group of the longest alias that was found; of equally long ones the group declared first."""
        ranked = sorted(((-len(a), i, name, a) for i, (name, aliases) in enumerate(groups) for a in aliases), key=lambda x: x[:2])
        if not ranked:
            return F.lit("")
        rank: dict[str, int] = {}
        for n, (*_, alias) in enumerate(ranked):
            rank.setdefault(alias, n)
        ranks = F.array(*[F.lit(rank.get(p)).cast("int") for p in self.phrases])
        best = F.array_min(F.transform(hits, lambda p: F.get(ranks, p)))
        return F.coalesce(F.get(F.array(*[F.lit(name) for _, _, name, _ in ranked]), best), F.lit(""))
