"""Divergence audit, ranked search and token counts on hard rows, against brute force, the library and SQL."""

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rolescape.llm import divergence, oracles, ranking, tokencounts, tries
from tests.llm.conftest import SCHEMA, rows, words

BYTE = public_tokenizers.path("byte_bpe_50k.json")
LETTERS = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LETTERS_DIGITS = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def got(df):
    return [tuple(r) for r in df.collect()]


def several(rng, n, langs=("en", "de", None, ""), sources=("s1", "s2", "Ünder", None)):
    """Documents of many sources whose words repeat, with ties, nulls, odd letters and an empty group."""
    out = [(i, rng.choice([None, "", words(rng, rng.randrange(1, 80), 30), f"İstanbul K ſ {words(rng, 4, 6)} 日本 n0t1e ÀB"]), rng.choice(langs), rng.choice(sources)) for i in range(n)]
    return [*out, (n, None, "en", "empty"), (n + 1, "alone", "fr", "only"), (n + 2, " ", "it", "a"), (n + 3, None, "it", "b"), out[0], out[0]]


def audit_by_hand(data, min_docs=3, ranks=200):
    docs = [((x or "").translate(LOW), a or "", b or "") for _, x, a, b in data]
    groups, df, said = defaultdict(set), Counter(), Counter()
    for x, a, b in docs:
        groups[a].add(b)
        terms = LETTERS.findall(x)
        df.update({(a, t) for t in terms})
        said.update((a, b, t) for t in terms)
    out = []
    for a, sources in groups.items():
        kept = sorted(t for (lang, t), n in df.items() if lang == a and n >= min_docs)
        v = len(kept)

        def share(count, n, v=v):
            return 1 + 10**9 * (count + 1) // (n + v)

        n = {b: sum(said[a, b, t] for t in kept) for b in sources}
        p = {b: [share(said[a, b, t], n[b]) for t in kept] for b in sources}
        q = [share(sum(said[a, b, t] for b in sources), sum(n.values())) for t in kept]
        for b in sources:
            pairs = sorted((-sum((x - y) ** 2 // y for x, y in zip(p[b], p[c], strict=True)), c.encode(), c) for c in sources if c != b)
            out += [(a, b, "pair", c, -f, i) for i, (f, _, c) in enumerate(pairs, 1)]
            terms = sorted((-((x - y) ** 2 // y), t.encode(), t) for x, y, t in zip(p[b], q, kept, strict=True) if said[a, b, t] and x > y)
            out += [(a, b, "term", t, -f, i) for i, (f, _, t) in enumerate(terms[:ranks], 1)]
    return sorted(out)


def test_divergence_equals_brute_force_and_sql(spark, none, monkeypatch):
    data = several(random.Random(3), 60)
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string").repartition(5)
    want = audit_by_hand(data)
    assert sorted(got(divergence.divergence(docs))) == want and {r[2] for r in want} == {"pair", "term"}
    clashing = docs.selectExpr("*", "'x' AS term", "'y' AS raw", "1 AS n", "'z' AS value", "2 AS rank", "3 AS kept")
    # tries sent early, blocks and tables of a few terms, few ranks
    for name, n in (("GATHERED", 7), ("HELD", 20), ("RANGE_LEAVES", 400), ("BLOCK_TERMS", 5), ("TABLE_CELLS", 3)):
        monkeypatch.setattr(divergence, name, n)
    assert sorted(got(divergence.divergence(clashing, ranks=2))) == audit_by_hand(data, ranks=2)
    assert got(divergence.divergence(spark.createDataFrame([], "doc_id long, text string, lang string, source string"))) == []
    c = duckdb.connect()
    frame = docs.toPandas()
    c.register("documents", frame)
    assert sorted(c.sql(oracles.OP11).fetchall()) == want


def test_shares_and_distances_are_exact():
    import numpy as np

    rng = random.Random(4)
    cases = [(rng.randrange(10**rng.randrange(1, 15)), rng.randrange(1, 9 * 10**15)) for _ in range(2000)] + [(0, 1), (9 * 10**14, 9 * 10**15)]
    for c, n in cases:
        c = min(c, n - 1)
        assert divergence.shares(np.array([c]), np.array([n]))[0] == 1 + 10**9 * (c + 1) // n
    assert divergence.distance(np.array([10**9 + 1]), np.array([1]))[0] == 10**18


def trie_of(part):
    import numpy as np
    import pyarrow as pa

    names = sorted({s for _, by in part.values() for s in by})
    counters = [(i, names.index(s), n) for i, (_, by) in enumerate(part.values()) for s, n in by.items()]
    leaf, source, counts = (np.array(c, np.int64) for c in zip(*counters, strict=True))
    return tries.Trie(pa.array(list(part), pa.binary()), np.array([d for d, _ in part.values()]), leaf, source, counts, names)


def leaves_of(trie):
    terms, docs, sources, counts = (c.to_pylist() for c in trie.columns(0, len(trie)))
    return [(t, d, dict(zip(s, n, strict=True))) for t, d, s, n in zip(terms, docs, sources, counts, strict=True)]


def test_tries_merge_and_walk_in_byte_order():
    rng = random.Random(6)
    parts = []
    for _ in range(4):
        part = {}
        for _ in range(300):
            t = "".join(rng.choice("aabé日") for _ in range(rng.randrange(1, 7))).encode()
            part[t] = (rng.randrange(1, 5), {rng.choice("xyz"): rng.randrange(1, 9) for _ in range(2)})
        parts.append(part)
    want = defaultdict(lambda: [0, Counter()])
    for p in parts:
        for t, (docs, by) in p.items():
            want[t][0] += docs
            want[t][1].update(by)
    whole = tries.merge([tries.merge(map(trie_of, parts[:2])), *map(trie_of, parts[2:])])
    assert leaves_of(whole) == [(t, want[t][0], dict(sorted(want[t][1].items()))) for t in sorted(want)]
    depths, labels = tries.edges(sorted(want))
    assert list(tries.walk(depths, labels)) == sorted(want) and sum(map(len, labels)) < sum(map(len, want))
    deep = [b"a" * n for n in range(1, 500)]
    assert tries.edges(deep) == ([*range(499)], [b"a"] * 499) and tries.edges([]) == ([], [])


def search_by_hand(docs, items, k=10):
    terms = [LETTERS_DIGITS.findall((x or "").translate(LOW)) for _, x, *_ in docs]
    counts = [Counter(t) for t in terms]
    total, n_words = sum(map(bool, terms)), sum(map(len, terms))
    df = Counter(t for c in counts for t in c)
    out = []
    for item, x in items:
        asked = set(LETTERS_DIGITS.findall((x or "").translate(LOW)))
        scored = []
        for (key, *_), c, t in zip(docs, counts, terms, strict=True):
            if t:
                m = 10 + 90 * len(t) * total // n_words
                score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[a] + 1))) * (10**9 * c[a] // (1000 * c[a] + 8 * m)) for a in asked if a in c)
                if score > 0:
                    scored.append((-score, key is None, key or 0, key))
        out += [(item, i, key, -s) for i, (s, _, _, key) in enumerate(sorted(scored, key=lambda r: r[:3])[:k], 1)]
    return Counter(out)


@pytest.mark.parametrize("limits", [{}, {"CELLS": 7, "GATHERED": 50, "SEED_TERMS": 1, "EXACT": 0}])
def test_ranked_search_equals_brute_force(spark, monkeypatch, limits):
    for name, n in limits.items():
        monkeypatch.setattr(ranking, name, n)
    rng = random.Random(8)
    docs = [*rows(), *[(100 + i, words(rng, rng.randrange(1, 40), 12), "en", 1) for i in range(120)], *[(300 + i, "tie tie of words", "en", 1) for i in range(15)]]
    items = [(1, words(rng, 30, 12)), (2, "tie WORDS words"), (3, None), (4, ""), (5, "nothingsaidanywhere"), (6, rows()[13][1]), (7, "é ß 日本語"), (7, "same tie"), (8, "tie"), (8, "tie"), (None, "of x 400")]
    df = spark.createDataFrame(docs, SCHEMA).repartition(6).selectExpr("*", "'a' AS term", "1 AS query", "2 AS row", "'b' AS raw", "3 AS at", "4 AS item")
    queries = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "7 AS doc_id", "8 AS rank", "'c' AS raw")
    want = search_by_hand(docs, items)
    assert Counter(got(ranking.ranked(df, queries))) == want
    if not limits:
        # in several blocks of items
        size = sum(len((x or "").encode()) for _, x in items)
        assert Counter(got(ranking.ranked(df, queries, k=3, query_bytes=size // 2))) == search_by_hand(docs, items, 3)


def test_ranked_search_of_empty_tables(spark, none):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert got(ranking.ranked(none, items)) == [] and got(ranking.ranked(spark.createDataFrame(rows(), SCHEMA), items.limit(0))) == []


def test_search_sql_equals_brute_force(spark):
    rng = random.Random(9)
    docs = [(i, words(rng, rng.randrange(1, 60), 20), "en", 1) for i in range(60)] + [(60, None, "en", 1), (61, "É K İ 1a", "en", 1)]
    items = [(i, words(rng, 12, 20)) for i in range(5)] + [(5, "é K i 1A")]
    c = duckdb.connect()
    frames = [spark.createDataFrame(docs, SCHEMA).toPandas(), spark.createDataFrame(items, "item_id long, text string").toPandas()]
    c.register("documents", frames[0])
    c.register("benchmark", frames[1])
    assert Counter(c.sql(oracles.OP12).fetchall()) == search_by_hand(docs, items)


def test_thresholds_prune_and_keep_all_results():
    """With a threshold some terms are no reason to look at a document, and no document that reaches it is lost."""
    import numpy as np

    queries = ranking.Queries([b"a b c d", b"c d"])
    weights, highest = np.array([1, 2, 50, 60]), np.array([10, 10, 10, 10])
    plan = ranking.Plan(queries, weights, highest, np.array([100, 0]))
    assert plan.rest.tolist() == [30, 0] and [x.tolist() for x in plan.others] == [[0, 1], []]
    lengths, ids = np.array([2, 2, 4, 1]), np.array([0, 1, 1, 3, 0, 1, 2, 3, 2])
    added = weights[ids] * 2
    found = sorted(plan.scores(lengths, ids, added))
    assert found == [(1, 0, 124), (1, 1, 120), (2, 0, 226), (2, 1, 220), (3, 0, 100), (3, 1, 100)]


def test_token_counts_equal_the_library(spark, none, monkeypatch):
    data = [*rows(), (20, "<|endoftext|>", "en", 1), (21, "a<|endoftext|><|endoftext|> b <|endo", "en", 1), (22, "  \n\n  x y  z'll 'S 12ab  ", "en", 1), (23, "x" * 200_000, "en", 1), (24, words(random.Random(1), 30_000, 50), "en", 1)]
    tokenizer = Tokenizer.from_file(BYTE)
    want = Counter()
    for k, x, *_ in data:
        n = len(tokenizer.encode(x or "", add_special_tokens=False).ids)
        want[k, len((x or "").encode()), n, n > 1024] += 1
    docs = spark.createDataFrame(data, SCHEMA).repartition(3).selectExpr("*", "1 AS block", "'p' AS piece", "2 AS number", "3 AS n", "4 AS first")
    assert Counter(got(tokencounts.token_counts(docs, BYTE))) == want
    monkeypatch.setattr(tokencounts, "KEPT_PIECES", 40)
    assert Counter(got(tokencounts.token_counts(docs, BYTE))) == want
    blank = spark.createDataFrame([(1, None), (2, ""), (2, "")], "doc_id long, text string")
    assert sorted(got(tokencounts.token_counts(blank, BYTE))) == [(1, 0, 0, False), (2, 0, 0, False), (2, 0, 0, False)]
    assert got(tokencounts.token_counts(none, BYTE)) == []


def test_other_vocabularies_are_refused(none):
    with pytest.raises(ValueError):
        tokencounts.token_counts(none, public_tokenizers.path("word_bpe_49k.json"))


def test_distinct_pieces_are_encoded_once(spark):
    docs = spark.createDataFrame([(i, "the same words", "en", 1) for i in range(50)], SCHEMA)
    lists = tokencounts.frequency_lists(docs.coalesce(1), BYTE)
    assert lists.selectExpr("explode(pieces) AS p").count() == 3
    assert tokencounts.piece_counts(lists.unionByName(lists).selectExpr("explode(pieces) AS piece"), BYTE).count() == 3
