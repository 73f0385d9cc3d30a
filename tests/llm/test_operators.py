"""Every operator on hard rows against a plain brute-force version, with clashing columns and on an empty table."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rolescape.llm import automaton, bpe, classifier, fingerprints, jaccard, licenses, packing, rules, sharding, suffixes, tokenfile
from tests.llm.conftest import rows

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
SPLIT = re.compile("[^\x20\x09-\x0d]+")


def got(df):
    return [tuple(r) for r in df.collect()]


def ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_packing_places_every_piece_once(clashing, none):
    out = packing.pack(clashing, WORD).toPandas()
    tokenizer = Tokenizer.from_file(WORD)
    want = Counter()
    for k, x, *_ in rows():
        t = np.array([*ids(tokenizer, x), packing.END_ID], "<u4")
        for p, a in enumerate(range(0, len(t), 2048)):
            want[k, p, a, len(t[a : a + 2048]), zlib.crc32(t[a : a + 2048].tobytes())] += 1
    have = Counter((None if r.doc_id != r.doc_id else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in out.itertuples())
    assert have == want
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g["offset"] == g["length"].cumsum() - g["length"]).all() and g["length"].sum() <= 2048
    assert got(packing.pack(none, WORD)) == []


def test_minimum_bin_slack_is_close_to_the_bound():
    rng = random.Random(1)
    histogram = Counter(min(2048, max(1, int(rng.lognormvariate(6, 1.2)))) for _ in range(20000))
    plan = packing.minimum_bin_slack(dict(histogram))
    placed = Counter()
    for c in plan:
        assert sum(n * k for n, k in c.parts) <= 2048
        for n, k in c.parts:
            placed[n] += k * c.bins
    assert placed == histogram
    assert sum(c.bins for c in plan) <= -(-sum(n * k for n, k in histogram.items()) // 2048) * 1.01 + 1
    assert packing.fullest(10, [7, 5, 4], {7: 1, 5: 1, 4: 2}) == [(5, 1), (4, 1)]
    assert packing.minimum_bin_slack({}) == []
    with pytest.raises(ValueError):
        packing.minimum_bin_slack({2049: 1})


def test_fingerprints(clashing, none):
    out = fingerprints.fingerprints(clashing).toPandas()
    order = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    want = Counter()
    for i, (k, x, *_) in enumerate(order):
        x, y = x or "", order[(i + 1) % len(order)][1] or ""
        n = len(x) // 3
        e = x[: len(x) - n] + y[:n] if n else x
        want[k, len(x), hashlib.sha256(e.encode()).hexdigest()] += 1
    assert Counter((None if r.doc_id != r.doc_id else int(r.doc_id), r.n_chars, r.edited_sha256) for r in out.itertuples()) == want
    text_of = {r[0]: r[1] or "" for r in rows() if r[0] != 8}
    marks = defaultdict(set)
    for r in out.itertuples():
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and r.kept_prefix >= r.n_chars - r.n_chars // 3
        if r.doc_id in text_of:
            marks[text_of[r.doc_id]].add(r.fingerprint)
    assert all(len(m) == 1 for m in marks.values()) and len({next(iter(m)) for m in marks.values()}) == len(marks)
    assert got(fingerprints.fingerprints(none)) == []


def test_fingerprints_of_short_texts_are_alike(spark):
    # each text is edited with the one below it
    texts = [chr(65 + n) * 3 + "".join(chr(97 + (i * i + n) % 26) for i in range(n)) for n in range(0, 34)]
    out = fingerprints.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert all(r["near_edited"] > 0 for r in out.collect())
    pair = spark.createDataFrame([(1, "a short text"), (2, "a short text!"), (3, "a short text! " + "and words of a longer one " * 4)], "doc_id long, text string")
    near = {r["doc_id"]: r["near_next"] for r in fingerprints.fingerprints(pair).collect()}
    assert near[2] == 11 / 12 and near[3] > 0 and near[1] > 0


def test_likeness_across_widths_is_the_share_of_the_shorter_ones_spans():
    rng = random.Random(10)
    for n, m in [(1, 1), (2, 5), (3, 80), (5, 6), (6, 23), (23, 24), (40, 71), (60, 72), (71, 72), (72, 73)]:
        a = "".join(rng.choice("abc") for _ in range(n))
        b = (a + "".join(rng.choice("abc") for _ in range(m)))[:m]
        p, q = fingerprints.Prefixes(a), fingerprints.Prefixes(b)
        w = fingerprints.span_width(min(n, m))
        x, y = ({t[i : i + w] for i in range(len(t) - w + 1)} for t in (a, b))
        found = fingerprints.alike(p, p.sketch(), q, q.sketch())
        assert found == fingerprints.alike(q, q.sketch(), p, p.sketch()) > 0
        if len(x | y) <= fingerprints.KEPT:
            assert found == len(x & y) / len(x | y)


def test_prefix_hashes_answer_spans_and_extensions():
    rng = random.Random(2)
    a = "".join(rng.choice("ab") for _ in range(400))
    b = a[50:300] + "x" + a[:100]
    p, q = fingerprints.Prefixes(a), fingerprints.Prefixes(b)
    for _ in range(200):
        i, j, n = rng.randrange(400), rng.randrange(350), rng.randrange(40)
        assert p.equal(i, q, j, n) == (i + n <= len(a) and j + n <= len(b) and a[i : i + n] == b[j : j + n])
        k = 0
        while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
            k += 1
        assert p.common_extension(i, q, j) == k
    assert p.common_extension(50, q, 0) == 250
    mark, sketch = fingerprints.fingerprint(p)
    assert (fingerprints.parse(mark)[1] == sketch).all() and fingerprints.likeness(sketch, sketch) == 1


def counts(text):
    w = SPLIT.findall(text or "")
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    marked = {i + j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if SPLIT.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(marked)


def test_quality_rules(clashing, none):
    out = got(rules.quality_rules(clashing).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"))
    want = Counter()
    for k, x, *_ in rows():
        c = counts(x)
        want[k, *c, c[0] < 50 or 100 * c[4] > 50 * c[0]] += 1
    assert Counter(r[:-1] for r in out) == want
    assert not any(r[-2] and r[-1] for r in out)
    assert {r[0]: r[-1] for r in out}[15] is False
    kept = sorted(r[0] for r in rules.passing(clashing).select("doc_id").collect() if r[0] is not None)
    assert kept == sorted(r[0] for r in out if r[-1] and r[0] is not None)
    assert got(rules.quality_rules(none)) == [] and got(rules.passing(none)) == []


def test_compression_bands_reject_repetition_and_noise():
    import zstandard

    z, b, rng = zstandard.ZstdCompressor(level=3), rules.Bands(), random.Random(3)
    noise = bytes(rng.randrange(33, 127) for _ in range(9000))
    assert not rules.verdict(("again and " * 500).encode(), b, z)[3]
    assert not rules.verdict(noise, b, z)[3]
    assert rules.verdict(b"", b, z)[3]


def brute_removed(items):
    first = {}
    order = sorted(items, key=lambda r: (r[0] is None, r[0] or 0))
    for k, x in order:
        raw = (x or "").encode()
        for i in range(len(raw) - 49):
            first.setdefault(raw[i : i + 50], k)
    out = []
    for k, x in items:
        raw = (x or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 49):
            f = first[raw[i : i + 50]]
            if f != k and (k is None or f is not None and f < k):
                gone[i : i + 50] = b"\1" * 50
        left = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        out.append((k, len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(left).hexdigest()))
    return out


def test_suffix_dedup(clashing, none):
    want = brute_removed([(k, x) for k, x, *_ in rows()])
    assert Counter(got(suffixes.digest(clashing))) == Counter(want)
    cleaned = suffixes.clean(clashing)
    assert cleaned.columns == clashing.columns
    assert {r["doc_id"]: r["text"] for r in cleaned.collect()}[8] == ""
    assert got(suffixes.digest(none)) == [] and got(suffixes.clean(none)) == []


def test_suffix_dedup_on_many_small_texts(spark):
    rng = random.Random(4)
    pool = ["".join(rng.choice("ab ") for _ in range(rng.randrange(20, 120))) for _ in range(30)]
    items = [(rng.randrange(60), "".join(rng.choice(pool) for _ in range(rng.randrange(4)))) for _ in range(80)]
    df = spark.createDataFrame(items, "doc_id long, text string").repartition(5)
    assert Counter(got(suffixes.digest(df))) == Counter(brute_removed(items))


def brute_anchors(data, ends, bits):
    """(anchor's place, first window, last window), each window looked at by itself."""
    names = suffixes.gram_names(data) >> np.uint64(bits)
    out = []
    for w in range(len(data) - suffixes.WIDTH + 1):
        if not any(w < e < w + suffixes.WIDTH for e in ends):
            at = w + int(np.argmin(names[w : w + suffixes.WIDTH - suffixes.GRAM + 1]))
            if out and out[-1][0] == at and out[-1][2] == w - 1:
                out[-1][2] = w
            else:
                out.append([at, w, w])
    return out


@pytest.mark.parametrize(("bits", "part"), [(28, 1 << 24), (9, 1 << 24), (28, 1), (28, 100), (12, 333)])
def test_anchors_of_data_longer_than_a_place_reaches(monkeypatch, bits, part):
    monkeypatch.setattr(suffixes, "PLACE_BITS", np.uint64(bits))
    monkeypatch.setattr(suffixes, "PART", part, raising=False)
    rng = random.Random(9)
    passage = bytes(rng.randrange(256) for _ in range(130))
    data = np.frombuffer(passage + bytes(rng.choice(b"ab") for _ in range(5000)) + passage + b"z" * 300, np.uint8)
    ends = np.array([130, 140, 140, 1900, len(data)])
    name, first, last = suffixes.anchors(data, ends)
    want = brute_anchors(data, ends.tolist(), bits)
    assert list(zip(first.tolist(), last.tolist(), strict=True)) == [(a, b) for _, a, b in want]
    grams = [data[at : at + suffixes.GRAM].tobytes() for at, _, _ in want]
    assert len(set(zip(grams, name.tolist(), strict=True))) == len(set(grams)) == len(set(name.tolist()))


@pytest.mark.parametrize("data", [b"", b"a", b"abcabcabcabcabcabcabcabcabcabcabcabcabcabcabcabcabcabcabcabc" * 3])
def test_refinement_names_equal_prefixes(data):
    a = np.frombuffer(data, np.uint8)
    if len(a):
        bucket = suffixes.refined(a)
        padded = data + b"\0" * 50
        for i in range(len(data)):
            for j in range(len(data)):
                assert (bucket[i] == bucket[j]) == (padded[i : i + 50] == padded[j : j + 50])


def test_classifier_learns_and_scores_every_row(spark, clashing, none):
    rng = random.Random(6)
    items = [(i, " ".join(rng.choice(("good", "plain", "words", "here")) for _ in range(60)) if i % 2 else " ".join(rng.choice(("!!", "$$$", "XX!!")) for _ in range(60))) for i in range(400)]
    df = spark.createDataFrame(items, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i, _ in items], "doc_id long, quality int, toxic int")
    net = classifier.fit(df, labels, rows=100)
    out = classifier.classify(df, net).toPandas()
    held = out[out.held_out]
    assert len(held) and ((held.predicted == 1) == (held.doc_id % 2 == 1)).mean() > 0.95
    assert (out.held_out == [zlib.crc32(str(k).encode()) % 4 == 2 for k in out.doc_id]).all()
    hard = got(classifier.classify(clashing, net))
    assert len(hard) == len(rows()) and all(0 <= r[2] <= 1 and r[3] == int(r[2] >= 0.7) for r in hard)
    untrained = classifier.fit(none, labels.limit(0))
    assert untrained.score("anything") == 0.5 and got(classifier.classify(none, untrained)) == []
    assert classifier.good(clashing, net).columns == clashing.columns


def forward(net, raw):
    """The network's score by its definition, in plain loops: every window, every chunk."""
    data = list(raw) + [0] * classifier.WIDTH
    n = max(2, -(-len(raw) // classifier.HALF)) * classifier.HALF
    data += [0] * (n + classifier.WIDTH - len(data))
    out = [sum(net.tables[j][data[i + j]].astype(float) for j in range(classifier.WIDTH)) for i in range(n)]
    chunks = [np.maximum(np.max(out[a : a + classifier.CHUNK], axis=0) + net.bias, 0) for a in range(0, n - classifier.CHUNK + 1, classifier.HALF)]
    z = np.concatenate([np.mean(chunks, axis=0), np.max(chunks, axis=0), np.min(chunks, axis=0)]) @ net.weights.astype(float) + net.offset
    return 1 / (1 + np.exp(-z))


def test_scores_are_those_of_a_plain_forward_pass():
    rng = random.Random(14)
    net = classifier.train([(bytes(rng.randrange(97 + 10 * y, 110 + 10 * y) for _ in range(rng.randrange(1, 1500))), y) for y in (0, 1) * 20], epochs=1)
    for n in (0, 1, 5, 255, 256, 257, 511, 512, 513, 1024, 3000, 40_000):
        text = "".join(rng.choice("abcdefghé \n") for _ in range(n))
        assert abs(net.score(text) - forward(net, text.encode())) < 1e-4


def test_classifier_trains_on_defined_rows_and_whole_texts(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(classifier, "train", lambda rows: seen.extend(rows))
    monkeypatch.setattr(classifier, "SAMPLE_BYTES", 50_000)
    # 3 has both labels, 4 two texts, 5 a null text, 7 is too long, 9 unlabelled
    docs = spark.createDataFrame([(1, "a" * 40_000), (3, "c"), (4, "z"), (4, "d"), (5, None), (7, "x" * 50_001), (9, "q"), (None, "n")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, 1), (4, 0), (4, 0), (5, 1), (7, 1), (None, 1), (11, 0), (1, 7)], "doc_id long, quality int")
    classifier.fit(docs, labels)
    want = [(k, x, y) for k, x, y in ((1, b"a" * 40_000, 1), (4, b"d", 0), (5, b"", 1)) if classifier.fold(k) != classifier.HELD_OUT]
    assert seen == [(x, y) for _, x, y in want] and len(want) >= 2


def test_bpe_equals_the_library(clashing, none):
    tokenizer = Tokenizer.from_file(BYTE)
    want = Counter()
    for k, x, *_ in rows():
        t = ids(tokenizer, x)
        want[k, len(t), hashlib.sha256(",".join(map(str, t)).encode()).hexdigest(), hashlib.sha256(tokenizer.decode(t, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(got(bpe.digests(clashing, BYTE))) == want
    assert got(bpe.digests(none, BYTE)) == []
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(clashing, BYTE), BYTE).collect()}
    assert back[12] == dict((r[0], r[1]) for r in rows())[12]


def test_automaton_against_merging_by_rank():
    rng = random.Random(7)
    for _ in range(30):
        labels = {0: b"a", 1: b"b", 2: b"c"}
        merges = []
        while len(merges) < 25:
            x, y = rng.choice(list(labels)), rng.choice(list(labels))
            if labels[x] + labels[y] in labels.values() or len(labels[x] + labels[y]) > 8:
                continue
            made = len(labels)
            # a merge that its own parts' merges would always forestall isn't part of a trained list
            machine = automaton.Automaton(dict(labels), list(merges))
            if machine.encode(labels[x] + labels[y]) != [x, y]:
                continue
            labels[made] = labels[x] + labels[y]
            merges.append((x, y, made))
        machine = automaton.Automaton(labels, merges)
        rank = {(x, y): (r, made) for r, (x, y, made) in enumerate(merges)}
        for _ in range(60):
            word = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 24)))
            t = [b - 97 for b in word]
            while hits := [(rank[p][0], i) for i, p in enumerate(zip(t, t[1:], strict=False)) if p in rank]:
                _, i = min(hits)
                t[i : i + 2] = [rank[t[i], t[i + 1]][1]]
            assert machine.encode(word) == t


def test_token_files_round_trip(clashing, none):
    out = got(tokenfile.round_trip(clashing, WORD))
    tokenizer = Tokenizer.from_file(WORD)
    order = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, start = Counter(), 0
    for k, x, *_ in order:
        t = np.array([*ids(tokenizer, x), tokenfile.END_ID], "<u4")
        want[k, start, len(t), zlib.crc32(t.tobytes())] += 1
        start += len(t)
    assert Counter(out) == want
    assert got(tokenfile.round_trip(none, WORD)) == []


def test_token_files_are_read_by_select(monkeypatch):
    keys, lengths = [None, None, -7, 3, 3, *range(10, 700)], [1 + i * i % 17 for i in range(695)]
    ids = np.arange(sum(lengths)).astype("<u2")
    file = tokenfile.TokenFile(tokenfile.file_image(keys, lengths, ids.tobytes(), 2))
    starts = np.concatenate([[0], np.cumsum(lengths)]).tolist()
    # every document is found without the scan that all() is
    monkeypatch.delattr(tokenfile.EliasFano, "all")
    assert [(k, a, x.tolist()) for k, a, x in file.documents()] == [(k, a, ids[a:b].tolist()) for k, a, b in zip(keys, starts[:-1], starts[1:], strict=True)]
    assert all(file.key(i) == k and (file.document(i) == ids[starts[i] : starts[i + 1]]).all() for i, k in enumerate(keys))


@pytest.mark.parametrize(("n", "top"), [(1, 0), (1, 9), (5, 3), (1000, 10), (1000, 10**6), (3000, 10**12)])
def test_elias_fano_selects(n, top):
    v = np.sort(np.random.default_rng(n).integers(0, top + 1, n))
    e = tokenfile.EliasFano.load(tokenfile.EliasFano.build(v).dump())
    assert (e.all() == v).all() and all(e.select(i) == v[i] for i in range(n))
    assert 8 * (len(e.low) + len(e.high)) <= n * (3 + max(0, top // n).bit_length()) + 16
    with pytest.raises(IndexError):
        e.select(n)


def brute_components(items):
    sets = []
    for _, x in items:
        w = SPLIT.findall((x or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    parent = list(range(len(items)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i in range(len(items)):
        groups[root(i)].append(items[i][0])
    low = {r: min((k for k in ks if k is not None), default=None) for r, ks in groups.items()}
    return Counter((items[i][0], len(sets[i]), low[root(i)]) for i in range(len(items)))


def test_jaccard_join(clashing, none):
    assert Counter(got(jaccard.near_duplicates(clashing))) == brute_components([(k, x) for k, x, *_ in rows()])
    kept = jaccard.representatives(clashing)
    assert kept.columns == clashing.columns and sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] in (7, 8, 10, 11)) == [7, 10]
    assert got(jaccard.near_duplicates(none)) == [] and got(jaccard.representatives(none)) == []


def test_texts_of_several_megabytes(spark):
    rng = random.Random(17)
    vocabulary = [f"w{i}" for i in range(30_000)]
    long = " ".join(rng.choice(vocabulary) for _ in range(600_000))
    near = long[: len(long) // 2] + " changed " + long[len(long) // 2 :]
    items = [(1, long), (2, near), (3, "x" * 3_000_000), (4, "short text of a few words"), (5, long[1_000_000:1_002_000])]
    df = spark.createDataFrame(items, "doc_id long, text string").repartition(2)
    assert [len(x) > 3_000_000 for _, x in items[:2]] == [True, True]
    assert {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    cut = {r["doc_id"]: r for r in suffixes.digest(df).collect()}
    assert cut[1]["n_removed"] == 0 and cut[2]["n_removed"] >= cut[2]["n_bytes"] - 20 and cut[3]["n_removed"] == 0 and cut[5]["n_removed"] == 2000
    assert {r["doc_id"]: r["n_chars"] for r in fingerprints.fingerprints(df).collect()} == {k: len(x) for k, x in items}


def test_jaccard_join_on_families_near_the_threshold(spark):
    rng = random.Random(8)
    items = []
    for family in range(12):
        base = [f"f{family}w{rng.randrange(900)}" for _ in range(rng.choice((7, 12, 40, 150, 400)))]
        for _ in range(rng.randrange(1, 14)):
            copy = list(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 18) + 1)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            items.append((len(items), " ".join(copy + ["common", "closing", "words", "of", "every", "single", "text"])))
    df = spark.createDataFrame(items, "doc_id long, text string").repartition(6)
    assert Counter(got(jaccard.near_duplicates(df))) == brute_components(items)


def side_of(sets, name):
    """A block's side table whose sets all stand under one name, each in its own band."""
    sizes = np.array([len(x) for x in sets])
    n, o = np.full(len(sets), name, np.uint64), np.arange(len(sets))
    return jaccard.Side(0, jaccard.squeeze(o.astype("<i8").tobytes(), sizes.astype("<u4").tobytes(), jaccard.pack_names(n), o.astype("<u4").tobytes(), np.zeros(len(sets), np.uint8).tobytes()))


def met(side, sets, nearest=False, first=False):
    marks = np.frombuffer(b"".join(jaccard.digests(np.concatenate(sets), side.sizes)), "V16")
    drawn = {(i, int(b)): jaccard.sketch(sets[i], int(b), not first) for i, b in enumerate(side.bands)}
    sent = jaccard.group_blobs(side, side.names, side.owners, side.bands, np.zeros(len(sets), int), None if first else side.place(np.arange(len(sets))), marks if first else None, drawn)
    rows = [r for batch in sent for r in batch.to_pylist()]
    return {(r["a"], r["b"]) for batch in jaccard.pairs_of_bucket(rows, nearest) for r in batch.to_pylist()}


@pytest.mark.parametrize("intruders", [[300], [260], [700], [300, 300], [3000], [100, 250, 640, 5000]])
def test_a_name_that_sets_of_several_bands_share_by_chance_loses_no_pair(intruders):
    rng = np.random.default_rng(11)
    a = np.sort(rng.integers(0, 1 << 63, 400).astype(np.uint64))
    b = np.sort(np.concatenate([a[:380], rng.integers(0, 1 << 63, 15).astype(np.uint64)]))
    sets = [a, *[np.sort(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in intruders], b]
    side = side_of(sets, 1 << 40)
    pair = {(0, len(sets) - 1)}
    assert met(side, sets) == met(side, sets, nearest=True) == pair
    assert {tuple(sorted(x)) for x in met(side, sets, first=True)} == pair


def test_hot_names_are_cut_so_that_every_two_sets_still_meet(monkeypatch):
    monkeypatch.setattr(jaccard, "HOT", 7)
    names = np.array([3] * 2 + [5] * 23 + [9] * 4, np.uint64) << np.uint64(16)
    wanted = np.array([3, 5, 9], np.uint64) << np.uint64(16)
    # the name's first sets lie in an earlier block
    which, out, to = jaccard.chunked(names, wanted, np.array([0, 5, 0]), np.array([0, 12, 0]), np.array([1, 0, 2]), 4)
    groups = defaultdict(set)
    for i, n in zip(which.tolist(), out.tolist(), strict=True):
        groups[n].add(i)
    assert all(len(set(to[out == n].tolist())) == 1 for n in groups) and set(to[which < 2].tolist()) == {1} and set(to[which > 24].tolist()) == {2}
    assert all(any({i, j} <= g for g in groups.values()) for i in range(2, 25) for j in range(2, i))
    assert groups[3 << 16] == {0, 1} and groups[9 << 16] == {25, 26, 27, 28}
    assert max(map(len, groups.values())) <= 14


def test_hot_names_give_the_same_pairs(monkeypatch, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    rng = random.Random(12)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    texts = []
    for _ in range(40):
        copy = list(base)
        for _ in range(rng.randrange(1, 4)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    file = str(tmp_path / "block.parquet")
    pq.write_table(pa.table({"doc_id": list(range(40)), "text": texts}), file)
    shared, _ = jaccard.names_of_block(file, "doc_id", "text")
    side = jaccard.Side(0, next(iter(jaccard.side_table(0, file, shared, 1, "doc_id", "text"))).column("side")[0].as_py())
    roots = side.place(np.arange(40))

    def pairs(hot, few=None):
        monkeypatch.setattr(jaccard, "HOT", hot)
        named = [r for batch in jaccard.named_roots(side, roots, 1) for r in batch.to_pylist()]
        answers = [names for _, names in jaccard.open_names(named, 1)]
        rows = [r for batch in jaccard.later_groups(side, file, roots, answers, few, 1, "doc_id", "text") for r in batch.to_pylist()]
        return {tuple(sorted((r["a"], r["b"]))) for batch in jaccard.pairs_of_bucket(rows, few is not None) for r in batch.to_pylist()}

    sets = [set(jaccard.shingle_set(x).tolist()) for x in texts]
    linked = {(i, j) for j in range(40) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert pairs(5) == pairs(1 << 20) >= linked and len(linked) > 50
    # the second round gives a few pairs for each set
    assert 0 < len(pairs(1 << 20, 2)) <= 2 * 40 and pairs(1 << 20, 2) <= pairs(1 << 20)


def test_a_forest_has_the_components_of_all_edges():
    rng = np.random.default_rng(13)
    a, b = rng.integers(0, 300, (2, 400))
    use = jaccard.forest(a, b)

    def parts(x, y):
        root = {i: i for i in {*a.tolist(), *b.tolist()}}
        for _ in range(300):
            for i, j in zip(x.tolist(), y.tolist(), strict=True):
                root[i] = root[j] = min(root[i], root[j])
        return root

    assert parts(a[use], b[use]) == parts(a, b) and use.sum() < 300


def test_word_hashes_are_those_of_the_words():
    texts = ["a B c", "", None, " x\ty ", "A", "longword" * 50 + " q", "é ß ABCDEFGHI abcdefghi ABCDEFGH", "\x0b\x0c", "abc"]
    hashes, n = jaccard.word_hashes(texts)
    words = [x for t in texts for x in (t or "").encode().lower().split()]
    assert n.tolist() == [len((t or "").encode().lower().split()) for t in texts]
    known = dict(zip(words, hashes.tolist(), strict=True))
    assert [known[w] for w in words] == hashes.tolist() and len(set(known.values())) == len(known)


def test_jump_shards(clashing, none):
    out = sharding.shard(clashing, 40).toPandas()
    assert Counter(zip(out["size"], out["text_crc32"], strict=True)) == Counter((len((x or "").encode()) + 16, zlib.crc32((x or "").encode())) for _, x, *_ in rows())
    assert out["shard"].between(0, 39).all() and (out["grown_shard"].isin([40]) | (out["grown_shard"] == out["shard"])).all()
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    assert got(sharding.shard(none, 40)) == []


def test_jump_hash_is_the_scalar_one():
    def scalar(key, shards):
        b, j = -1, 0
        while j < shards:
            b = j
            key = (key * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
        return b

    keys = np.random.default_rng(15).integers(0, 1 << 63, 500).astype(np.uint64)
    for shards in (1, 2, 40, 41, 1000):
        assert sharding.jump_hash(keys, shards).tolist() == [scalar(k, shards) for k in sharding.mixed(keys).tolist()]


def test_jump_hash_moves_the_necessary_share():
    keys = np.arange(200_000).astype(np.uint64)
    a, b = sharding.jump_hash(keys, 40), sharding.jump_hash(keys, 41)
    moved = a != b
    assert (b[moved] == 40).all() and abs(moved.mean() - 1 / 41) < 0.003
    size = np.bincount(a, minlength=40)
    assert size.max() < 1.06 * size.mean() and size.min() > 0.94 * size.mean()


def brute_scan(text):
    """Base columns and labels by looking at every place: a notice counts where one of its diagonals' words hold enough of it."""
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    at = sorted((i, label) for phrase, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())
    base = {label for _, label in at}
    labels, best = set(base), 1.0 if at else 0.0
    for label, notices in licenses.NOTICES.items():
        for notice in notices:
            t = re.findall("[a-z0-9]+", notice)
            votes = defaultdict(set)
            for i in range(len(w) - 2):
                for j in range(len(t) - 2):
                    if w[i : i + 3] == t[j : j + 3]:
                        votes[i - j].add(j)
            spans, last = [], None
            for d in sorted(votes):
                if last is None or d - last > licenses.NEAR:
                    spans.append([])
                spans[-1].append(d)
                last = d
            for span in spans:
                held = {j + k for d in span for j in votes[d] for k in range(3)}
                length = max(d + max(votes[d]) + 3 for d in span) - min(d + min(votes[d]) for d in span)
                if len(held) / len(t) >= licenses.COVER and length <= licenses.STRETCH * len(t):
                    labels.add(label)
                    best = max(best, len(held) / len(t))
    return len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted(base)), ",".join(sorted(labels)), best if not at else 1.0


def test_license_scan_equals_a_look_at_every_place(spark):
    rng = random.Random(16)
    notices = [n for x in licenses.NOTICES.values() for n in x]
    texts = [None, "", "CC BY cc by. General Public License"]
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            n = rng.choice(notices).split()
            for _ in range(rng.randrange(0, 4)):
                i = rng.randrange(len(n))
                n[i : i + 1] = rng.choice(([], [n[i], "so"], ["other"], [n[i].upper()]))
            parts += [" ".join(n), " ".join(rng.choice(("the", "software", "all rights reserved", "cc", "by")) for _ in range(rng.randrange(9)))]
        texts.append(rng.choice((" ", ", ", "\n")).join(parts))
    texts.append(" ".join([notices[0]] * 3000))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in licenses.scan(df).collect():
        if r["doc_id"] < len(texts) - 1:
            want = brute_scan(texts[r["doc_id"]])
            assert tuple(r)[1:-1] == want[:-1] and abs(r["score"] - want[-1]) < 1e-9
        else:
            assert r["n_words"] == 24000 and r["labels"] == "apache-2.0"


def test_license_scan(spark, clashing, none):
    gpl = "This work is licensed under the GNU General Public License, version 3."
    texts = [gpl, "Licensed under CC BY-NC 4.0. All rights  reserved.", "this work is truly licensed under the gnu general public license version 3", "general public opinion on license terms", "x " * 5000 + "Released under the MIT License.", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    assert out[0]["labels"] == "gpl" and (out[0]["n_base"], out[0]["first_word"], out[0]["last_word"]) == (1, 7, 7)
    assert out[1]["base_labels"] == "cc-by,reserved" and out[1]["labels"] == "cc-by,cc-by-nc,reserved" and (out[1]["first_word"], out[1]["last_word"]) == (2, 7)
    assert out[2]["labels"] == "gpl" and out[3]["labels"] == "" and out[3]["score"] == 0
    assert out[4]["labels"] == "mit" and out[4]["n_base"] == 0 and out[4]["first_word"] is None
    assert out[5]["n_words"] == 0 and out[6]["labels"] == ""
    hard = got(licenses.scan(clashing).select("doc_id", "n_words"))
    want = Counter((k, len(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (x or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))))) for k, x, *_ in rows())
    assert Counter(hard) == want and got(licenses.scan(none)) == []
