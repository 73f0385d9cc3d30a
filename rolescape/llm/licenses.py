"""License scans by diagonal voting, in DataFrame operations only.

Every rolling word k-gram of a document is hashed and joined to the positions of the same k-gram in a small fixed
set of license notices. Matches of one notice lie on a diagonal, document position minus notice position; a word
left out or added moves to a neighbouring diagonal. Votes are counted by diagonal, neighbouring diagonals are
merged, and a span counts when the notice's words it really holds cover enough of the notice and the span is not
much longer than the notice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Public license notices, by label. Their number and length bound the broadcast side of the join.
NOTICES = {
    "apache-2.0": [
        "licensed under the apache license version 2.0",
        "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ],
    "mit": [
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    ],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "gpl": [
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    ],
    "mpl-2.0": ["this source code form is subject to the terms of the mozilla public license v 2.0"],
    "cc-by-nc": ["licensed under cc by nc 4.0"],
    "cc-by-sa": ["licensed under cc by sa 4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license"],
    "cc-by": ["licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"],
    "public-domain": ["this work is dedicated to the public domain", "this is free and unencumbered software released into the public domain"],
}
GRAM = 3
#: Diagonals at most so far apart belong to one span: as many words may be left out or added between two matches.
NEAR = 3
#: Share of a notice's words that a span must hold, and how much longer than the notice it may be.
COVER = 0.8
STRETCH = 1.5

SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words(text: Column) -> Column:
    """The words of a text with A-Z lower-cased, as an array; null or empty text: none."""
    # full lower-casing changes no word boundary, as every character beyond ASCII is part of a word before and after,
    # and no base phrase has a letter that one of them becomes; it is several times faster than a translation of A-Z
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def gram_hashes(w: Column, k: int = GRAM) -> Column:
    """The hash of every k-gram of an array of words, in order."""
    starts = F.when(F.size(w) >= k, F.sequence(F.lit(0), F.size(w) - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))


def said_grams(w: Column, hashed: Column, hashes: list[int], k: int = GRAM) -> Column:
    """(at, hash, words) of the k-grams whose hash is one of some: empty for most texts."""
    places = F.when(F.size(hashed) > 0, F.sequence(F.lit(0), F.size(hashed) - 1)).otherwise(F.array().cast("array<int>"))
    met = F.filter(places, lambda i: F.get(hashed, i).isin(*hashes))
    return F.transform(met, lambda i: F.struct(i.alias("at"), F.get(hashed, i).alias("hash"), F.concat_ws(" ", *[F.get(w, i + j) for j in range(k)]).alias("words")))


def notices(spark: SparkSession, texts: dict[str, list[str]] | None = None) -> DataFrame:
    """label, notice, n (words), tpos, hash, gram for every k-gram of the notices."""
    rows = [(label, i, x) for i, (label, x) in enumerate((label, x) for label, xs in (texts or NOTICES).items() for x in xs)]
    df = spark.createDataFrame(rows, "label string, notice int, body string").withColumn("w", words(F.col("body")))
    df = df.select("label", "notice", F.size("w").alias("n"), "w", F.posexplode_outer(gram_hashes(F.col("w"))).alias("tpos", "hash"))
    return df.select("label", "notice", "n", "tpos", "hash", F.concat_ws(" ", F.slice("w", F.col("tpos") + 1, GRAM)).alias("gram"))


def phrase_places(w: Column, phrase: str) -> Column:
    """Starts of a phrase's words standing consecutively, as an array of ints."""
    parts = phrase.split(" ")
    starts = F.when(F.size(w) >= len(parts), F.sequence(F.lit(0), F.size(w) - len(parts))).otherwise(F.array().cast("array<int>"))
    hit = lambda i: reduce(lambda a, b: a & b, [F.get(w, i + j) == p for j, p in enumerate(parts)])
    return F.when(F.array_contains(w, parts[0]), F.filter(starts, hit)).otherwise(F.array().cast("array<int>"))


def scan(docs: DataFrame, texts: dict[str, list[str]] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of docs.

    labels are the base labels and those of notices with a verified span; score is the largest share of a notice
    that such a span holds (1 for a base phrase, 0 without either). A null text is empty: no words, no labels, score
    0. Rows that repeat key and text get the same result each; null keys are carried through. An empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    base = docs.select(docs[key].cast("long").alias("key"), F.xxhash64(F.coalesce(docs[text], F.lit(""))).alias("text_key"), words(docs[text]).alias("w"))
    found = base.select("key", "text_key", F.size("w").cast("long").alias("n_words"), *[phrase_places(F.col("w"), p).alias(f"p{i}") for i, p in enumerate(BASE)])
    places = F.concat(*[F.col(f"p{i}") for i in range(len(BASE))])
    base_labels = F.filter(F.array(*[F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, label in enumerate(BASE.values())]), lambda x: x.isNotNull())
    found = found.select("key", "text_key", "n_words", F.size(places).cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"), base_labels.alias("base"))

    known = notices(spark, texts)
    # the notices are a constant of a few hundred rows; a gram's words go along only where its hash is one of theirs
    hashes = [r["hash"] for r in known.select("hash").distinct().collect()]
    hashed = base.select("key", "text_key", "w", gram_hashes(F.col("w")).alias("hashes"))
    # the outer form: for the inner one Spark infers a filter on the array size, under which it would split each text again
    grams = hashed.select("key", "text_key", F.explode_outer(said_grams(F.col("w"), F.col("hashes"), hashes)).alias("g"))
    grams = grams.select("key", "text_key", F.col("g.at").alias("pos"), F.col("g.hash").alias("hash"), F.col("g.words").alias("gram"))
    met = grams.join(F.broadcast(known), ["hash", "gram"])
    # a set of notice positions on each diagonal: rows that repeat a document add nothing, and a notice bounds the set
    votes = met.groupBy("key", "text_key", "label", "notice", "n", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.collect_set("tpos").alias("at"))
    along = Window.partitionBy("key", "text_key", "label", "notice").orderBy("diagonal")
    merged = votes.withColumn("new", (F.col("diagonal") - F.coalesce(F.lag("diagonal").over(along), F.lit(-(1 << 30))) > NEAR).cast("int")).withColumn("span", F.sum("new").over(along))
    ends = merged.groupBy("key", "text_key", "label", "notice", "n", "span").agg(F.flatten(F.collect_list("at")).alias("at"), F.min(F.col("diagonal") + F.array_min("at")).alias("first"), F.max(F.col("diagonal") + F.array_max("at") + GRAM).alias("last"))
    held = F.size(F.array_distinct(F.flatten(F.transform("at", lambda t: F.sequence(t, t + GRAM - 1)))))
    spans = ends.withColumn("share", held / F.col("n")).where((F.col("share") >= COVER) & (F.col("last") - F.col("first") <= STRETCH * F.col("n")))
    named = spans.groupBy("key", "text_key").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))

    r = named.select(F.col("key").alias("k"), F.col("text_key").alias("t"), "more", "share")
    out = found.join(r, found["key"].eqNullSafe(r["k"]) & (found["text_key"] == r["t"]), "left")
    none = F.array().cast("array<string>")
    return out.select(
        F.col("key").alias(key), "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).cast("double").alias("score"),
    )
