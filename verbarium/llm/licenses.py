"""License scans: named phrases, and an exact set-similarity join with license templates.

Notices may be wrapped at any width. A text block is the longest run of lines from a line on whose
inner lines hold no more words than the template has; lines without words, such as blank ones or
lone comment marks, are passed over. A line alone is the shortest such run and holds nothing that
the longest does not. A block meets a template if it holds at least ``CONTAINMENT`` of the
template's different words.

All of it is DataFrame operations. The words of the templates are ordered by the number of
documents that hold them, rarest first. A block that meets a template of n words holds
c = ceil(n * CONTAINMENT) of them, so it has one of the n - c + 1 rarest (prefix filter), at least
c words (length filter), and after its first shared word enough words must be left on both sides
(positional filter). What passes is checked exactly.

Every block that meets a template has a word of the template's prefix in some line. The lines that
may share a block with such a line are tested first, all at once and by the same filters; only
where they meet a template, its blocks are taken one by one. Other lines are not split into words.
Equal texts have equal results, so blocks belong to a text (two hashes of it), not to a doc_id.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbarium.llm.common import staged
from verbarium.llm.rules import let

CONTAINMENT = 0.8

# Phrases and their labels.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

# Public license notices, one line each.
TEMPLATES = {
    "apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-nc-4.0-short": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3-short": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.',
    "mit-short": "Released under the MIT License.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}

# Characters that words consist of: ASCII letters and digits, and all beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
NO_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: str) -> list[str]:
    """Different words of a template, in their order."""
    return list(dict.fromkeys(re.findall(r"[0-9a-z]+", text.lower())))


def needed(n: int, containment: float) -> int:
    # Guards against a product like 0.8 * 5 that is a hair above the whole number.
    return math.ceil(n * containment - 1e-9)


def lowered(text: Column) -> Column:
    """Lower-case text. Beyond ASCII it changes no word's borders; the Kelvin sign, the only
    character there whose lower case is a single ASCII letter, is put out of the way."""
    return F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u0138")))


def canonical(text: Column) -> Column:
    """The words in a row, with one blank before and after each."""
    return F.concat(F.lit(" "), F.btrim(F.regexp_replace(lowered(text), NO_WORD, " ")), F.lit(" "))


def holds_any(text: Column, parts: list[str]) -> Column:
    """Whether one of ``parts`` is somewhere in the text; plain searches, cheaper than a pattern."""
    return reduce(Column.__or__, (text.contains(part) for part in parts), F.lit(False))


def phrase_places(text: Column, phrases: list[tuple[str, str]]) -> Column:
    """Struct of n_base, first_word, last_word and base_labels; null for texts without a phrase."""
    hints = sorted({max(p.split(), key=len) for p, _ in phrases})

    def blanks(s: Column) -> Column:
        return (F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))).cast("long")

    def of_canonical(c: Column) -> Column:
        found = []
        for phrase, label in phrases:
            mark = f" {phrase} "
            first = F.locate(mark, c)
            from_end = F.locate(mark[::-1], F.reverse(c))
            last = F.length(c) - from_end - len(mark) + 2
            entry = F.struct(
                F.regexp_count(c, F.lit(f"(?<= ){phrase}(?= )")).cast("long").alias("n"),
                (blanks(F.substr(c, F.lit(1), first)) - 1).alias("first"),
                (blanks(F.substr(c, F.lit(1), last)) - 1).alias("last"),
                F.lit(label).alias("label"),
            )
            found.append(F.when(first > 0, entry))
        return let(
            F.array_compact(F.array(*found)),
            lambda a: F.when(
                F.size(a) > 0,
                F.struct(
                    F.aggregate(a, F.lit(0).cast("long"), lambda t, x: t + x["n"]).alias("n_base"),
                    F.array_min(F.transform(a, lambda x: x["first"])).alias("first_word"),
                    F.array_max(F.transform(a, lambda x: x["last"])).alias("last_word"),
                    F.transform(a, lambda x: x["label"]).alias("base_labels"),
                ),
            ),
        )

    return F.when(holds_any(lowered(text), hints), let(canonical(text), of_canonical))


def text_keys(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", "text", F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2"))


def array_of(values: list) -> Column:
    return F.array(*map(F.lit, values))


def word_order(texts: DataFrame, words: list[str]) -> list[str]:
    """``words`` by the number of documents that hold them, rarest first.

    One row per template word comes back, whatever the size of the table.
    """
    held = F.array_intersect(F.split(lowered(F.col("text")), NO_WORD), array_of(words))
    counts = texts.select(F.explode(held).alias("word")).groupBy("word").count()
    known = {row["word"]: row["count"] for row in counts.collect()}
    return sorted(words, key=lambda w: (known.get(w, 0), w))


def line_places(texts: DataFrame, signs: list[str], in_line: str, reach: int) -> DataFrame:
    """(k1, k2, near, counts, centre): around each line with a sign the lines that may share a
    block with it, their numbers of words, and its place among them.

    A line that does may be parted from it by inner lines of ``reach`` words at most.
    """
    split = F.filter(F.split(lowered(F.col("text")), "\n"), lambda x: x.rlike(WORD))
    lines = texts.select("k1", "k2", F.when(holds_any(lowered(F.col("text")), signs), split).alias("lines"))
    at = F.array_compact(F.transform("lines", lambda x, i: F.when(x.rlike(in_line), i)))

    def reached(counts: Column) -> Column:
        """How many lines outwards, the first one next to the sign, can share a block with it."""
        start = F.struct(F.lit(0).alias("inner"), F.lit(0).alias("n"))
        step = lambda t, x: F.when(t["inner"] <= reach, F.struct((t["inner"] + x).alias("inner"), (t["n"] + 1).alias("n"))).otherwise(t)
        return F.aggregate(counts, start, step, lambda t: t["n"])

    def around(i: Column) -> Column:
        # Inner lines have a word each, so no more lines than these can be reached.
        first = F.greatest(i - (reach + 1), F.lit(0))
        return F.struct(F.slice("lines", first + 1, i - first + reach + 2).alias("near"), (i - first).alias("centre"))

    # The outer form, as the plain one gets a filter that evaluates the whole array once more.
    marked = lines.select("k1", "k2", F.explode_outer(F.transform(at, around)).alias("place"))
    marked = marked.where("place IS NOT NULL").select("k1", "k2", "place.*")
    counted = marked.withColumn("counts", F.transform("near", lambda x: F.regexp_count(x, F.lit(WORD))))
    left = reached(F.reverse(F.slice("counts", F.lit(1), F.col("centre"))))
    right = reached(F.slice("counts", F.col("centre") + 2, F.size("counts")))
    sided = counted.withColumn("left", left).withColumn("right", right)
    part = lambda c: F.slice(c, F.col("centre") - F.col("left") + 1, F.col("left") + F.col("right") + 1).alias(c)
    return sided.select("k1", "k2", part("near"), part("counts"), F.col("left").alias("centre"))


def shaped(blocks: DataFrame, rank: dict[str, int]) -> DataFrame:
    """``blocks`` with n_words and ranks, the known ones of the words of column ``block``."""
    words = F.array_distinct(F.filter(F.split(F.col("block"), NO_WORD), lambda w: w != ""))
    numbers = F.create_map(*(F.lit(x) for w, i in rank.items() for x in (w, i)))
    known = F.sort_array(F.transform(F.filter(words, lambda w: w.isin(list(rank))), lambda w: F.element_at(numbers, w)))
    return blocks.withColumn("n_words", F.size(words)).withColumn("ranks", known)


def meeting(blocks: DataFrame, index: DataFrame, *kept: str) -> DataFrame:
    """``kept``, template, size and overlap of the shaped ``blocks`` that meet a template."""
    probes = blocks.select(*kept, "n_words", "ranks", F.posexplode("ranks").alias("j", "rank"))
    met = probes.where(F.size("ranks") > 0).join(F.broadcast(index), "rank")
    # Length filter, then what can still be shared from this word on, in template and block.
    met = met.where(F.col("n_words") >= F.col("needed"))
    rest = 1 + F.least(F.col("size") - F.col("i") - 1, F.size("ranks") - F.col("j") - 1)
    met = met.where(rest >= F.col("needed")).withColumn("shared", F.array_intersect("ranks", "all"))
    # A pair counts at its first shared word, which is in the prefix if the pair meets.
    met = met.where((F.size("shared") >= F.col("needed")) & (F.get("shared", F.lit(0)) == F.col("rank")))
    return met.select(*kept, "template", "size", F.size("shared").alias("overlap"))


def blocks_of(met: DataFrame, totals: dict[str, int]) -> DataFrame:
    """(k1, k2, own, block): the blocks for template ``own`` around the signs of ``met``."""
    total = F.element_at(F.create_map(*(F.lit(x) for pair in totals.items() for x in pair)), F.col("template"))
    known = met.select("k1", "k2", "near", "counts", "centre", F.col("template").alias("own"), total.alias("total"))
    first = known.select("*", F.explode(F.sequence(F.lit(0), F.col("centre"))).alias("a"))
    start = F.struct(F.lit(0).alias("inner"), F.lit(0).alias("n"))
    step = lambda t, x: F.when(
        t["inner"] <= F.col("total"), F.struct((t["inner"] + x).alias("inner"), (t["n"] + 1).alias("n"))
    ).otherwise(t)
    more = F.aggregate(F.slice("counts", F.col("a") + 2, F.size("counts")), start, step, lambda t: t["n"])
    whole = first.withColumn("more", more).where(F.col("a") + F.col("more") >= F.col("centre"))
    block = F.array_join(F.slice("near", F.col("a") + 1, F.col("more") + 1), " ")
    return whole.select("k1", "k2", "own", block.alias("block"))


def matching_blocks(texts: DataFrame, templates: dict[str, str], containment: float) -> DataFrame:
    """(k1, k2, template, overlap, size) of all text blocks that meet a template.

    A block comes once for each line with a prefix word in it.
    """
    sets = {name: words_of(text) for name, text in templates.items()}
    order = word_order(texts, sorted(set().union(*sets.values())))
    rank = {w: i for i, w in enumerate(order)}
    ranked = {name: sorted(rank[w] for w in words) for name, words in sets.items()}
    prefix = {name: r[: len(r) - needed(len(r), containment) + 1] for name, r in ranked.items()}
    signs = [order[i] for i in sorted(set().union(*map(set, prefix.values())))]
    sign = "|".join(map(re.escape, sorted(signs)))
    in_line = rf"(?<![0-9a-z\x{{80}}-\x{{10FFFF}}])({sign})(?![0-9a-z\x{{80}}-\x{{10FFFF}}])"
    # The index of prefixes: a fixed small table, known when the plan is built.
    spark = texts.sparkSession
    rows = [(r, name, i, len(ranked[name]), needed(len(ranked[name]), containment), ranked[name])
            for name in sorted(prefix) for i, r in enumerate(prefix[name])]
    index = spark.createDataFrame(rows, "rank int, template string, i int, size int, needed int, all array<int>")
    totals = {name: len(re.findall(r"[0-9a-z]+", text.lower())) for name, text in templates.items()}
    places = line_places(texts, signs, in_line, max(totals.values()))
    near = staged(places, "license-lines").withColumn("block", F.array_join("near", " "))
    met = meeting(shaped(near, rank), index, "k1", "k2", "near", "counts", "centre")
    blocks = shaped(blocks_of(met, totals), rank)
    return meeting(blocks, index, "k1", "k2", "own").where("own = template").drop("own")


def scan(docs: DataFrame, phrases: list[tuple[str, str]] = PHRASES, templates: dict[str, str] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row.

    ``score`` is 1 for texts with a phrase, else the largest containment found, else 0. A null
    or empty text has no words and no labels (empty strings). Repeated rows and null ids stay;
    an empty table gives an empty result. Texts of any length are read whole. Only doc_id and text
    are used, so further columns, whatever their names, do not matter.
    """
    texts = text_keys(docs)
    base = texts.select(
        "doc_id",
        "k1",
        "k2",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"),
        phrase_places(F.col("text"), phrases).alias("base"),
    )
    blocks = matching_blocks(texts, templates, containment)
    found = blocks.groupBy("k1", "k2").agg(
        F.collect_set("template").alias("found"), F.max(F.col("overlap") / F.col("size")).alias("containment")
    )
    none = F.array().cast("array<string>")
    own = F.coalesce(F.col("base.base_labels"), none)
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return base.join(staged(found, "license-blocks"), ["k1", "k2"], "left").select(
        "doc_id",
        "n_words",
        F.coalesce("base.n_base", F.lit(0).cast("long")).alias("n_base"),
        F.col("base.first_word").alias("first_word"),
        F.col("base.last_word").alias("last_word"),
        joined(own).alias("base_labels"),
        joined(F.array_union(own, F.coalesce("found", none))).alias("labels"),
        F.when(F.col("base").isNotNull(), 1.0).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )
