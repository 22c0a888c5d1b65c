"""License scan: an exact set-similarity join of text blocks with license templates, in DataFrame functions only.

A block is a line of a document, or a run of RUN_LINES lines from any line on (so that a wrapped notice is one block,
whatever marks its lines begin with), and is compared as a set of words. It meets a template if it has all words that
name the license, none that name another one, and at least CONTAINMENT of the template's words; of a template of fewer
than SHORT words it has all, on one line with few words besides. Only words of the templates matter for that, so blocks keep those
alone. They are put in the order of their frequency in the whole corpus, rare ones first. A block that meets a template
shares one of the template's first words (prefix filter); it has enough words (length filter); and enough words are left
after the shared one on either side (positional filter). Pairs that pass are verified by the size of the intersection.

Runs of lines are made only in documents that have all naming words of a long template. A notice wrapped into more than
RUN_LINES lines, or with a long text on its lines besides, is not found.

The templates are a fixed list, so their index and their words' order are broadcast and are small at any size of the
corpus. Counts of words are summed before they are shuffled; no text is shuffled.

Nulls: a null text is empty and has no words, no labels and score 0; a null id stays null. Repeated documents give a
row each. An empty table gives no rows. Memory follows the longest text.
"""

from __future__ import annotations

import re
from functools import reduce
from math import ceil
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketpulse.llm.frames import checkpointed

CONTAINMENT = 0.8
#: Lines of a run, and words of a run for each word of the template that it meets, at most.
RUN_LINES = 12
RUN_WORDS = 4
#: Templates of fewer distinct words need all of them, in a block of so many words more at most.
SHORT = 16
MORE_WORDS = 12
#: Score of a document that has a base phrase but meets no template.
PHRASE_SCORE = 0.5

#: Phrases and their labels. Fixed values.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Openings of public license notices, and one-line notices, with their labels. Fixed values.
TEMPLATES = (
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files (the Software), to deal in the Software without restriction, including without"
        " limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of"
        " the Software, and to permit persons to whom the Software is furnished to do so, subject to the following"
        " conditions",
    ),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance"
        " with the License. You may obtain a copy of the License at",
    ),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
        " Public License as published by the Free Software Foundation, either version 3 of the License, or (at your"
        " option) any later version.",
    ),
    ("gpl-2.0", "Distributed under the GNU General Public License, version 2."),
    ("gpl-3.0", "Distributed under the GNU General Public License, version 3."),
    ("lgpl", "Distributed under the GNU Lesser General Public License."),
    ("agpl", "Distributed under the GNU Affero General Public License."),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
        " the following conditions are met",
    ),
    (
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was"
        " not distributed with this file, You can obtain one at",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is"
        " hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
)

#: Words that a block must have to be of a license, and words that it must not have.
NAMES = {
    "mit": ("mit",),
    "apache-2.0": ("apache", "2"),
    "gpl": ("gnu", "general", "public"),
    "gpl-2.0": ("gnu", "general", "public", "2"),
    "gpl-3.0": ("gnu", "general", "public", "3"),
    "lgpl": ("gnu", "lesser"),
    "agpl": ("gnu", "affero"),
    "bsd": ("redistribution", "source", "binary", "permitted"),
    "mpl-2.0": ("mozilla", "2"),
    "isc": ("permission", "fee", "granted", "purpose"),
    "unlicense": ("unencumbered", "public", "domain"),
    "cc-by-4.0": ("by", "4"),
    "cc-by-nc-4.0": ("cc", "nc", "4"),
    "cc-by-sa-4.0": ("cc", "sa", "4"),
}
OTHERS = {
    "gpl": ("lesser", "affero"),
    "gpl-2.0": ("lesser", "affero", "3"),
    "gpl-3.0": ("lesser", "affero", "2"),
    "cc-by-4.0": ("nc", "sa", "nd", "noncommercial", "sharealike", "noderivatives"),
    "cc-by-nc-4.0": ("sa", "nd"),
    "cc-by-sa-4.0": ("nc", "nd"),
}

_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
_INSIDE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
_PLACES = (
    f"(?<!{_INSIDE})(?:" + "|".join(p.replace(" ", f"{_BREAK}+") for p in PHRASES) + f")(?!{_INSIDE})"
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_words(text: str) -> list[str]:
    return sorted(set(re.findall(r"[0-9a-z]+", text.lower())))


def naming_words(label: str, text: str) -> list[str]:
    """Words of a template that a block must have: the license's name, if the template says it, or what is its own."""
    own = set(template_words(text))
    named = [w for w in NAMES[label] if w in own]
    if label == "mit" and not named:
        named = ["permission", "granted", "sublicense"]
    if label == "cc-by-4.0":
        named += ["cc"] if "cc" in own else ["creative", "commons", "attribution"]
    return named


def _need(size: int) -> int:
    """Fewest words of a template that a block must contain."""
    return size if size < SHORT else ceil(round(CONTAINMENT * size, 9))


VOCABULARY = sorted(
    {w for _, text in TEMPLATES for w in template_words(text)} | {w for others in OTHERS.values() for w in others}
)
LEAST_NEED = min(_need(len(template_words(text))) for _, text in TEMPLATES)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, _BREAK), lambda w: w != "")


def _literals(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def _word_starts(lowered: Column, places: Column) -> Column:
    """Number of words before each place: those between the places and those of the places before it."""
    gaps = F.transform(F.split(lowered, _PLACES, -1), lambda x: F.size(_words(x)))
    sizes = F.transform(places, lambda x: F.size(_words(x)))
    steps = F.zip_with(gaps, sizes, lambda gap, size: F.struct(gap.alias("gap"), size.alias("size")))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        longer = F.when(x["size"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(start)))
        return F.struct((start + F.coalesce(x["size"], F.lit(0))).alias("at"), longer.alias("out"))

    return F.aggregate(steps, first, step, lambda acc: acc["out"])


def _read(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per document: row (its own number), n_words, starts and labels of the phrases, template words of its lines."""
    lowered = F.translate(F.coalesce(docs[text_col], F.lit("")), _UPPER, _LOWER)
    rows = docs.select(docs[id_col].alias("doc_id"), F.monotonically_increasing_id().alias("row"), lowered.alias("text"))
    rows = rows.select(
        "doc_id",
        "row",
        "text",
        F.regexp_extract_all("text", F.lit(_PLACES), F.lit(0)).alias("places"),
        F.transform(F.split("text", "\n"), _words).alias("lines"),
    )
    label = F.create_map(*(F.lit(x) for phrase, name in PHRASES.items() for x in (phrase.split(" ")[0], name)))

    def block(x: Column) -> Column:
        found = F.array_intersect(x, _literals(VOCABULARY))
        return F.struct(found.alias("found"), F.size(x).alias("size"), F.lit(False).alias("run"))

    rows = rows.select(
        "doc_id",
        "row",
        F.aggregate("lines", F.lit(0).cast("long"), lambda n, x: n + F.size(x)).alias("n_words"),
        F.when(F.size("places") > 0, _word_starts(F.col("text"), F.col("places"))).alias("starts"),
        F.transform("places", lambda x: label[_words(x)[0]]).alias("base"),
        F.transform("lines", block).alias("lines"),
    )
    rows = rows.withColumn("every", F.array_distinct(F.flatten("lines.found")))
    long = [naming_words(name, text) for name, text in TEMPLATES if len(template_words(text)) >= SHORT]
    wrapped = reduce(or_, (reduce(and_, (F.array_contains("every", w) for w in some)) for some in long))

    def run(line: Column, at: Column) -> Column:
        part = F.slice(F.col("lines"), at + 1, RUN_LINES)
        found = F.array_distinct(F.flatten(F.transform(part, lambda x: x["found"])))
        size = F.aggregate(part, F.lit(0), lambda n, x: n + x["size"])
        return F.struct(F.when(F.size(line["found"]) > 0, found).otherwise(line["found"]).alias("found"), size.alias("size"), F.lit(True).alias("run"))

    runs = F.when(wrapped & (F.size("lines") > 1), F.transform("lines", run))
    blocks = F.concat("lines", F.coalesce(runs, F.slice("lines", 1, 0)))
    return rows.select(
        "doc_id",
        "row",
        "n_words",
        "starts",
        "base",
        F.filter(blocks, lambda x: (F.size(x["found"]) > 0) & (~x["run"] | (F.size(x["found"]) >= SHORT // 2))).alias("blocks"),
    )


def _met(read: DataFrame) -> DataFrame:
    """Every (row, label, containment) of a block that meets a template."""
    lines = F.filter("blocks", lambda x: ~x["run"])
    counted = read.select(F.explode(F.flatten(F.transform(lines, lambda x: x["found"]))).alias("word")).groupBy("word").count()
    counts = {r["word"]: r["count"] for r in counted.collect()}  # at most the templates' words
    order = sorted(VOCABULARY, key=lambda w: (counts.get(w, 0), w))
    rank = {w: k for k, w in enumerate(order)}
    entries = []
    for number, (label, text) in enumerate(TEMPLATES):
        own = sorted(template_words(text), key=rank.__getitem__)
        need, names, others = _need(len(own)), naming_words(label, text), list(OTHERS.get(label, ()))
        total = len(re.findall(r"[0-9a-z]+", text.lower()))
        most = len(own) + MORE_WORDS if len(own) < SHORT else None
        entries += [
            (w, k, number, label, own, need, names, others, most, RUN_WORDS * total)
            for k, w in enumerate(own[: len(own) - need + 1])
        ]
    schema = (
        "word string, place int, template int, label string, words array<string>, need int,"
        " names array<string>, others array<string>, most int, most_of_run int"
    )
    index = F.broadcast(read.sparkSession.createDataFrame(entries, schema))

    blocks = read.select("row", F.posexplode("blocks").alias("line", "block")).select("row", "line", "block.*")
    blocks = blocks.where(F.size("found") >= LEAST_NEED)
    blocks = blocks.withColumn("found", F.array_intersect(_literals(order), "found"))  # in the order of frequency
    prefix = F.slice("found", F.lit(1), F.size("found") - LEAST_NEED + 1)
    pairs = blocks.select("row", "line", "found", "size", "run", F.posexplode(prefix).alias("at", "word")).join(index, "word")
    left = F.least(F.size("found") - F.col("at"), F.size("words") - F.col("place"))
    pairs = pairs.where((F.size("found") >= F.col("need")) & (left >= F.col("need")))
    pairs = pairs.withColumn("shared", F.size(F.array_intersect("found", "words"))).where(F.col("shared") >= F.col("need"))
    named = (F.size(F.array_except("names", "found")) == 0) & ~F.arrays_overlap("others", "found")
    run = F.col("run")
    fits = F.when(F.col("most").isNotNull(), ~run & (F.col("size") <= F.col("most"))).otherwise(
        ~run | (F.col("size") <= F.col("most_of_run"))
    )
    pairs = pairs.where(named & fits)
    return pairs.select("row", "label", (F.col("shared") / F.size("words")).alias("containment"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, starts (words at which base phrases stand), base and found (labels), best."""
    read = checkpointed(_read(docs, id_col, text_col))  # narrow; the texts are read once
    met = _met(read).groupBy("row").agg(F.collect_set("label").alias("found"), F.max("containment").alias("best"))
    return read.drop("blocks").join(met, "row", "left").drop("row")


def report(docs: DataFrame) -> DataFrame:
    """One row per document, with its base phrases and all labels."""
    none = F.array().cast("array<string>")
    starts = F.coalesce("starts", F.array().cast("array<int>"))
    base = F.array_sort(F.array_distinct(F.coalesce("base", none)))
    every = F.array_sort(F.array_union(F.coalesce("base", none), F.coalesce("found", none)))
    phrase = F.when(F.size(starts) > 0, F.lit(PHRASE_SCORE)).otherwise(F.lit(0.0))
    return scan(docs).select(
        "doc_id",
        "n_words",
        F.size(starts).cast("long").alias("n_base"),
        F.array_min("starts").cast("long").alias("first_word"),
        F.array_max("starts").cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.greatest(F.coalesce("best", F.lit(0.0)), phrase).alias("score"),
    )
