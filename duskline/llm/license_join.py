"""License notices by phrases and by an exact set-similarity join with templates.

Main path: DataFrame functions only. A template of up to c words (c a power of
two) is compared with blocks of 2c words in a row of the whole text, one at every c-th
word, whatever lines they stand on: a notice of up to c words lies whole in one of
them, and words further apart never make one. Blocks and templates are sets of
words, ordered by how often the corpus has a word, rare words first. A block
matches a template if it holds at least THRESHOLD of the template's words and
all of its must-have words (what tells it from its kin: affero, nc, a version).
Of the templates that match a block those win that it holds the greatest part of, and of
these those it shares most words with. With need = ceil(THRESHOLD * size of template):
- prefix filter: one of the template's `size - need + 1` rarest words must stand
  in the text, and in the block, where it meets the template by an equi-join;
- length filter: a block must hold `need` words of the vocabulary at least;
- positional filter: after a shared word at given places, at most the shorter
  rest can still be shared;
- what is left is verified by the size of the intersection.
Words outside of the templates never count, so blocks are cut to the templates'
vocabulary. The template side (a parameter) is a few rows and is broadcast; its
size never depends on the data. Word counts of the vocabulary are read first.

Defined cases: a null text counts as empty; repeated rows are matched once and
get the same result; a null id is kept.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

THRESHOLD = 0.8
#: Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Widespread license notices, as words, each with the words that it must have.
TEMPLATES = {
    "agpl-3.0": [
        ("gnu affero general public license version 3", "affero 3"),
        ("this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software "
         "foundation either version 3 of the license or at your option any later version", "affero 3"),
    ],
    "apache-2.0": [
        ("licensed under the apache license version 2 0", "apache"),
        ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
         "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is "
         "basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", "apache"),
    ],
    "bsd": [
        ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution binary"),
        ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce "
         "the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "redistributions binary"),
    ],
    "cc-by-4.0": [("licensed under cc by 4 0", "cc by 4"), ("this work is licensed under a creative commons attribution 4 0 international license", "commons attribution international 4")],
    "cc-by-nc-4.0": [("licensed under cc by nc 4 0", "cc by nc 4"),
                     ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "commons attribution noncommercial international 4")],
    "cc-by-sa-4.0": [("licensed under cc by sa 4 0", "cc by sa 4"),
                     ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "commons attribution sharealike international 4")],
    "gpl-2.0": [
        ("this work is licensed under the gnu general public license version 2", "gnu general public 2"),
        ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
         "either version 2 of the license or at your option any later version", "gnu general public 2"),
    ],
    "gpl-3.0": [
        ("this work is licensed under the gnu general public license version 3", "gnu general public 3"),
        ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
         "either version 3 of the license or at your option any later version", "gnu general public 3"),
    ],
    "isc": [("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this "
             "permission notice appear in all copies", "fee granted")],
    "lgpl": [("gnu lesser general public license version", "lesser general public"),
             ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software "
              "foundation", "lesser general public")],
    "mit": [
        ("released under the mit license", "mit"),
        ("licensed under the mit license", "mit"),
        ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without "
         "restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom "
         "the software is furnished to do so subject to the following conditions", "granted charge"),
    ],
    "mpl-2.0": [("this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla 2")],
    "unlicense": [("this is free and unencumbered software released into the public domain", "unencumbered domain")],
}
#: Words of the shortest blocks' step.
LEAST_STEP = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words, after lower-casing.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """A-Z lower-cased, nothing else; the short way where all is ASCII."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BETWEEN), "")


def _starts(phrase: str) -> Column:
    """Places in `_lj_words` where the words of a phrase stand; looked for only where the text holds them in a row."""
    parts = phrase.split()
    there = F.col("_lj_low").rlike(BETWEEN.join(parts))
    places = F.filter(F.sequence(F.lit(0), F.size("_lj_words") - len(parts)),
                      lambda i: F.slice("_lj_words", i + 1, len(parts)) == F.array(*map(F.lit, parts)))
    return F.when(there & (F.size("_lj_words") >= len(parts)), places).otherwise(F.array().cast("array<int>"))


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    must: tuple[str, ...]
    need: int
    step: int


def prepared(templates: dict[str, list[tuple[str, str]]], threshold: float) -> list[Template]:
    """Sets of words with the number that a block needs and the step of its blocks."""
    out = []
    for label, texts in templates.items():
        for text, must in texts:
            words = sorted(set(text.split()))
            out.append(Template(label, tuple(words), tuple(sorted(set(must.split()))), math.ceil(threshold * len(words) - 1e-9), max(LEAST_STEP, 1 << (len(text.split()) - 1).bit_length())))
    return out


def _literals(words) -> Column:
    return F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")


def _blocks_with(rare: Column, step: int, own: Column) -> Column:
    """Blocks of `words` that hold one of the rare words, as structs (step, start, held); held: their words of `own`, in its order."""
    hits = F.filter(F.transform("words", lambda w, i: F.when(F.array_contains(rare, w), F.floor(i / step).cast("int"))), lambda i: i.isNotNull())
    starts = F.filter(F.array_distinct(F.flatten(F.transform(F.array_distinct(hits), lambda i: F.array(i - 1, i)))), lambda i: i >= 0)
    return F.transform(starts, lambda i: F.struct(F.lit(step).alias("step"), i.alias("start"), F.array_intersect(own, F.slice("words", i * step + 1, F.lit(2 * step))).alias("held")))


def template_matches(docs: DataFrame, templates: dict[str, list[tuple[str, str]]], threshold: float) -> DataFrame:
    """(`_lj_key`, label, part): templates that win a block of `_lj_low`."""
    known = prepared(templates, threshold)
    vocabulary = sorted({w for t in known for w in t.words})
    seen = docs.select(F.explode(F.split("_lj_low", BETWEEN)).alias("w")).where(F.col("w").isin(vocabulary))
    counts = {r["w"]: r["n"] for r in seen.groupBy("w").agg(F.count("*").alias("n")).collect()}  # a row per word of the templates
    order = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    place = {w: i for i, w in enumerate(order)}
    ranked = [sorted(t.words, key=place.__getitem__) for t in known]
    first = [r[:len(r) - t.need + 1] for t, r in zip(known, ranked, strict=True)]
    there = docs.where(F.col("_lj_low").rlike("|".join(sorted({w for p in first for w in p if w in counts})) or "(?!)"))
    worded = there.select("_lj_key", words_of(F.col("_lj_low")).alias("words"))
    blocks = []
    for step in sorted({t.step for t in known}):
        rare = _literals(sorted({w for t, p in zip(known, first, strict=True) if t.step == step for w in p if w in counts}))
        own = _literals([w for w in order if any(t.step == step and w in t.words for t in known)])
        blocks.append(_blocks_with(rare, step, own))
    every = worded.select("_lj_key", F.explode(F.concat(*blocks)).alias("b")).select("_lj_key", "b.*").withColumn("size", F.size("held"))
    spread = every.where(F.col("size") >= min(t.need for t in known)).select("_lj_key", "step", "start", "held", "size", F.posexplode("held").alias("at", "w"))
    rows = [(t.label, list(t.words), list(t.must), len(t.words), t.need, t.step, i, w) for t, p in zip(known, first, strict=True) for i, w in enumerate(p)]
    few = docs.sparkSession.createDataFrame(rows, "label string, whole array<string>, must array<string>, t_size int, need int, step int, t_at int, w string")
    close = spread.join(F.broadcast(few), ["step", "w"]).where(
        (F.col("size") >= F.col("need")) & (1 + F.least(F.col("t_size") - F.col("t_at") - 1, F.col("size") - F.col("at") - 1) >= F.col("need")))
    shared = F.size(F.array_intersect("held", "whole"))
    sure = close.where((shared >= F.col("need")) & (F.size(F.array_except("must", "held")) == 0))
    sure = sure.select("_lj_key", "step", "start", "label", (shared / F.col("t_size")).alias("part"), shared.alias("shared")).distinct()
    best = F.rank().over(Window.partitionBy("_lj_key", "step", "start").orderBy(F.desc("part"), F.desc("shared")))
    return sure.withColumn("best", best).where("best = 1").select("_lj_key", "label", "part")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[tuple[str, str]]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """id_col, n_words, n_base, first_word, last_word, base_labels, labels, score; labels are arrays.

    score: 1 where a phrase stands, else the largest part of a winning template that a block holds (0 without one).
    templates: label -> (words, must-have words) of its notices.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    base = docs.select(F.col(f"`{id_col}`").alias("_lj_id"), F.xxhash64(f"`{id_col}`", text).alias("_lj_key"), lowered(text).alias("_lj_low"))
    lined = base.withColumn("_lj_words", words_of(F.col("_lj_low")))
    for i, phrase in enumerate(PHRASES):
        lined = lined.withColumn(f"_lj_p{i}", _starts(phrase))
    found = [F.col(f"_lj_p{i}") for i in range(len(PHRASES))]
    places = F.array_sort(F.concat(*found))
    labels = F.filter(F.array(*(F.when(F.size(p) > 0, F.lit(label)) for p, label in zip(found, PHRASES.values(), strict=True))), lambda x: x.isNotNull())
    counted = lined.select("_lj_id", "_lj_key", F.size("_lj_words").cast("long").alias("n_words"), F.size(places).cast("long").alias("n_base"),
                           F.element_at(places, F.when(F.size(places) > 0, 1)).cast("long").alias("first_word"),
                           F.element_at(places, F.when(F.size(places) > 0, -1)).cast("long").alias("last_word"), F.array_sort(labels).alias("base_labels"))
    matched = template_matches(base, TEMPLATES if templates is None else templates, threshold).groupBy("_lj_key").agg(
        F.collect_set("label").alias("more"), F.max("part").alias("part"))
    every = F.array_sort(F.array_distinct(F.concat("base_labels", F.coalesce("more", F.array().cast("array<string>")))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("part", F.lit(0.0)))
    return counted.join(matched, "_lj_key", "left").select(F.col("_lj_id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels",
                                                           every.alias("labels"), score.alias("score"))
