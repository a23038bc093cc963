"""Licence scan by a positional index of the licences' rare words, in column expressions only.

Of every licence template the words that the fewest documents contain are indexed with their places. A document's
words that are in the index are looked up, the highest in inverse document frequency first, and each gives the place where the
template would have to start. Starts of one template that lie close together are one find; it counts when enough
of the template's rare words agree on it and its mandatory phrases stand there, word for word. Phrases are found
in the same way: all their words agree on one start.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope.llm.scratch import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The phrases that always count, with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


@dataclass(frozen=True)
class Template:
    """A licence notice; ``phrases`` are runs of its words that must stand in the text as they are."""

    name: str
    label: str
    text: str
    phrases: tuple[str, ...]


# Notices and opening passages as their licences publish them.
TEMPLATES = (
    Template(
        "mit", "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        ("permission is hereby granted free of charge to any person obtaining a copy", "to deal in the software without restriction"),
    ),
    Template("mit-notice", "mit", "Released under the MIT License.", ("under the mit license",)),
    Template("mit-spdx", "mit", "SPDX-License-Identifier: MIT", ("spdx license identifier mit",)),
    Template(
        "apache", "apache",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at",
        ("licensed under the apache license", "except in compliance with the license"),
    ),
    Template("apache-notice", "apache", "Licensed under the Apache License, Version 2.0.", ("under the apache license version 2 0",)),
    Template("apache-spdx", "apache", "SPDX-License-Identifier: Apache-2.0", ("spdx license identifier apache 2 0",)),
    Template(
        "gpl", "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        ("terms of the gnu general public license as published by the free software foundation",),
    ),
    Template("gpl-notice", "gpl", "This work is licensed under the GNU General Public License, version 3.", ("under the gnu general public license",)),
    Template(
        "lgpl", "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
        "License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        ("terms of the gnu lesser general public license as published by the free software foundation",),
    ),
    Template(
        "agpl", "agpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public "
        "License as published by the Free Software Foundation",
        ("terms of the gnu affero general public license as published by the free software foundation",),
    ),
    Template(
        "bsd", "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer.",
        ("redistribution and use in source and binary forms with or without modification are permitted",),
    ),
    Template(
        "isc", "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
        ("for any purpose with or without fee is hereby granted",),
    ),
    Template(
        "mpl", "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at",
        ("subject to the terms of the mozilla public license",),
    ),
    Template(
        "unlicense", "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
        "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose",
        ("free and unencumbered software released into the public domain",),
    ),
    Template(
        "cc0", "cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        ("waived all copyright and related or neighboring rights to",),
    ),
    Template("cc-by", "cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License.", ("creative commons attribution 4 0",)),
    Template("cc-by-code", "cc-by", "Licensed under CC BY 4.0.", ("licensed under cc by 4 0",)),
    Template(
        "cc-by-sa", "cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        ("creative commons attribution sharealike",),
    ),
    Template("cc-by-sa-code", "cc-by-sa", "Licensed under CC BY-SA 4.0.", ("licensed under cc by sa",)),
    Template(
        "cc-by-nc", "cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        ("creative commons attribution noncommercial",),
    ),
    Template("cc-by-nc-code", "cc-by-nc", "Licensed under CC BY-NC 4.0.", ("licensed under cc by nc",)),
)


@dataclass(frozen=True)
class LicenseIndex:
    """``rare``: most rare words of a template that are indexed, half of its distinct words at most. ``need_percent``:
    share of them that must agree on a start. ``width``: words by which the starts of one find may differ, less than half
    of it for certain. Templates may have up to 40 rare words and 20 phrases."""

    templates: tuple[Template, ...] = TEMPLATES
    base: dict[str, str] = field(default_factory=lambda: dict(BASE))
    rare: int = 16
    need_percent: int = 60
    width: int = 16

    def words(self) -> list[str]:
        """All words of templates and phrases, in order of the alphabet."""
        texts = [t.text for t in self.templates] + list(self.base)
        return sorted({w for text in texts for w in plain_words(text)})


PHRASE_BIT = 40


def plain_words(text: str) -> list[str]:
    """The words of a template, as :func:`words_of` gives those of a document."""
    return "".join(c.lower() if c.isascii() and c.isalnum() else " " for c in text).split()


def words_of(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(low, NOT_WORD), "")


def _literal(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def document_frequency(docs: DataFrame, words: list[str], text_col: str = "text") -> dict[str, int]:
    """In how many rows of ``docs`` each of ``words`` stands; all rows are counted, and a row a word reaches the driver."""
    present = docs.select(F.explode(F.array_intersect(_literal(words), words_of(F.col(text_col)))).alias("word"))
    counted = {r.word: r.n for r in present.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {w: counted.get(w, 0) for w in words}


def rare_words(template: Template, frequency: dict[str, int], index: LicenseIndex) -> list[str]:
    """The words of a template to index: lowest document frequency first, ties in order of the alphabet."""
    distinct = sorted(set(plain_words(template.text)), key=lambda w: (frequency[w], w))
    return distinct[: max(1, min(index.rare, len(distinct) // 2))]


def _places(run: list[str], text: list[str]) -> list[int]:
    return [i for i in range(len(text) - len(run) + 1) if text[i : i + len(run)] == run]


def _values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A frame of constants that stays in the JVM."""
    names = [c.split()[0] for c in schema.split(", ")]
    cell = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else "NULL" if v is None else str(v)
    values = ", ".join("(" + ", ".join(map(cell, row)) + ")" for row in rows)
    typed = spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})")
    return typed.select(*[F.col(n).cast(kind).alias(n) for n, kind in (c.split() for c in schema.split(", "))])


def _postings(frequency: dict[str, int], index: LicenseIndex) -> tuple[list[tuple], list[tuple], list[tuple], list[list[str]]]:
    """Rows of the index.

    ``tokens`` (word, template, place, bit): the rare words. ``runs`` (word, phrase, place, bit, n): the phrases' words.
    ``seats`` (phrase, template or null, label, place in the template, bit): where a phrase belongs; the base ones have no
    template. ``phrases``: their words, by number.
    """
    numbers: dict[str, int] = {}
    tokens, seats = [], []
    for at, template in enumerate(index.templates):
        text = plain_words(template.text)
        for bit, word in enumerate(rare_words(template, frequency, index)):
            tokens += [(word, at, place, 1 << bit) for place, w in enumerate(text) if w == word]
        for bit, phrase in enumerate(template.phrases):
            number = numbers.setdefault(phrase, len(numbers))
            seats += [(number, at, template.label, place, 1 << PHRASE_BIT + bit) for place in _places(plain_words(phrase), text)]
    seats += [(numbers.setdefault(phrase, len(numbers)), None, label, 0, 0) for phrase, label in index.base.items()]
    phrases = [plain_words(p) for p in numbers]
    runs = [(word, number, place, 1 << place, len(phrase)) for number, phrase in enumerate(phrases) for place, word in enumerate(phrase)]
    return tokens, runs, seats, phrases


def scan_licenses(docs: DataFrame, index: LicenseIndex | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Base: the places of the index's base phrases, their number and the smallest and largest start in words.
    ``labels``: those of the base phrases and of the templates found. ``spans``: array of (label, template, start word,
    rare words that agree, rare words), the best find of each template. ``score``: the greatest share of a template's
    rare words that agree at a find, 0 where only base phrases or nothing was found.

    Whole texts are read twice, for the frequencies and for the places; of a document only the places of licence words go
    on. All looked-up places are compared by sums over (document, template, start), so a document that repeats a word
    many times is no large group. No Python on the way.

    Defined cases: a null or empty text has no words and no labels; repeated rows get the same result each; rows with
    null ids count by their text; an empty table gives no rows; further columns of ``docs`` are ignored.
    """
    index = index or LicenseIndex()
    spark = docs.sparkSession
    frequency = document_frequency(docs, index.words(), text_col)
    tokens, runs, seats, phrases = _postings(frequency, index)
    indexed = sorted({t[0] for t in tokens} | {w for p in phrases for w in p}, key=lambda w: (frequency[w], w))
    rare = {t[0] for t in tokens}

    text = F.coalesce(F.col(text_col), F.lit(""))
    read = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_key"), words_of(text).alias("words"))
    present = read.select("*", F.array_intersect(_literal(indexed), F.col("words")).alias("present"))  # rarest first
    # A phrase can stand only where all its words do; rare words are looked up wherever they stand.
    whole = F.filter(F.array(*[_literal(p) for p in phrases]), lambda p: F.size(F.array_except(p, F.col("present"))) == 0)
    looked = F.array_union(F.array_intersect(F.col("present"), _literal(sorted(rare))), F.flatten(whole))
    asked = present.select("doc_id", "text_key", "words", F.when(F.size("present") > 0, looked).alias("looked"))
    hit = F.transform("words", lambda w, i: F.when(F.array_contains("looked", w), F.struct(w.alias("word"), i.alias("at"))))
    hits = F.when(F.size("looked") > 0, F.filter(hit, lambda h: h.isNotNull()))
    rows = written(asked.select("doc_id", "text_key", F.size("words").cast("long").alias("n_words"), hits.alias("hits")), "license-rows")

    key = ["doc_id", "text_key"]
    places = rows.select(*key, F.inline("hits"))
    run_frame = _values(spark, runs, "word string, phrase int, place int, bit long, n int")
    seat_frame = _values(spark, seats, "phrase int, template int, label string, seat int, bit long")
    token_frame = _values(spark, tokens, "word string, template int, place int, bit long")

    # Phrases: a start that all words agree on. Frames of constants are broadcast, they are as large as the templates.
    agreed = places.join(F.broadcast(run_frame), "word").groupBy(*key, "phrase", "n", (F.col("at") - F.col("place")).alias("start")).agg(
        F.bit_or("bit").alias("mask")
    )
    stand = written(agreed.filter(F.bit_count("mask") == F.col("n")).join(F.broadcast(seat_frame), "phrase"), "license-phrases")
    base = stand.filter("template IS NULL").groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_base"), F.min("start").cast("long").alias("first_word"), F.max("start").cast("long").alias("last_word"),
        F.collect_set("label").alias("base_labels"),
    )

    # Templates: rare words and phrases that agree on a start, up to a few words more or less.
    of_words = places.join(F.broadcast(token_frame), "word").select(*key, "template", (F.col("at") - F.col("place")).alias("start"), "bit")
    of_phrases = stand.filter("template IS NOT NULL").select(*key, "template", (F.col("start") - F.col("seat")).alias("start"), "bit")
    shifted = F.explode(F.array(F.lit(0), F.lit(index.width // 2))).alias("shift")
    near = of_words.union(of_phrases).select(*key, "template", "start", "bit", shifted)
    bucket = F.floor((F.col("start") + F.col("shift")) / index.width).alias("bucket")
    finds = near.groupBy(*key, "template", "shift", bucket).agg(
        F.bit_or("bit").alias("mask"), F.min(F.when(F.col("bit") >= 1 << PHRASE_BIT, F.col("start"))).alias("start")
    )
    told = [
        (i, t.label, t.name, len(rare_words(t, frequency, index)), ((1 << len(t.phrases)) - 1) << PHRASE_BIT) for i, t in enumerate(index.templates)
    ]
    told_frame = _values(spark, told, "template int, label string, name string, n_rare int, mandatory long")
    count = F.bit_count(F.col("mask").bitwiseAND(F.lit((1 << PHRASE_BIT) - 1)))
    verified = finds.join(F.broadcast(told_frame), "template").withColumn("agree", count).filter(
        (F.col("mask").bitwiseAND(F.col("mandatory")) == F.col("mandatory")) & (F.col("agree") * 100 >= F.col("n_rare") * index.need_percent)
    )
    best = verified.groupBy(*key, "template").agg(
        F.max(F.struct(F.col("agree"), (-F.col("start")).alias("before"), "label", "name", "n_rare")).alias("b")
    )
    span = F.struct(
        F.col("b.label").alias("label"), F.col("b.name").alias("template"), (-F.col("b.before")).cast("long").alias("start"),
        F.col("b.agree").cast("int").alias("agree"), F.col("b.n_rare").alias("n_rare"),
    )
    found = best.groupBy(*key).agg(F.collect_set("b.label").alias("found"), F.sort_array(F.collect_list(span)).alias("spans"),
                                   F.max(F.col("b.agree") / F.col("b.n_rare")).alias("score"))

    answers = base.join(found, (base["doc_id"].eqNullSafe(found["doc_id"])) & (base["text_key"] == found["text_key"]), "full").select(
        F.coalesce(base["doc_id"], found["doc_id"]).alias("d"), F.coalesce(base["text_key"], found["text_key"]).alias("k"),
        "n_base", "first_word", "last_word", "base_labels", "found", "spans", "score",
    )
    answers = written(answers, "license-answers")
    none = F.array().cast("array<string>")
    base_labels, found_labels = F.coalesce("base_labels", none), F.coalesce("found", none)
    joined = rows.join(answers, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "left")
    return joined.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.array_join(F.sort_array(base_labels), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(base_labels, found_labels)), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("spans", F.array().cast(answers.schema["spans"].dataType)).alias("spans"),
    )
