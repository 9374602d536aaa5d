"""License scans: a positional index of rare words of licence notices, and phrases that have to stand."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from dwellspark.llm.rows import ascii_lower, column

#: Phrases that count wherever their words stand one after the other, and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))


class Template(NamedTuple):
    """A licence notice: its label, its words, and the phrases without which a text near it is another."""

    label: str
    text: str
    phrases: tuple[str, ...]


# The notices with which licences are commonly applied or named.
TEMPLATES = (
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    Template(
        "gpl-3-or-later",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
        "published by the free software foundation either version 3 of the license or at your option any later version",
        ("gnu general public license", "either version 3", "any later version"),
    ),
    Template(
        "gpl-2-or-later",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
        "published by the free software foundation either version 2 of the license or at your option any later version",
        ("gnu general public license", "either version 2", "any later version"),
    ),
    Template(
        "lgpl-or-later",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license "
        "as published by the free software foundation either version 2 1 of the license or at your option any later version",
        ("gnu lesser general public license", "any later version"),
    ),
    Template("apache-2", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template(
        "apache-2-notice",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may "
        "obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing "
        "software distributed under the license is distributed on an as is basis without warranties or conditions of any kind",
        ("apache license version 2 0", "in compliance with the license", "as is basis"),
    ),
    Template("mit-named", "released under the mit license", ("mit license",)),
    Template(
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the "
        "software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
        "distribute sublicense and or sell copies of the software",
        ("permission is hereby granted free of charge", "without restriction", "sublicense"),
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
        "conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the "
        "following disclaimer",
        ("source and binary forms", "retain the above copyright notice"),
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that "
        "the above copyright notice and this permission notice appear in all copies",
        ("with or without fee", "appear in all copies"),
    ),
    Template(
        "mpl-2",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with "
        "this file you can obtain one at http mozilla org mpl 2 0",
        ("mozilla public license v 2 0",),
    ),
    Template("cc-by-4", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-nc-4", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("cc-by-sa-4", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    Template(
        "cc-by-notice",
        "this work is licensed under a creative commons attribution 4 0 international license",
        ("creative commons attribution 4 0",),
    ),
    Template(
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or "
        "distribute this software",
        ("unencumbered software", "public domain"),
    ),
)
#: Words of each template that are looked up in a file, rarest first; how many must agree on one place: half of the template's
#: distinct words, but no fewer than the one and no more than the other number.
RAREST, AGREE = 12, (3, 5)
#: Words that may be missing or added between the place that the rare words agree on and a phrase.
SLACK = 8
#: Most words of all templates together: they are constants of the plan, and their counts come to the driver.
MOST_WORDS = 20_000


def words_of(text: Column) -> Column:
    """A-Z in lower case, then runs of a-z, 0-9 and all beyond ASCII, in order."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _strings(values) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def phrase_places(words: Column, spaced: Column, phrase: str) -> Column:
    """Places at which the phrase's words stand one after the other; ``spaced`` are all words between blanks."""
    parts = phrase.split()
    fits = lambda at: [F.get(words, at + k) == part for k, part in enumerate(parts)]

    def here(at: Column) -> Column:
        first, *rest = fits(at)
        for one in rest:
            first = first & one
        return first

    found = F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), here)
    return F.when(F.contains(spaced, F.lit(f" {phrase} ")), found).otherwise(F.array().cast("array<int>"))


def licence_words(docs: DataFrame, templates: tuple[Template, ...], text_column: str) -> list[str]:
    """The templates' words by falling IDF over all documents, then by themselves; those that no document has come last."""
    vocabulary = sorted({word for template in templates for word in template.text.split()})
    assert len(vocabulary) <= MOST_WORDS, "templates are constants of the plan"
    held = F.array_intersect(words_of(column(text_column)), _strings(vocabulary))
    holders = docs.select(F.explode_outer(held).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("documents"))
    # One row a word, so this many at most.
    counts = {r["word"]: r["documents"] for r in holders.filter(F.col("word").isNotNull()).collect()}
    return sorted(counts, key=lambda word: (counts[word], word))


def agreeing(template: Template, agree: tuple[int, int]) -> int:
    """How many of a template's words must stand as in it."""
    words = len(set(template.text.split()))
    return min(words, agree[1], max(agree[0], words // 2))


def _alignments(words: Column, top: Column, templates: tuple[Template, ...], ranked: list[str], agree: tuple[int, int]) -> Column:
    """``template, at``: the places at which enough of the rare words stand as in the template."""
    at_of: dict[str, list[int]] = {}
    for number, template in enumerate(templates):
        for place, word in enumerate(template.text.split()):
            at_of.setdefault(word, []).append((number << 40) - place)
    known = [word for word in ranked if word in at_of]
    postings = F.array(*[F.array(*[F.lit(p).cast("long") for p in at_of[word]]) for word in known])
    enough = F.array(*[F.lit(agreeing(t, agree)) for t in templates])
    hits = F.filter(
        F.transform(words, lambda word, at: F.struct(at.cast("long").alias("at"), F.array_position(top, word).alias("which"))),
        lambda hit: hit["which"] > 0,
    )
    # The word's rank leads to its postings; each gives the template and where its first word would stand.
    ranks = F.transform(top, lambda word: F.array_position(_strings(known), word))
    origins = F.flatten(
        F.transform(
            hits,
            lambda hit: F.transform(
                F.get(postings, F.get(ranks, (hit["which"] - 1).cast("int")).cast("int") - 1), lambda p: p + hit["at"] + (1 << 39)
            ),
        )
    )
    state = "struct<last:bigint,run:int,found:array<bigint>>"
    start = F.struct(F.lit(-1).alias("last"), F.lit(0).alias("run"), F.array().alias("found")).cast(state)

    def count(seen: Column, origin: Column) -> Column:
        run = F.when(seen["last"] == origin, seen["run"] + 1).otherwise(1)
        whole = run == F.get(enough, F.call_function("shiftright", origin, F.lit(40)).cast("int"))
        grown = F.when(whole, F.array_append(seen["found"], origin)).otherwise(seen["found"])
        return F.struct(origin.alias("last"), run.cast("int").alias("run"), grown.alias("found")).cast(state)

    return F.aggregate(F.array_sort(origins), start, count, lambda seen: seen["found"])


def license_scan(
    docs: DataFrame,
    phrases: tuple[tuple[str, str], ...] = PHRASES,
    templates: tuple[Template, ...] = TEMPLATES,
    rarest: int = RAREST,
    agree: tuple[int, int] = AGREE,
    slack: int = SLACK,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """A row per document: its id, ``n_words, n_base, first_word, last_word, base_labels, labels, score, found``.

    ``n_base`` counts the places of all ``phrases``; ``first_word`` and ``last_word`` are the smallest and
    largest (words from 0; NULL if none). ``base_labels`` and ``labels`` are distinct, sorted and
    comma-joined; ``labels`` has those of templates too. Of a document the licence words with the highest IDF (over all
    rows of ``docs``) are looked up, ``rarest`` of each template; a template is a candidate where enough of its words
    (``agree``) stand at places that put its first word at one place. It counts if each of its phrases begins at most
    ``slack`` words outside the template's words there. ``score`` is the largest share of a counting template's words that
    stand within its place, ``slack`` words about it included; else 0. ``found`` lists ``label, word`` of the places that count.

    NULL is empty; empty texts have no words and no labels. Repeated rows and rows without id
    are scanned each; empty tables give no rows; other columns are not read.

    Two passes over the texts: document counts of the templates' words, one row a word, and a projection.
    All of a document is done in its row, so nothing else is shuffled and no key can be hot.
    """
    ranked = licence_words(docs, templates, text_column)
    rows = docs.select(column(id_column).alias("id"), words_of(column(text_column)).alias("words"))
    spaced = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    places = [(label, phrase_places(F.col("words"), F.col("spaced"), phrase)) for phrase, label in phrases]
    rows = rows.withColumn("spaced", spaced).withColumn("base", F.array(*[F.struct(F.lit(l).alias("label"), p.alias("at")) for l, p in places]))
    starts = F.flatten(F.transform("base", lambda b: b["at"]))
    names = F.transform(F.filter("base", lambda b: F.size(b["at"]) > 0), lambda b: b["label"])
    # A text without any of the phrases that templates must have can have no label of theirs.
    needed = sorted({phrase for t in templates for phrase in t.phrases})
    stands = F.lit(False)
    for template in templates:
        all_there = F.lit(True)
        for phrase in template.phrases:
            all_there = all_there & F.contains("spaced", F.lit(f" {phrase} "))
        stands = stands | all_there
    # An intersection keeps the order of its first side: by falling IDF.
    ranks = {word: rank for rank, word in enumerate(ranked)}
    own = [sorted({word for word in t.text.split() if word in ranks}, key=ranks.get) for t in templates]
    top = F.array_distinct(F.concat(*[F.slice(F.array_intersect(_strings(words), F.col("words")), 1, rarest) for words in own]))
    known = _alignments(F.col("words"), F.col("top"), templates, ranked, agree) if ranked else F.array().cast("array<bigint>")
    nowhere = F.array().cast("array<bigint>")
    rows = rows.withColumn("stands", stands).withColumn("top", F.when(F.col("stands"), top))
    rows = rows.withColumn("origins", F.when(F.col("stands"), known).otherwise(nowhere))
    at_phrases = {p: phrase_places(F.col("words"), F.col("spaced"), p) for p in needed}
    rows = rows.withColumn(
        "phrase_at", F.when(F.size("origins") > 0, F.array(*[at_phrases[p] for p in needed])).otherwise(F.array().cast("array<array<int>>"))
    )

    sizes = [len(t.text.split()) for t in templates]
    lengths, labels = F.array(*map(F.lit, sizes)), _strings([t.label for t in templates])
    wanted = F.array(*[F.array(*[F.lit(needed.index(p)) for p in t.phrases]) for t in templates])
    texts = F.array(*[_strings(sorted(set(t.text.split()))) for t in templates])
    half = 1 << 39

    def judged(origin: Column) -> Column:
        number = F.call_function("shiftright", origin, F.lit(40)).cast("int")
        first = (origin.bitwiseAND(F.lit((1 << 40) - 1)) - half).cast("int")
        until = first + F.get(lengths, number)
        near = lambda at: (at >= first - slack) & (at < until + slack)
        all_near = F.forall(F.get(wanted, number), lambda p: F.exists(F.get("phrase_at", p), near))
        begin = F.greatest(first - slack, F.lit(0))
        window = F.slice("words", begin + 1, F.greatest(until + slack - begin, F.lit(0)))
        own = F.get(texts, number)
        share = F.when(all_near, F.round(F.size(F.array_intersect(own, window)) / F.size(own), 6))
        return F.struct(F.get(labels, number).alias("label"), F.greatest(first, F.lit(0)).alias("word"), share.alias("share"))

    found = F.filter(F.transform("origins", judged), lambda one: one["share"].isNotNull())
    rows = rows.withColumn("judged", found)
    joined = lambda values: F.array_join(F.array_sort(F.array_distinct(values)), ",")
    return rows.select(
        F.col("id").alias(id_column),
        F.size("words").cast("long").alias("n_words"),
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        joined(names).alias("base_labels"),
        joined(F.concat(names, F.transform("judged", lambda one: one["label"]))).alias("labels"),
        F.coalesce(F.array_max(F.transform("judged", lambda one: one["share"])), F.lit(0.0)).alias("score"),
        F.transform("judged", lambda one: F.struct(one["label"].alias("label"), one["word"].alias("word"))).alias("found"),
    )
