"""License scan as an exact set-similarity join, in DataFrame operations only.

A block is a run of neighbouring lines of a document, a set of words: runs of each length in ``RUNS``, overlapping, so that a notice
is in one block however it is wrapped. A template is a set of words with a label and the words that tell it from its
relatives. The join finds every block that holds at least ``THRESHOLD`` of a template's words and all of the telling ones.
Words no template has cannot add to an overlap and are left out of the blocks. The others are ordered by the number of blocks in the whole corpus that hold them, rarest first:
a block with the overlap it takes must hold one of the template's first ``size - needed + 1`` words (prefix filter),
have as many words as needed (length filter), and where the first common word stands late on either
side, what is left must still suffice (positional filter). What passes is counted exactly.

The template side (its words, ranks and prefixes) is bounded by the templates given and is broadcast up to
``MAX_TEMPLATE_WORDS``, beyond which a call fails; documents are read once and never shuffled by word,
and word counts are combined before they move.

Defined results: null or empty texts have no words, no labels and score 0; equal blocks match alike, each on its own; a block that meets
several templates has all their labels; rows that share an id are told apart and have each their own.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelane.llm.common import UPPER_LETTERS, lower_ascii, staged

THRESHOLD = 0.8
# Lengths of runs of lines and the steps between their starts; a notice of up to length - step + 1 lines is inside one.
RUNS = ((3, 1), (16, 4))
MAX_TEMPLATE_WORDS = 100_000

# Phrases with the labels they stand for.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Fixed values, texts of public license notices: (label, telling words, words).
TEMPLATES = (
    ("mit", "mit", "released under the mit license"),
    ("mit", "mit", "licensed under the mit license"),
    ("mit", "granted sublicense furnished", "permission is hereby granted free of charge to any person obtaining a copy of this "
     "software and associated documentation files the software to deal in the software without restriction including without "
     "limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to "
     "permit persons to whom the software is furnished to do so"),
    ("apache-2.0", "apache 2", "licensed under the apache license version 2 0"),
    ("apache-2.0", "apache 2", "licensed under the apache license version 2 0 the license you may not use this file except in "
     "compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl-3.0", "general 3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-2.0", "general 2", "this work is licensed under the gnu general public license version 2"),
    ("gpl-3.0", "general 3 redistribute", "this program is free software you can redistribute it and or modify it under the terms of "
     "the gnu general public license as published by the free software foundation either version 3 of the license"),
    ("gpl-2.0", "general 2 redistribute", "this program is free software you can redistribute it and or modify it under the terms of "
     "the gnu general public license as published by the free software foundation either version 2 of the license"),
    ("cc-by-nc-4.0", "cc nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "cc sa", "licensed under cc by sa 4 0"),
    ("bsd", "redistribution binary", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl-2.0", "mozilla", "subject to the terms of the mozilla public license v 2 0"),
    ("proprietary", "all rights reserved", "all rights reserved"),
)

DELIMITERS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _needed(size: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * size - 1e-9))


def _places(phrases: Mapping[str, str]) -> Column:
    """(at, label) of every place in _words where the words of a phrase stand one after another."""
    found = []
    for phrase, label in phrases.items():
        words = phrase.split()
        ends = [f"get(_words, i + {k}) = '{w}'" for k, w in enumerate(words)]
        hit = f"filter(transform(_words, (w, i) -> if(w = '{words[0]}' and {' and '.join(ends)}, i, -1)), x -> x >= 0)"
        listed = F.expr(f"transform({hit}, x -> struct(x as at, '{label}' as label))")
        none = F.expr("cast(array() as array<struct<at: int, label: string>>)")
        last = F.array_contains("_words", F.lit(words[0])) & F.array_contains("_words", F.lit(words[-1]))
        found.append(F.when(last, listed).otherwise(none))
    return F.concat(*found)


def _meetings(blocks: DataFrame, prefix: DataFrame) -> DataFrame:
    """Blocks, with sorted ``ranks``, and the templates one of whose prefix words they hold, a row per such word.

    ``long_enough`` and ``placed_early`` say whether size and place of the word leave what it takes; the latter is true at the
    first common word of every pair that suffices.
    """
    probes = blocks.select("*", F.posexplode("ranks").alias("b_at", "rank"))
    left = F.least(F.size("t_ranks") - F.col("t_at"), F.size("ranks") - F.col("b_at"))
    return probes.join(F.broadcast(prefix), "rank").select(
        "*", (F.size("ranks") >= F.col("needed")).alias("long_enough"), (left >= F.col("needed")).alias("placed_early")
    )


def scan(
    docs: DataFrame,
    templates: Sequence[tuple[str, str, str]] = TEMPLATES,
    phrases: Mapping[str, str] = PHRASES,
    threshold: float = THRESHOLD,
    runs: Sequence[tuple[int, int]] = RUNS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """Two frames: (row, id, n_words, places) per document, places being (at, label) of the phrases, and
    (row, id, block, template, label, containment) per block that meets a template; ``row`` is a number of the call's own."""
    sets = [(k, label, sorted(set(text.split())), telling.split()) for k, (label, telling, text) in enumerate(templates)]
    alphabet = sorted({w for _, _, words, _ in sets for w in words})
    if sum(len(words) for _, _, words, _ in sets) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates of more than {MAX_TEMPLATE_WORDS} words")
    lowered = lower_ascii(F.coalesce(F.col(text_col), F.lit("")))
    split = F.transform(F.split(lowered, "\n"), lambda s: F.array_remove(F.split(s, DELIMITERS), ""))
    lines = docs.select(F.col(id_col).alias("id"), split.alias("_lines"))
    known = F.array(*[F.lit(w) for w in alphabet])
    read = staged(
        lines.select("id", "_lines", F.flatten("_lines").alias("_words")).select(
            F.monotonically_increasing_id().alias("row"),
            "id",
            F.size("_words").cast("bigint").alias("n_words"),
            _places(phrases).alias("places"),
            F.transform("_lines", lambda words: F.array_intersect(words, known)).alias("lines"),
        ),
        "license-lines",
    )
    at = F.sequence(F.lit(0), F.size("lines") - 1)

    def of_length(length: int, step: int) -> Column:
        starts = F.filter(at, lambda i: i % step == 0)
        return F.transform(starts, lambda i: F.array_distinct(F.flatten(F.slice("lines", i + 1, F.lit(length)))))

    blocks = F.concat(*[of_length(*run) for run in runs])
    blocks = read.select("row", "id", F.posexplode(blocks).alias("block", "words")).filter(F.size("words") > 0)

    # Global order over the words of templates: one row per such word.
    counts = blocks.select(F.explode("words").alias("word")).groupBy("word").count()
    frequency = {r["word"]: r["count"] for r in counts.collect()}
    order = sorted(alphabet, key=lambda w: (frequency.get(w, 0), w))
    rank = {w: k for k, w in enumerate(order)}
    prefixes = []
    for k, label, words, telling in sets:
        ranks = sorted(rank[w] for w in words)
        needed = _needed(len(ranks), threshold)
        own = [rank[w] for w in telling]
        prefixes += [(r, k, label, at, needed, ranks, own) for at, r in enumerate(ranks[: len(ranks) - needed + 1])]
    spark = docs.sparkSession
    prefix = spark.createDataFrame(
        prefixes, "rank int, template int, label string, t_at int, needed int, t_ranks array<int>, telling array<int>"
    )
    ranked = F.create_map(*[F.lit(x) for w, k in rank.items() for x in (w, k)])
    sorted_blocks = blocks.select(
        "row", "id", "block", F.array_sort(F.transform("words", lambda w: F.element_at(ranked, w))).alias("ranks")
    ).filter(F.size("ranks") >= min(p[4] for p in prefixes) if prefixes else F.lit(False))
    candidates = _meetings(sorted_blocks, prefix).filter("long_enough and placed_early")
    overlap = F.size(F.array_intersect("ranks", "t_ranks"))
    first_common = F.array_min(F.array_intersect("ranks", "t_ranks"))
    tells = F.size(F.array_except("telling", "ranks")) == 0
    pairs = candidates.filter((first_common == F.col("rank")) & (overlap >= F.col("needed")) & tells)
    found = pairs.select("row", "id", "block", "template", "label", (overlap / F.size("t_ranks")).alias("containment"))
    return read.select("row", "id", "n_words", "places"), found


def labelled(docs: DataFrame, **options) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every document."""
    base, found = scan(docs, **options)
    more = found.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    joined = base.join(more, "row", "left")
    labels = F.transform("places", lambda p: p["label"])
    starts = F.transform("places", lambda p: p["at"])
    listed = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    extra = F.coalesce("more", F.array().cast("array<string>"))
    return joined.select(
        "id",
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min(starts).cast("bigint").alias("first_word"),
        F.array_max(starts).cast("bigint").alias("last_word"),
        listed(labels).alias("base_labels"),
        listed(F.concat(labels, extra)).alias("labels"),
        F.coalesce("best", F.lit(0.0)).alias("score"),
    )


def _sql() -> str:
    def words(text: str) -> str:
        return f"[{', '.join(repr(w) for w in sorted(set(text.split())))}]"

    rows = ", ".join(
        f"('{label}', {words(t)}, {words(telling)}, {_needed(len(set(t.split())), THRESHOLD)})" for label, telling, t in TEMPLATES
    )
    starts = " UNION ALL ".join(
        f"SELECT *, unnest(range(0, len(split), {step})) AS i, {length} AS length FROM read" for length, step in RUNS
    )

    def at(phrase: str) -> str:
        parts = phrase.split()
        tests = " AND ".join(f"words[i + {k}] = '{w}'" for k, w in enumerate(parts))
        return f"list_filter(range(1, len(words) + 1), lambda i: {tests})"

    pieces = [f"list_transform({at(p)}, lambda i: {{'at': i - 1, 'label': '{label}'}})" for p, label in PHRASES.items()]
    places = reduce(lambda a, b: f"list_concat({a}, {b})", pieces)
    lowered = f"translate(coalesce(text, ''), '{UPPER_LETTERS}', '{UPPER_LETTERS.lower()}')"
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""
WITH templates(label, parts, telling, needed) AS (VALUES {rows}),
read AS (
    SELECT doc_id, regexp_extract_all({lowered}, '{word}') AS words, string_split({lowered}, chr(10)) AS split FROM documents
), based AS (
    SELECT doc_id, len(words) AS n_words, {places} AS places FROM read
), runs AS (
    {starts}
), lines AS (
    SELECT doc_id, list_distinct(regexp_extract_all(array_to_string(split[i + 1:i + length], chr(10)), '{word}')) AS parts
    FROM runs
), found AS (
    SELECT doc_id, list(DISTINCT t.label) AS more,
           max(len(list_intersect(l.parts, t.parts)) / len(t.parts)::DOUBLE) AS best
    FROM lines l JOIN templates t ON len(list_intersect(l.parts, t.parts)) >= t.needed
        AND list_has_all(l.parts, t.telling) GROUP BY doc_id
)
SELECT doc_id, n_words, len(places) AS n_base,
       list_min(list_transform(places, lambda p: p.at)) AS first_word,
       list_max(list_transform(places, lambda p: p.at)) AS last_word,
       array_to_string(list_sort(list_distinct(list_transform(places, lambda p: p.label))), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(
           list_transform(places, lambda p: p.label), coalesce(more, [])))), ',') AS labels,
       coalesce(best, 0.0)::DOUBLE AS score
FROM based LEFT JOIN found USING (doc_id)
"""


LABELS_SQL = _sql()
