"""License notices: fixed phrases, and an exact set-similarity join of text blocks with licence templates.

A block is up to ``BLOCK_LINES`` consecutive lines. It matches a template if it contains at least ``percent`` % of the
template's distinct words. Words are ordered by how many documents of the whole input hold them, rarest first. A template's
prefix is so short that a block that meets the threshold must hold one of its words; pairs that share a prefix word pass a
length filter and a positional filter (what can still follow the first common word) before the words are compared in full.

Only words of templates matter for a match, so texts are reduced to these at once, and texts that as a whole can't meet any
threshold have no blocks. Everything is a DataFrame expression or a join; the templates are a constant of this module.

Defined results: a null text counts as empty: no words, no places, no labels, score 0. Rows that repeat an id are scanned each
by itself; ties of labels are told by their order. Other columns pass through, whatever their names; the text doesn't, and columns
named like the made ones are replaced.
"""

from __future__ import annotations

import re
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, nested, unnested

BLOCK_LINES = 3
PERCENT = 80
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Sentences of well-known public notices, by label.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]

_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _template_words(text: str) -> list[str]:
    return sorted({w for w in re.split(_BREAKS, text.translate(str.maketrans(_UPPER, _LOWER))) if w})


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), _BREAKS), "")


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _strings(values: list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def scan_licenses(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` (text, ...) without text, with n_words, n_base, first_word, last_word, base_labels, labels and score.

    score is the largest share of a template's words found in a block that meets the threshold, 1 with a phrase, else 0.
    """
    scratch = Scratch(docs.sparkSession, "license-scan")
    templates = [(label, _template_words(text)) for label, text in TEMPLATES]
    need = [ceil(percent * len(w) / 100) for _, w in templates]
    vocabulary = sorted({w for _, ws in templates for w in ws})
    made = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    own, kept = nested(docs, [*made, "text"])

    read = docs.select(own.alias("own"), F.coalesce("text", F.lit("")).alias("_text")).withColumn("_words", _words(F.col("_text")))
    read = read.withColumn("_flat", F.when(F.array_contains("_words", "license"), F.concat(F.lit(" "), F.array_join("_words", " "), F.lit(" "))))
    read = read.withColumn("_seen", F.array_intersect("_words", _strings(vocabulary)))
    n_words, counts, firsts, lasts, labels = F.size("_words").cast("long"), [], [], [], []
    for phrase, label in PHRASES.items():
        parts = F.split(F.col("_flat"), f" {phrase}(?= )")
        n = F.when(F.col("_flat").isNull(), 0).otherwise(F.size(parts) - 1)
        counts.append(n)
        firsts.append(F.when(n > 0, _spaces(F.element_at(parts, 1))))
        lasts.append(F.when(n > 0, n_words - (_spaces(F.element_at(parts, -1)) - 1) - len(phrase.split())))
        labels.append(F.when(n > 0, label))
    could = F.lit(False)
    for (_, ws), least in zip(templates, need, strict=True):
        could = could | (F.size(F.array_intersect("_seen", _strings(ws))) >= least)
    base = read.select(
        "own", "_seen", n_words.alias("n_words"), sum(counts[1:], counts[0]).cast("long").alias("n_base"),
        F.least(*firsts).cast("long").alias("first_word"), F.greatest(*lasts).cast("long").alias("last_word"),
        F.array_sort(F.array_compact(F.array(*labels))).alias("_base_labels"),
        F.when(could, F.split("_text", "\n")).alias("_lines"),
    ).withColumn("_row", F.monotonically_increasing_id())
    base = scratch.save(base, "base")

    held = {r[0]: r[1] for r in base.select(F.explode("_seen").alias("w")).groupBy("w").count().collect()}  # a row a word of the templates
    order = sorted(vocabulary, key=lambda w: (held.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    ranked = [sorted(rank[w] for w in ws) for _, ws in templates]
    values = ", ".join(
        f"({r}, {i}, {at}, {len(ranks)}, {least}, '{label}', array({', '.join(map(str, ranks))}))"
        for i, ((label, _), ranks, least) in enumerate(zip(templates, ranked, need, strict=True))
        for at, r in enumerate(ranks[: len(ranks) - least + 1])
    )
    prefixes = docs.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t(word_rank, template, template_at, template_size, need, label, ranks)")

    starts = F.sequence(F.lit(1), F.size("_lines"))
    line_blocks = F.transform(starts, lambda i: F.array_join(F.slice("_lines", i, BLOCK_LINES), "\n"))
    blocks = base.where("_lines is not null").select("_row", F.posexplode(line_blocks).alias("block", "_text"))
    rank_of = F.create_map(*(F.lit(x) for w in order for x in (w, rank[w])))
    block_ranks = F.sort_array(F.transform(F.array_intersect(_words(F.col("_text")), _strings(vocabulary)), lambda w: F.element_at(rank_of, w)))
    blocks = blocks.select("_row", "block", block_ranks.alias("ranks_of_block")).where(F.size("ranks_of_block") >= min(need))
    probes = blocks.select("_row", "block", "ranks_of_block", F.posexplode("ranks_of_block").alias("own_at", "word_rank"))
    pairs = probes.join(F.broadcast(prefixes), "word_rank").where(F.size("ranks_of_block") >= F.col("need"))
    # the first common word of a pair decides: no word of either before it is common
    first = pairs.groupBy("_row", "block", "template").agg(F.min(F.struct("own_at", "template_at", "template_size", "need", "label", "ranks", "ranks_of_block")).alias("p")).select("_row", "p.*")
    open_pairs = first.where(1 + F.least(F.col("template_size") - F.col("template_at") - 1, F.size("ranks_of_block") - F.col("own_at") - 1) >= F.col("need"))
    common = F.size(F.array_intersect("ranks_of_block", "ranks"))
    matches = open_pairs.select("_row", "label", "need", common.alias("common"), (common / F.col("template_size")).alias("share")).where(F.col("common") >= F.col("need"))
    found = matches.groupBy("_row").agg(F.collect_set("label").alias("_labels"), F.max("share").alias("_share"))

    none = F.array().cast("array<string>")
    return base.drop("_seen", "_lines").join(found, "_row", "left").select(
        *unnested(kept), "n_words", "n_base", "first_word", "last_word", F.array_join("_base_labels", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("_base_labels", F.coalesce("_labels", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("_share", F.lit(0.0))).alias("score"),
    )
