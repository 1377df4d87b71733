"""License scanning: an exact set-similarity join of text blocks with license templates.

A block is a line of a text, or a window of as many consecutive words as the template has, whatever line breaks
and comment marks stand between them; blocks and templates are sets of words (ASCII letters and digits, A-Z
lower-cased, and all characters above ASCII). A block meets a template when it holds at least
``share`` of the template's distinct words.

1. The templates' words are ordered by their number of occurrences in all texts, rarest first.
2. *Prefix filter.* With o = ceil(share * t), a block that meets a template of t words holds one of
   its t - o + 1 first words. Only blocks with such a word go on, one row for each word of any template.
3. *Length filter.* The block has at least o distinct template words.
4. *Positional filter.* For the first common prefix word, at place i of t in the template and j of b in the
   block, the overlap is at most 1 + min(t - i - 1, b - j - 1).
5. Surviving pairs are verified by intersection.

Windows are found around the prefix words: each that meets the template lies among the words on both sides of one.
The length filter is put to these, and then all windows in them are compared.

Beside it, base phrases are found wherever their words stand consecutively. DataFrame functions only.
The join works on distinct texts by their SHA-256, so copies are joined once.

Null and empty texts have no words, no labels and the score 0. Repeated ids and rows stay separate rows; null
ids are kept. Templates without words match nothing. Further columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import keep

#: Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Templates of a block: their index is broadcast, and each block of templates reads the texts once.
BLOCK = 500

#: Public license notices and their labels: fixed values.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("reserved", "All rights reserved."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)

_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words of short texts, A-Z lower-cased."""
    return F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), _BETWEEN), "")


def word_count(text: Column) -> Column:
    """Words of a text; one that begins or ends between words has an empty piece there."""
    pieces = F.split(text, _BETWEEN)
    return F.size(pieces) - F.when(pieces[0] == "", 1).otherwise(0) - F.when(
        (F.size(pieces) > 1) & (F.element_at(pieces, -1) == ""), 1
    ).otherwise(0)


def phrase_places(words: Column, phrase: str) -> Column:
    """Starts, in words from 0, of all places where the phrase's words stand consecutively."""
    parts = phrase.split(" ")
    starts = F.when(F.size(words) >= len(parts), F.sequence(F.lit(0), F.size(words) - len(parts)))

    def here(i: Column) -> Column:
        test = F.get(words, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            test = test & (F.get(words, i + k) == part)
        return test

    return F.coalesce(F.filter(starts, here), F.array().cast("array<int>"))


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES), "label string, template string")


def template_labels(texts: DataFrame, templates: DataFrame, share: float = 0.8) -> DataFrame:
    """(blob, labels, score) of the texts (blob, text) with a block that meets a template, for any number of templates."""
    spark = texts.sparkSession
    sets = templates.distinct().select(
        F.xxhash64("label", "template").alias("t_id"), "label", F.array_distinct(words_of(F.col("template"))).alias("words"),
        F.size(words_of(F.col("template"))).alias("n"),
    )
    sets = keep(sets.where(F.size("words") > 0), "templates")
    blocks = math.ceil(sets.count() / BLOCK)
    found = spark.createDataFrame([], "blob binary, label string, share double")
    for k in range(blocks):
        listed = sets.where(F.pmod("t_id", F.lit(blocks)) == k).collect()
        if listed:
            found = found.unionByName(_block_labels(texts, listed, share))
    return found.groupBy("blob").agg(F.collect_set("label").alias("labels"), F.max("share").alias("score"))


def _block_labels(texts: DataFrame, listed: list[Row], share: float) -> DataFrame:
    """(blob, label, share) of the texts and the templates (t_id, label, words, n) that they meet."""
    spark = texts.sparkSession
    vocabulary = sorted({w for r in listed for w in r["words"]})
    spoken = texts.select(F.explode(F.split("text", _BETWEEN)).alias("word")).select(F.lower("word").alias("word"))
    seen = spoken.where(F.col("word").isin(vocabulary)).groupBy("word").count()
    often = {r["word"]: r["count"] for r in seen.collect()}
    order = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (often.get(w, 0), w)))}

    index = []  # a row for each prefix word of each template
    for r in listed:
        ranks = sorted(order[w] for w in r["words"])
        need = math.ceil(len(ranks) * share - 1e-9)
        index += [(r["t_id"], r["label"], rank, i, len(ranks), need, ranks) for i, rank in enumerate(ranks[: len(ranks) - need + 1])]
    by_rank = {k: w for w, k in order.items()}
    lengths = {r["t_id"]: r["n"] for r in listed}
    first_words = sorted({by_rank[row[2]] for row in index})
    index_df = spark.createDataFrame(index, "t_id long, label string, rank int, i int, t int, need int, ranks array<int>")
    ranked = spark.createDataFrame(list(order.items()), "word string, rank int")

    holds = "(?i)(?<![0-9A-Za-z\\x80-\\x{10FFFF}])(?:" + "|".join(first_words) + ")(?![0-9A-Za-z\\x80-\\x{10FFFF}])"
    lines = texts.where(F.col("text").rlike(holds)).select("blob", F.explode(F.split("text", "\n")).alias("line"))
    lines = lines.where(F.col("line").rlike(holds)).distinct().withColumn("block", F.xxhash64("line"))
    words = lines.select("blob", "block", F.explode(F.array_distinct(words_of(F.col("line")))).alias("word"))
    blocks = words.join(F.broadcast(ranked), "word").groupBy("blob", "block")
    blocks = blocks.agg(F.array_sort(F.collect_set("rank")).alias("own"))
    probes = blocks.select("blob", "block", "own", F.posexplode("own").alias("j", "rank"))
    met = probes.join(F.broadcast(index_df), "rank").where(F.size("own") >= F.col("need"))
    room = 1 + F.least(F.col("t") - F.col("i") - 1, F.size("own") - F.col("j") - 1)
    first = met.groupBy("blob", "block", "t_id").agg(
        F.min_by(F.struct("label", "own", "ranks", "need", "t", room.alias("room")), "i").alias("m")
    )
    common = F.size(F.array_intersect("m.own", "m.ranks"))
    found = first.where("m.room >= m.need").where(common >= F.col("m.need"))
    found = found.select("blob", "m.label", (common / F.col("m.t")).alias("share"))

    starts = [
        (by_rank[rank], label, len(ranks), need, [by_rank[k] for k in ranks], lengths[t_id])
        for t_id, label, rank, _, _, need, ranks in index
    ]
    starts_df = spark.createDataFrame(starts, "word string, label string, t int, need int, wanted array<string>, n int")
    broken = texts.where(F.col("text").contains("\n") & F.col("text").rlike(holds)).select("blob", words_of(F.col("text")).alias("words"))
    near = broken.select("blob", "words", F.posexplode("words").alias("at", "word")).where(F.col("word").isin(first_words))
    near = near.join(F.broadcast(starts_df), "word")
    left = F.greatest(F.col("at") - F.col("n") + 1, F.lit(0))
    near = near.select("blob", "label", "t", "need", "wanted", "n", F.slice("words", left + 1, F.col("at") + F.col("n") - left).alias("around"))
    near = near.where(F.size(F.array_intersect("wanted", "around")) >= F.col("need"))
    places = F.sequence(F.lit(0), F.greatest(F.size("around") - F.col("n"), F.lit(0)))
    held = F.transform(places, lambda k: F.size(F.array_intersect(F.col("wanted"), F.slice(F.col("around"), k + 1, F.col("n")))))
    windows = near.select("blob", "label", "t", "need", F.array_max(held).alias("held")).where("held >= need")
    return found.unionByName(windows.select("blob", "label", (F.col("held") / F.col("t")).alias("share")))


def scan_licenses(
    docs: DataFrame,
    templates: DataFrame | None = None,
    share: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row.

    score is the largest share of a template that a block holds, 1 where a base phrase stands.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("blob"))
    if templates is None:
        templates = default_templates(docs.sparkSession)
    labelled = keep(template_labels(own.select("blob", "text"), templates, share), "licenses")

    gate = "|".join(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+".join(p.split(" ")) for p in PHRASES)
    rows = own.select(
        "id", "blob", word_count(F.col("text")).cast("long").alias("n_words"),
        F.when(F.col("text").rlike(f"(?i){gate}"), words_of(F.col("text"))).alias("words"),
    )
    none = F.array().cast("array<int>")
    for k, phrase in enumerate(PHRASES):
        rows = rows.withColumn(f"p{k}", F.when(F.col("words").isNotNull(), phrase_places(F.col("words"), phrase)).otherwise(none))
    places = F.concat(*(F.col(f"p{k}") for k in range(len(PHRASES))))
    base = F.array_sort(F.array_compact(F.array(*(F.when(F.size(f"p{k}") > 0, F.lit(label)) for k, label in enumerate(PHRASES.values())))))
    rows = rows.select(
        "id", "blob", "n_words", F.size(places).cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"), F.array_distinct(base).alias("base"),
    )
    out = rows.join(labelled, "blob", "left")
    more = F.coalesce("labels", F.array().cast("array<string>"))
    return out.select(
        F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", more)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("score", F.lit(0.0))).alias("score"),
    )
