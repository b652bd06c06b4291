"""License scans: diagonal voting of word k-grams.

All rolling word k-gram hashes of all texts are joined to the places of the same k-grams in license templates.
A hit at word i of a text and word p of a template votes for the offset diagonal i - p. Diagonals of one text
and template that lie next to each other (a word added or left out) are merged, and a merged span is verified by
the share of the template's k-grams that it holds and by its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, literal_table

#: Phrases whose places are counted, and wordings of licenses (public texts and customary notices).
PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
TEMPLATES = (
    ("mit", "released under the MIT License"),
    ("mit", "licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "licensed under CC BY 4.0"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
)
#: Word k-grams; words between merged diagonals; least share of a template's k-grams; most length of a span in templates.
K, SLACK, COVERED, STRETCH = 3, 4, 0.75, 1.5


def lowered(text: Column) -> Column:
    """A-Z lower-cased, and nothing else; for texts of ASCII alone lower() is that, and faster."""
    a_to_z = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(a_to_z)


def license_words(text: Column) -> Column:
    """Runs of ASCII letters and digits and of all other characters above ASCII, A-Z lower-cased; null text: none."""
    return F.array_remove(F.split(lowered(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def kgram_hashes(words: Column, k: int) -> Column:
    """Hash of the k words from each word on; no hashes for fewer than k words."""
    return let(words, lambda w: F.when(F.size(w) < k, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.xxhash64(*[F.get(w, i + (j - 1)) for j in range(k)]))))


def template_grams(spark: SparkSession, templates=TEMPLATES, k: int = K) -> DataFrame:
    """gram, template, label, grams (of the template), at (its word): a constant table of a few hundred rows."""
    rows = [{"template": n, "label": label, "wording": wording} for n, (label, wording) in enumerate(templates)]
    table = literal_table(spark, rows, "template: int, label: string, wording: string")
    hashes = table.select("template", "label", kgram_hashes(license_words(F.col("wording")), k).alias("hashes"))
    return hashes.select("template", "label", F.size("hashes").alias("grams"), F.posexplode("hashes").alias("at", "gram"))


def license_spans(docs: DataFrame, *, templates=TEMPLATES, k: int = K, slack: int = SLACK, covered: float = COVERED, stretch: float = STRETCH) -> DataFrame:
    """doc_id, text_hash, template, label, start, length (words), covered (0 to 1): verified spans of all texts.

    A text is known by doc_id and hash, so rows that share an id keep apart; rows equal in both give one set of spans.
    """
    grams = template_grams(docs.sparkSession, templates, k)
    rolling = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(kgram_hashes(license_words(F.col("text")), k)).alias("i", "gram"))
    hits = rolling.join(F.broadcast(grams), "gram")  # a constant table
    diagonals = hits.groupBy("doc_id", "text_hash", "template", "label", "grams", (F.col("i") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("ats"), F.min("i").alias("first"), F.max("i").alias("last"))
    order = Window.partitionBy("doc_id", "text_hash", "template").orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(order) > slack).cast("int")
    merged = (
        diagonals.withColumn("apart", F.coalesce(apart, F.lit(0)))
        .withColumn("run", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("doc_id", "text_hash", "template", "label", "grams", "run")
        .agg(F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("held"), F.min("first").alias("start"), (F.max("last") + k - F.min("first")).alias("length"))
    )
    share = F.col("held") / F.col("grams")
    verified = merged.filter((share >= covered) & (F.col("length") <= stretch * (F.col("grams") + k - 1)))
    return verified.select("doc_id", "text_hash", "template", "label", "start", "length", share.alias("covered"))


def phrase_starts(words: Column, phrase: str) -> Column:
    parts = phrase.split(" ")
    same = lambda w, i: F.reduce(F.array(*[F.get(w, i + (j - 1)) == p for j, p in enumerate(parts)]), F.lit(True), lambda a, b: a & b)
    return let(words, lambda w: F.when(F.size(w) < len(parts), F.array().cast("array<int>")).otherwise(F.filter(F.transform(F.sequence(F.lit(1), F.size(w) - len(parts) + 1), lambda i: F.when(same(w, i), i - 1)), lambda i: i.isNotNull())))


def scan_licenses(docs: DataFrame, *, templates=TEMPLATES, **parameters) -> DataFrame:
    """A row a document: n_words, places of the phrases, labels by phrase and by template, and a score.

    Null and empty texts have no words, places or labels and score 0. Rows that repeat keep one row each. A score is
    1 where a phrase stands, else the share of the best verified template. Other columns are not looked at.
    """
    docs = docs.select("doc_id", "text")
    words = license_words(F.col("text"))
    asked = F.instr(F.lower("text"), "license") > 0  # every phrase has this word
    none = F.array().cast("array<int>")
    based = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.size(words).cast("long").alias("n_words"), *[F.when(asked, phrase_starts(words, phrase)).otherwise(none).alias(f"at_{label}") for label, phrase in PHRASES.items()])
    places = F.concat(*[F.col(f"at_{label}") for label in PHRASES])
    base = F.sort_array(F.filter(F.array(*[F.when(F.size(f"at_{label}") > 0, label) for label in PHRASES]), lambda x: x.isNotNull()))
    based = based.select("doc_id", "text_hash", "n_words", F.size(places).cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"), base.alias("base"))
    found = license_spans(docs, templates=templates, **parameters).groupBy(F.col("doc_id").alias("found_id"), F.col("text_hash").alias("found_hash")).agg(F.collect_set("label").alias("found"), F.max("covered").alias("covered"))
    both = based.join(found, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("text_hash") == F.col("found_hash")), "left")
    labels = F.sort_array(F.array_distinct(F.concat("base", F.coalesce("found", F.array().cast("array<string>")))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("covered", F.lit(0.0)))
    return both.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))
