"""License scans by an exact set-similarity join, in DataFrame functions alone.

Blocks are pieces of a text, as sets of words, whatever its line breaks: the paragraphs between blank lines, and windows of
consecutive words, each of which overlaps the next by as many words as the longest template has, so that so many words in a row
always lie in one window. Templates are license statements, as sets of words. A block meets a template when it holds at least
`threshold` of the template's words. Words are ordered by how many blocks of the corpus hold them, rarest first. A block that
meets a template holds one of its first |T| - need + 1 words in that order (prefix filter), and has at least
`need` words of the templates' vocabulary (length filter). What passes is counted exactly. Only the templates, a fixed list, are broadcast.

A text is cut into blocks only if it holds a phrase, or one of some |T| - need + 1 words of a template T, here its longest:
without any of these it has too few words of T left, so this leaves out no block that meets T.

Apart from that join, PHRASES are found where their words stand in a row, whatever stands between the words.

Null text is empty: no words, no places, empty label lists, score 0. Repeated rows and repeated doc_ids are separate documents.
Only doc_id and text are read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, pick

#: Base phrases with their labels, and templates with theirs.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]
THRESHOLD = 0.9
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD, GAP = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
#: WORD before letters are made small.
ANY_WORD, BLANK_LINE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"\n[\x20\x09\x0B-\x0D]*\n"


def phrase_pattern(phrase: str) -> str:
    return rf"(?<!{WORD[:-1]})" + rf"{GAP}+".join(phrase.split()) + rf"(?!{WORD[:-1]})"


def _template_words(spark, threshold):
    raw = spark.createDataFrame([(i, label, text) for i, (label, text) in enumerate(TEMPLATES)], "template int, label string, text string")
    words = F.array_distinct(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(WORD), F.lit(0)))
    return raw.select("template", "label", words.alias("words")).withColumn("need", F.ceil(F.size("words") * F.lit(threshold)).cast("int"))


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spark = docs.sparkSession
    templates = _template_words(spark, threshold)
    vocabulary = sorted({w for r in templates.select("words").collect() for w in r["words"]})
    wanted = templates.select("words", "need").collect()
    signs = {w for r in wanted for w in sorted(r["words"], key=lambda w: (-len(w), w))[: len(r["words"]) - r["need"] + 1]}
    loose = [rf"{ANY_WORD.replace('[^', '[')[:-1]}+".join(p.split()) for p in PHRASES]
    candidate = "(?i)(?:" + "|".join([*sorted(signs), *loose]) + ")"
    longest = max(len(re.findall("[A-Za-z0-9]+", text)) for _, text in TEMPLATES)
    texts = pick(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("row_id"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    low = texts.select("row_id", "doc_id", F.regexp_count("text", F.lit(ANY_WORD)).cast("long").alias("n_words"), F.when(F.col("text").rlike(candidate), F.translate("text", UPPER, LOWER)).otherwise("").alias("low"))
    low = low.withColumn("all", F.regexp_extract_all("low", F.lit(WORD), F.lit(0)))
    places = [F.regexp_count("low", F.lit(phrase_pattern(p))) for p in PHRASES]
    any_phrase = "(?:" + "|".join(phrase_pattern(p) for p in PHRASES) + ")"
    words_before = lambda text: F.regexp_count(text, F.lit(WORD)).cast("long")
    first = F.when(F.col("n_base") > 0, words_before(F.regexp_extract("low", rf"(?s)^(.*?){any_phrase}", 1)))
    last = F.when(F.col("n_base") > 0, words_before(F.regexp_extract("low", rf"(?s)^(.*){any_phrase}", 1)))
    known = lambda words: F.array_intersect(words, F.array(*map(F.lit, vocabulary)))
    paragraphs = F.transform(F.split("low", BLANK_LINE), lambda t: known(F.regexp_extract_all(t, F.lit(WORD), F.lit(0))))
    windows = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size("all") / longest).cast("int") - 2)), lambda k: known(F.slice("all", k * longest + 1, F.lit(2 * longest))))
    rows = low.withColumn("places", F.array(*places)).select(
        "row_id", "doc_id", "low", "n_words", F.aggregate("places", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_base"),
        F.array_sort(F.filter(F.array(*(F.when(F.col("places")[i] > 0, F.lit(label)) for i, label in enumerate(PHRASES.values()))), lambda x: x.isNotNull())).alias("base"),
        F.array_distinct(F.filter(F.concat(paragraphs, windows), lambda s: F.size(s) > 0)).alias("blocks"),
    )
    rows = materialize(rows.select("row_id", "doc_id", "n_words", "n_base", first.alias("first_word"), last.alias("last_word"), "base", "blocks"))

    blocks = rows.select("row_id", F.posexplode("blocks").alias("block", "words"))
    counted = blocks.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("held"))
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "word")))
    ranked = templates.select("template", "label", "need", F.explode("words").alias("word")).join(counted, "word", "left").groupBy("template", "label", "need").agg(order.alias("ordered"))
    prefix = ranked.select("template", "label", "need", F.size("ordered").alias("size"), F.transform("ordered", lambda s: s["word"]).alias("wanted"), F.posexplode("ordered").alias("at", "w")).filter("at <= size - need").withColumn("word", F.col("w.word"))
    least = templates.agg(F.min("need")).first()[0]
    entry = blocks.filter(F.size("words") >= least).select("row_id", "block", "words", F.explode("words").alias("word"))
    met = entry.join(F.broadcast(prefix), "word").filter("size(words) >= need")
    met = met.groupBy("row_id", "block", "template", "label", "need", "size").agg(F.first("words").alias("words"), F.first("wanted").alias("wanted"))
    met = met.withColumn("common", F.size(F.array_intersect("words", "wanted"))).filter("common >= need")
    found = met.groupBy("row_id").agg(F.collect_set("label").alias("more"), F.max(F.col("common") / F.col("size")).alias("best"))
    both = rows.join(found, "row_id", "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    return both.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).cast("double").alias("score"))
