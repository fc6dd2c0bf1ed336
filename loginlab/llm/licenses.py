"""License scans as an exact set-similarity join.

A template is the set of words of a license notice; a text block is a line of a document, or a run of
words across line breaks that is at most 1 / ``threshold`` times as long as the notice, so notices that are
wrapped are found as well. A template is found in a block if the block has at least ``threshold`` of the
template's words. The SQL of the query knows lines only: it agrees where no notice is wrapped.
All template words are counted over the whole corpus and ordered from rare to frequent. If a block
contains ``need`` of a template's ``n`` words, it contains one of the first ``n - need + 1`` of them
(prefix filter); at position ``p`` of the template at most ``n - p`` words can still be shared, counting
from zero (positional filter); and the block has at least ``need`` words itself (length filter).
Surviving pairs are verified on their whole word sets, so the join is exact.

Null text counts as empty: no words, no labels, score 0. Repeated rows are scanned each. Other
columns are ignored. Templates without words are never found; equal templates count once. An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loginlab.llm.common import kept, table

# fixed values: the phrases and labels of the stated query
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

# fixed values: sentences of public license notices that stand in files
TEMPLATES = [
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files, to deal in the Software without restriction",
    ),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance "
        "with the License",
    ),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation",
    ),
    ("gpl", "This work is licensed under the GNU General Public License"),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met",
    ),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    (
        "cc-by-sa",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ),
    (
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    ),
    ("mit", "Released under the MIT License"),
]
THRESHOLD = 0.8
MOST_WORDS = 20_000  # words of all templates that the plan may hold
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# what stands between words: ASCII characters but digits and letters
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def spaced(text: Column) -> Column:
    """The words of a text, case kept, each followed by a space, after a first space."""
    return F.regexp_replace(F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" ")), BETWEEN, " ")


def lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def word_set(text: Column) -> Column:
    return F.array_distinct(F.split(F.trim(text), " "))


def _templates(spark, templates) -> DataFrame:
    rows = spark.createDataFrame(templates, "label string, notice string")
    words = rows.withColumn("words", F.array_sort(word_set(lower(spaced(F.col("notice"))))))
    words = words.where(F.trim(spaced(F.col("notice"))) != "")
    length = F.size(F.split(F.trim(spaced(F.col("notice"))), " "))
    words = words.groupBy("label", "words").agg(F.max(length).alias("length"))
    return words.withColumn("template", F.xxhash64("label", "words"))


def _words(values) -> Column:
    return F.array(*[F.lit(w) for w in sorted(values)]).cast("array<string>")


def _wide(spaced_text: Column) -> Column:
    """Words in lower case; also letters beyond ASCII are lowered, so this finds too much."""
    return F.split(F.lower(spaced_text), " ")


def frequencies(docs: DataFrame, words: list[str], text_col="text") -> DataFrame:
    """⟨word, n⟩: in how many documents each of some words occurs."""
    found = F.array_intersect(_wide(spaced(F.col(text_col))), _words(words))
    counts = docs.select(F.explode(found).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    known = docs.sparkSession.createDataFrame([(w,) for w in words], "word string")  # may be empty
    return known.join(counts, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))


def _prefixes(docs: DataFrame, templates, threshold, text_col) -> DataFrame:
    """⟨template, label, length, words, need, place, word⟩: the rare words by which templates are met."""
    known = kept(_templates(docs.sparkSession, templates))
    vocabulary = [r[0] for r in known.select(F.explode("words")).distinct().limit(MOST_WORDS + 1).collect()]
    if len(vocabulary) > MOST_WORDS:
        raise ValueError("too many template words for one plan: scan in several runs")
    order = frequencies(docs, vocabulary, text_col)
    need = F.greatest(F.lit(1), F.ceil(F.size("words") * threshold - 1e-9)).cast("int")
    ordered = (
        known.select("template", "label", "length", F.explode("words").alias("word"))
        .join(order, "word")
        .groupBy("template", "label", "length")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "word"))), lambda x: x["word"]).alias("words"))
        .withColumn("need", need)
    )
    return kept(
        ordered.select("*", F.posexplode("words").alias("place", "word")).where(F.size("words") - F.col("place") >= F.col("need"))
    )


def _rare(prefix: DataFrame) -> Column:
    return _words(r[0] for r in prefix.select("word").distinct().collect())


def _met(blocks: DataFrame, prefix: DataFrame, rare: Column) -> DataFrame:
    """Blocks with the templates of whose words, ``shared`` of them, they have enough."""
    met = blocks.withColumn("word", F.explode(F.array_intersect("have", rare))).join(F.broadcast(prefix), "word")
    met = met.where(F.size("have") >= F.col("need"))
    # a pair meets at each prefix word that it shares: the first one speaks for it
    earlier = F.slice("words", F.lit(1), F.col("place"))
    met = met.where(~F.arrays_overlap("have", earlier))
    return met.withColumn("shared", F.size(F.array_intersect("have", "words"))).where("shared >= need")


def _lines_with(docs: DataFrame, prefix: DataFrame, rare: Column, id_cols, text_col) -> DataFrame:
    text = F.coalesce(text_col, F.lit(""))
    lines = docs.where(F.arrays_overlap(_wide(spaced(F.col(text_col))), rare)).select(
        *id_cols, F.posexplode(F.split(text, "\n")).alias("block", "line")
    )
    lines = lines.select(*id_cols, F.col("block").cast("long").alias("block"), word_set(lower(spaced(F.col("line")))).alias("have"))
    return _met(lines, prefix, rare).select(
        *id_cols, "block", "label", "template", (F.col("shared") / F.size("words")).alias("containment")
    )


def _runs_with(docs: DataFrame, prefix: DataFrame, rare: Column, threshold, id_cols, text_col) -> DataFrame:
    broken = docs.where(F.contains(F.col(text_col), F.lit("\n")) & F.arrays_overlap(_wide(spaced(F.col(text_col))), rare))
    texts = broken.select(*id_cols, F.split(F.trim(lower(spaced(F.col(text_col)))), " ").alias("all_words"))
    # the whole text is a block that holds all its runs: few texts pass
    met = _met(texts.withColumn("have", F.array_distinct("all_words")), prefix, rare)
    placed = F.transform("all_words", lambda w, i: F.struct(i.alias("at"), w.alias("word")))
    hits = met.select(
        *id_cols,
        "label",
        "template",
        F.size("words").alias("size"),
        "need",
        F.ceil(F.col("length") / threshold - 1e-9).cast("int").alias("run"),
        F.filter(placed, lambda x: F.array_contains("words", x["word"])).alias("hits"),
    )

    def count(hit, i):
        run = F.filter(F.slice("hits", i + 1, F.col("run")), lambda x: x["at"] < hit["at"] + F.col("run"))
        return F.size(F.array_distinct(F.transform(run, lambda x: x["word"])))

    best = hits.withColumn("best", F.array_max(F.transform("hits", count))).where("best >= need")
    return best.select(*id_cols, "label", "template", (F.col("best") / F.col("size")).alias("containment"))


def blocks_with(docs: DataFrame, templates, threshold=THRESHOLD, id_cols=("doc_id",), text_col="text") -> DataFrame:
    """⟨id columns, block, label, template, containment⟩ of every line that has a template."""
    prefix = _prefixes(docs, templates, threshold, text_col)
    return _lines_with(docs, prefix, _rare(prefix), id_cols, text_col)


def runs_with(docs: DataFrame, templates, threshold=THRESHOLD, id_cols=("doc_id",), text_col="text") -> DataFrame:
    """⟨id columns, label, template, containment⟩ of every text with a line break that has a template in
    a run of words at most 1 / ``threshold`` times as long as the notice: the greatest containment."""
    prefix = _prefixes(docs, templates, threshold, text_col)
    return _runs_with(docs, prefix, _rare(prefix), threshold, id_cols, text_col)


def places(words: Column, phrase: str) -> Column:
    """Where the words of a phrase stand one after the other, counted from 0."""
    parts = phrase.split(" ")

    def here(i):
        same = F.get(words, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            same = same & (F.get(words, i + k) == part)
        return same

    return F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, threshold=THRESHOLD, id_col="doc_id", text_col="text") -> DataFrame:
    """Per row of ``docs``: words, places of the phrases, labels by phrases, labels by phrases
    and templates, and the greatest containment found (a phrase counts as 1)."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.withColumn("content", F.xxhash64("text"))
    rows = rows.withColumn("second", F.hash("text"))
    prefix, keys = _prefixes(rows, templates, threshold, "text"), ("id", "content", "second")
    rare = _rare(prefix)
    found = _lines_with(rows, prefix, rare, keys, "text").drop("block")
    found = found.unionByName(_runs_with(rows, prefix, rare, threshold, keys, "text"))
    found = found.groupBy(
        F.col("id").alias("_id"), F.col("content").alias("_content"), F.col("second").alias("_second")
    ).agg(F.collect_set("label").alias("more"), F.max("containment").alias("containment"))

    based = rows.select("id", "content", "second", spaced(F.col("text")).alias("spaced"))
    any_phrase = F.lower("spaced").rlike("|".join(f" {p} " for p, _ in phrases))
    words = F.when(any_phrase, F.split(F.trim(lower(F.col("spaced"))), " "))
    n_words = F.length("spaced") - F.length(F.replace("spaced", F.lit(" "), F.lit(""))) - 1
    based = based.select("id", "content", "second", n_words.cast("long").alias("n_words"), words.alias("words"))
    at = F.array(*[F.struct(F.lit(label).alias("label"), places(F.col("words"), p).alias("at")) for p, label in phrases])
    based = based.withColumn("at", F.when(F.col("words").isNotNull(), F.filter(at, lambda x: F.size(x["at"]) > 0)))
    every = F.flatten(F.transform("at", lambda x: x["at"]))
    based = based.select(
        "id",
        "content",
        "second",
        "n_words",
        F.coalesce(F.size(every), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.coalesce(F.array_distinct(F.transform("at", lambda x: x["label"])), _words([])).alias("base"),
    )
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("content") == F.col("_content")) & (F.col("second") == F.col("_second"))
    both = F.array_union("base", F.coalesce("more", _words([])))
    return based.join(found, same, "left").select(
        F.col("id").alias(id_col),
        "n_words",
        F.greatest("n_base", F.lit(0)).alias("n_base"),
        "first_word",
        "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(both), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql_rows(rows) -> str:
    return ", ".join("('" + "', '".join(v.replace("'", "''") for v in row) + "')" for row in rows)


ORACLE_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), {{word}}) AS words
  FROM documents),
phrases(phrase, label) AS (VALUES {_sql_rows(PHRASES)}),
split_phrases AS (SELECT string_split(phrase, ' ') AS p, label FROM phrases),
hits AS (
  SELECT r, label, unnest(list_filter(range(len(words)), lambda i: words[i + 1:i + len(p)] = p)) AS place
  FROM docs, split_phrases),
base AS (
  SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS base
  FROM hits GROUP BY r),
templates(label, notice) AS (VALUES {_sql_rows(TEMPLATES)}),
sets AS (
  SELECT label, list_distinct(regexp_extract_all(translate(notice, '{UPPER}', '{LOWER}'), {{word}})) AS t
  FROM templates),
blocks AS (
  SELECT DISTINCT r, list_distinct(regexp_extract_all(translate(line, '{UPPER}', '{LOWER}'), {{word}})) AS b
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs)),
more AS (
  SELECT r, list(DISTINCT label) AS more, max(len(list_intersect(t, b)) / len(t)) AS containment
  FROM blocks, sets WHERE len(list_intersect(t, b)) >= ceil({THRESHOLD} * len(t) - 1e-9) GROUP BY r)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(containment, 0) END::DOUBLE AS score
FROM docs LEFT JOIN base USING (r) LEFT JOIN more USING (r)
""".replace("{word}", r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'")
