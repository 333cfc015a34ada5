"""License scans: exact set-similarity join of text blocks with license templates."""

from __future__ import annotations

import math
import re
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import cut, keyed, lower_ascii, real_id

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Phrases whose places are reported, and their labels.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
# Usual license notices by label.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("all-rights-reserved", "All rights reserved."),
]
CONTAINMENT = 0.8
#: A block has so many times the words of the template it is held against.
SPAN = 2


class Template(NamedTuple):
    k: int
    label: str
    words: list[str]  # distinct
    span: int  # words of a block
    need: int  # distinct words of the template that a block must hold


def _prepared(templates: list[tuple[str, str]], containment: float) -> list[Template]:
    out = []
    for label, text in templates:
        words = re.findall(WORD, text.lower())
        if words:
            distinct = list(dict.fromkeys(words))
            out.append(Template(len(out), label, distinct, SPAN * len(words), max(1, math.ceil(containment * len(distinct) - 1e-9))))
    return out


def _found(docs: DataFrame, templates: list[Template]) -> DataFrame:
    """(id, h, labels, share) of the documents with a block that fits a template."""
    text = lower_ascii(F.coalesce("text", F.lit("")))
    rows = keyed(docs, F.split(F.regexp_replace(text, GAP, " "), " ").alias("words"))
    vocabulary = sorted({w for t in templates for w in t.words})
    counted = rows.select(F.explode(F.array_intersect("words", F.lit(vocabulary))).alias("w")).groupBy("w").count()
    seen = {r["w"]: r["count"] for r in counted.collect()}  # as many rows as the templates have words
    order = sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    spark = docs.sparkSession
    sets = [(t.k, t.label, sorted(t.words, key=rank.get), t.span, t.need) for t in templates]
    table = spark.createDataFrame(sets, "k int, label string, set array<string>, span int, need int")
    prefixes = [(w, k, need) for k, _, words, _, need in sets for w in words[: len(words) - need + 1]]
    index = spark.createDataFrame(prefixes, "w string, k int, need int")

    # a block's words are the document's, so what the document lacks no block has
    rare = F.lit(sorted({w for w, _, _ in prefixes}))
    rows = rows.filter(F.arrays_overlap("words", rare))
    own = rows.select("id", "h", F.array_intersect(F.lit(order), "words").alias("own"))
    spots = own.select("id", "h", F.size("own").alias("n"), F.posexplode("own").alias("at", "w"))
    # length filter: enough words at all; positional filter: enough words from this one on, which is the rarest shared
    candidates = spots.join(index, "w").filter("n >= need").groupBy("id", "h", "k").agg(F.min(F.struct("at", "n", "need")).alias("x"))
    candidates = candidates.filter("x.n - x.at >= x.need").select("id", "h", "k")
    candidates = cut(candidates)

    # places of template words in candidate documents; a block of `span` words lies within two neighbouring stretches
    hits = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("p"), w.alias("w"))), lambda x: x["w"].isin(vocabulary))
    places = rows.select("id", "h", hits.alias("hits")).join(candidates, ["id", "h"]).select("id", "h", "k", F.inline("hits"))
    words = table.select("k", "label", "span", "need", F.size("set").alias("size"), F.explode("set").alias("w"), F.slice("set", F.lit(1), F.size("set") - F.col("need") + 1).alias("prefix"))
    words = words.withColumn("rare", F.array_contains("prefix", F.col("w"))).drop("prefix")
    near = places.join(words, ["k", "w"])
    near = near.withColumn("stretch", F.explode(F.array(F.floor(F.col("p") / F.col("span")), F.floor(F.col("p") / F.col("span")) - 1)))
    blocks = near.groupBy("id", "h", "k", "label", "span", "need", "size", "stretch").agg(F.collect_set(F.struct("p", "w")).alias("x"), F.max("rare").alias("rare"))
    blocks = blocks.filter(F.col("rare") & (F.size(F.array_distinct("x.w")) >= F.col("need")))
    shared = F.array_max(
        F.transform("x", lambda a: F.size(F.array_distinct(F.transform(F.filter("x", lambda b: (b["p"] >= a["p"]) & (b["p"] < a["p"] + F.col("span"))), lambda b: b["w"]))))
    )
    fits = blocks.withColumn("shared", shared).filter("shared >= need")
    return fits.groupBy("id", "h").agg(F.array_sort(F.collect_set("label")).alias("found"), F.max(F.col("shared") / F.col("size")).alias("share"))


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """Base phrases and license templates in every document, by DataFrame functions alone.

    A block is a run of words, twice as many as the template has, wherever lines end; it fits a template when it holds
    at least `containment` of the template's distinct words. First a pass over all documents counts in how many each
    template word is, which gives their global order, rarest first. Each template is filed under its prefix: so many of
    its rarest words that a fitting block must hold one of them. A document's template words in that order join the
    index by a prefix word; it is a candidate if it has enough words (length filter) and enough of them follow
    (positional filter). In candidates the places of template words are gathered by stretches of a block's size, and the
    blocks that begin at each are verified by their whole intersection.

    Templates are a parameter, (label, text) pairs or a frame of them; a label may have several. They are tables joined
    with the corpus, while their distinct words also stand in the plan. score is the largest containment found, and 1
    where a base phrase occurs, else 0. Null and empty texts have no words, no places, empty labels and score 0.
    Repeated rows each give a row; an empty table gives none; columns other than doc_id and text are not read.
    """
    if isinstance(templates, DataFrame):
        templates = [(r["label"], r["text"]) for r in templates.select("label", "text").collect()]  # a table of notices, not of documents
    prepared = _prepared(TEMPLATES if templates is None else templates, containment)
    spaced = keyed(docs, lower_ascii(F.coalesce("text", F.lit(""))).alias("low")).withColumn(
        "flat", F.concat(F.lit(" "), F.replace(F.trim(F.regexp_replace("low", GAP, " ")), F.lit(" "), F.lit("  ")), F.lit(" "))
    )
    n_words = lambda c: ((F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))) / 2).cast("long")
    rows = spaced.select("id", "h", "flat", F.when(F.col("flat") == "  ", F.lit(0)).otherwise(n_words(F.col("flat"))).cast("long").alias("n_words"))
    places = []
    for phrase, label in PHRASES:
        inner = f" {phrase.replace(' ', '  ')} "
        has = F.col("flat").contains(inner)
        n = (F.length("flat") - F.length(F.replace("flat", F.lit(inner), F.lit("")))) / len(inner)
        after = n_words(F.substring_index("flat", inner, -1))
        places.append(
            F.struct(
                F.when(has, n).otherwise(0).cast("long").alias("n"),
                F.when(has, n_words(F.substring_index("flat", inner, 1))).alias("first"),
                F.when(has, F.col("n_words") - after - len(phrase.split())).alias("last"),
                F.when(has, F.lit(label)).alias("label"),
            )
        )
    rows = rows.select("id", "h", "n_words", F.array(*places).alias("places"))
    if prepared:
        rows = rows.join(_found(docs, prepared), ["id", "h"], "left")
    else:
        rows = rows.select("*", F.lit(None).cast("array<string>").alias("found"), F.lit(None).cast("double").alias("share"))
    base = F.array_compact(F.col("places.label"))
    return rows.select(
        real_id().alias("doc_id"),
        "n_words",
        reduce(lambda a, b: a + b, (F.col("places")[i]["n"] for i in range(len(PHRASES)))).alias("n_base"),
        F.array_min("places.first").alias("first_word"),
        F.array_max("places.last").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, F.coalesce("found", F.array().cast("array<string>"))))), ",").alias("labels"),
        F.greatest(F.coalesce("share", F.lit(0.0)), F.when(F.size(base) > 0, 1.0).otherwise(0.0)).alias("score"),
    )


def scan_sql() -> str:
    """The same by brute force: every block against every template."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    listed = lambda xs: "[" + ", ".join(map(quoted, xs)) + "]"
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    start = lambda p: "list_filter(range(1, len(words) + 1), lambda i: " + " AND ".join(f"words[i + {j}] = {quoted(w)}" for j, w in enumerate(p.split())) + ")"
    places = " || ".join(f"list_transform({start(p)}, lambda i: {{'at': i - 1, 'label': {quoted(x)}}})" for p, x in PHRASES)
    quoted_sets = ((t, listed(t.words)) for t in _prepared(TEMPLATES, CONTAINMENT))
    templates = ", ".join(f"{{'label': {quoted(t.label)}, 'tw': {x}, 'span': {t.span}, 'need': {t.need}}}" for t, x in quoted_sets)
    inside = "list_filter(th, lambda p: p >= s AND p < s + span)"
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, {low} AS low, regexp_extract_all({low}, '{WORD}') AS words FROM documents),
p AS (SELECT rid, {places} AS places FROM d),
t AS (SELECT unnest([{templates}], recursive := true)),
c AS (SELECT rid, words, t.* FROM d, t WHERE len(list_intersect(tw, words)) >= need),
h AS (SELECT *, list_filter(range(1, len(words) + 1), lambda i: list_contains(tw, words[i])) AS th FROM c),
m AS (
  SELECT rid, label, need, list_max(list_transform(th, lambda s: len(list_distinct(list_transform({inside}, lambda p: words[p]))))) AS shared, len(tw) AS size
  FROM h),
f AS (SELECT rid, list(label) AS labels, max(shared / size) AS share FROM m WHERE shared >= need GROUP BY rid)
SELECT d.doc_id, len(words)::BIGINT AS n_words, len(places)::BIGINT AS n_base,
       list_min(list_transform(places, lambda x: x.at))::BIGINT AS first_word,
       list_max(list_transform(places, lambda x: x.at))::BIGINT AS last_word,
       coalesce(array_to_string(list_sort(list_distinct(list_transform(places, lambda x: x.label))), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_transform(places, lambda x: x.label) || coalesce(f.labels, []))), ','), '') AS labels,
       greatest(coalesce(f.share, 0.0), CASE WHEN len(places) > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS score
FROM d JOIN p USING (rid) LEFT JOIN f USING (rid)"""
