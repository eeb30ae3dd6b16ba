"""License scans: an exact set-similarity join of text blocks with templates.

A template is a set of words. Text blocks are runs of words of at most twice the
template's length, wherever lines end. All runs lie in stretches of fixed length that
overlap; those are found first, as sets of words. Words are ordered by the number of
stretches that have them, over all documents, rarest first. A template of n words that must be contained to a share t needs ceil(t * n) words in common, so
a stretch that qualifies has one of the template's first n - ceil(t * n) + 1 words:
stretches meet templates by an equi-join on these prefixes. The length filter drops
stretches of too few words, the positional filter pairs whose rest is too short, and
what is left is verified run by run. Words outside of all templates count for no
overlap and are left out of the sets at once.

Built-in functions only. The prefix index has a row for each prefix word of the
given templates; it does not grow with the documents.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import size_checked, stage, text_or_empty
from .native import let, non_empty

#: Share of a template's words that a block must contain.
CONTAINMENT = 0.8
#: Words of a run, as a multiple of the template's.
RUN = 2
#: What separates words (of lowered text): ASCII other than digits and letters.
SEP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases whose places are reported, with their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
# Notices in common use, with their labels.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
              "General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("all-rights-reserved", "All rights reserved"),
)


def words_of(text: str) -> list[str]:
    """The words of a template (ASCII), in order."""
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def lowered(text):
    """Letters A-Z lowered. Other scripts' capitals are lowered too, which no ASCII
    word can tell apart; the one sign that would become ASCII is replaced before."""
    return F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u00e9")))


def _phrase_places(words, phrases):
    """Array of (start, label) of the places where a phrase's words are consecutive."""
    out = []
    for phrase, label in phrases:
        parts = phrase.split()

        def here(i):
            ok = F.get(words, i) == parts[0]
            for k, p in enumerate(parts[1:], 1):
                ok = ok & (F.get(words, i + k) == p)
            return F.coalesce(ok, F.lit(False))
        starts = F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)
        out.append(F.transform(starts, lambda i: F.struct(i.cast("long").alias("start"), F.lit(label).alias("label"))))
    return F.concat(*out)


def scan_blocks(docs: DataFrame, templates, phrases) -> DataFrame:
    """One pass over the texts: (rid, doc_id, n_words, base, blocks). ``blocks`` has
    the template words of each stretch that has any, the words' places in it, and
    its number. A stretch is as long as two of the longest runs and starts
    in the middle of the one before."""
    step = max([RUN * len(words_of(t)) for _, t in templates], default=1)
    vocabulary = sorted({w for _, t in templates for w in words_of(t)})
    some_phrase = "|".join(SEP.join(p.split()) for p, _ in phrases)
    lines = F.transform(F.split("low", "\n"), lambda line: non_empty(F.split(line, SEP)))
    nothing = F.array().cast("array<struct<start:bigint,label:string>>")
    base = F.when(F.col("low").rlike(some_phrase), let(F.flatten("lines"), lambda w: _phrase_places(w, phrases))) \
        .otherwise(nothing)

    def stretch(words, no):
        part = F.transform(F.slice(words, no * step + 1, 2 * step), lambda w, i: F.struct(i.alias("at"), w.alias("word")))
        return F.struct(no.alias("no"), F.filter(part, lambda x: x["word"].isin(vocabulary)).alias("places"))
    blocks = let(F.flatten("lines"), lambda words: F.filter(
        F.transform(F.sequence(F.lit(0), F.floor(F.size(words) / step).cast("int")), lambda no: stretch(words, no)),
        lambda b: F.size(b["places"]) > 0))
    low = docs.select("doc_id", lowered(text_or_empty()).alias("low"))
    cut = low.select("doc_id", "low", lines.alias("lines"))
    return cut.select(
        F.monotonically_increasing_id().alias("rid"), "doc_id",
        F.aggregate("lines", F.lit(0).cast("long"), lambda n, ws: n + F.size(ws)).alias("n_words"),
        base.alias("base"), blocks.alias("blocks"))


def word_order(scanned: DataFrame, vocabulary: list[str]) -> list[str]:
    """The template words, rarest first by the stretches that have them; at most the
    templates' vocabulary reaches the driver."""
    counts = {r["w"]: r["n"] for r in scanned.select(F.explode("blocks").alias("b"))
              .select(F.explode(F.array_distinct("b.places.word")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def matches(scanned: DataFrame, templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """(rid, block, template, label, containment): every stretch and template where a
    run in the stretch holds at least the share ``containment`` of the template's words."""
    spark = scanned.sparkSession
    order = word_order(scanned, sorted({w for _, t in templates for w in words_of(t)}))
    prefixes, sets = [], []
    for t, (label, text) in enumerate(templates):
        own = set(words_of(text))
        words = [w for w in order if w in own]
        need = math.ceil(containment * len(words) - 1e-9)
        sets.append((t, label, words, need, RUN * len(words_of(text))))
        prefixes += [(w, t, i, len(words), need) for i, w in enumerate(words[:len(words) - need + 1])]
    index = size_checked(spark.createDataFrame(prefixes, "word string, template int, i int, size int, need int"))
    known = size_checked(spark.createDataFrame(sets, "template int, label string, words array<string>, need int, run int"))
    fewest = min(need for *_, need, _ in sets)
    ordered = F.array_intersect(F.array(*[F.lit(w) for w in order]), "b.places.word")
    blocks = scanned.select("rid", F.explode("blocks").alias("b")).where(F.size("b.places") >= fewest) \
        .select("rid", F.col("b.no").alias("block"), F.col("b.places").alias("places"), ordered.alias("own"))
    probe = blocks.where(F.size("own") >= fewest).select("rid", "block", "places", "own", F.posexplode("own").alias("j", "word"))
    # length filter, then positional filter: the words after the shared one must do
    pairs = probe.join(index, "word").where((F.size("own") >= F.col("need")) & (
        F.least(F.col("size") - F.col("i"), F.size("own") - F.col("j")) >= F.col("need")))
    pairs = pairs.groupBy("rid", "block", "template").agg(F.first("places").alias("places"))
    own = F.filter("places", lambda x: F.array_contains("words", x["word"]))

    def words_from(places, x):
        run = F.filter(places, lambda y: (y["at"] >= x["at"]) & (y["at"] < x["at"] + F.col("run")))
        return F.size(F.array_distinct(F.transform(run, lambda y: y["word"])))
    common = let(own, lambda places: F.array_max(F.transform(places, lambda x: words_from(places, x))))
    verified = pairs.join(known, "template").withColumn("common", common).where("common >= need")
    return verified.select("rid", "block", "template", "label", (F.col("common") / F.size("words")).alias("containment"))


def scan_documents(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, containment: float = CONTAINMENT) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_words, n_base,
    first_word, last_word, base_labels, labels, score.

    Null and empty texts have no words, empty label strings, null places and score 0.
    Repeated rows and null ids are scanned one by one; an empty table gives no rows;
    whole texts are read, line ends part no notice; other columns are not read. ``score`` is the largest containment of a template, 0 if none meets it.
    """
    scanned = stage(scan_blocks(docs, templates, phrases), "blocks")
    hits = matches(scanned, templates, containment).groupBy("rid").agg(
        F.collect_set("label").alias("found"), F.max("containment").alias("score"))
    starts, own = F.transform("base", lambda b: b["start"]), F.transform("base", lambda b: b["label"])
    both = F.array_union(own, F.coalesce("found", F.array().cast("array<string>")))
    return scanned.drop("blocks").join(hits, "rid", "left").select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), F.array_join(F.sort_array(F.array_distinct(own)), ",").alias("base_labels"),
        F.array_join(F.sort_array(both), ",").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
