"""License scans by diagonal voting.

Every run of ``GRAM`` words of every document is joined to the places where the templates hold the same
words.  A copy of a template puts its hits on one diagonal (place in the text less place in the
template); an inserted or lost word shifts it a little, so neighbouring diagonals are merged.  What is
merged is a span, and it is verified by the share of the template's words and of its own words that
the hits cover.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.text import ascii_lower, body, identity, unwrapped

# Phrases with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Public license notices, by the label that a copy of one gives.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("mit-terms", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("mit-notice", "Released under the MIT License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]

#: Templates of at most so many characters together are broadcast; more meet the texts in an exchange.
BROADCAST_CHARS = 1 << 20
#: Words in a run that is looked up.
GRAM = 4
#: Diagonals that lie this far apart at most belong to one copy.
SLACK = 3
#: Shares that a span's hits cover at least: of the template's words, of its own words.
OF_TEMPLATE, OF_SPAN = 0.7, 0.6


def license_words(text: Column) -> Column:
    """Runs of digits, letters and characters beyond ASCII, A-Z lower-cased."""
    return F.filter(F.split(ascii_lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", -1), lambda w: w != "")


def grams(words: Column, k: int) -> Column:
    """All runs of ``k`` words, joined by a space, in their order; ``words`` is a column."""
    every = F.sequence(F.lit(1), F.size(words) - k + 1)
    return F.when(F.size(words) >= k, F.transform(every, lambda i: F.array_join(F.slice(words, i, F.lit(k)), " ")))


def template_grams(spark: SparkSession, templates: list[tuple[str, str]], k: int = GRAM) -> DataFrame:
    """hash, gram, template, label, of (its words) and tpos: where each template holds a run of ``k`` words."""
    given = spark.createDataFrame([(i, *t) for i, t in enumerate(templates)], "template int, label string, text string")
    d = given.withColumn("w", license_words(F.col("text")))
    each = d.select("template", "label", F.size("w").alias("of"), F.posexplode(grams(F.col("w"), k)).alias("tpos", "gram"))
    places = each.withColumn("hash", F.xxhash64("gram"))
    return F.broadcast(places) if sum(len(text) for _, text in templates) <= BROADCAST_CHARS else places


def phrase_places(words: Column, phrases: dict[str, str]) -> Column:
    """struct(at, label) of all places where a phrase's words stand one after another; ``words`` is a column."""

    def places(phrase: str, label: str) -> Column:
        own = phrase.split(" ")

        def here(w, i):
            same = w == own[0]
            for n, x in enumerate(own[1:], 1):
                same = same & F.coalesce(F.get(words, i + n) == x, F.lit(False))
            return F.when(same, F.struct(i.alias("at"), F.lit(label).alias("label")))

        found = F.filter(F.transform(words, here), lambda x: x.isNotNull())
        return F.when(F.array_contains(words, own[-1]), found)

    return F.concat(*(F.coalesce(places(p, x), F.array().cast("array<struct<at:int,label:string>>")) for p, x in phrases.items()))


def license_spans(docs: DataFrame, templates: list[tuple[str, str]] | None = None, k: int = GRAM) -> DataFrame:
    """doc_id, ident and ``spans`` of the documents that hold a verified copy of a template.

    A span is struct(start, end, template, label, share): words from ``start`` to before ``end``, and the
    share of the template that its hits cover.  Runs of words are joined by hash and compared as text;
    the templates are a parameter, and broadcast up to ``BROADCAST_CHARS``.  Rows alike in doc_id and text
    count as one document.  A document's hits meet in one group, which is no longer
    than its text.
    """
    known = template_grams(docs.sparkSession, TEMPLATES if templates is None else templates, k)
    w = docs.select("doc_id", identity().alias("ident"), license_words(body()).alias("w"))
    runs = w.select("doc_id", "ident", F.posexplode(grams(F.col("w"), k)).alias("pos", "run")).withColumn("hash", F.xxhash64("run"))
    votes = runs.join(known, "hash").where("run = gram")
    document = ["doc_id", "ident", "template", "label", "of"]
    diagonals = votes.groupBy(*document, (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.collect_set("tpos").alias("hits"))

    along = Window.partitionBy("doc_id", "ident", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > SLACK, F.lit(True)).cast("int")
    copies = diagonals.withColumn("apart", apart).withColumn("copy", F.sum("apart").over(along))
    merged = copies.groupBy(*document, "copy").agg(F.collect_list(F.struct("diagonal", "hits")).alias("votes"))

    def covered(of) -> Column:
        starts = F.flatten(F.transform("votes", lambda v: F.transform(v["hits"], lambda t: of(v, t))))
        return F.array_distinct(F.flatten(F.transform(starts, lambda s: F.sequence(s, s + k - 1))))

    # The same words as places in the template and as places in the text.
    spans = merged.withColumns({"own": covered(lambda v, t: t), "found": covered(lambda v, t: t + v["diagonal"])})
    start, end, share = F.array_min("found"), F.array_max("found") + 1, F.size("own") / F.col("of")
    good = spans.where((share >= OF_TEMPLATE) & (F.size("found") >= OF_SPAN * (end - start)))
    span = F.struct(start.alias("start"), end.alias("end"), "template", "label", share.alias("share"))
    return good.groupBy("doc_id", "ident").agg(F.sort_array(F.collect_list(span)).alias("spans"))


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``keep``, all by default) with ``__licenses`` = struct(n_words, n_base, first_word,
    last_word, base_labels, labels, score, spans).

    Base labels are those of the phrases found, ``labels`` has the ones of verified spans too; ``score`` is 1
    with a phrase, else the largest share of a span, else 0.  A null or empty text has no words and no
    labels, nor has one shorter than a phrase.  Repeated rows have the same findings, one row each.  Texts
    are read whole; a task holds one text's words and runs of words at a time.  All columns stay, whatever their
    names, but for one named ``__licenses``, which gives way; an empty table gives no rows.
    """
    keep = docs.columns if keep is None else keep
    d = docs.select(F.struct(*keep).alias("row"), "doc_id", identity().alias("ident"), license_words(body()).alias("w"))
    places = d.withColumn("places", phrase_places(F.col("w"), PHRASES if phrases is None else phrases))
    base = places.select("row", "doc_id", "ident", F.size("w").cast("long").alias("n_words"), "places")
    spans = license_spans(docs, templates)
    joined = base.join(spans, (base["ident"] == spans["ident"]) & base["doc_id"].eqNullSafe(spans["doc_id"]), "left")

    at = F.transform("places", lambda p: p["at"].cast("long"))
    own, more = (F.coalesce(F.transform(c, lambda p: p["label"]), F.array().cast("array<string>")) for c in ("places", "spans"))
    told = lambda labels: F.array_join(F.sort_array(F.array_distinct(labels)), ",")
    score = F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0)))
    found = F.struct(
        "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        told(own).alias("base_labels"), told(F.concat(own, more)).alias("labels"), score.alias("score"), "spans",
    )
    return unwrapped(joined.select("row", found.alias("__licenses")), keep, "__licenses")
