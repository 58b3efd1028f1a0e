"""Licence notices in documents.

Method: overlapping windows of each text get MinHash signatures; windows that agree with a template in a band retrieve it;
exact containment of the template's shingles verifies the match.

Windows hold 2m words for a template of m words, so a notice may have grown by half and more, and may begin at every word: of all
windows, those are cut that begin at a shingle of a template of m words and reach as many such shingles as a match needs (the
best window of a text can always be moved on to its first such shingle). A band is one MinHash. From the least Jaccard similarity that a
match of a template can have follows the number of bands by which the chance to miss it stays below MISS. Two sets agree in a band
only at the hash of a shingle that both hold, so windows that are not cut could not agree. Only DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldscope.llm import shingles
from fieldscope.session import pin

CONTAINMENT = 0.8
MISS = 1e-9  # chance that a window with a match agrees with its template in no band

#: Notices by which licences are applied, and the opening conditions of short licences.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
)


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """(license, template) as a table; its size is the caller's list."""
    return spark.createDataFrame(list(templates), "license string, template string")


def _needed(containment: float) -> Column:
    """How many of a template's different shingles (``texts``) a match holds."""
    return F.greatest(F.lit(1), F.ceil(F.size("texts") * F.lit(containment) - F.lit(1e-6)).cast("int"))


def _n_bands() -> Column:
    """The bands by which a match is missed with a chance below MISS, from the least similarity it can have: a window of 2m words
    full of other shingles besides the ``needed`` ones."""
    similarity = F.col("needed") / (2 * F.col("width") - (shingles.WORDS - 1) + F.size("texts") - F.col("needed"))
    return F.ceil(F.log(F.lit(MISS)) / F.log1p(-similarity)).cast("int")


def _bands(frame: DataFrame) -> DataFrame:
    """A row per band: the least of the hashes of ``texts`` under the hash function of the band."""

    def signature(hashes):
        return F.transform(F.sequence(F.lit(0), F.col("bands") - 1), lambda band: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, band))))

    signed = frame.withColumn("_signature", shingles.once(F.transform("texts", lambda t: F.xxhash64(t)), signature))
    return signed.select("*", F.posexplode("_signature").alias("band", "least")).drop("_signature", "texts", "bands")


def _starts() -> Column:
    """The starts of the windows of 2m words that begin at a place with a shingle and reach ``needed`` places."""
    last = F.greatest(F.col("n_words") - 2 * F.col("width"), F.lit(0))
    reach = 2 * F.col("width") - shingles.WORDS

    def cut(places):
        def begins(place, i):
            start = F.least(place, last)
            end = F.get(places, i + F.col("needed") - 1)  # of a window at the end of the text, places before this one count as well
            return F.coalesce((end <= start + reach) | (place > last), F.lit(False))

        return F.array_distinct(F.transform(F.filter(places, begins), lambda place: F.least(place, last)))

    return shingles.once(F.array_sort("places"), cut)


def license_matches(docs: DataFrame, templates: DataFrame | None = None, containment: float = CONTAINMENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row_key, doc_id, license, start, containment): a row per row of ``docs`` and licence found in it.

    A licence is found where any window of twice a template's words (the whole text if it has fewer) holds at least
    ``containment`` of the template's different five-word shingles. containment is the largest share of all windows and templates,
    start the word where the first shingle of the template stands in the first such window. Words are runs of letters and digits in lower case.
    Null or short texts match nothing, nor do templates of fewer than five words or without a licence
    name. Repeated rows are reported once; empty tables give an empty result; other columns are not read.
    """
    rows = shingles.rows_of(docs, doc_id, text)
    templates = template_table(docs.sparkSession) if templates is None else templates
    known = templates.select(F.col("license").cast("string").alias("license"), shingles.words_of("template").alias("words"))
    known = known.where(F.col("license").isNotNull() & (F.size("words") >= shingles.WORDS)).distinct()
    known = known.select("license", F.xxhash64("words").alias("template"), F.size("words").alias("width"), F.array_distinct(shingles.texts_in(F.col("words"))).alias("texts"), "words")
    known = known.withColumn("needed", _needed(containment)).withColumn("bands", _n_bands())
    widths = known.groupBy("width").agg(F.min("needed").alias("needed"), F.max("bands").alias("bands"))

    # the places in a text where a shingle of a template of each width stands, and the windows that begin there
    wanted = known.select("width", "words", F.explode(shingles.places()).alias("offset"))
    wanted = wanted.select("width", shingles.hash_at(F.col("offset")).alias("shingle")).distinct().join(widths, "width")
    found = shingles.hits(rows, shingles.sendable(wanted, "licence-shingles"))
    held = found.groupBy("row_key", "width", "needed", "bands", "n_words").agg(F.collect_set("place").alias("places"))
    windows = held.select("row_key", "width", "bands", F.explode(_starts()).alias("start"))
    cut = shingles.windows_of(rows, windows, F.col("start"), F.col("width") * 2)
    cut = pin(cut.select("row_key", "doc_id", "width", "bands", "start", "texts").distinct(), "licence-window-texts")
    signed = _bands(cut.select("row_key", "width", "bands", "start", F.array_distinct("texts").alias("texts")))
    index = _bands(known.select("license", "template", "width", "bands", "texts"))
    asked = signed.where("least is not null").join(index, ["width", "band", "least"]).select("row_key", "width", "start", "license", "template").distinct()

    named = known.select("license", "template", F.col("texts").alias("asked"))
    held = asked.join(cut, ["row_key", "width", "start"]).join(named, ["license", "template"])
    share = F.size(F.array_intersect("asked", "texts")) / F.size("asked")
    first = F.col("start") + F.array_position(F.transform("texts", lambda t: F.array_contains("asked", t)), True).cast("int") - 1
    scored = held.withColumn("containment", share).where(F.col("containment") >= containment).withColumn("first", first)
    best = scored.groupBy("row_key", "doc_id", "license").agg(F.max(F.struct("containment", (-F.col("first")).alias("back"))).alias("best"))
    return best.select("row_key", "doc_id", "license", (-F.col("best.back")).cast("long").alias("start"), F.col("best.containment").alias("containment"))
