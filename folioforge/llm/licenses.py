"""Operator 1: license scans. DataFrame functions only.

Texts are cut into overlapping windows of words, windows and templates get MinHash bands, equal bands retrieve
templates, and the template's shingles are then counted exactly in the text around the window.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioforge.llm.common import lower_ascii, table, written

#: Public notices, by SPDX identifier where there is one.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-long": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0.",
    "all-rights-reserved": "All rights reserved.",
}
#: Words in a shingle: templates are single sentences, most of which have none or one of the five words used elsewhere.
SHINGLE = 3
#: Shingles in a window and the step between windows: three shingles are five words. One row per band.
SPAN, STEP, BANDS = 3, 3, 16
#: Share of a template's shingles that must stand together; rows that may be broadcast (under 32 bytes each).
CONTAINED, BROADCAST_ROWS = 0.8, 1_000_000


def collision_probability(shared: int, either: int, bands: int = BANDS) -> float:
    """That a window and a template window of this Jaccard similarity meet in a band."""
    return 1 - (1 - shared / either) ** bands


def _word_hashes(df: DataFrame, text: str) -> DataFrame:
    """df with wh, the hashes of the lower-case words without ASCII punctuation; none for null or blank text."""
    cut = df.withColumn("_cut", F.split(lower_ascii(F.coalesce(F.col(text), F.lit(""))), r'[\x09-\x0D\x20.,;:!?()\[\]"]+'))
    # a text that begins or ends with white space has an empty first or last word
    some = F.slice("_cut", F.when(F.element_at("_cut", 1) == "", 2).otherwise(1), F.greatest(F.size("_cut") - F.when(F.element_at("_cut", 1) == "", 1).otherwise(0) - F.when((F.element_at("_cut", -1) == "") & (F.size("_cut") > 1), 1).otherwise(0), F.lit(0)))
    return cut.withColumn("_some", some).withColumn("wh", F.transform("_some", lambda w: F.xxhash64(w))).drop("_cut", "_some")


def _windows(hashed: DataFrame, *keep: str, step: int) -> DataFrame:
    """A row for each window, with the hashes h0, h1, h2 of its word triples; the later ones are null where the text ends."""
    cut = F.transform(F.sequence(F.lit(0), F.size("wh") - SHINGLE, F.lit(step)), lambda k: F.struct(k.alias("at"), F.slice("wh", k + 1, SPAN + SHINGLE - 1).alias("w")))
    # no filter on the size: it would be moved below the hashing and hash every word twice
    rows = hashed.select(*keep, F.explode(F.when(F.size("wh") >= SHINGLE, cut)).alias("c"))
    get = [F.get(F.col("c.w"), F.lit(k)) for k in range(SPAN + SHINGLE - 1)]
    h = [F.when(get[k + 2].isNotNull(), F.xxhash64(*get[k : k + SHINGLE])).alias(f"h{k}") for k in range(SPAN)]
    # exploding one struct keeps the optimiser from putting these hashes into every band
    return rows.select(*keep, "c.at", F.inline(F.array(F.struct(*h))))


def _bands() -> list[Column]:
    """Per band the least hash of the window's one to three shingles."""
    return [F.least(F.xxhash64("h0", F.lit(j)), *[F.when(F.col(h).isNotNull(), F.xxhash64(h, F.lit(j))) for h in ("h1", "h2")]) for j in range(BANDS)]


def _triples(words: Column, start: Column, size: Column) -> Column:
    """Hashes of the word triples from start on, `size` of them."""
    return F.transform(F.sequence(start, start + size - 1), lambda k: F.xxhash64(F.get(words, k), F.get(words, k + 1), F.get(words, k + 2)))


def scan(df: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, license_id, containment, first_word): each license that each document holds.

    A template is held where a stretch of the text, as long as the template and a fifth more on either side of a
    retrieved window, holds 0.8 of its distinct shingles, and no other template more at that place; containment is the
    best share, first_word the least retrieved place. Templates of under three words cannot be found. Null, blank and short texts hold nothing; rows of one id
    count together; a null id is kept as null. The templates are a parameter of a few thousand sentences at most: their
    bands are constants of the plan.
    """
    spark = df.sparkSession
    notices = spark.createDataFrame(list(templates.items()) or [("", "")], "license_id string, notice string")
    notices = _word_hashes(notices, "notice").where(F.size("wh") >= SHINGLE)
    known = notices.select("license_id", (F.size("wh") - (SHINGLE - 1)).alias("n"), F.array_distinct(_triples(F.col("wh"), F.lit(0), F.size("wh") - (SHINGLE - 1))).alias("t_shingles"))
    bands = _windows(notices, "license_id", step=1).select("license_id", F.posexplode(F.array(*_bands())).alias("band", "value")).distinct()
    by_band: dict[int, list[int]] = {}
    for r in bands.select("band", "value").distinct().collect():  # bounded by the templates
        by_band.setdefault(r["band"], []).append(r["value"])
    docs = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    if not by_band:
        return docs.limit(0).select("doc_id", F.lit("").alias("license_id"), F.lit(0.0).alias("containment"), F.lit(0).alias("first_word"))
    each = _windows(_word_hashes(docs.select("doc_id", F.xxhash64("text").alias("th"), "text"), "text").select("doc_id", "th", "wh"), "doc_id", "th", step=STEP)
    own = _bands()
    met = own[0].isin(by_band[0])
    for j in range(1, BANDS):
        met = met | own[j].isin(by_band[j])
    some = each.where(met).select("doc_id", "th", "at", F.posexplode(F.array(*own)).alias("band", "value"))
    hits = written(some.join(F.broadcast(bands), ["band", "value"]).select("doc_id", "th", "at", "license_id").distinct(), "license-hits")
    places = written(hits.groupBy("doc_id", "th").agg(F.collect_set(F.struct("license_id", "at")).alias("places")).withColumnsRenamed({"doc_id": "hit_id", "th": "hit_th"}), "license-places")
    right = F.broadcast(places) if hits.count() <= BROADCAST_ROWS else places
    found = docs.withColumn("th", F.xxhash64("text")).join(right, (F.col("th") == F.col("hit_th")) & F.col("doc_id").eqNullSafe(F.col("hit_id")))
    found = _word_hashes(found, "text").select("doc_id", "th", "wh", "places")
    # the places are cut out of the text before they are exploded, so that no row carries the whole text
    reach = {r["license_id"]: math.ceil(r["n"] * 1.2) for r in known.select("license_id", "n").collect()}
    longest = F.create_map(*[F.lit(x) for kv in reach.items() for x in kv])

    def around(p: Column) -> Column:
        start = F.greatest(p["at"] - longest[p["license_id"]], F.lit(0))
        size = F.least(p["at"] + SPAN + longest[p["license_id"]], F.size("wh") - (SHINGLE - 1)) - start
        return F.struct(p["license_id"].alias("license_id"), p["at"].alias("at"), _triples(F.col("wh"), start, size).alias("near"))

    spots = found.select("doc_id", "th", F.explode(F.transform("places", around)).alias("p")).select("doc_id", "th", "p.*")
    share = F.size(F.array_intersect("t_shingles", "near")) / F.size("t_shingles")
    checked = spots.join(F.broadcast(known.select("license_id", "t_shingles")), "license_id").withColumn("containment", share).where(F.col("containment") >= CONTAINED)
    # notices that differ in a word retrieve each other's places: the best match of a place counts
    best = checked.withColumn("best", F.max("containment").over(W.partitionBy("doc_id", "th", "at"))).where("containment = best")
    return best.groupBy("doc_id", "license_id").agg(F.max("containment").alias("containment"), F.min("at").alias("first_word"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
