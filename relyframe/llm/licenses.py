"""Licences of files by sparse TF-IDF cosine to templates, and from the nearest directory above.

A file's lines that speak of a licence, alone and with one or two lines after
them, are compared with short templates; of a licence file (LICENSE, COPYING,
...) and of a directory's own page the finding holds for the directory. A file
without a finding takes that of its nearest ancestor directory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relyframe.llm.store import sized, stored

# Public header and title phrases of common licences.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "licensed under the GNU Affero General Public License, version 3"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0 Creative Commons Attribution"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0 Creative Commons Attribution ShareAlike"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC0-1.0", "CC0 1.0 public domain dedication"),
    ("ISC", "Licensed under the ISC License"),
    ("proprietary", "All rights reserved"),
    ("proprietary", "Copyright. All rights reserved. Unauthorized copying of this file is strictly prohibited. Proprietary and confidential"),
)
CUE = r"(?i)licen[sc]|copyright|spdx|all rights reserved|public domain|creative commons|permission is hereby granted|redistribution and use|\bCC0\b|neither the name of"
LICENCE_FILE = r"(?i)(^|/)(licen[sc]e|copying|copyright|notice|unlicense)[^/]*$"
LEAST_COSINE = 0.6
SPDX = r"SPDX-License-Identifier:[ \t]*\(?([A-Za-z0-9][A-Za-z0-9.+-]*)"
# A licence whose text holds all of another one's: where both are found in a file, the first one counts.
HOLDS = {"BSD-3-Clause": "BSD-2-Clause"}


def _terms(text):
    """Lower-case words, and numbers with their dots."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}0-9.]+|\.(?![0-9])|(?<![0-9])\."), lambda t: t != "")


def _weighted(terms: DataFrame, idf: DataFrame, key: list[str]) -> DataFrame:
    """key, term, weight: TF-IDF of length one for each key; a term nobody else has weighs most."""
    counted = terms.groupBy(*key, "term").agg(F.count("*").alias("tf"))
    raw = counted.join(idf, "term", "left").withColumn("weight", F.col("tf") * F.col("idf"))
    norm = raw.groupBy(*key).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return raw.join(norm, key).select(*key, "term", (F.col("weight") / F.col("norm")).alias("weight"))


def own_licences(files: DataFrame, templates=TEMPLATES) -> DataFrame:
    """Rows (file, licence, cosine, line): each file's best finding, at least LEAST_COSINE. files: (file, path, text)."""
    spark: SparkSession = files.sparkSession
    hit = files.filter(F.col("text").rlike(CUE)).select("file", F.posexplode(F.split("text", "\n")).alias("line", "body"), F.split("text", "\n").alias("all"))
    cue = hit.filter(F.col("body").rlike(CUE))
    parts = F.array(*[F.array_join(F.slice("all", F.col("line") + 1, n), " ") for n in (1, 2, 3)])
    segments = stored(cue.select("file", "line", F.posexplode(F.array_distinct(parts)).alias("part", "body")), "segments")
    terms = stored(segments.select("file", "line", "part", F.explode(_terms(F.col("body"))).alias("term")), "terms")
    model = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "template int, licence string, body string")
    own = model.select("template", F.explode(_terms(F.col("body"))).alias("term"))
    # Document frequency over the lines with a cue and the templates.
    total = segments.filter("part = 0").count() + len(templates)
    df = terms.filter("part = 0").select("file", "line", "term").distinct().groupBy("term").agg(F.count("*").alias("n"))
    df = df.union(own.distinct().groupBy("term").agg(F.count("*").alias("n"))).groupBy("term").agg(F.sum("n").alias("n"))
    idf = stored(df.select("term", (F.log((F.lit(total) + 1) / (F.col("n") + 1)) + 1).alias("idf")), "idf")
    known = _weighted(own, idf, ["template"]).withColumnRenamed("weight", "known")
    found = _weighted(terms, idf, ["file", "line", "part"])
    # The templates are a fixed, short list.
    dots = found.join(F.broadcast(known), "term").groupBy("file", "line", "part", "template").agg(F.sum(F.col("weight") * F.col("known")).alias("cosine"))
    named = dots.filter(F.col("cosine") >= LEAST_COSINE).join(F.broadcast(model.select("template", "licence")), "template")
    named = named.select("file", "licence", "cosine", "line", "part", "template")
    for wide, narrow in HOLDS.items():
        both = named.filter(F.col("licence") == wide).select("file").distinct()
        named = named.filter(F.col("licence") != narrow).unionByName(named.filter(F.col("licence") == narrow).join(both, "file", "left_anti"))
    # An identifier that a file states is its licence, whatever else it says.
    stated = cue.select("file", F.regexp_extract("body", SPDX, 1).alias("licence"), F.lit(2.0).alias("cosine"), "line", F.lit(0).alias("part"), F.lit(-1).alias("template"))
    named = named.unionByName(stated.filter("licence <> ''"))
    best = F.max_by(F.struct("licence", F.least("cosine", F.lit(1.0)).alias("cosine"), "line"), F.struct("cosine", -F.col("line"), -F.col("part"), -F.col("template")))
    return named.groupBy("file").agg(best.alias("b")).select("file", "b.licence", "b.cosine", "b.line")


def directory_of(path):
    return F.regexp_replace(path, r"/?[^/]*$", "")


def scan_licences(files: DataFrame, templates=TEMPLATES) -> DataFrame:
    """One row per row of files (file, path, text): file, licence, cosine, origin, depth.

    ``origin`` is ``own``, ``inherited`` or null. A directory's licence is the best
    finding among its licence files and its own page (a path that ends in a
    slash). Null texts have no finding of their own, null paths inherit none.
    Files are named by ``file``; equal names share findings. Ties go to the
    licence that comes first in alphabetical order.
    """
    mine = stored(own_licences(files, templates), "own")
    speaks = files.filter(F.col("path").rlike(LICENCE_FILE) | F.col("path").endswith("/")).select("file", directory_of(F.col("path")).alias("dir"))
    # Alphabetical order is turned around for max_by by taking the least name among the best.
    found = speaks.join(mine, "file").groupBy("dir", "licence").agg(F.max("cosine").alias("c"))
    top = found.groupBy("dir").agg(F.max("c").alias("c"))
    named = stored(found.join(top, ["dir", "c"]).groupBy("dir").agg(F.min("licence").alias("above"), F.first("c").alias("above_cosine")), "directories")
    dirs = files.filter("path IS NOT NULL").select(directory_of(F.col("path")).alias("dir")).distinct()
    parts = F.split("dir", "/")
    up = dirs.select(F.col("dir").alias("below"), F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth"), parts.alias("parts"))
    up = up.select("below", "depth", F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/").alias("dir"))
    nearest = up.join(sized(named), "dir").groupBy("below").agg(F.max_by(F.struct("above", "above_cosine", "depth"), "depth").alias("a"))
    nearest = stored(nearest.select(F.col("below").alias("dir"), "a.*"), "nearest")
    rows = files.select("file", directory_of(F.col("path")).alias("dir"))
    out = rows.join(sized(mine), "file", "left").join(sized(nearest), "dir", "left")
    return out.select(
        "file", F.coalesce("licence", "above").alias("licence"), F.coalesce("cosine", "above_cosine").alias("cosine"),
        F.when(F.col("licence").isNotNull(), "own").when(F.col("above").isNotNull(), "inherited").alias("origin"),
        F.when(F.col("licence").isNull(), F.col("depth")).alias("depth"),
    )
