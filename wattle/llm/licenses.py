"""Licence scans: sparse TF-IDF cosine to templates, then nearest-ancestor inheritance.

*Scan.* The units of a file are its lines and, for a licence file (by its name), also its whole
text. A unit and a template are vectors of count times ``ln((1 + units) / (1 + units with
the word)) + 1``; counts of units are taken over the whole corpus for the templates' words, and a
word outside the templates weighs as if no unit had it. A file's own licence is that of
its best unit with a cosine of at least ``THRESHOLD``.

Only units that can reach the threshold are scored: by Cauchy-Schwarz, a unit whose common
words carry less than ``THRESHOLD ** 2`` of a template's squared norm cannot, so per template
the lightest words below that share are set aside and a unit must have one of the others.
Units are scored once for each different text, however often it occurs.

*Inheritance.* A directory declares the licence that most of its declaring files have. A file
without a licence of its own takes the one declared by the nearest directory above it:
ancestors are listed for the different directories only, joined to the declaring ones, and
the deepest wins; files then look up their directory.

Everything is column expressions and joins. Defined cases: null or wordless texts have no own
licence; a null path has no directory and inherits nothing; equal rows get equal answers; ties
go to the higher cosine, the earlier unit, the licence first by name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, small, stored

THRESHOLD = 0.6
LICENCE_FILE = r"(?i)(^|/)(un)?(licen[cs]e|copying|notice)[^/]*$"

# Licence notices as commonly published.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def template_words(text: str) -> dict[str, int]:
    out: dict[str, int] = {}
    word = ""
    for c in text.lower() + " ":
        if c.isalnum():
            word += c
        elif word:
            out[word] = out.get(word, 0) + 1
            word = ""
    return out


def units(files: DataFrame) -> DataFrame:
    """``path, x, pos, unit``: lines, and the whole text (pos -1) of licence files. ``x`` tells
    files of one path apart by their text."""
    f = files.select("path", F.xxhash64("text").alias("x"), "text", "licence_file")
    every = F.concat(
        F.when(F.col("licence_file"), F.array(F.struct(F.lit(-1).alias("pos"), F.col("text").alias("unit")))).otherwise(
            F.expr("cast(array() as array<struct<pos:int,unit:string>>)")),
        F.transform(F.split("text", "\n"), lambda line, i: F.struct(i.alias("pos"), line.alias("unit"))))
    return f.select("path", "x", F.explode(every).alias("u")).select("path", "x", "u.pos", "u.unit")


def weights(files: DataFrame, templates) -> tuple[dict[str, float], float]:
    """Inverse unit frequency of the templates' words, and that of a word in no unit."""
    vocabulary = sorted({w for _, t in templates for w in template_words(t)})
    w = units(files).select(words(F.col("unit")).alias("w")).where(F.size("w") > 0)
    # one empty word for each unit counts the units themselves
    has = F.concat(F.array(F.lit("")), F.array_intersect("w", F.array(*map(F.lit, vocabulary))))
    n = {r["w"]: r["n"] for r in w.select(F.explode(has).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    total = n.get("", 0)
    return {v: math.log((1 + total) / (1 + n.get(v, 0))) + 1 for v in vocabulary}, math.log(1 + total) + 1


def deciding_words(templates, idf: dict[str, float], threshold: float) -> list[str]:
    """Words one of which a unit must have to reach the threshold with some template."""
    out: set[str] = set()
    for _, text in templates:
        square = {w: (n * idf[w]) ** 2 for w, n in template_words(text).items()}
        left = threshold ** 2 * sum(square.values()) * (1 - 1e-9)
        for w in sorted(square, key=lambda w: (square[w], w)):
            left -= square[w]
            if left <= 0:
                out.add(w)
    return sorted(out)


def unit_licences(texts: DataFrame, templates, idf, unknown: float, threshold: float) -> DataFrame:
    """``unit, licence, score`` of the different texts that reach the threshold."""
    spark = texts.sparkSession
    vectors = {i: {w: n * idf[w] for w, n in template_words(t).items()} for i, (_, t) in enumerate(templates)}
    norm = {i: math.sqrt(sum(x * x for x in v.values())) for i, v in vectors.items()}
    table = spark.createDataFrame(
        [(w, idf[w], [(i, v[w] / norm[i]) for i, v in vectors.items() if w in v]) for w in idf],
        "w string, idf double, t array<struct<i:int,x:double>>")
    names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(templates)], "i int, licence string")
    w = texts.select("unit", F.explode(words(F.col("unit"))).alias("w")).groupBy("unit", "w").agg(F.count("*").alias("n"))
    w = w.join(F.broadcast(table), "w", "left").withColumn("x", F.col("n") * F.coalesce("idf", F.lit(unknown)))
    length = w.groupBy("unit").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("length"))
    dots = w.select("unit", F.col("x").alias("own"), F.explode("t").alias("t")).groupBy("unit", "t.i").agg(
        F.sum(F.col("own") * F.col("t.x")).alias("dot"))
    scored = dots.join(length, "unit").join(F.broadcast(names), "i")
    scored = scored.select("unit", "licence", (F.col("dot") / F.col("length")).alias("score"))
    best = scored.where(F.col("score") >= threshold).groupBy("unit").agg(
        F.max("score").alias("score"), F.collect_set(F.struct("score", "licence")).alias("all"))
    # equal scores: the licence first by name
    tied = F.array_min(F.transform(F.filter("all", lambda s: s["score"] == F.col("score")), lambda s: s["licence"]))
    return best.select("unit", tied.alias("licence"), "score")


def parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: p != "")


def inherited(dirs: DataFrame, declared: DataFrame) -> DataFrame:
    """``dir, licence, from_dir`` of the nearest declaring directory at or above each ``dir``."""
    d = dirs.withColumn("p", parts(F.col("dir")))
    up = d.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size("p")), lambda i: F.struct(
        i.alias("depth"), F.array_join(F.slice("p", F.lit(1), i), "/").alias("from_dir")))).alias("a"))
    up = up.select("dir", "a.depth", "a.from_dir")
    at = declared.select(F.col("dir").alias("from_dir"), "licence")
    return up.join(small(at), "from_dir").groupBy("dir").agg(F.max(F.struct("depth", "from_dir", "licence")).alias("m")).select(
        "dir", "m.licence", "m.from_dir")


def scan(files: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD,
         licence_file: Column | None = None, declares: Column | None = None) -> DataFrame:
    """``path, x, licence, how, score, from_dir`` of every file.

    ``files``: ``path, text`` and what the two conditions use. ``licence_file`` (default: by
    the name): the whole text is also a unit. ``declares`` (default: licence files): the file's
    own licence speaks for its directory. ``how`` is own, inherited or null.
    """
    named = F.coalesce(F.col("path").rlike(LICENCE_FILE), F.lit(False))
    licence_file = named if licence_file is None else licence_file
    f = columns(files, "path", "text").select(F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    f = f.withColumn("licence_file", licence_file).withColumn("declares", licence_file if declares is None else declares)
    p = parts(F.col("path"))
    f = f.withColumn("dir", F.array_join(F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))), "/"))
    idf, unknown = weights(f, templates)
    deciding = deciding_words(templates, idf, threshold)
    some = units(f).where(F.arrays_overlap(words(F.col("unit")), F.array(*map(F.lit, deciding))))
    some = stored(some, "licence-units")
    found = stored(unit_licences(some.select("unit").distinct(), templates, idf, unknown, threshold), "unit-licences")
    own = some.join(small(found), "unit").groupBy("path", "x").agg(
        F.max(F.struct("score", (-F.col("pos")).alias("neg"), "licence")).alias("m"))
    own = stored(own.select("path", "x", F.col("m.licence").alias("own"), F.col("m.score").alias("score")), "own-licences")

    f = f.select("path", F.xxhash64("text").alias("x"), "dir", "declares")
    o = small(own)
    f = f.join(o, f["path"].eqNullSafe(o["path"]) & (f["x"] == o["x"]), "left").select(f["path"], f["x"], "dir", "declares", "own", "score")
    votes = f.where("declares AND own IS NOT NULL AND dir IS NOT NULL").groupBy("dir", "own").agg(F.count("*").alias("n"))
    declared = votes.groupBy("dir").agg(F.max("n").alias("n")).join(votes, ["dir", "n"]).groupBy("dir").agg(F.min("own").alias("licence"))
    above = stored(inherited(f.select("dir").where("dir IS NOT NULL").distinct(), stored(declared, "declared")), "inherited")
    out = f.join(small(above), "dir", "left")
    return out.select(
        "path", "x", F.coalesce("own", "licence").alias("licence"),
        F.when(F.col("own").isNotNull(), "own").when(F.col("licence").isNotNull(), "inherited").alias("how"),
        "score", F.when(F.col("own").isNull(), F.col("from_dir")).alias("from_dir"))
