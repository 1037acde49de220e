"""Licence scans with DataFrame functions only.

Every line of every file, and every run of as many words as a template has, across line breaks too, is compared with licence
templates by the cosine of sparse TF-IDF vectors; document frequencies are counted over all files. A word counts once per line
or run with weight ln((1 + N) / (1 + df)); words that no template has weigh ln(1 + N), so running text around a phrase lowers
the score of a line, and the run that is the phrase alone finds it. Most lines and runs are ruled out by bounds
(Cauchy-Schwarz): without a strong word none can reach the threshold, where weak words are those that together leave every
template below it, and no run within a stretch of text can reach a template of which the stretch has too little.

Files whose licence lines, or template words in such runs, make up most of the text, or whose name says so, are licence files of their directory. A file without
a licence of its own inherits from the nearest directory above it that has one, by joins on paths.
"""
from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidepanel.llm.common import Stage

#: Names and the wording of their usual notices.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|unlicense)([.-].*)?$"
THRESHOLD = 0.7


def terms(text: Column) -> Column:
    """Distinct lower-case words of letters and digits."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), "[^a-z0-9]+")), "")


def _values(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A small table of fixed values as part of the plan."""
    word = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else f"{x!r}D" if isinstance(x, float) else str(x)
    return spark.sql(f"SELECT * FROM VALUES {', '.join('(' + ', '.join(map(word, r)) + ')' for r in rows)} AS t({columns})")


WORD = re.compile("[a-z0-9]+")


def _words(text: str) -> list[str]:
    return sorted({w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()})


class _Model:
    """Weights of the words of the templates over ``files``, and which of them are strong."""

    def __init__(self, files: DataFrame, templates, threshold: float):
        self.templates, self.threshold = templates, threshold
        self.words = [_words(t) for _, t in templates]
        self.vocabulary = sorted(set().union(*self.words))
        self.known = F.array(*[F.lit(w) for w in self.vocabulary])
        counted = Stage(files.select(F.explode(F.array_append(F.array_intersect(terms(F.col("text")), self.known), F.lit(""))).alias("term")).groupBy("term").count(), "df")
        df = {r["term"]: r["count"] for r in counted.df.collect()}  # at most one row per template word
        n = df.get("", 0)  # every file with text has the empty mark
        self.square = square = {w: math.log((1 + n) / (1 + df.get(w, 0))) ** 2 for w in self.vocabulary}
        self.other = math.log(1 + n) ** 2
        weak: list[str] = []
        for w in sorted(self.vocabulary, key=lambda w: (square[w], w)):
            more = {*weak, w}
            if any(sum(square[x] for x in t if x in more) >= threshold**2 * sum(square[x] for x in t) for t in self.words):
                break
            weak.append(w)
        self.strong = F.array(*[F.lit(w) for w in self.vocabulary if w not in weak])


def line_scores(files: DataFrame, model: _Model) -> DataFrame:
    """(path, row, line, n_chars, licence, score): lines whose best template reaches the threshold, ties to the first name."""
    spark, words, square = files.sparkSession, model.words, model.square
    lines = files.select("path", "row", F.posexplode(F.split("text", "\n")).alias("line", "said"))
    lines = lines.select("path", "row", "line", F.length("said").alias("n_chars"), terms(F.col("said")).alias("terms"))
    lines = lines.where(F.arrays_overlap("terms", model.strong))
    lines = lines.select("path", "row", "line", "n_chars", F.size("terms").alias("n"), F.explode(F.array_intersect("terms", model.known)).alias("term"))
    weights = _values(spark, [(w, square[w]) for w in model.vocabulary], "term, square")
    held = _values(spark, [(w, i) for i, t in enumerate(words) for w in t], "term, template")
    size = _values(spark, [(i, name, math.sqrt(sum(square[w] for w in t))) for i, ((name, _), t) in enumerate(zip(model.templates, words, strict=True))], "template, licence, norm")
    hits = Stage(lines.join(weights, "term"), "lines")
    line = ["path", "row", "line"]
    norms = hits.df.groupBy(*line).agg(F.sqrt(F.sum("square") + (F.max("n") - F.count(F.lit(1))) * F.lit(model.other)).alias("own"), F.max("n_chars").alias("n_chars"))
    dots = hits.df.join(held, "term").groupBy(*line, "template").agg(F.sum("square").alias("dot"))
    scored = dots.join(norms, line).join(size, "template").select(*line, "n_chars", "licence", (F.col("dot") / (F.col("own") * F.col("norm"))).alias("score"))
    scored = scored.where(F.col("score") >= model.threshold)
    best = scored.groupBy(*line).agg(F.max("n_chars").alias("n_chars"), F.min(F.struct((-F.round("score", 9)).alias("s"), "licence")).alias("b"))
    return best.select(*line, "n_chars", F.col("b.licence").alias("licence"), (-F.col("b.s")).alias("score"))


def run_scores(files: DataFrame, model: _Model) -> DataFrame:
    """(path, row, licence, score, said): for stretches of text and templates, the best run of the template's number of words if it reaches the threshold.

    said has (at, n_chars) of each template word in such runs. A run begins at any word; a text with fewer words is one run.
    A stretch holds all runs that begin in its first half.
    """
    long = [len(WORD.findall(t.lower())) for _, t in model.templates]
    half = max(long)
    weight = lambda w: F.coalesce(F.get(F.array(*[F.lit(model.square[x]) for x in model.vocabulary]), (F.array_position(model.known, w) - 1).cast("int")), F.lit(model.other))
    total = lambda words: F.aggregate(words, F.lit(0.0), lambda a, w: a + weight(w))
    kinds = F.array(*[F.struct(F.lit(name).alias("licence"), F.lit(n).alias("n"), F.lit(sum(model.square[w] for w in t)).alias("square"), F.array(*map(F.lit, t)).alias("terms"))
                      for (name, _), n, t in zip(model.templates, long, model.words, strict=True)])
    spoken = files.select("path", "row", F.array_remove(F.split(F.lower("text"), "[^a-z0-9]+"), "").alias("words")).where(F.arrays_overlap("words", model.strong))
    cut = F.transform(F.sequence(F.lit(0), ((F.size("words") - 1) / half).cast("int")), lambda k: F.slice("words", k * half + 1, F.lit(2 * half)))
    parts = spoken.select("path", "row", F.posexplode(cut).alias("k", "part")).where(F.arrays_overlap("part", model.strong))
    pairs = parts.select("path", "row", "k", "part", F.explode(kinds).alias("t"))
    least = F.col("t.square") * model.threshold**2 * (1 - 1e-9)
    pairs = pairs.where((F.col("t.square") > 0) & (total(F.array_intersect("part", "t.terms")) >= least))
    last = F.size("part") - F.col("t.n")
    starts = F.when(last >= 0, F.sequence(F.lit(0), F.least(last, F.lit(half - 1)))).when(F.col("k") == 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))

    def scored(i: Column) -> Column:
        run = F.array_distinct(F.slice("part", i + 1, F.col("t.n")))
        return F.struct(F.round(total(F.array_intersect(run, F.col("t.terms"))) / F.sqrt(total(run) * F.col("t.square")), 9).alias("score"), i.alias("i"))

    pairs = pairs.select("path", "row", "k", "part", "t", F.filter(F.transform(starts, scored), lambda r: r["score"] >= model.threshold).alias("runs")).where(F.size("runs") > 0)
    places = F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["i"], F.least(r["i"] + F.col("t.n"), F.size("part")) - 1))))
    places = F.filter(places, lambda p: F.array_contains(F.col("t.terms"), F.get("part", p)))
    said = F.transform(places, lambda p: F.struct((F.col("k").cast("long") * half + p).alias("at"), (F.length(F.get("part", p)) + 1).alias("n_chars")))
    return pairs.select("path", "row", F.col("t.licence").alias("licence"), F.array_max("runs")["score"].alias("score"), said.alias("said"))


def parent(path: Column) -> Column:
    """Directory of a path; '' for the top."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def ancestors(folder: Column) -> Column:
    """(folder, depth) of the directory itself and all above it."""
    steps = F.split(folder, "/")
    return F.transform(F.sequence(F.lit(0), F.size(steps)), lambda i: F.struct(F.array_join(F.slice(steps, 1, i), "/").alias("above"), i.alias("depth")))


def scan(files: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(path, licence, score, origin, inherited_from) of every distinct path of ``files`` (path, text).

    origin is ``own``, ``inherited`` or ``none``. Rows that share a path are one file with all their lines; null paths take no
    part; null or empty texts have no licence of their own. Between several licence files of one directory the highest
    score decides, then the licence's name.
    """
    files = files.select(F.col("path").cast("string").alias("path"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("path is not null")
    model, rows = _Model(files, templates, threshold), files.withColumn("row", F.monotonically_increasing_id())
    lines, runs = Stage(line_scores(rows, model), "licence-lines"), Stage(run_scores(rows, model), "licence-runs")
    best = lines.df.select("path", "licence", "score").unionByName(runs.df.select("path", "licence", "score"))
    best = best.groupBy("path").agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("b"))
    in_lines = lines.df.groupBy("path").agg(F.sum("n_chars").alias("in_lines"))
    in_runs = runs.df.select("path", "row", F.explode("said").alias("w")).distinct().groupBy("path").agg(F.sum("w.n_chars").alias("in_runs"))
    found = Stage(best.join(in_lines, "path", "left").join(in_runs, "path", "left")
                  .select("path", F.greatest("in_lines", "in_runs").alias("said"), F.col("b.licence").alias("licence"), (-F.col("b.s")).alias("score")), "own-licences")
    sizes = files.groupBy("path").agg(F.sum(F.length("text")).alias("n_chars"))
    own = Stage(sizes.join(found.df, "path", "left").select("path", parent(F.col("path")).alias("folder"), "licence", "score",
                (F.regexp_extract("path", "[^/]*$", 0).rlike(LICENCE_FILE) | (F.col("said") * 2 >= F.col("n_chars"))).alias("is_file")), "files")
    given = own.df.where("licence is not null and is_file").groupBy("folder").agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("g")).select(F.col("folder").alias("above"), "g")
    above = own.df.select("folder").distinct().select("folder", F.explode(ancestors(F.col("folder"))).alias("a")).select("folder", "a.above", "a.depth")
    nearest = above.join(given, "above").groupBy("folder").agg(F.max(F.struct("depth", "above", "g")).alias("m"))
    nearest = nearest.select("folder", F.col("m.above").alias("above"), F.col("m.g.licence").alias("given"), (-F.col("m.g.s")).alias("given_score"))
    joined = own.df.join(nearest, "folder", "left")
    has = F.col("licence").isNotNull()
    return joined.select("path", F.coalesce("licence", "given").alias("licence"), F.when(has, F.col("score")).otherwise(F.col("given_score")).alias("score"),
                         F.when(has, "own").when(F.col("given").isNotNull(), "inherited").otherwise("none").alias("origin"),
                         F.when(~has, F.col("above")).alias("inherited_from"))
