"""Licence notices by sparse TF-IDF cosine, and inheritance from the nearest directory with a licence file."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm.common import both_sides
from packetloom.operators.durable import checkpointed

# The sentences by which the licences are usually declared.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL", "This library is free software under the GNU Lesser General Public License, version 3."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def terms(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def anchors(weights: dict[str, float], threshold: float) -> set[str]:
    """Terms of which a text must hold one to reach ``threshold``: those left when the lightest ones, whose norm
    alone is below it, are taken away (their product with any unit vector is below it too)."""
    whole, light = sum(w * w for w in weights.values()), 0.0
    left = set(weights)
    for t, w in sorted(weights.items(), key=lambda x: (x[1], x[0])):
        light += w * w
        if light >= threshold * threshold * whole * (1 - 1e-9):
            break
        left.discard(t)
    return left


def _template_table(spark: SparkSession, templates, idf: dict[str, float]) -> DataFrame:
    """(term, idf, t0, t1 ..): the templates' normed weights; a row for each of their terms."""
    vectors = []
    for _, text in templates:
        own = terms(text)
        raw = {t: own.count(t) * idf[t] for t in own}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        vectors.append({t: w / norm for t, w in raw.items()})
    rows = [(t, idf[t], *[v.get(t, 0.0) for v in vectors]) for t in sorted(idf)]
    return spark.createDataFrame(rows, ", ".join(["term string", "idf double", *[f"t{k} double" for k in range(len(templates))]]))


def scan(docs: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, threshold: float = 0.6, share: float = 0.5) -> DataFrame:
    """(doc_id, path, licence, score, how) of every row of ``docs``.

    Every line of every whole text is compared with the ``templates``: TF-IDF vectors over words of a-z and 0-9, with
    ``ln((1 + documents) / (1 + documents with the term)) + 1`` counted over all rows for every term. The best line at or above ``threshold`` gives the licence, ``how = 'header'`` (ties:
    the template listed first). If such lines hold at least ``share`` of a text's words it is a licence file
    (``how = 'file'``) and its licence holds for its directory (ties: highest score, then licence name). Rows without
    a licence take that of the nearest directory above their path that has one (``how = 'inherited'``, its score);
    the rest have nulls, as have null texts. A null path inherits nothing. Rows that repeat an id and text count as often
    as they come. Lines are looked at only if they hold an anchor (see :func:`anchors`), which loses none.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), path.alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    vocabulary = sorted({t for _, text in templates for t in terms(text)})
    held = F.array_distinct(words(F.col("text")))
    counted = checkpointed(rows.select(F.explode(F.array_append(held, F.lit(" "))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("documents")))
    # a row for each term of the templates, and one for all
    counts = {r["term"]: r["documents"] for r in counted.where(F.col("term").isin(*vocabulary, " ")).collect()}
    total = counts.pop(" ", 0)
    idf = {t: math.log((1 + total) / (1 + counts.get(t, 0))) + 1 for t in vocabulary}
    needed = set().union(*[anchors({t: terms(text).count(t) * idf[t] for t in terms(text)}, threshold) for _, text in templates])
    pattern = "(?i)(?<![a-z0-9])(?:" + "|".join(sorted(needed)) + ")(?![a-z0-9])"

    marked = rows.where(F.col("text").rlike(pattern)).select("doc_id", "path", F.xxhash64("text").alias("row"), F.size(words(F.col("text"))).alias("size"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = marked.where(F.col("line").rlike(pattern)).withColumn("lid", F.xxhash64("line"))
    # equal lines are scored once
    distinct = lines.groupBy("lid").agg(F.first("line").alias("line"))
    table = _template_table(spark, templates, idf)
    spread = distinct.select("lid", F.explode(words(F.col("line"))).alias("term")).groupBy("lid", "term").agg(F.count(F.lit(1)).alias("tf"))
    weighed = spread.join(counted, "term").join(F.broadcast(table), "term", "left")  # a row for each term of the templates
    weight = F.col("tf") * F.coalesce("idf", F.log((1 + F.lit(total)) / (1 + F.col("documents"))) + 1)
    names = [f"t{k}" for k in range(len(templates))]
    sums = weighed.groupBy("lid").agg(F.sqrt(F.sum(weight * weight)).alias("norm"), F.sum("tf").alias("n"), *[F.sum(weight * F.coalesce(t, F.lit(0.0))).alias(t) for t in names])
    cosines = [F.round(F.col(t) / F.col("norm"), 6) for t in names]
    best = F.greatest(*cosines)
    which = F.coalesce(*[F.when(c == best, F.lit(k)) for k, c in enumerate(cosines)])
    scored = sums.select("lid", "n", best.alias("score"), which.alias("k")).where(F.col("score") >= threshold)
    hits = lines.join(both_sides(scored), "lid").groupBy("doc_id", "path", "row", "size").agg(
        F.max(F.struct("score", (-F.col("k")).alias("k"))).alias("b"), F.sum("n").alias("n"), F.countDistinct("pos").alias("lines"), F.count(F.lit(1)).alias("all")
    )
    licence = F.element_at(F.array(*[F.lit(name) for name, _ in templates]), (1 - F.col("b.k")).cast("int"))
    # rows that repeat an id and a text have each line as often as they come
    filled = F.col("n") * F.col("lines") / F.col("all") >= share * F.col("size")
    own = checkpointed(hits.select("doc_id", "path", "row", licence.alias("licence"), F.col("b.score").alias("score"), F.when(filled, "file").otherwise("header").alias("how")))

    folder = F.regexp_replace("path", "/?[^/]*$", "")
    files = own.where("how = 'file' AND path IS NOT NULL").select(folder.alias("dir"), "licence", "score").groupBy("dir")
    files = files.agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("licence").alias("l"))).alias("f"))
    folders = rows.where("path IS NOT NULL").select(folder.alias("dir")).distinct()
    parts = F.split("dir", "/")
    above = folders.select("dir", F.posexplode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("depth", "up"))
    near = above.join(files.select(F.col("dir").alias("up"), "f"), "up").groupBy("dir").agg(F.max(F.struct("depth", "f")).alias("m"))
    near = near.select("dir", F.col("m.f.l").alias("from_dir"), (-F.col("m.f.s")).alias("dir_score"))
    slim = rows.select("doc_id", "path", F.xxhash64("text").alias("row"), folder.alias("at"))
    mine = own.select(F.col("doc_id").alias("o_id"), F.col("path").alias("o_path"), F.col("row").alias("o_row"), "licence", "score", "how")
    same = F.col("doc_id").eqNullSafe(F.col("o_id")) & F.col("path").eqNullSafe(F.col("o_path")) & (F.col("row") == F.col("o_row"))
    out = slim.join(mine, same, "left").join(both_sides(near), F.col("at") == F.col("dir"), "left")
    how = F.coalesce("how", F.when(F.col("from_dir").isNotNull(), "inherited"))
    return out.select("doc_id", "path", F.coalesce("licence", "from_dir").alias("licence"), F.coalesce("score", "dir_score").alias("score"), how.alias("how"))
