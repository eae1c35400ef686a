"""Licences of files: statements in the text against templates, then the nearest directory that has one.

Every line of a file is a possible header.  Lines and templates are sparse
TF-IDF vectors; document frequencies of the templates' terms are counted over
all files, and a term outside the templates weighs as one that a single file
has.  A line can only reach the threshold with one of a template's key terms
(without them even the rest of the template is too short a vector), so all
other lines are left out before any join, without a loss.

A file without a statement of its own takes the licence of the nearest
directory above it in which a licence file has one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .text import keyed, let, letter_words, plain_id, row_key

THRESHOLD = 0.6
LICENCE_FILE = r"(?i)^(licen[sc]e|copying|notice|unlicense)"

# Short public statements by SPDX name.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0 Universal, dedicated to the public domain."),
    ("ISC", "Released under the ISC License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
)


def terms(text: Column) -> Column:
    return F.transform(letter_words(text), lambda w: F.lower(w))


def _template_terms(text: str) -> list[str]:
    kept = "".join(c.lower() if c.isalnum() else " " for c in text)
    return kept.split()


def corpus_weights(files: DataFrame, templates=TEMPLATES) -> tuple[dict[str, float], float, int]:
    """Weight of each term of the templates, the weight of any other, and the number of files.

    What comes to the driver is one number for each term of the templates.
    """
    vocabulary = sorted({t for _, text in templates for t in _template_terms(text)})
    listed = F.array(*[F.lit(t) for t in vocabulary])
    seen = files.select(
        F.explode(F.concat(F.array(F.lit("")), F.array_intersect(terms(F.col("text")), listed))).alias("term")
    ).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["term"]: r["n"] for r in seen.collect()}
    total = counts.get("", 0)
    weigh = lambda n: math.log((1 + total) / (1 + n)) + 1.0
    return {t: weigh(counts.get(t, 0)) for t in vocabulary}, weigh(min(1, total)), total


def _template_vectors(weights: dict[str, float], templates) -> list[tuple[str, dict[str, float]]]:
    """Unit vectors."""
    out = []
    for name, text in templates:
        words = _template_terms(text)
        raw = {t: words.count(t) * weights[t] for t in dict.fromkeys(words)}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        out.append((name, {t: v / norm for t, v in raw.items()}))
    return out


def key_terms(vectors, threshold: float) -> list[str]:
    """Terms of which a line needs one: the others of a template together stay below the threshold."""
    keys = set()
    for _, vector in vectors:
        rest = 1.0
        for term, v in sorted(vector.items(), key=lambda x: (-x[1], x[0])):
            if rest < (threshold - 1e-9) ** 2:
                break
            keys.add(term)
            rest -= v * v
    return sorted(keys)


def statements(files: DataFrame, threshold: float = THRESHOLD, templates=TEMPLATES) -> DataFrame:
    """Best statement of each file that has one: (id, rk, licence, score, line).

    ``files`` has id, rk and text.  Of equal scores the first name, then the
    first line wins.
    """
    weights, other, _ = corpus_weights(files, templates)
    vectors = _template_vectors(weights, templates)
    spark = files.sparkSession
    table = spark.createDataFrame(
        [(i, name, t, float(v)) for i, (name, vec) in enumerate(vectors) for t, v in vec.items()],
        "template int, licence string, term string, part double",
    )
    weight = spark.createDataFrame([(t, float(w)) for t, w in weights.items()], "term string, weight double")
    keys = F.array(*[F.lit(t) for t in key_terms(vectors, threshold)])
    lines = F.filter(
        F.transform(
            F.split(F.coalesce("text", F.lit("")), r"\r?\n"),
            lambda x, i: F.struct(i.alias("line"), terms(x).alias("terms")),
        ),
        lambda s: F.arrays_overlap(s["terms"], keys),
    )
    counted = (
        files.select("id", "rk", F.explode(lines).alias("_s"))
        .select("id", "rk", "_s.line", F.explode("_s.terms").alias("term"))
        .groupBy("id", "rk", "line", "term").agg(F.count(F.lit(1)).alias("tf"))
        .join(F.broadcast(weight), "term", "left")
        .withColumn("value", F.col("tf") * F.coalesce("weight", F.lit(other)))
    )
    # one pass: a row without a template carries the length of the line
    parts = counted.join(F.broadcast(table), "term", "left").groupBy("id", "rk", "line", "template", "licence").agg(
        F.sum(F.col("value") * F.col("part")).alias("dot")
    )
    norms = counted.groupBy("id", "rk", "line").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    scored = (
        parts.filter(F.col("template").isNotNull()).join(norms, ["id", "rk", "line"])
        .withColumn("score", F.col("dot") / F.col("norm")).filter(F.col("score") >= threshold)
    )
    order = F.struct((-F.round("score", 9)).alias("a"), "licence", "line")
    return scored.groupBy("id", "rk").agg(F.min_by(F.struct("licence", "score", "line"), order).alias("_b")).select(
        "id", "rk", "_b.licence", "_b.score", "_b.line"
    )


def directory(path: Column) -> Column:
    """The part before the last slash; ``/`` for files at the top."""
    cut = F.regexp_replace(path, r"/[^/]*$", "")
    return F.when((cut == "") | (~F.contains(path, F.lit("/"))), F.lit("/")).otherwise(cut)


def _ancestors(folder: Column) -> Column:
    """The folder itself and all above it as (folder, depth)."""
    names = F.array_remove(F.split(folder, "/"), "")
    return let(
        names,
        lambda n: F.transform(
            F.sequence(F.lit(0), F.size(n)),
            lambda k: F.struct(F.concat(F.lit("/"), F.array_join(F.slice(n, 1, k), "/")).alias("folder"), k.alias("depth")),
        ),
    )


def license_scan(
    files: DataFrame,
    id_col: str = "doc_id",
    path_col: str = "path",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    licence_file: str = LICENCE_FILE,
    templates=TEMPLATES,
) -> DataFrame:
    """One row per file: doc_id, path, own_licence, score, licence, via, taken_from.

    ``via`` is ``statement``, ``directory`` or null where nothing is found.  A
    null path lies at the top and is no licence file; null and empty texts have
    no statement; repeated rows get the same result.  Paths are compared with a
    leading and without a trailing slash.
    """
    found = statements(keyed(files, id_col, text_col), threshold, templates)
    path = F.coalesce(F.col(path_col).cast("string"), F.lit(""))
    folder = F.concat(F.lit("/"), F.array_join(F.array_remove(F.split(directory(path), "/"), ""), "/"))
    listed = files.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("id"), row_key(id_col, text_col).alias("rk"),
        F.col(path_col).alias("path"), folder.alias("folder"),
        F.regexp_extract(path, r"([^/]*)$", 1).rlike(licence_file).alias("_is"),
    ).join(found, ["id", "rk"], "left")
    order = F.struct((-F.round("score", 9)).alias("a"), "licence")
    declared = (
        listed.filter(F.col("_is") & F.col("licence").isNotNull())
        .groupBy("folder").agg(F.min_by("licence", order).alias("_given"))
        .withColumnRenamed("folder", "_from")
    )
    inherited = (
        listed.select("folder").distinct()
        .select("folder", F.explode(_ancestors(F.col("folder"))).alias("_a"))
        .select("folder", F.col("_a.folder").alias("_from"), F.col("_a.depth").alias("_depth"))
        .join(declared, "_from")
        .groupBy("folder").agg(F.max_by(F.struct("_given", "_from"), "_depth").alias("_g"))
    )
    own = F.col("licence").isNotNull()
    return listed.join(inherited, "folder", "left").select(
        plain_id().alias("doc_id"), "path", F.col("licence").alias("own_licence"), F.round("score", 6).alias("score"),
        F.coalesce("licence", "_g._given").alias("licence"),
        F.when(own, F.lit("statement")).when(F.col("_g").isNotNull(), F.lit("directory")).alias("via"),
        F.when(~own, F.col("_g._from")).alias("taken_from"),
    )
