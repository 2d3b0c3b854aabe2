"""Licence scan: TF-IDF cosine of header sentences and licence files to templates, then inheritance along directories.

Sentences that mention licensing are split into terms; each is a sparse vector of term count times inverse document
frequency (over all texts with such sentences) and meets the templates' vectors in one join on terms, whose other side
is the templates' own vocabulary. A text's licence is that of its best sentence with a cosine of `LEAST` or more.
A file without one inherits from the nearest ancestor directory that holds a licence file. DataFrame functions only.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.llm.store import staged

# Short notices of common licences.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "You may not use this file except in compliance with the License."],
    "MIT": ["Released under the MIT License.", "This project is licensed under the MIT License."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.",
                "either version 3 of the License, or (at your option) any later version of the GNU General Public License"],
    "GPL-2.0": ["This program is licensed under the GNU General Public License, version 2."],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3."],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.",
                     "Redistribution and use in source and binary forms, with or without modification, are permitted"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "proprietary": ["All rights reserved.", "Copyright all rights reserved."],
}
HINT = r"(?i)licen[sc]e|copyright|rights reserved|redistribution and use|public domain"
SENTENCE = r"\n|(?<=[.!?;])[\x20\t]+"
TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
LEAST = 0.7
LICENCE_FILES = ["LICENSE", "LICENCE", "COPYING", "LICENSE.txt", "LICENSE.md"]
_NOTICES = [(name, Counter(re.findall(TERM, text.lower()))) for name, texts in TEMPLATES.items() for text in texts]


def _key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def sentence_terms(docs: DataFrame, text: str = "text") -> DataFrame:
    """(key, unit, term, tf) of the sentences that mention licensing; equal texts share a key, so a copy only scales tf."""
    held = docs.select(F.col(text).cast("string").alias("text")).filter(F.col("text").rlike(HINT))
    units = held.select(_key(F.col("text")).alias("key"), F.posexplode(F.split("text", SENTENCE, -1)).alias("unit", "sentence")).filter(F.col("sentence").rlike(HINT))
    terms = units.select("key", "unit", F.explode(F.regexp_extract_all(F.lower("sentence"), F.lit(TERM), F.lit(0))).alias("term"))
    return terms.groupBy("key", "unit", "term").agg(F.count("*").cast("double").alias("tf"))


def _template_weights(terms: DataFrame, n: Column) -> DataFrame:
    """(term, idf, weights): per term of the templates its weight in each notice, whose vectors have length one."""
    entries = F.array(*[F.struct(F.lit(i).alias("notice"), F.lit(t).alias("term"), F.lit(float(c)).alias("tf"))
                        for i, (_, counts) in enumerate(_NOTICES) for t, c in sorted(counts.items())])
    notices = terms.sparkSession.range(1).select(F.explode(entries).alias("e")).select("e.*")
    seen = (terms.join(F.broadcast(notices.select("term").distinct()), "term", "left_semi").select("key", "term").distinct()
            .groupBy("term").agg(F.count("*").alias("df")))
    weighed = notices.join(seen, "term", "left").withColumn("idf", F.log((1 + n) / (1 + F.coalesce("df", F.lit(0)))) + 1)
    of_notice = Window.partitionBy("notice")
    unit = weighed.withColumn("w", F.col("tf") * F.col("idf") / F.sqrt(F.sum((F.col("tf") * F.col("idf")) ** 2).over(of_notice)))
    held = unit.groupBy("term").agg(F.first("idf").alias("idf"), F.map_from_entries(F.collect_list(F.struct("notice", "w"))).alias("by_notice"))
    return held.select("term", "idf", F.array(*[F.coalesce(F.try_element_at("by_notice", F.lit(i)), F.lit(0.0)) for i in range(len(_NOTICES))]).alias("weights"))


def sentence_scores(terms: DataFrame) -> DataFrame:
    """(key, unit, licence, score): the best template of every sentence; ties go to the first template in the list."""
    n = terms.select("key").distinct().agg(F.count("*").alias("n")).scalar()
    # One row per term of the fixed templates, so the broadcast is bounded by them.
    known = terms.join(F.broadcast(_template_weights(terms, n)), "term", "left")
    value = F.col("tf") * F.coalesce("idf", F.log(1 + n) + 1)
    dots = [F.coalesce(F.sum(value * F.get("weights", F.lit(i))), F.lit(0.0)).alias(f"d{i}") for i in range(len(_NOTICES))]
    sums = known.groupBy("key", "unit").agg(F.sum(value * value).alias("square"), *dots)
    scored = F.array(*[F.struct((F.col(f"d{i}") / F.sqrt("square")).alias("score"), F.lit(-i).alias("place"), F.lit(name).alias("licence"))
                       for i, (name, _) in enumerate(_NOTICES)])
    return sums.select("key", "unit", F.array_max(scored).alias("best")).select("key", "unit", "best.licence", "best.score")


def direct_licences(docs: DataFrame, text: str = "text", least: float = LEAST) -> DataFrame:
    """(key, licence, score): the licence of every text that has one, by its best sentence, then the first."""
    scores = sentence_scores(staged(sentence_terms(docs, text), "terms")).filter(F.col("score") >= least)
    best = scores.groupBy("key").agg(F.max(F.struct("score", (-F.col("unit")).alias("place"), "licence")).alias("best"))
    return best.select("key", "best.licence", "best.score")


def licensed(docs: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(row, licence, score, via, inherited_from): via is header, directory or none; inherited_from is a directory.

    `row` holds the columns of docs but the text, which is not moved: only its key is joined on.

    A path's directory is what stands before its last slash; the root is the empty directory. A null path is outside of
    any directory and inherits nothing. If a directory holds several licence files, the best score, then the
    least licence name counts. Null text has no licence of its own. Repeated rows get equal answers.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row"), F.col(path).alias("path"), _key(F.col(text).cast("string")).alias("key"))
    found = staged(rows.join(direct_licences(docs, text), "key", "left").drop("key"), "found")
    directory = F.when(F.contains("path", F.lit("/")), F.regexp_extract("path", "^(.*)/[^/]*$", 1)).when(F.col("path").isNotNull(), F.lit(""))
    filed = found.withColumn("directory", directory)
    name = F.element_at(F.split("path", "/"), -1)
    grants = (filed.filter(name.isin(*LICENCE_FILES) & F.col("licence").isNotNull())
              .groupBy("directory").agg(F.min_by("licence", F.struct(-F.col("score"), "licence")).alias("granted")))
    # Each directory once, with all its ancestors; the deepest that grants a licence wins.
    depth = F.when(F.col("directory") == "", 0).otherwise(F.size(F.split("directory", "/")))
    above = (filed.select("directory").distinct().filter(F.col("directory").isNotNull())
             .select("directory", F.explode(F.sequence(F.lit(0), depth)).alias("depth"))
             .select("directory", "depth", F.array_join(F.slice(F.split("directory", "/"), F.lit(1), F.col("depth")), "/").alias("ancestor")))
    nearest = (above.join(grants.withColumnRenamed("directory", "ancestor"), "ancestor")
               .groupBy("directory").agg(F.max_by(F.struct("ancestor", "granted"), "depth").alias("near")))
    out = filed.join(nearest, "directory", "left")
    own = F.col("licence").isNotNull()
    return out.select("row", F.coalesce("licence", "near.granted").alias("licence"), "score",
                      F.when(own, "header").when(F.col("near").isNotNull(), "directory").otherwise("none").alias("via"),
                      F.when(~own, F.col("near.ancestor")).alias("inherited_from"))
