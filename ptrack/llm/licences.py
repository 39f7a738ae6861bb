"""Licence scan: TF-IDF cosine of licence headers to templates, and inheritance by directory.

The lines of a text that speak of a licence are its header. Headers and templates are
sparse vectors of words, weighted by their frequency and by how rare they are among all
headers; words outside the templates count in the length of a header only. A header takes
the template of the greatest cosine. Files with such a header that are named like a licence
file, and short texts that are little else, are licence files: they hold for their directory, and a file without a header inherits
from the nearest directory above it, found by joins on paths."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ptrack.llm.common import stored

CUES = "(?i)licen[sc]e|copyright|copying|permission is hereby|redistribution and use|public domain|spdx"
# Short notices by which public licences are named.
TEMPLATES = (
    ("MIT", "Released under the MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
)
LEAST = 0.6
# Files that hold for their directory by name, however long: LICENSE, LICENCE.md, COPYING.LESSER, LICENSE-MIT, MIT-LICENSE.txt
FILE_NAMES = "(?i)(^|/)([a-z0-9.]+[-_])?(un)?(licen[sc]e|copying)([-_.][a-z0-9._-]+)?$"
FILE_NAMES_NOT = "(?i)[.](py|js|ts|java|c|cc|cpp|h|hpp|rs|go|rb|php|sh|cs|html?|css|json|xml|ya?ml)$"
FILE_WORDS = 40                       # a licence file has at most so many words besides its header


def _terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _counted(df: DataFrame, key: list, text: str) -> DataFrame:
    """(key, term, tf)"""
    return df.select(*key, F.explode(_terms(F.col(text))).alias("term")).groupBy(*key, "term").agg(F.count(F.lit(1)).alias("tf"))


def headers(files: DataFrame) -> DataFrame:
    """file, header: the lines that speak of a licence; files without such lines are left out."""
    lines = F.filter(F.split(F.col("text"), "\\n"), lambda x: x.rlike(CUES))
    return files.where(F.col("text").rlike(CUES)).select("file", F.explode(lines).alias("header"))


def matches(heads: DataFrame, least: float = LEAST) -> DataFrame:
    """(file, licence, similarity) of the best template of any header line, if it is near enough.
    Equal headers are compared once; ties go by name."""
    spark = heads.sparkSession
    known = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(TEMPLATES)], "template int, licence string, text string")
    texts = heads.groupBy("header").agg(F.count(F.lit(1)).alias("many"))
    texts = stored(texts.withColumn("h", F.xxhash64("header")), "headers")
    tf = _counted(texts, ["h"], "header")
    # how many headers hold a word, all files counted
    df = tf.join(texts.select("h", "many"), "h").groupBy("term").agg(F.sum("many").alias("df"))
    n = heads.count()
    idf = F.log((F.lit(n) + 1.0) / (F.coalesce("df", F.lit(0)) + 1.0)) + 1.0
    a = tf.join(df, "term").select("h", "term", (F.col("tf") * idf).alias("w"))
    a_len = a.groupBy("h").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("a_len"))
    # the templates are a fixed list of a few hundred words
    b = F.broadcast(stored(_counted(known, ["template", "licence"], "text").join(df, "term", "left").select("template", "licence", "term", (F.col("tf") * idf).alias("v")), "templates"))
    b_len = F.broadcast(b.groupBy("template").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("b_len")))
    dot = a.join(b, "term").groupBy("h", "template", "licence").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    cos = (dot.join(a_len, "h").join(b_len, "template").select("h", "licence", F.round(F.col("dot") / (F.col("a_len") * F.col("b_len")), 9).alias("similarity"))
           .where(F.col("similarity") >= least))
    best = cos.groupBy("h").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "licence")).alias("best"))
    found = heads.select("file", F.xxhash64("header").alias("h")).join(best, "h")
    return found.groupBy("file").agg(F.min("best").alias("best")).select("file", F.col("best.licence").alias("licence"), (-F.col("best.s")).alias("similarity"))


def directory_licences(files: DataFrame) -> DataFrame:
    """(dir, licence): of the licence files of a directory the most similar one, then the least file."""
    pick = F.struct((-F.col("similarity")).alias("s"), "file", "licence")
    return files.where("is_licence_file").groupBy("dir").agg(F.min(pick).alias("p")).select("dir", F.col("p.licence").alias("licence"))


def licence_scan(files: DataFrame, least: float = LEAST, file_words: int = FILE_WORDS) -> DataFrame:
    """files (file: unique, path, text) -> file, path, licence, similarity, found_in.

    found_in is 'header', 'directory' with the directory in `holder`, or null if nothing was
    found. A null path is the root. Null texts have no header."""
    files = files.select("file", F.coalesce("path", F.lit("")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    heads = stored(headers(files), "licence-headers")
    own = matches(heads, least)
    words = F.size(F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
    per = heads.groupBy("file").agg(F.sum(F.size(F.split("header", "[\\x20\\x09-\\x0D]+"))).alias("header_words"))
    listed = files.select("file", "path", words.alias("words"), F.regexp_replace("path", "/?[^/]*$", "").alias("dir"))
    named = F.col("path").rlike(FILE_NAMES) & ~F.col("path").rlike(FILE_NAMES_NOT)
    whole = stored(listed.join(own, "file", "left").join(per, "file", "left").withColumn(
        "is_licence_file", F.col("licence").isNotNull() & (named | (F.col("words") - F.coalesce("header_words", F.lit(0)) <= file_words))), "licence-files")
    held = directory_licences(whole)
    # directories once each, however many files they hold, with all that lie above them
    steps = F.filter(F.split("dir", "/"), lambda x: x != "")
    above = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(steps, 1, i), "/").alias("up")))
    dirs = whole.select("dir").distinct().select("dir", F.explode(above).alias("a")).select("dir", "a.depth", "a.up")
    near = (dirs.join(held.select(F.col("dir").alias("up"), "licence"), "up").groupBy("dir")
            .agg(F.max(F.struct("depth", "up", "licence")).alias("n")).select("dir", F.col("n.up").alias("holder"), F.col("n.licence").alias("held")))
    out = whole.join(near, "dir", "left")
    own_one = F.col("licence").isNotNull()
    return out.select("file", "path", F.coalesce("licence", "held").alias("licence"), "similarity",
                      F.when(own_one, "header").when(F.col("held").isNotNull(), "directory").alias("found_in"),
                      F.when(~own_one, F.col("holder")).alias("holder"))
