"""Licence scan: passages against licence templates by Dice coefficient over word bigrams, in DataFrame functions.

Texts and templates are normalised to lower-case words. A passage of n bigrams and a template of m that share s of
them, repeats included, have the coefficient 2 s / (n + m); at a threshold t only passages with n from m t / (2 - t) to
m (2 - t) / t can reach it, and share m t / (2 - t) bigrams at least. So a template's rarest bigrams, as many as leave
fewer than that, tell which texts can hold it; only these texts' other bigrams are looked up, and only passages
within the size bounds that begin and end with a shared bigram are scored: others score less.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilgraph.plans.staging import staged

THRESHOLD = 0.8
#: Templates go to every task up to so many bigrams in all; more are shuffled.
BROADCAST_BIGRAMS = 200_000

#: Licence statements as they are commonly worded, and the texts or notices of short licences.
STATEMENTS = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This file is subject to the terms of the Mozilla Public License, version 2.0."),
    ("all-rights-reserved", "All rights reserved."),
)
TEXTS = (
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain "
        "the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR "
        "IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain "
        "the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to "
        "endorse or promote products derived from this software without specific prior written permission.",
    ),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice "
        "appear in all copies.",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
        "to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)
TEMPLATES = STATEMENTS + TEXTS


def _words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")


def _placed(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, pos, a, b): the bigrams of the words column w, by their place from 0."""
    n = F.size("w") - 1
    pairs = F.arrays_zip(F.slice("w", F.lit(1), n), F.slice("w", F.lit(2), n))
    rows = df.where((F.size("w") > 1) & (F.col("w")[0] != "")).select(*keys, F.posexplode(pairs).alias("pos", "g"))
    return rows.select(*keys, "pos", F.col("g")["0"].alias("a"), F.col("g")["1"].alias("b"))


def templates(spark: SparkSession, rows=TEMPLATES) -> DataFrame:
    """(licence, template): the statements and texts to look for."""
    return spark.createDataFrame(list(rows), "licence string, template string")


def template_bigrams(known: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(tid, licence, m, most, a, b, c, rare): a template's distinct bigrams, how often it has each, and whether texts
    are searched for that one first; m bigrams with repeats, and the most that a passage can have."""
    words = known.where(F.col("template").isNotNull()).select("licence", _words(F.col("template")).alias("w")).distinct()
    t = words.select("licence", "w", F.xxhash64("licence", "w").alias("tid"), (F.size("w") - 1).alias("m"))
    grams = _placed(t, "tid", "licence", "m").groupBy("tid", "licence", "m", "a", "b").agg(F.count(F.lit(1)).alias("c"))
    spread = grams.groupBy("a", "b").agg(F.count(F.lit(1)).alias("in"))
    order = Window.partitionBy("tid").orderBy("in", (-F.length("a") - F.length("b")).alias("short"), "a", "b")
    least = F.ceil(F.col("m") * (threshold / (2 - threshold)) - 1e-9)
    before = F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("c")
    return grams.join(spread, ["a", "b"]).select("tid", "licence", "m", F.floor(F.col("m") * ((2 - threshold) / threshold) + 1e-9).cast("int").alias("most"), "a", "b", "c", (before < F.col("m") - least + 1).alias("rare"))


def scan(docs: DataFrame, known: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, licence, dice, first_word, n_words): licences whose template a passage of the document matches, with the
    largest coefficient and where the first, then shortest passage that has it begins and how many words it has.

    A passage may stand anywhere, over line ends too, and matches every template at or over the threshold. Texts of one
    word have no bigram and match nothing; nor do nulls and empty texts. Rows that share an identifier are reported
    together, null identifiers as one; repeated templates count once. Other columns are ignored.
    """
    grams = template_bigrams(known, threshold)
    few = grams.count() <= BROADCAST_BIGRAMS
    small = F.broadcast if few else (lambda df: df)
    key = ["k1", "k2"]
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull()).select("id", "text", F.xxhash64("id", "text").alias("k1"), F.xxhash64(F.lit(1), "text", "id").alias("k2"))
    words = _placed(texts.select("id", *key, _words(F.col("text")).alias("w")), "id", *key)
    able = staged(words.join(small(grams.where("rare").select("tid", "a", "b")), ["a", "b"]).select("id", *key, "tid").distinct(), "able")
    named = grams.withColumn("g", F.xxhash64("a", "b")).drop("a", "b", "rare")
    seen = words.join(small(grams.select("a", "b").distinct()), ["a", "b"]).select(*key, "pos", F.xxhash64("a", "b").alias("g"))
    # Places are dealt out whatever the size of able, and texts are not moved.
    met = seen.join(able.hint("shuffle_hash"), key).join(small(named), ["tid", "g"]).dropDuplicates([*key, "tid", "pos"])
    hits = staged(met.withColumn("part", F.floor(F.col("pos") / F.col("most"))), "hits")
    starts = hits.select("id", "licence", "m", "most", *key, "tid", F.col("pos").alias("s"), F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    pairs = starts.join(hits.select(*key, "tid", "part", F.col("pos").alias("e"), "g", "c"), [*key, "tid", "part"]).where((F.col("e") >= F.col("s")) & (F.col("e") < F.col("s") + F.col("most")))
    passage = [*key, "tid", "s"]
    dealt = pairs.repartition(*passage).withColumn("r", F.row_number().over(Window.partitionBy(*passage, "g").orderBy("e")))
    shared = F.sum((F.col("r") <= F.col("c")).cast("int")).over(Window.partitionBy(*passage).orderBy("e"))
    scored = dealt.withColumn("dice", 2.0 * shared / (F.col("e") - F.col("s") + 1 + F.col("m"))).where(F.col("dice") >= threshold)
    best = scored.groupBy("id", "licence").agg(F.max(F.struct("dice", (-F.col("s")).alias("s"), (-F.col("e")).alias("e"))).alias("x"))
    return best.select("id", "licence", "x.dice", (-F.col("x.s")).cast("long").alias("first_word"), (F.col("x.s") - F.col("x.e") + 2).cast("long").alias("n_words"))


def sql(threshold: float = THRESHOLD) -> str:
    """DuckDB's SQL for scan() of documents against TEMPLATES: all passages that begin and end with a shared bigram."""
    rows = ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(TEMPLATES))
    words = "string_split(trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')"
    grams = "unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS g, unnest(range(0, len(w) - 1)) AS pos"
    ratio = f"({2 - threshold!r}::DOUBLE / {threshold!r})"
    return f"""
    WITH t AS (SELECT tid, licence, len(w) - 1 AS m, {grams} FROM (SELECT tid, licence, {words.format("template")} AS w FROM (VALUES {rows}) v(tid, licence, template))),
    tc AS (SELECT tid, licence, m, floor(m * {ratio} + 1e-9)::INT AS most, g, count(*) AS c FROM t GROUP BY ALL),
    d AS (SELECT doc_id, row_number() OVER () AS k, {words.format("text")} AS w FROM documents),
    h AS MATERIALIZED (SELECT doc_id, k, tid, licence, m, most, g, c, pos FROM (SELECT doc_id, k, {grams} FROM d WHERE len(w) > 1) JOIN tc USING (g)),
    p AS (SELECT x.doc_id, x.k, x.tid, x.licence, x.m, x.pos AS s, y.pos AS e, y.c, row_number() OVER (PARTITION BY x.k, x.tid, x.pos, y.g ORDER BY y.pos) AS r
          FROM h x JOIN h y ON x.k = y.k AND x.tid = y.tid AND y.pos BETWEEN x.pos AND x.pos + x.most - 1),
    q AS (SELECT doc_id, licence, m, s, e, sum(CASE WHEN r <= c THEN 1 ELSE 0 END) OVER (PARTITION BY k, tid, s ORDER BY e) AS shared FROM p),
    z AS (SELECT doc_id, licence, s, e, 2.0::DOUBLE * shared / (e - s + 1 + m) AS dice FROM q)
    SELECT doc_id, licence, dice, s AS first_word, e - s + 2 AS n_words FROM z WHERE dice >= {threshold!r}
    QUALIFY row_number() OVER (PARTITION BY doc_id, licence ORDER BY dice DESC, s, e) = 1"""


__all__ = ["STATEMENTS", "TEMPLATES", "TEXTS", "THRESHOLD", "scan", "sql", "template_bigrams", "templates"]
