"""Licence statements by a trained paragraph classifier, with DataFrame functions only.

A paragraph is a block of lines up to a blank line, a line that ends a sentence or a short line; lines wrapped at
WRAPPED characters or more go on in the next one, and marks of comments are taken off. Features are its word n-grams (one to
three words). A multinomial logistic regression with an L1 share, so that its weights are sparse, learns the families
and `unknown` from notices, parts of notices, and a bounded sample of other paragraphs. On
paragraphs of the sample that were not trained on, the least probability for naming a family is
chosen such that at most MISTAKES of them are named. A prediction is confirmed by comparing the paragraph with the
notices of the family: of one of them, CONFIRM of the words must stand in the paragraph, in line with one another.

Every paragraph is looked at: a notice may have lost the very word that tells of licences.

Cases: null and empty texts have no paragraphs and no families; very long paragraphs take time in proportion to their words;
repeated rows are judged each; a null doc_id is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged

#: Notices by family, sentences that speak of licences without being one, and the words that tell of licences.
NOTICES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT license.", "This project is distributed under the terms of the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "ISC": ["Released under the ISC License.", "Permission to use, copy, modify, and or distribute this software for any purpose with or without fee is hereby granted"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Released under the Apache License 2.0.", "This file is licensed under the Apache License, Version 2.0 (the License)", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS basis"],
    "GPL": ["This work is licensed under the GNU General Public License, version 3.", "Released under the GNU GPL, version 2 or later.", "This program is free software: you can redistribute it and or modify it under the terms of the GNU General Public License", "Licensed under the GPL version 3.", "Licensed under the GNU General Public License, version 2."],
    "LGPL": ["Licensed under the GNU Lesser General Public License, version 3.", "This library is released under the LGPL, version 2.1 or later."],
    "AGPL": ["Licensed under the GNU Affero General Public License, version 3.", "Released under the AGPL, version 3 or later."],
    "BSD": ["Released under the BSD License.", "Licensed under the BSD 3-Clause License.", "Licensed under the BSD 2-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted"],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.", "Licensed under the Mozilla Public License 2.0."],
    "EPL": ["This program is made available under the terms of the Eclipse Public License 2.0.", "Licensed under the Eclipse Public License, version 2.0."],
    "zlib": ["Released under the zlib License.", "This software is provided as is, without any express or implied warranty. Permission is granted to anyone to use this software for any purpose"],
    "Unlicense": ["Released under the Unlicense.", "This is free and unencumbered software released into the public domain under the Unlicense."],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "Text is available under the Creative Commons Attribution ShareAlike License."],
    "CC0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright, dedicated to the public domain under CC0 1.0 Universal."],
    "Proprietary": ["All rights reserved.", "Copyright, all rights reserved. No part of this may be reproduced without written permission."],
}
OTHERWISE = ["Her driving license had expired in May.", "A licence to fish in the river costs ten pounds.", "Copyright law protects authors of books.", "They reserved a table for two.", "All seats are reserved.", "You need written permission of the owner to enter.", "The creative team met on the village commons.", "The warranties of the seller last two years.", "The tribe of the Apache lived in the south.", "The redistribution of land was permitted by the new version of the law.", "He is a licensed plumber and works under the terms of the union."]
TELLING = ["license", "licensed", "licence", "licenced", "unlicense", "gnu", "gpl", "lgpl", "agpl", "bsd", "mozilla", "eclipse", "zlib", "cc0", "creative", "commons", "copyright", "permission", "redistribution", "redistribute", "reserved", "warranty", "warranties"]
#: Words of other tongues too, so these tell only if their first letter is a capital.
TELLING_CAPITALS = ["MIT", "Mit", "CC", "Cc", "ISC", "Apache", "APACHE"]
UNKNOWN = "unknown"

#: The bounded training sample: paragraphs of the corpus, about this many.
SAMPLE_PARAGRAPHS = 4000
MISTAKES = 0.001
#: Share of a notice's words that confirms a prediction, and words that may be put in or left out between them.
CONFIRM = 0.75
DRIFT = 8
MOST = 3
#: Characters from which a line may be wrapped.
WRAPPED = 40

_MARKS = r"(?m)^[ \t]*(?:#+|//+|/?\*+|--+|;+)[ \t]?"
#: The look ahead changes no match; it spares looking back from places that are not before a line's end.
_WRAP = rf"(?=[ \t]*\n)(?<=[^\n]{{{WRAPPED}}})(?<![.!?:;])[ \t]*\n[ \t]*(?=[^ \t\n])"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[0-9\p{L}]+"), F.lit(0))


def _with_words(rows: DataFrame) -> DataFrame:
    """rows with w, the words of text, in place of text. The array of one holds them, so that they are found once."""
    return rows.withColumn("_w", F.array(words_of(F.col("text")))).select(*[c for c in rows.columns if c != "text"], F.explode("_w").alias("w"))


def grams(w: Column) -> Column:
    """All runs of one to MOST words of w."""
    return F.filter(F.concat(*(_joined(w, n) for n in range(1, MOST + 1))), lambda g: g.isNotNull())


def _joined(w: Column, n: int) -> Column:
    """Of words w, w w', w w' w''... by n lists, each shifted by one; null where words are missing."""
    out = w
    for k in range(1, n):
        out = F.zip_with(out, F.slice(w, k + 1, F.size(w)), lambda a, b: F.concat(a, F.lit(" "), b))
    return out


def with_grams(rows: DataFrame) -> DataFrame:
    """rows with g, the distinct n-grams of text, in place of text."""
    told = _with_words(rows)
    return told.select(*[c for c in told.columns if c != "w"], F.array_distinct(grams(F.col("w"))).alias("g"))


def paragraphs(docs: DataFrame) -> DataFrame:
    """key, at, text (_outer: a plain explode would have Spark work the pieces out twice): the paragraphs of each distinct text."""
    told = docs.filter("text IS NOT NULL").select("key", "text").dropDuplicates(["key"])
    blocks = F.split(F.regexp_replace(F.regexp_replace("text", _MARKS, ""), _WRAP, " "), "\n")
    return told.select("key", F.posexplode_outer(blocks).alias("at", "text")).filter("trim(text) <> ''")


def notices(spark: SparkSession) -> DataFrame:
    rows = [F.struct(F.lit(f).alias("family"), F.lit(n).alias("text"), F.lit(i).alias("no")) for i, (f, n) in enumerate((f, n) for f, all_n in NOTICES.items() for n in all_n)]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _examples(spark: SparkSession) -> DataFrame:
    """Notices whole, in part, and with words around them; telling words without a notice are unknown."""
    n = notices(spark)
    w = F.split("text", " ")
    part = lambda a, b: F.array_join(F.slice(w, a, F.greatest(b, F.lit(1))), " ")
    forms = F.array("text", F.upper("text"), part(F.lit(1), F.floor(F.size(w) * 0.8).cast("int")), part(F.lit(2), F.size(w)), F.concat(F.lit("Note. "), "text"), F.concat("text", F.lit(" See the file for details.")))
    alone = [t.format(w) for w in TELLING + TELLING_CAPITALS for t in ("{}", "and {} of them")] + OTHERWISE
    unknown = spark.range(1).select(F.lit(UNKNOWN).alias("family"), F.explode(F.array(*map(F.lit, alone))).alias("text"))
    return n.select("family", F.explode(forms).alias("text")).unionByName(unknown)


class Classifier:
    """weights: gram, and w, one weight for each family (families[-1] is unknown); small tables, bounded by NOTICES."""

    def __init__(self, families: list[str], weights: DataFrame, bias: list[float], least: float):
        self.families, self.weights, self.bias, self.least = families, weights, bias, least
        self.words = sorted({w for r in weights.select("gram").collect() for w in r["gram"].split(" ")})

    def predict(self, rows: DataFrame) -> DataFrame:
        """key, at, family, probability of the rows (key, at, text) that are named; the others, and those without an n-gram that has weight, are unknown."""
        k = len(self.families)
        # a word that no n-gram with weight has is null, and with it the n-grams that hold it: these are neither spelled out nor joined
        known = _with_words(rows).select("key", "at", F.transform("w", lambda x: F.when(x.isin(self.words), x)).alias("w")).filter(F.exists("w", lambda x: x.isNotNull()))
        parts = known.select("key", "at", F.explode_outer(F.array_distinct(grams(F.col("w")))).alias("gram")).join(F.broadcast(self.weights), "gram")
        sums = parts.groupBy("key", "at").agg(*(F.sum(F.col("w")[i]).alias(f"s{i}") for i in range(k)))
        logits = F.array(*(F.col(f"s{i}") + self.bias[i] for i in range(k)))
        scored = sums.select("key", "at", logits.alias("l")).withColumn("top", F.array_max("l"))
        total = F.aggregate(F.transform("l", lambda x: F.exp(x - F.col("top"))), F.lit(0.0), lambda a, x: a + x)
        best = F.element_at(F.array(*map(F.lit, self.families)), F.array_position("l", F.col("top")).cast("int"))
        named = scored.select("key", "at", best.alias("best"), (1 / total).alias("probability"))
        family = F.when((F.col("best") != UNKNOWN) & (F.col("probability") >= self.least), F.col("best")).otherwise(UNKNOWN)
        return staged(named.select("key", "at", family.alias("family"), "probability").filter(F.col("family") != UNKNOWN), "licence-named")

    def confirm(self, rows: DataFrame, found: DataFrame) -> DataFrame:
        """found (of predict) with confirmed; rows (key, at, text) hold those paragraphs, and perhaps others.

        Words of a notice are in line if their places in notice and paragraph differ by about the same: two rows of bands of 2 * DRIFT, set off by DRIFT, hold any that differ by DRIFT at most.
        """
        spelled = _with_words(rows.join(found.select("key", "at"), ["key", "at"], "left_semi"))
        notice = _with_words(notices(spelled.sparkSession)).select("family", "no", F.size("w").alias("size"), F.posexplode("w").alias("o", "word"))
        paragraph = found.join(spelled, ["key", "at"]).select("key", "at", "family", F.posexplode("w").alias("i", "word"))
        met = paragraph.join(F.broadcast(notice), ["family", "word"])
        bands = F.array(*(F.struct(F.lit(s).alias("row"), F.floor((F.col("i") - F.col("o") + s) / (2 * DRIFT)).alias("band")) for s in (0, DRIFT)))
        in_line = met.withColumn("b", F.explode(bands)).groupBy("key", "at", "no", "size", "b").agg(F.count_distinct("o").alias("n"))
        share = in_line.groupBy("key", "at").agg(F.max(F.col("n") / F.col("size")).alias("share"))
        return found.join(share, ["key", "at"], "left").select("key", "at", "family", "probability", (F.coalesce("share", F.lit(0.0)) >= CONFIRM).alias("confirmed"))


def train(docs: DataFrame) -> Classifier:
    """From the notices, and about SAMPLE_PARAGRAPHS paragraphs of docs (text) in which no notice stands."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizer

    spark = docs.sparkSession
    n = docs.count()
    lines = docs.select("text").sample(min(1.0, SAMPLE_PARAGRAPHS / 4 / max(n, 1)), seed=11).select(F.explode(F.split("text", "\n")).alias("text")).filter("trim(text) <> ''")
    telling = F.element_at(F.array(*map(F.lit, TELLING)), (F.pmod(F.xxhash64("text"), F.lit(len(TELLING))) + 1).cast("int"))
    #: A telling word alone does not make a notice; each other paragraph is also shown with one put in.
    plain = lines.filter(~F.col("text").rlike(r"(?i)licen[sc]e|copyright|all rights reserved")).select("text", F.concat(telling, F.lit(" "), "text").alias("with"))
    others = plain.select(F.explode(F.array("text", "with")).alias("text"), F.lit(UNKNOWN).alias("family"), (F.pmod(F.xxhash64("text"), F.lit(4)) == 0).alias("kept"))
    examples = staged(_examples(spark).withColumns({"kept": F.lit(False), "made": F.lit(True)}).unionByName(others.withColumn("made", F.lit(False))), "licence-examples", rows=SAMPLE_PARAGRAPHS)
    rows = staged(with_grams(examples.withColumn("told", F.col("text"))), "licence-training", rows=SAMPLE_PARAGRAPHS)
    families = [*NOTICES, UNKNOWN]
    label = F.array_position(F.array(*map(F.lit, families)), F.col("family")) - 1
    #: The n-grams of notices and of what is like them; of these, L1 leaves weights to those that tell families apart.
    counter = CountVectorizer(inputCol="g", outputCol="features", binary=True, minDF=2, vocabSize=1 << 14).fit(rows.filter("made"))
    known = counter.transform(rows.withColumn("label", label.cast("double")).withColumn("weight", F.when(F.col("family") == UNKNOWN, 1.0).otherwise(8.0)))
    model = LogisticRegression(family="multinomial", maxIter=60, regParam=3e-4, elasticNetParam=0.5, weightCol="weight").fit(known.filter("not kept"))
    matrix, bias = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    at = [(g, [float(x) for x in matrix[:, i]]) for i, g in enumerate(counter.vocabulary) if matrix[:, i].any()]
    weights = staged(spark.createDataFrame(at, "gram string, w array<double>"), "licence-weights", rows=len(at))
    first = Classifier(families, weights, [float(x) for x in bias], 0.0)
    held = rows.filter("kept").select(F.monotonically_increasing_id().alias("key"), F.lit(0).alias("at"), F.col("told").alias("text"))
    held = staged(held, "licence-held", rows=SAMPLE_PARAGRAPHS)
    mistakes = first.predict(held).agg(F.percentile(F.col("probability"), F.lit(0.999)), F.count("*")).first()
    wrong = mistakes[1] > MISTAKES * max(held.count(), 1)
    return Classifier(families, weights, first.bias, max(0.5, mistakes[0]) if wrong else 0.5)


def scan(docs: DataFrame, classifier: Classifier | None = None) -> DataFrame:
    """doc_id, n_notices, families (confirmed, sorted), n_unconfirmed, probability (the least of the confirmed) for each row of docs."""
    rows = docs.select("doc_id", F.struct(F.xxhash64("text").alias("a"), F.hash("text").alias("b")).alias("key"), "text")
    model = classifier or train(docs)
    named = model.predict(paragraphs(rows))
    # words are found again for the few texts in which something is named, not kept for all
    found = staged(model.confirm(paragraphs(rows.join(named.select("key").distinct(), "key", "left_semi")), named), "licence-found")
    ok = F.col("confirmed")
    by_text = found.groupBy("key").agg(F.count_if(ok).alias("n_notices"), F.sort_array(F.collect_set(F.when(ok, F.col("family")))).alias("families"), F.count_if(~ok).alias("n_unconfirmed"), F.round(F.min(F.when(ok, F.col("probability"))), 6).alias("probability"))
    out = rows.select("doc_id", "key").join(by_text, "key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return out.select("doc_id", zero("n_notices"), F.array_join(F.coalesce("families", F.array().cast("array<string>")), ",").alias("families"), zero("n_unconfirmed"), "probability")
