"""License scan by diagonal voting.

Rolling word k-grams of every text are joined to the positions of fixed template
texts. A hit at word i of the text and word j of a template votes for the diagonal
i - j; neighbouring diagonals (words added or left out) merge into one span, and a
span counts when the template words it covers reach the required share. Labels of
verified spans join those of three fixed phrases.

One pass over the texts keeps counts and the k-grams that may be in a template (a
bit table of the template hashes says so), without the texts; voting runs on these
small rows. The templates are fixed and their table is broadcast. Everything is
keyed by a row id of the written table, so copies and common lines spread evenly.

Cases: null or empty text gives zero counts and empty labels; repeated rows and null
ids give one row each; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxcohort.llm.common import let, text_of, written

K = 3
COVER = 0.75         # share of a template's words that a span must cover
DRIFT = 3            # diagonals this near to each other merge
BITS = 1 << 16

# fixed values: phrases of the contract
PHRASES = {"cc-by": ("cc", "by"), "gpl": ("general", "public", "license"), "reserved": ("all", "rights", "reserved")}

# fixed values: notices of public licenses, as words
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("reserved", "all rights reserved"),
]


def license_words(text: Column) -> Column:
    """Runs of ASCII letters and digits and of other characters above ASCII, in lower case."""
    return F.array_remove(F.split(F.lower(text), "[\\x00-/:-`{-\\x7F]+"), "")


def _kgram(words: Column, i: Column, first: Column, k: int) -> Column:
    return F.xxhash64(first, *[F.get(words, i + n) for n in range(1, k)])


def template_positions(spark, templates=None, k: int = K) -> DataFrame:
    """One row per k-gram of a template: label, template, n_template, j, gram."""
    rows = [(i, label, text) for i, (label, text) in enumerate(templates or TEMPLATES)]
    words = spark.createDataFrame(rows, "template int, label string, text string").withColumn("w", license_words(F.col("text")))
    grams = F.transform(F.slice("w", 1, F.greatest(F.size("w") - (k - 1), F.lit(0))),
                        lambda x, j: F.struct(j.alias("j"), _kgram(F.col("w"), j, x, k).alias("gram")))
    return words.select("template", "label", F.size("w").alias("n_template"), F.inline(grams))


def _phrase(words: Column, i: Column, first: Column) -> Column:
    """Number of the base phrase that starts at word i, else null."""
    out = F.lit(None).cast("int")
    for n, phrase in enumerate(PHRASES.values()):
        here = first == phrase[0]
        for at, word in enumerate(phrase[1:], 1):
            here = here & (F.get(words, i + at) == word)
        out = F.when(here, F.lit(n)).otherwise(out)
    return out


def license_scan(docs: DataFrame, templates=None, k: int = K, cover: float = COVER, drift: int = DRIFT) -> DataFrame:
    """One row per document: base counts and labels, all labels, and ``score``.

    ``score`` is the best share of a template covered by a verified span, 1 where a
    base phrase stands, else 0.
    """
    spark = docs.sparkSession
    positions = template_positions(spark, templates, k)
    fixed = positions.collect()      # fixed templates
    places, bits = spark.createDataFrame(fixed, positions.schema), ["0"] * BITS
    for r in fixed:
        bits[r["gram"] % BITS] = "1"
    table = F.split(F.lit(" ".join(bits)), " ").cast("array<boolean>")
    maybe = lambda g: F.get(table, F.pmod(g, F.lit(BITS)).cast("int"))

    def facts(w):
        seen = F.transform(w, lambda x, i: F.struct(i.alias("i"), _kgram(w, i, x, k).alias("gram"), _phrase(w, i, x).alias("phrase")))
        return F.struct(F.size(w).cast("long").alias("n_words"),
                        F.filter(seen, lambda s: s["phrase"].isNotNull() | maybe(s["gram"])).alias("seen"))

    names = F.array(*map(F.lit, PHRASES))
    rows = docs.select("doc_id", let(license_words(text_of()), facts).alias("f"))
    rows = rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.col("f.n_words").alias("n_words"), F.col("f.seen").alias("seen"))
    rows = written(rows)
    base = F.filter("seen", lambda s: s["phrase"].isNotNull())

    hits = rows.select("rid", F.inline("seen")).join(F.broadcast(places), "gram")
    votes = hits.groupBy("rid", "template", "label", "n_template", (F.col("i") - F.col("j")).alias("diagonal")).agg(F.collect_set("j").alias("js"))
    by = W.partitionBy("rid", "template").orderBy("diagonal")
    chained = votes.withColumn("new", (F.col("diagonal") - F.lag("diagonal").over(by) > drift).cast("int")) \
        .withColumn("span", F.sum(F.coalesce("new", F.lit(0))).over(by))
    covered = F.size(F.array_distinct(F.flatten(F.transform(F.flatten(F.collect_list("js")), lambda j: F.sequence(j, j + (k - 1))))))
    spans = chained.groupBy("rid", "template", "label", "n_template", "span").agg(covered.alias("n")) \
        .withColumn("share", F.col("n") / F.col("n_template")).where(F.col("share") >= cover)
    found = spans.groupBy("rid").agg(F.collect_set("label").alias("more"), F.max("share").alias("best"))

    base_names = lambda b: F.transform(b, lambda s: F.get(names, s["phrase"]))
    starts = F.transform(base, lambda s: s["i"].cast("long"))
    out = rows.select("rid", "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
                      F.array_max(starts).alias("last_word"), F.array_sort(F.array_distinct(base_names(base))).alias("names"))
    joined = out.join(found, "rid", "left")
    nothing = F.array().cast("array<string>")
    return joined.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("names", ",").alias("base_labels"),
                         F.array_join(F.array_sort(F.array_union("names", F.coalesce("more", nothing))), ",").alias("labels"),
                         F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))
