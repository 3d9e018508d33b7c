"""License scans by diagonal voting.

Rolling word k-grams of a text are joined, by hash, to the places where templates have them; hits on one diagonal (place in the
text less place in the template) vote for one copy of the template, neighbouring diagonals belong to one copy with words put
in or left out, and a span counts when enough of the template's k-grams stand in it word for word. K-grams that no template has
are dropped within the text's row, by the same hash table, before anything is joined. DataFrame functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonorant.llm.common import materialize, read_table

#: Words hold what is neither an ASCII control, space nor punctuation; upper-case A to Z count as lower-case.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"

#: The base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices of public licenses, by label.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
}

#: Words of a k-gram; how far apart diagonals of one copy may lie; share of a template's k-grams that makes a label; what a base
#: phrase alone scores.
K, NEAR, LEAST, PHRASE_SCORE = 5, 3, 0.5, 0.5


def words_of(text: str) -> list[str]:
    return re.findall(WORD + "+", text.lower())


def template_places(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """label, t_at, grams (of the template), t_gram: a row for each k-gram. Small by construction: it comes from constants or
    from what the caller holds in memory."""
    rows = []
    for label, text in templates.items():
        w = words_of(text)
        rows += [(label, i, len(w) - K + 1, " ".join(w[i : i + K])) for i in range(len(w) - K + 1)]
    return spark.createDataFrame(rows, "label string, t_at int, grams int, t_gram string")


def let(x: Column, body) -> Column:
    """body of x, with x evaluated once."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def lowered(text: Column) -> Column:
    """Lower-case, where no other letter may become one of a to z: two signs beyond ASCII would, and stand aside."""
    for sign in "\u212a\u0130":
        text = F.replace(text, F.lit(sign), F.lit("\u0138"))
    return F.lower(text)


def measures(text: Column, templates: dict[str, str]) -> Column:
    """struct(n_words, n_base, first_word, last_word, base, hits) of a text: its words are cut once, the base phrases and the
    k-grams whose hash some template has are picked within the row, and only those are put out, as (at, gram)."""
    phrases = {label: phrase.split(" ") for phrase, label in PHRASES.items()}
    tables = [words_of(t) for t in templates.values()]
    grams = sorted({" ".join(w[i : i + K]) for w in tables for i in range(len(w) - K + 1)})
    # Tests of single words go first: they are cheap, and few places pass them.
    heads, seconds = ({g.split(" ")[k] for g in grams} for k in (0, 1))

    def at(w: Column, k: Column, n: int = 0) -> Column:
        return F.get(w, k + n if n else k)

    def stands(w: Column, k: Column, phrase: list[str]) -> Column:
        out = at(w, k) == phrase[0]
        for n, x in enumerate(phrase[1:], 1):
            out = out & (at(w, k, n) == x)
        return F.coalesce(out, F.lit(False))

    def row(w: Column) -> Column:
        n = F.size(w)
        starts = F.when(n > 0, F.filter(F.transform(w, lambda x, k: F.when(x.isin(*{p[0] for p in phrases.values()}), k)), lambda k: k.isNotNull())).otherwise(F.array().cast("array<int>"))
        places = F.filter(F.sequence(F.lit(0), n - K), lambda k: at(w, k).isin(*heads) & at(w, k, 1).isin(*seconds) & F.array_join(F.slice(w, k + 1, K), " ").isin(*grams))
        hits = F.when(n >= K, F.transform(places, lambda k: F.struct(k.alias("at"), F.array_join(F.slice(w, k + 1, K), " ").alias("gram"))))
        of = lambda s, phrase: F.filter(s, lambda k: stands(w, k, phrase))
        found = lambda s: F.struct(*(of(s, p).alias(f"p{i}") for i, p in enumerate(phrases.values())))
        return let(let(starts, found), lambda f: F.struct(
            n.cast("long").alias("n_words"),
            sum((F.size(f[f"p{i}"]) for i in range(len(phrases))), F.lit(0)).cast("long").alias("n_base"),
            F.least(*(F.array_min(f[f"p{i}"]) for i in range(len(phrases)))).cast("long").alias("first_word"),
            F.greatest(*(F.array_max(f[f"p{i}"]) for i in range(len(phrases)))).cast("long").alias("last_word"),
            F.array_compact(F.array(*(F.when(F.size(f[f"p{i}"]) > 0, F.lit(label)) for i, label in enumerate(phrases)))).alias("base"),
            F.coalesce(hits, F.expr("filter(array(named_struct('at', 0, 'gram', '')), x -> false)")).alias("hits"),
        ))

    return let(F.regexp_extract_all(lowered(F.coalesce(text, F.lit(""))), F.lit(WORD + "+"), F.lit(0)), row)


def template_spans(hits: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """hits (row, at, gram) -> row, label, first_word, last_word, votes, share: a row for each copy of a template of which at
    least `least` stands in the text. Grams are joined to the templates' places, votes are counted by diagonal, and diagonals
    of one copy are merged; a gram is its words, so every vote stands word for word."""
    # The templates are a fixed, small table.
    places = hits.join(F.broadcast(template_places(hits.sparkSession, templates)), F.col("gram") == F.col("t_gram"))
    keys = ("row", "label")
    diagonals = places.groupBy(*keys, (F.col("at") - F.col("t_at")).alias("diagonal")).agg(F.collect_set("t_at").alias("t"), F.min("at").alias("low"), F.max("at").alias("high"), F.first("grams").alias("grams"))
    by = Window.partitionBy(*keys).orderBy("diagonal")
    new = F.when(F.col("diagonal") - F.lag("diagonal").over(by) <= NEAR, 0).otherwise(1)
    copies = diagonals.withColumn("new", new).withColumn("copy", F.sum("new").over(by)).groupBy(*keys, "copy")
    voted = F.flatten(F.collect_list("t"))
    out = copies.agg(F.min("low").alias("first_word"), (F.max("high") + K - 1).alias("last_word"), F.size(voted).alias("votes"), (F.size(F.array_distinct(voted)) / F.first("grams")).alias("share"))
    return out.where(F.col("share") >= least).drop("copy")


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """docs (doc_id, text; other columns are dropped) -> doc_id, n_words, n_base, first_word, last_word (of the base phrases),
    base_labels, labels (arrays, sorted) and score: the largest share of a template found, and PHRASE_SCORE at least where a base
    phrase stands.

    Null and empty texts have no words and no labels. Repeated rows each get their row; an empty table gives an empty one. The
    texts are read once; what is kept of them, in the shared folder, is the measures and the k-grams that a template has."""
    rows = docs.select("doc_id", measures(F.col("text"), templates).alias("m")).select("doc_id", "m.*")
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "license-hits")
    hits = rows.where(F.size("hits") > 0).select("row", F.explode("hits").alias("x")).select("row", "x.*")
    found = template_spans(hits, templates, least).groupBy("row").agg(F.collect_set("label").alias("found"), F.max("share").alias("share"))
    both = rows.drop("hits").join(found, "row", "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    score = F.greatest(F.when(F.col("n_base") > 0, F.lit(PHRASE_SCORE)).otherwise(0.0), F.coalesce("share", F.lit(0.0)))
    return both.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_sort("base").alias("base_labels"), labels.alias("labels"), score.cast("double").alias("score"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(read_table(spark, sf_dir, "documents"))
    return out.withColumns({"base_labels": F.array_join("base_labels", ","), "labels": F.array_join("labels", ",")})
