"""License scan by diagonal voting.

Every run of k words of every text is joined to the places where templates have it.  A hit at
word p of a text and place q of a template votes for the diagonal p - q; a copy of the
template is a run of votes on one diagonal, or on neighbouring ones where words were put in
or left out.  Votes are added up by diagonal, neighbouring diagonals become one span, and a
span counts if it holds enough of its template without being much longer.

Phrases of the base list are looked up in place; they need no votes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.llm.rows import ROW, ascii_lower, text_of, with_row_id

#: A word: letters and digits of ASCII, lower-cased, and everything beyond ASCII.
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

#: The phrases of the base list and their labels.
PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)

#: Notices as their licences word them, and their labels.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons "
        "to whom the Software is furnished to do so, subject to the following conditions",
    ),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    (
        "apache",
        "you may not use this file except in compliance with the License. You may obtain a copy of "
        "the License at",
    ),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of "
        "the GNU General Public License as published by the Free Software Foundation",
    ),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("all-rights-reserved", "All rights reserved. No part of this publication may be reproduced"),
)


@dataclass(frozen=True)
class Voting:
    """``k`` words vote; diagonals up to ``apart`` words from the next are one span.  A span
    counts with ``coverage`` of its template's runs, within ``longer`` times its length."""

    k: int = 3
    apart: int = 3
    coverage: float = 0.8
    longer: float = 1.5


def _words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD), 0)


def template_runs(spark: SparkSession, templates, k: int) -> DataFrame:
    """``(h, run, template, label, place, n_runs, n_words)``: a row per run of each template.

    The size is that of the template list, which is a parameter and no table.
    """
    rows = []
    for number, (label, text) in enumerate(templates):
        words = re.findall(WORD, text.lower())
        runs = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
        if not runs:
            raise ValueError(f"a template needs {k} words: {text!r}")
        rows += [(run, number, label, i, len(runs), len(words)) for i, run in enumerate(runs)]
    table = spark.createDataFrame(
        rows, "run string, template int, label string, place int, n_runs int, n_words int"
    )
    return table.withColumn("h", F.xxhash64("run"))


def spans(docs: DataFrame, templates=TEMPLATES, voting: Voting = Voting()) -> DataFrame:
    """``(_row, template, label, first_word, last_word, coverage, verified)``, a row per span
    that got votes; words count from 0 and the last one is part of the span."""
    k = voting.k
    words = with_row_id(docs.select(text_of(docs).alias("_t"))).select(ROW, _words(F.col("_t")).alias("w"))
    every = F.transform(
        F.sequence(F.lit(0), F.size("w") - k),
        lambda i: F.concat_ws(" ", *[F.get("w", i + j) for j in range(k)]),
    )
    # No filter: pushed down, it would look for the words a second time.
    runs = words.select(ROW, F.posexplode(F.when(F.size("w") >= k, every)).alias("pos", "run"))
    known = template_runs(docs.sparkSession, templates, k)
    hits = runs.withColumn("h", F.xxhash64("run")).join(F.broadcast(known), ["h", "run"])
    votes = hits.groupBy(ROW, "template", "label", "n_runs", "n_words", (F.col("pos") - F.col("place")).alias("diagonal")).agg(
        F.min("pos").alias("first"), F.max("pos").alias("last"), F.collect_set("place").alias("places")
    )
    along = Window.partitionBy(ROW, "template").orderBy("diagonal")
    far = F.col("diagonal") - F.lag("diagonal").over(along) > voting.apart
    merged = (
        votes.withColumn("new", F.coalesce(far, F.lit(False)).cast("int"))
        .withColumn("span", F.sum("new").over(along))
        .groupBy(ROW, "template", "label", "n_runs", "n_words", "span")
        .agg(
            F.min("first").alias("first_word"),
            (F.max("last") + (k - 1)).alias("last_word"),
            F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("found"),
        )
    )
    length = F.col("last_word") - F.col("first_word") + 1
    coverage = F.col("found") / F.col("n_runs")
    return merged.select(
        ROW,
        "template",
        "label",
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        coverage.alias("coverage"),
        ((coverage >= voting.coverage) & (length <= F.col("n_words") * voting.longer)).alias("verified"),
    )


def scan(
    docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, voting: Voting = Voting()
) -> DataFrame:
    """``(_row, doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)``.

    One row per document.  Null texts have no words; without a base phrase ``first_word`` and
    ``last_word`` are null, without a label the lists are empty.  ``score`` is the largest
    coverage of any template, 0 without votes.
    """
    words = with_row_id(docs.select("doc_id", text_of(docs).alias("_t"))).select(
        ROW, "doc_id", _words(F.col("_t")).alias("w")
    )

    def starts(phrase: str) -> Column:
        parts = phrase.split(" ")
        at = F.filter(
            F.sequence(F.lit(0), F.size("w") - len(parts)),
            lambda i: reduce(lambda a, b: a & b, [F.get("w", i + j) == p for j, p in enumerate(parts)]),
        )
        # The phrase's last word is looked for first: few texts have it.
        there = (F.size("w") >= len(parts)) & F.array_contains("w", parts[-1])
        return F.when(there, at).otherwise(F.expr("array()").cast("array<int>"))

    places = words.select(
        ROW,
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        *[starts(p).alias(f"_p{i}") for i, (p, _) in enumerate(phrases)],
    )
    own = F.array_compact(
        F.array(*[F.when(F.size(f"_p{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(phrases)])
    )
    base = places.select(
        ROW, "doc_id", "n_words", F.concat(*[f"_p{i}" for i in range(len(phrases))]).alias("at"), own.alias("own")
    )
    voted = (
        spans(docs, templates, voting)
        .groupBy(ROW)
        .agg(F.collect_set(F.when(F.col("verified"), F.col("label"))).alias("more"), F.max("coverage").alias("score"))
    )
    none = F.expr("array()").cast("array<string>")

    def listed(labels: Column) -> Column:
        return F.array_join(F.sort_array(F.array_distinct(labels)), ",")

    return base.join(voted, ROW, "left").select(
        ROW,
        "doc_id",
        "n_words",
        F.size("at").cast("long").alias("n_base"),
        F.array_min("at").cast("long").alias("first_word"),
        F.array_max("at").cast("long").alias("last_word"),
        listed(F.col("own")).alias("base_labels"),
        listed(F.concat("own", F.coalesce("more", none))).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
