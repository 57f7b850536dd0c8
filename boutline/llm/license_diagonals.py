"""License scan by diagonal voting, in DataFrame operations only.

Every run of words of a document whose hash is that of a run of a template votes for the difference of the two positions, the
diagonal. A place of a template is a diagonal with many votes; insertions and deletions move it to neighbouring ones, whose votes
are added up around each peak. The span that a peak marks is then compared with the template, letter by letter. Short phrases need
all of their votes on one diagonal and word-for-word equality.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from boutline.llm.stored import stored


class Template(NamedTuple):
    label: str
    text: str


# Phrases that must be found wherever they stand, word for word, and their labels.
PHRASES = [
    Template("gpl", "gnu general public license"),
    Template("apache", "apache license"),
    Template("cc-by", "cc by"),
    Template("mit", "mit license"),
]
# Public license notices.
NOTICES = [
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
                    "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
                    "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
                    "provided that the above copyright notice and this permission notice appear in all copies"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
                    "conditions are met"),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
                           "License. You may obtain a copy of the License at"),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
                    "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    Template("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
                     "License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"),
    Template("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public "
                     "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
                        "distributed with this file, You can obtain one at"),
    Template("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
                          "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose"),
    Template("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    Template("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    Template("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    Template("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
                      "accompanying documentation covered by this license"),
]
#: Words of a run: of phrases, of notices.
PHRASE_RUN, NOTICE_RUN = 2, 3
#: Diagonals around a peak whose votes count for it.
DRIFT = 4
#: Share of a notice's runs that must vote before its span is compared.
VOTES = 0.4
#: Likeness (1 - edit distance / longer length, in characters) of an accepted span.
LIKENESS = 0.9

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_words(text):
    """The words of a text, A-Z in lower case; a null text has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def runs(words, size: int):
    """(at, h) of every run of ``size`` words."""
    found = F.transform(words, lambda w, i: F.struct(i.alias("at"), F.xxhash64(F.lit(size), w, *[F.get(words, i + k) for k in range(1, size)]).alias("h")))
    return F.filter(found, lambda r: r["at"] <= F.size(words) - size)


def template_runs(spark: SparkSession, phrases: list[Template], notices: list[Template]) -> DataFrame:
    """(template, label, exact, n, votes, text, pos, h) of every run of every template of ``n`` words and ``votes`` runs."""
    rows = [(i, t.label, exact, t.text) for i, (t, exact) in enumerate([(t, True) for t in phrases] + [(t, False) for t in notices])]
    given = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(exact).alias("exact"), F.lit(text).alias("words"))
                      for i, label, exact, text in rows])
    words = spark.range(1).select(F.inline(given)).withColumn("words", split_words(F.col("words")))
    own = words.withColumn("runs", F.when(F.col("exact"), runs(F.col("words"), PHRASE_RUN)).otherwise(runs(F.col("words"), NOTICE_RUN)))
    return own.select("template", "label", "exact", F.size("words").cast("long").alias("n"), F.size("runs").alias("needed"),
                      F.array_join("words", " ").alias("text"), F.inline("runs")).withColumnRenamed("at", "pos")


def _likeness(span, text):
    """1 - edit distance / longer length; a character beyond ASCII counts as one. Spans of over twice the length are not alike."""
    span = F.regexp_replace(span, r"[^\x00-\x7F]", "?")
    longer = F.greatest(F.length(span), F.length(text), F.lit(1)).cast("double")
    return F.when(F.length(span) <= 2 * F.length(text), 1.0 - F.levenshtein(span, text) / longer).otherwise(0.0)


def _marked(docs: DataFrame, templates: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(row, doc_id, n_words, runs, words), written; only a document with a run of a template keeps its words."""
    # Hashes of the templates' own runs: some hundred numbers, whatever the documents are.
    hashes = [r.h for r in templates.select("h").distinct().collect()]
    words = docs.select(F.col(doc_id).alias("doc_id"), split_words(F.col(text)).alias("words"))
    own = [F.filter(runs(F.col("words"), size), lambda r: r["h"].isin(hashes)) for size in (PHRASE_RUN, NOTICE_RUN)]
    rows = words.select("doc_id", "words", F.concat(*own).alias("runs"))
    return stored(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.size("words").cast("long").alias("n_words"), "runs",
                              F.when(F.size("runs") > 0, F.col("words")).alias("words")), "license-runs")


def _places(marked: DataFrame, templates: DataFrame) -> DataFrame:
    """(row, template, exact, n, low, high, diagonal): the diagonals that hold a template, and how far their neighbours reach."""
    met = marked.where(F.size("runs") > 0).select("row", F.inline("runs")).join(F.broadcast(templates.drop("label", "text")), "h")
    votes = met.groupBy("row", "template", "exact", "n", "needed", (F.col("at") - F.col("pos")).cast("long").alias("diagonal")).agg(F.count("*").alias("votes"))
    whole = votes.where(F.col("exact") & (F.col("votes") == F.col("needed")))
    phrases = whole.withColumns({"low": F.col("diagonal"), "high": F.col("diagonal")})
    near = Window.partitionBy("row", "template").orderBy("diagonal").rangeBetween(-DRIFT, DRIFT)
    most = F.max(F.struct("votes", (-F.col("diagonal")).alias("first"))).over(near)
    merged = votes.where(~F.col("exact")).withColumns({"low": F.min("diagonal").over(near), "high": F.max("diagonal").over(near),
                                                       "all": F.sum("votes").over(near), "most": most})
    peaks = merged.where((F.col("all") >= VOTES * F.col("needed")) & (F.col("most.first") == -F.col("diagonal")))
    own = ["row", "template", "exact", "n", "low", "high", "diagonal"]
    return phrases.select(own).union(peaks.select(own))


def _cut(marked: DataFrame, places: DataFrame) -> DataFrame:
    """The places with ``start`` and ``stop`` in words, ``wide`` (all neighbouring diagonals) and ``narrow`` (the peak's) text."""
    # No more places in a row than a document has words, and its words come once.
    grouped = places.groupBy("row").agg(F.collect_list(F.struct("template", "exact", "n", "low", "high", "diagonal")).alias("places"))
    zero = F.lit(0).cast("long")

    def cut(p, low, high):
        start, stop = F.greatest(low, zero), F.least(high + p["n"], F.col("n_words"))
        return start, stop, F.array_join(F.slice(F.col("words"), (start + 1).cast("int"), (stop - start).cast("int")), " ")

    def spans(p):
        start, stop, wide = cut(p, p["low"], p["high"])
        return F.struct(p["template"].alias("template"), start.alias("start"), stop.alias("stop"), wide.alias("wide"),
                        cut(p, p["diagonal"], p["diagonal"])[2].alias("narrow"))

    return marked.join(grouped, "row").select("row", F.inline(F.transform("places", spans)))


def license_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", phrases: list[Template] = PHRASES,
                  notices: list[Template] = NOTICES) -> tuple[DataFrame, DataFrame]:
    """((row, doc_id, n_words) of every document, (row, label, exact, start, stop, likeness) of every accepted place).

    Places are counted in words. Phrases are reported wherever they stand; of notices whose spans overlap only the likest is, the
    first template of those alike.
    """
    templates = template_runs(docs.sparkSession, phrases, notices)
    marked = _marked(docs, templates, doc_id, text)
    texts = templates.select("template", "label", "exact", "text").distinct()
    spans = _cut(marked, _places(marked, templates)).join(F.broadcast(texts), "template")
    alike = F.greatest(_likeness(F.col("wide"), F.col("text")), _likeness(F.col("narrow"), F.col("text")))
    checked = spans.withColumn("likeness", F.when(F.col("exact"), (F.col("narrow") == F.col("text")).cast("double")).otherwise(alike))
    # Few and small rows: written, so that comparing spans and choosing among them are stages of their own.
    good = stored(checked.where(F.col("likeness") >= F.when(F.col("exact"), 1.0).otherwise(LIKENESS))
                  .select("row", "template", "label", "exact", "start", "stop", "likeness"), "license-spans")
    order = Window.partitionBy("row", "exact").orderBy("start", "template")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = good.withColumn("new", (F.col("exact") | reach.isNull() | (F.col("start") >= reach)).cast("int"))
    islands = apart.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.row_number().over(Window.partitionBy("row", "exact", "island").orderBy(F.desc("likeness"), "template"))
    return (marked.select("row", "doc_id", "n_words"),
            islands.withColumn("best", best).where("best = 1").select("row", "label", "exact", "start", "stop", "likeness"))


def licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", phrases: list[Template] = PHRASES,
             notices: list[Template] = NOTICES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans), one row per row of ``docs``.

    ``n_base`` counts the places of phrases, ``first_word`` and ``last_word`` are the first and last start (null without one), the
    labels are distinct, sorted and joined by commas, ``labels`` with those of the notices. ``score`` is the best likeness of an
    accepted place, 0 without one; ``spans`` holds them all. Null and empty texts have no words and no labels; null ids and repeated
    rows are rows like any other; other columns are ignored; an empty table gives an empty result.
    """
    rows, spans = license_spans(docs, doc_id, text, phrases, notices)
    base = F.col("exact")
    by_row = spans.groupBy("row").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"), F.max(F.when(base, F.col("start"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("likeness").alias("score"),
        F.array_sort(F.collect_list(F.struct("start", "stop", "label", "likeness"))).alias("spans"))
    none = {"n_base": 0, "base_labels": "", "labels": "", "score": 0.0}
    return rows.join(by_row, "row", "left").fillna(none).drop("row").withColumnRenamed("doc_id", doc_id)
