"""License scan by diagonal voting.

Every rolling word 2-gram hash of every text is joined with the positions of
the same 2-gram in the templates. A hit at word ``pos`` of template position
``tpos`` lies on diagonal ``pos - tpos``; hits are counted by (document,
template, diagonal), neighbouring diagonals (words inserted or left out) that
overlap are merged into one span, and a span is verified when it covers enough
of the template's 2-grams within a limited length.

A base phrase is a template whose every 2-gram must hit one diagonal, which is
the phrase standing there word for word; license texts need ``min_coverage``.

Scale: the template table is a constant of this module (a few hundred rows),
so broadcasting it is safe. The hashes leave Python as one array per document
and are exploded next to the broadcast join: only hits and one marker row per
document (hash 0, which carries the word count) are shuffled, once, by row.
Rows are told apart by their scan position, so repeated documents stay apart.

Edge cases: null or empty text has no words, no labels, score 0; null doc_id
stays null; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bourse.llm import textcols as T

# Base phrases and their labels.
BASE = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]
# Notice lines of public licenses.
LICENSES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
            "the following conditions are met"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
            "public license as published by the free software foundation"),
    ("lgpl", "gnu lesser general public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
K = 2
# letters and digits; every byte of a non-ASCII character counts as a letter
WORD = T.byte_table([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])
DDL = "row_id long, doc_id long, n_words long, hashes array<bigint>"
MARK = -1


def _gram_batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        data, off = T.column(batch, "text")
        row_id, doc_id = T.keep_columns(batch, ["row_id", "doc_id"])
        for i, j, d, o in T.blocks(data, off):
            low = T.LOWER[d]
            s, e = T.spans(WORD[low], o)
            doc = T.owners(o, s)
            g, at = T.gram_hash(T.span_hash(T.prefix_hash(low), s, e), doc, K)
            g = np.where(g == 0, np.uint64(1), g).view(np.int64)
            n_words = np.bincount(doc, minlength=j - i)
            n_grams = np.bincount(doc[at], minlength=j - i)
            first = np.cumsum(n_grams + 1) - (n_grams + 1)      # the marker stands before each row's hashes
            flat = np.insert(g, np.cumsum(n_grams) - n_grams, 0)
            assert not flat[first].any()
            yield pa.RecordBatch.from_arrays(
                [row_id.slice(i, j - i), doc_id.slice(i, j - i), pa.array(n_words, pa.int64()),
                 T.ragged(flat, n_grams + 1, pa.int64())], names=["row_id", "doc_id", "n_words", "hashes"])


def template_table(base=BASE, licenses=LICENSES) -> list[tuple]:
    """(hash, template, label, is_base, position, number of 2-grams) rows; the marker has hash 0."""
    rows = [(0, MARK, "", False, 0, 0)]
    for t, (label, text) in enumerate([*base, *licenses]):
        h = T.word_hash(text.split())
        g = T.gram_hash(h, np.zeros(len(h), np.int64), K)[0].view(np.int64).tolist()
        rows += [(x, t, label, t < len(base), p, len(g)) for p, x in enumerate(g)]
    return rows


def license_spans(docs: DataFrame, *, min_coverage: float = 0.8, max_shift: int = 2, base=BASE,
                  licenses=LICENSES) -> DataFrame:
    """Verified spans, and one row with template -1 for every document row.

    Columns row_id, doc_id, n_words, template, label, is_base, start, stop
    (words from 0, stop excluded) and coverage (0 to 1).
    """
    spark = docs.sparkSession
    table = spark.createDataFrame(template_table(base, licenses),
                                  "hash long, template int, label string, is_base boolean, tpos int, n_grams int")
    grams = (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
             .withColumn("row_id", F.monotonically_increasing_id()).mapInArrow(_gram_batches, DDL))
    hits = (grams.select("row_id", "doc_id", "n_words", F.posexplode("hashes").alias("pos", "hash"))
            .join(F.broadcast(table), "hash")
            .select("row_id", "doc_id", "n_words", "template", "label", "is_base", "n_grams", "tpos",
                    (F.col("pos") - 1).alias("pos"), (F.col("pos") - 1 - F.col("tpos")).alias("diagonal")))
    part = ["row_id", "doc_id", "n_words", "template", "label", "is_base", "n_grams"]
    votes = (hits.repartition("row_id").groupBy(*part, "diagonal")
             .agg(F.count("*").alias("votes"), F.min("pos").alias("lo"), F.max("pos").alias("hi"),
                  F.collect_set("tpos").alias("covered")))
    # a diagonal joins the one before when they are near and their spans touch; base phrases never merge
    w = Window.partitionBy("row_id", "template").orderBy("diagonal")
    near = ((F.col("diagonal") - F.lag("diagonal").over(w) <= max_shift)
            & (F.col("lo") <= F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1)) + F.col("n_grams"))
            & ~F.col("is_base") & (F.col("template") != MARK))
    runs = (votes.withColumn("new", F.when(F.coalesce(near, F.lit(False)), 0).otherwise(1))
            .withColumn("run", F.sum("new").over(w)))
    merged = (runs.groupBy(*part, "run")
              .agg(F.min("lo").alias("start"), (F.max("hi") + K).alias("stop"),
                   F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).alias("n_covered")))
    coverage = F.col("n_covered") / F.greatest(F.col("n_grams"), F.lit(1))
    fits = F.col("stop") - F.col("start") <= F.ceil((F.col("n_grams") + K - 1) * 1.5)
    ok = F.when(F.col("is_base"), F.col("n_covered") == F.col("n_grams")).otherwise((coverage >= min_coverage) & fits)
    return (merged.where((F.col("template") == MARK) | ok)
            .select("row_id", "doc_id", "n_words", "template", "label", "is_base", "start", "stop",
                    coverage.alias("coverage")))


def license_scan(docs: DataFrame, **options) -> DataFrame:
    """One row per document row: base counts, labels and a score."""
    spans = license_spans(docs, **options)
    base, real = F.col("is_base"), F.col("template") != MARK

    def joined(c):
        return F.array_join(F.array_sort(F.collect_set(c)), ",")

    return (spans.groupBy("row_id", "doc_id", "n_words")
            .agg(F.sum(F.when(base, 1).otherwise(0)).alias("n_base"),
                 F.min(F.when(base, F.col("start").cast("long"))).alias("first_word"),
                 F.max(F.when(base, F.col("start").cast("long"))).alias("last_word"),
                 joined(F.when(base, F.col("label"))).alias("base_labels"),
                 joined(F.when(real, F.col("label"))).alias("labels"),
                 F.max(F.when(real, F.least(F.col("coverage"), F.lit(1.0))).otherwise(F.lit(0.0))).alias("score"))
            .select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"))
