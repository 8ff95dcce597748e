"""License scans by diagonal voting.

Every k words in a row of a text are hashed, and all hashes are joined in Spark to the
positions of the templates' own. A hit of text position p and template position t votes for
the diagonal p - t: where a template stands as a whole, all its hits share one. Votes are
summed by diagonal, and neighbouring diagonals (a few words put in or left out) are merged.
A merged span is verified where its diagonals lie closest: those within the words that the
template may gain or lose in all must cover enough of its different positions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from ._words import shingle_hashes, word_hashes

SHORT, LONG = 2, 3  # words in a hash, for phrases and for other templates
GAP = 3  # words by which diagonals may differ to be merged
EDITED = 0.2  # of a template's words, or GAP if that is more: how far apart a span's diagonals may lie
COVERED = 0.8  # of a template's positions


@dataclass(frozen=True)
class Template:
    """A phrase stands word by word on one diagonal; other templates may be altered."""

    label: str
    text: str
    phrase: bool = False


PHRASES = (
    Template("cc-by", "cc by", True),
    Template("gpl", "general public license", True),
    Template("reserved", "all rights reserved", True),
)
#: Fixed wordings of notices.
NOTICES = (
    Template("mit", "released under the MIT License"),
    Template("mit", "licensed under the MIT License"),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files, to deal in the Software without restriction",
    ),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, "
        "are permitted provided that the following conditions are met",
    ),
    Template("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    Template(
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of "
        "the GNU General Public License as published by the Free Software Foundation",
    ),
    Template("cc-by-sa", "Creative Commons Attribution-ShareAlike"),
    Template("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc0", "dedicated to the public domain under CC0"),
    Template("mpl-2.0", "subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("proprietary", "may not be reproduced or distributed without the prior written permission"),
)
_HIT = "hash long, template int, label string, phrase boolean, reach int, keys int, at int"


def reach(t: Template, words: int) -> int:
    """How far apart the diagonals of a span of the template may lie."""
    return 0 if t.phrase else max(GAP, int(EDITED * words))


def _template_rows(templates: tuple[Template, ...]) -> list[tuple]:
    rows = []
    for i, t in enumerate(templates):
        (_, _, words), k = next(word_hashes(pa.array([t.text]))), SHORT if t.phrase else LONG
        keys = shingle_hashes(words, k).view(np.int64).tolist()
        if not keys:
            raise ValueError(f"a template needs {k} words: {t.text!r}")
        rows += [(h, i, t.label, t.phrase, reach(t, len(words)), len(keys), p) for p, h in enumerate(keys)]
    return rows


def _hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, same, n_words and hashes: 0 for the text itself, then those of 2 words, then of 3."""
    for batch in batches:
        ids, texts, same = batch.columns
        for first, counts, words in word_hashes(texts):
            parts, sizes, at = [], [], 0
            for n in counts.tolist():
                own = words[at : at + n]
                at += n
                row = [np.zeros(1, np.uint64), shingle_hashes(own, SHORT), shingle_hashes(own, LONG)]
                parts += row
                sizes.append(sum(map(len, row)))
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            flat = np.concatenate(parts).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(first, len(counts)),
                    same.slice(first, len(counts)),
                    pa.array(counts, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                ],
                names=["doc_id", "same", "n_words", "hashes"],
            )


def scan_licenses(
    docs: DataFrame,
    templates: tuple[Template, ...] = PHRASES + NOTICES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_words and spans of each row of docs.

    spans: array of (label, phrase, start, end, covered), in words from 0, end exclusive,
    sorted by start; covered is the part of the template's positions that was met. Phrases
    count where all their words stand in a row. Null texts have no words and no spans; null
    ids and repeated rows stay rows of their own. An empty table gives none.

    The templates' table has a row for each of their words and is broadcast.
    """
    spark = docs.sparkSession
    rows = _template_rows(templates)
    # The row of a text's own hash 0 keeps texts without hits, as template -1.
    rows.append((0, -1, None, False, 0, 0, 0))
    keys = F.broadcast(spark.createDataFrame(rows, _HIT))
    # Rows of one id and text go through as one, counted; a hash of the text tells others of its id apart.
    text = F.col(text_col)
    texts = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("same"))
    id_type = texts.schema["doc_id"].dataType
    kinds = StructType().add("doc_id", id_type).add("same", LongType()).add("n_words", LongType())
    hashed = texts.mapInArrow(_hash_batches, kinds.add("hashes", ArrayType(LongType())))
    text = ["doc_id", "same", "n_words"]
    found = ["template", "label", "phrase", "reach", "keys"]
    hits = hashed.select(*text, F.posexplode("hashes").alias("p", "hash")).join(keys, "hash")
    pairs = F.greatest(F.col("n_words") - SHORT + 1, F.lit(0))
    place = F.when(F.col("phrase"), F.col("p") - 1).otherwise(F.col("p") - 1 - pairs)
    # Keys of two lengths never meet: the row of hashes tells which a position belongs to.
    right = (F.col("template") < 0) | (F.col("phrase") == (F.col("p") <= pairs))
    votes = (
        hits.where(right)
        .withColumn("diagonal", (place - F.col("at")).cast("long"))
        .groupBy(*text, *found, "diagonal")
        .agg(F.collect_set("at").alias("met"), F.count("*").alias("n"))
    )
    by_diagonal = Window.partitionBy(*text, "template").orderBy("diagonal")
    beside = F.col("diagonal") - F.lag("diagonal").over(by_diagonal) <= GAP
    ahead = by_diagonal.rangeBetween(0, max(r[4] for r in rows))
    near = F.filter("ahead", lambda v: v["diagonal"] <= F.col("diagonal") + F.col("reach"))
    spans = (
        votes.withColumn("fresh", (~F.coalesce(beside & ~F.col("phrase"), F.lit(False))).cast("int"))
        .withColumn("span", F.sum("fresh").over(by_diagonal))
        .withColumn("ahead", F.collect_list(F.struct("diagonal", "met")).over(ahead))
        .withColumn("near", near)
        .withColumn("positions", F.size(F.array_distinct(F.flatten(F.transform("near", lambda v: v["met"])))))
    )
    first = F.array_min(F.transform("near", lambda v: v["diagonal"] + F.array_min(v["met"])))
    last = F.array_max(F.transform("near", lambda v: v["diagonal"] + F.array_max(v["met"])))
    best = F.max_by(
        F.struct("positions", first.alias("first"), last.alias("last")), F.struct("positions", -F.col("diagonal"))
    )
    merged = spans.groupBy(*text, *found, "span").agg(best.alias("best"), F.max("n").alias("n"))
    k = F.when(F.col("phrase"), F.lit(SHORT)).otherwise(F.lit(LONG))
    covered = F.col("best.positions") / F.col("keys")
    least = F.when(F.col("phrase"), F.lit(1.0)).otherwise(F.lit(COVERED))
    span = F.struct(
        F.col("best.first").alias("start"),
        (F.col("best.last") + k).alias("end"),
        "label",
        "phrase",
        covered.alias("covered"),
    )
    verified = F.when((F.col("template") >= 0) & (covered >= least), span)
    copies = F.max(F.when(F.col("template") < 0, F.col("n")))
    whole = merged.groupBy(*text).agg(F.array_sort(F.collect_list(verified)).alias("spans"), copies.alias("copies"))
    each = whole.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.select("doc_id", "n_words", "spans")
