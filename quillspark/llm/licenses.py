"""License scans by diagonal voting.

Rolling hashes of all word k-grams meet the templates' k-grams in a Spark join; a hit at word p of template
position t votes for diagonal p - t.  A base phrase stands where a diagonal has all its votes.  For the
longer templates neighbouring diagonals are merged, which bridges words put in or left out, and a span is
accepted if enough of the template's k-grams lie on it in order of magnitude of its length.

A null text counts as empty: no words, no labels, score 0, first and last word null.  Empty tables give no
rows; repeated rows give repeated rows.  The columns named by `keep` are kept, unless they have the name of
a result, which then stands in their place; other columns are dropped.  Texts are scanned whole, at any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .shared import materialize, ship
from .text import LOWER, MARKS, U64, Lookup, hash_of, hashes, mix, signed, slices, tokens

# Phrase and label of the base scan.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Opening or naming words of public licenses, and the label that a span of them gets.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2"),
    ("lgpl", "gnu lesser general public license"),
    ("mpl-2.0", "subject to the terms of the mozilla public license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa-4.0", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "cc0 1 0 universal public domain dedication"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
K = 3
#: Diagonals this near are one span.
SLACK = 2
#: Least share of a template's k-grams on a span.
COVER = 0.87
_FACTORS = [U64(0x9DDFEA08EB382D69), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9)]


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words, from the words' hashes."""
    n = max(0, len(words) - k + 1)
    total = np.full(n, k, dtype=np.uint64)
    for i in range(k):
        total += words[i : i + n] * _FACTORS[i]
    return mix(total)


def template_grams() -> list[tuple[int, int, int, int, str, bool]]:
    """(gram, template, position, number of grams, label, is base) of every template k-gram."""
    rows = []
    both = [(label, phrase, True) for phrase, label in BASE.items()] + [(label, phrase, False) for label, phrase in TEMPLATES]
    for number, (label, phrase, base) in enumerate(both):
        words = np.array([hash_of(w) for w in phrase.split()], dtype=np.uint64)
        grams = signed(gram_hashes(words, 2 if base else K)).tolist()
        rows += [(g, number, i, len(grams), label, base) for i, g in enumerate(grams)]
    return rows


def _grams(docs: DataFrame, text: str) -> DataFrame:
    """Add n_words and grams: array<struct<pos, gram>> of the k-grams that some template has."""
    rows = template_grams()
    known = np.unique(np.array([r[0] for r in rows], dtype=np.int64).view(np.uint64))
    kept = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Lookup(known)  # the join's own filter, applied before rows leave Python
        kind = pa.list_(pa.struct([("pos", pa.int64()), ("gram", pa.int64())]))
        for batch in batches:
            counts, sizes, where, what = [], [], [], []
            for _, _, data, offsets in slices(batch.column(len(kept))):
                low = LOWER[data]
                starts, ends, first = tokens(low, offsets, MARKS)
                words = hashes(low, starts, ends)
                owner = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
                at, grams = [], []
                for k in (2, K):
                    g = gram_hashes(words, k)
                    hit = np.flatnonzero(table.get(g) >= 0)
                    hit = hit[owner[hit] == owner[hit + k - 1]]  # within one text
                    at.append(hit)
                    grams.append(g[hit])
                at, grams = np.concatenate(at), np.concatenate(grams)
                order = np.argsort(owner[at], kind="stable")
                at, grams = at[order], grams[order]
                counts.append(np.diff(first))
                sizes.append(np.bincount(owner[at], minlength=len(offsets) - 1))
                where.append(at - first[owner[at]])
                what.append(grams)
            if not counts:
                continue
            offs = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
            items = pa.StructArray.from_arrays([pa.array(np.concatenate(where), pa.int64()), pa.array(signed(np.concatenate(what)), pa.int64())], ["pos", "gram"])
            yield pa.record_batch([*(batch.column(i) for i in range(len(kept))), pa.array(np.concatenate(counts), pa.int64()), pa.ListArray.from_arrays(pa.array(offs), items).cast(kind)], names=[*kept, "__n", "__grams"])

    schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string("__n long, __grams array<struct<pos:long,gram:long>>").fields])
    return docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text}`").cast("string").alias("__text")).mapInArrow(run, schema)


OUT = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `keep` columns and OUT: words, base places with their first and last start, labels, score from 0 to 1."""
    spark = docs.sparkSession
    ship(spark)
    keep = tuple(c for c in keep if c.lower() not in OUT)
    wide = docs.select(*(F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(keep)), F.col(f"`{text}`").alias("__t"))
    rows = materialize(_grams(wide, "__t").drop("__t").withColumn("__row", F.monotonically_increasing_id()))
    # A fixed list of under 200 rows.
    templates = F.broadcast(spark.createDataFrame(template_grams(), "gram long, template int, tpos int, grams int, label string, base boolean"))
    hits = rows.where(F.size("__grams") > 0).select("__row", F.inline("__grams")).join(templates, "gram")
    votes = hits.groupBy("__row", "template", "label", "base", "grams", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(
        F.collect_set("tpos").alias("tposes"), F.min("pos").alias("low"), F.max("pos").alias("high")
    )
    base = votes.where(F.col("base") & (F.size("tposes") == F.col("grams"))).groupBy("__row").agg(
        F.count(F.lit(1)).alias("n_base"), F.min("diagonal").alias("first_word"), F.max("diagonal").alias("last_word"), F.collect_set("label").alias("base_set")
    )
    inside = Window.partitionBy("__row", "template").orderBy("diagonal")
    jump = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(inside) > SLACK).cast("int"), F.lit(1))
    merged = votes.where(~F.col("base")).withColumn("jump", jump).withColumn("span", F.sum("jump").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    spans = merged.groupBy("__row", "template", "label", "grams", "span").agg(F.array_distinct(F.flatten(F.collect_list("tposes"))).alias("covered"), F.min("low").alias("low"), F.max("high").alias("high"))
    cover = F.size("covered") / F.col("grams")
    good = spans.where((cover >= COVER) & (F.col("high") - F.col("low") <= 2 * (F.col("grams") + K)))
    more = good.groupBy("__row").agg(F.collect_set("label").alias("more_set"), F.max(cover).alias("cover"))
    none = F.array().cast("array<string>")
    joined = rows.drop("__grams").join(base, "__row", "left").join(more, "__row", "left")
    both = F.array_sort(F.array_union(F.coalesce("base_set", none), F.coalesce("more_set", none)))
    return joined.select(
        *(F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)),
        F.col("__n").alias("n_words"),
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.coalesce("base_set", none)), ",").alias("base_labels"),
        F.array_join(both, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("cover", F.lit(0.0))).alias("score"),
    )
