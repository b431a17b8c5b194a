"""License scan: an exact set-similarity join of license templates with text blocks; DataFrame functions only.

Tokens are ordered by how often they stand in all documents.  For containment ``t`` a template needs
``ceil(t * size)`` of its tokens in a block, so one of its ``size - need + 1`` rarest must be there:
only blocks that hold such a prefix token are looked at.  The length filter drops blocks with fewer
distinct words than needed, the positional filter those whose first matching prefix tokens leave too few tokens, and
the rest is intersected exactly.

Blocks are runs of ``2 * half`` words that start every ``half`` words, so any ``half`` consecutive words,
and thus any template, lie whole in some block.  Phrases are templates that must be there whole and in order.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyspark.llm.words import with_words, words
from surveyspark.runtime import materialise, small_table

# Phrases and their labels.
PHRASES = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)
# Opening or characteristic sentences of public licenses, as their stewards publish them.
TEMPLATES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this work is licensed under the gnu lesser general public license version 3", "lgpl-3.0"),
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("released under the mit license", "mit"),
)
CONTAINMENT = 0.8


def _need(size: int, containment: float) -> int:
    return max(1, math.ceil(containment * size - 1e-9))


def token_counts(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """How often each token of the templates stands in all documents; as many numbers as tokens."""
    spark = docs.sparkSession
    known = small_table(spark, [(x,) for x in vocabulary], "token string")
    counts = (docs.select(F.explode(words(F.col("text"))).alias("token")).join(known, "token")
              .groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect())
    return {x: 0 for x in vocabulary} | {r["token"]: r["n"] for r in counts}


def license_scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and text_hash of each row.

    ``docs`` has doc_id and text; other columns are ignored.  ``labels`` and ``base_labels`` are sorted
    arrays, of each block the labels of all templates that reach the threshold, but those whose words there
    all belong to a closer one; ``score`` is the largest containment of a template in a block, 1 where a phrase stands, 0 where no
    template reaches the threshold.  A NULL or wordless text has no labels.  Rows that repeat a doc_id have
    results of their own.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    sets = [(i, label, tuple(dict.fromkeys(text.split()))) for i, (text, label) in enumerate(templates)]
    vocabulary = sorted({x for _, _, tokens in sets for x in tokens} | {x for text, _ in phrases for x in text.split()})
    counts = token_counts(docs, vocabulary)
    rank = {x: i for i, x in enumerate(sorted(vocabulary, key=lambda x: (counts[x], x)))}
    half = max([32, *(len(text.split()) for text, _ in templates)])

    prefix_rows = []
    for i, label, tokens in sets:
        ordered = sorted(tokens, key=rank.get)
        need = _need(len(ordered), containment)
        prefix_rows += [(i, label, len(ordered), need, x, place) for place, x in enumerate(ordered[:len(ordered) - need + 1])]
    rare = sorted({row[4] for row in prefix_rows})

    tokens = with_words(docs, "doc_id", F.xxhash64("text").alias("text_hash"))
    at = F.transform("w", lambda w, i: F.when(w.isin(rare), i))
    places = F.array().cast("array<struct<start:int,label:string>>")
    for text, label in phrases:
        parts = text.split()
        key = min(range(len(parts)), key=lambda j: rank[parts[j]])
        starts = F.filter(F.transform("w", lambda w, i: F.when(w == parts[key], i - key)), lambda i: i.isNotNull())
        whole = F.filter(starts, lambda s: (s >= 0) & (F.slice(F.col("w"), F.greatest(s, F.lit(0)) + 1, len(parts))
                                                        == F.array(*map(F.lit, parts))))
        places = F.concat(places, F.transform(whole, lambda s: F.struct(s.alias("start"), F.lit(label).alias("label"))))
    looked = tokens.select("doc_id", "text_hash", "w", F.size("w").cast("bigint").alias("n_words"), places.alias("places"),
                           F.filter(at, lambda i: i.isNotNull()).alias("at"))
    number = F.transform("at", lambda i: (i / half).cast("int"))
    blocks = F.array_distinct(F.concat(number, F.filter(F.transform(number, lambda b: b - 1), lambda b: b >= 0)))
    looked = materialise(looked.select(
        "doc_id", "text_hash", "n_words", "places",
        F.transform(blocks, lambda b: F.struct(b.alias("block"), F.array_distinct(
            F.slice(F.col("w"), b * half + 1, 2 * half)).alias("set"))).alias("blocks")))

    prefixes = small_table(spark, prefix_rows, "template int,label string,size int,need int,token string,place int")
    whole_sets = small_table(spark, [(i, x) for i, _, tokens in sets for x in tokens], "template int,member string")
    whole_sets = whole_sets.groupBy("template").agg(F.collect_list("member").alias("members"))
    pieces = looked.select("doc_id", "text_hash", F.explode("blocks").alias("b")).select(
        F.coalesce("doc_id", F.lit(-(1 << 63))).alias("row_id"), "text_hash", "b.block", "b.set", F.size("b.set").alias("width"))
    scored = (pieces.select("row_id", "text_hash", "block", "set", "width",
                            F.explode(F.array_intersect("set", F.array(*map(F.lit, rare)))).alias("token"))
              .join(prefixes, "token")
              .filter(F.col("width") >= F.col("need"))
              .groupBy("row_id", "text_hash", "block", "template", "label", "size", "need", "width")
              .agg(F.count_distinct("token").alias("seen"), F.max("place").alias("place"), F.first("set").alias("set"))
              .filter(F.col("seen") + F.least(F.col("size") - 1 - F.col("place"), F.col("width") - F.col("seen")) >= F.col("need"))
              .join(whole_sets, "template")
              .withColumn("matched", F.array_intersect("set", "members"))
              .filter(F.size("matched") >= F.col("need"))
              .withColumn("share", F.size("matched") / F.col("size"))
              .groupBy("row_id", "text_hash", "block")
              .agg(F.max("share").alias("best"), F.collect_list(F.struct("share", "label", "matched")).alias("hits"))
              # Of templates that match the same words of a block the closest name it: one is left out only if all its
              # words there, and so all their places, belong to a closer one.
              .select("row_id", "text_hash", "best", F.explode(F.filter("hits", lambda h: ~F.exists("hits", lambda g: (
                  (g["share"] > h["share"]) & (F.size(F.array_except(h["matched"], g["matched"])) == 0))))).alias("hit"))
              .groupBy("row_id", "text_hash").agg(F.collect_set("hit.label").alias("found"), F.max("best").alias("best"))
              .withColumnsRenamed({"row_id": "_id", "text_hash": "_hash"}))
    starts = F.transform("places", lambda p: p["start"])
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    none = F.array().cast("array<string>")
    return (looked.join(scored, (F.coalesce("doc_id", F.lit(-(1 << 63))) == F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
            .select("doc_id", "n_words", F.size("places").cast("bigint").alias("n_base"),
                    F.array_min(starts).cast("bigint").alias("first_word"), F.array_max(starts).cast("bigint").alias("last_word"),
                    base.alias("base_labels"), F.array_sort(F.array_union(base, F.coalesce("found", none))).alias("labels"),
                    F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
                    "text_hash"))
