"""The operators of this folder as queries over the driver tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyspark.llm import (
    ann, decontaminate, licenses, lm_score, mixing, ngram_join, pii, prefix_trie, quality, simhash, suffix_dedup,
    url_filter, whitening)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op9_ngram_join(spark, sf_dir):
    return ngram_join.component_ids(table(spark, sf_dir, "documents"))


@query
def op6_suffix_dedup(spark, sf_dir):
    return (suffix_dedup.deduplicated(table(spark, sf_dir, "documents"))
            .select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")))


@query
def op1_decontaminate(spark, sf_dir):
    hits = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                       F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
                       (F.col("n_hit") > 0).alias("contaminated"))


@query
def op7_license_scan(spark, sf_dir):
    found = licenses.license_scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word",
                        F.concat_ws(",", "base_labels").alias("base_labels"),
                        F.concat_ws(",", "labels").alias("labels"), "score")


@query
def op4_mix_sources(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op8_url_filter(spark, sf_dir):
    return url_filter.judged(table(spark, sf_dir, "pages"))


ORACLES["op8_url_filter"] = r"""
WITH parts AS (
    SELECT page_id, coalesce(regexp_extract(url, '^(.*?)://([^/?#]*)([^?#]*)', 2, 's'), '') AS raw_host,
           coalesce(regexp_extract(url, '^(.*?)://([^/?#]*)([^?#]*)', 3, 's'), '') AS path
    FROM pages),
named AS (
    SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM parts),
ruled AS (
    SELECT page_id, host, path,
        CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
             WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
             WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
             WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
    FROM named)
SELECT page_id, host, path, rule,
    CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
         WHEN rule IS NOT NULL THEN 'allow'
         WHEN regexp_matches(host, '(^|[.])(spam-farm|casino-win)[.]example[.](com|org|net)$') THEN 'block'
         ELSE 'allow' END AS verdict
FROM ruled
"""


@query
def op5_hash_forest(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.filter("vec_id % 100 = 0"))


@query
def op10_lm_score(spark, sf_dir):
    target = table(spark, sf_dir, "labels").filter("quality = 1")
    return lm_score.scores(table(spark, sf_dir, "documents"), target)


@query
def op2_quality_knn(spark, sf_dir):
    scored = quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score",
                         (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


@query
def op3_pii(spark, sf_dir):
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    names = F.array(*map(F.lit, pii.KINDS))

    def said(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint")

    base = F.filter("spans", lambda s: s["base"])
    counts = [count(i).alias(f"n_{kind}") for i, kind in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


@query
def op12_whitening(spark, sf_dir):
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


@query
def op13_prefix_trie(spark, sf_dir):
    return prefix_trie.trie(*prefix_trie.rebuilt_turns(table(spark, sf_dir, "conversations")))


@query
def op11_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))
