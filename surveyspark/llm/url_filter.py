"""URL filter: a blocked Bloom filter passes possible hits to an exact hash join.

Listed rules are pairs of a host and a path.  A url asks for every pair of a parent domain of its host
and a beginning of its path as long as some rule's path.  The filter is a table of blocks of 512 bits; a
key falls in one block and sets eight bits of it.  Most keys fail there; the others join the list exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyspark.llm.words import lower_ascii
from surveyspark.runtime import small_table

# Host, path and what the rule says.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
# Hosts with all their subdomains that the list blocks beyond the rules; they apply where no rule does.
LISTED = (("spam-farm.example.com", ""), ("spam-farm.example.org", ""), ("spam-farm.example.net", ""),
          ("casino-win.example.com", ""), ("casino-win.example.org", ""), ("casino-win.example.net", ""))
WORDS = 8
KEYS_PER_BLOCK = 32


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _parents(host: Column) -> Column:
    """The host and every domain above it."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def bloom_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, words): the blocks of the filter that are not empty, for the hashes in ``keys``.key."""
    bits = keys.select(*_place(F.col("key"), blocks))
    return bits.groupBy("block").agg(F.array(*[
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bits")[w])) for w in range(WORDS)]).alias("words"))


def _place(key: Column, blocks: int) -> list[Column]:
    """A key's block, and one bit in each of its words."""
    again = F.xxhash64(key)
    return [F.pmod(key, F.lit(blocks)).cast("bigint").alias("block"),
            F.array(*[F.shiftrightunsigned(again, 6 * w).bitwiseAND(F.lit(63)).cast("int") for w in range(WORDS)]).alias("bits")]


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES,
           listed: Sequence[tuple[str, str]] | DataFrame = LISTED) -> DataFrame:
    """page_id, host, path, rule (or NULL) and verdict of each row of ``pages`` (page_id, url).

    The longest rule wins; without one, a url that a listed host and path fit is blocked, any other is
    allowed.  A NULL url or one without ``://`` has an empty host and path and is allowed.  Repeated rows
    stay rows of their own.  ``listed`` may be a table (host, path) of any size.
    """
    spark = pages.sparkSession
    own = small_table(spark, [(h, p, v, True) for h, p, v in rules], "host string,path string,says string,is_rule boolean")
    more = listed if isinstance(listed, DataFrame) else small_table(spark, list(listed), "host string,path string")
    entries = own.unionByName(more.select("host", "path", F.lit("block").alias("says"), F.lit(False).alias("is_rule"))).distinct()
    lengths = [r[0] for r in entries.select(F.length("path")).distinct().collect()]
    blocks = max(1, -(-entries.count() // KEYS_PER_BLOCK))
    entries = entries.withColumn("key", F.xxhash64("host", "path"))
    table = bloom_filter(entries, blocks).withColumnRenamed("block", "_block")

    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    # Equal urls ask once, however often they stand in the table.
    pairs = urls.select("host", "path").distinct()
    starts = F.array_distinct(F.array(*[F.when(F.length("path") >= n, F.left("path", F.lit(n))) for n in sorted(lengths)]))
    asked = (pairs.filter("host <> ''").select("host", "path", F.explode(_parents(F.col("host"))).alias("parent"))
             .select("host", "path", "parent", F.explode(F.filter(starts, lambda x: x.isNotNull())).alias("begin"))
             .withColumn("key", F.xxhash64("parent", "begin")))
    asked = asked.select("*", *_place(F.col("key"), blocks))
    present = F.lit(True)
    for w in range(WORDS):
        present = present & F.getbit(F.col("words")[w], F.col("bits")[w]).cast("boolean")
    possible = (asked.join(table, F.col("block") == F.col("_block")).filter(present)
                .select("host", "path", "parent", "begin"))
    exact = (possible.join(entries.select(F.col("host").alias("parent"), F.col("path").alias("begin"), "says", "is_rule"),
                           ["parent", "begin"])
             .groupBy("host", "path").agg(
                 F.max(F.when(F.col("is_rule"), F.struct(
                     (F.length("parent") + F.length("begin")).alias("size"), F.concat("parent", "begin").alias("rule"), "says"))).alias("best"),
                 F.bool_or(~F.col("is_rule")).alias("is_listed")))
    exact = exact.select(F.col("host").alias("_host"), F.col("path").alias("_path"), "best", "is_listed")
    return (urls.join(exact, (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")), "left")
            .select("page_id", "host", "path", F.col("best.rule").alias("rule"),
                    F.coalesce("best.says", F.when(F.col("is_listed"), F.lit("block")), F.lit("allow")).alias("verdict")))
