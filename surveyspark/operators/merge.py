"""Keys and checked merges.

A full outer join cannot be broadcast and its hot keys cannot be split at run time.  The merges here
are therefore outer joins from the side whose keys may repeat, plus the rows of the other side whose
key never occurs there.  Spark can broadcast or skew-split the first of those joins; the second holds distinct keys in
hash tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyspark import codebook as cb
from surveyspark.operators.checks import CheckFailed, check_report, Check, duplicate_keys, enforce, key_report

LEFT_ONLY, RIGHT_ONLY, BOTH = "left_only", "right_only", "both"


def composite_key(suffix: str, parts: Sequence[cb.KeyPart] = cb.KEY_PARTS, extra: Sequence[str] = ()) -> Column:
    """The key parts joined in order; NULL when any part is missing."""
    names = [f"{p.prefix}_{suffix}" if suffix else p.prefix for p in parts]
    return F.concat(*[F.col(n) for n in [*names, *extra]])


def merge_tables(left: DataFrame, right: DataFrame, on: Sequence[str], kind: str = "m:1",
                 keep: Sequence[str] | None = None) -> DataFrame:
    """Outer merge with a ``_merge`` indicator; on shared columns the left (master) value is kept.

    ``kind`` says which side has unique keys: ``m:1``, ``1:m`` or ``1:1``.  Prove it with
    :func:`uniqueness_report`.  ``keep`` limits the columns brought in from the right.
    A NULL in the key matches nothing.
    """
    on = list(on)
    if kind not in {"m:1", "1:m", "1:1"}:
        raise ValueError(f"unknown merge kind: {kind}")
    if keep is not None:
        right = right.select(*on, *keep)
    shared = [c for c in right.columns if c in left.columns and c not in on]
    added = [c for c in right.columns if c not in left.columns]
    if kind == "1:m":
        many, one, many_mark, one_mark = right, left, RIGHT_ONLY, LEFT_ONLY
    else:
        many, one, many_mark, one_mark = left, right, LEFT_ONLY, RIGHT_ONLY

    a, b = many.alias("a"), one.withColumn("__hit", F.lit(True)).alias("b")
    matches = [F.col(f"a.`{c}`") == F.col(f"b.`{c}`") for c in on]
    joined = a.join(b, _all(matches), "left_outer")
    hit = F.col("b.__hit").isNotNull()
    left_side, right_side = ("b", "a") if kind == "1:m" else ("a", "b")

    def pick(column: str) -> Column:
        if column in on:
            return F.col(f"a.`{column}`").alias(column)
        if column in shared:
            mine, theirs = F.col(f"{left_side}.`{column}`"), F.col(f"{right_side}.`{column}`")
            if kind == "1:m":
                return F.when(hit, mine).otherwise(theirs).alias(column)
            return mine.alias(column)
        side = left_side if column in left.columns else right_side
        return F.col(f"{side}.`{column}`").alias(column)

    order = [*left.columns, *added]
    matched = joined.select(*[pick(c) for c in order], F.when(hit, BOTH).otherwise(many_mark).alias("_merge"))

    # A hash table of an anti join keeps a repeated key once, so keys need neither be made distinct nor be sorted first.
    seen = many.select(*on).hint("shuffle_hash")
    rest = one.join(seen, on, "left_anti").withColumn("_merge", F.lit(one_mark))
    return matched.unionByName(rest, allowMissingColumns=True).select(*order, "_merge")


def uniqueness_report(left: DataFrame, right: DataFrame, on: Sequence[str], kind: str) -> DataFrame:
    """Key checks for the sides that ``kind`` declares unique."""
    reports = []
    if kind in {"1:1", "1:m"}:
        reports.append(key_report(left, on, "left key"))
    if kind in {"1:1", "m:1"}:
        reports.append(key_report(right, on, "right key"))
    out = reports[0]
    for report in reports[1:]:
        out = out.unionByName(report)
    return out


def merge_counts(merged: DataFrame) -> DataFrame:
    """Rows per merge outcome."""
    return merged.groupBy("_merge").agg(F.count(F.lit(1)).alias("rows"))


def unmatched_counts(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of each side whose key the other side lacks, as a one-row table.

    Keys are counted before they meet, so a hot key is one entry per side.
    """
    on = list(on)
    a = left.groupBy(*on).agg(F.count(F.lit(1)).alias("__l"))
    b = right.groupBy(*on).agg(F.count(F.lit(1)).alias("__r"))
    both = a.join(b, on, "full_outer")
    return both.agg(
        F.coalesce(F.sum(F.when(F.col("__r").isNull(), F.col("__l"))), F.lit(0)).alias("left_only"),
        F.coalesce(F.sum(F.when(F.col("__l").isNull(), F.col("__r"))), F.lit(0)).alias("right_only"))


def merge_checked(left: DataFrame, right: DataFrame, on: Sequence[str], kind: str = "m:1",
                  keep: Sequence[str] | None = None) -> DataFrame:
    """:func:`merge_tables` that stops unless the keys are unique as declared and all rows match."""
    enforce(uniqueness_report(left, right, on, kind))
    merged = merge_tables(left, right, on, kind, keep)
    counts = {r["_merge"]: r["rows"] for r in merge_counts(merged).collect()}
    if counts.get(LEFT_ONLY, 0) or counts.get(RIGHT_ONLY, 0):
        raise CheckFailed(
            f"merge stopped: {counts.get(LEFT_ONLY, 0):,} left rows and "
            f"{counts.get(RIGHT_ONLY, 0):,} right rows have no partner")
    return merged


def agreement(left: DataFrame, right: DataFrame, on: Sequence[str], pairs: Sequence[tuple[str, str]], kind: str = "m:1") -> DataFrame:
    """Disagreeing rows of the outer merge per (left column, right column), in one pass; NULL on either side disagrees.

    Only counts are wanted, so the merge is one full join that reads each side once.  A task keeps the side with unique keys in a hash
    table and the other side passes by unsorted: a hot key there costs time, but no memory.
    """
    if kind not in {"m:1", "1:m", "1:1"}:
        raise ValueError(f"unknown merge kind: {kind}")
    a = left.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(on)], *[F.col(c).alias(f"a{i}") for i, (c, _) in enumerate(pairs)])
    b = right.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(on)], *[F.col(c).alias(f"b{i}") for i, (_, c) in enumerate(pairs)])
    a, b = (a.hint("shuffle_hash"), b) if kind == "1:m" else (a, b.hint("shuffle_hash"))
    merged = a.join(b, [f"k{i}" for i in range(len(on))], "full_outer")
    return check_report(merged, [Check(f"{c} = {d}", F.col(f"a{i}") == F.col(f"b{i}")) for i, (c, d) in enumerate(pairs)])


def rows_preserved(before: DataFrame, after: DataFrame, key: Sequence[str]) -> DataFrame:
    """Row counts before and after, and the number of repeated keys after."""
    counted = after.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("rows_after"), F.count_if(F.col("__n") > 1).alias("repeated_keys"))
    base = before.agg(F.count(F.lit(1)).alias("rows_before"))
    joined = base.withColumn("__k", F.lit(1)).join(counted.withColumn("__k", F.lit(1)), "__k")
    return joined.select("rows_before", "rows_after", "repeated_keys")


def stack_visits(first: DataFrame, revisit: DataFrame) -> DataFrame:
    """First-visit and revisit records under each other.

    The key contains the visit, so the two never meet: a one-to-one merge would only stack them.
    """
    return first.unionByName(revisit, allowMissingColumns=True)


def drop_suffix(df: DataFrame, suffix: str) -> DataFrame:
    """Harmonise the names of one file: ``mult_hhrv`` becomes ``mult`` (upper-case codes kept)."""
    end = f"_{suffix}"
    return df.withColumnsRenamed({c: c[: -len(end)] for c in df.columns if c.endswith(end)})


def repeated_rows(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """All rows whose key repeats."""
    return df.join(duplicate_keys(df, key).select(*key), list(key), "left_semi")


def _all(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for condition in conditions[1:]:
        out = out & condition
    return out
