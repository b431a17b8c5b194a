"""Weighted percentiles without sorting the data.

The wanted value is narrowed down by value ranges: one pass sums weights per range and finds the range
that each percentile falls in, the next pass looks only inside those ranges.  No task ever holds more
than one range of one group, and a value repeated on very many rows is one summed entry.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from surveyspark.runtime import materialise

RANGES = 512
# Cut points of each group's first ranges.
CUTS = 63
# Rows left in the fullest wanted range above which the ranges are cut again.
SMALL_RANGE = 2_000_000
_TIE = 1e-12


def weighted_percentiles(df: DataFrame, value: str, probabilities: Sequence[float], weight: str = "Weight",
                         by: Sequence[str] = (), ranges: int = RANGES, small_range: int = SMALL_RANGE,
                         cut_lineage: bool = True) -> DataFrame:
    """``(by..., p, value)``: smallest value whose running weight exceeds p times the total.

    Where some running weight equals that target, the mean of its value and the next one.  Rows
    without a value or a positive weight take no part.  Groups are compared null-safely.

    The rows are read three times or more.  By default their two or three columns are written first;
    turn ``cut_lineage`` off when ``df`` is a plain scan.
    """
    if not probabilities or any(not 0 < p < 1 for p in probabilities):
        raise ValueError("probabilities must lie strictly between 0 and 1")
    if ranges < 2:
        raise ValueError("at least two ranges are needed")
    keys = [f"__k{i}" for i in range(len(by))]
    rows = df.select(*[F.struct(F.col(b)).alias(k) for b, k in zip(by, keys)],
                     F.col(value).cast("double").alias("__y"), F.col(weight).cast("double").alias("__w"))
    rows = rows.filter(F.col("__y").isNotNull() & ~F.isnan("__y") & (F.col("__w") > 0))

    if cut_lineage:
        rows = materialise(rows)

    # First cut: all rows; every group needs its total anyway.
    inside = _bucketed(rows, keys, min(CUTS, ranges - 1))
    sums = _range_sums(inside, keys)
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    # One row per range of a group: at most `ranges` rows in a window partition.
    placed = sums.withColumns({
        "total": F.sum("w").over(group), "upto": F.sum("w").over(_upto(group)),
        "next": F.lead("lo").over(group.orderBy("__bucket"))})
    placed = placed.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])))
    placed = placed.withColumn("target", F.col("p") * F.col("total"))
    wanted = materialise(_hit(placed, keys))
    inside = inside.join(wanted.drop("n"), [*keys, "__bucket"])

    # Further cuts while a wanted range is still large, each between its own ends.  These fall into
    # different parts, so every cut takes rows away.
    # Halves keep the difference of very large ends finite.
    before_cut = None
    while True:
        largest = wanted.filter("lo < hi").agg(F.max("n").alias("n"), F.sum("n").alias("all")).first()
        if (largest["n"] or 0) <= small_range:
            break
        if before_cut is not None and largest["all"] >= before_cut:
            raise RuntimeError("a range of values cannot be cut any further")
        before_cut = largest["all"]
        part = F.floor((F.col("__y") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * ranges)
        part = F.when(F.col("hi") > F.col("lo"), F.least(part, F.lit(ranges - 1))).otherwise(0)
        inside = inside.withColumn("__bucket", part.cast("int")).drop("lo", "hi")
        sums = _range_sums(inside, [*keys, "p", "target", "before", "next"])
        group = Window.partitionBy(*keys, "p")
        placed = sums.withColumns({
            "upto": F.col("before") + F.sum("w").over(_upto(group)),
            "next": F.coalesce(F.lead("lo").over(group.orderBy("__bucket")), F.col("next"))})
        wanted = materialise(_hit(placed, keys))
        inside = inside.drop("target", "before", "next").join(wanted.drop("n"), [*keys, "p", "__bucket"])

    values = inside.groupBy(*keys, "p", "target", "before", "next", "__y").agg(F.sum("__w").alias("w"))
    group = Window.partitionBy(*keys, "p")
    by_value = group.orderBy("__y")
    values = values.withColumns({
        "running": F.col("before") + F.sum("w").over(by_value.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        "after": F.coalesce(F.lead("__y").over(by_value), F.col("next"))})
    reached = F.col("running") >= F.col("target") * (1 - _TIE)
    exact = F.abs(F.col("running") - F.col("target")) <= F.col("target") * _TIE
    answer = F.when(exact & F.col("after").isNotNull(), (F.col("__y") + F.col("after")) / 2).otherwise(F.col("__y"))
    found = values.filter(reached).groupBy(*keys, "p").agg(F.min_by(answer, F.col("__y")).alias("value"))
    return found.select(*[F.col(k)[b].alias(b) for b, k in zip(by, keys)], "p", "value")


def _range_sums(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys, "__bucket").agg(
        F.sum("__w").alias("w"), F.count(F.lit(1)).alias("n"), F.min("__y").alias("lo"), F.max("__y").alias("hi"))


def _upto(group):
    return group.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _hit(placed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The range of each group and percentile in which the running weight passes the target."""
    before, line = F.col("upto") - F.col("w"), F.col("target") * (1 - _TIE)
    chosen = placed.filter((F.col("upto") >= line) & (before < line))
    return chosen.select(*keys, "p", "__bucket", "target", before.alias("before"), "next", "n", "lo", "hi")


def _bucketed(rows: DataFrame, keys: Sequence[str], cuts: int) -> DataFrame:
    """Number the value range of every row among the quantile sketch's cut points of its own group.

    The cut points only balance the work.  Infinite values have ranges of their own at both ends, so every other range has finite ends.
    """
    infinite = float("inf")
    sketch = F.percentile_approx("__y", [i / (cuts + 1) for i in range(1, cuts + 1)], 16 * (cuts + 1))
    # One short array per group, met by a map-side combined aggregate.
    points = rows.filter(F.abs("__y") < infinite).groupBy(*keys).agg(sketch.alias("__c"))
    if keys:
        rows = rows.join(points, [*keys], "left")
    else:
        found = points.first()["__c"] or []
        rows = rows.withColumn("__c", F.array(*map(F.lit, found)).cast("array<double>"))
    below = F.coalesce(F.size(F.filter("__c", lambda c: c < F.col("__y"))), F.lit(0))
    bucket = F.when(F.col("__y") == -infinite, -1).when(F.col("__y") == infinite, cuts + 1).otherwise(below)
    return rows.withColumn("__bucket", bucket.cast("int")).drop("__c")


def reference_rif(value: str, quantile: float, p: float) -> Column:
    """``q - 1{y <= q} / (p (1 - p))``: no density and no p; a missing value counts as above q."""
    below = F.coalesce(F.col(value) <= F.lit(quantile), F.lit(False)).cast("double")
    return F.lit(quantile) - below / F.lit(p * (1 - p))


def standard_rif(value: str, quantile: float, p: float, density: float) -> Column:
    """``q + (p - 1{y <= q}) / f(q)`` (Firpo, Fortin and Lemieux 2009); NULL for a missing value."""
    below = (F.col(value) <= F.lit(quantile)).cast("double")
    return F.lit(quantile) + (F.lit(p) - below) / F.lit(density)


def kernel_densities(df: DataFrame, value: str, points: Mapping[float, float], weight: str = "Weight",
                     bandwidth: float | None = None) -> dict[float, float]:
    """Weighted Gaussian kernel density of ``value`` at the given points, in one pass.

    The default bandwidth is Silverman's rule on the weighted standard deviation.
    """
    rows = df.filter(F.col(value).isNotNull() & (F.col(weight) > 0))
    y, w = F.col(value).cast("double"), F.col(weight).cast("double")
    if bandwidth is None:
        n, total, s1 = rows.agg(F.count(F.lit(1)), F.sum(w), F.sum(w * y)).first()
        # Squares around the mean: a large mean costs no digits.
        spread = (rows.agg(F.sum(w * F.pow(y - F.lit(s1 / total), 2))).first()[0] / total) ** 0.5
        bandwidth = 1.06 * spread * n ** -0.2
    sums = [F.sum(w * F.exp(-0.5 * F.pow((y - F.lit(q)) / F.lit(bandwidth), 2))) for q in points.values()]
    row = rows.agg(F.sum(w), *sums).first()
    scale = row[0] * bandwidth * (2 * math.pi) ** 0.5
    return {p: row[i + 1] / scale for i, p in enumerate(points)}


def add_rif(df: DataFrame, value: str, probabilities: Sequence[float], weight: str = "Weight",
            where: Column | None = None, kind: str = "reference", prefix: str = "rif",
            cut_lineage: bool = True) -> tuple[DataFrame, dict[float, float]]:
    """Add ``rif25``-style columns; quantiles come from the rows in ``where``, columns from all rows.

    The rows are read up to eight times.  By default all columns of ``df`` are written first, so give it only those that are wanted;
    turn ``cut_lineage`` off when ``df`` is a plain scan.
    """
    if cut_lineage:
        df = materialise(df)
    rows = df if where is None else df.filter(where)
    table = weighted_percentiles(rows, value, probabilities, weight, cut_lineage=False)
    quantiles = {r["p"]: r["value"] for r in table.collect()}  # one number per requested percentile
    if kind == "standard":
        density = kernel_densities(rows, value, quantiles, weight)
        columns = {p: standard_rif(value, q, p, density[p]) for p, q in quantiles.items()}
    elif kind == "reference":
        columns = {p: reference_rif(value, q, p) for p, q in quantiles.items()}
    else:
        raise ValueError(f"unknown influence variable: {kind}")
    return df.withColumns({f"{prefix}{round(100 * p):d}": c for p, c in columns.items()}), quantiles
