"""Group-gap decompositions (Oaxaca 1973, Blinder 1973; formulas as in Jann 2008)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyspark.operators.gram import Design, Moments, design, estimation_sample, gram
from surveyspark.operators.regression import Fit, solve
from surveyspark.runtime import materialise

TERMS = T.StructType([
    T.StructField("y", T.StringType()), T.StructField("part", T.StringType()), T.StructField("term", T.StringType()),
    T.StructField("estimate", T.DoubleType()), T.StructField("std_error", T.DoubleType()),
])
ALL_TERMS = "(all)"


def oaxaca(df: DataFrame, y: str | Sequence[str], x: Sequence[str], group: str, weight: str | None = None,
           where: Column | None = None, by: Sequence[str] = (), pooled: bool = False, detail: bool = False,
           weight_kind: str = "aweight") -> DataFrame:
    """Difference of mean ``y`` between ``group`` = 0 (first) and ``group`` = 1 (second).

    Threefold: endowments, coefficients, interaction, seen from the second group.  ``pooled`` gives the
    twofold split against a pooled model that contains the group indicator.  ``detail`` adds one row
    per covariate.  ``by`` repeats the decomposition; blocks lacking one of the groups are left out.
    """
    ys = [y] if isinstance(y, str) else list(y)
    rows = df if where is None else df.filter(where)
    sample = materialise(estimation_sample(rows.filter(F.col(group).isin(0, 1)), ys, x, weight, [group, *by]))
    return oaxaca_from_sample(sample, design(sample, ys, x), group, weight, by, pooled, detail, weight_kind)


def oaxaca_from_sample(sample: DataFrame, plan: Design, group: str, weight: str | None, by: Sequence[str] = (),
                       pooled: bool = False, detail: bool = False, weight_kind: str = "aweight") -> DataFrame:
    """Decompose a ready estimation sample: one moment pass, then one small row per block."""
    sums = gram(sample, plan, weight, [group, *by])
    sides = sums.groupBy(*by).agg(*[
        F.max(F.when(F.col(group) == g, F.col(c))).alias(f"{c}{g}") for g in (0, 1) for c in ("n", "moments")])
    sides = sides.filter("n0 IS NOT NULL AND n1 IS NOT NULL")
    schema = T.StructType([sides.schema[b] for b in by] + list(TERMS.fields))

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                keys = [getattr(row, b) for b in by]
                first = Moments.from_row(plan, row.n0, row.moments0)
                second = Moments.from_row(plan, row.n1, row.moments1)
                for name in plan.y:
                    split = twofold if pooled else threefold
                    for record in split(first, second, name, list(plan.x), weight_kind, detail):
                        out.append([*keys, name, *record])
            yield pd.DataFrame(out, columns=schema.names)

    return sides.mapInPandas(run, schema)


def _levels(first: Moments, second: Moments, y: str, weight_kind: str) -> list[tuple]:
    m1, m2 = first.means([y])[0], second.means([y])[0]
    v1, v2 = (m.covariance_of_means([y], weight_kind)[0, 0] for m in (first, second))
    return [("group_1", ALL_TERMS, m1, v1 ** 0.5), ("group_2", ALL_TERMS, m2, v2 ** 0.5),
            ("difference", ALL_TERMS, m1 - m2, (v1 + v2) ** 0.5)]


def _mean_vector(m: Moments, x: list[str], weight_kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Covariate means with a trailing 1 for the intercept, and their sampling covariance."""
    cov = np.zeros((len(x) + 1, len(x) + 1))
    cov[:-1, :-1] = m.covariance_of_means(x, weight_kind)
    return np.append(m.means(x), 1.0), cov


def _part(name: str, terms: Sequence[str], left: np.ndarray, left_cov: np.ndarray, right: np.ndarray,
          right_cov: np.ndarray, detail: bool) -> list[tuple]:
    """Sum of products of two independent vectors with delta-method standard errors."""
    variance = float(left @ right_cov @ left + right @ left_cov @ right)
    out = [(name, ALL_TERMS, float(left @ right), max(variance, 0.0) ** 0.5)]
    if detail:
        each = left ** 2 * np.diag(right_cov) + right ** 2 * np.diag(left_cov)
        out += [(name, t, float(a * b), float(max(v, 0.0)) ** 0.5) for t, a, b, v in zip(terms, left, right, each)]
    return out


def threefold(first: Moments, second: Moments, y: str, x: list[str], weight_kind: str, detail: bool) -> list[tuple]:
    one, two = (solve(m, y, x, weight_kind) for m in (first, second))
    x1, v1 = _mean_vector(first, x, weight_kind)
    x2, v2 = _mean_vector(second, x, weight_kind)
    terms = one.terms
    gap, gap_cov = x1 - x2, v1 + v2
    slope, slope_cov = one.beta - two.beta, one.cov + two.cov
    return [
        *_levels(first, second, y, weight_kind),
        *_part("endowments", terms, gap, gap_cov, two.beta, two.cov, detail),
        *_part("coefficients", terms, x2, v2, slope, slope_cov, detail),
        *_part("interaction", terms, gap, gap_cov, slope, slope_cov, detail),
    ]


def pooled_fit(first: Moments, second: Moments, y: str, x: list[str], weight_kind: str) -> Fit:
    """Model of both groups together with the group indicator, which is then left aside."""
    both = first + second
    size = len(both.plan.names)
    plan = Design(both.plan.y, (*both.plan.x, "__group"), {**both.plan.shift, "__group": 0.0})
    # The indicator is 1 in the second group, so its moments are that group's first row.
    position = 1 + len(both.plan.x)
    matrix = np.insert(np.insert(both.matrix, position, 0.0, axis=0), position, 0.0, axis=1)
    others = [i for i in range(size + 1) if i != position]
    matrix[position, others] = matrix[others, position] = second.matrix[0]
    matrix[position, position] = second.weight
    fit = solve(Moments(plan, both.n, matrix), y, [*x, "__group"], weight_kind)
    keep = [i for i, t in enumerate(fit.terms) if t != "__group"]
    return Fit([fit.terms[i] for i in keep], fit.beta[keep], fit.cov[np.ix_(keep, keep)],
               [fit.omitted[i] for i in keep], fit.n, fit.r2)


def twofold(first: Moments, second: Moments, y: str, x: list[str], weight_kind: str, detail: bool) -> list[tuple]:
    star = pooled_fit(first, second, y, x, weight_kind)
    one, two = (solve(m, y, x, weight_kind) for m in (first, second))
    x1, v1 = _mean_vector(first, x, weight_kind)
    x2, v2 = _mean_vector(second, x, weight_kind)
    explained = _part("explained", one.terms, x1 - x2, v1 + v2, star.beta, star.cov, detail)
    a = _part("unexplained", one.terms, x1, v1, one.beta - star.beta, one.cov + star.cov, detail)
    b = _part("unexplained", one.terms, x2, v2, star.beta - two.beta, star.cov + two.cov, detail)
    unexplained = [(n, t, p + q, (s * s + u * u) ** 0.5) for (n, t, p, s), (_, _, q, u) in zip(a, b)]
    return [*_levels(first, second, y, weight_kind), *explained, *unexplained]
