"""Least squares from moment sums, for one model or for many groups at once."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyspark.operators.gram import Design, Moments, design, estimation_sample, gram
from surveyspark.runtime import materialise

COEFFICIENTS = T.StructType([
    T.StructField("y", T.StringType()), T.StructField("term", T.StringType()),
    T.StructField("estimate", T.DoubleType()), T.StructField("std_error", T.DoubleType()),
    T.StructField("t", T.DoubleType()), T.StructField("omitted", T.BooleanType()),
    T.StructField("n", T.LongType()), T.StructField("r2", T.DoubleType()),
])
# A column whose part not explained by earlier columns is below this share of it is collinear.
COLLINEAR = 1e-9


@dataclass(frozen=True)
class Fit:
    """Coefficients in original units, ``_cons`` last; omitted terms have zero rows."""

    terms: list[str]
    beta: np.ndarray
    cov: np.ndarray
    omitted: list[bool]
    n: int
    r2: float


def solve(moments: Moments, y: str, x: Sequence[str], weight_kind: str = "aweight") -> Fit:
    """Weighted least squares of ``y`` on ``x`` and an intercept from a moment matrix."""
    plan, names = moments.plan, moments.plan.names
    where = [0] + [names.index(v) for v in x]
    target = names.index(y)
    xx = moments.matrix[np.ix_(where, where)]
    xy = moments.matrix[where, target]
    yy = moments.matrix[target, target]
    kept = _independent(xx)
    scale = np.sqrt(np.diag(xx)[kept])
    inverse = np.linalg.inv(xx[np.ix_(kept, kept)] / np.outer(scale, scale)) / np.outer(scale, scale)
    b = np.zeros(len(where))
    b[kept] = inverse @ xy[kept]

    k = len(kept)
    residual = max(float(yy - b @ xy), 0.0)
    total = float(yy - moments.matrix[0, target] ** 2 / moments.weight)
    if weight_kind == "iweight":
        freedom, rss = moments.weight - k, residual
    else:
        freedom, rss = moments.n - k, residual * moments.n / moments.weight
        inverse = inverse * moments.weight / moments.n
    cov = np.zeros((len(where), len(where)))
    if freedom > 0:
        cov[np.ix_(kept, kept)] = inverse * rss / freedom
    else:
        cov[:] = np.nan

    # Undo the shift: only the intercept changes.
    back = np.eye(len(where))
    back[0, 1:] = [-plan.shift[v] for v in x]
    b = back @ b
    b[0] += plan.shift[y]
    cov = back @ cov @ back.T
    order = [*range(1, len(where)), 0]
    omitted = [i not in kept for i in range(len(where))]
    return Fit([*x, "_cons"], b[order], cov[np.ix_(order, order)], [omitted[i] for i in order], moments.n,
               1 - residual / total if total > 0 else float("nan"))


def _independent(xx: np.ndarray) -> list[int]:
    """Columns kept when later ones that earlier ones explain are dropped (the intercept is first)."""
    work, kept = xx.astype(float).copy(), []
    for j in range(len(xx)):
        if xx[j, j] > 0 and work[j, j] > COLLINEAR * xx[j, j]:
            kept.append(j)
            work = work - np.outer(work[:, j], work[j]) / work[j, j]
    return kept


def fit_table(grams: DataFrame, plan: Design, by: Sequence[str] = (), y: Sequence[str] | None = None,
              x: Sequence[str] | None = None, weight_kind: str = "aweight") -> DataFrame:
    """Coefficients of every group and dependent variable.

    Each moment row is solved where it lies (a k x k system); nothing goes through the driver.
    """
    ys, xs = tuple(y or plan.y), tuple(x or plan.x)
    schema = T.StructType([grams.schema[b] for b in by] + list(COEFFICIENTS.fields))

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                moments = Moments.from_row(plan, row.n, row.moments)
                keys = [getattr(row, b) for b in by]
                for name in ys:
                    fit = solve(moments, name, xs, weight_kind)
                    errors = np.sqrt(np.maximum(np.diag(fit.cov), 0))
                    for term, value, error, gone in zip(fit.terms, fit.beta, errors, fit.omitted):
                        t = value / error if error > 0 else None
                        out.append([*keys, name, term, value, error, t, gone, fit.n, fit.r2])
            yield pd.DataFrame(out, columns=schema.names)

    return grams.mapInPandas(run, schema)


def regress(df: DataFrame, y: str | Sequence[str], x: Sequence[str], weight: str | None = None,
            by: Sequence[str] = (), where: Column | None = None, weight_kind: str = "aweight") -> DataFrame:
    """Linear regression(s) with an intercept: several dependent variables share one pass.

    Rows that lack any of the named columns are dropped, so put variables with different gaps into
    separate calls.
    """
    ys = [y] if isinstance(y, str) else list(y)
    sample = materialise(estimation_sample(df, ys, x, weight, by, where))
    plan = design(sample, ys, x)
    return fit_table(gram(sample, plan, weight, by), plan, by, weight_kind=weight_kind)


def log_wage(wage: str) -> Column:
    """Natural log; NULL at zero and below."""
    return F.when(F.col(wage) > 0, F.ln(wage))
