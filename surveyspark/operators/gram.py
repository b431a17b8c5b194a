"""Moment sums: everything a linear model needs from the rows, in one aggregate per group."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Design:
    """Variables of a moment matrix.  ``shift`` holds constants subtracted for conditioning."""

    y: tuple[str, ...]
    x: tuple[str, ...]
    shift: dict[str, float]

    @property
    def names(self) -> list[str]:
        return ["_cons", *self.x, *self.y]


def estimation_sample(df: DataFrame, y: Sequence[str], x: Sequence[str], weight: str | None = None,
                      by: Sequence[str] = (), where: Column | None = None) -> DataFrame:
    """Model columns of the rows that satisfy ``where`` and lack none of them (listwise deletion)."""
    columns = list(dict.fromkeys([*y, *x, *([weight] if weight else []), *by]))
    rows = df if where is None else df.filter(where)
    return rows.select(*columns).dropna(subset=columns)


def design(sample: DataFrame, y: Sequence[str], x: Sequence[str], centre: bool = True) -> Design:
    """Variables with constants to subtract, so that Age and Age squared keep their digits apart.

    The constants are the means over the whole sample, to nine digits: the order in which rows are added up
    changes later digits only, so it does not change the constants.
    """
    names = [*y, *x]
    if not centre:
        return Design(tuple(y), tuple(x), dict.fromkeys(names, 0.0))
    means = sample.agg(*[F.avg(F.col(n).cast("double")).alias(n) for n in names]).first()
    return Design(tuple(y), tuple(x), {n: float(f"{means[n] or 0.0:.9g}") for n in names})


def gram(sample: DataFrame, plan: Design, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., n, moments)``: the upper triangle of Z'WZ, Z = (1, x, y) shifted, row by row.

    Sums combine map-side, so a group on a third of the rows costs no more than the others.
    """
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    z = [None] + [F.col(n).cast("double") - F.lit(plan.shift[n]) for n in [*plan.x, *plan.y]]
    sums = []
    for i, a in enumerate(z):
        for b in z[i:]:
            product = w
            for factor in (a, b):
                product = product if factor is None else product * factor
            sums.append(F.sum(product))
    named = [s.alias(f"m{i}") for i, s in enumerate(sums)]
    out = sample.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *named)
    return out.select(*by, "n", F.array(*[F.col(f"m{i}") for i in range(len(sums))]).alias("moments"))


def gram_long(grams: DataFrame, plan: Design, by: Sequence[str] = ()) -> DataFrame:
    """Moment sums as ``(by..., n, row_term, column_term, total)``."""
    names = plan.names
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    entries = F.array(*[F.struct(F.lit(a).alias("row_term"), F.lit(b).alias("column_term"),
                                 F.col("moments")[i].alias("total")) for i, (a, b) in enumerate(pairs)])
    return grams.select(*by, "n", F.inline(entries))


@dataclass(frozen=True)
class Moments:
    """A symmetric moment matrix of (1, x, y), in shifted units, with its sample size."""

    plan: Design
    n: int
    matrix: np.ndarray

    @classmethod
    def from_row(cls, plan: Design, n: int, moments: Sequence[float]) -> "Moments":
        size = len(plan.names)
        matrix = np.zeros((size, size))
        matrix[np.triu_indices(size)] = moments
        return cls(plan, int(n), matrix + np.triu(matrix, 1).T)

    def __add__(self, other: "Moments") -> "Moments":
        return Moments(self.plan, self.n + other.n, self.matrix + other.matrix)

    @property
    def weight(self) -> float:
        return float(self.matrix[0, 0])

    def means(self, names: Sequence[str]) -> np.ndarray:
        """Weighted means in original units."""
        where = [self.plan.names.index(n) for n in names]
        return self.matrix[0, where] / self.weight + np.array([self.plan.shift[n] for n in names])

    def covariance_of_means(self, names: Sequence[str], weight_kind: str) -> np.ndarray:
        where = [self.plan.names.index(n) for n in names]
        mean = self.matrix[0, where] / self.weight
        spread = self.matrix[np.ix_(where, where)] / self.weight - np.outer(mean, mean)
        observations = self.weight if weight_kind == "iweight" else self.n
        return spread / max(observations - 1, 1e-300)
