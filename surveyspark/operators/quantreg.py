"""Exact weighted linear quantile regression over distributed rows.

The minimum of the check loss lies on a vertex: a plane through as many rows as there are coefficients.  Only rows near
that plane decide which vertex it is.  So a pass over the rows keeps a band around the current plane, whose width
follows each row's leverage, and turns every row outside it, whose sign is taken as fixed, into one sum of k numbers.  The rows of the
band are gathered (equal ones as one; a share of them, with raised weights, while they are too many) and the small problem, the
band plus the fixed sum, is solved exactly by exchanging rows of the basis.  The band then narrows about the
new plane.  Once it was gathered whole and no row outside it has changed its sign, the vertex is the minimum over all rows
(cf. Portnoy and Koenker 1997).  All quantiles share the passes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyspark.operators.gram import estimation_sample
from surveyspark.operators.regression import _independent
from surveyspark.runtime import materialise, small_table

# Points of a band that are aimed at, and how many more may turn out to be there, for each quantile.
POINTS, SLACK = 8_192, 4
# A band holds this many standard errors of the plane that a share of the rows gave.
MARGIN = 6.0
# A search still open after so many passes is an error, never a result.
MAX_PASSES = 40
# Ties are broken by this much, in units of the spread of y; the basis found is solved again without it.
NOISE = 1e-10
# Residuals up to this size, in the same units, count as zero.
ZERO = 1e-9


@dataclass
class _Search:
    """Where one quantile stands, in standardised units: a plane, its band, and the band solved before."""

    tau: float
    beta: np.ndarray
    half: float = np.inf
    share: float = 1.0
    misses: int = 0
    solved: tuple[np.ndarray, float] | None = None
    done: bool = False
    stats: dict = field(default_factory=dict)


@dataclass(frozen=True)
class _Frame:
    """Kept columns, units, and the matrix that turns a standardised row into its leverage."""

    kept: list[int]
    means: np.ndarray
    scales: np.ndarray
    root: np.ndarray
    n: int
    total: float

    def chance(self, leverage: np.ndarray, share: float) -> np.ndarray:
        """Of being drawn: half of it by leverage, so that rows of rare kinds are always there; ``share`` on average at most."""
        return np.minimum(1.0, share * (0.5 + 0.5 * leverage ** 2 / len(self.kept)))

    def standardised(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """y, (1, x) and leverage of rows (y, x)."""
        v = (values - self.means) / self.scales
        z = np.concatenate([np.ones((len(v), 1)), v[:, 1:]], axis=1)[:, self.kept]
        return v[:, 0], z, np.maximum(np.sqrt(((z @ self.root) ** 2).sum(axis=1)), 1e-6)


def quantile_regression(df: DataFrame, y: str, x: Sequence[str], taus: Sequence[float], weight: str | None = None,
                        where: Column | None = None, max_passes: int = MAX_PASSES, points: int = POINTS) -> DataFrame:
    """``(tau, term, estimate, n, share_below, objective, passes, converged)``, exact up to rounding.

    ``share_below`` is the weighted share of rows under the fit and ``objective`` the check loss.  Terms that earlier
    ones explain are zero.  If several vertices share the minimum, one of them is returned.  At most ``points`` times a small
    factor rows reach the driver for each quantile and pass.  A search that does not end within ``max_passes`` raises RuntimeError.
    """
    if not taus or any(not 0 < t < 1 for t in taus):
        raise ValueError("quantiles must lie strictly between 0 and 1")
    sample = materialise(estimation_sample(df, [y], x, weight, where=where))
    columns = [y, *x]
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    ready = sample.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)], w.alias("w"))
    ready = ready.filter("w > 0")
    frame, start = _frame(ready, len(columns))
    searches = [_Search(tau, start.copy(), share=min(1.0, points / frame.n)) for tau in taus]
    passes = 2
    while passes < max_passes and not all(s.done for s in searches):
        active = [s for s in searches if not s.done]
        for search, sums, rows in zip(active, *_pass(ready, frame, active, points, passes)):
            _advance(search, frame, sums, rows, points)
        passes += 1
    if not all(s.done for s in searches):
        raise RuntimeError(f"no minimum found in {passes} passes for quantiles {[s.tau for s in searches if not s.done]}")

    out = []
    for s in searches:
        beta = np.zeros(len(columns))
        beta[frame.kept] = s.beta
        slopes = beta[1:] * frame.scales[0] / frame.scales[1:]
        intercept = frame.means[0] + frame.scales[0] * beta[0] - float(slopes @ frame.means[1:])
        for term, value in zip([*x, "_cons"], [*slopes, intercept]):
            out.append((float(s.tau), term, float(value), frame.n, s.stats["share"], s.stats["objective"], passes, s.done))
    return small_table(
        df.sparkSession, out, "tau double, term string, estimate double, n bigint, share_below double, objective double, "
             "passes int, converged boolean")


def _values(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)])


def _frame(ready: DataFrame, size: int) -> tuple[_Frame, np.ndarray]:
    """Units of the columns, then the least-squares plane and the leverage matrix: two passes."""
    w = F.col("w")
    row = ready.agg(
        F.count(F.lit(1)), F.sum(w), *[F.sum(w * F.col(f"v{i}")) for i in range(size)],
        *[F.stddev_pop(f"v{i}") for i in range(size)]).first()
    if not row[0]:
        raise ValueError("the estimation sample is empty")
    means = np.array(row[2:2 + size], dtype=float) / row[1]
    scales = np.array([s if s and s > 0 else 1.0 for s in row[2 + size:]], dtype=float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((size + 1, size + 1))
        for batch in batches:
            values = _values(batch)
            v = np.concatenate([np.ones((len(values), 1)), (values[:, :-1] - means) / scales], axis=1)
            out += (v * values[:, -1:]).T @ v
        at = np.indices(out.shape)
        yield pa.RecordBatch.from_arrays([pa.array(at[0].ravel(), pa.int32()), pa.array(at[1].ravel(), pa.int32()), pa.array(out.ravel())],
                                         names=["i", "j", "v"])

    moments = np.zeros((size + 1, size + 1))
    for r in ready.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        moments[r["i"], r["j"]] = r["v"] / row[1]
    place = [0, *range(2, size + 1)]
    kept = _independent(moments[np.ix_(place, place)])
    used = [place[i] for i in kept]
    inverse = np.linalg.inv(moments[np.ix_(used, used)])
    frame = _Frame(kept, means, scales, np.linalg.cholesky((inverse + inverse.T) / 2), int(row[0]), float(row[1]))
    return frame, inverse @ moments[used, 1]


def _pass(ready: DataFrame, frame: _Frame, active: list[_Search], points: int, number: int
          ) -> tuple[list[np.ndarray], list[tuple | None]]:
    """For each search the sums over all rows, and the points of its band (None if there are too many).

    Sums: the fixed part, weight and rows in the band, rows outside the last solved band that changed their sign, weight below
    the plane, check loss.
    """
    k = len(frame.kept)
    tries = [(s.tau, s.beta, s.half, s.share, s.solved) for s in active]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(tries), k + 5))
        # Every pass draws anew: a draw that missed the plane is not repeated.
        rng = np.random.default_rng([number, TaskContext.get().partitionId()])
        for batch in batches:
            if not batch.num_rows:
                continue
            values = _values(batch)
            w = values[:, -1]
            y, z, leverage = frame.standardised(values[:, :-1])
            draw = rng.random(len(w))
            for b, (tau, beta, half, share, solved) in enumerate(tries):
                r = y - z @ beta
                inside = np.abs(r) <= half * leverage
                below = r < -ZERO
                push = w * np.where(r > 0, tau, tau - 1)
                sums[b, :k] += z.T @ np.where(inside, 0.0, push)
                sums[b, k:k + 2] += w[inside].sum(), inside.sum()
                if solved is not None:
                    old = y - z @ solved[0]
                    sums[b, k + 2] += ((np.abs(old) > solved[1] * leverage) & (np.sign(old) * r < 0)).sum()
                sums[b, k + 3:] += w[below].sum(), push @ r
                chance = frame.chance(leverage, share) if share < 1 else np.ones(len(w))
                rows = np.flatnonzero(inside & (draw < chance))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), b), pa.int32()), pa.array(np.full(len(rows), -1), pa.int32()), pa.array(w[rows] / chance[rows]),
                     pa.FixedSizeListArray.from_arrays(values[rows, :-1].ravel(), values.shape[1] - 1).cast(pa.list_(pa.float64()))],
                    names=["b", "i", "v", "point"])
        at = np.indices(sums.shape)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at[0].ravel(), pa.int32()), pa.array(at[1].ravel(), pa.int32()), pa.array(sums.ravel()),
             pa.nulls(sums.size, pa.list_(pa.float64()))], names=["b", "i", "v", "point"])

    found = materialise(ready.mapInArrow(run, "b int, i int, v double, point array<double>").groupBy("b", "i", "point").agg(
        F.sum("v").alias("v"), F.count(F.lit(1)).alias("c")))
    sizes = dict(found.filter("i = -1").groupBy("b").count().collect())
    fine = [b for b in range(len(tries)) if sizes.get(b, 0) <= SLACK * points]
    # Bounded by the check above: sums, and at most so many points for each quantile.
    table = found.filter((F.col("i") >= 0) | F.col("b").isin(fine)).toArrow()
    which, at, value, count = (table.column(c).to_numpy() for c in ("b", "i", "v", "c"))
    sums = np.zeros((len(tries), k + 5))
    sums[which[at >= 0], at[at >= 0]] = value[at >= 0]
    rows: list[tuple | None] = []
    for b in range(len(tries)):
        if b not in fine:
            rows.append(None)
            continue
        use = np.flatnonzero((at < 0) & (which == b))
        flat = table.column("point").take(pa.array(use)).combine_chunks()
        values = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(use), len(frame.means))
        order = np.lexsort(values.T)
        rows.append((values[order], value[use][order], count[use][order]))
    return list(sums), rows


def _advance(s: _Search, frame: _Frame, sums: np.ndarray, rows: tuple | None, points: int) -> None:
    """End the search, or solve the band and choose the next one."""
    k = len(frame.kept)
    fixed, weight, inside, changed, below, loss = sums[:k], sums[k], sums[k + 1], sums[k + 2], sums[k + 3], sums[k + 4]
    if s.solved is not None and changed == 0:
        s.stats, s.done = {"share": below / frame.total, "objective": frame.scales[0] * loss}, True
        return
    if rows is None:
        # More different points than expected: gather a share of them.
        s.share, s.solved = max(min(1.0, points / frame.n), s.share / (2 * SLACK)), None
        return
    values, w, count = rows
    y, z, leverage = frame.standardised(values)
    whole = s.share >= 1
    scaled = w if whole or not w.sum() else w * (weight / w.sum())
    found = solve_vertex(y, z, scaled, s.tau, fixed, s.beta, frame.total) if len(y) >= k else None
    if found is None:
        # The band does not hold the plane, or too few of its points were drawn: look further around the same one.  A share that is
        # few enough for all rows is so for any band.
        fewer = max(min(1.0, points / frame.n), s.share / 4)
        s.misses += 1
        s.share, s.half, s.solved = min(1.0, 2 * s.share) if whole or inside >= frame.n else fewer, 4.0 ** s.misses * s.half, None
        return
    s.misses = 0
    if whole and inside >= frame.n:
        r = y - z @ found
        s.beta, s.done = found, True
        s.stats = {"share": w[r < -ZERO].sum() / frame.total, "objective": frame.scales[0] * float(w @ (r * np.where(r > 0, s.tau, s.tau - 1)))}
        return
    if whole:
        # If a sign has changed after all, the next pass solves a wider band about the new plane.
        s.solved = (s.beta, s.half)
        s.beta, s.half = found, 1.5 * s.half
        return
    # Different points of the band: those drawn once stand for others not drawn.
    mass = np.where(count > 1, 1.0, 1.0 / frame.chance(leverage, s.share))
    target = max(points / 2, min(0.5, MARGIN * (k / len(y)) ** 0.5) * mass.sum())
    near = np.abs(y - z @ found) / leverage
    order = np.argsort(near)
    near, reach = near[order], np.cumsum(mass[order])
    rank = int(np.searchsorted(reach, target))
    few = min(63, len(near) - 1)
    half = near[min(rank, len(near) - 1)] if rank >= few else near[few] * target / reach[few]
    s.beta, s.half, s.solved = found, max(float(half), 10 * NOISE), None
    s.share = 1.0 if target <= 0.75 * points else points / target


def solve_vertex(y: np.ndarray, z: np.ndarray, w: np.ndarray, tau: float, fixed: np.ndarray, start: np.ndarray,
                 total: float) -> np.ndarray | None:
    """Minimum of the check loss minus ``fixed @ beta`` by basis exchange from the rows nearest to ``start``.

    Each step leaves the row whose multiplier is farthest outside its bounds and walks to where the slope along that edge
    turns.  None if the rows do not span the columns or the loss falls without end.
    """
    n, k = z.shape
    noisy = y + NOISE * np.random.default_rng(n).uniform(-1, 1, n)
    basis = _basis(z, np.argsort(np.abs(noisy - z @ start), kind="stable"))
    if basis is None:
        return None
    tolerance = 1e-12 * total
    for _ in range(200 * k + n):
        inverse = np.linalg.inv(z[basis])
        beta = inverse @ noisy[basis]
        r = noisy - z @ beta
        r[basis] = 0.0
        push = w * np.where(r > 0, tau, tau - 1)
        push[basis] = 0.0
        multiplier = -inverse.T @ (z.T @ push + fixed)
        over, under = multiplier - tau * w[basis], (tau - 1) * w[basis] - multiplier
        excess = np.maximum(over, under)
        j = int(np.argmax(excess / np.sqrt((inverse ** 2).sum(axis=0))))
        if excess[j] <= tolerance:
            return np.linalg.solve(z[basis], y[basis])
        move = inverse[:, j] * (-1.0 if over[j] >= under[j] else 1.0)
        step = z @ move
        step[basis] = 0.0
        ahead = np.flatnonzero(r * step > 0)
        at = r[ahead] / step[ahead]
        order = np.argsort(at, kind="stable")
        gain = np.cumsum(w[ahead][order] * np.abs(step[ahead][order]))
        stop = int(np.searchsorted(gain, excess[j]))
        if stop >= len(order):
            return None
        basis[j] = ahead[order[stop]]
    return None


def _basis(z: np.ndarray, order: np.ndarray) -> np.ndarray | None:
    """The first rows in ``order`` that are independent."""
    k = z.shape[1]
    rows: list[int] = []
    span = np.zeros((0, k))
    for lo in range(0, len(order), 256):
        part = z[order[lo:lo + 256]]
        rest = part - (part @ span.T) @ span
        rest -= (rest @ span.T) @ span
        size = np.sqrt((part ** 2).sum(axis=1))
        while len(rows) < k:
            length = np.sqrt((rest ** 2).sum(axis=1))
            good = np.flatnonzero(length > 1e-7 * size)
            if not len(good):
                break
            rows.append(int(order[lo + good[0]]))
            axis = rest[good[0]] / length[good[0]]
            span = np.vstack([span, axis])
            rest = rest - np.outer(rest @ axis, axis)
            rest -= np.outer(rest @ axis, axis)
        if len(rows) == k:
            return np.array(rows)
    return None
