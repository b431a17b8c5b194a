"""Embedding whitening from an exact characteristic polynomial.

Entries become integers, so the scatter matrix is a sum of integers that no order of summing changes.  Its
characteristic polynomial is found modulo many primes (reduction to Hessenberg form, one Spark task for a block of
primes) and put together by the Chinese remainder theorem.  All its roots are real, so sign changes of shifted
coefficients count the roots above a point exactly; the largest roots are isolated with them and cut down to some
160 bits.  Components come from inverse iteration on the null space of (scatter - root), in long fixed-point numbers.

The data is read three times (sums, check of the result, output) and never shuffled; what reaches the driver
depends on the dimension alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
# Bits of the largest possible root that isolation works with, and fraction bits of the elimination.
ROOT_BITS, FIXED_BITS = 160, 192
BLOCK_ROWS = 4_096
# Exact sums travel as five pieces of 30 bits, the last one signed.
PIECE, PIECES = 30, 5


@dataclass(frozen=True)
class Whitening:
    """What was fitted: row count, sums, eigenvalues of the covariance and unit components (one per column)."""

    n: int
    sums: list[int]
    roots: list[float]
    components: np.ndarray
    explained: list[float | None]
    identity_error: float | None

    def projection(self) -> np.ndarray:
        """Columns that take n * x - S to whitened values; NaN for components of no variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(np.array(self.roots) > 0, 1 / np.sqrt(self.roots), np.nan) / self.n
        return self.components * scale


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vector (double) of rows without NULL or non-finite entries, of the commonest dimension (ties: smaller)."""
    fine = vectors.filter(
        F.col("embedding").isNotNull() & (F.size("embedding") > 0)
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    ).select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    common = fine.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return fine.filter(F.size("vector") == (common["d"] if common else 0))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(rows, floor(1024 * entry) as integers), some thousands of rows at a time; the shift is left out."""
    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(lo, BLOCK_ROWS)
            flat = part.column(part.schema.get_field_index("vector")).flatten().to_numpy(zero_copy_only=False)
            scaled = np.floor(SCALE * flat.reshape(part.num_rows, -1))
            if np.abs(scaled).max() >= 2.0 ** 62:
                raise ValueError("an entry is too large to become a 64-bit integer")
            yield part, scaled.astype(np.int64)


def _limbs(y: np.ndarray) -> list[np.ndarray]:
    """Pieces of 20 bits (the last one signed) as floats: products summed over a block stay exact."""
    out = []
    while np.abs(y).max(initial=0) >= 1 << 20:
        out.append((y & ((1 << 20) - 1)).astype(np.float64))
        y = y >> 20
    return [*out, y.astype(np.float64)]


def block_moments(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums and exact sums of products of integer columns, as Python integers."""
    total = np.zeros(y.shape[1], object)
    gram = np.zeros((y.shape[1],) * 2, object)
    limbs = _limbs(y)
    for a, left in enumerate(limbs):
        total = total + (left.sum(axis=0).astype(np.int64).astype(object) << (20 * a))
        for b, right in enumerate(limbs):
            gram = gram + ((left.T @ right).astype(np.int64).astype(object) << (20 * (a + b)))
    return total, gram


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total, gram = 0, None, None
    for part, y in _blocks(batches):
        one, two = block_moments(y)
        n, total, gram = n + part.num_rows, one if total is None else total + one, two if gram is None else gram + two
    if not n:
        return
    i, j = np.triu_indices(len(total))
    value = np.concatenate([[n], total, gram[i, j]]).astype(object)
    row = np.concatenate([[-1], np.full(len(total), -1), i])
    column = np.concatenate([[-1], np.arange(len(total)), j])
    mask = (1 << PIECE) - 1
    pieces = [(value >> (PIECE * k)) & mask for k in range(PIECES - 1)] + [value >> (PIECE * (PIECES - 1))]
    yield pa.RecordBatch.from_arrays(
        [pa.array(row.astype(np.int32)), pa.array(column.astype(np.int32)), *[pa.array(p.astype(np.int64)) for p in pieces]],
        names=["i", "j", *[f"p{k}" for k in range(PIECES)]])


def moments(vectors: DataFrame) -> tuple[int, list[int], np.ndarray]:
    """Row count, sums and sums of products of the integer columns, all exact."""
    names = [f"p{k}" for k in range(PIECES)]
    parts = vectors.select("vector").mapInArrow(_sums, "i int, j int, " + ", ".join(f"{c} bigint" for c in names))
    rows = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in names]).collect()
    value = {(r["i"], r["j"]): sum(r[c] << (PIECE * k) for k, c in enumerate(names)) for r in rows}
    if not value:
        return 0, [], np.zeros((0, 0), object)
    d = max(j for _, j in value) + 1
    gram = np.array([[value[min(i, j), max(i, j)] for j in range(d)] for i in range(d)], object).reshape(d, d)
    return value[-1, -1], [value[-1, j] for j in range(d)], gram


# --- the polynomial --------------------------------------------------------------------------------

def _is_prime(n: int) -> bool:
    """Exact below 3.2e9 with these bases."""
    d, r = n - 1, 0
    while d % 2 == 0:
        d, r = d // 2, r + 1
    for a in (2, 3, 5, 7):
        x = pow(a, d, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(r - 1)):
            return False
    return True


def primes_for(matrix: np.ndarray) -> list[int]:
    """Primes below 2^31 whose product exceeds twice every coefficient.

    A coefficient is a sum of products of k eigenvalues, none negative, so it is at most C(d, k) (trace / d)^k.
    """
    d, trace = len(matrix), sum(int(matrix[i, i]) for i in range(len(matrix)))
    most = max(math.comb(d, k) * (trace ** k // d ** k + 1) for k in range(d + 1))
    found, product, candidate = [], 1, (1 << 31) - 1
    while product <= 2 * most:
        if _is_prime(candidate):
            found.append(candidate)
            product *= candidate
        candidate -= 2
    return found


def polynomials_mod(matrix: np.ndarray, primes: list[int]) -> np.ndarray:
    """Coefficients (lowest first) of det(x - matrix) modulo each prime, by reduction to Hessenberg form."""
    p = np.array(primes, np.int64)
    h = np.stack([(matrix % q).astype(np.int64) for q in primes])
    count, d = len(p), len(matrix)
    each, m1, m2 = np.arange(count), p[:, None], p[:, None, None]
    for k in range(d - 2):
        pivot = k + 1 + np.argmax(h[:, k + 1:, k] != 0, axis=1)
        row = h[each, pivot].copy()
        h[each, pivot], h[:, k + 1] = h[:, k + 1].copy(), row
        column = h[each, :, pivot].copy()
        h[each, :, pivot], h[:, :, k + 1] = h[:, :, k + 1].copy(), column
        inverse = np.array([pow(int(v), int(q) - 2, int(q)) for v, q in zip(h[:, k + 1, k], p)], np.int64)
        u = h[:, k + 2:, k] * inverse[:, None] % m1
        h[:, k + 2:] = (h[:, k + 2:] - u[:, :, None] * h[:, k + 1][:, None, :] % m2) % m2
        h[:, :, k + 1] = (h[:, :, k + 1] + (h[:, :, k + 2:] * u[:, None, :] % m2).sum(axis=2)) % m1
    poly = np.zeros((count, d + 1, d + 1), np.int64)
    poly[:, 0, 0] = 1
    for k in range(1, d + 1):
        poly[:, k, 1:] = poly[:, k - 1, :-1]
        poly[:, k] = (poly[:, k] - h[:, k - 1, k - 1][:, None] * poly[:, k - 1] % m1) % m1
        if k > 1:
            weight = np.empty((count, k - 1), np.int64)
            run = np.ones(count, np.int64)
            for i in range(k - 1, 0, -1):
                run = run * h[:, i, i - 1] % p
                weight[:, i - 1] = run * h[:, i - 1, k - 1] % p
            poly[:, k] = (poly[:, k] - (weight[:, :, None] * poly[:, :k - 1] % m2).sum(axis=1)) % m1
    return poly[:, d]


def characteristic_polynomial(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """Exact coefficients (lowest first); a Spark task takes a block of primes."""
    primes = primes_for(matrix)
    block = max(1, min(16, (1 << 22) // max(1, len(matrix)) ** 2))
    blocks = [primes[lo:lo + block] for lo in range(0, len(primes), block)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(blocks[b], pa.int64()), pa.array(polynomials_mod(matrix, blocks[b]).tolist(), pa.list_(pa.int64()))],
                    names=["prime", "residues"])

    found = spark.range(0, len(blocks), 1, len(blocks)).mapInArrow(run, "prime bigint, residues array<bigint>").collect()
    product = math.prod(primes)
    out = [0] * (len(matrix) + 1)
    for r in found:
        rest = product // r["prime"]
        one = rest * pow(rest, -1, r["prime"])
        out = [c + one * x for c, x in zip(out, r["residues"])]
    out = [c % product for c in out]
    return [c - product if 2 * c > product else c for c in out]


# --- roots -----------------------------------------------------------------------------------------

def roots_above(poly: list[int], point: int) -> int:
    """How many roots exceed ``point``, repeats counted.

    For a polynomial with real roots only, Descartes' sign changes after a shift are this number exactly.
    """
    c = list(poly)
    for i in range(len(c) - 1):
        for k in range(len(c) - 2, i - 1, -1):
            c[k] += point * c[k + 1]
    signs = [x > 0 for x in c if x]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _value(poly: list[int], point: int) -> int:
    out = 0
    for c in reversed(poly):
        out = out * point + c
    return out


def largest_roots(poly: list[int], bits: int, top: int, wanted: int) -> list[tuple[int, int]]:
    """(root * 2^bits rounded up, repeats) of the largest roots, until ``wanted`` are found; none exceeds ``top``."""
    d = len(poly) - 1
    scaled = [c << (bits * (d - k)) for k, c in enumerate(poly)]
    out: list[tuple[int, int]] = []
    # Intervals (low, high] with the number of roots above each end; the highest on top.
    stack = [(-1, top << bits, d, 0)]
    while stack and sum(m for _, m in out) < wanted:
        low, high, above_low, above_high = stack.pop()
        inside = above_low - above_high
        if not inside:
            continue
        if inside == 1:
            # One root: the sign of a value tells on which side it is, by the number of roots above.
            while high - low > 1:
                middle = (low + high) // 2
                value = _value(scaled, middle)
                if value == 0:
                    low, high = middle - 1, middle
                elif (value < 0) == (above_high % 2 == 1):
                    high = middle
                else:
                    low = middle
            out.append((high, 1))
        elif high - low == 1:
            out.append((high, inside))
        else:
            middle = (low + high) // 2
            above = roots_above(scaled, middle)
            stack += [(low, middle, above_low, above), (middle, high, above, above_high)]
    return out


# --- components ------------------------------------------------------------------------------------

def null_vectors(matrix: np.ndarray, root: int, bits: int, repeats: int) -> np.ndarray:
    """Unit vectors (rows) spanning the null space of matrix - root / 2^bits.

    Gaussian elimination with full pivoting on integers of several hundred bits; pivots that vanish count as one unit, and
    two solves from a fixed start leave nothing but the null space.  A repeated root gives orthogonal vectors.
    """
    d = len(matrix)
    w = np.array([[int(v) << bits for v in row] for row in matrix], object).reshape(d, d)
    for i in range(d):
        w[i, i] -= root
    rows, columns = np.arange(d), np.arange(d)
    factor = np.zeros((d, d), object)
    for k in range(d):
        place = int(np.argmax(np.abs(w[k:, k:])))
        r, c = k + place // (d - k), k + place % (d - k)
        for a in (w, factor):
            a[[k, r]] = a[[r, k]]
        w[:, [k, c]] = w[:, [c, k]]
        rows[[k, r]], columns[[k, c]] = rows[[r, k]], columns[[c, k]]
        if k >= d - repeats or w[k, k] == 0:
            w[k, k] = 1
        factor[k + 1:, k] = (w[k + 1:, k] << FIXED_BITS) // w[k, k]
        w[k + 1:, k + 1:] -= (factor[k + 1:, k][:, None] * w[k, k + 1:][None, :]) >> FIXED_BITS
        if k >= d - repeats:
            factor[k + 1:, k] = 0
            w[k, k + 1:] = 0

    def solve(v: np.ndarray) -> np.ndarray:
        v = v[rows].copy()
        for k in range(d - 1):
            v[k + 1:] -= (factor[k + 1:, k] * v[k]) >> FIXED_BITS
        for k in range(d - 1, -1, -1):
            v[k] = (v[k] << FIXED_BITS) // w[k, k]
            v[:k] -= (w[:k, k] * v[k]) >> FIXED_BITS
        out = np.empty(d, object)
        out[columns] = v
        most = max(1, max(abs(x) for x in out))
        return (out << FIXED_BITS) // most

    found: list[np.ndarray] = []
    rng = np.random.default_rng(12)
    for _ in range(repeats):
        v = rng.integers(-(1 << 30), 1 << 30, d).astype(object) << (FIXED_BITS - 30)
        v = solve(solve(v))
        unit = np.array([float(x / (1 << FIXED_BITS)) for x in v])
        unit /= np.linalg.norm(unit)
        for _ in range(2):
            for other in found:
                unit = unit - (unit @ other) * other
            unit /= np.linalg.norm(unit)
        found.append(unit * np.sign(unit[np.argmax(np.abs(unit))]))
    return np.array(found)


def _components(spark: SparkSession, matrix: np.ndarray, roots: list[tuple[int, int]], bits: int) -> np.ndarray:
    """Unit components as columns, a Spark task for each different root; zeros for roots that are zero."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                root, repeats = roots[k]
                found = null_vectors(matrix, root, bits, repeats) if root else np.zeros((repeats, len(matrix)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k] * len(found), pa.int32()), pa.array(range(len(found)), pa.int32()),
                     pa.array(found.tolist(), pa.list_(pa.float64()))], names=["k", "repeat", "vector"])

    found = spark.range(0, len(roots), 1, len(roots)).mapInArrow(run, "k int, repeat int, vector array<double>").collect()
    return np.array([r["vector"] for r in sorted(found, key=lambda r: (r["k"], r["repeat"]))]).T


# --- fitting and applying --------------------------------------------------------------------------

def _centred(y: np.ndarray, model: Whitening) -> np.ndarray:
    """n * x - S, exact; Python integers where 64 bits might not hold it."""
    most = model.n * int(np.abs(y).max(initial=0)) + max(map(abs, model.sums))
    if most < 1 << 62:
        return model.n * y - np.array(model.sums, np.int64)
    return model.n * y.astype(object) - np.array(model.sums, object)


def _spread(t: np.ndarray) -> list[int | None]:
    """Exact sums of squares of rows; None where a long cannot hold it."""
    if t.dtype != object and t.shape[1] * int(np.abs(t).max(initial=0)) ** 2 < 1 << 63:
        return (t * t).sum(axis=1).tolist()
    exact = t.astype(object)
    return [v if v < 1 << 63 else None for v in (exact * exact).sum(axis=1)]


def _identity_error(vectors: DataFrame, model: Whitening) -> float | None:
    """Largest entry, in size, of the whitened covariance minus the identity, over components with variance."""
    some = [k for k, e in enumerate(model.roots) if e > 0]
    if not some:
        return None
    projection = model.projection()[:, some]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, product = np.zeros(len(some)), np.zeros((len(some),) * 2)
        for _, y in _blocks(batches):
            w = _centred(y, model).astype(np.float64) @ projection
            total, product = total + w.sum(axis=0), product + w.T @ w
        i, j = np.triu_indices(len(some))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([np.full(len(some), -1), i]).astype(np.int32)),
             pa.array(np.concatenate([np.arange(len(some)), j]).astype(np.int32)),
             pa.array(np.concatenate([total, product[i, j]]))], names=["i", "j", "value"])

    rows = vectors.select("vector").mapInArrow(run, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))
    value = {(r["i"], r["j"]): r["value"] / model.n for r in rows.collect()}
    return max(abs(v - value[-1, i] * value[-1, j] - (i == j)) for (i, j), v in value.items() if i >= 0)


def fit(good: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Whitening of the rows of ``usable``; None for an empty table."""
    n, sums, gram = moments(good)
    if not n:
        return None
    spark = good.sparkSession
    scatter = n * gram - np.outer(np.array(sums, object), np.array(sums, object))
    d = len(sums)
    wanted = min(components, d)
    trace = sum(int(scatter[i, i]) for i in range(d))
    if not trace:
        return Whitening(n, sums, [0.0] * wanted, np.zeros((d, wanted)), [None] * wanted, None)
    bits = max(0, ROOT_BITS - trace.bit_length())
    roots = largest_roots(characteristic_polynomial(spark, scatter), bits, trace, wanted)
    axes = _components(spark, scatter, roots, bits)[:, :wanted]
    each = [r for r, m in roots for _ in range(m)][:wanted]
    model = Whitening(n, sums, [r / ((n * n) << bits) for r in each], axes, [r / (trace << bits) for r in each], None)
    return Whitening(n, sums, model.roots, axes, model.explained, _identity_error(good, model))


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error: a row for each used vector and component.

    ``vectors`` has vec_id and embedding.  Vectors that are NULL, empty, hold NULL or non-finite entries, or have another
    dimension than most take no part; zero vectors do.  Rows that repeat a vec_id, or have none, are rows of their own.  Components
    without variance get NULL in ``whitened``; without any variance ``explained`` and ``identity_error`` are NULL too.
    ``deviation`` is NULL where 64 bits cannot hold it.  Entries of 2^52 or more in size raise.  Other columns are ignored.
    An empty table gives no rows.
    """
    good = usable(vectors)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = (f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, "
              "identity_error double")
    model = fit(good, components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    projection, wide = model.projection(), len(model.roots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, y in _blocks(batches):
            t = _centred(y, model)
            value = (t.astype(np.float64) @ projection).reshape(-1)
            rows = part.num_rows
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(np.repeat(np.arange(rows), wide))),
                 pa.array(np.tile(np.arange(1, wide + 1), rows).astype(np.int32)), pa.array(np.full(rows * wide, model.n)),
                 pa.array([v for v in _spread(t) for _ in range(wide)], pa.int64()),
                 pa.array(value, pa.float64(), mask=np.isnan(value)),
                 pa.array(model.explained * rows, pa.float64()), pa.array([model.identity_error] * (rows * wide), pa.float64())],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return good.mapInArrow(run, schema)
