"""Whitening of integer vectors along exact principal components.

Tasks sum the products of their vectors in limbs of 20 bits, which floating-point products of
matrices hold exactly, so the scatter matrix M = n sum(x x^T) - S S^T is an exact integer matrix,
n^2 times the covariance. Its characteristic polynomial is computed modulo many primes, each by
reduction to Hessenberg form in a task of its own, and put together by Chinese remaindering.
All roots of the polynomial are real, so the sign changes in its Taylor coefficients at a point
count the roots above the point exactly, multiples included: that isolates the largest roots,
and bisection refines them to FRACTION bits after the point. Each component is a null vector of
M - root, found by inverse iteration in fixed-point integers of FRACTION + GUARD bits.

What the driver holds grows with the dimension only: the scatter matrix and the polynomial.
Counting roots costs about dimension^2 additions of integers of some 100 bits a dimension, so
the method suits vectors of up to a few hundred entries.

Defined results
* Rows whose vector is null, holds null or non-finite entries or an entry beyond 64 bits once
  scaled are dropped; so are empty vectors and those not of the most frequent length (of several
  such lengths, the least).
* Components of eigenvalue 0 don't exist, so equal vectors or a single row give no row at all.
* Components that share an eigenvalue exactly are some orthonormal basis of their space, the
  same for all rows. The largest entry of a component is positive (of equal ones, the first).
* Repeated rows and null ids each stay a row. Extra columns are ignored. Empty table: no row.
* A deviation of more than 38 digits is null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.llm.common import written

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
LIMB = 20
#: Products of two limbs, so many at most, stay below 2^53.
BLOCK_ROWS = 1 << 12
FLUSH = 256
FRACTION = 96
GUARD = 160
PRIME_BITS = 31
NO_LIMB = -1


def integer_vectors(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id and x (array of long) of the rows that remain."""
    scaled = lambda c: F.lit(float(SCALE)) * c.cast("double")
    fits = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(scaled(c)) < 2.0**62)
    able = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, fits)
    whole = lambda c: F.floor(scaled(c)).cast("long") + F.lit(SHIFT).cast("long")
    x = F.when(able, F.transform(vector, whole))
    kept = rows.select(F.col(vec_id).alias("vec_id"), x.alias("x")).filter("x is not null")
    lengths = kept.groupBy(F.size("x").alias("length")).count().orderBy(F.desc("count"), "length").first()
    return kept.filter(F.size("x") == (lengths["length"] if lengths else 0))


def matrix_of(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def limbs_of(y: np.ndarray) -> list[np.ndarray]:
    """y as sum of limb[k] 2^(20 k); all but the last limb are in [0, 2^20)."""
    out = []
    while True:
        if (np.abs(y) <= 1 << LIMB).all():
            return [*out, y.astype(np.float64)]
        out.append((y & ((1 << LIMB) - 1)).astype(np.float64))
        y = y >> LIMB


def scatter_parts(vectors: DataFrame) -> DataFrame:
    """Sums over all rows of limb products: one, two (limb numbers), i, j, total.

    Rows with two = NO_LIMB sum limbs of entry i; one = two = NO_LIMB counts the rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            for (one, two), total in held.items():
                i, j = np.indices(total.shape)
                keep = np.ones(total.shape, bool) if one != two or two == NO_LIMB else i <= j
                n = int(keep.sum())
                columns = [np.full(n, one, np.int32), np.full(n, two, np.int32), i[keep].astype(np.int32), j[keep].astype(np.int32), total[keep]]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["one", "two", "i", "j", "part"])
            held.clear()

        blocks = 0
        for batch in batches:
            x = matrix_of(batch.column(0))
            for at in range(0, len(x), BLOCK_ROWS):
                limbs = limbs_of(x[at : at + BLOCK_ROWS] - SHIFT)
                sums = {(NO_LIMB, NO_LIMB): np.array([[len(limbs[0])]])}
                for a, left in enumerate(limbs):
                    sums[a, NO_LIMB] = left.sum(axis=0, keepdims=True).T
                    for b in range(a, len(limbs)):
                        sums[a, b] = left.T @ limbs[b]
                for key, value in sums.items():
                    held[key] = held.get(key, 0) + value.astype(np.int64)
                blocks += 1
                if blocks % FLUSH == 0:
                    yield from flushed()
        yield from flushed()

    parts = vectors.select("x").mapInArrow(run, "one int, two int, i int, j int, part long")
    return parts.groupBy("one", "two", "i", "j").agg(F.sum(F.col("part").cast("decimal(38, 0)")).alias("total"))


def scatter(vectors: DataFrame) -> tuple[int, list[int], np.ndarray]:
    """n, sums S of the entries, and the integer matrix n sum(x x^T) - S S^T."""
    found = scatter_parts(vectors).collect()
    n = next((int(r.total) for r in found if r.one == NO_LIMB), 0)
    size = 1 + max((r.i for r in found), default=-1)
    sums = [0] * size
    products = np.zeros((size, size), object)
    for r in found:
        if r.one == NO_LIMB:
            continue
        if r.two == NO_LIMB:
            sums[r.i] += int(r.total) << LIMB * r.one
            continue
        value = int(r.total) << LIMB * (r.one + r.two)
        products[r.i, r.j] += value
        # The mirror image: of the same limbs off the diagonal, of two limbs always.
        if r.one != r.two or r.i != r.j:
            products[r.j, r.i] += value
    s = np.array(sums, object)
    return n, [v + n * SHIFT for v in sums], n * products - np.outer(s, s)


def primes_below(limit: int, count: int) -> list[int]:
    """The `count` largest primes below the limit, by sieving windows downwards."""
    small = np.ones(math.isqrt(limit) + 1, bool)
    small[:2] = False
    for p in range(2, math.isqrt(len(small)) + 1):
        if small[p]:
            small[p * p :: p] = False
    out: list[int] = []
    high, width = limit, 1 << 16
    while len(out) < count:
        window = np.ones(width, bool)
        low = high - width
        for p in np.flatnonzero(small).tolist():
            window[-low % p :: p] = False
        out += (low + np.flatnonzero(window)[::-1]).tolist()
        high = low
    return out[:count]


def polynomial_mod(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients, constant first, of det(t - matrix) modulo p (below 2^31)."""
    h = matrix.astype(np.int64) % p
    size = len(h)
    for j in range(size - 2):
        below = np.flatnonzero(h[j + 1 :, j])
        if not len(below):
            continue
        pivot = j + 1 + int(below[0])
        if pivot != j + 1:
            h[[j + 1, pivot]] = h[[pivot, j + 1]]
            h[:, [j + 1, pivot]] = h[:, [pivot, j + 1]]
        factors = h[j + 2 :, j] * pow(int(h[j + 1, j]), -1, p) % p
        # Subtract multiples of one row from those below, and add the columns back to keep similarity.
        h[j + 2 :] = (h[j + 2 :] - factors[:, None] * h[j + 1][None, :] % p) % p
        h[:, j + 1] = (h[:, j + 1] + (h[:, j + 2 :] * factors[None, :] % p).sum(axis=1)) % p
    found = [np.zeros(size + 1, np.int64)]
    found[0][0] = 1
    for k in range(size):
        new = np.roll(found[k], 1) - int(h[k, k]) * found[k] % p
        product = 1
        for i in range(k - 1, -1, -1):
            product = product * int(h[i + 1, i]) % p
            if not product:
                break
            new -= (product * int(h[i, k]) % p) * found[i] % p
        found.append(new % p)
    return found[size].tolist()


def polynomial(spark, matrix: np.ndarray) -> list[int]:
    """Coefficients, constant first, of the characteristic polynomial, exactly."""
    size, trace = len(matrix), int(sum(matrix.diagonal()))
    # By Maclaurin's inequality for eigenvalues that are not negative.
    mean = -(-trace // size)
    bound = max(math.comb(size, k) * mean**k for k in range(size + 1))
    count = (2 * bound + 1).bit_length() // (PRIME_BITS - 1) + 1
    moduli = primes_below(1 << PRIME_BITS, count)
    held = spark.sparkContext.broadcast((matrix, moduli))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, primes = held.value
        for batch in batches:
            for number in batch.column(0).to_pylist():
                rest = polynomial_mod(np.array(whole % primes[number], np.int64), primes[number])
                yield pa.RecordBatch.from_pydict({"number": [number], "rest": pa.array([rest], pa.list_(pa.int64()))})

    tasks = max(1, min(count, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rests = spark.range(0, count, 1, tasks).mapInArrow(run, "number long, rest array<long>").collect()
    total, product = [0] * (size + 1), 1
    for row in sorted(rests, key=lambda r: r.number):
        p = moduli[row.number]
        inverse = pow(product, -1, p)
        total = [t + product * ((r - t) * inverse % p) for t, r in zip(total, row.rest)]
        product *= p
    return [t - product if 2 * t > product else t for t in total]


class Roots:
    """The roots of a polynomial that has real roots only, none below 0."""

    def __init__(self, coefficients: list[int], fraction: int = FRACTION) -> None:
        size = len(coefficients) - 1
        self.zeros = next(k for k, c in enumerate(coefficients) if c)
        kept = coefficients[self.zeros :]
        # In units of 2^-fraction, so that all places are integers.
        self.scaled = [c << fraction * (len(kept) - 1 - k) for k, c in enumerate(kept)]
        self.positive = size - self.zeros
        self.top = (abs(kept[-2]) << fraction) + 1 if self.positive else 0
        self.counts: dict[int, int] = {}

    def above(self, place: int) -> int:
        """How many roots, by multiplicity, are above the place: sign changes of Taylor coefficients."""
        if place not in self.counts:
            c = list(self.scaled)
            for k in range(len(c) - 1):
                for i in range(len(c) - 2, k - 1, -1):
                    c[i] += place * c[i + 1]
            signs = [v > 0 for v in c if v]
            self.counts[place] = sum(a != b for a, b in zip(signs, signs[1:]))
        return self.counts[place]

    def sign(self, place: int) -> int:
        value = 0
        for c in reversed(self.scaled):
            value = value * place + c
        return (value > 0) - (value < 0)

    def largest(self, count: int) -> list[int]:
        """The places of the largest roots, each with its multiplicity, rounded up to a unit."""
        out = []
        for nth in range(1, min(count, self.positive) + 1):
            low = max((p for p, n in self.counts.items() if n >= nth), default=0)
            high = min((p for p, n in self.counts.items() if n < nth), default=self.top)
            while high - low > 1 and not (self.above(low) == nth and self.above(high) == nth - 1):
                middle = (low + high) // 2
                low, high = (middle, high) if self.above(middle) >= nth else (low, middle)
            # A single root between: signs tell the side.
            at_high = self.sign(high)
            while high - low > 1 and at_high:
                middle = (low + high) // 2
                side = self.sign(middle)
                if not side:
                    high = middle
                    break
                low, high = (low, middle) if side == at_high else (middle, high)
            out.append(high)
        return out


def null_vectors(matrix: np.ndarray, root: int, count: int, fraction: int = FRACTION) -> list[list[float]]:
    """`count` orthonormal vectors that matrix - root sends next to zero: inverse iteration."""
    bits, size = fraction + GUARD, len(matrix)
    a = np.array([[int(v) << bits for v in row] for row in matrix], object)
    for i in range(size):
        a[i, i] -= root << bits - fraction
    order, factors = list(range(size)), []
    for k in range(size):
        pivot = k + max(range(size - k), key=lambda i: abs(a[k + i, k]))
        a[[k, pivot]] = a[[pivot, k]]
        order[k], order[pivot] = order[pivot], order[k]
        for done in factors:
            done[k], done[pivot] = done[pivot], done[k]
        a[k, k] = a[k, k] or 1
        column = np.zeros(size, object)
        column[k + 1 :] = (a[k + 1 :, k] << bits) // a[k, k]
        a[k + 1 :, k:] -= column[k + 1 :, None] * a[k, k:][None, :] >> bits
        factors.append(column)

    def solved(b: np.ndarray) -> np.ndarray:
        z = b[order].copy()
        for k in range(size):
            z[k + 1 :] -= factors[k][k + 1 :] * z[k] >> bits
        for k in range(size - 1, -1, -1):
            z[k] = ((z[k] << bits) - int((a[k, k + 1 :] * z[k + 1 :]).sum() if k + 1 < size else 0)) // a[k, k]
        return z

    rng = np.random.default_rng(size)
    found = [np.array([int(v) << bits for v in rng.integers(1, 1 << 20, size)], object) for _ in range(count)]
    for _ in range(3):
        ready: list[np.ndarray] = []
        for vector in map(solved, found):
            vector = unit(vector, bits)
            for other in ready:
                vector = vector - (int((vector * other).sum()) * other >> 2 * bits)
            ready.append(unit(vector, bits))
        found = ready
    out = []
    for vector in found:
        first = max(range(size), key=lambda i: (abs(vector[i]), -i))
        sign = -1 if vector[first] < 0 else 1
        out.append([sign * int(v) / (1 << bits) for v in vector])
    return out


def unit(vector: np.ndarray, bits: int) -> np.ndarray:
    length = math.isqrt(int((vector * vector).sum())) or 1
    return (vector << bits) // length


@dataclass(frozen=True)
class Whitening:
    """What whitens a row: counts, sums, components (rows), eigenvalues and their shares."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: list[float]
    explained: list[float]


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The components of the vectors (vec_id, x); None if they don't vary."""
    spark = vectors.sparkSession
    n, sums, matrix = scatter(vectors)
    trace = int(sum(matrix.diagonal())) if n else 0
    if not trace:
        return None
    roots = Roots(polynomial(spark, matrix)).largest(components)
    distinct = sorted(set(roots), reverse=True)
    held = spark.sparkContext.broadcast((matrix, [(r, roots.count(r)) for r in distinct]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, wanted = held.value
        for batch in batches:
            for number in batch.column(0).to_pylist():
                found = null_vectors(whole, *wanted[number])
                yield pa.RecordBatch.from_pydict(
                    {"number": [number] * len(found), "entries": pa.array(found, pa.list_(pa.float64()))}
                )

    tasks = spark.range(0, len(distinct), 1, len(distinct)).mapInArrow(run, "number long, entries array<double>")
    rows = sorted(tasks.collect(), key=lambda r: r.number)
    one = 1 << FRACTION
    return Whitening(
        n,
        sums,
        np.array([r.entries for r in rows]),
        [r / (one * n * n) for r in roots],
        [r / (one * trace) for r in roots],
    )


def projected(vectors: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, deviation and whitened (an array with an entry for each component)."""
    held = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        whole, rest = zip(*(divmod(s, m.n) for s in m.sums))
        base, part = np.array(whole, np.int64), np.array(rest, np.float64) / m.n
        axes = (m.components / np.sqrt(np.array(m.eigenvalues))[:, None]).T
        constant = sum(r * r for r in rest)
        for batch in batches:
            if not batch.num_rows:
                continue
            off = matrix_of(batch.column(1)) - base
            far = int(np.abs(off).max())
            kind = np.int64 if far * max(far, max(rest)) * len(rest) < 1 << 62 else object
            wide = off.astype(kind)
            squares, mixed = (wide * wide).sum(axis=1).tolist(), (wide * np.array(rest, kind)).sum(axis=1).tolist()
            deviation = [m.n * m.n * a - 2 * m.n * b + constant for a, b in zip(squares, mixed)]
            shown = [Decimal(d) if d < 10**38 else None for d in deviation]
            white = (off.astype(np.float64) - part) @ axes
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(shown, pa.decimal128(38, 0)), pa.array(list(white), pa.list_(pa.float64()))],
                ["vec_id", "deviation", "whitened"],
            )

    return vectors.select(F.col("vec_id").cast("long"), "x").mapInArrow(
        run, "vec_id long, deviation decimal(38,0), whitened array<double>"
    )


def identity_error(rows: DataFrame, components: int) -> float:
    """The largest absolute entry of the covariance of `whitened` minus the identity."""
    entry = lambda i: F.get("whitened", F.lit(i))
    cells: list[Column] = [
        F.abs(F.covar_pop(entry(i), entry(j)) - float(i == j)) for i in range(components) for j in range(i, components)
    ]
    return max(v for v in rows.agg(*cells).first())


def whiten(
    rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every row and component."""
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    vectors = integer_vectors(rows, vec_id, vector)
    model = fit(vectors, components)
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    white = written(projected(vectors, model), "whitened")
    error = identity_error(white, len(model.eigenvalues))
    shares = F.array(*map(F.lit, model.explained))
    listed = white.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return listed.select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("place")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
