"""Whitening of embeddings by the exact characteristic polynomial of their integer scatter (operator 11).

Entries become integers u = floor(1024 c); a shift by a constant, as in x = u + 100000, leaves every covariance
as it is. With n vectors, sums s and products P = sum of u u', the matrix A = n P - s s' is n * n times the
covariance, in integers.

1. One pass adds up s and P: a task sums its batches exactly, Spark adds the tasks' sums per entry.
2. The characteristic polynomial of A is found modulo as many 31-bit primes as its coefficients need, each
   by reduction to Hessenberg form, primes dealt over tasks; Chinese remaindering joins them. One more prime checks the result.
3. A is symmetric, so all roots are real, and the sign changes in the coefficients of p(x + a) are exactly
   the number of roots above a (rule of Descartes). Bisection by that count isolates each distinct root of the
   square-free part; signs at midpoints narrow it, far below the distance to its neighbours. Multiplicities are differences of counts.
4. Per distinct root, inverse iteration with A - root * I in fixed-point integers finds its null space, a
   vector per multiplicity, orthonormal; roots are dealt over tasks.
5. A second pass projects every vector; a third over that table measures the covariance.

What passes through the driver are d * d sums, a polynomial of degree d and k vectors: bounded by
the length d of the vectors, however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction
from math import comb, isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from takemark.llm.common import Scratch, small_batches

#: Entries are multiplied by this and rounded down.
UNITS = 1024
#: Integers of a larger size than this don't fit a long with all that is done to them.
LARGEST = float(1 << 62)
_WORD = 1 << 64


# Integer polynomials: lists of coefficients, the constant first.


def primes_below(top: int, n: int) -> list[int]:
    """The n largest primes below top, which is at most 2 ** 31."""

    def prime(m: int) -> bool:
        odd, twos = m - 1, 0
        while odd % 2 == 0:
            odd, twos = odd // 2, twos + 1
        for base in (2, 3, 5, 7):  # enough below 3.2e9
            x = pow(base, odd, m)
            if x in (1, m - 1):
                continue
            for _ in range(twos - 1):
                x = x * x % m
                if x == m - 1:
                    break
            else:
                return False
        return True

    found, m = [], top - 1 if top % 2 == 0 else top - 2
    while len(found) < n:
        if prime(m):
            found.append(m)
        m -= 2
    return found


def charpoly_mod(a: np.ndarray, p: int) -> np.ndarray:
    """Coefficients modulo p, the constant first, of det(x I - a); a has entries from 0 to p - 1, p < 2 ** 31."""
    h, d = a.copy(), len(a)
    for k in range(d - 2):
        below = np.flatnonzero(h[k + 1 :, k])
        if not len(below):
            continue
        at = k + 1 + int(below[0])
        if at != k + 1:
            h[[k + 1, at]] = h[[at, k + 1]]
            h[:, [k + 1, at]] = h[:, [at, k + 1]]
        f = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - f[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * f % p).sum(1)) % p
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for k in range(1, d + 1):
        polys[k, 1:] = polys[k - 1, :-1]
        polys[k] = (polys[k] - h[k - 1, k - 1] * polys[k - 1]) % p
        along = 1
        for i in range(1, k):
            along = along * int(h[k - i, k - i - 1]) % p
            if not along:
                break
            polys[k] = (polys[k] - int(h[k - i - 1, k - 1]) * along % p * polys[k - i - 1]) % p
    return polys[d]


def joined_residues(primes: list[int], residues: list[list[int]]) -> list[int]:
    """The integers of least size with these residues modulo each prime."""
    value, modulus = [0] * len(residues[0]), 1
    for p, row in zip(primes, residues, strict=True):
        inverse = pow(modulus % p, -1, p)
        value = [v + modulus * ((int(r) - v) * inverse % p) for v, r in zip(value, row, strict=True)]
        modulus *= p
    return [v - modulus if 2 * v > modulus else v for v in value]


def _divided(a: list[int], b: list[int]) -> tuple[list[Fraction], list[Fraction]]:
    rest, quotient = [Fraction(x) for x in a], [Fraction(0)] * max(1, len(a) - len(b) + 1)
    for k in range(len(a) - len(b), -1, -1):
        f = rest[k + len(b) - 1] / b[-1]
        quotient[k] = f
        for i, x in enumerate(b):
            rest[k + i] -= f * x
    rest = rest[: len(b) - 1]
    while rest and not rest[-1]:
        rest.pop()
    return quotient, rest


def _whole(poly: list[Fraction]) -> list[int]:
    """The multiple of poly with integer coefficients without a common factor and a positive last one."""
    scale = int(np.lcm.reduce([x.denominator for x in poly], dtype=object))
    out = [int(x * scale) for x in poly]
    common = int(np.gcd.reduce(out, dtype=object)) or 1
    return [x // common if out[-1] > 0 else -x // common for x in out]


def _common_mod(a: list[int], b: list[int], p: int) -> int:
    """Degree of the common divisor modulo p."""
    a, b = ([x % p for x in c] for c in (a, b))
    while True:
        while b and not b[-1]:
            b.pop()
        if not b:
            return len(a) - 1
        inverse = pow(b[-1], -1, p)
        while len(a) >= len(b):
            f = a[-1] * inverse % p
            for i, x in enumerate(b):
                a[len(a) - len(b) + i] = (a[len(a) - len(b) + i] - f * x) % p
            a.pop()
        a, b = b, a


def square_free(poly: list[int]) -> list[int]:
    """poly with each of its roots once."""
    slope = [k * x for k, x in enumerate(poly)][1:]
    # No common divisor modulo a prime that keeps the degree proves that there is none.
    if not slope or any(poly[-1] % p and slope[-1] % p and _common_mod(poly, slope, p) == 0 for p in primes_below(1 << 31, 3)):
        return poly
    a, b = poly, slope
    while b:
        _, rest = _divided(a, b)
        a, b = b, _whole(rest) if rest else []
    return _whole(_divided(poly, a)[0])


def _at(poly: list[int], num: int, shift: int) -> list[int]:
    """Coefficients, but for positive factors, of poly(x + num / 2 ** shift)."""
    c = [x << (shift * (len(poly) - 1 - k)) for k, x in enumerate(poly)]
    for i in range(len(c) - 1):
        for k in range(len(c) - 2, i - 1, -1):
            c[k] += num * c[k + 1]
    return c


def roots_above(poly: list[int], num: int, shift: int = 0) -> int:
    """How many roots, by multiplicity, of a polynomial with real roots only are above num / 2 ** shift."""
    signs = [x > 0 for x in _at(poly, num, shift) if x]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _sign(poly: list[int], num: int, shift: int) -> int:
    value = 0
    for k, c in enumerate(reversed(poly)):
        value = value * num + (c << (shift * k))
    return (value > 0) - (value < 0)


@dataclass(frozen=True)
class Root:
    """A root above lo / 2 ** shift, or equal to it where lo is hi, and at most hi / 2 ** shift; above: distinct roots beyond it; times: its multiplicity."""

    lo: int
    hi: int
    shift: int
    above: int
    times: int

    def middle(self) -> Fraction:
        return Fraction(self.lo + self.hi, 2 << self.shift)


def _halved(free: list[int], r: Root) -> Root:
    lo, hi, shift = (r.lo, r.hi, r.shift) if r.hi - r.lo > 1 else (2 * r.lo, 2 * r.hi, r.shift + 1)
    mid = (lo + hi) // 2
    sign = _sign(free, mid, shift)
    if not sign:
        return Root(mid, mid, shift, r.above, r.times)
    # Right of all roots free is positive; the sign changes at each of them.
    within = sign > 0 if r.above % 2 else sign < 0
    return Root(mid, hi, shift, r.above, r.times) if within else Root(lo, mid, shift, r.above, r.times)


def largest_roots(poly: list[int], k: int, bits: int = 160) -> list[Root]:
    """The largest positive roots, in falling order, of a polynomial with real roots only, none negative, as many as make k by multiplicity.

    Each interval is narrower than 2 ** -bits of its root and than 2 ** -64 of the distance to the next root.
    """
    zeros = next(i for i, c in enumerate(poly) if c)
    poly = poly[zeros:]
    free = square_free(poly)
    top = (-poly[-2] // poly[-1] + 1).bit_length() if len(poly) > 1 else 0  # no root is larger than the sum of all
    stack = [(0, 1 << top, 0, roots_above(free, 0), 0)]  # (lo, hi], and how many distinct roots are above lo and above hi
    found: list[Root] = []
    while stack and sum(r.times for r in found[:-1]) < k:  # one root more than wanted, for the distance
        lo, hi, shift, beyond_lo, beyond_hi = stack.pop()
        if beyond_lo - beyond_hi == 1:
            found.append(Root(lo, hi, shift, beyond_hi, roots_above(poly, lo, shift) - roots_above(poly, hi, shift)))
        elif beyond_lo > beyond_hi:
            if hi - lo < 2:
                lo, hi, shift = 2 * lo, 2 * hi, shift + 1
            mid = (lo + hi) // 2
            beyond = roots_above(free, mid, shift)
            stack += [(lo, mid, shift, beyond_lo, beyond), (mid, hi, shift, beyond, beyond_hi)]

    def settled(i: int) -> bool:
        r = found[i]
        width = Fraction(r.hi - r.lo, 1 << r.shift)
        gaps = [Fraction(a.lo, 1 << a.shift) - Fraction(b.hi, 1 << b.shift) for a, b in zip(found[max(0, i - 1) : i + 1], found[i : i + 2]) if a is not b]
        return width * (1 << bits) <= Fraction(r.lo, 1 << r.shift) and all(width * _WORD <= g for g in gaps)

    while waiting := [i for i in range(len(found)) if not settled(i)]:
        for i in waiting:
            found[i] = _halved(free, found[i])
    while len(found) > 1 and sum(r.times for r in found[:-1]) >= k:
        found.pop()
    return found


def null_vectors(a: np.ndarray, root: Root, rounds: int = 3) -> np.ndarray:
    """Orthonormal rows that span the null space of a - root * I, to double precision; a holds Python integers."""
    d, places = len(a), 2 * root.shift + 192
    one = 1 << places
    lu = a * one
    value = root.middle()
    for i in range(d):
        lu[i, i] -= value.numerator * one // value.denominator
    order = np.arange(d)
    for k in range(d):
        at = k + int(np.argmax(np.abs(lu[k:, k])))
        lu[[k, at]], order[[k, at]] = lu[[at, k]], order[[at, k]]
        if not lu[k, k]:
            lu[k, k] = 1
        if k + 1 < d:
            f = (lu[k + 1 :, k] << places) // lu[k, k]
            lu[k + 1 :, k] = f
            lu[k + 1 :, k + 1 :] -= (f[:, None] * lu[k, k + 1 :]) >> places

    def solved(b: np.ndarray) -> np.ndarray:
        y = b[order]
        for i in range(1, d):
            y[i] -= (lu[i, :i] @ y[:i]) >> places
        for i in range(d - 1, -1, -1):
            rest = y[i] - ((lu[i, i + 1 :] @ y[i + 1 :] >> places) if i + 1 < d else 0)
            y[i] = (rest << places) // lu[i, i]
        largest = max(abs(x) for x in y).bit_length()
        return y << (places - largest) if largest < places else y >> (largest - places)

    vectors = [np.array([int(x) for x in row], object) << (places - 30) for row in np.random.default_rng(11).integers(1, 1 << 30, (root.times, d))]
    for _ in range(rounds):
        done: list[np.ndarray] = []
        for v in map(solved, vectors):
            for w in done + done:
                v = v - (((v @ w) >> places) * w >> places)
            done.append((v << places) // isqrt(v @ v))
        vectors = done
    out = np.array([[x / one for x in v] for v in vectors])
    return out * np.sign(out[np.arange(len(out)), np.argmax(np.abs(out), 1)])[:, None]


@dataclass(frozen=True)
class Whitening:
    """n, sums and trace of the integers u; per component its root of A and unit vector, and explained, its share of the variance."""

    n: int
    sums: list[int]
    roots: list[Fraction]
    vectors: np.ndarray
    explained: list[float]


def usable(vector: Column) -> Column:
    """Whether a vector isn't null and all its entries are numbers whose integers fit."""
    return vector.isNotNull() & F.forall(vector.cast("array<double>"), lambda x: F.coalesce(F.abs(x) < LARGEST / UNITS, F.lit(False)))


def _integers(column: pa.ListArray, d: int) -> np.ndarray:
    return np.floor(np.asarray(column.flatten()).reshape(len(column), d) * UNITS).astype(np.int64)


def _scatter(vectors: DataFrame, d: int) -> list[list[int]]:
    """Sums of products of all pairs of (u, 1), exact: n is the last."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d + 1, d + 1), object)
        for batch in batches:
            u = np.column_stack([_integers(batch.column(0), d), np.ones(batch.num_rows, np.int64)])
            size = int(np.abs(u).max(initial=0)) ** 2 * len(u)
            u = u.astype(float if size < 1 << 53 else np.int64 if size < 1 << 62 else object)
            product = u.T @ u
            total = total + (product.astype(np.int64) if product.dtype == float else product).astype(object)
        i, j = np.triu_indices(d + 1)
        flat, kind = total[i, j].tolist(), pa.decimal128(38, 0)
        if total[d, d]:
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array([Decimal(int(x) // _WORD) for x in flat], kind), pa.array([Decimal(int(x) % _WORD) for x in flat], kind)], ["i", "j", "high", "low"])

    parts = vectors.mapInArrow(added, "i long, j long, high decimal(38,0), low decimal(38,0)")
    out = [[0] * (d + 1) for _ in range(d + 1)]
    for r in parts.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect():
        out[r.i][r.j] = out[r.j][r.i] = int(r.high) * _WORD + int(r.low)
    return out


def characteristic_polynomial(spark: SparkSession, a: np.ndarray) -> list[int]:
    """Coefficients, the constant first, of det(x I - a) for a symmetric a without negative roots, of Python integers."""
    d, trace = len(a), int(a.trace())
    largest = max(comb(d, k) * trace**k // d**k + 1 for k in range(d + 1))  # a symmetric function of roots is largest where all are equal
    count = (2 * largest).bit_length() // 30 + 2  # the primes are above 2 ** 30
    primes = primes_below(1 << 31, count)
    whole = spark.sparkContext.broadcast(a)

    def reduced(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"prime": frame["prime"], "residues": [charpoly_mod((whole.value % p).astype(np.int64), p) for p in frame["prime"].tolist()]})

    dealt = spark.createDataFrame([(p,) for p in primes], "prime long").repartition(min(count, spark.sparkContext.defaultParallelism))
    rows = {r.prime: r.residues for r in dealt.mapInPandas(reduced, "prime long, residues array<long>").collect()}
    poly = joined_residues(primes[:-1], [rows[p] for p in primes[:-1]])
    if any(c % primes[-1] != r for c, r in zip(poly, rows[primes[-1]], strict=True)):
        raise ArithmeticError("the characteristic polynomial fails its check modulo one more prime")
    return poly


def fit(vectors: DataFrame, d: int, k: int) -> Whitening:
    """vectors: one column of usable vectors of length d."""
    spark = vectors.sparkSession
    sums = _scatter(vectors, d)
    n, s = sums[d][d], sums[d][:d]
    a = np.array([[n * sums[i][j] - s[i] * s[j] for j in range(d)] for i in range(d)], object).reshape(d, d)
    trace = int(a.trace()) if d else 0
    if not trace:
        return Whitening(n, s, [], np.zeros((0, d)), [])
    roots = largest_roots(characteristic_polynomial(spark, a), k)
    whole, held = spark.sparkContext.broadcast(a), spark.sparkContext.broadcast(roots)

    def solved(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in frame["root"].tolist():
                found = null_vectors(whole.value, held.value[i])
                yield pd.DataFrame({"root": i, "place": range(len(found)), "vector": list(found)})

    dealt = spark.createDataFrame([(i,) for i in range(len(roots))], "root long").repartition(len(roots))
    rows = sorted(dealt.mapInPandas(solved, "root long, place long, vector array<double>").collect())[:k]
    values = [roots[r.root].middle() for r in rows]
    return Whitening(n, s, values, np.array([r.vector for r in rows]), [float(v / trace) for v in values])


def whiten(table: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = 8) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for every vector that takes part and every component up to k.

    Vectors that are null or hold null or non-finite entries take no part, nor do those with entries of 2 ** 52 or more.
    Covariances need one length: vectors take part that have the most frequent one, ties to the longer. Components
    are those with a positive eigenvalue, so a constant or empty table has none and gives no rows. Equal
    eigenvalues share a null space; any orthonormal basis of it will do, and reruns find the same.
    Repeated rows count as often as they occur; a null id is kept. Other columns are not read. deviation is exact,
    as decimal(38,0); null where it needs more digits.
    """
    spark = table.sparkSession
    rows = table.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v")).where(usable(F.col("v")))
    length = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), F.desc("d")).first()
    d = length.d if length else 0
    rows = rows.where(F.size("v") == d)
    with small_batches(spark, 4096), Scratch(spark) as s:
        model = fit(rows.select("v"), d, k)
        n, sums = model.n, np.array(model.sums, object)
        small = np.array([x / n for x in model.sums]) if n else np.zeros(d)
        # (u - s / n) on a unit vector over the root of (root / n ** 2)
        weights = (model.vectors / np.array([[Decimal(r.numerator) / Decimal(r.denominator)] for r in model.roots], object).astype(float).reshape(-1, 1) ** 0.5 * n).T
        largest = max((abs(x) for x in model.sums), default=0)

        def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                u = _integers(batch.column(1), d)
                fits = d * (n * int(np.abs(u).max(initial=0)) + largest) ** 2 < 1 << 62
                off = (n * u - sums.astype(np.int64)) if fits else n * u.astype(object) - sums
                deviation = [Decimal(int(x)) if x < 10**38 else None for x in (off * off).sum(1)]
                w = (u - small) @ weights
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviation, pa.decimal128(38, 0)), pa.array(list(w), pa.list_(pa.float64()))], ["id", "deviation", "w"])

        schema = rows.select("id").schema.add("deviation", "decimal(38,0)").add("w", ArrayType(DoubleType()))
        if not model.roots:
            rows = rows.limit(0)
        done = s.keep(rows.mapInArrow(projected, schema), "whitened")
        m = len(model.roots)
        pairs = [F.abs(F.covar_pop(F.col("w")[i], F.col("w")[j]) - (1.0 if i == j else 0.0)) for i in range(m) for j in range(i, m)]
        error = done.agg(F.greatest(*pairs, F.lit(0.0))).first()[0] if pairs else 0.0
    explained = F.array(*map(F.lit, model.explained)) if m else F.array().cast("array<double>")
    return done.select(F.col("id").alias(id_col), F.lit(n).cast("long").alias("n"), "deviation", F.posexplode("w").alias("place", "whitened")).select(
        id_col, (F.col("place") + 1).alias("component"), "n", "deviation", "whitened", F.get(explained, F.col("place")).alias("explained"), F.lit(error).alias("identity_error")
    )
