"""Whitening of vectors by the exact characteristic polynomial of their integer scatter.

Tasks sum the distinct vectors' scatter in integers. Its characteristic polynomial is taken modulo primes, each in a task,
by reduction to Hessenberg form, and put together by Chinese remainders, so that every coefficient is exact. A polynomial
whose roots are all real has as many roots above a place as the polynomial shifted there has changes of sign: this isolates
every root, in integers, which are then halved to hundreds of bits. The components span the null spaces of the scatter less
its roots, found by inverse iteration in fixed-point numbers, one component a task.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from fieldtrace.llm.common import whole
from fieldtrace.sources.writers import settled

SCALE, OFFSET = 64, 1_000_000
#: Integers beyond count as this: sums of products of millions of vectors then fit in 38 digits.
LIMIT = float(1 << 50)
#: Relative bits within which roots count as one, to which single roots are found, and of the fixed-point numbers.
APART, REFINED, FIXED = 128, 256, 512


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors, near their mean ``centre`` (integers), whose remaining sums are ``rest``; components by falling root."""

    n: int
    centre: np.ndarray
    rest: list[int]
    vectors: np.ndarray
    roots: np.ndarray
    explained: list[float | None]
    identity_error: float | None = None


def shifted(embedding: Column) -> Column:
    """floor(64 * x) + 1,000,000 of each component as a double; null where the vector or a component is null or not finite."""
    values = F.transform(embedding, lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(LIMIT)), F.lit(-LIMIT))) + OFFSET)
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    return F.when(fine, values)


def matrix(vectors: pd.Series, centre: np.ndarray) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.int64) - centre


def gram(z: np.ndarray) -> np.ndarray:
    """z'z in Python's integers: by doubles over so many rows as keep every sum exact."""
    most = int(np.abs(z).max(initial=0))
    out = np.zeros((z.shape[1], z.shape[1]), dtype=object)
    rows = 2**53 // max(1, most * most)
    if rows == 0:
        return out + z.astype(object).T @ z.astype(object)
    for i in range(0, len(z), rows):
        part = z[i : i + rows].astype(np.float64)
        out += (part.T @ part).astype(np.int64).astype(object)
    return out


def summed(fits: DataFrame, terms: Callable[[pd.Series], np.ndarray], kind: str) -> dict[int, int | float]:
    """Sums of the arrays that ``terms`` makes of batches of v: within each task first, then by place over the cluster."""

    def emit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for part in parts:
            if len(part):
                found = terms(part["v"])
                total = found if total is None else total + found
        if total is not None:
            yield pd.DataFrame({"at": np.arange(len(total), dtype=np.int32), "amount": [repr(x) for x in total.tolist()]})

    added = fits.select("v").mapInPandas(emit, "at int, amount string").groupBy("at").agg(F.sum(F.col("amount").cast(kind)).alias("amount"))
    return {r["at"]: r["amount"] for r in added.collect()}


def is_prime(n: int) -> bool:
    """For odd n below 3,215,031,751."""
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for base in (2, 3, 5, 7):
        x = pow(base, d, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(s - 1)):
            return False
    return True


def primes_for(bound: int) -> list[int]:
    """Primes below 2^31, the greatest ones, whose product is above ``bound``."""
    out, product, n = [], 1, 2**31 - 1
    while product <= bound:
        if is_prime(n):
            out.append(n)
            product *= n
        n -= 2
    return out


def polynomial_modulo(m: np.ndarray, p: int) -> np.ndarray:
    """Coefficients, lowest first, of det(x - m) modulo a prime below 2^31; m is int64 in 0..p-1."""
    a, d = m.copy(), len(m)
    for k in range(1, d - 1):
        below = np.flatnonzero(a[k:, k - 1])
        if not len(below):
            continue
        if (i := k + below[0]) != k:
            a[[i, k]] = a[[k, i]]
            a[:, [i, k]] = a[:, [k, i]]
        u = a[k + 1 :, k - 1] * pow(int(a[k, k - 1]), -1, p) % p
        # A similarity: rows lose multiples of row k, and column k gains the columns by the same factors.
        a[k + 1 :] = (a[k + 1 :] - u[:, None] * a[k]) % p
        a[:, k] = (a[:, k] + (a[:, k + 1 :] * u % p).sum(axis=1)) % p
    found = np.zeros((d + 1, d + 1), dtype=np.int64)
    found[0, 0] = 1
    for k in range(1, d + 1):
        found[k, 1:] = found[k - 1, :-1]
        found[k] = (found[k] - a[k - 1, k - 1] * found[k - 1]) % p
        path = 1
        for i in range(k - 1, 0, -1):
            path = path * int(a[i, i - 1]) % p
            found[k] = (found[k] - int(a[i - 1, k - 1]) * path % p * found[i - 1]) % p
    return found[d]


def characteristic(spark: SparkSession, scatter: list[list[int]]) -> list[int]:
    """Exact coefficients of a scatter's characteristic polynomial, lowest first; one task takes a few primes."""
    d, trace = len(scatter), sum(scatter[i][i] for i in range(len(scatter)))
    # Elementary symmetric sums of non-negative roots are largest when all roots are equal.
    bound = max(math.comb(d, k) * trace**k // d**k + 1 for k in range(d + 1))
    primes = primes_for(2 * bound)

    def reduce(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for p in part["p"].tolist():
                m = np.array([[x % p for x in row] for row in scatter], dtype=np.int64)
                yield pd.DataFrame({"p": [p], "c": [polynomial_modulo(m, p).tolist()]})

    slices = min(len(primes), spark.sparkContext.defaultParallelism)
    residues = spark.createDataFrame([(p,) for p in primes], "p long").repartition(slices, "p").mapInPandas(reduce, "p long, c array<long>")
    values, product = [0] * (d + 1), 1
    for r in residues.collect():
        p = r["p"]
        inverse = pow(product, -1, p)
        values = [x + product * ((c - x) * inverse % p) for x, c in zip(values, r["c"])]
        product *= p
    return [x - product if 2 * x > product else x for x in values]


def scaled(poly: list[int], bits: int) -> list[int]:
    """The polynomial whose roots are 2^bits times as large."""
    return [c << (bits * (len(poly) - 1 - k)) for k, c in enumerate(poly)]


def above(poly: list[int], place: int) -> int:
    """Roots above ``place`` of a polynomial that has real roots only: changes of sign after the shift."""
    c = list(poly)
    for i in range(len(c) - 1):
        for j in range(len(c) - 2, i - 1, -1):
            c[j] += place * c[j + 1]
    signs = [x > 0 for x in c if x]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def value(poly: list[int], x: int) -> int:
    out = 0
    for c in reversed(poly):
        out = out * x + c
    return out


def isolated(poly: list[int], k: int, top: int) -> tuple[int, int, int, int]:
    """The k-th largest root, all of them real, above 0 and at most ``top``: (root * 2^bits, bits, first, count).

    ``count`` roots from the ``first``-th on lie within a relative 2^-APART of each other; single ones are found to 2^-REFINED.
    """
    low, high, bits = 0, top, 0
    over_low, over_high, q = above(poly, 0), 0, poly
    while over_low - over_high > 1 and (low == 0 or high - low > low >> APART):
        if high - low == 1:
            low, high, bits = low << 32, high << 32, bits + 32
            q = scaled(poly, bits)
        middle = (low + high) // 2
        n = above(q, middle)
        if n >= k:
            low, over_low = middle, n
        else:
            high, over_high = middle, n
    if over_low - over_high == 1:
        sign = value(q, high)
        while sign and (low == 0 or high - low > low >> REFINED):
            if high - low == 1:
                low, high, bits = low << 32, high << 32, bits + 32
                q = scaled(poly, bits)
            middle = (low + high) // 2
            v = value(q, middle)
            if v == 0 and middle > low:
                high, sign = middle, 0
            elif (v > 0) == (sign > 0):
                high = middle
            else:
                low = middle
    return high, bits, over_high + 1, over_low - over_high


def null_space(scatter: list[list[int]], root: int, bits: int, count: int) -> list[list[float]]:
    """``count`` orthonormal vectors that the scatter less root / 2^bits all but cancels: one step of inverse iteration."""
    d = len(scatter)
    at = root << (FIXED - bits) if bits <= FIXED else root >> (bits - FIXED)
    a = np.array([[x << FIXED for x in row] for row in scatter], dtype=object)
    a[range(d), range(d)] -= at
    rng = random.Random(17)
    b = np.array([[rng.getrandbits(64) << FIXED for _ in range(count)] for _ in range(d)], dtype=object)
    for j in range(d):
        i = j + max(range(d - j), key=lambda r: abs(a[j + r, j]))
        if i != j:
            a[[i, j]], b[[i, j]] = a[[j, i]], b[[j, i]]
        # A pivot that vanishes is where the null space shows: the least number stands for it.
        if a[j, j] == 0:
            a[j, j] = 1
        u = (a[j + 1 :, j] << FIXED) // a[j, j]
        a[j + 1 :, j:] -= (u[:, None] * a[j, j:]) >> FIXED
        b[j + 1 :] -= (u[:, None] * b[j]) >> FIXED
    x = np.zeros((d, count), dtype=object)
    for j in range(d - 1, -1, -1):
        rest = b[j] - ((a[j, j + 1 :, None] * x[j + 1 :]).sum(axis=0) >> FIXED if j + 1 < d else 0)
        x[j] = (rest << FIXED) // a[j, j]
    basis: list[np.ndarray] = []
    for v in x.T:
        for _ in range(2):
            v = (v << FIXED) // max(1, math.isqrt(int((v * v).sum())))
            for w in basis:
                v = v - ((w * int((v * w).sum() >> FIXED)) >> FIXED)
        basis.append((v << FIXED) // max(1, math.isqrt(int((v * v).sum()))))
    # Either sign would do; the first of the largest entries is positive, so that reruns agree.
    return [[float(e / (1 << FIXED)) for e in (v if v[max(range(d), key=lambda i: abs(v[i]))] > 0 else -v)] for v in basis]


def components(spark: SparkSession, scatter: list[list[int]], most: int) -> list[tuple[int, float, list[float]]]:
    """(component, root, unit vector) of the largest roots above 0, by falling root."""
    poly = characteristic(spark, scatter)
    zeros = next(i for i, c in enumerate(poly) if c)
    poly, trace = poly[zeros:], sum(scatter[i][i] for i in range(len(scatter)))
    wanted = min(most, len(poly) - 1)
    if wanted == 0:
        return []

    def find(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for k in part["k"].tolist():
                root, bits, first, count = isolated(poly, k, trace)
                vector = null_space(scatter, root, bits, count)[k - first]
                yield pd.DataFrame({"k": [k], "root": [root / (1 << bits)], "vector": [vector]})

    asked = spark.createDataFrame([(k,) for k in range(1, wanted + 1)], "k int").repartition(wanted, "k")
    found = asked.mapInPandas(find, "k int, root double, vector array<double>").collect()
    return sorted((r["k"], r["root"], list(r["vector"])) for r in found)


def fit(vectors: DataFrame, most: int = 16) -> Whitening | None:
    """The whitening of the distinct vectors of (v array<long>); None if there are none or they have no entries.

    Vectors are as long as most rows' are (of equally many the longer); others, and null ones, take no part.
    """
    spark = vectors.sparkSession
    held = vectors.where("v is not null").select("v")
    size = held.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if size is None or size["size"] == 0:
        return None
    d = size["size"]
    fits = settled(held.where(F.size("v") == d).distinct())
    zero = np.zeros(d, dtype=np.int64)
    sums = summed(fits, lambda v: np.append(matrix(v, zero).astype(object).sum(axis=0), len(v)), "decimal(38,0)")
    n = int(sums[d])
    totals = [int(sums[i]) for i in range(d)]
    # Centred on the mean's whole part before multiplying; what remains of it is taken off exactly below.
    centre = np.array([s // n for s in totals], dtype=np.int64)
    rest = [s - n * int(c) for s, c in zip(totals, centre)]
    upper = np.triu_indices(d)
    products = summed(fits, lambda v: gram(matrix(v, centre))[upper], "decimal(38,0)")
    scatter = [[0] * d for _ in range(d)]
    for at, (i, j) in enumerate(zip(*(x.tolist() for x in upper))):
        scatter[i][j] = scatter[j][i] = n * int(products[at]) - rest[i] * rest[j]
    trace = sum(scatter[i][i] for i in range(d))
    found = components(spark, scatter, most) if trace else []
    roots = np.array([root for _, root, _ in found])
    basis = np.array([v for _, _, v in found], dtype=np.float64).reshape(len(found), d)
    explained = [root / trace for root in roots] + [0.0 if trace else None] * (min(most, d) - len(found))
    model = Whitening(n, centre, rest, basis, roots, explained)
    if not found:
        return model
    k = len(found)
    pairs = np.triu_indices(k)

    def moments(v: pd.Series) -> np.ndarray:
        w = projected(model, matrix(v, centre))
        return np.concatenate([(w.T @ w)[pairs], w.sum(axis=0)])

    seen = summed(fits, moments, "double")
    means = [seen[len(pairs[0]) + i] / n for i in range(k)]
    errors = [abs(seen[at] / n - means[i] * means[j] - (i == j)) for at, (i, j) in enumerate(zip(*(x.tolist() for x in pairs)))]
    return replace(model, identity_error=max(errors))


def centred(model: Whitening, z: np.ndarray) -> np.ndarray:
    """n times the distances from the mean, exact: 64-bit integers where they fit."""
    most = int(np.abs(z).max(initial=0)) * model.n + model.n
    if most * most * z.shape[1] < 2**63:
        return z * model.n - np.array(model.rest, dtype=np.int64)
    return z.astype(object) * model.n - np.array(model.rest, dtype=object)


def projected(model: Whitening, z: np.ndarray) -> np.ndarray:
    """Scatter and distances are n^2 and n times too large: the factors cancel."""
    return centred(model, z).astype(np.float64) @ model.vectors.T / np.sqrt(model.roots)


def whitened(vectors: DataFrame, most: int = 16) -> DataFrame:
    """Each row whose v (array<long>) takes part: doc (struct of all columns), n, deviation, whitened, explained, identity_error.

    deviation is the sum over entries of (n*v - S)^2 as text, exact; whitened (array<double>) holds one value a component,
    explained (array<double>) each component's share of the trace. Components are those of the distinct vectors' covariance
    (divisor n), at most ``most`` and as many as entries; equal roots have any orthonormal basis of their space, the same for
    all rows. Roots of 0 have no unit variance: their whitened values are null and explained is 0, or null if no entry varies;
    identity_error is over the other components and null if there are none. Rows whose v is null, or has another length than
    most rows' v, are dropped; repeated rows are returned one by one but fitted once; an empty table gives no rows. The matrix
    of entries by entries meets in one task: meant for vectors of up to some hundred entries.
    """
    schema = "n long, deviation string, whitened array<double>, explained array<double>, identity_error double"
    model = fit(vectors, most)
    if model is None:
        empty = vectors.select(whole(vectors), *(F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in schema.split(", ")))
        return empty.where("false")
    shared = vectors.sparkSession.sparkContext.broadcast(model)
    width = len(model.explained)

    @pandas_udf("deviation string, whitened array<double>")
    def apply(v: pd.Series) -> pd.DataFrame:
        m = shared.value
        if not len(v):
            return pd.DataFrame({"deviation": [], "whitened": []})
        z = matrix(v, m.centre)
        y = centred(m, z)
        deviation = [str(x) for x in (y * y).sum(axis=1).tolist()]
        values = projected(m, z).tolist() if len(m.roots) else [[] for _ in range(len(v))]
        return pd.DataFrame({"deviation": deviation, "whitened": [x + [None] * (width - len(x)) for x in values]})

    rows = vectors.where(F.col("v").isNotNull() & (F.size("v") == len(model.centre)))
    out = rows.select(whole(rows), apply("v").alias("_w"))
    explained = F.array(*(F.lit(x).cast("double") for x in model.explained))
    return out.select(
        "doc", F.lit(model.n).cast("long").alias("n"), F.col("_w.deviation").alias("deviation"), F.col("_w.whitened").alias("whitened"),
        explained.alias("explained"), F.lit(model.identity_error).cast("double").alias("identity_error"),
    )
