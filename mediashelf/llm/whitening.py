"""Embedding whitening: principal components of integer vectors from the exact characteristic polynomial of their scatter."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediashelf.session import cut_lineage

#: Binary places of a root below the scatter's units, and decimal digits of the arithmetic in which its vector is found.
PLACES, DIGITS = 128, 120

#: Steps of inverse iteration; each gains about as many places as PLACES has.
ITERATIONS = 3

#: Vectors multiplied at a time.
ROWS = 4_096


@dataclass(frozen=True)
class Whitening:
    """n vectors with their sums, and per component a unit direction, its eigenvalue and its share of the trace."""

    n: int
    sums: tuple[int, ...]
    directions: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray


def quantised(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """(key, v array<long>): floor(scale * c) + shift of each component as double.

    Vectors that are null, hold a null or a non-finite component, or one whose number isn't a long are left out; null keys stay.
    """
    c = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    fits = F.coalesce(F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) * F.lit(float(scale)) < F.lit(2.0**62), F.lit(False))), F.lit(False))
    return vectors.where(fits).select(key, F.transform(c, lambda x: x + F.lit(shift)).alias("v"))


def _rows(column: pa.ListArray) -> np.ndarray:
    """Vectors of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _less(x: np.ndarray, origin: np.ndarray) -> np.ndarray:
    """x - origin in whole numbers of any size."""
    if len(x) and max(abs(int(x.max())), abs(int(x.min())), *(abs(int(o)) for o in origin)) >= 1 << 61:
        return x.astype(object) - origin.astype(object)
    return x - origin


def _products(y: np.ndarray) -> np.ndarray:
    """The sum of y's outer products, exactly: by floating point or long arithmetic where no sum can leave it."""
    top = max(abs(int(y.max())), abs(int(y.min())))
    if top * top * len(y) < 1 << 53:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    if top * top * len(y) < 1 << 62:
        return (y.T @ y).astype(object)
    return y.astype(object).T @ y.astype(object)


def scatter(vectors: DataFrame, dims: int) -> tuple[int, list[int], list[list[int]]]:
    """n, S and the matrix n * sum(x x') - S S' of vectors (v array<long>) with `dims` components, in whole numbers.

    Every task adds up its vectors' products, less an origin (any one vector: the matrix doesn't depend on it); Spark adds the tasks' sums
    number by number. The driver gets dims * (dims + 1) / 2 + dims + 1 numbers.
    """
    first = vectors.head()
    if first is None:
        return 0, [0] * dims, [[0] * dims for _ in range(dims)]
    origin = np.array(first["v"], np.int64)
    upper = np.triu_indices(dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, np.zeros(dims, object), np.zeros((dims, dims), object)
        for b in batches:
            x = _rows(b.column(0))
            for at in range(0, len(x), ROWS):
                y = _less(x[at : at + ROWS], origin)
                n, s, q = n + len(y), s + y.astype(object).sum(axis=0), q + _products(y)
        if n:
            values = [n, *s, *q[upper]]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))], names=["i", "value"])

    sums = vectors.select("v").mapInArrow(run, "i int, value decimal(38,0)").groupBy("i").agg(F.sum("value").alias("value"))
    values = [int(r["value"]) for r in sums.orderBy("i").collect()]
    n, s, q = values[0], values[1 : dims + 1], values[dims + 1 :]
    m = [[0] * dims for _ in range(dims)]
    for i, j, x in zip(*upper, q, strict=True):
        m[i][j] = m[j][i] = n * x - s[i] * s[j]
    return n, [a + n * int(o) for a, o in zip(s, origin, strict=True)], m


def residues(matrix: np.ndarray, p: int) -> np.ndarray:
    """The characteristic polynomial modulo a prime p < 2^31 of a matrix of residues, lowest power first.

    Similarity by row and column steps brings the matrix to Hessenberg form, whose leading minors obey a short recurrence.
    """
    h, d = matrix.copy(), len(matrix)
    for j in range(d - 2):
        below = np.flatnonzero(h[j + 1 :, j])
        if not len(below):
            continue
        i, k = j + 1 + below[0], j + 1
        h[[i, k]] = h[[k, i]]
        h[:, [i, k]] = h[:, [k, i]]
        u = h[k + 1 :, j] * pow(int(h[k, j]), -1, p) % p
        h[k + 1 :] = (h[k + 1 :] - u[:, None] * h[k]) % p
        h[:, k] = (h[:, k] + (h[:, k + 1 :] * u % p).sum(axis=1)) % p
    minors = np.zeros((d + 1, d + 1), np.int64)
    minors[0, 0] = 1
    for k in range(d):
        t = np.zeros(k + 1, np.int64)  # h[i, k] times the subdiagonal from i to k
        run = 1
        for i in range(k, -1, -1):
            t[i] = h[i, k] * run % p
            run = run * int(h[i, i - 1]) % p if i else 0
        minors[k + 1, 1:] = minors[k, :-1]
        minors[k + 1] = (minors[k + 1] - (t[:, None] * minors[: k + 1] % p).sum(axis=0)) % p
    return minors[d]


def _primes(beyond: int) -> list[int]:
    """The largest primes below 2^31 whose product exceeds `beyond`."""
    out, product, q = [], 1, (1 << 31) - 1
    while product <= beyond:
        # a strong test to these bases is a proof below 3,215,031,751
        odd, twos = q - 1, 0
        while odd % 2 == 0:
            odd, twos = odd // 2, twos + 1
        if all((x := pow(a, odd, q)) in (1, q - 1) or any((x := x * x % q) == q - 1 for _ in range(twos - 1)) for a in (2, 3, 5, 7)):
            out.append(q)
            product *= q
        q -= 2
    return out


def characteristic_polynomial(spark, matrix: list[list[int]]) -> list[int]:
    """The coefficients of det(x I - matrix), lowest power first, for a positive semidefinite matrix of whole numbers.

    Prime by prime in Spark tasks, joined by Chinese remaindering. The coefficient of x^(d - k) is a symmetric function of
    eigenvalues that add up to the trace, at most binomial(d, k) * (trace / d)^k, which says how many primes are enough.
    """
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    bound = max((math.comb(d, k) * trace**k // d**k for k in range(1, d + 1)), default=0) + 1
    primes = _primes(2 * bound)
    held = spark.sparkContext.broadcast(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ps = b.column(0).to_pylist()
            out = [residues(np.array([[x % p for x in row] for row in held.value], np.int64), p).tolist() for p in ps]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int64()))], names=["p", "c"])

    parts = spark.createDataFrame([(p,) for p in primes], "p long").repartition(min(len(primes), spark.sparkContext.defaultParallelism))
    found = parts.mapInArrow(run, "p long, c array<long>").collect()  # as many numbers as the polynomial has digits
    total, modulus = [0] * (d + 1), 1
    for r in found:
        inverse = pow(modulus, -1, r["p"])
        total = [t + modulus * ((c - t) * inverse % r["p"]) for t, c in zip(total, r["c"], strict=True)]
        modulus *= r["p"]
    return [t - modulus if 2 * t > modulus else t for t in total]


def largest_roots(coefficients: list[int], most: int, places: int = PLACES) -> list[tuple[int, int]]:
    """(floor of 2^places * root, multiplicity) of the largest positive roots, falling, until `most` are told, of a polynomial without other than real, non-negative roots.

    Shifted by t, such a polynomial has exactly as many changes of sign as roots above t: halving isolates roots by whole numbers alone. A
    single root is then halved in by signs. Roots that aren't told apart at the last place count as one.
    """
    zero = next((i for i, c in enumerate(coefficients) if c), len(coefficients))
    c = [x << places * (len(coefficients) - 1 - i) for i, x in enumerate(coefficients)][zero:]
    if len(c) < 2:
        return []

    def above(t: int) -> int:
        s = list(c)
        for i in range(len(s) - 1):
            for j in range(len(s) - 2, i - 1, -1):
                s[j] += t * s[j + 1]
        signs = [x > 0 for x in s if x]
        return sum(a != b for a, b in zip(signs, signs[1:], strict=False))

    def value(t: int) -> int:
        v = 0
        for x in reversed(c):
            v = v * t + x
        return v

    high = -c[-2] // c[-1] + 1  # no root is above their sum
    out, stack = [], [(0, high, above(0), 0)]  # roots above the ends; a root r lies in low < r <= high
    while stack and sum(m for _, m in out) < most:
        low, high, a, b = stack.pop()
        if a == b:
            continue
        if a - b == 1:
            end = value(high)  # of the sign right of the root, if it isn't the root
            while end and high - low > 1:
                mid = (low + high) // 2
                v = value(mid)
                low, high = (mid, mid) if v == 0 else (low, mid) if (v > 0) == (end > 0) else (mid, high)
            out.append((low if end else high, 1))
        elif high - low == 1:
            out.append((low, a - b))
        else:
            mid = (low + high) // 2
            m = above(mid)
            stack += [(low, mid, a, m), (mid, high, m, b)]
    return out


def null_vectors(matrix: list[list[int]], root: int, count: int, places: int = PLACES, digits: int = DIGITS) -> np.ndarray:
    """`count` orthonormal vectors of the null space of matrix - root / 2^places, by inverse iteration in decimals of `digits` digits.

    The shift is a root to `places` places, so one step of iteration all but leaves the null space; a block of `count` starts serves a multiple root.
    """
    with localcontext() as context:
        context.prec = digits
        d = len(matrix)
        shift = Decimal(root) / (1 << places)
        a = np.array([[Decimal(x) for x in row] for row in matrix], object)
        a[range(d), range(d)] -= shift
        tiny = max(abs(Decimal(matrix[i][i])) for i in range(d)) * Decimal(10) ** (-digits // 2)
        b = np.array([[Decimal(float(x)) for x in row] for row in np.random.default_rng(13).standard_normal((d, count))], object)
        order = []
        for k in range(d):
            i = k + int(np.argmax(np.abs(a[k:, k])))
            order.append(i)
            a[[k, i]] = a[[i, k]]
            if abs(a[k, k]) < tiny:
                a[k, k] = tiny
            a[k + 1 :, k] = a[k + 1 :, k] / a[k, k]
            a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k], a[k, k + 1 :])
        for _ in range(ITERATIONS):
            for k, i in enumerate(order):
                b[[k, i]] = b[[i, k]]
            for k in range(d):
                b[k + 1 :] -= np.outer(a[k + 1 :, k], b[k])
            for k in range(d - 1, -1, -1):
                b[k] = b[k] / a[k, k]
                b[:k] -= np.outer(a[:k, k], b[k])
            for j in range(count):
                for i in range(j):
                    b[:, j] -= b[:, i] * (b[:, i] @ b[:, j])
                b[:, j] /= (b[:, j] @ b[:, j]).sqrt()
        return b.T.astype(np.float64)


def fit(vectors: DataFrame, components: int = 8) -> Whitening | None:
    """The leading components of vectors (v array<long>, all of one length) whose variance isn't zero; None without vectors.

    The driver holds the scatter and its polynomial, numbers that depend on the length of the vectors, never on how many there are;
    the polynomial's halving takes about dims^2 operations on numbers of dims^2 digits, so lengths of some hundred are practical.
    """
    size = vectors.select(F.size("v").alias("d")).head()
    if size is None:
        return None
    dims = size["d"]
    n, sums, m = scatter(vectors, dims)
    trace = sum(m[i][i] for i in range(dims))
    roots = largest_roots(characteristic_polynomial(vectors.sparkSession, m), components) if trace else []
    directions = [null_vectors(m, root, times) for root, times in roots]
    values = [Decimal(root) / (1 << PLACES) for root, times in roots for _ in range(times)][:components]
    none = np.zeros((0, dims))
    return Whitening(
        n, tuple(sums), np.concatenate([none, *directions])[:components],
        np.array([float(v / n / n) for v in values]), np.array([float(v / trace) for v in values]),
    )


def apply(vectors: DataFrame, model: Whitening, key: str = "vec_id") -> DataFrame:
    """(key, deviation long, whitened array<double>): each vector's squared distance from the mean times n, and its whitened components.

    A deviation that isn't a long is null.
    """
    ship = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = ship.value
        scale = (m.directions / (m.n * np.sqrt(m.eigenvalues))[:, None]).T
        most = max(abs(v) for v in m.sums)
        for b in batches:
            x = _rows(b.column(1))
            dev = x * m.n - np.array(m.sums) if len(x) and max(abs(int(x.max())), abs(int(x.min()))) * m.n + most < 1 << 62 else x.astype(object) * m.n - np.array(m.sums, object)
            far = (dev * dev).sum(axis=1)  # right modulo 2^64 at least: the rest is told by its size
            large = np.flatnonzero((dev.astype(np.float64) ** 2).sum(axis=1) > 2.0**62)
            far = far.astype(object) if len(large) else far
            for i in large:
                far[i] = sum(int(v) ** 2 for v in dev[i])
            white = dev.astype(np.float64) @ scale
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * white.shape[1], pa.int32()), pa.array(white.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f if f < 1 << 63 else None for f in far.tolist()], pa.int64()), rows], names=[key, "deviation", "whitened"])

    source = vectors.select(key, "v")
    schema = source.select(key, F.lit(None).cast("long").alias("deviation"), F.array(F.lit(0.0)).alias("whitened")).schema
    return source.mapInArrow(run, schema)


def identity_error(whitened: DataFrame, components: int) -> float:
    """The largest absolute entry of the whitened vectors' covariance (divisor n, centred first) less the identity."""
    w = [F.col("whitened")[i] for i in range(components)]
    mean = whitened.agg(*(F.avg(x).alias(f"m{i}") for i, x in enumerate(w))).head()
    centred = [x - F.lit(m) for x, m in zip(w, mean, strict=True)]
    pairs = [(i, j) for i in range(components) for j in range(i + 1)]
    cov = whitened.agg(*(F.avg(centred[i] * centred[j]).alias(f"c{i}_{j}") for i, j in pairs)).head()
    return max(abs(c - (i == j)) for c, (i, j) in zip(cov, pairs, strict=True))


def whiten(vectors: DataFrame, key: str = "vec_id", components: int = 8) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): every vector on every leading component.

    `vectors` is (key, v array<long>). The fit is over all vectors; components of no variance aren't whitened, so fewer than
    `components` come back where the vectors have a lower rank, and none if they are all equal. Equal eigenvalues have any
    orthonormal basis of their space. Vectors that haven't the commonest length (ties: the longer) take no part. Repeated rows count each
    time; null keys are kept; no vectors, no rows; other columns play no part.
    """
    spark = vectors.sparkSession
    sizes = vectors.where("v is not null").groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), F.col("d").desc()).head()
    held = vectors.select(key, "v").where(F.size("v") == F.lit(sizes["d"] if sizes else 0))
    model = fit(held, components) if sizes and sizes["d"] else None
    k = 0 if model is None else len(model.eigenvalues)
    kind = held.select(
        key, F.lit(1).alias("component"), *(F.lit(0).cast("long").alias(c) for c in ("n", "deviation")), *(F.lit(0.0).alias(c) for c in ("whitened", "explained", "identity_error"))
    ).schema
    if not k:
        return spark.createDataFrame([], kind)
    rows = cut_lineage(apply(held, model, key))
    error = identity_error(rows, k)
    share = F.array(*(F.lit(float(e)) for e in model.explained))
    each = rows.select(key, "deviation", F.posexplode("whitened").alias("_llm_at", "whitened"))
    return each.select(
        key, (F.col("_llm_at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        share[F.col("_llm_at")].alias("explained"), F.lit(error).alias("identity_error"),
    )
