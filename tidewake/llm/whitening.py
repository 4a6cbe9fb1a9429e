"""Whitening of embeddings from the exact characteristic polynomial of their integer scatter matrix.

Components are quantised to whole numbers x = floor(scale * c). The fit list is each distinct x vector once, n of them, with
sums S and moments M; their scatter n * M - S S' (n squared times the covariance) is a matrix of whole numbers, and nothing of
it is rounded:

* tasks sum moments exactly (floats of 20-bit limbs, in passes that a float holds), Spark adds the tasks' parts;
* the scatter's characteristic polynomial is worked out modulo 31-bit primes, a share of the primes a task, by reduction to
  Hessenberg form; the residues meet by Chinese remaindering. All roots are real and none is negative, so the elementary
  symmetric sums are at most C(d, k) (trace / d)^k, which says how many primes are enough;
* as all roots are real, the sign changes of the polynomial moved to a count the roots above a exactly, with multiplicity:
  halving isolates the largest roots, and the sign of the polynomial narrows single ones to 2^-200 of their size;
* each component spans the null space of scatter - root, found by inverse iteration in 100 decimal digits against the
  components before it, so equal or nearly equal roots get orthonormal components too.

What goes through the driver is of the size of the matrix (d by d), whatever the number of rows.

Vectors that are null or empty or hold null or non-finite entries take no part. All vectors have one length: if several
occur, the one with most distinct vectors counts (the longer of equals) and rows of another length have no result. Values
of scale * c beyond a long count as the nearest long. Repeated rows and null vec_ids are results of their own. Only
components with a positive eigenvalue exist: a table of one distinct vector gives no rows, like an empty table. A deviation
beyond a long is null.
"""

from __future__ import annotations

import decimal
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.llm.common import written

#: Bits of a limb, and rows whose products of limbs a float sums without loss: 2 * 20 + 13 = 53.
LIMB, ROWS = 20, 1 << 13
#: Bits of the limbs in which tasks hand over their sums.
PART = 32
#: Bits to which roots are narrowed, against their size, and the digits of the inverse iteration.
ROOT_BITS, DIGITS = 200, 100


def quantised(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id and x (array<long>) of the vectors that take part."""
    c = F.transform("embedding", lambda v: v.cast("double"))
    odd = F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    held = vectors.select("vec_id", "embedding").where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~odd)
    return held.select("vec_id", F.transform(c, lambda v: F.floor(v * scale)).alias("x"))


def _matrices(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of the batches of ROWS rows at most, with their x as a matrix."""
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            part = b.slice(at, ROWS)
            yield part, part.column(part.schema.get_field_index("x")).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def moments(x: np.ndarray) -> np.ndarray:
    """x' x as Python integers, for ROWS rows at most."""
    limbs, rest = [], x
    while True:
        last = not len(rest) or (rest.min() >= -(1 << LIMB) and rest.max() < 1 << LIMB)
        limbs.append((rest if last else rest & ((1 << LIMB) - 1)).astype(float))
        if last:
            break
        rest = rest >> LIMB
    out = np.zeros((x.shape[1], x.shape[1]), object)
    for i, a in enumerate(limbs):
        for j, b in enumerate(limbs):
            out += (a.T @ b).astype(np.int64).astype(object) << (LIMB * (i + j))
    return out


def _handed_over(cells: Iterator[tuple[int, int, int]]) -> pa.RecordBatch:
    """(i, j, value) with any whole value, as rows of limbs that Spark can sum as longs."""
    rows = []
    for i, j, v in cells:
        sign, v, limb = (1, int(v), 0) if v >= 0 else (-1, -int(v), 0)
        while v:
            rows.append((i, j, limb, sign * (v & ((1 << PART) - 1))))
            v, limb = v >> PART, limb + 1
    i, j, limb, v = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.record_batch([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(limb, pa.int32()), pa.array(v, pa.int64())], ["i", "j", "limb", "v"])


def scatter(fit: DataFrame, dim: int) -> tuple[int, list[int], np.ndarray]:
    """n, the sums and n squared times the covariance of the x vectors of fit, exactly."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(dim, object), np.zeros((dim, dim), object)
        for _, x in _matrices(batches, dim):
            n += len(x)
            sums += ((x >> PART).sum(0).astype(object) << PART) + (x & ((1 << PART) - 1)).sum(0).astype(object)
            products += moments(x)
        if n:
            yield _handed_over([(-1, -1, n), *((-1, j, s) for j, s in enumerate(sums)), *((i, j, products[i, j]) for i in range(dim) for j in range(i, dim))])

    n, sums, products = 0, [0] * dim, np.zeros((dim, dim), object)
    for r in fit.mapInArrow(part, "i int, j int, limb int, v long").groupBy("i", "j", "limb").agg(F.sum("v").alias("v")).collect():
        v = r["v"] << (PART * r["limb"])
        if r["j"] < 0:
            n += v
        elif r["i"] < 0:
            sums[r["j"]] += v
        else:
            products[r["i"], r["j"]] += v
            if r["i"] != r["j"]:
                products[r["j"], r["i"]] += v
    s = np.array(sums, object)
    return n, sums, n * products - np.outer(s, s)


def _is_prime(p: int) -> bool:
    """Miller-Rabin; the bases decide every p below 2^32."""
    odd, twos = p - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 7, 61):
        y = pow(base, odd, p)
        if y in (1, p - 1):
            continue
        for _ in range(twos - 1):
            y = y * y % p
            if y == p - 1:
                break
        else:
            return False
    return True


def primes_for(trace: int, dim: int) -> list[int]:
    """31-bit primes whose product exceeds every coefficient of a characteristic polynomial without negative roots."""
    most = max(math.comb(dim, k) * (-(-trace**k // dim**k)) for k in range(dim + 1))
    out, product, p = [], 1, (1 << 31) - 1
    while product <= most:
        if _is_prime(p):
            out.append(p)
            product *= p
        p -= 2
    return out


def polynomial_modulo(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(t - matrix) modulo p, the constant first: similar Hessenberg form, then its leading minors."""
    h = (matrix % p).astype(np.int64)
    d = len(h)
    for k in range(d - 2):
        rows = np.flatnonzero(h[k + 1 :, k])
        if not len(rows):
            continue
        pivot = k + 1 + int(rows[0])
        if pivot != k + 1:
            h[[k + 1, pivot]] = h[[pivot, k + 1]]
            h[:, [k + 1, pivot]] = h[:, [pivot, k + 1]]
        factor = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - factor[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * factor % p).sum(1)) % p
    minors = np.zeros((d + 1, d + 1), np.int64)
    minors[0, 0] = 1
    for k in range(d):
        row = np.zeros(d + 1, np.int64)
        row[1:] = minors[k, :-1]
        row = (row - int(h[k, k]) * minors[k] % p) % p
        chain = 1
        for i in range(k - 1, -1, -1):
            chain = chain * int(h[i + 1, i]) % p
            if not chain:
                break
            row = (row - (int(h[i, k]) * chain % p) * minors[i] % p) % p
        minors[k + 1] = row
    return minors[d]


def characteristic_polynomial(spark, matrix: np.ndarray) -> list[int]:
    """Coefficients of det(t - matrix), the constant first, for a symmetric matrix of whole numbers without negative roots."""
    d = len(matrix)
    primes = primes_for(sum(matrix.diagonal()), d)

    def residues(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column(0).to_pylist():
                yield pa.record_batch([pa.array([k]), pa.array([polynomial_modulo(matrix, primes[k]).tolist()])], ["id", "c"])

    tasks = max(1, min(len(primes) // 8, spark.sparkContext.defaultParallelism))
    rows = spark.range(0, len(primes), 1, tasks).mapInArrow(residues, "id long, c array<long>").collect()
    product = math.prod(primes)
    out = [0] * (d + 1)
    for r in rows:
        p = primes[r["id"]]
        rest = product // p
        share = rest * pow(rest, -1, p)
        for k, c in enumerate(r["c"]):
            out[k] += share * c
    return [x % product if (d - k) % 2 == 0 else -(-x % product) for k, x in enumerate(out)]


def roots_above(poly: list[int], num: int, bits: int) -> int:
    """Roots above num / 2^bits, with multiplicity: sign changes after the move, exact as all roots are real."""
    d = len(poly) - 1
    c = [x << (bits * (d - k)) for k, x in enumerate(poly)]
    for i in range(d):
        for j in range(d - 1, i - 1, -1):
            c[j] += num * c[j + 1]
    signs = [x > 0 for x in c if x]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def _sign(poly: list[int], num: int, bits: int) -> int:
    value, scale = 0, 0
    for x in reversed(poly):
        value = value * num + (x << scale)
        scale += bits
    return (value > 0) - (value < 0)


def largest_roots(poly: list[int], k: int) -> list[tuple[int, int]]:
    """The k largest positive roots with multiplicity, falling, each as (num, bits) within 2^-ROOT_BITS of its size."""
    if len(poly) < 2:
        return []
    top = max(1, -poly[-2])  # the trace: no root is above it
    out: list[tuple[int, int]] = []
    for i in range(1, min(k, roots_above(poly, 0, 0)) + 1):
        low, high, bits, above_high = 0, top, 0, 0  # the i-th largest root is in (low, high]
        single = False
        while True:
            if high - low == 1:
                if low and low.bit_length() > ROOT_BITS:
                    break
                low, high, bits = low << 8, high << 8, bits + 8
            mid = (low + high) // 2
            if single:
                s = _sign(poly, mid, bits)
                low, high = (mid, high) if s and s == below else (low, mid)
                continue
            n = roots_above(poly, mid, bits)
            if n >= i:
                low, inside = mid, n
            else:
                high, above_high, inside = mid, n, roots_above(poly, low, bits)
            if low and inside - above_high == 1:
                below = -1 if above_high % 2 == 0 else 1  # the sign just below the root; above all roots it is positive
                single = _sign(poly, low, bits) == below
        out.append((low + high, bits + 1))
    return out


def null_vectors(matrix: np.ndarray, roots: list[tuple[int, int]]) -> np.ndarray:
    """A unit vector for each root (columns), orthogonal to those before it, by inverse iteration; its largest entry is positive."""
    d, found = len(matrix), []
    with decimal.localcontext(decimal.Context(prec=DIGITS, Emin=-(10**6), Emax=10**6)):
        tiny = Decimal(10) ** (-DIGITS) * Decimal(int(max(matrix.diagonal())))
        for num, bits in roots:
            root = Decimal(num) / Decimal(2) ** bits
            a = np.array([[Decimal(int(v)) for v in row] for row in matrix], object)
            for i in range(d):
                a[i, i] -= root
            order = list(range(d))
            for i in range(d):  # rows are exchanged for the largest pivot; factors stay below the diagonal
                best = max(range(i, d), key=lambda r: abs(a[r, i]))
                if best != i:
                    a[[i, best]] = a[[best, i]]
                    order[i], order[best] = order[best], order[i]
                if abs(a[i, i]) < tiny:
                    a[i, i] = tiny
                a[i + 1 :, i] = a[i + 1 :, i] / a[i, i]
                a[i + 1 :, i + 1 :] -= np.outer(a[i + 1 :, i], a[i, i + 1 :])
            v = np.array([Decimal(1) / Decimal(2 + (i * 7919) % 31) for i in range(d)], object)
            for _ in range(4):
                for _ in range(2):
                    for u in found:
                        v = v - u * (u @ v)
                v = v / (v @ v).sqrt()
                y = v[order]
                for i in range(d):
                    y[i] -= a[i, :i] @ y[:i] if i else 0
                for i in range(d - 1, -1, -1):
                    y[i] = (y[i] - (a[i, i + 1 :] @ y[i + 1 :] if i < d - 1 else 0)) / a[i, i]
                v = y
            for _ in range(2):
                for u in found:
                    v = v - u * (u @ v)
                v = v / (v @ v).sqrt()
            if max(v, key=abs) < 0:
                v = -v
            found.append(v)
    return np.array([[float(x) for x in v] for v in found]).T.reshape(d, len(found))


def whitened(vectors: DataFrame, components: int = 4, scale: int = 256) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error for every vector that takes part."""
    spark = vectors.sparkSession
    rows = quantised(vectors, scale)
    distinct = written(rows.select("x").distinct(), "whiten-fit")
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    lengths = distinct.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    dim = lengths["dim"]
    fit = distinct.where(F.size("x") == dim)
    n, sums, matrix = scatter(fit, dim)
    roots = largest_roots(characteristic_polynomial(spark, matrix), components)
    if not roots:
        return spark.createDataFrame([], schema)
    k, trace = len(roots), int(sum(matrix.diagonal()))
    values = [num / (n * n << bits) for num, bits in roots]
    share = [num / (trace << bits) for num, bits in roots]
    mean, axes = np.array([s / n for s in sums]), null_vectors(matrix, roots) / np.sqrt(values)

    def projected(x: np.ndarray) -> np.ndarray:
        return (x - mean) @ axes

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for _, x in _matrices(batches, dim):
            w = np.column_stack([np.ones(len(x)), projected(x)])
            total += w.T @ w
        i, j = (a.ravel() for a in np.indices(total.shape))
        yield pa.record_batch([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], ["i", "j", "v"])

    moment = np.zeros((k + 1, k + 1))
    for r in fit.mapInArrow(products, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        moment[r["i"], r["j"]] = r["v"] / n
    error = float(np.abs(moment[1:, 1:] - np.outer(moment[0, 1:], moment[0, 1:]) - np.eye(k)).max())
    largest = max(map(abs, sums))

    def deviations(x: np.ndarray) -> pa.Array:
        most = n * int(max(abs(int(x.min())), abs(int(x.max())))) + largest
        if most * most * dim < 2**63:
            return pa.array(((n * x - np.array(sums, np.int64)) ** 2).sum(1))
        exact = ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(1)
        return pa.array([int(v) if v < 2**63 else None for v in exact], pa.int64())

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _matrices(batches, dim):
            every = np.repeat(np.arange(len(x)), k)
            m = len(every)
            columns = [
                part.column(0).take(pa.array(every)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(m, n)), deviations(x).take(pa.array(every)),
                pa.array(projected(x).ravel()), pa.array(np.tile(share, len(x))), pa.array(np.full(m, error)),
            ]
            yield pa.record_batch(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.where(F.size("x") == dim).select(F.col("vec_id").cast("long"), "x").mapInArrow(out, schema)
