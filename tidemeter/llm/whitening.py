"""Whitening of vectors over exact principal components.

Entries become whole numbers, so the scatter of the distinct vectors is an integer matrix that tasks add up without
rounding. Its characteristic polynomial is found modulo many primes (reduction to Hessenberg form, one prime a row
of a table) and put together by Chinese remaindering. As all its roots are real, the signs of its shifted
coefficients count the roots above a place exactly; bisection isolates each root to ``DIGITS`` bits. Components are
null spaces of the scatter less a root, by inverse iteration in fixed-point numbers of ``BITS`` bits. All rows are
then projected in double precision.

Null vectors and vectors with null or non-finite entries take no part, nor do those whose entries leave the range of
a long. Entries missing at the end of a shorter vector count as 0. Repeated rows and ids are all projected; equal
vectors count once in the fit. Components of variance 0 do not exist: with one distinct vector there are none, and
an empty table gives an empty result. Other columns are not read. Only tables of the size of the scatter matrix
reach the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemeter.llm.common import matrix_of, stored

SCALE, OFFSET = 64, 1_000_000
#: Whole entries stay below this, so that sums of two fit a long.
LARGEST = float(2**61)
#: Entries are added up in digits of so many bits, exactly in doubles for ``ROWS`` rows at a time.
DIGIT, ROWS = 16, 4096
#: Bits to which a root is known, bits of the fixed-point numbers, and bits below which roots count as equal.
DIGITS, BITS, EQUAL = 160, 512, 100
ROUNDS = 4


def whole_vectors(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, y) with y = floor(64 * entry) as longs; the offset, which moves no covariance, is added when rows leave."""
    scaled = F.transform(F.col(vector_column), lambda c: c.cast("double") * SCALE)
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), scaled.alias("z")).where("z IS NOT NULL")
    fits = F.forall("z", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))
    whole = rows.where(F.coalesce(fits, F.lit(False))).select("vec_id", F.transform("z", lambda c: F.floor(c).cast("long")).alias("y"))
    width = whole.agg(F.max(F.size("y"))).first()[0] or 0
    return whole.withColumn("y", F.concat("y", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("y"))))


def _digits(y: np.ndarray) -> list[np.ndarray]:
    """Signed digits of whole numbers, lowest first, as doubles."""
    out, half = [], 1 << (DIGIT - 1)
    while True:
        low = ((y + half) & ((1 << DIGIT) - 1)) - half
        out.append(low.astype(np.float64))
        y = (y - low) >> DIGIT
        if not y.any():
            return out


def scatter(rows: DataFrame, width: int) -> list[list[int]]:
    """Exact sums of products of the vectors with a last entry 1: products, sums and number of rows."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            whole = matrix_of(batch.column(0), width).astype(np.int64)
            for at in range(0, len(whole), ROWS):
                part = whole[at : at + ROWS]
                digits = _digits(np.hstack([part, np.ones((len(part), 1), np.int64)]))
                for i, a in enumerate(digits):
                    for j, b in enumerate(digits):
                        sums[i + j] = sums.get(i + j, 0) + (a.T @ b).astype(np.int64)
        for power, total in sums.items():
            yield pa.RecordBatch.from_pydict({
                "power": pa.array([power] * total.size, pa.int32()),
                "place": pa.array(range(total.size), pa.int32()),
                "part": pa.array(total.ravel(), pa.int64()),
            })

    parts = rows.mapInArrow(add, "power int, place int, part long")
    total = [[0] * (width + 1) for _ in range(width + 1)]
    for r in parts.groupBy("power", "place").agg(F.sum(F.col("part").cast("decimal(20,0)")).alias("part")).collect():
        total[r["place"] // (width + 1)][r["place"] % (width + 1)] += int(r["part"]) << (DIGIT * r["power"])
    return total


def primes(count: int) -> list[int]:
    """Primes downwards from 2**31, told by strong tests to the bases 2, 3, 5 and 7, which decide below 3.2e9."""

    def strong(n: int, base: int) -> bool:
        twos = ((n - 1) & (1 - n)).bit_length() - 1
        x = pow(base, (n - 1) >> twos, n)
        return x in (1, n - 1) or any((x := x * x % n) == n - 1 for _ in range(twos - 1))

    found, n = [], 2**31 - 1
    while len(found) < count:
        if all(strong(n, b) for b in (2, 3, 5, 7)):
            found.append(n)
        n -= 2
    return found


def modular_polynomial(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(x - matrix) modulo a prime below 2**31, constant first."""
    h, d = matrix.copy(), len(matrix)
    for k in range(d - 2):
        below = np.flatnonzero(h[k + 1 :, k])
        if not len(below):
            continue
        pivot = k + 1 + below[0]
        h[[k + 1, pivot]] = h[[pivot, k + 1]]
        h[:, [k + 1, pivot]] = h[:, [pivot, k + 1]]
        factor = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - factor[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * factor % p).sum(axis=1)) % p
    leading = np.zeros((d + 1, d + 1), np.int64)
    leading[0, 0] = 1
    for k in range(d):
        leading[k + 1, 1:] = leading[k, :-1]
        weights, product = [int(h[k, k])], 1
        for i in range(k - 1, -1, -1):
            product = product * int(h[i + 1, i]) % p
            weights.append(int(h[i, k]) * product % p)
        drop = (np.array(weights[::-1], np.int64)[:, None] * leading[: k + 1] % p).sum(axis=0)
        leading[k + 1] = (leading[k + 1] - drop) % p
    return leading[d]


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Exact coefficients of det(x - matrix), constant first, of an integer matrix without negative roots."""
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    most = max(math.comb(d, k) * (-(-trace // d)) ** k for k in range(d + 1))  # by the mean of the roots
    chosen = primes((2 * most + 1).bit_length() // 30 + 1)

    def residues(batches):
        for batch in batches:
            found = [modular_polynomial(np.array([[v % p for v in row] for row in matrix], np.int64), p).tolist() for p in batch["p"].tolist()]
            yield pd.DataFrame({"p": batch["p"], "residues": found})

    table = spark.createDataFrame([(p,) for p in chosen], "p long").repartition(max(1, len(chosen) // 4))
    modulus, values = 1, [0] * (d + 1)
    for r in table.mapInPandas(residues, "p long, residues array<long>").collect():
        step = modulus * pow(modulus, -1, r["p"])
        values = [v + (x - v) * step for v, x in zip(values, r["residues"], strict=True)]
        modulus *= r["p"]
        values = [v % modulus for v in values]
    return [v - modulus if 2 * v > modulus else v for v in values]


def roots_above(coefficients: list[int], place: int, shift: int) -> int:
    """How many roots of a polynomial with real roots only are above place / 2**shift: sign changes after moving the origin there."""
    degree = len(coefficients) - 1
    c = [v << (shift * (degree - i)) for i, v in enumerate(coefficients)]
    for i in range(degree):
        for j in range(degree - 1, i - 1, -1):
            c[j] += place * c[j + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def isolate(coefficients: list[int], number: int, top: int) -> tuple[int, int]:
    """(place, shift): the number-th largest root lies above place / 2**shift, by at most 1 / 2**shift; it is at most ``top``."""
    place, step = 0, 1 << top.bit_length()
    while step := step >> 1:
        if roots_above(coefficients, place + step, 0) >= number:
            place += step
    shift = max(0, DIGITS - place.bit_length())
    low = place << shift
    for bit in range(shift - 1, -1, -1):
        if roots_above(coefficients, low + (1 << bit), shift) >= number:
            low += 1 << bit
    return low, shift


def null_space(matrix: list[list[int]], place: int, shift: int, size: int) -> list[list[float]]:
    """``size`` unit vectors, at right angles, that the matrix only stretches by the root in the given interval."""
    d, one = len(matrix), 1 << BITS
    root = (2 * place + 1) << (BITS - shift - 1)
    lu = np.array([[(v << BITS) - (root if i == j else 0) for j, v in enumerate(row)] for i, row in enumerate(matrix)], object)
    order = list(range(d))
    for k in range(d):
        pivot = max(range(k, d), key=lambda i: abs(lu[i, k]))
        lu[[k, pivot]], order[k], order[pivot] = lu[[pivot, k]], order[pivot], order[k]
        lu[k, k] = lu[k, k] or 1
        if k + 1 < d:
            lu[k + 1 :, k] = (lu[k + 1 :, k] << BITS) // lu[k, k]
            lu[k + 1 :, k + 1 :] -= (lu[k + 1 :, k][:, None] * lu[k, k + 1 :]) >> BITS

    def solve(b: np.ndarray) -> np.ndarray:
        x = b[order]
        for i in range(1, d):
            x[i] -= int((lu[i, :i] * x[:i]).sum()) >> BITS
        for i in range(d - 1, -1, -1):
            rest = x[i] - (int((lu[i, i + 1 :] * x[i + 1 :]).sum()) >> BITS) if i + 1 < d else x[i]
            x[i] = (rest << BITS) // lu[i, i]
        return x

    def unit(x: np.ndarray) -> np.ndarray:
        return (x << BITS) // max(1, math.isqrt(int((x * x).sum())))

    basis = [unit(np.array([(pow(i + 2, k + 3, 2**31 - 1) - 2**30) << (BITS - 31) for i in range(d)], object)) for k in range(size)]
    for _ in range(ROUNDS):
        solved: list[np.ndarray] = []
        for x in basis:
            x = unit(solve(x))
            for other in (*solved, *solved):
                x = x - ((int((x * other).sum()) >> BITS) * other >> BITS)
            solved.append(unit(x))
        basis = solved
    return [[float(Fraction(int(v), one)) for v in x] for x in basis]


@dataclass(frozen=True)
class Whitening:
    """A fit: n distinct vectors, sums of y, components as rows, their eigenvalues, shares of variance, and the identity error."""

    width: int
    n: int
    sums: list[int]
    components: list[list[float]]
    eigenvalues: list[float]
    explained: list[float]
    identity_error: float

    def centred(self, y: np.ndarray) -> np.ndarray:
        """n * x less the sums, exactly: longs where they fit, else Python numbers."""
        most = int(np.abs(y).max(initial=0)) * self.n + max(map(abs, self.sums), default=0)
        exact = y if most < 2**62 else y.astype(object)
        return exact * self.n - np.array(self.sums, exact.dtype)

    def project(self, centred: np.ndarray) -> np.ndarray:
        scale = np.array(self.components).T / np.sqrt(np.array(self.eigenvalues))
        return (centred.astype(np.float64) / self.n) @ scale


def fit(rows: DataFrame, components: int) -> Whitening | None:
    """The components of the distinct vectors of ``rows`` (vec_id, y); None where nothing varies."""
    spark = rows.sparkSession
    distinct = stored(rows.select("y").distinct(), "whitening-fit")
    width = (distinct.select(F.size("y")).first() or [0])[0]
    total = scatter(distinct, width)
    n, sums = total[width][width], total[width][:width]
    matrix = [[n * total[i][j] - sums[i] * sums[j] for j in range(width)] for i in range(width)]
    trace = sum(matrix[i][i] for i in range(width))
    if trace == 0:
        return None
    coefficients = characteristic_polynomial(spark, matrix)
    zeros = next(i for i, c in enumerate(coefficients) if c)
    coefficients, count = coefficients[zeros:], min(components, width - zeros)

    def find(batches):
        for batch in batches:
            found = [isolate(coefficients, k, trace) for k in batch["number"].tolist()]
            yield pd.DataFrame({"number": batch["number"], "place": [str(a) for a, _ in found], "shift": [s for _, s in found]})

    numbers = spark.createDataFrame([(k,) for k in range(1, count + 1)], "number int").repartition(count)
    places = sorted(numbers.mapInPandas(find, "number int, place string, shift int").collect())
    roots = [(int(r["place"]), r["shift"]) for r in places]
    value = [Fraction(2 * a + 1, 2 << s) for a, s in roots]
    groups = [0]
    for k in range(1, count):
        groups.append(groups[-1] if value[k - 1] - value[k] <= value[k] / 2**EQUAL else k)

    def span(batches):
        for batch in batches:
            for first in batch["first"].tolist():
                basis = null_space(matrix, *roots[first], groups.count(first))
                yield pd.DataFrame({"number": range(first, first + len(basis)), "entries": basis})

    firsts = spark.createDataFrame([(g,) for g in sorted(set(groups))], "first int").repartition(count)
    basis = [r["entries"] for r in sorted(firsts.mapInPandas(span, "number int, entries array<double>").collect())]
    shares = [float(v / trace) for v in value]
    found = Whitening(width, n, sums, basis, [float(v / n**2) for v in value], shares, 0.0)
    return Whitening(**vars(found) | {"identity_error": identity_error(distinct, found)})


def identity_error(distinct: DataFrame, found: Whitening) -> float:
    """Largest entry of the whitened vectors' covariance less the identity, centred on their own mean."""
    count = len(found.components)

    def total(make, size: int) -> np.ndarray:
        def add(batches):
            parts = [make(found.project(found.centred(matrix_of(b.column(0), found.width)))) for b in batches if b.num_rows]
            part = np.sum(parts, axis=0).ravel() if parts else np.zeros(0)
            yield pa.RecordBatch.from_pydict({"place": pa.array(range(len(part)), pa.int32()), "part": pa.array(part, pa.float64())})

        sums = np.zeros(size)
        for r in distinct.mapInArrow(add, "place int, part double").groupBy("place").agg(F.sum("part").alias("part")).collect():
            sums[r["place"]] = r["part"]
        return sums

    mean = total(lambda w: w.sum(axis=0), count) / found.n
    spread = total(lambda w: (w - mean).T @ (w - mean), count * count).reshape(count, count) / found.n
    return float(np.abs(spread - np.eye(count)).max())


def whiten(vectors: DataFrame, *, components: int = 16, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), one row for every vector and component.

    ``deviation`` is exact; it is null where it leaves the range of a long.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = whole_vectors(vectors, id_column, vector_column)
    found = fit(rows, components)
    if found is None:
        return vectors.sparkSession.createDataFrame([], schema)
    count = len(found.components)

    def apply(batches):
        for batch in batches:
            centred = found.centred(matrix_of(batch.column(1), found.width))
            most = int(np.abs(centred).max(initial=0))
            wide = centred if most**2 * found.width < 2**63 else centred.astype(object)
            deviation = [int(v) if v < 2**63 else None for v in (wide * wide).sum(axis=1)]
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(n), count))),
                    pa.array(np.tile(np.arange(1, count + 1), n), pa.int32()),
                    pa.array(np.full(n * count, found.n), pa.int64()),
                    pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(n), count))),
                    pa.array(found.project(centred).ravel(), pa.float64()),
                    pa.array(np.tile(found.explained, n), pa.float64()),
                    pa.array(np.full(n * count, found.identity_error), pa.float64()),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(apply, schema)
