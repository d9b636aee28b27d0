"""Embedding whitening by spectrum slicing (operator 11).

Vectors become integers on a grid of 1/64, and each distinct integer vector is
counted once. Their sums and products are exact integers, so the covariance
does not depend on how Spark cuts the table. The driver holds one d x d matrix:
the signs in an LDL' factorisation of the shifted matrix (Bunch-Kaufman pivots)
count the eigenvalues above a shift, bisection on these counts isolates each
leading eigenvalue, Rayleigh quotient iteration finishes it, and two more
counts beside the result certify its number.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import packed

COMPONENTS = 16
GRID = 64
OFFSET = 1_000_000
#: Grid values beyond this count as this, so that sums of products fit 38 digits.
FARTHEST = 1 << 40

OUTPUTS = ["n", "deviation", "whitened", "explained", "identity_error"]


def positive_count(matrix: np.ndarray, shift: float) -> int:
    """Eigenvalues of ``matrix`` above ``shift``: the positive pivots of LDL' (Sylvester's law of inertia)."""
    a = matrix - shift * np.eye(len(matrix))
    bound, above, k, n = (1 + 17**0.5) / 8, 0, 0, len(matrix)

    def swap(i: int, j: int) -> None:
        if i != j:
            a[[i, j]] = a[[j, i]]
            a[:, [i, j]] = a[:, [j, i]]

    while k < n:
        column = np.abs(a[k + 1 :, k])
        r = k + 1 + int(column.argmax()) if len(column) else k
        most = column.max(initial=0.0)
        single = True
        if abs(a[k, k]) < bound * most:
            row = np.abs(a[r, k:])
            row[r - k] = 0.0
            widest = row.max()
            if abs(a[k, k]) * widest < bound * most * most:
                if abs(a[r, r]) >= bound * widest:
                    swap(k, r)
                else:
                    swap(k + 1, r)
                    single = False
        if single:
            d = a[k, k]
            above += d > 0
            if d != 0:
                a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k] / d, a[k + 1 :, k])
            k += 1
        else:  # a 2 x 2 pivot of this rule is indefinite
            block, c = a[k : k + 2, k : k + 2], a[k + 2 :, k : k + 2]
            above += 1
            a[k + 2 :, k + 2 :] -= c @ np.linalg.solve(block, c.T)
            k += 2
    return above


def _rayleigh(matrix: np.ndarray, shift: float, found: np.ndarray, tiny: float) -> tuple[float, np.ndarray, float]:
    """(value, unit vector, residual) of the eigenpair near ``shift``, orthogonal to the rows of ``found``."""
    n = len(matrix)
    v = np.cos(np.arange(1, n + 1) * (1.0 + len(found)))  # any fixed vector without symmetry

    def clean(x: np.ndarray) -> np.ndarray:
        for _ in range(2):
            x = x - found.T @ (found @ x)
        return x / np.linalg.norm(x)

    v, at, best = clean(v), shift, None
    for step in range(40):
        try:
            v = clean(np.linalg.solve(matrix - at * np.eye(n), v))
        except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
            at += tiny
            continue
        value = float(v @ matrix @ v)
        residual = float(np.linalg.norm(matrix @ v - value * v))
        if best is None or residual < best[2]:
            best = value, v, residual
        elif step > 3 and best[2] <= tiny:
            break
        if step >= 1:  # two steps of inverse iteration first
            at = value
    return best


def leading_eigenpairs(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues, falling, and their unit vectors as rows.

    Multiple eigenvalues give an orthonormal basis of their space. Raises if a
    pair cannot be certified by the counts beside it.
    """
    n = len(matrix)
    norm = float(np.abs(matrix).sum(axis=1).max(initial=0.0))  # Gershgorin: no eigenvalue is larger
    if norm == 0.0:
        return np.zeros(min(count, n)), np.eye(n)[: min(count, n)]
    tiny = 4 * n * np.finfo(float).eps * norm
    known = {-norm - tiny: n, norm + tiny: 0}

    def above(shift: float) -> int:
        if shift not in known:
            known[shift] = positive_count(matrix, shift)
        return known[shift]

    values, vectors = [], np.zeros((0, n))
    for number in range(1, min(count, n) + 1):
        low = max(s for s, c in known.items() if c >= number)
        high = min(s for s, c in known.items() if c < number)
        while True:
            middle = (low + high) / 2
            alone = known[low] - known[high] == 1
            if (alone and high - low < norm / 16) or high - low <= 2 * tiny:
                value, vector, residual = _rayleigh(matrix, middle, vectors, tiny)
                near = max(2 * residual, tiny)
                if above(value + near) < number <= above(value - near):
                    break
                if high - low <= 2 * tiny:
                    raise ArithmeticError(f"eigenvalue {number} is not certified")
            if above(middle) >= number:
                low = middle
            else:
                high = middle
        values.append(value)
        vectors = np.vstack([vectors, vector])
    order = np.argsort(-np.array(values), kind="stable")  # a multiple value's copies may differ in the last bits
    return np.array(values)[order], vectors[order]


@dataclass
class Whitening:
    """n fitted vectors with sums S; directions (as rows, over the root of their variance), or none where there is no variance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def alive(self) -> np.ndarray:
        return self.values > 8 * len(self.sums) * np.finfo(float).eps * self.trace

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S as exact integers (of Python's where 64 bits do not do)."""
        wide = self.n * (int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0) // max(self.n, 1) + 1) >= 1 << 62
        x = x.astype(object) if wide else x
        return self.n * x - np.array(self.sums, dtype=object if wide else np.int64)

    def project(self, centred: np.ndarray) -> np.ndarray:
        """Whitened rows; NaN in components without variance."""
        scale = np.full(len(self.values), np.nan)
        scale[self.alive] = 1 / np.sqrt(self.values[self.alive])
        return (centred.astype(np.float64) / self.n) @ self.vectors.T * scale

    @staticmethod
    def deviations(centred: np.ndarray) -> list[int | None]:
        """Sums of squares, exact; None beyond 64 bits."""
        most = int(np.abs(centred).max(initial=0))
        if most * most * max(centred.shape[1], 1) < 1 << 63:
            return (centred * centred).sum(axis=1).tolist()
        sums = [sum(int(c) ** 2 for c in row) for row in centred]
        return [s if s < 1 << 63 else None for s in sums]


def grid(vector: Column) -> Column:
    """The integers of a vector; null where it is null or has a null or non-finite entry."""
    v = vector.cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    clipped = lambda c: F.floor(F.least(F.greatest(c * GRID, F.lit(-float(FARTHEST))), F.lit(float(FARTHEST))))
    return F.when(~bad, F.transform(v, lambda c: clipped(c).cast("long") + OFFSET))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _products(fitted: DataFrame, centre: list[int]) -> np.ndarray:
    """Exact sums of products of x - centre, as Python integers: one number a pair of dimensions leaves a task."""
    dim = len(centre)
    rows, cols = np.triu_indices(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(rows), dtype=object)
        for batch in batches:
            y = _matrix(batch.column(0), dim) - np.array(centre)
            most = int(np.abs(y).max(initial=0))
            step = max(1, (1 << 53) // max(1, most * most))  # so many products add up exactly in a double
            for i in range(0, len(y), step):
                part = y[i : i + step]
                f = part.astype(np.float64 if most < 1 << 26 else object)
                total += np.array([int(p) for p in (f.T @ f)[rows, cols]], dtype=object)
        with decimal.localcontext(prec=60):
            values = [decimal.Decimal(int(t)) for t in total]
        yield pa.record_batch([pa.array(range(len(rows)), pa.int32()), pa.array(values, pa.decimal128(38, 0))], names=["k", "v"])

    sums = fitted.select("x").mapInArrow(run, "k int, v decimal(38,0)").groupBy("k").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((dim, dim), dtype=object)
    for r in sums:
        i, j = rows[r["k"]], cols[r["k"]]
        out[i, j] = out[j, i] = int(r["v"])
    return out


def _identity_error(fitted: DataFrame, model: Whitening) -> float | None:
    """Largest absolute entry of (covariance of the whitened fit list - identity), over the components with variance."""
    m, dim = int(model.alive.sum()), len(model.sums)
    if m == 0:
        return None
    shared = fitted.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        total = np.zeros((m, m + 1))
        for batch in batches:
            w = model.project(model.centred(_matrix(batch.column(0), dim)))[:, :m]
            total += w.T @ np.column_stack([w, np.ones(len(w))])
        yield pa.record_batch([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], names=["k", "v"])

    sums = fitted.select("x").mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    total = np.zeros(m * (m + 1))
    for r in sums:
        total[r["k"]] = r["v"] / model.n
    total = total.reshape(m, m + 1)
    mean = total[:, m]
    return float(np.abs(total[:, :m] - np.outer(mean, mean) - np.eye(m)).max())


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors in ``rows.x``, all of one length; None without rows.

    To the driver go d sums, d (d + 1) / 2 products and, for the error, a square of ``components``.
    """
    fitted = materialize(rows.select("x").distinct())
    spread = fitted.select(F.posexplode("x").alias("k", "v")).groupBy("k")
    found = sorted(spread.agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("s"), F.count("*").alias("n")).collect())
    if not found:
        return None
    n, sums = found[0]["n"], [int(r["s"]) for r in found]
    centre = [(2 * s + n) // (2 * n) for s in sums]
    products = _products(fitted, centre)
    rest = np.array([s - n * c for s, c in zip(sums, centre)], dtype=object)
    exact = n * products - np.outer(rest, rest)  # n * n times the covariance
    covariance = np.array([[int(e) / (n * n) for e in row] for row in exact])
    values, vectors = leading_eigenpairs(covariance, min(components, len(sums)))
    model = Whitening(n, sums, values, vectors, float(sum(int(exact[i, i]) for i in range(len(sums))) / (n * n)))
    model.identity_error = _identity_error(fitted, model)
    return model


def whiten(vectors: DataFrame, components: int = COMPONENTS, vector_col: str = "embedding") -> DataFrame:
    """``vectors`` with n, deviation, whitened and explained (arrays by component) and identity_error.

    Rows go whose vector is null, has a null or non-finite entry, or has another
    length than most usable rows (ties: the longer length; vectors of length 0
    never count). Repeated vectors are fitted once, and each of their rows is
    returned. A component without variance is null in whitened and 0 in
    explained (null without any variance), and does not count in
    identity_error. deviation is null beyond 64 bits. Entries beyond 2**34 in
    absolute value count as that. Other columns go through; columns named like
    the outputs are replaced.
    """
    usable = packed(vectors, OUTPUTS, x=grid(F.col(f"`{vector_col}`"))).where(F.size("x") > 0)
    lengths = usable.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    usable = usable.where(F.size("x") == (lengths["d"] if lengths else -1))
    model = fit(usable, components)
    if model is None:
        return usable.select("_row.*", *[F.lit(None).cast(t).alias(c) for c, t in zip(OUTPUTS, ["long", "long", "array<double>", "array<double>", "double"])])
    shared, dim = usable.sparkSession.sparkContext.broadcast(model), len(model.sums)

    @F.arrow_udf("deviation long, whitened array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for x in batches:
            centred = model.centred(_matrix(x, dim))
            w = model.project(centred)
            flat = pa.array(w.ravel(), mask=np.isnan(w).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), flat)
            yield pa.StructArray.from_arrays([pa.array(model.deviations(centred), pa.int64()), lists], ["deviation", "whitened"])

    explained = [None if model.trace == 0 else max(0.0, float(v)) * bool(a) / model.trace for v, a in zip(model.values, model.alive)]
    return usable.select("_row", run("x").alias("found")).select(
        "_row.*",
        F.lit(model.n).cast("long").alias("n"),
        "found.deviation",
        "found.whitened",
        F.array(*[F.lit(e).cast("double") for e in explained]).alias("explained"),
        F.lit(model.identity_error).cast("double").alias("identity_error"),
    )


def by_component(whitened: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """One row per vector and component, numbered from 1."""
    each = whitened.select(F.col(id_col), "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("at", "value"))
    number = (F.col("at") + 1).cast("int")
    return each.select(id_col, number.alias("component"), "n", "deviation", F.col("value").alias("whitened"), F.element_at("explained", number).alias("explained"), "identity_error")
