"""Whitening of embeddings by their principal components.

Vectors become whole numbers, floor(256 * entry), and the fit list holds each such
vector once.  Its sums are exact.  The covariance is of centred vectors:
each task adds up outer products of its own, and the matrices are added up
by row in two rounds.  It has as many rows as a vector has entries, so
it is solved on the driver: Householder reflections make it tridiagonal, counts of
Sturm sequences bisect to the leading eigenvalues, inverse iteration gives
their vectors, those of close eigenvalues held orthogonal to each other, and the
reflections are undone.  The projection goes to the tasks by broadcast.

Vectors that are null or hold null or non-finite entries take no part.  Vectors of
different lengths have no covariance, so each length is whitened by itself,
zero vectors included; empty vectors have no components and no rows.  Rows count,
not ids: repeated rows count once for the fit and are all returned, null ids too.
Entries that no long holds once multiplied end at its limits.  A component without variance (a
single vector, fewer distinct vectors than components) has explained 0 and a null
``whitened``, and is not part of ``identity_error``, which is null if no component is left.
``deviation`` is null where no long holds it.  Empty tables give empty results; other
columns are not read.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampflow.llm.common import bounded_batches, saved

SCALE = 256
COMPONENTS = 4
#: Partial matrices that one task adds up in the first round, about.
FAN_IN = 64
_EPS = np.finfo(np.float64).eps


# ---- the eigenproblem, on the driver


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and reflections of a symmetric matrix; reflection k acts on entries k + 1 and on."""
    a, n = np.array(a, np.float64), len(a)
    reflections = []
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        scale = np.abs(x).max()
        v = np.zeros_like(x)
        if scale > 0 and np.abs(x[1:]).max(initial=0.0) > 0:
            v = x / scale
            v[0] += np.copysign(np.sqrt(v @ v), v[0])
            v /= np.sqrt(v @ v)
            sub = a[k + 1 :, k + 1 :]
            w = sub @ v
            w -= (v @ w) * v
            sub -= 2 * (np.outer(v, w) + np.outer(w, v))
            a[k + 1 :, k] = x - 2 * v * (v @ x)
        reflections.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflections


def below(d: np.ndarray, e: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix are less than each ``x``: negative terms of its Sturm sequence."""
    tiny = max(np.finfo(np.float64).tiny, _EPS**2 * max(np.abs(d).max(), np.abs(e).max(initial=0.0)))
    q = d[0] - x
    count = (q < 0).astype(np.int64)
    for k in range(1, len(d)):
        q = np.where(np.abs(q) < tiny, np.where(q < 0, -tiny, tiny), q)
        q = d[k] - x - e[k - 1] ** 2 / q
        count += q < 0
    return count


def leading_values(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, by bisection to the last digits."""
    n = len(d)
    radius = np.append(np.abs(e), 0.0) + np.append(0.0, np.abs(e))
    low, high = np.full(k, (d - radius).min()), np.full(k, (d + radius).max())
    slack = _EPS * max(np.abs(low).max(), np.abs(high).max()) + np.finfo(np.float64).tiny
    low, high, rank = low - slack, high + slack, n - 1 - np.arange(k)
    for _ in range(200):
        middle = (low + high) / 2
        up = below(d, e, middle) > rank  # then the eigenvalue of that rank lies below
        low, high = np.where(up, low, middle), np.where(up, middle, high)
        if np.all(high - low <= 2 * _EPS * np.maximum(np.abs(low), np.abs(high)) + np.finfo(np.float64).tiny):
            break
    return (low + high) / 2


def _solve(d: np.ndarray, e: np.ndarray, shift: float, b: np.ndarray) -> np.ndarray:
    """x of (T - shift) x = b, by elimination with row exchanges; a zero pivot is a very small one."""
    n, tiny = len(d), _EPS * max(np.abs(d).max(), np.abs(e).max(initial=0.0), np.finfo(np.float64).tiny)
    u0, u1, u2, x = d - shift, np.append(e, 0.0), np.zeros(n), b.copy()
    for k in range(n - 1):
        low, main, right = e[k], u0[k + 1], u1[k + 1]
        if abs(low) > abs(u0[k]):
            x[k], x[k + 1] = x[k + 1], x[k]
            factor = u0[k] / low
            u0[k], u0[k + 1], u1[k], u1[k + 1], u2[k] = low, u1[k] - factor * main, main, -factor * right, right
        else:
            u0[k] = u0[k] if abs(u0[k]) > tiny else tiny
            factor = low / u0[k]
            u0[k + 1] = main - factor * u1[k]
        x[k + 1] -= factor * x[k]
    for k in range(n - 1, -1, -1):
        rest = x[k] - (u1[k] * x[k + 1] if k + 1 < n else 0.0) - (u2[k] * x[k + 2] if k + 2 < n else 0.0)
        x[k] = rest / (u0[k] if abs(u0[k]) > tiny else tiny)
        if abs(x[k]) > 1e150:
            x /= abs(x[k])
    return x


def leading_vectors(d: np.ndarray, e: np.ndarray, values: np.ndarray, seed: int = 3) -> np.ndarray:
    """A unit eigenvector a column of the tridiagonal matrix for each of ``values`` (falling), by inverse iteration.

    Vectors of a cluster of close eigenvalues are made orthogonal to those before them after each step.
    """
    rng, norm = np.random.default_rng(seed), max(np.abs(d).max(), np.abs(e).max(initial=0.0))
    out, begins = np.zeros((len(d), len(values))), 0
    for k, value in enumerate(values):
        if k and values[k - 1] - value > 1e-3 * norm:
            begins = k
        cluster, x = out[:, begins:k], rng.normal(size=len(d))
        shift = value - (k - begins) * 4 * _EPS * norm  # equal eigenvalues need shifts of their own
        for _ in range(6):
            x = _solve(d, e, shift, x)
            x /= np.abs(x).max()
            for _ in range(2):
                x -= cluster @ (cluster.T @ x)
            x /= np.sqrt(x @ x)
        out[:, k] = x
    return out


def components(covariance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and their unit vectors as columns."""
    k = min(k, len(covariance))
    if not np.abs(covariance).max(initial=0.0) > 0:
        return np.zeros(k), np.eye(len(covariance))[:, :k]
    d, e, reflections = tridiagonal(covariance)
    values = leading_values(d, e, k)
    vectors = leading_vectors(d, e, values)
    for at in range(len(reflections) - 1, -1, -1):
        v = reflections[at]
        vectors[at + 1 :] -= 2 * np.outer(v, v @ vectors[at + 1 :])
    return values, vectors / np.sqrt((vectors**2).sum(0))


# ---- vectors, in the tasks


def whole(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, x: array of longs) of the vectors that take part."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).where("v is not null")
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    scaled = F.transform("v", lambda c: F.floor(c.cast("double") * float(SCALE)).cast("long"))
    return rows.where(F.coalesce(fine, F.lit(False))).select("id", scaled.alias("x"))


def _by_length(column: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, matrix of longs) of a batch of arrays."""
    sizes, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)
    begins = np.cumsum(sizes) - sizes
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        yield size, at, flat[begins[at][:, None] + np.arange(size)]


@dataclass
class Center:
    """How many vectors of one length the fit list holds, and their sums."""

    n: int
    sums: list[int]

    def __post_init__(self):
        self.whole = np.array([s // self.n for s in self.sums], np.int64)
        self.part = np.array([s % self.n / self.n for s in self.sums])

    def off(self, x: np.ndarray) -> np.ndarray:
        """x - S/n, the whole parts subtracted first so that nothing is lost to a far center."""
        if len(x) and max(abs(int(x.min())), abs(int(x.max()))) < 1 << 62 and np.abs(self.whole).max(initial=0) < 1 << 62:
            return (x - self.whole).astype(np.float64) - self.part
        return x.astype(np.float64) - self.whole.astype(np.float64) - self.part

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n * x - S)**2 of each row, exactly; none beyond a long."""
        most = max((abs(s) for s in self.sums), default=0) + self.n * (max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0)
        if most**2 * max(1, x.shape[1]) < 1 << 63:
            return ((x * self.n - np.array(self.sums, np.int64)) ** 2).sum(1).tolist()
        out = [sum((self.n * a - s) ** 2 for a, s in zip(row, self.sums)) for row in x.tolist()]
        return [v if v < 1 << 63 else None for v in out]


def centers(fit: DataFrame) -> dict[int, Center]:
    """By length: count and sums of the vectors ``x``; each task adds up its own, and their sums are added up."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[int, int] = {}
        high: dict[int, np.ndarray] = {}
        low: dict[int, np.ndarray] = {}
        for batch in batches:
            for size, at, x in _by_length(batch.column(0)):
                n[size] = n.get(size, 0) + len(at)
                high[size] = high.get(size, 0) + (x >> 32).sum(0)
                low[size] = low.get(size, 0) + (x & 0xFFFFFFFF).sum(0)
        for size in n:  # entry -1 is the count
            sums = [decimal.Decimal(n[size])] + [decimal.Decimal((int(h) << 32) + int(b)) for h, b in zip(high[size], low[size])]
            yield pa.RecordBatch.from_arrays([pa.array([size] * len(sums), pa.int32()), pa.array(range(-1, size), pa.int32()), pa.array(sums, pa.decimal128(38, 0))], ["size", "entry", "total"])

    parts = fit.select("x").mapInArrow(add, "size int, entry int, total decimal(38,0)")
    out: dict[int, dict[int, int]] = {}
    for r in parts.groupBy("size", "entry").agg(F.sum("total").alias("total")).collect():  # a row an entry of a vector
        out.setdefault(r["size"], {})[r.entry] = int(r.total)
    return {size: Center(own[-1], [own[k] for k in range(size)]) for size, own in sorted(out.items())}


def grams(fit: DataFrame, around: dict[int, Center], project: dict[int, np.ndarray] | None = None) -> dict[int, np.ndarray]:
    """By length: the mean outer product of x - S/n, or of its projection; added up by row, first of some tasks each, then of all."""
    shared = fit.sparkSession.sparkContext.broadcast((around, project))  # a matrix a length

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, onto = shared.value
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for size, _, x in _by_length(batch.column(0)):
                y = own[size].off(x)
                if onto is not None:
                    y = y @ onto[size]
                total[size] = total.get(size, 0) + y.T @ y
        for size, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([size] * len(m), pa.int32()), pa.array(range(len(m)), pa.int32()), pa.array(list(m), pa.list_(pa.float64()))], ["size", "entry", "row"])

    def add(rows: pa.Table) -> pa.Table:
        total = np.stack(rows.column("row").to_numpy()).sum(0)
        return pa.table({"size": rows.column("size")[:1], "entry": rows.column("entry")[:1], "row": pa.array([total], pa.list_(pa.float64()))})

    kind = "size int, entry int, row array<double>"
    parts = fit.select("x").mapInArrow(multiply, kind)
    some = F.floor(F.spark_partition_id() / FAN_IN).alias("some")
    some = parts.withColumn("some", some).groupBy("size", "entry", "some").applyInArrow(add, kind)
    out: dict[int, dict[int, list]] = {}
    for r in some.groupBy("size", "entry").applyInArrow(add, kind).collect():
        out.setdefault(r["size"], {})[r.entry] = r.row
    return {size: np.array([own[k] for k in range(len(own))]) / around[size].n for size, own in out.items()}


@dataclass
class Whitener:
    """Of vectors of one length: center, projection to unit variance, share of the variance, and how far the fit list is from white."""

    center: Center
    projection: np.ndarray
    explained: list[float]
    usable: list[bool]
    identity_error: float | None


def fit_whitening(rows: DataFrame, k: int = COMPONENTS) -> dict[int, Whitener]:
    """A whitener a length of vectors, from ``rows`` as ``whole`` gives them."""
    fit = saved(rows.where("size(x) > 0").select("x").distinct(), "fit-vectors")
    around = centers(fit)
    solved = {}
    for size, v in grams(fit, around).items():
        values, vectors = components(v, k)
        trace = float(np.trace(v))
        usable = values > max(trace, 0.0) * size * _EPS * 8
        scale = np.where(usable, 1 / np.sqrt(np.where(usable, values, 1.0)), 0.0)
        solved[size] = (vectors * scale, [float(e / trace) if u else 0.0 for e, u in zip(values, usable)], usable.tolist())
    if not solved:
        return {}
    out, white = {}, grams(fit, around, {size: p for size, (p, _, _) in solved.items()})
    for size, (p, explained, usable) in solved.items():
        own = np.flatnonzero(usable)
        error = float(np.abs(white[size][np.ix_(own, own)] - np.eye(len(own))).max()) if len(own) else None
        out[size] = Whitener(around[size], p, explained, usable, error)
    return out


def whitened(rows: DataFrame, model: dict[int, Whitener]) -> DataFrame:
    """Each of ``rows`` (``whole``): id, n, deviation and the vector of its components (null entries: no variance), with explained and identity_error."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # some numbers an entry of a vector

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, at, x in _by_length(batch.column(1)):
                w = shared.value.get(size)
                if w is None:
                    continue
                y = (w.center.off(x) @ w.projection).tolist()
                y = y if all(w.usable) else [[c if u else None for c, u in zip(row, w.usable)] for row in y]
                columns = [batch.column(0).take(pa.array(at)), pa.array([w.center.n] * len(at), pa.int64()), pa.array(w.center.deviations(x), pa.int64()), pa.array(y, pa.list_(pa.float64())), pa.array([w.explained] * len(at), pa.list_(pa.float64())), pa.array([w.identity_error] * len(at), pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(apply, f"id {rows.schema['id'].dataType.simpleString()}, n long, deviation long, whitened array<double>, explained array<double>, identity_error double")


def op11(spark, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    rows = whole(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    out = whitened(rows, fit_whitening(rows))
    each = out.select("id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("k", "c"))
    return each.select(F.col("id").alias("vec_id"), (F.col("k") + 1).alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")
