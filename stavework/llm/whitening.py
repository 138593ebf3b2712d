"""Whitening of embeddings by an eigendecomposition that is updated vector by vector.

Every task keeps the eigenvalues and eigenvectors of the scatter that it has seen and adds centred vectors z by rank-one updates: the new
eigenvalues are the roots of the secular equation 1 + sum(v_i^2 / (d_i - x)) = 0 with v the vector in the present basis. Entries
of v that are zero, and all but one of each group of equal eigenvalues after a reflection, are deflated. The vectors of a batch are first
brought to as many as there are dimensions with the same scatter (the triangle of their QR decomposition), so that a row costs its
length times the dimensions. Spectra of tasks are added in rounds, each eigenpair of one being a rank-one update of another. Two more passes
refine the basis by Rayleigh-Ritz: the covariance projected on it is summed by Spark, and its own small eigendecomposition turns it.

Sums are exact: an entry becomes a whole number, numbers add as decimals, deviations are computed with integers of any length.

Cases: rows whose vector is null or holds a null, a NaN or an infinity are dropped; so are rows whose length is not that of most
rows (of equally frequent lengths the largest), empty vectors, and vectors with an entry of 2^40 or more. Repeated rows and rows with a
repeated or null id all count and all have results. A component whose eigenvalue is zero next to the largest (all of them for a single or for equal
vectors) has a null ``whitened``; the share is null where there is no variance, ``identity_error`` where no component has any, ``deviation`` where
it passes 64 bits. An empty table gives no rows. Further columns of any name are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, checkpointed, shuffles_removed, table

COMPONENTS, SCALE, SHIFT, LARGEST = 8, 1024, 100_000, 2.0**40
#: So many spectra are added in one task, and so many rounds refine the basis.
FAN_IN, REFINEMENTS = 8, 2
EPS = np.finfo(np.float64).eps
SPECTRUM = "part long, d array<double>, q array<double>"


def secular_roots(d: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum(w / (d - x)), for ascending distinct d and positive w: for each, the nearest pole below and the distance to it."""
    n, k = len(d), np.arange(len(d))
    gaps = np.append(np.diff(d), w.sum())
    # the pole that is nearer to a root is its origin, so that the distance keeps its digits; the last root has but one
    up = (1 + (w / (d[None, :] - d[:, None] - gaps[:, None] / 2)).sum(1) < 0) & (k < n - 1)
    origin = k + up
    delta = d[None, :] - d[origin][:, None]
    low, high = np.where(up, -gaps / 2, 0.0), np.where(up, 0.0, np.where(k < n - 1, gaps / 2, gaps))
    x = (low + high) / 2
    for _ in range(120):
        terms = delta - x[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            f, slope = 1 + (w / terms).sum(1), (w / terms**2).sum(1)
        low, high = np.where(f < 0, x, low), np.where(f < 0, high, x)
        with np.errstate(divide="ignore", invalid="ignore"):
            newton = x - f / slope
        inside = (newton > low) & (newton < high)
        new = np.where(inside, newton, (low + high) / 2)
        if (np.abs(new - x) <= 2 * EPS * np.abs(new)).all():
            break
        x = new
    return origin, x


def rank_one(d: np.ndarray, q: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ascending eigenvalues and the eigenvectors of q diag(d) q' + z z'."""
    v, d, q = q.T @ z, d.copy(), q.copy()
    size = max(float(d[-1]), float(v @ v))
    if size == 0:
        return d, q
    tiny = 8 * EPS * size
    for i in range(len(d) - 1):  # equal neighbours: a rotation puts all of the vector on the second
        if d[i + 1] - d[i] <= tiny and v[i]:
            r = np.hypot(v[i], v[i + 1])
            c, s = v[i + 1] / r, v[i] / r
            q[:, i], q[:, i + 1] = c * q[:, i] - s * q[:, i + 1], s * q[:, i] + c * q[:, i + 1]
            v[i], v[i + 1] = 0.0, r
    live = np.flatnonzero(np.abs(v) * np.sqrt(size) > tiny)
    live = live[np.concatenate([np.diff(d[live]) > 0, [True]])] if len(live) else live
    if len(live):
        dl, w = d[live], v[live] ** 2
        origin, x = secular_roots(dl, w)
        gaps = (dl[None, :] - dl[origin][:, None]) - x[:, None]  # d_j - root_i
        # the vector that has exactly these roots, so that the eigenvectors are orthogonal
        n = len(dl)
        j = np.arange(n)
        ratio = -gaps / np.where(np.eye(n, dtype=bool), 1.0, dl[None, :] - dl[:, None])  # (root_i - d_j) / (d_i - d_j)
        ratio[j, j] = -gaps[j, j]
        exact = np.sqrt(np.abs(np.prod(ratio, axis=0)))
        turn = (np.copysign(exact, v[live])[None, :] / gaps).T
        turn /= np.linalg.norm(turn, axis=0)
        q[:, live], d[live] = q[:, live] @ turn, dl[origin] + x
    order = np.argsort(d, kind="stable")
    return d[order], q[:, order]


class Spectrum:
    """The eigendecomposition of a sum of z z'."""

    def __init__(self, dims: int):
        self.d, self.q = np.zeros(dims), np.eye(dims)

    def add(self, z: np.ndarray) -> None:
        """Add the scatter of the rows of z."""
        for row in np.linalg.qr(z, mode="r") if len(z) > len(self.d) else z:
            self.d, self.q = rank_one(self.d, self.q, row)

    def add_spectrum(self, d: np.ndarray, q: np.ndarray) -> None:
        for k in np.flatnonzero(d > 0):
            self.d, self.q = rank_one(self.d, self.q, np.sqrt(d[k]) * q[:, k])

    def batch(self, part: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([self.d]), pa.array([self.q.ravel()])], ["part", "d", "q"])


def matrix(lists: pa.ListArray) -> np.ndarray:
    """The rows of lists of one length."""
    values = lists.flatten().to_numpy()
    return values.reshape(len(lists), -1) if len(lists) else np.empty((0, 0))


def fitted(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): the rows that are kept, their entries as whole numbers."""
    e = F.col("embedding")
    good = vectors.select("vec_id", e.cast("array<double>").alias("e")).filter(F.size("e") > 0).filter(F.forall("e", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < LARGEST), F.lit(False))))
    sizes = good.groupBy(F.size("e").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).limit(1).collect()
    return good.filter(F.size("e") == (sizes[0].dims if sizes else 0)).select("vec_id", F.transform("e", lambda c: F.floor(c * SCALE) + SHIFT).alias("x"))


def sums(x: DataFrame) -> tuple[int, list[int]]:
    """How many vectors, and the exact sum of each dimension."""
    rows = x.select(F.posexplode("x").alias("i", "c")).groupBy("i").agg(F.sum(F.col("c").cast("decimal(18,0)")).alias("s"), F.count("*").alias("n")).orderBy("i").collect()
    return (rows[0].n if rows else 0), [int(r.s) for r in rows]


class Centre:
    """Vectors less their mean: the mean's whole part is taken off as whole numbers."""

    def __init__(self, n: int, s: list[int]):
        self.n, self.s = n, s
        self.whole = np.array([v // n for v in s], np.int64)
        self.rest = np.array([v % n / n for v in s])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sums over dimensions of (n * x - s)^2."""
        most, part = int(np.abs(x - self.whole).max(initial=0)) + 1, np.array([v % self.n for v in self.s], np.int64)
        if (most * self.n) ** 2 * x.shape[1] < 1 << 62:
            return ((self.n * (x - self.whole) - part) ** 2).sum(1).tolist()
        exact = ((self.n * (x - self.whole).astype(object) - part.astype(object)) ** 2).sum(1)
        return [int(v) if v < 1 << 63 else None for v in exact]


def spectrum(x: DataFrame, centre: Centre, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """The eigendecomposition of the scatter: tasks update their own, and FAN_IN of them are added at a time until one is left."""
    dims = len(centre.s)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, seen = Spectrum(dims), False
        for b in batches:
            if b.num_rows:
                own.add(centre(matrix(b.column(0))))
                seen = True
        if seen:
            yield own.batch(TaskContext.get().partitionId())

    def added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, Spectrum] = {}
        for b in batches:
            for part, d, q in zip(b.column(0).to_pylist(), matrix(b.column(1)), matrix(b.column(2)), strict=True):
                open_.setdefault(part, Spectrum(dims)).add_spectrum(d, q.reshape(dims, dims))
        for part, s in open_.items():
            yield s.batch(part)

    found = scratch.write(x.select("x").mapInArrow(rows, SPECTRUM))
    parts = (found.agg(F.max("part")).first()[0] or 0) + 1
    while parts > 1:
        parts = -(-parts // FAN_IN)
        found = scratch.write(found.withColumn("part", F.expr(f"part div {FAN_IN}")).repartition(min(parts, 1000), "part").mapInArrow(added, SPECTRUM))
    row = found.first()
    return np.array(row.d), np.array(row.q).reshape(dims, dims)


def products(x: DataFrame, function, size: int) -> np.ndarray:
    """The sum over all rows of y y', y = function(rows)."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for b in batches:
            if b.num_rows:
                y = function(matrix(b.column(0)))
                total += y.T @ y
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i * size + j), pa.array(total[i, j])], ["cell", "v"])

    out = np.zeros(size * size)
    for cell, v in x.select("x").mapInArrow(rows, "cell long, v double").groupBy("cell").agg(F.sum("v")).collect():
        out[cell] = v
    return out.reshape(size, size)


def whiten(vectors: DataFrame) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of embeddings (vec_id, embedding)."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = vectors.sparkSession
    x = checkpointed(fitted(vectors))
    n, s = sums(x)
    if not n:
        return spark.createDataFrame([], schema)
    centre = Centre(n, s)
    with shuffles_removed(spark), Scratch(spark) as scratch:
        d, q = spectrum(x, centre, scratch)
    for _ in range(REFINEMENTS):
        d, turn = np.linalg.eigh(products(x, lambda r, q=q: centre(r) @ q, len(s)) / n)
        q = np.linalg.qr(q @ turn)[0]
    d, q = d[::-1], q[:, ::-1]
    top = min(COMPONENTS, len(s))
    live = [k for k in range(top) if d[k] > len(s) * EPS * d[0] and d[k] > 0]
    axes, total = q[:, live] / np.sqrt(d[live]), float(d.sum())
    error = None
    if live:
        mean = _mean(x, lambda r: centre(r) @ axes, len(live), n)
        error = float(np.abs(products(x, lambda r: centre(r) @ axes - mean, len(live)) / n - np.eye(len(live))).max())
    shares = [float(d[k] / total) if total > 0 else None for k in range(top)]

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            r, m = matrix(b.column(1)), b.num_rows
            y, deviation = np.full((m, top), np.nan), centre.deviations(r)
            y[:, live] = centre(r) @ axes
            out = [b.column(0).take(pa.array(np.repeat(np.arange(m), top))), pa.array(np.tile(np.arange(1, top + 1, dtype=np.int32), m)), pa.repeat(n, m * top), pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(m), top)))]
            yield pa.RecordBatch.from_arrays([*out, pa.array(y.ravel(), mask=np.isnan(y.ravel())), pa.array(shares * m, pa.float64()), pa.array([error] * (m * top), pa.float64())], [c.split()[0] for c in schema.split(", ")])

    return x.select(F.col("vec_id").cast("long"), "x").mapInArrow(rows, schema)


def _mean(x: DataFrame, function, size: int, n: int) -> np.ndarray:
    """The mean over all rows of function(rows)."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(function(matrix(b.column(0))).sum(0))], ["k", "v"])

    found = dict(x.select("x").mapInArrow(rows, "k long, v double").groupBy("k").agg(F.sum("v")).collect())
    return np.array([found[k] / n for k in range(size)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {"op13_embedding_whitening": query}
ORACLES: dict[str, str] = {}
