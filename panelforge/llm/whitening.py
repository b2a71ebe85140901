"""Whitening of embeddings by a Jacobi-Davidson method that sees the rows only through distributed products.

The covariance is never formed. A product of it with a few vectors is one pass over the written rows of the fit list: a
task centres its block exactly (n*x - S in whole numbers, then divided), multiplies twice and gives back one small matrix.
The driver keeps a subspace of a few vectors of the embeddings' length, which does not grow with the rows.

1. Rayleigh-Ritz in the subspace gives Ritz pairs; those whose residuals have reached double precision are locked, in
   falling order, and deflated.
2. For the next open pairs the correction equation (I - QQ')(V - e)(I - QQ') t = -r is solved to a few steps by MINRES;
   the systems of all open pairs go in step, so a step is one pass.
3. The corrections widen the subspace; when it is full it is folded to its leading Ritz vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import written

#: Components, rows packed into a block, open pairs corrected at once, MINRES steps, outer steps at most.
COMPONENTS, BLOCK, AT_ONCE, INNER, OUTER = 16, 4096, 16, 5, 200
#: Entries become floor(SCALE * c) + SHIFT. Partial matrices of so many partitions are added up by one task.
SCALE, SHIFT, FAN_IN = 64, 1_000_000, 64
EPS = np.finfo(float).eps


def _blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    """Vectors as packed whole-number matrices of BLOCK rows at most, with their sums."""
    for b in batches:
        for at in range(0, b.num_rows, BLOCK):
            x = b.column(0).slice(at, BLOCK)
            m = x.flatten().to_numpy().astype("<i8").reshape(-1, d)
            yield pa.RecordBatch.from_arrays([pa.array([m.tobytes()], pa.binary()), pa.array([len(m)], pa.int64()), pa.array([m.sum(axis=0).tolist()], pa.list_(pa.int64()))], ["x", "m", "sums"])


class FitList:
    """The distinct vectors as a written table of blocks, with n, S, and products of the centred rows."""

    def __init__(self, distinct: DataFrame, d: int):
        self.spark, self.d = distinct.sparkSession, d
        self.blocks = written(distinct.mapInArrow(lambda b: _blocks(b, d), "x binary, m long, sums array<long>"))
        self.n = self.blocks.agg(F.sum("m")).first()[0] or 0
        sums = self.blocks.select(F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
        self.sums = np.array([int(r["s"]) for r in sorted(sums)], dtype=np.int64)
        self.passes, self.parts = 0, self.blocks.rdd.getNumPartitions()

    def reduce(self, of, shape: tuple[int, ...]) -> np.ndarray:
        """The sum of of(centred rows) over all blocks; partitions are added up in order, FAN_IN in one task at a time."""
        n, d, sums = self.n, self.d, self.sums

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            total = np.zeros(shape)
            for b in batches:
                for x in b.column(0):
                    total += of(centred(np.frombuffer(x.as_buffer(), dtype="<i8").reshape(-1, d), n, sums))
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["p", "t"])

        def add(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("p")
            return pd.DataFrame({"p": [rows["p"].iloc[0] // FAN_IN], "t": [sum(np.frombuffer(t) for t in rows["t"]).tobytes()]})

        self.passes += 1
        some = self.blocks.select("x").mapInArrow(part, "p long, t binary")
        count = self.parts
        while count > FAN_IN:
            some = some.groupBy(F.floor(F.col("p") / FAN_IN).alias("by")).applyInPandas(lambda rows: add(rows), "p long, t binary")
            count = math.ceil(count / FAN_IN)
        parts = sorted((r["p"], r["t"]) for r in some.collect())
        return sum((np.frombuffer(t) for _, t in parts), np.zeros(math.prod(shape))).reshape(shape)

    def product(self, vectors: np.ndarray) -> np.ndarray:
        """Covariance times vectors (d x b), without the covariance."""
        return self.reduce(lambda z: z.T @ (z @ vectors), vectors.shape) / self.n


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n, exact in whole numbers before the one division."""
    return (x * n - sums) / n


def _orthonormal(t: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """Columns of t made orthonormal to `against` and each other, twice over; columns that vanish are left out."""
    out = np.zeros((len(t), 0))
    for k in range(t.shape[1]):
        v = t[:, k]
        size = np.linalg.norm(v)
        for _ in range(3):
            for q in (*against, out):
                v = v - q @ (q.T @ v)
        left = np.linalg.norm(v)
        if left > 1e-10 * size > 0:
            v = v / left
            for q in (*against, out):
                v = v - q @ (q.T @ v)
            out = np.column_stack([out, v / np.linalg.norm(v)])
    return out


def _corrections(product, locked: np.ndarray, u: np.ndarray, e: np.ndarray, r: np.ndarray, steps: int) -> np.ndarray:
    """Approximate solutions of the projected correction equations of the pairs (u, e) with residuals r, by MINRES in step.

    Each column is its own system with its own projector (locked vectors and its Ritz vector); only the products are shared.
    """
    def project(x: np.ndarray) -> np.ndarray:
        x = x - locked @ (locked.T @ x)
        return x - u * np.einsum("ij,ij->j", u, x)

    def unit(a: np.ndarray) -> np.ndarray:
        return np.where(a > 0, a, 1.0)

    v = project(-r)
    beta = np.linalg.norm(v, axis=0)
    v = v / unit(beta)
    before, x = np.zeros_like(v), np.zeros_like(v)
    w1, w2 = np.zeros_like(v), np.zeros_like(v)
    eta, b = beta.copy(), np.zeros_like(beta)
    c1, c2, s1, s2 = np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    for _ in range(steps):
        a = project(product(v) - v * e)
        alpha = np.einsum("ij,ij->j", v, a)
        a = project(a - v * alpha - before * b)
        after = np.linalg.norm(a, axis=0)
        # two old rotations, then the new one
        over2, mid = s2 * b, c2 * b
        over1, here = c1 * mid + s1 * alpha, c1 * alpha - s1 * mid
        size = unit(np.hypot(here, after))
        c2, s2, c1, s1 = c1, s1, here / size, after / size
        w1, w2 = (v - w1 * over1 - w2 * over2) / size, w1
        x = x + w1 * (c1 * eta)
        eta = -s1 * eta
        before, v, b = v, a / unit(after), after
    return x


def jacobi_davidson(product, d: int, k: int, at_once: int = AT_ONCE, inner: int = INNER, outer: int = OUTER) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns) of the k largest of a symmetric positive operator of size d, given its products.

    A pair is locked when its residual is below d*eps times the largest eigenvalue, all above it being locked: that is
    where double precision ends for a product summed over rows. The locked space is then rotated once more by Rayleigh-Ritz
    on fresh products.
    """
    k = min(k, d)
    full = min(d, 5 * k)
    rng = np.random.default_rng(20)
    locked, values = np.zeros((d, 0)), np.zeros(0)
    basis = _orthonormal(rng.standard_normal((d, min(d, k + 4))))
    image = product(basis)
    scale, best, still = 0.0, np.inf, 0
    for _ in range(outer):
        h = basis.T @ image
        e, y = np.linalg.eigh((h + h.T) / 2)
        e, y = e[::-1], y[:, ::-1]
        u, au = basis @ y, image @ y
        scale = max(scale, values[0] if len(values) else e[0])
        r = au - u * e
        r = r - locked @ (locked.T @ r)
        size = np.linalg.norm(r, axis=0)
        wanted = min(k - locked.shape[1], len(e))
        good = size[:wanted] <= d * EPS * scale
        done = wanted if good.all() else int(np.argmin(good))
        if done:
            locked, values = np.column_stack([locked, u[:, :done]]), np.append(values, e[:done])
            u, au, e, r, size = u[:, done:], au[:, done:], e[done:], r[:, done:], size[done:]
        if locked.shape[1] >= k:
            break
        open_ = slice(0, min(at_once, k - locked.shape[1], len(e)))
        worst = float(size[open_].max()) if len(e) else np.inf
        still = 0 if done or worst < 0.5 * best else still + 1
        best = worst if done else min(best, worst)
        if still > 8:  # products carry more rounding than the bound: take them anew
            u, still = _orthonormal(u, locked), 0
            au = product(u)
        t = _corrections(product, locked, u[:, open_], e[open_], r[:, open_], inner) if len(e) else rng.standard_normal((d, at_once))
        if u.shape[1] + locked.shape[1] + t.shape[1] > full < d:
            keep = min(u.shape[1], k - locked.shape[1] + 2)
            u, au = u[:, :keep], au[:, :keep]
        t = t[:, : d - u.shape[1] - locked.shape[1]]
        new = _orthonormal(t, locked, u)
        if not new.shape[1]:
            new = _orthonormal(rng.standard_normal((d, 2)), locked, u)
        basis, image = (np.column_stack([u, new]), np.column_stack([au, product(new)])) if new.shape[1] else (_orthonormal(u, locked), product(_orthonormal(u, locked)))
    else:
        raise RuntimeError(f"{k - locked.shape[1]} of {k} pairs have not reached double precision in {outer} steps")
    q = _orthonormal(locked)
    h = q.T @ product(q)
    e, y = np.linalg.eigh((h + h.T) / 2)
    return e[::-1], q @ y[:, ::-1]


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row per kept row and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows go whose vector is null or empty or holds null, NaN or infinite entries, and rows of another length than most
    (the longer of equals). The fit list holds each distinct whole-number vector once. Components without variance
    (eigenvalue within d*eps of none, against the trace) cannot be whitened and are not returned, so that fewer distinct
    vectors than components give fewer rows, and one vector or none no rows. Repeated rows and repeated or null ids
    give their rows again. `deviation` is null where it exceeds a long.
    """
    spark = vectors.sparkSession
    bad = F.exists(vector_col, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    fine = vectors.where(F.col(vector_col).isNotNull() & ~bad).where(F.size(vector_col) > 0)
    sizes = fine.groupBy(F.size(vector_col).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    d = sizes["d"]
    whole = F.transform(vector_col, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT)
    rows = fine.where(F.size(vector_col) == d).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("x"))
    fit = FitList(rows.select("x").distinct(), d)
    n, sums = fit.n, fit.sums
    trace = float(fit.reduce(lambda z: np.array((z * z).sum()), ())) / n
    if not trace > 0:
        return spark.createDataFrame([], schema)
    e, u = jacobi_davidson(fit.product, d, components)
    e, u = e[e > d * EPS * trace], u[:, e > d * EPS * trace]
    root, k = np.sqrt(e), len(e)

    def moments(z: np.ndarray) -> np.ndarray:
        w = z @ u / root
        return np.vstack([w.sum(axis=0), w.T @ w])

    m = fit.reduce(moments, (k + 1, k)) / n
    error = float(np.abs(m[1:] - np.outer(m[0], m[0]) - np.eye(k)).max())
    share = (e / trace).tolist()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(-1, d)
            off = x * n - sums
            deviation = (off * off).sum(axis=1)
            wide = (off.astype(float) ** 2).sum(axis=1) > 9e18
            w = off / n @ u / root
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(deviation, pa.int64(), mask=wide), pa.ListArray.from_arrays(np.arange(0, w.size + 1, k, dtype=np.int32), w.ravel())], ["vec_id", "deviation", "w"])

    out = rows.mapInArrow(project, "vec_id long, deviation long, w array<double>")
    return out.select("vec_id", "deviation", F.posexplode("w").alias("i", "whitened")).select(
        "vec_id", (F.col("i") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(F.array(*map(F.lit, share)), F.col("i") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    """Every row of `embeddings` with a whole vector, on the first sixteen components."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
