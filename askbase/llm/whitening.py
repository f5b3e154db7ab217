"""Embedding whitening by a matrix-free Jacobi-Davidson solver.

The covariance is never formed.  A product of it with a few vectors is one Spark
job over the table: tasks centre their rows exactly, multiply twice and add up,
and a grouped sum returns one number per dimension and vector.  The driver holds
the search subspace only, vectors as long as an embedding.

Per round: Rayleigh-Ritz on the subspace; pairs whose residual has reached double
precision are locked, from the largest eigenvalue on; for each of the rest the
correction equation (I - QQ')(V - e I)(I - QQ') t = -r, with Q the locked vectors and the
current Ritz block, is solved by a few steps of MINRES; the corrections
extend the subspace.  All corrections share their products, so a step of MINRES is one job
whatever the number of components.

Defined results
  * A row takes part if its vector has the usual length and finite entries whose
    ``floor(1024 * c) + 100000`` is below 2**61; others are dropped.  A null ``vec_id`` stays.
  * Components whose variance is zero within rounding are left out: one row, equal
    rows or no rows give no result, and fewer dimensions than asked for give fewer components.
  * Equal eigenvalues: any orthonormal basis of their space.
  * ``deviation`` is exact; where it does not fit a long it is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from askbase.llm.common import written
from askbase.llm.vectors import finite_rows, usual_length

#: Entries become floor(STEP * c) + SHIFT.
STEP, SHIFT = 1024, 100_000
#: Largest magnitude of an entry times STEP.
LARGEST = 2.0 ** 61
#: Bytes of the entries in one block of rows.
BLOCK_BYTES = 4 << 20
#: Steps of MINRES for a round's corrections, and the reduction at which they end sooner.
INNER_STEPS, INNER_REDUCTION = 4, 1e-4
#: Rounds, far more than are needed; a solver that has not finished by then fails.
MAX_ROUNDS = 200
EPS = float(np.finfo(np.float64).eps)


def jacobi_davidson(times: Callable[[np.ndarray], np.ndarray], dims: int, count: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenpairs of the symmetric ``times``, falling; vectors as columns."""
    count = min(count, dims)
    block, room = min(dims, 2 * count), min(dims, 6 * count)
    rng = np.random.default_rng(seed)
    basis = np.linalg.qr(rng.standard_normal((dims, block)))[0]
    image = times(basis)
    locked, values = np.empty((dims, 0)), []
    best, stalled = np.inf, 0
    for _ in range(MAX_ROUNDS):
        small = basis.T @ image
        e, y = np.linalg.eigh((small + small.T) / 2)
        e, y = e[::-1], y[:, ::-1]
        basis, image = basis @ y, image @ y
        want = min(count - len(values), basis.shape[1])
        size = max([abs(v) for v in [*values, *e[:1]]], default=0.0)
        resid = image[:, :want] - basis[:, :want] * e[:want]
        resid -= locked @ (locked.T @ resid)
        norms = np.linalg.norm(resid, axis=0)
        # as small as products in double precision make it; or no longer falling
        exact = norms <= 4 * EPS * np.sqrt(dims) * size
        open_norm = float(norms.max(initial=0.0))
        stalled = stalled + 1 if open_norm > best / 2 and open_norm < 1e3 * EPS * dims * size else 0
        best = min(best, open_norm)
        if stalled >= 2 or basis.shape[1] + len(values) >= dims:
            exact[:] = norms <= 1e3 * EPS * dims * size
        ready = int(np.argmin(exact)) if not exact.all() else want
        locked = np.column_stack([locked, basis[:, :ready]])
        values += e[:ready].tolist()
        basis, image, e = basis[:, ready:], image[:, ready:], e[ready:]
        resid = resid[:, ready:]
        want -= ready
        if len(values) == count:
            return np.array(values), locked
        if basis.shape[1] + want > room - len(values):
            keep = max(want, block - len(values))
            basis, image, e = basis[:, :keep], image[:, :keep], e[:keep]
        fresh = _corrections(times, np.column_stack([locked, basis[:, :want]]), e[:want], resid)
        for _ in range(2):
            fresh -= locked @ (locked.T @ fresh)
            fresh -= basis @ (basis.T @ fresh)
        u, s, _ = np.linalg.svd(fresh / np.maximum(np.linalg.norm(fresh, axis=0), 1e-300), full_matrices=False)
        fresh = u[:, s > 1e-8]
        free = dims - locked.shape[1] - basis.shape[1]
        if not fresh.shape[1] or free <= 0:
            fresh = rng.standard_normal((dims, min(want, max(free, 0))))
        fresh = fresh[:, :free]
        for _ in range(2):
            fresh -= locked @ (locked.T @ fresh)
            fresh -= basis @ (basis.T @ fresh)
            fresh = np.linalg.qr(fresh)[0] if fresh.shape[1] else fresh
        if fresh.shape[1]:
            basis, image = np.column_stack([basis, fresh]), np.column_stack([image, times(fresh)])
    raise RuntimeError(f"no convergence in {MAX_ROUNDS} rounds")


def _corrections(times, fixed: np.ndarray, e: np.ndarray, resid: np.ndarray) -> np.ndarray:
    """MINRES for all correction equations side by side (columns): t orthogonal to ``fixed``."""
    def project(v):
        v = v - fixed @ (fixed.T @ v)
        return v - fixed @ (fixed.T @ v)

    v = project(-resid)
    beta = np.linalg.norm(v, axis=0)
    start = np.where(beta > 0, beta, 1.0)
    v = v / start
    before, t = np.zeros_like(v), np.zeros_like(v)
    d1, d2 = np.zeros_like(v), np.zeros_like(v)
    c1, s1, c2, s2 = np.ones_like(e), np.zeros_like(e), np.ones_like(e), np.zeros_like(e)
    rest, link = beta.copy(), np.zeros_like(e)
    for _ in range(INNER_STEPS):
        w = project(times(v)) - v * e            # Lanczos on the projected, shifted operator
        alpha = np.einsum("ij,ij->j", v, w)
        w = project(w - v * alpha - before * link)
        nxt = np.linalg.norm(w, axis=0)
        # rotations of the two columns before, then one of our own
        far, mid = s2 * link, c2 * link
        up, here = c1 * mid + s1 * alpha, c1 * alpha - s1 * mid
        length = np.hypot(here, nxt)
        safe = np.where(length > 0, length, 1.0)
        c0, s0 = np.where(length > 0, here / safe, 1.0), np.where(length > 0, nxt / safe, 0.0)
        d0 = np.where(length > 0, (v - d1 * up - d2 * far) / safe, 0.0)
        t = t + d0 * (c0 * rest)
        rest = -s0 * rest
        d2, d1 = d1, d0
        c2, s2, c1, s1 = c1, s1, c0, s0
        before, link = v, nxt
        v = w / np.where(nxt > 0, nxt, 1.0)
        if (np.abs(rest) <= INNER_REDUCTION * start).all():
            break
    return project(t)


class Whitening:
    """Rows as blocks of integers, their exact sums, and the fitted components."""

    def __init__(self, df: DataFrame, count: int = 8):
        self.spark, self.dims, self.count = df.sparkSession, usual_length(df), count
        self.n, self.sums = 0, []
        self.values, self.axes, self.trace = np.empty(0), np.empty((self.dims, 0)), 0.0
        self.blocks = written(_to_blocks(df, self.dims), "white-blocks").persist(StorageLevel.MEMORY_AND_DISK)
        if self.dims:
            self._fit()

    def close(self) -> None:
        self.blocks.unpersist()

    def _fit(self) -> None:
        dims = self.dims

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, high, low = 0, np.zeros(dims, object), np.zeros(dims, object)
            for _, x in _each(batches, dims):
                n += len(x)
                high += (x >> 31).sum(axis=0).astype(object)        # halves cannot overflow in a block
                low += (x & 0x7FFFFFFF).sum(axis=0).astype(object)
            if n:
                yield _cells(np.arange(dims), [str(v) for v in (high * 2 ** 31 + low).tolist()], n)

        got = self.blocks.mapInArrow(add, "i int, s string, n bigint").groupBy("i").agg(
            F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).collect()
        if not got:
            return
        self.n = got[0]["n"]
        self.sums = [int(r["s"]) for r in sorted(got, key=lambda r: r["i"])]
        squares = self._products(np.empty((dims, 0)), squares=True)
        self.trace = float(squares.sum())
        values, axes = jacobi_davidson(self._products, dims, self.count)
        real = values > 16 * EPS * dims * max(self.trace, 0.0)
        self.values, self.axes = values[real], axes[:, real]

    def _centre(self) -> Callable[[np.ndarray], np.ndarray]:
        """x - S/n, rounded once: the whole part is taken off in integers."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        part = np.array([(s % self.n) / self.n for s in self.sums])
        return lambda x: (x - whole) - part

    def _products(self, w: np.ndarray, squares: bool = False) -> np.ndarray:
        """V w, or the diagonal of V: one job over the table."""
        dims, centre, width = self.dims, self._centre(), 1 if squares else w.shape[1]

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, some = np.zeros((dims, width)), False
            for _, x in _each(batches, dims):
                c, some = centre(x), True
                total += (c * c).sum(axis=0)[:, None] if squares else c.T @ (c @ w)
            if some:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims, dtype=np.int32)), *map(pa.array, total.T)],
                                                 names=["i", *[f"v{j}" for j in range(width)]])

        names = [f"v{j}" for j in range(width)]
        parts = self.blocks.mapInArrow(multiply, "i int, " + ", ".join(f"{v} double" for v in names))
        rows = parts.groupBy("i").agg(*[F.sum(v).alias(v) for v in names]).collect()
        out = np.zeros((dims, width))
        for r in rows:
            out[r["i"]] = [r[v] for v in names]
        return out / self.n

    def identity_error(self) -> float:
        """Largest entry of the whitened rows' covariance minus the identity."""
        dims, k, white = self.dims, len(self.values), self._white()

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, some = np.zeros((k, k + 1)), False
            for _, x in _each(batches, dims):
                w, some = white(x), True
                total += np.column_stack([w.T @ w, w.sum(axis=0)])
            if some:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * (k + 1), dtype=np.int32)), pa.array(total.ravel())],
                                                 names=["i", "v"])

        rows = self.blocks.mapInArrow(spread, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        total = np.array([r["v"] for r in sorted(rows, key=lambda r: r["i"])]).reshape(k, k + 1) / self.n
        mean = total[:, k]
        return float(np.abs(total[:, :k] - np.outer(mean, mean) - np.eye(k)).max())

    def _white(self) -> Callable[[np.ndarray], np.ndarray]:
        centre, to = self._centre(), self.axes / np.sqrt(self.values)
        return lambda x: centre(x) @ to

    def transform(self) -> DataFrame:
        """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row per
        vector that takes part and component."""
        schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double"
        k, dims, n, sums = len(self.values), self.dims, self.n, self.sums
        if not k:
            return self.spark.createDataFrame([], schema + ", explained double, identity_error double")
        error, white = self.identity_error(), self._white()
        whole, rest = np.array([s // n for s in sums], np.int64), [s % n for s in sums]

        def deviations(x: np.ndarray) -> list[int | None]:
            c = x - whole
            most = n * int(np.abs(c).max(initial=0)) + n
            if dims * most * most < 2 ** 63:
                return ((n * c - np.array(rest, np.int64)) ** 2).sum(axis=1).tolist()
            big = ((n * c.astype(object) - np.array(rest, object)) ** 2).sum(axis=1).tolist()
            return [v if v < 2 ** 63 else None for v in big]

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, x in _each(batches, dims):
                m = len(x)
                dev = pa.array(deviations(x), pa.int64())
                at = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)),
                     dev.take(at), pa.array(white(x).ravel())], names=["vec_id", "component", "n", "deviation", "whitened"])

        out = self.blocks.mapInArrow(rows, schema)
        share = F.lit([float(e / self.trace) for e in self.values])
        return out.withColumn("explained", F.element_at(share, F.col("component"))).withColumn("identity_error", F.lit(error))


def _to_blocks(df: DataFrame, dims: int) -> DataFrame:
    """``ids, x``: the integer vectors of some rows, as one matrix."""
    rows = max(1, BLOCK_BYTES // (8 * max(dims, 1)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, c = finite_rows(b.column("embedding"), dims)
            fits = (np.abs(c) < LARGEST / STEP).all(axis=1)
            x = np.floor(STEP * c[fits]).astype(np.int64) + SHIFT
            ids = b.column("vec_id").take(pa.array(at[fits]))
            for i in range(0, len(x), rows):
                yield pa.RecordBatch.from_arrays([pa.array([ids[i:i + rows].to_pylist()], pa.list_(pa.int64())),
                                                  pa.array([x[i:i + rows].tobytes()], pa.binary())], names=["ids", "x"])

    src = df.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    if not dims:
        src = src.limit(0)
    return src.mapInArrow(pack, "ids array<bigint>, x binary")


def _each(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for b in batches:
        for i in range(b.num_rows):
            yield b.column("ids")[i].values, np.frombuffer(b.column("x")[i].as_buffer(), np.int64).reshape(-1, dims)


def _cells(i: np.ndarray, s: list[str], n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(s), pa.array(np.full(len(i), n, np.int64))],
                                      names=["i", "s", "n"])


def whiten(df: DataFrame, count: int = 8) -> DataFrame:
    """The vectors of ``df`` in units of their ``count`` leading components (see ``Whitening.transform``)."""
    return Whitening(df, count).transform()
