"""Whitening of embeddings by Jacobi-Davidson, without a covariance matrix.

Vectors become whole numbers (256 steps to one) and each distinct one counts once. The largest
eigenpairs of their covariance come from Jacobi-Davidson iterations that touch the data only through
products: every task multiplies its centred vectors with a few directions and back, and the tasks'
sums are added. On the driver are a search space of some directions and the small matrix of it.

1. Rayleigh-Ritz over the search space gives approximations and residuals of all wanted pairs not yet locked.
2. Each residual gets a correction from (I - QQ')(A - theta I)(I - QQ') t = -r, Q holding the pair's vector and the
   locked ones, by a few steps of MINRES. The steps of all corrections go together: one product for the whole block.
3. Corrections and residuals are made orthogonal to the search space and extend it; a full space restarts from its
   best vectors.
4. The leading pair is locked when its residual is as small as double precision allows (or stops falling there).

The vectors are packed in blocks in the shared folder, which each product reads. Sums of whole numbers and squared
deviations are exact; products centre vectors before multiplying.

Defined results: rows whose vector is null or holds a null or non-finite entry are dropped, all others give rows,
repeated ones too; a shorter vector is filled with zeros to the longest one's length. Directions in which the vectors do not
differ cannot be whitened: components stop before the first whose eigenvalue is rounding only, so equal vectors, or a single one, give
no rows. Eigenvectors of equal eigenvalues are one orthonormal basis of their space. A deviation beyond 64 bits is
null. Entries beyond 64 bits are held at the ends of that range. Columns beyond ``vec_id`` and ``embedding`` are ignored. Empty in, empty out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.workspace import new_dir

#: Steps to one, in which entries are rounded down.
STEPS = 256

#: Components given.
COMPONENTS = 4

#: MINRES steps of a correction, directions of a search space, and those kept at a restart.
INNER = 3
SPACE = 64
KEPT = 16

#: Outer iterations after which a failure to converge is an error.
OUTER = 200

#: Residuals, as a part of the largest eigenvalue, from which on a pair is as exact as doubles allow when they
#: stop falling, and at which it is locked at once.
NEAR = 1e-12
DONE = 4e-15

#: Numbers of a block of packed vectors.
BLOCK = 500_000

Product = Callable[[np.ndarray], np.ndarray]


# Jacobi-Davidson -----------------------------------------------------------------------


def _orthogonal(vectors: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """Columns made orthogonal to the ``bases`` and to each other; those that vanish are left out."""
    kept = []
    for v in vectors.T:
        size = np.linalg.norm(v)
        for _ in range(3):
            for base in (*bases, np.array(kept).T if kept else np.zeros((len(v), 0))):
                v = v - base @ (base.T @ v)
        if size > 0 and np.linalg.norm(v) > 1e-10 * size:
            kept.append(v / np.linalg.norm(v))
    return np.array(kept).T if kept else np.zeros((len(vectors), 0))


def _minres(product: Product, theta: np.ndarray, bases: list[np.ndarray], right: np.ndarray, steps: int) -> np.ndarray:
    """A few MINRES steps on the projected correction equations of all columns at once.

    Column j is solved in the space orthogonal to ``bases[j]`` with the operator A - theta[j].
    """
    d, k = right.shape

    def project(x: np.ndarray) -> np.ndarray:
        return np.stack([x[:, j] - bases[j] @ (bases[j].T @ x[:, j]) for j in range(k)], axis=1)

    b = project(right)
    beta = np.linalg.norm(b, axis=0)
    live = beta > 0
    v_old, v = np.zeros((d, k)), b / np.where(live, beta, 1)
    x = np.zeros((d, k))
    w, w_old = np.zeros((d, k)), np.zeros((d, k))
    eta, beta_now = beta.copy(), np.zeros(k)
    c, c_old = np.ones(k), np.ones(k)
    s, s_old = np.zeros(k), np.zeros(k)
    for _ in range(steps):
        if not live.any():
            break
        av = project(product(v) - v * theta)
        alpha = np.sum(v * av, axis=0)
        v_new = av - v * alpha - v_old * beta_now
        v_new = project(v_new)
        beta_new = np.linalg.norm(v_new, axis=0)
        # the two rotations before, then the one that removes beta_new
        rho3 = s_old * beta_now
        rho2 = c_old * c * beta_now + s * alpha
        rho1_bar = c * alpha - c_old * s * beta_now
        rho1 = np.hypot(rho1_bar, beta_new)
        solid = live & (rho1 > 0)
        safe = np.where(solid, rho1, 1)
        c_new, s_new = rho1_bar / safe, beta_new / safe
        w_new = (v - w * rho2 - w_old * rho3) / safe
        x = x + np.where(solid, w_new * (c_new * eta), 0)
        eta = np.where(solid, -s_new * eta, eta)
        live = solid & (beta_new > 1e-14 * np.abs(beta))
        v_old, v = v, np.where(live, v_new / np.where(beta_new > 0, beta_new, 1), 0)
        beta_now = np.where(live, beta_new, 0)
        w_old, w = w, w_new
        c_old, c, s_old, s = c, c_new, s, s_new
    return x


def largest_pairs(product: Product, d: int, k: int, scale: float, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric operator on ``d`` dimensions that is nowhere negative, and unit
    eigenvectors as columns. ``product`` multiplies the operator with a block of columns; ``scale`` is a bound of the
    largest eigenvalue (such as the trace)."""
    k = min(k, d)
    space = _orthogonal(np.random.default_rng(seed).standard_normal((d, min(d, k + 2))))
    image = product(space)
    locked, values = np.zeros((d, 0)), []
    before = np.inf
    for _ in range(OUTER):
        small = space.T @ image
        theta, y = np.linalg.eigh((small + small.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        ritz, ritz_image = space @ y, image @ y
        residual = ritz_image - ritz * theta
        residual -= locked @ (locked.T @ residual)
        size = np.linalg.norm(residual, axis=0)
        whole = locked.shape[1] + space.shape[1] >= d  # the search space is all there is
        top = max([scale * 1e-300, *values[:1], theta[0] if len(theta) else 0.0])
        n_locked = len(values)
        while len(values) < k and len(theta):
            stalled = size[0] <= NEAR * top and size[0] >= before / 2
            if not (size[0] <= DONE * top or stalled or (whole and size[0] <= NEAR * top)):
                break
            values.append(float(theta[0]))
            unit = ritz[:, :1] - locked @ (locked.T @ ritz[:, :1])
            locked = np.concatenate([locked, unit / np.linalg.norm(unit)], axis=1)
            theta, size = theta[1:], size[1:]
            ritz, ritz_image, residual = ritz[:, 1:], ritz_image[:, 1:], residual[:, 1:]
            before = np.inf
        if len(values) == k:
            order = np.argsort(-np.array(values), kind="stable")
            return np.array(values)[order], locked[:, order]
        if len(values) == n_locked:
            before = size[0] if len(size) else np.inf
        space, image = ritz, ritz_image
        if space.shape[1] + 2 * (k - len(values)) > SPACE:
            space, image = space[:, :KEPT], image[:, :KEPT]
        n = min(k - len(values), len(theta))
        bases = [np.concatenate([locked, ritz[:, j : j + 1]], axis=1) for j in range(n)]
        if n:
            fresh = _minres(product, theta[:n], bases, -residual[:, :n], INNER)
            fresh = np.concatenate([fresh, residual[:, :n]], axis=1)
            fresh = _orthogonal(fresh, locked, space)
        else:
            fresh = _orthogonal(np.random.default_rng(seed + len(values)).standard_normal((d, 2)), locked, space)
        if fresh.shape[1]:
            space = np.concatenate([space, fresh], axis=1)
            image = np.concatenate([image, product(fresh)], axis=1)
        else:  # nothing to add: products anew take out what rounding has gathered
            space = _orthogonal(space, locked)
            image = product(space)
    raise RuntimeError(f"{len(values)} of {k} pairs converged in {OUTER} iterations")


# Distributed products ------------------------------------------------------------------


def clean_vectors(embeddings: DataFrame) -> DataFrame:
    """``vec_id, embedding`` (doubles) of the rows whose vector is whole and finite."""
    vectors = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vectors.filter(F.col("embedding").isNotNull() & finite)


def whole_numbers(embedding: str, d: int, steps: int = STEPS) -> Column:
    """An embedding as ``d`` longs: entries times ``steps``, rounded down, and zeros behind them."""
    whole = F.transform(embedding, lambda c: F.floor(c * F.lit(float(steps))))
    return F.concat(whole, F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size(embedding)))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _pack(batches: Iterable[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    rows = max(1, BLOCK // d)
    for batch in batches:
        x = _matrix(batch.column("x"), d)
        for lo in range(0, len(x), rows):
            yield pa.RecordBatch.from_arrays([pa.array([x[lo : lo + rows].tobytes()], pa.binary())], names=["block"])


def _blocks(batches: Iterable[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for value in batch.column("block"):
            yield np.frombuffer(value.as_buffer(), np.int64).reshape(-1, d)


class FitList:
    """The distinct vectors, packed in blocks in the shared folder, and what sums over them."""

    def __init__(self, vectors: DataFrame, d: int):
        """``vectors``: a column ``x`` of ``d`` longs."""
        spark = vectors.sparkSession
        path = new_dir(spark, "vectors")
        distinct = vectors.select("x").distinct()
        distinct.mapInArrow(partial(_pack, d=d), "block binary").write.parquet(path)
        self._blocks, self.d = spark.read.parquet(path), d
        self.n, self.sums = self._whole_sums()
        self.mean = np.array([s / self.n for s in self.sums]) if self.n else np.zeros(d)

    def _whole_sums(self) -> tuple[int, list[int]]:
        """How many vectors there are, and the exact sum of each dimension: high and low halves apart, so that
        none overflows."""
        d = self.d

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
            for x in _blocks(batches, d):
                n += len(x)
                high += (x >> 32).sum(axis=0)
                low += (x & 0xFFFFFFFF).sum(axis=0)
            columns = [np.arange(d), np.full(d, n), high, low]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["i", "n", "high", "low"])

        whole = [F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("n", "high", "low")]
        parts = self._blocks.mapInArrow(run, "i long, n long, high long, low long")
        rows = parts.groupBy("i").agg(*whole).orderBy("i").collect()  # a row for each dimension
        if not rows:
            return 0, [0] * d
        return int(rows[0].n), [(int(r.high) << 32) + int(r.low) for r in rows]

    def total(self, of: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
        """The sum over all centred blocks of the ``size`` numbers that ``of`` makes of one."""
        d, mean = self.d, self.mean

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(size, np.longdouble)
            for x in _blocks(batches, d):
                sums += of(x - mean).ravel()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(size)), pa.array(sums.astype(np.float64))], names=["i", "v"]
            )

        rows = self._blocks.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
        out = np.zeros(size)
        out[rows.column("i").to_numpy()] = rows.column("v").to_numpy()
        return out

    def product(self, w: np.ndarray) -> np.ndarray:
        """The covariance times the columns of ``w``, without the covariance."""
        return self.total(lambda x: x.T @ (x @ w), w.size).reshape(w.shape) / self.n

    def trace(self) -> float:
        return float(self.total(lambda x: np.sum(x * x, keepdims=True), 1)[0]) / self.n


# The whole -----------------------------------------------------------------------------

_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
_OUT_ARROW = pa.schema(
    [
        ("vec_id", pa.int64()),
        ("component", pa.int32()),
        ("n", pa.int64()),
        ("deviation", pa.int64()),
        ("whitened", pa.float64()),
        ("explained", pa.float64()),
        ("identity_error", pa.float64()),
    ]
)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """For each row the sum of the squares of ``n * x - sums``, exact; None beyond 64 bits."""
    largest = n * int(np.abs(x.astype(np.float64)).max(initial=0) + 1) + max(map(abs, sums), default=0)
    if largest * largest * max(1, x.shape[1]) < 1 << 63:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    found = ((x.astype(object) * n - np.array(sums, object)) ** 2).sum(axis=1)
    return [int(v) if v < 1 << 63 else None for v in found]


def _whiten(
    batches: Iterable[pa.RecordBatch], mean, scaled, n: int, sums: list[int], explained, error: float
) -> Iterator[pa.RecordBatch]:
    d, k = scaled.shape
    for batch in batches:
        x = _matrix(batch.column("x"), d)
        rows = len(x)
        which = np.repeat(np.arange(rows), k)
        columns = [
            batch.column("vec_id").take(pa.array(which)),
            np.tile(np.arange(1, k + 1), rows),
            np.full(rows * k, n),
            pa.array(deviations(x, n, sums), pa.int64()).take(pa.array(which)),
            ((x - mean) @ scaled).ravel(),
            np.tile(explained, rows),
            np.full(rows * k, error),
        ]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, np.ndarray) else c for c, f in zip(columns, _OUT_ARROW)], schema=_OUT_ARROW)


def whiten(embeddings: DataFrame, k: int = COMPONENTS, steps: int = STEPS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of every row with a whole vector, for its
    first ``k`` components."""
    spark = embeddings.sparkSession
    vectors = clean_vectors(embeddings.withColumn("vec_id", F.col("vec_id").cast("long")))
    d = vectors.agg(F.max(F.size("embedding"))).first()[0]
    none = spark.createDataFrame([], _OUT)
    if not d:
        return none
    x = vectors.select("vec_id", whole_numbers("embedding", d, steps).alias("x"))
    fit = FitList(x, d)
    trace = fit.trace()
    if not trace > 0:
        return none
    values, units = largest_pairs(fit.product, d, k, trace)
    # rounding is all that is left of a direction in which nothing differs
    solid = values > values[0] * d * 1e-13
    values, units = values[solid], units[:, solid]
    scaled = units / np.sqrt(values)
    k = len(values)

    def moments(c: np.ndarray) -> np.ndarray:
        y = c @ scaled
        return np.concatenate([(y.T @ y).ravel(), y.sum(axis=0)])

    sums = fit.total(moments, k * k + k) / fit.n
    means = sums[k * k :]
    error = float(np.abs(sums[: k * k].reshape(k, k) - np.outer(means, means) - np.eye(k)).max())
    run = partial(
        _whiten, mean=fit.mean, scaled=scaled, n=fit.n, sums=fit.sums, explained=values / trace, error=error
    )
    return x.mapInArrow(run, _OUT)
