"""Whitened embeddings by a matrix-free Jacobi-Davidson method.

Integer entries x have exact sums, so centred entries (n x - S) / n are rounded once. The
covariance is never formed: ``product`` gives V W for a few columns W by one pass over the
stored rows, each batch adding C' (C W) of its centred rows C, summed per cell by Spark.

Jacobi-Davidson works on blocks: Rayleigh-Ritz in a search space; wanted pairs whose
residual is down to rounding are locked, largest first; for the others the correction
equation, projected against locked and current vectors, is solved roughly by a few steps of
MINRES (all columns share each pass), and the corrections widen the space. A full space is
restarted from its best vectors. The driver holds columns of the embedding's width, never
rows: at most ``SPACE`` + ``K`` columns and as many products.

Defined results. Rows whose vector is null or holds null or non-finite entries are dropped.
Shorter vectors are filled with zeros; an empty vector is all zeros. Rows that repeat an id
or a vector count each time. A null id is kept. A component without variance (eigenvalue no
larger than rounding) has a null ``whitened``, share 0 and no part in ``identity_error``.
``explained`` is null if nothing varies. ``deviation`` is null where it exceeds 63 bits.
Fewer dimensions than ``K``: as many components. No rows or no dimension: no result.
Components of equal eigenvalues may be any orthonormal set of theirs; all rows share it.
Raises OverflowError if n times the largest scaled entry exceeds 62 bits.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starmill.llm.stored import stored

K, SCALE, SHIFT = 32, 64, 1_000_000
#: Columns of the search space beside locked ones; steps of MINRES per correction; most rounds.
SPACE, STEPS, ROUNDS = 96, 4, 200
EPS = np.finfo(float).eps


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Integer rows of ``width`` entries; missing ones are those of a zero component."""
    size = np.asarray(pc.list_value_length(column)).astype(np.int64)
    flat = column.flatten().to_numpy()
    if (size == width).all():
        return flat.reshape(-1, width).astype(np.int64)
    made = np.full((len(size), width), SHIFT, np.int64)
    first = np.cumsum(size) - size
    made[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(first, size)] = flat
    return made


def _added(rows: DataFrame, each: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int], width: int) -> np.ndarray:
    """The sum of ``each(batch)`` over all batches; ``shape`` cells reach the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            total += each(_matrix(batch.column("x"), width))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], ["cell", "v"])

    cells = rows.select("x").mapInArrow(add, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
    made = np.zeros(shape[0] * shape[1])
    made[cells.column("cell").to_numpy()] = cells.column("v").to_numpy()
    return made.reshape(shape)


def _orthonormal(new: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """An orthonormal base of what ``new`` adds to the (orthonormal) others; dependent columns go."""
    base = np.column_stack(against) if against else np.zeros((len(new), 0))
    kept: list[np.ndarray] = []
    for v in new.T:
        size = np.linalg.norm(v)
        for _ in range(3):
            v = v - base @ (base.T @ v)
            for u in kept:
                v = v - u * (u @ v)
        left = np.linalg.norm(v)
        if size > 0 and left > 1e-10 * size and len(kept) + base.shape[1] < len(new):
            kept.append(v / left)
    return np.column_stack(kept) if kept else np.zeros((len(new), 0))


def minres(apply: Callable[[np.ndarray], np.ndarray], right: np.ndarray, steps: int) -> np.ndarray:
    """Columns t with small ``apply(t) - right`` by ``steps`` steps each; ``apply`` is symmetric per column."""
    beta = np.linalg.norm(right, axis=0)
    v_old, v = np.zeros_like(right), right / np.where(beta > 0, beta, 1)
    w_old, w, t = np.zeros_like(right), np.zeros_like(right), np.zeros_like(right)
    eta, gamma_old, gamma = beta.copy(), np.ones_like(beta), np.ones_like(beta)
    sigma_old, sigma, before = np.zeros_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    for _ in range(steps):
        u = apply(v)
        alpha = (v * u).sum(0)
        u = u - alpha * v - before * v_old
        after = np.linalg.norm(u, axis=0)
        # the last two rotations, then a new one
        delta = gamma * alpha - gamma_old * sigma * before
        rho_2 = sigma * alpha + gamma_old * gamma * before
        rho_3 = sigma_old * before
        rho = np.hypot(delta, after)
        there = rho > EPS * np.maximum(np.abs(alpha), before)
        safe = np.where(there, rho, 1)
        gamma_old, gamma = gamma, np.where(there, delta / safe, 1)
        sigma_old, sigma = sigma, np.where(there, after / safe, 0)
        w_old, w = w, np.where(there, (v - rho_3 * w_old - rho_2 * w) / safe, 0)
        t = t + gamma * eta * w
        eta = -sigma * eta
        v_old, v = v, np.where(after > 0, u / np.where(after > 0, after, 1), 0)
        before = after
    return t


def eigenpairs(product: Callable[[np.ndarray], np.ndarray], width: int, k: int, space: int = SPACE,
               steps: int = STEPS, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and unit vectors (columns) of a symmetric positive operator."""
    k = min(k, width)
    space = max(space, 2 * k)
    locked, values = np.zeros((width, 0)), np.zeros(0)
    if start is None:
        start = np.random.default_rng(7).standard_normal((width, min(width, k + 8)))
    base = _orthonormal(start)
    image = product(base)
    scale = 0.0
    for _ in range(ROUNDS):
        small = base.T @ image
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        base, image = base @ turn, image @ turn
        scale = max(scale, float(theta[0]) if len(theta) else 0.0, float(values[0]) if len(values) else 0.0)
        left = k - len(values)
        residual = image[:, :left] - base[:, :left] * theta[:left]
        residual -= locked @ (locked.T @ residual)
        size = np.linalg.norm(residual, axis=0)
        # rounding in a product of this width; a space with nothing outside it is exact
        small_enough = 16 * math.sqrt(width) * EPS * scale
        whole = base.shape[1] + locked.shape[1] >= width
        done = left if whole else int(np.argmax(np.append(size > small_enough, True)))
        if done:
            locked, values = np.column_stack((locked, base[:, :done])), np.append(values, theta[:done])
            base, image, theta, residual = base[:, done:], image[:, done:], theta[done:], residual[:, done:]
        if len(values) >= k:
            order = np.argsort(-values, kind="stable")
            return values[order], locked[:, order]
        if base.shape[1] + k - len(values) > space:
            base, image, theta = (x[..., : 2 * (k - len(values))] for x in (base, image, theta))
        wanted = k - len(values)
        current, shift = base[:, :wanted], theta[:wanted]
        fixed = np.column_stack((locked, current))

        def projected(t: np.ndarray) -> np.ndarray:
            t = t - fixed @ (fixed.T @ t)
            t = product(t) - t * shift
            return t - fixed @ (fixed.T @ t)

        aim = -(residual - fixed @ (fixed.T @ residual))
        added = _orthonormal(np.column_stack((minres(projected, aim, steps), aim)), locked, base)
        if not added.shape[1]:
            added = _orthonormal(np.random.default_rng(11 + len(values)).standard_normal((width, wanted)), locked, base)
        base, image = np.column_stack((base, added)), np.column_stack((image, product(added)))
    raise RuntimeError(f"eigenpairs did not settle in {ROUNDS} rounds")


def whiten(table: DataFrame, k: int = K, vector_column: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: one row per row and component."""
    spark = table.sparkSession
    kind = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    sound = F.forall(vector_column, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    number = F.transform(vector_column, lambda c: (F.floor(c.cast("double") * SCALE) + SHIFT))
    rows = stored(table.where(F.col(vector_column).isNotNull() & sound).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), number.alias("x")), "whitening-rows")
    n, width, most = rows.agg(F.count("*"), F.max(F.size("x")), F.max(F.array_max(F.transform("x", F.abs)))).first()
    if not n or not width:
        return spark.createDataFrame([], kind)
    if n * max(most, SHIFT) >= 2 ** 62:
        raise OverflowError(f"{n} rows with entries up to {most} do not fit 64-bit sums")
    places = rows.select(F.posexplode("x").alias("place", "x")).groupBy("place").agg(F.sum(F.col("x") - SHIFT).alias("s"))
    sums = np.full(width, n * SHIFT, np.int64)
    for r in places.collect():  # one row per dimension
        sums[r["place"]] += r["s"]

    def centred(x: np.ndarray) -> np.ndarray:
        return (x * n - sums) / n

    def product(columns: np.ndarray) -> np.ndarray:
        return _added(rows, lambda x: (c := centred(x)).T @ (c @ columns), columns.shape, width) / n

    values, vectors = eigenpairs(product, width, k)
    varies = values > 16 * width * EPS * max(values[0], EPS)
    total = _added(rows, lambda x: (centred(x) ** 2).sum(0)[None], (1, width), width).sum() / n
    scaled = vectors[:, varies] / np.sqrt(values[varies])
    m = scaled.shape[1]
    error = None
    if m:
        mean = _added(rows, lambda x: (centred(x) @ scaled).sum(0)[None], (1, m), width) / n
        cover = _added(rows, lambda x: (w := centred(x) @ scaled - mean).T @ w, (m, m), width) / n
        error = float(np.abs(cover - np.eye(m)).max())
    explained = np.where(varies, values, 0) / total if total > 0 else None

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = len(values)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"), width)
            apart = x * n - sums
            fits = (apart.astype(float) ** 2).sum(1) < 2.0 ** 62.9
            deviation = pa.array(np.where(fits, (np.where(fits[:, None], apart, 0) ** 2).sum(1), 0), mask=~fits)
            made = np.full((len(x), parts), np.nan)
            made[:, varies] = centred(x) @ scaled
            every = np.repeat(np.arange(len(x)), parts)
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(pa.array(every)), pa.array(np.tile(np.arange(1, parts + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(every), n)), deviation.take(pa.array(every)),
                pa.array(made.ravel(), mask=np.tile(~varies, len(x))),
                pa.array(np.tile(explained, len(x))) if explained is not None else pa.nulls(len(every), pa.float64()),
                pa.array([error] * len(every), pa.float64())],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, kind)
