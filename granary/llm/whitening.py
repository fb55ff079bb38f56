"""Operator 13: whitening of embeddings by matrix-free block subspace iteration.

Each entry c becomes the long x = floor(64 c) + 1,000,000. Over all valid vectors the sums S of
the dimensions are exact, and V is the covariance of x. V is never formed: a pass over the rows adds up, in
each task, Xc' (Xc Q) for a block Q of orthonormal columns, Xc being the rows minus S/n, made from the exact
n x - S. The driver holds dimension x block numbers: it takes the QR factors of the product and, by
Rayleigh-Ritz, the eigenvalues and vectors of V within the block, and the passes
end when the residuals |V q - e q| of all ``k`` components are at most ``tolerance`` times the largest eigenvalue;
it fails if ``most_passes`` do not do. The block has 32 columns more than
``k`` or twice as many, at most the dimension; where that is the whole dimension (64 for 32 components) one
pass certifies. A last pass over whitened rows gives their covariance, and so identity_error.

Dropped are rows whose vector is null or empty, has null or non-finite entries, entries of 2**40 or more
(their squares would not fit exact sums), or another length than most valid vectors (of
equally frequent lengths the greater). Components whose eigenvalue is not above ``tolerance`` times the largest
cannot be whitened and are left out, so equal vectors alone give no rows, as an empty table does.
A deviation that does not fit a long is null. Null and repeated ids keep their rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.tables import emit

SCALE, SHIFT, MOST = 64, 1_000_000, 2.0**40
COMPONENTS, TOLERANCE, MOST_PASSES = 32, 1e-12, 200


def whole_numbers(vectors: DataFrame, column: str) -> DataFrame:
    """vec_id and x of the valid rows of the usual length."""
    entries = F.transform(column, lambda c: F.lit(SCALE) * c.cast("double"))
    valid = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < MOST))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), entries.alias("x")).filter(F.col("x").isNotNull() & (F.size("x") > 0)).filter(valid)
    usual = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    rows = rows.filter(F.size("x") == (usual["d"] if usual else 0))
    return rows.select("vec_id", F.transform("x", lambda c: F.floor(c) + F.lit(SHIFT)).alias("x"))


def matrix(batch: pa.RecordBatch, column: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy().reshape(batch.num_rows, -1)


def totals(rows: DataFrame) -> tuple[int, np.ndarray]:
    """n and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch, 0)
                n, total = n + len(x), x.sum(axis=0) + (0 if total is None else total)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(np.full(total.size, n)), pa.array(total)], names=["i", "n", "total"])

    found = rows.select("x").mapInArrow(run, "i int, n long, total long").groupBy("i").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("i").toArrow()
    return (int(found.column("n")[0].as_py()), found.column("total").to_numpy()) if found.num_rows else (0, np.zeros(0, np.int64))


def product(rows: DataFrame, n: int, total: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, float]:
    """V Q for the columns Q of ``block``, and the trace of V, in one pass.

    A task sends one number for each entry of the product; they are added up on the executors.
    """
    shared = rows.sparkSession.sparkContext.broadcast((total, block))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, block = shared.value
        own, squares = np.zeros(block.shape), 0.0
        for batch in batches:
            if batch.num_rows:
                centred = (n * matrix(batch, 0) - total) / n
                own += centred.T @ (centred @ block)
                squares += float(np.einsum("ij,ij->", centred, centred))
        out = np.append(own.ravel(), squares)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size, dtype=np.int32)), pa.array(out)], names=["at", "v"])

    found = rows.select("x").mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(block.size + 1)
    out[found.column("at").to_numpy()] = found.column("v").to_numpy()
    return out[:-1].reshape(block.shape) / n, out[-1] / n


def principal(rows: DataFrame, n: int, total: np.ndarray, k: int = COMPONENTS, tolerance: float = TOLERANCE, most_passes: int = MOST_PASSES) -> tuple[np.ndarray, np.ndarray, float]:
    """The ``k`` largest eigenvalues of V (fewer if V has a lesser rank), unit vectors as columns, and V's trace."""
    d = total.size
    k = min(k, d)
    block = np.linalg.qr(np.random.default_rng(13).standard_normal((d, min(d, max(2 * k, k + 32)))))[0]
    for _ in range(most_passes):
        image, trace = product(rows, n, total, block)
        inner = block.T @ image
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vectors, images = block @ turn, image @ turn
        residuals = np.linalg.norm(images[:, :k] - vectors[:, :k] * values[:k], axis=0)
        if residuals.max() <= tolerance * max(values[0], 0):
            there = int((values[:k] > tolerance * values[0]).sum())
            vectors = vectors[:, :there]
            largest = np.abs(vectors).argmax(axis=0)
            return values[:there], vectors * np.sign(vectors[largest, np.arange(there)]), trace
        block = np.linalg.qr(images)[0]
    raise RuntimeError(f"the components are not certified after {most_passes} passes: residual {residuals.max() / values[0]:.1e} of the largest eigenvalue")


def deviations(away: np.ndarray) -> list[int | None]:
    """Exact sums of squares of the rows, null where one does not fit a long."""
    largest = int(np.abs(away).max(initial=0))
    if largest * largest * away.shape[1] < 1 << 63:
        return (away * away).sum(axis=1).tolist()
    exact = (sum(v * v for v in row) for row in away.tolist())
    return [x if x < 1 << 63 else None for x in exact]


def whitened(vectors: DataFrame, k: int = COMPONENTS, column: str = "embedding", tolerance: float = TOLERANCE, most_passes: int = MOST_PASSES) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error: a row for each valid vector and component."""
    rows = whole_numbers(vectors, column)
    schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])
    kinds = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    n, total = totals(rows)
    if not n:
        return vectors.sparkSession.createDataFrame([], kinds)
    values, axes, trace = principal(rows, n, total, k, tolerance, most_passes)
    axes, share = axes / np.sqrt(values), values / trace if len(values) else values
    away = product(rows, n, total, axes)[0].T @ axes - np.eye(len(values)) if len(values) else np.zeros(0)
    shared = vectors.sparkSession.sparkContext.broadcast((total, axes, share, float(np.abs(away).max(initial=0))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, axes, share, error = shared.value
        c = share.size
        for batch in batches:
            for part in (batch.slice(i, 2048) for i in range(0, batch.num_rows, 2048)):
                away = n * matrix(part, 1) - total
                own = deviations(away)
                each = lambda x: [v for v in x for _ in range(c)]
                yield from emit([{"vec_id": each(part.column(0).to_pylist()), "component": np.tile(np.arange(1, c + 1, dtype=np.int32), len(own)), "n": np.full(len(own) * c, n), "deviation": each(own), "whitened": ((away / n) @ axes).ravel(), "explained": np.tile(share, len(own)), "identity_error": np.full(len(own) * c, error)}], schema)

    return rows.mapInArrow(run, kinds)
