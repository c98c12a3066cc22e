"""Embedding whitening by matrix-free block subspace iteration.

The covariance V of the fit list (each different vector once) is never formed. A pass over the vectors sends a block Q of
orthonormal columns to every task; each adds up Xᵀ(XQ) over its centred rows X, Spark sums the tasks' blocks by cell, and
the driver holds VQ, as many numbers as a vector has dimensions times the block's columns. QR and Rayleigh-Ritz turn
the block into estimates of the largest eigenvectors, and the residuals |Vq - eq| say how good they are: the passes end when
those of all k components are at rounding's level, or, where they come no lower, at a level that certifies each
component against its nearest neighbour. Spectra of embeddings are flat, and a plain power step gains little there, so between
two Rayleigh-Ritz steps the block goes through a Chebyshev polynomial of V (Zhou and Saad, 2007) that keeps small
what lies below the block's smallest estimate: a pass for each degree, with the same sums.

Vectors are integers here, x = floor(256 c), so means, and each row's deviation from them, are exact. The fit list is packed
into blocks of rows once and read from the shared folder by each pass. Nothing else is shuffled: a pass moves one number
for each cell of the block and task. ``whiten`` is row-local.

Defined cases: vectors that are null or empty, that hold null, NaN, infinite or huge entries (2^42 or more in size), or that have
another length than most of the table's take no part and have no rows; with fewer than k eigenvalues above rounding
(copies of one vector, say) there are as many components as such eigenvalues, and none without any;
equal eigenvalues share a space, any basis of which is right; a deviation that doesn't fit 63 bits is null; rows that repeat,
or have no id, each have results; other columns pass through ``whiten``; an empty table stays empty.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import free_names, read_table, ship, written

SCALE = 256
K = 4
#: Columns of the block: at least so many, and at least so many for each component.
BLOCK, PER_COMPONENT = 32, 4
#: Chebyshev degree between two Rayleigh-Ritz steps.
DEGREE = 10
#: Residuals over the largest eigenvalue: rounding's level, and what is good enough where they come no lower.
TIGHT, ENOUGH = 1e-14, 1e-11
#: Passes after which it is an error not to be certified.
MOST_PASSES = 2_000
#: An entry's size before scaling.
HUGE = float(1 << 42)
#: Vectors of a packed block.
ROWS = 2048


@dataclass
class Whitening:
    """n vectors with the sums of each dimension, and the components: unit columns, eigenvalues, residuals."""

    n: int
    sums: list[int]
    trace: float = 0.0
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    residuals: np.ndarray = field(default_factory=lambda: np.zeros(0))
    passes: int = 0
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums]) if self.n else np.zeros(len(self.sums))


def integer_vectors(df: DataFrame, vector: str, name: str) -> DataFrame:
    """The rows that take part, with their integers as an array of longs."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < HUGE))
    whole = df.filter(F.col(vector).isNotNull() & (F.size(vector) > 0)).filter(fine)
    sizes = whole.groupBy(F.size(vector).alias("size")).agg(F.count("*").alias("n"))
    usual = sizes.agg(F.max(F.struct("n", "size"))["size"]).first()[0]  # a row for each length
    whole = whole.filter(F.size(vector) == F.lit(usual or 0))
    return whole.withColumn(name, F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long")))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def fit_list(vectors: DataFrame, name: str) -> DataFrame:
    """(rows, data, sums): each different vector once, packed into blocks of 64-bit integers."""

    def pack(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                x = _matrix(batch.column(0).slice(start, ROWS))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([len(x)], pa.int64()), pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()), pa.array([x.sum(axis=0).tolist()], pa.list_(pa.int64()))],
                    names=["rows", "data", "sums"],
                )

    return written(vectors.select(name).distinct().mapInArrow(pack, "rows long, data binary, sums array<long>"), "fit_list")


def _summed(blocks: DataFrame, each) -> np.ndarray:
    """each(rows of a block) summed over all blocks: a number for each cell and task moves."""

    def run(batches):
        total = None
        for batch in batches:
            for rows, data in zip(batch.column(0), batch.column(1), strict=True):
                part = each(np.frombuffer(data.as_buffer(), np.int64).reshape(rows.as_py(), -1))
                total = part if total is None else total + part
        if total is not None:
            flat = np.asarray(total, np.float64).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int64()), pa.array(flat)], names=["cell", "value"])

    cells = blocks.select("rows", "data").mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(len(cells))
    for c in cells:
        out[c["cell"]] = c["value"]
    return out


def _times(blocks: DataFrame, mean: np.ndarray, n: int, q: np.ndarray) -> np.ndarray:
    """VQ by one pass over the vectors."""

    def each(x):
        z = x - mean
        return z.T @ (z @ q)

    return _summed(blocks, each).reshape(q.shape) / n


def _certified(values: np.ndarray, residuals: np.ndarray, k: int, before: float) -> bool:
    top, worst = values[0], float(residuals[:k].max())
    if worst <= TIGHT * top:
        return True
    return worst <= ENOUGH * top and worst > 0.5 * before  # rounding's level: no pass lowers it


def _subspace(blocks: DataFrame, model: Whitening, k: int, block: int, seed: int = 11) -> None:
    """Fills in the model's components."""
    d, mean = len(model.sums), model.mean
    width = min(d, max(block, PER_COMPONENT * k))
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, width)))[0]
    times = lambda x: _times(blocks, mean, model.n, x)
    before = float("inf")
    while True:
        vq = times(q)
        model.passes += 1
        values, turn = np.linalg.eigh((q.T @ vq + vq.T @ q) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        residuals = np.linalg.norm(vq - q * values, axis=0)
        top = max(float(values[0]), 0.0)
        if top == 0.0:
            return
        found = min(k, int((values > 1e-12 * top).sum()))
        if _certified(values, residuals, found, before):
            break
        if model.passes >= MOST_PASSES:
            raise RuntimeError(f"after {model.passes} passes the residuals are {residuals[:found]}")
        before = float(residuals[:found].max())
        # a Chebyshev polynomial of V, scaled to 1 at the largest eigenvalue, that is small on [0, edge]
        half = max(float(values[-1]), 1e-3 * top) / 2
        first = scale = half / (top - half)
        older, newer = q, (vq - half * q) * (scale / half)
        for _ in range(DEGREE - 1):
            following = 1 / (2 / first - scale)
            older, newer = newer, (times(newer) - half * newer) * (2 * following / half) - older * (scale * following)
            model.passes, scale = model.passes + 1, following
        q = np.linalg.qr(newer)[0]
    q = q[:, :found]
    signs = np.where(q[np.abs(q).argmax(axis=0), np.arange(found)] < 0, -1.0, 1.0)
    model.values, model.vectors, model.residuals = values[:found].copy(), q * signs, residuals[:found]


def _identity_error(blocks: DataFrame, model: Whitening) -> float:
    """How far the covariance of the whitened fit list is from the identity, by one more pass."""
    k = len(model.values)

    def each(x):
        w = model_rows(x)
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    model_rows = _projection(model)
    sums = _summed(blocks, each) / model.n
    mean, square = sums[:k], sums[k:].reshape(k, k)
    return float(np.abs(square - np.outer(mean, mean) - np.eye(k)).max())


def _projection(model: Whitening):
    """Rows of integers to whitened rows."""
    mean, onto = model.mean, model.vectors / np.sqrt(model.values)
    return lambda x: (x - mean) @ onto


def fit(df: DataFrame, vector: str = "embedding", k: int = K, block: int = BLOCK) -> Whitening:
    """The k largest components of the different vectors' covariance, certified by their residuals."""
    ship(df.sparkSession)
    rows = integer_vectors(df.select(F.col(vector).alias("vector")), "vector", "x")
    blocks = fit_list(rows, "x")
    sums = blocks.select("rows", F.posexplode("sums")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("s"), F.sum("rows").alias("n")).orderBy("pos").collect()
    model = Whitening(sums[0]["n"] if sums else 0, [int(r["s"]) for r in sums])
    if model.n:
        mean = model.mean
        model.trace = float(_summed(blocks, lambda x: np.array([((x - mean) ** 2).sum()]))[0] / model.n)
        if model.trace > 0:
            _subspace(blocks, model, k, block)
        if len(model.values):
            model.identity_error = _identity_error(blocks, model)
    return model


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sums over dimensions of (n x - S)^2, exact."""
    most = n * float(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if most * most * max(1, len(sums)) < 2.0**62:
        off = x * n - np.array(sums, np.int64)
        return (off * off).sum(axis=1).tolist()
    found = [sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [v if v < 2**63 else None for v in found]


def whiten(df: DataFrame, model: Whitening, vector: str = "embedding") -> DataFrame:
    """The rows of df that take part, with deviation and whitened (an array, a value a component) in place of columns of these names."""
    ship(df.sparkSession)
    (x,) = free_names(df, "integers")
    rest = [c for c in df.columns if c.lower() not in ("deviation", "whitened")]
    rows = integer_vectors(df, vector, x).filter(F.size(x) == len(model.sums)).select(*rest, x)
    schema = T.StructType([rows.schema[c] for c in rest] + [T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])

    def run(batches):
        onto = _projection(model) if len(model.values) else None
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                whole = _matrix(part.column(len(rest)))
                found = onto(whole) if onto else np.zeros((len(whole), 0))
                offsets = pa.array(np.arange(len(whole) + 1) * found.shape[1], pa.int32())
                new = [pa.array(_deviations(whole, model.n, model.sums), pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(found.ravel(), pa.float64()))]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(rest)], *new], names=[*rest, "deviation", "whitened"])

    return rows.mapInArrow(run, schema)


def op11_subspace_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = fit(vectors)
    explained = F.create_map(*[F.lit(x) for k, e in enumerate(model.values) for x in (k, float(e) / model.trace)]) if len(model.values) else F.create_map().cast("map<int,double>")
    each = whiten(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return each.select(
        "vec_id",
        (F.col("k") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(explained, F.col("k")).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )


QUERIES = {"op11_subspace_whitening": op11_subspace_whitening}
#: SQL has no eigenvectors; the tests hold it against numpy's.
ORACLES: dict[str, str] = {}
