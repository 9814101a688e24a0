"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation (operator 11).

Y holds the centred rows. From a right vector v comes the left vector u = Yv and from that the next right
vector Yᵀu, each made orthogonal to all before it; then Y = U B Vᵀ with a bidiagonal B, whose small SVD gives
the components and the deviations along them.

Right vectors are as long as a row, left ones as the table. So right ones, and B, are on the driver, and left ones
nowhere: a row's entries of all left vectors follow from the row itself, V and the coefficients so far, and a task works them out
again for the rows at hand. One pass a step gives Yv, made orthogonal with coefficients that YᵀU tells beforehand, Yᵀu, and
Uᵀu, what orthogonality it still lacks, which is then taken off without another pass unless it's more than a trace.

Rows are held as blocks of whole numbers in the shared folder, so a pass reads bytes and multiplies matrices; sums
of a pass are as many numbers as a row has, a few times over.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspan.llm.common import settled

SCALE, SHIFT = 64, 1_000_000
#: Components at most; entries of a block; magnitude from which an entry has no exact whole number and counts as not finite.
COMPONENTS, BLOCK_ENTRIES, TOO_LARGE = 32, 1 << 18, 2.0**40
#: Parts of the largest length below which a vector has no direction but that of rounding.
NOTHING = 64 * np.finfo(float).eps


def whole_numbers(vectors: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * vectors.astype(np.float64)).astype(np.int64) + SHIFT


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column, all of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


@dataclass
class Model:
    """What was fitted: rows, whole-number sums by dimension, components (a column each), eigenvalues, trace of the covariance."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The exact sum over dimensions of (n*x - S)**2 for each row; null beyond 63 bits."""
        far = x.astype(np.float64) * self.n - np.array(self.sums, np.float64)
        short = (far * far).sum(1) < 2.0**62
        with np.errstate(over="ignore"):
            d = x * np.int64(self.n) - np.array([((s + (1 << 63)) % (1 << 64)) - (1 << 63) for s in self.sums], np.int64)  # modulo 2**64, exact where the result is short
            out: list[int | None] = (d * d).sum(1).tolist()
        for i in np.flatnonzero(~short).tolist():
            exact = sum((self.n * a - s) ** 2 for a, s in zip(x[i].tolist(), self.sums, strict=True))
            out[i] = exact if exact < 1 << 63 else None
        return out


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n, as exact as doubles are: the whole part of S/n goes off as a whole number."""
    whole = np.array([s // n for s in sums], np.int64)
    return (x - whole).astype(np.float64) - np.array([s % n / n for s in sums])


def fit_rows(table: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector has only finite entries, at least one, and as many as most vectors have (the more, if two lengths are as frequent)."""
    v = F.col(f"`{vector}`")
    good = v.isNotNull() & F.forall(v, lambda c: F.coalesce(F.abs(c.cast("double")) < TOO_LARGE, F.lit(False))) & (F.size(v) > 0)
    rows = table.where(good)
    lengths = rows.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.where(F.size(v) == (lengths[0]["d"] if lengths else 0))


def blocks_of(rows: DataFrame, vector: str) -> DataFrame:
    """The rows as blocks: rows, data (whole numbers, 64 bits each), sums of each dimension."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = whole_numbers(matrix(batch.column("v")))
            step = max(1, BLOCK_ENTRIES // x.shape[1])
            parts = [x[a : a + step] for a in range(0, len(x), step)]
            yield pa.RecordBatch.from_pydict({"rows": pa.array([len(p) for p in parts], pa.int64()), "data": pa.array([p.astype("<i8").tobytes() for p in parts], pa.binary()), "sums": pa.array([p.sum(0).tolist() for p in parts], pa.list_(pa.int64()))})

    return rows.select(F.col(f"`{vector}`").cast("array<double>").alias("v")).mapInArrow(gather, "rows long, data binary, sums array<long>")


def summed(blocks: DataFrame, of_rows: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all blocks of the numbers that of_rows gives for a block's whole numbers (few and as many for each)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for n, data in zip(batch.column("rows").to_pylist(), batch.column("data"), strict=True):
                part = of_rows(np.frombuffer(data.as_buffer(), "<i8").reshape(n, -1))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(len(total)), pa.int32()), "value": pa.array(total, pa.float64())})

    found = blocks.select("rows", "data").mapInArrow(add, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(len(found))
    for row in found:
        out[row["at"]] = row["value"]
    return out


def left_entries(y: np.ndarray, v: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The rows' entries of the left vectors: Yv = U r, r upper triangular, solved column by column; a zero on its diagonal stands for no vector."""
    u = y @ v
    for j in range(r.shape[1]):
        u[:, j] -= u[:, :j] @ r[:j, j]
        u[:, j] *= 1 / r[j, j] if r[j, j] else 0.0
    return u


def orthogonal(w: np.ndarray, v: np.ndarray) -> np.ndarray:
    """w without its parts along the columns of v; twice, for rounding."""
    for _ in range(2):
        w = w - v @ (v.T @ w)
    return w


def bidiagonal(blocks: DataFrame, n: int, sums: list[int], seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """V (right vectors, a column each, as many as dimensions) and the bidiagonal B with Y = U B Vᵀ.

    Where Yᵀu has no new direction (fewer or equal deviations), a new one is drawn and B has a zero there.
    """
    d = len(sums)
    rng = np.random.default_rng(seed)

    def fresh(v: np.ndarray) -> np.ndarray:
        w = orthogonal(rng.standard_normal(d), v)
        return w / np.linalg.norm(w)

    v = fresh(np.zeros((d, 0)))[:, None]
    r, back = np.zeros((0, 0)), np.zeros((d, 0))  # back: Yᵀu of each left vector
    b = np.zeros((d, d))
    largest = 0.0
    for k in range(d):
        h = back.T @ v[:, k]

        def step(x: np.ndarray, v: np.ndarray = v, r: np.ndarray = r, h: np.ndarray | None = None, k: int = k) -> np.ndarray:
            y = centred(x, n, sums)
            u = left_entries(y, v[:, :k], r)
            new = y @ v[:, k] - u @ h
            return np.concatenate([[new @ new], u.T @ new, y.T @ new])

        for _ in range(3):
            found = summed(blocks, lambda x, h=h, step=step: step(x, h=h))
            size2, lacks, w = found[0], found[1 : 1 + k], found[1 + k :]
            h = h + lacks
            if lacks @ lacks <= 1e-16 * size2:
                break
        alpha = float(np.sqrt(max(0.0, size2 - lacks @ lacks)))
        w = w - back @ lacks
        largest = max(largest, alpha, float(np.linalg.norm(h)))
        if alpha <= NOTHING * largest * np.sqrt(d):
            alpha = 0.0
        w = w / alpha if alpha else np.zeros(d)
        r = np.block([[r, h[:, None]], [np.zeros((1, k)), np.array([[alpha]])]])
        back = np.column_stack([back, w])
        b[k, k] = alpha
        if k + 1 < d:
            w = orthogonal(w - alpha * v[:, k], v)
            beta = float(np.linalg.norm(w))
            largest = max(largest, beta)
            if beta <= NOTHING * largest * np.sqrt(d):
                beta, w = 0.0, fresh(v)
            else:
                w = w / beta
            b[k, k + 1] = beta
            v = np.column_stack([v, w])
    return v, b


def fit(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Model:
    """The model of rows (from fit_rows): up to so many components, those without deviation left out."""
    blocks = settled(blocks_of(rows, vector), "vector-blocks", "zstd")
    n = int(blocks.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0])
    if not n:
        return Model(0, [], np.zeros((0, 0)), np.zeros(0), 0.0)
    by_dimension = blocks.select(F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    sums = [int(r["s"]) for r in sorted(by_dimension, key=lambda r: r["at"])]
    v, b = bidiagonal(blocks, n, sums)
    _, deviations, turned = np.linalg.svd(b)
    kept = deviations > NOTHING * len(sums) * deviations[0]
    kept[components:] = False
    c = v @ turned[kept].T
    c *= np.where(c[np.abs(c).argmax(0), np.arange(c.shape[1])] < 0, -1.0, 1.0)
    model = Model(n, sums, c, deviations[kept] ** 2 / n, float((deviations**2).sum() / n))
    if k := c.shape[1]:
        scale = c / np.sqrt(model.eigenvalues)

        def products(x: np.ndarray) -> np.ndarray:
            z = centred(x, n, sums) @ scale
            return np.concatenate([z.sum(0), (z.T @ z).ravel()])

        found = summed(blocks, products) / n
        mean = found[:k]  # zero but for rounding, so nothing is lost in the difference
        model.identity_error = float(np.abs(found[k:].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())
    return model


def whitened(table: DataFrame, id_column: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    Vectors that are null or empty, or hold a null or an entry that isn't finite (or of 2**40 or more), are left out, and so are those of another length
    than most have. Null ids and repeated rows stay, each row for itself; equal deviations have components in any basis of their plane; directions
    without deviation have no component, so equal vectors alone, and an empty table, give no row; other columns are left out. A deviation beyond 63 bits is null.
    """
    rows = fit_rows(table, vector)
    model = fit(rows, vector, components)
    id_type = table.schema[id_column].dataType
    schema = T.StructType([T.StructField("vec_id", id_type), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("whitened", "explained", "identity_error"))])
    k = model.components.shape[1]
    if not k:
        return table.sparkSession.createDataFrame([], schema)
    scale = model.components / np.sqrt(model.eigenvalues)
    explained = model.eigenvalues / model.trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not (m := batch.num_rows):
                continue
            x = whole_numbers(matrix(batch.column("v")))
            z = model.centred(x) @ scale
            repeat = pa.array(np.repeat(np.arange(m), k))
            columns = [batch.column("vec_id").take(repeat), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, model.n), pa.int64()), pa.array(model.deviations(x), pa.int64()).take(repeat), pa.array(z.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, model.identity_error))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.select(F.col(f"`{id_column}`").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v")).mapInArrow(project, schema)
