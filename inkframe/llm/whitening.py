"""PCA whitening of embeddings: covariance by generated column aggregates, LAPACK on the small matrix, projection by batches.

The covariance is the upper triangle of sums of centred products, one SQL expression a pair of dimensions, summed in one
aggregation (of PAIRS expressions at most; longer vectors take several). The driver holds sums and the covariance, never
vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkframe.llm.common import Scratch, exact, slices, table, tidy

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
PAIRS = 4096
NONE = 1e-12  # a component with this share of the trace, or less, has no direction
COLUMNS = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _upper(rows: DataFrame, columns: list[str]) -> np.ndarray:
    """The symmetric matrix of sums of products of all pairs of columns."""
    d, out = len(columns), np.zeros((len(columns), len(columns)))
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    for at in range(0, len(pairs), PAIRS):
        some = pairs[at : at + PAIRS]
        for (i, j), v in zip(some, rows.selectExpr(*[f"sum({columns[i]} * {columns[j]})" for i, j in some]).first(), strict=True):
            out[i, j] = out[j, i] = v or 0.0
    return out


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """vectors (vec_id, embedding, anything else) to (vec_id, x): x = floor(64 c) + 1000000 of each entry as double.

    Rows go whose vector is null or empty, holds null or non-finite entries, or entries beyond what a long holds.
    """
    v = exact(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    small = F.forall("v", lambda c: c.isNotNull() & (F.abs(c) < float(1 << 56)))  # NaN counts as large
    v = v.where(F.col("v").isNotNull() & (F.size("v") > 0) & small)
    return v.select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE).cast("long") + SHIFT).alias("x"))


class Model:
    """Means, components (columns, unit length, by falling eigenvalue) and eigenvalues of distinct vectors of one length."""

    def __init__(self, n: int, sums: list[int], covariance: np.ndarray, most: int):
        self.n, self.sums = n, sums
        values, vectors = np.linalg.eigh(covariance)
        self.trace = float(np.trace(covariance))
        self.values, self.vectors = values[::-1][:most].copy(), vectors[:, ::-1][:, :most].copy()
        flip = self.vectors[np.abs(self.vectors).argmax(0), np.arange(self.vectors.shape[1])] < 0
        self.vectors[:, flip] *= -1  # either sign will do: the largest entry is positive
        self.sound = self.values > NONE * self.trace
        self.mean = np.array([s / n for s in sums])
        self.error: float | None = None

    def explained(self) -> np.ndarray:
        return np.where(self.sound, self.values / self.trace if self.trace else 0.0, 0.0)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Rows of x, whole numbers, to rows of whitened values; NaN without a direction."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.sound, (x - self.mean) @ self.vectors / np.sqrt(np.where(self.sound, self.values, np.nan)), np.nan)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n x - S) ** 2; None where a long does not hold it."""
        far = max((abs(int(v)) for v in (x.max(), x.min())), default=0) * self.n + max(abs(s) for s in self.sums)
        if far * far * x.shape[1] < 1 << 63:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(1).tolist()
        near = max(abs(self.n * int(v) - s) for col, s in zip(x.T, self.sums, strict=True) for v in (col.max(), col.min()))
        if far < 1 << 63 and near * near * x.shape[1] < 1 << 63:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(1).tolist()
        sums = [sum((self.n * int(v) - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x]
        return [s if s < 1 << 63 else None for s in sums]


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def fit(distinct: DataFrame, d: int, most: int = COMPONENTS) -> Model:
    """The model of distinct vectors x of length d; its error is measured on the whitened vectors themselves."""
    entry = [F.get("x", k) for k in range(d)]
    n, *sums = distinct.agg(F.count("*"), *[F.sum(c.cast("decimal(38,0)")) for c in entry]).first()
    sums = [int(s) for s in sums]
    # No entry is null; columns that Spark knows as such sum several times faster.
    centred = distinct.select(*[F.coalesce(c.cast("double") - F.lit(s / n), F.lit(0.0)).alias(f"c{k}") for k, (c, s) in enumerate(zip(entry, sums, strict=True))])
    model = Model(n, sums, _upper(centred, centred.columns) / n, most)
    k = int(model.sound.sum())

    @tidy
    def run(it):
        for b in it:
            w = model.whiten(_matrix(b.column("x"), d))[:, model.sound]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in w.T], [f"w{j}" for j in range(k)])

    if k:
        white = distinct.select("x").mapInArrow(run, ", ".join(f"w{j} double" for j in range(k)))
        mean = white.selectExpr(*[f"avg(w{j})" for j in range(k)]).first()
        white = white.select(*[F.coalesce(F.col(f"w{j}") - F.lit(m), F.lit(0.0)).alias(f"w{j}") for j, m in enumerate(mean)])
        model.error = float(np.abs(_upper(white, white.columns) / n - np.eye(k)).max())
    return model


def whitening(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """vectors (vec_id, embedding, anything else) to a row per remaining vector (see whole_numbers) and component: COLUMNS.

    The fit counts equal x vectors once. Vectors of different lengths are fitted apart, each length by its own
    distinct vectors. Components number up to `most`, or the length where that is less; one without variance has null
    whitened and no share. Rows that repeat vec_id and vector stay; a deviation that a long does not hold is null; an
    empty table gives no rows.
    """
    spark = vectors.sparkSession
    keep = Scratch(spark, "whitening")
    x = whole_numbers(vectors)
    distinct = keep.save(x.select("x").distinct(), "distinct")
    models = {r.d: fit(distinct.where(F.size("x") == r.d), r.d, most) for r in distinct.select(F.size("x").alias("d")).distinct().orderBy("d").collect()}

    @tidy
    def run(it):
        for whole in it:
            for b in slices(iter([whole])):
                size = b.column("x").value_lengths().to_numpy(zero_copy_only=False)
                for d in np.unique(size).tolist():
                    part, m = b.filter(pa.array(size == d)), models[d]
                    entries = _matrix(part.column("x"), d)
                    w, k = m.whiten(entries), len(m.values)
                    times = lambda v: np.repeat(np.asarray(v), k)  # noqa: E731, B023
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("vec_id").take(pa.array(times(np.arange(len(entries))))),
                            pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(entries))),
                            pa.array(np.full(w.size, m.n, np.int64)),
                            pa.array([v for v in m.deviations(entries) for _ in range(k)], pa.int64()),
                            pa.array(w.ravel(), mask=np.isnan(w).ravel()),
                            pa.array(np.tile(m.explained(), len(entries))),
                            pa.array([m.error] * w.size, pa.float64()),
                        ],
                        [c.split()[0] for c in COLUMNS.split(", ")],
                    )

    return x.mapInArrow(run, COLUMNS)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, 16 components."""
    return whitening(table(spark, sf_dir, "embeddings"))
