"""Whiten embeddings: decorrelated components of unit variance, by a two-pass covariance.

Entries become whole numbers, x = floor(scale * entry) + offset. The first pass adds x up
exactly, which gives the mean S / n as a whole number m and an exact rest. The second pass
adds outer products of centred vectors by matrix products of batches; x - m is exact and
small, so centring loses nothing. Partial matrices of the partitions are merged by
``treeAggregate``; the driver gets one matrix of dimension squared, whatever the number of
rows, and takes its eigenvectors (symmetric, LAPACK). The projection, dimension times
``components`` doubles, travels to the tasks; a third pass measures the covariance of
what it makes. Rows aren't shuffled or written.

Defined results: a vector that is null, holds null, NaN or infinite entries, or an entry
of 2^61 / scale or more, is dropped; so are vectors of another length than the most common
one (of equally common lengths the largest), which lack entries or have too many. Rows may
repeat identifiers or vectors; each counts. A component without variance, to double
precision, has ``whitened`` null and no part in ``identity_error``; ``explained`` is null if
there is no variance at all. ``deviation`` is null over 38 digits. No vectors, or vectors
of length 0, give no rows. Only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Rows of a batch of matrix products: at most so many entries.
ENTRIES = 1 << 20


def valid_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """vec_id, v (array of double): vectors with whole, finite entries."""
    whole = F.forall(vector_col, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < 2.0**61 / scale))
    return rows.select(F.col(id_col).alias("vec_id"), F.when(whole, F.col(vector_col).cast("array<double>")).alias("v")).where(F.col("v").isNotNull())


def common_length(vectors: DataFrame) -> int:
    sizes = vectors.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    found = sizes.orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    return found[0]["d"] if found else 0


def integer_blocks(batches: Iterator[pa.RecordBatch], d: int, scale: int, offset: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(identifiers, x as a matrix of int64) of slices of the batches."""
    step = max(1, ENTRIES // d)
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            v = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            yield part.column("vec_id"), np.floor(scale * v).astype(np.int64) + offset


def exact_sums(x: np.ndarray) -> list[int]:
    """Column sums as whole numbers of any size: high and low halves are added apart."""
    high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
    return [(int(h) << 32) + int(w) for h, w in zip(high, low)]


class Moments:
    """Number, mean and centred outer products of rows; merged pairwise, each centred by
    its own mean before multiplying."""

    def __init__(self, d: int) -> None:
        self.n, self.mean, self.outer = 0, np.zeros(d), np.zeros((d, d))

    def add(self, rows: np.ndarray) -> "Moments":
        other = Moments(rows.shape[1])
        other.n, other.mean = len(rows), rows.mean(axis=0)
        centred = rows - other.mean
        other.outer = centred.T @ centred
        return self.merge(other)

    def merge(self, other: "Moments") -> "Moments":
        if not other.n:
            return self
        n, apart = self.n + other.n, other.mean - self.mean
        self.outer += other.outer + np.outer(apart, apart) * (self.n * other.n / n)
        self.mean += apart * (other.n / n)
        self.n = n
        return self

    def covariance(self) -> np.ndarray:
        return self.outer / self.n


def gathered(vectors: DataFrame, start: Callable, add: Callable, merge: Callable):
    """One value from all rows: ``add`` takes the Arrow batches of a partition, partial
    values are merged in a tree of depth 2."""
    import pickle

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"value": [pickle.dumps(add(start(), batches))]})

    parts = vectors.mapInArrow(partial, "value binary").rdd.map(lambda r: pickle.loads(bytes(r[0])))
    return parts.treeAggregate(start(), merge, merge, depth=2)


def fit(vectors: DataFrame, d: int, scale: int, offset: int) -> tuple[int, list[int], np.ndarray]:
    """(n, S, covariance of x) of the vectors of length ``d``."""

    def add_sums(total, batches):
        n, sums = total
        for _, x in integer_blocks(batches, d, scale, offset):
            n, sums = n + len(x), [a + b for a, b in zip(sums, exact_sums(x))]
        return n, sums

    n, sums = gathered(vectors, lambda: (0, [0] * d), add_sums, lambda a, b: (a[0] + b[0], [p + q for p, q in zip(a[1], b[1])]))
    middle, rest = centre(n, sums)

    def add_outer(total, batches):
        for _, x in integer_blocks(batches, d, scale, offset):
            y = (x - middle) - rest
            total += y.T @ y
        return total

    return n, sums, gathered(vectors, lambda: np.zeros((d, d)), add_outer, np.add) / n


def centre(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The mean as whole numbers and what is left of each, half a unit at most."""
    middle = [(2 * s + n) // (2 * n) for s in sums]
    return np.array(middle, np.int64), np.array([(s - n * m) / n for s, m in zip(sums, middle)])


def components_of(covariance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and their unit eigenvectors as columns."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:k]
    return values[order], vectors[:, order]


def deviations(x: np.ndarray, n: int, sums: list[int], middle: np.ndarray) -> list[int]:
    """For each row the sum of (n * x - S)^2, exact: with y = x - m and T = S - n * m it is
    n^2 * sum(y^2) - 2 * n * sum(y * T) + sum(T^2), whose sums fit in 64 bits for usual rows."""
    rest = [s - n * int(m) for s, m in zip(sums, middle)]
    y, most = x - middle, max(map(abs, rest), default=0)
    largest, d = int(np.abs(y).max(initial=0)), x.shape[1]
    if d * largest * max(largest, most) >= 1 << 62 or most >= 1 << 62:
        y, t = y.astype(object), np.array(rest, object)
    else:
        t = np.array(rest, np.int64)
    squares, cross, constant = (y * y).sum(axis=1), (y * t).sum(axis=1), sum(r * r for r in rest)
    return [n * n * int(a) - 2 * n * int(b) + constant for a, b in zip(squares, cross)]


SHAPE = "deviation decimal(38,0), whitened array<double>"
RESULT = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row
    for each vector and component, ``components`` at most."""
    found = valid_vectors(rows, id_col, vector_col, scale)
    d = common_length(found)
    kind = dict(found.dtypes)["vec_id"]
    if not d:
        none = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
        return rows.sparkSession.createDataFrame([], f"vec_id {kind}, {none}")
    vectors = found.where(F.size("v") == d)
    n, sums, covariance = fit(vectors, d, scale, offset)
    values, axes = components_of(covariance, min(components, d))
    trace, (middle, rest) = float(np.trace(covariance)), centre(n, sums)
    varies = values > d * np.finfo(float).eps * max(values[0], 0.0)
    unit = axes / np.sqrt(np.where(varies, values, 1.0))

    def project(x: np.ndarray) -> np.ndarray:
        return ((x - middle) - rest) @ unit

    def measure(total: Moments, batches: Iterator[pa.RecordBatch]) -> Moments:
        for _, x in integer_blocks(batches, d, scale, offset):
            total.add(project(x)[:, varies])
        return total

    error = None
    if varies.any():
        made = gathered(vectors, lambda: Moments(int(varies.sum())), measure, lambda a, b: a.merge(b)).covariance()
        error = float(np.abs(made - np.eye(len(made))).max())
    most = 10**38

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in integer_blocks(batches, d, scale, offset):
            w = project(x)
            kept = pa.array(w.ravel(), mask=np.tile(~varies, len(w)))
            far = [Decimal(v) if v < most else None for v in deviations(x, n, sums, middle)]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), kept)
            yield pa.RecordBatch.from_arrays([ids, pa.array(far, pa.decimal128(38, 0)), lists], ["vec_id", "deviation", "whitened"])

    explained = F.array(*[F.lit(float(e) / trace if trace > 0 else None).cast("double") for e in values])
    each = vectors.mapInArrow(apply, f"vec_id {kind}, {SHAPE}").select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return each.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("k")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))
