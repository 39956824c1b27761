"""Whitening of embeddings: exact covariances by polarisation, their eigenvectors, and every vector's projection."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadcurve.llm.work import Work, ship, tidy

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Entries from here on count as non-finite, so that sums over 10 ** 12 vectors stay exact in 38 digits.
LARGEST = float(1 << 34)
#: Eigenvalues up to this part of the largest are zero but for rounding.
RANK = 1e-12
ROWS = 4096
_LONG = (1 << 63) - 1
SCHEMA = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id and x, the whole-numbered vector, of the rows that take part."""
    sound = f"size(embedding) > 0 and forall(embedding, c -> c is not null and abs(cast(c as double)) < {LARGEST}D)"
    whole = f"transform(embedding, c -> cast(floor({SCALE} * cast(c as double)) as bigint) + {OFFSET}L) as x"
    return embeddings.where(f"embedding is not null and coalesce({sound}, false)").selectExpr("cast(vec_id as bigint) as vec_id", whole)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _sums(fit: DataFrame, dims: int, of: Callable[[np.ndarray], list[int]]) -> list[int]:
    """The places of ``of``'s lists of whole numbers, summed exactly over all rows of the fit list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[int] = []
        for batch in batches:
            found = of(_matrix(batch.column("x"), dims))
            total = [a + b for a, b in zip(total, found, strict=True)] if total else found
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(map(Decimal, total), pa.decimal128(38, 0))], ["place", "total"])

    parts = fit.mapInArrow(tidy(run), "place int, total decimal(38,0)")
    return [int(r.total) for r in parts.groupBy("place").agg(F.sum("total").alias("total")).orderBy("place").collect()]


def _exact(values: np.ndarray, factor: int) -> np.ndarray:
    """The values as 64-bit integers if ``factor`` times the largest square fits, else as Python's."""
    largest = int(np.abs(values).max(initial=0))
    return values if factor * largest * largest <= _LONG else values.astype(object)


def pair_squares(centred: np.ndarray) -> list[int]:
    """Sums of squares of every dimension, then of every sum of two dimensions i < j."""
    y = _exact(centred, 4 * max(len(centred), 1))
    out = [int(v) for v in (y * y).sum(0)]
    for i in range(y.shape[1] - 1):
        pair = y[:, i : i + 1] + y[:, i + 1 :]
        out += [int(v) for v in (pair * pair).sum(0)]
    return out


def covariance(n: int, rests: list[int], squares: list[int]) -> np.ndarray:
    """The covariance matrix out of variances alone: twice cov(i, j) is var(i + j) - var(i) - var(j).

    ``squares`` are those of ``pair_squares`` over values less a whole
    number near their mean, ``rests`` the sums of these values. n * squares
    less the squared rest is n * n variances, exact; each entry is rounded
    once.
    """
    dims = len(rests)
    own = [n * squares[i] - rests[i] ** 2 for i in range(dims)]
    out = np.empty((dims, dims))
    at = dims
    for i in range(dims):
        out[i, i] = own[i] / (n * n)
        for j in range(i + 1, dims):
            both = n * squares[at] - (rests[i] + rests[j]) ** 2
            out[i, j] = out[j, i] = (both - own[i] - own[j]) / (2 * n * n)
            at += 1
    return out


@dataclass
class Whitening:
    """n; centre: whole numbers near the mean; rests: sums of what is left; axes (dimension x component), their eigenvalues, and the trace."""

    n: int
    centre: np.ndarray
    rests: np.ndarray
    axes: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0

    def usable(self) -> np.ndarray:
        return self.values > RANK * max(float(self.values.max(initial=0)), 0.0)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened values, not a number in components without variance."""
        scale = np.where(self.usable(), np.sqrt(np.maximum(self.values, 1e-300)), np.nan)
        return ((x - self.centre) - self.rests / self.n) @ self.axes / scale

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n * x - S) ** 2, exact; nothing where it does not fit a long."""
        y = x - self.centre
        largest = self.n * (int(np.abs(y).max(initial=0)) + 1)
        if x.shape[1] * largest * largest > _LONG:
            y = y.astype(object)
            z = self.n * y - self.rests.astype(object)
        else:
            z = self.n * y - self.rests
        return [v if v <= _LONG else None for v in map(int, (z * z).sum(1))]


def fit(vectors: DataFrame, dims: int, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of a fit list (column x, each vector once); nothing if it is empty."""
    n = vectors.count()
    if not n:
        return None
    sums = _sums(vectors, dims, lambda x: [int(v) for v in _exact(x, max(len(x), 1)).sum(0)])
    centre = np.array([s // n for s in sums])
    rests = [s - n * int(c) for s, c in zip(sums, centre, strict=True)]
    v = covariance(n, rests, _sums(vectors, dims, lambda x: pair_squares(x - centre)))
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)
    model = Whitening(n, centre, np.array(rests), axes, values, float(np.trace(v)))
    model.identity_error = _identity_error(vectors, dims, model)
    return model


def _identity_error(vectors: DataFrame, dims: int, model: Whitening) -> float:
    """How far the covariance of the whitened fit list is from the identity, components without variance left out."""
    usable = model.usable()
    k = int(usable.sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            w = model.project(_matrix(batch.column("x"), dims))[:, usable]
            total += np.concatenate((w.sum(0)[None, :], w.T @ w))
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], ["place", "total"])

    if not k:
        return 0.0
    parts = vectors.mapInArrow(tidy(run), "place int, total double")
    total = np.array([r.total for r in parts.groupBy("place").agg(F.sum("total").alias("total")).orderBy("place").collect()]).reshape(k + 1, k)
    # projections are centred already: their mean is rounding
    mean = total[0] / model.n
    return float(np.abs(total[1:] / model.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Every vector's whitened components, one row per vector and component.

    An entry c becomes the whole number floor(64 c) + 1,000,000. The fit
    list has each distinct vector of these once, however many rows share it.
    Over it, squares of centred values are summed exactly for every dimension
    and every sum of two dimensions, in parts by task; covariances are
    differences of these variances. Only sums by dimension or pair come to
    the driver, whose number does not depend on the rows.

    Columns: vec_id, component (from 1, by falling eigenvalue; at most 16 and
    at most the dimensions), n (vectors of the fit list), deviation (exact,
    null where it does not fit a long), whitened, explained, identity_error.
    Rows whose vector is null, empty, or holds an entry that is null, not
    finite or 2 ** 34 and more are left out, as are vectors of another length
    than most have (the shorter length of equally frequent ones). Components
    without variance have whitened null, and explained null if nothing
    varies. Repeated rows give repeated rows, a null vec_id is kept, an empty
    table gives no rows; only vec_id and embedding are read.
    """
    spark = embeddings.sparkSession
    ship(spark)
    rows = whole_vectors(embeddings)
    length = rows.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    dims = length.dims if length else 0
    rows = rows.where(F.size("x") == dims)
    model = fit(Work(spark, "whitening").keep(rows.select("x").distinct(), "fit"), dims, components) if dims else None
    if model is None:
        return spark.createDataFrame([], SCHEMA)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        k = len(m.values)
        explained = m.values / m.trace if m.trace else np.full(k, np.nan)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                x = _matrix(part.column("x"), dims)
                each = np.repeat(np.arange(len(x)), k)
                whitened, shares = m.project(x).ravel(), np.tile(explained, len(x))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("vec_id").take(pa.array(each)),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(each), m.n)),
                        pa.array(m.deviations(x), pa.int64()).take(pa.array(each)),
                        pa.array(whitened, mask=np.isnan(whitened)),
                        pa.array(shares, mask=np.isnan(shares)),
                        pa.array(np.full(len(each), m.identity_error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(tidy(run), SCHEMA)
