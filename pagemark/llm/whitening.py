"""Whitening of embeddings by a randomised range finder.

Entries become integers (64ths of one, rounded down, moved up by SHIFT), so counts and sums are exact. The covariance V is never
gathered from pairs of dimensions on the driver's side of the data: each pass multiplies it with a few columns, V Q = sum of c (c Q) / n
over all centred rows c, in tasks that send one matrix each, and these are added up in a shuffle by the matrices' rows. A random start of
RANK + OVER columns goes through POWERS passes, each made orthonormal on the driver (a matrix of the vectors' dimension, not of
the rows). Rayleigh-Ritz then takes components from the small matrix Q' V Q. Their residuals V q - e q
are of the same pass; where one is above SURE of its eigenvalue, and above what rounding leaves of the first, the range did not hold the components to double precision, and the basis is
expanded to the full dimension, where the same two steps are exact. Spectra that fall fast end early, flat ones expand.
A last pass measures the covariance of the whitened rows.

Centred rows are x - S // n - (S % n) / n: no large number cancels. Ties: equal eigenvalues have components in any basis of their space,
in the order that the driver's solver gives; repeated rows count each. Components whose eigenvalue is not above TINY of the first have nothing to
be scaled to and are left out, so equal rows, or one row, give no rows. Rows are dropped whose vector is null, is empty, holds null, NaN or infinite
entries, or has not the dimension that most rows have (of equally many the largest). Entries beyond 2**53 count as that; a deviation that
a long cannot hold is null. A null id stays. Very long vectors: the driver and each task hold a square of the dimension if
the basis expands. An empty table gives an empty result. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few

#: Components; columns beyond them in the random start; power passes.
RANK, OVER, POWERS = 32, 16, 3
#: Entries are 64ths, moved up by this.
STEPS, SHIFT = 64, 1_000_000
#: Residuals of their eigenvalue, what rounding leaves of the largest one, and eigenvalues of the largest, up to which they count as none.
SURE, ROUNDING, TINY = 1e-12, 1e-14, 1e-12
#: Rows that are worked on at a time.
ROWS = 4_096


def integers(vectors: np.ndarray) -> np.ndarray:
    """Entries in steps, as integers."""
    most = float(1 << 53)
    return np.floor(np.clip(vectors.astype(np.float64) * STEPS, -most, most)).astype(np.int64) + SHIFT


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, vector (doubles) of rows whose vectors are whole."""
    v = F.col("embedding")
    whole = F.size(v) > 0
    odd = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    return rows.where(v.isNotNull() & whole & ~F.coalesce(odd, F.lit(True))).select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("vector"))


@dataclass
class Fit:
    """What all rows have in common."""

    n: int
    sums: list[int]
    components: np.ndarray  #: a column each, by falling eigenvalue
    values: np.ndarray  #: eigenvalues
    explained: np.ndarray
    expanded: bool  #: was the full dimension needed?
    identity_error: float = 0.0

    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        return centre(self.n, self.sums)


def centre(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Whole and broken part of the mean."""
    return np.array([s // n for s in sums], np.int64), np.array([s % n / n for s in sums])


def matrix(column: pa.ListArray) -> np.ndarray:
    """The integers of a batch's vectors, a row each."""
    return integers(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1))


def added(vectors: DataFrame, work: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum of work over matrices of integers: a matrix of a given shape from each task, added up row by row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in few(batches, ROWS):
            if len(batch):
                total += work(matrix(batch["vector"]))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(shape[0]), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["row", "cells"])

    cells = vectors.select("vector").mapInArrow(each, "row int, cells array<double>").select("row", F.posexplode("cells").alias("column", "cell"))
    out = np.zeros(shape)
    found = cells.groupBy("row", "column").agg(F.sum("cell").alias("cell")).toArrow()
    out[found["row"].to_numpy(), found["column"].to_numpy()] = found["cell"].to_numpy()
    return out


def counted(vectors: DataFrame) -> tuple[int, list[int]]:
    """Vectors of the commonest dimension and their exact sums by dimension."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches, ROWS):
            sizes = batch["vector"].value_lengths().to_numpy()
            for d in np.unique(sizes).tolist():
                x = matrix(batch["vector"].filter(pa.array(sizes == d)))
                low = x & 0xFFFFFFFF  # two halves, so that sums of a batch stay below 2**63
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([len(x)] * d, pa.int64()), pa.array((x >> 32).sum(0)), pa.array(low.sum(0))], ["d", "at", "n", "high", "low"]
                )

    parts = vectors.select("vector").mapInArrow(each, "d int, at int, n long, high long, low long")
    sums = parts.groupBy("d", "at").agg(F.sum("n").alias("n"), F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low"))
    most = sums.agg(F.max(F.struct("n", "d")).alias("x")).first().x
    if most is None:
        return 0, []
    rows = sums.where(F.col("d") == most.d).orderBy("at").collect()  # one for each dimension
    return most.n, [(int(r.high) << 32) + int(r.low) for r in rows]


def fit(vectors: DataFrame, rank: int = RANK, over: int = OVER, powers: int = POWERS, sure: float = SURE) -> Fit:
    """Components of the rows of `usable` of the commonest dimension."""
    n, sums = counted(vectors)
    d = len(sums)
    if not n:
        return Fit(0, [], np.zeros((0, 0)), np.zeros(0), np.zeros(0), False)
    vectors = vectors.where(F.size("vector") == d)
    whole, broken = centre(n, sums)

    def times(q: np.ndarray) -> np.ndarray:
        """The covariance times columns, in one pass; the trace in one more column's first cell."""

        def work(x: np.ndarray) -> np.ndarray:
            c = (x - whole) - broken
            return np.hstack([c.T @ (c @ q), np.full((d, 1), (c * c).sum())])

        return added(vectors, work, (d, q.shape[1] + 1)) / n

    def ritz(q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Components and eigenvalues in the span of q, their residuals and the trace."""
        y = times(q)
        y, trace = y[:, :-1], float(y[0, -1])
        small = q.T @ y
        e, u = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-e, kind="stable")[:rank]
        e, u = e[order], u[:, order]
        return q @ u, e, np.linalg.norm(y @ u - (q @ u) * e, axis=0), trace

    width = min(d, rank + over)
    q = np.linalg.qr(np.random.default_rng(7).standard_normal((d, width)))[0]
    for _ in range(powers if width < d else 0):
        q = np.linalg.qr(times(q)[:, :-1])[0]
    components, e, residual, trace = ritz(q)
    first = max(e.max(initial=0.0), 0.0)
    there = e > TINY * first
    expanded = width < d and (not there.any() or bool((residual > np.maximum(sure * e, ROUNDING * first))[there].any()))
    if expanded:
        # the rest of the space, orthogonal to what there is
        more = np.linalg.qr(np.hstack([q, np.random.default_rng(8).standard_normal((d, d - width))]))[0]
        components, e, residual, trace = ritz(more)
    there = e > TINY * max(e.max(initial=0.0), 0.0)
    components, e = components[:, there], e[there]
    out = Fit(n, sums, components, e, e / trace if trace > 0 else e, bool(expanded))
    if len(e):
        scaled = components / np.sqrt(e)

        def spread(x: np.ndarray) -> np.ndarray:
            w = ((x - whole) - broken) @ scaled
            return np.hstack([w.T @ w, w.sum(0)[:, None]])

        moments = added(vectors, spread, (len(e), len(e) + 1)) / n
        mean = moments[:, -1]
        out.identity_error = float(np.abs(moments[:, :-1] - np.outer(mean, mean) - np.eye(len(e))).max())
    return out


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sum of (n x - S) squared of each row, exactly; null where a long cannot hold it."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n for s in sums], np.int64)
    c = x - whole
    most = (int(np.abs(c).max(initial=0)) + 1) * n
    if most * most * max(1, len(sums)) < 1 << 63:
        return ((c * n - rest) ** 2).sum(1).tolist()
    exact = [sum((n * int(a) - int(r)) ** 2 for a, r in zip(row, rest, strict=True)) for row in c]
    return [v if v < 1 << 63 else None for v in exact]


def whitened(rows: DataFrame, rank: int = RANK) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: each usable row of embeddings on each component."""
    vectors = usable(rows)
    found = fit(vectors, rank)
    k, d = len(found.values), len(found.sums)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, broken = found.centre()
        scaled = found.components / np.sqrt(found.values)
        for batch in few(batches, ROWS):
            if not len(batch):
                continue
            x = matrix(batch["vector"])
            w = ((x - whole) - broken) @ scaled
            many = len(x)
            each = np.repeat(np.arange(many), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["vec_id"].take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), many)), pa.array(np.full(many * k, found.n)),
                    pa.array(deviations(x, found.n, found.sums), pa.int64()).take(pa.array(each)), pa.array(w.ravel()), pa.array(np.tile(found.explained, many)), pa.array(np.full(many * k, found.identity_error)),
                ],
                [c.split()[0] for c in schema.split(", ")],
            )

    return vectors.where((F.size("vector") == d) & F.lit(k > 0)).mapInArrow(work, schema)
