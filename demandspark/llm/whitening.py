"""Embedding whitening: distributed covariance, float32 eigenvectors, Ogita-Aishima refinement in float64.

Entries become whole numbers first (``floor(256 * c)``), so equal vectors are equal bytes and sums are
exact. The fit list holds each distinct vector once: vectors are packed to the narrowest integers that
hold them and grouped by these bytes. One pass over the fit list gives the exact sums of every
dimension, a second one the covariance: every partition adds up the products of its centred rows and
emits one row a dimension, and the partial rows of a dimension are added in extended precision.

The covariance (dimensions x dimensions, whatever the number of rows) is decomposed on the driver:
``eigh`` in float32, then Ogita and Aishima's refinement with matrix products in float64. A step improves
the orthogonality of all vectors and mixes pairs whose eigenvalues are told apart by the current
accuracy. Eigenvalues that are not told apart form a cluster; the covariance, shifted by the cluster's
mean and projected on the cluster's vectors, is a small problem of its own whose eigenvectors
rotate the cluster, after which the refinement goes on. Steps end when the gap that is told apart is that of
rounding errors.

Defined cases: rows whose vector is null, empty, or holds null or non-finite entries are dropped. Of
the others the dimension is the most frequent length (of several the smallest) and rows of another
length are dropped. Rows with the same id, or none, are rows of their own. With fewer dimensions than
components there are as many components as dimensions. Where an eigenvalue is zero (fewer distinct
vectors than dimensions, constant dimensions) ``whitened`` is null; ``explained`` is null where the
trace is zero, and ``identity_error`` covers the components with an eigenvalue above zero (null if there
are none). ``deviation`` is null beyond the range of a long; entries are cut to that of ``2**52``. An
empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandspark.llm.tables import stored

SCALE, LIMIT = 256.0, 1 << 52
COMPONENTS = 4
#: Packed vectors start with the width of their integers.
WIDTHS = (np.dtype("<i2"), np.dtype("<i4"), np.dtype("<i8"))
RESULT = (
    "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
)


def scaled(lists: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows that can be used, and for each its entries as whole numbers."""
    lists = lists.cast(pa.large_list(pa.float64()))
    at = lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False)  # a null entry reads as NaN
    size = np.diff(at)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    fine = (size > 0) & (bad[at[1:]] == bad[at[:-1]])
    if lists.null_count:
        fine &= ~lists.is_null().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(fine)
    with np.errstate(invalid="ignore", over="ignore"):
        whole = np.clip(np.floor(flat * SCALE), -LIMIT, LIMIT)
    return rows, [whole[at[r] : at[r + 1]].astype(np.int64) for r in rows]


def pack(x: np.ndarray) -> bytes:
    """Equal vectors give equal bytes."""
    top = int(np.abs(x).max(initial=0))
    kind = 0 if top < 1 << 15 else 1 if top < 1 << 31 else 2
    return bytes([kind]) + x.astype(WIDTHS[kind]).tobytes()


def unpacked(packed: pa.Array) -> np.ndarray:
    """The vectors of one length as rows of a matrix."""
    rows = [v.as_py() for v in packed]
    if not rows:
        return np.zeros((0, 0), np.int64)
    return np.stack([np.frombuffer(b, WIDTHS[b[0]], offset=1) for b in rows]).astype(np.int64)


def vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, x`` (packed) and ``size`` of the rows that can be used."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                use, found = scaled(part.column("x"))
                ids = part.column("vec_id").take(pa.array(use))
                packed = pa.array([pack(x) for x in found], pa.binary())
                sizes = pa.array([len(x) for x in found], pa.int32())
                yield pa.RecordBatch.from_arrays([ids, packed, sizes], ["vec_id", "x", "size"])

    given = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    return given.mapInArrow(run, "vec_id bigint, x binary, size int")


def sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and exact sums of every dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            x = unpacked(batch.column("x"))
            if len(x):
                # an entry has 53 bits at most: 1,024 of them stay within a long
                parts = [x[a : a + 1024].sum(axis=0) for a in range(0, len(x), 1024)]
                exact = [sum(int(p[j]) for p in parts) for j in range(x.shape[1])]
                n, total = n + len(x), exact if total is None else [a + b for a, b in zip(total, exact, strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(total)), pa.int32()), pa.array([n] * len(total), pa.int64()), pa.array([str(t) for t in total])],
                ["dim", "n", "total"],
            )

    part = fit.select("x").mapInArrow(run, "dim int, n bigint, total string")
    exact = F.sum(F.col("total").cast("decimal(38,0)")).alias("total")
    found = part.groupBy("dim").agg(F.sum("n").alias("n"), exact).orderBy("dim").collect()  # a row a dimension
    return (found[0]["n"] if found else 0), [int(r["total"]) for r in found]


def covariance(fit: DataFrame, n: int, mean: np.ndarray, by: np.ndarray | None = None) -> np.ndarray:
    """Covariance with divisor ``n`` of the centred vectors, projected by the columns of ``by`` if given."""
    width = len(mean) if by is None else by.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width), np.longdouble)
        some = False
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                x = unpacked(batch.column("x").slice(a, 4096)) - mean
                x = x if by is None else x @ by
                total += x.T @ x
                some = True
        if some:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(width), pa.int32()), pa.array(list(total.astype(np.float64)))], ["dim", "part"]
            )

    def add(parts: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(width, np.longdouble)
        for p in parts["part"]:
            total += p
        return pd.DataFrame({"dim": parts["dim"].iloc[:1], "row": [(total / n).astype(np.float64)]})

    rows = fit.select("x").mapInArrow(run, "dim int, part array<double>")
    found = rows.groupBy("dim").applyInPandas(add, "dim int, row array<double>").collect()  # a row a dimension
    out = np.array([r["row"] for r in sorted(found, key=lambda r: r["dim"])])
    return (out + out.T) / 2


def clusters(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Runs of two or more rising values each within ``gap`` of the next."""
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.diff(values[order]) > gap) + 1
    return [run for run in np.split(order, cuts) if len(run) > 1]


def refine(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One Ogita-Aishima step: eigenvalues, better eigenvectors, and the gap that was told apart."""
    d = len(a)
    r = np.eye(d) - x.T @ x
    s = x.T @ (a @ x)
    r, s = (r + r.T) / 2, (s + s.T) / 2  # so that corrections of near values stay antisymmetric
    values = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(np.diag(s))
    gap = 2 * (np.linalg.norm(off, 2) + np.linalg.norm(a, 2) * np.linalg.norm(r, 2))
    apart = values[None, :] - values[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        mixed = (s + values[None, :] * r) / apart
    e = np.where(np.abs(apart) > gap, mixed, r / 2)
    np.fill_diagonal(e, np.diag(r) / 2)
    return values, x + x @ e, float(gap)


def turn(a: np.ndarray, x: np.ndarray, values: np.ndarray, run: np.ndarray) -> None:
    """Solve a cluster as a small problem of its own, shifted so that its differences are not rounded away."""
    basis = np.linalg.qr(x[:, run])[0]
    inner = basis.T @ (a @ basis - values[run].mean() * basis)
    scale = np.abs(inner).max()
    if scale > 0:
        x[:, run] = basis @ np.linalg.eigh((inner + inner.T) / (2 * scale))[1]


def eigen(a: np.ndarray, steps: int = 20, near: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix to double precision."""
    d = len(a)
    size = float(np.abs(a).max(initial=0.0))
    if size == 0:
        return np.zeros(d), np.eye(d)
    a = a / size
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.float64)
    floor, last = 64 * d * np.finfo(np.float64).eps, np.inf
    for _ in range(steps):
        values, x, gap = refine(a, x)
        if gap <= floor or gap >= last:
            break
        last = gap
        for run in clusters(values, gap):
            turn(a, x, values, run)
    for run in clusters(values, near):  # values so near that a step of the size of rounding errors turns them
        turn(a, x, values, run)
    for _ in range(2):
        x = x + x @ (np.eye(d) - x.T @ x) / 2
    values = np.einsum("ij,ij->j", x, a @ x) * size
    order = np.argsort(-values, kind="stable")
    x = x[:, order]
    signs = np.sign(x[np.abs(x).argmax(axis=0), np.arange(d)])
    return values[order], x * signs


@dataclass(frozen=True)
class Whitening:
    """What the fit list gives: ``n``, exact sums, and the leading components."""

    n: int
    totals: list[int]
    values: np.ndarray
    matrix: np.ndarray  # one column a component, divided by the root of its eigenvalue; NaN where that is zero
    explained: list[float | None]
    identity_error: float | None

    @property
    def dimension(self) -> int:
        return len(self.totals)

    @property
    def mean(self) -> np.ndarray:
        return np.array([t / self.n for t in self.totals])


def fit(found: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fit on the distinct vectors of ``found`` (from :func:`vectors`); None if there are none."""
    distinct = stored(found.groupBy("x").agg(F.first("size").alias("size")), "fit-list")
    lengths = distinct.groupBy("size").count().orderBy(F.desc("count"), "size").first()
    if lengths is None:
        return None
    distinct = distinct.where(F.col("size") == lengths["size"])
    n, totals = sums(distinct)
    mean = np.array([t / n for t in totals])
    v = covariance(distinct, n, mean)
    values, basis = eigen(v)
    k = min(components, len(totals))
    trace = float(np.trace(v))
    floor = max(values.max(initial=0.0), 0.0) * len(totals) * np.finfo(np.float64).eps * 4
    positive = values[:k] > floor
    with np.errstate(divide="ignore", invalid="ignore"):
        matrix = np.where(positive, basis[:, :k] / np.sqrt(np.where(positive, values[:k], 1.0)), np.nan)
    error = None
    if positive.any():
        use = matrix[:, positive]
        error = float(np.abs(covariance(distinct, n, mean, use) - np.eye(use.shape[1])).max())
    explained = [float(e) / trace if trace > 0 else None for e in values[:k]]
    return Whitening(n, totals, values[:k], matrix, explained, error)


def transform(found: DataFrame, model: Whitening, as_lists: bool = False) -> DataFrame:
    """One row for each vector and component (``RESULT``), or one a vector with ``whitened`` as a list."""
    n, totals, mean = model.n, model.totals, model.mean
    matrix = model.matrix
    k = matrix.shape[1]

    def deviations(x: np.ndarray) -> list[int | None]:
        top = n * (int(np.abs(x).max(initial=0)) + max((abs(t) // n + 1 for t in totals), default=0))
        if top < 1 << 31 and top * top * len(totals) < 1 << 62:
            return ((n * x - np.array(totals)) ** 2).sum(axis=1).tolist()
        exact = [sum((n * int(c) - t) ** 2 for c, t in zip(row, totals, strict=True)) for row in x]
        return [e if e < 1 << 63 else None for e in exact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                x = unpacked(part.column("x"))
                out = (x - mean) @ matrix
                far = pa.array(deviations(x), pa.int64())
                if as_lists:
                    values = pa.array([[None if np.isnan(c) else float(c) for c in row] for row in out], pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([part.column("vec_id"), far, values], ["vec_id", "deviation", "whitened"])
                    continue
                m = len(x)
                again = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("vec_id").take(again), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, n)), far.take(again), pa.array(out.ravel(), from_pandas=True),
                        pa.array(model.explained * m, pa.float64()), pa.array([model.identity_error] * (m * k), pa.float64()),
                    ],
                    [c.split()[0] for c in RESULT.split(", ")],
                )

    schema = "vec_id bigint, deviation bigint, whitened array<double>" if as_lists else RESULT
    same = found.where(F.col("size") == model.dimension).select("vec_id", "x")
    return same.mapInArrow(run, schema)


def whitened(rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of every usable row."""
    found = vectors(rows, id_col, vector_col)
    model = fit(found, components)
    if model is None:
        return rows.sparkSession.createDataFrame([], RESULT)
    return transform(found, model)
