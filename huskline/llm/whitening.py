"""Operator 11: whitening of embeddings from exact integer sums, by bit-sliced popcounts.

A component c becomes the integer x = floor(256 * c).  The fit list holds each distinct x-vector once.  A task
takes its vectors in blocks, shifts every dimension by its least value, so that no number is negative, and
packs each bit of each dimension over 64 rows into a word.  The sum of products of two dimensions is then
the sum over their planes of popcount(plane AND plane), weighted by two to the power of both bits' places; the
shift is taken out again in integers.  Sums of tasks are added as integers, and the covariance n * sum(x y) - S S' is
centred as an integer matrix of any width, before it is divided and handed to eigh.  The driver holds that matrix only: dimensions squared.

Defined results: rows whose vector is null, or holds null, NaN or an infinite entry are dropped; an empty vector stays; where lengths differ,
shorter vectors end in zeros; rows with null or repeated vec_id and repeated rows each give rows of their own; 256 * c
beyond a long becomes the largest or least long; `deviation` is null where it does not fit a long, and `deviation_digits` has it
always; a component without variance (eigenvalue within rounding of zero) has a null `whitened`, takes no part in `identity_error`, and
`explained` is null where the trace is zero; equal eigenvalues come in the order that eigh gives, one for all rows; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, prepare, stash

SCALE = 256
COMPONENTS = 4
#: Rows whose bit planes are held at once, a multiple of 64.
BLOCK = 16_384
#: Shares over which the tasks' sums of a dimension are added up first.
SHARES = 64
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_digits string"
LARGEST = (1 << 63) - 1


def finite(vector: Column) -> Column:
    """Neither null nor with null or non-finite entries."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))


def grid(table: DataFrame) -> tuple[DataFrame, int]:
    """vec_id and x of the remaining rows, and the number of dimensions."""
    vector = F.col("embedding").cast("array<double>")
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("v")).where(finite(F.col("v")))
    least, most = rows.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    width = int(most or 0)
    entry = F.transform("v", lambda c: F.floor(c * float(SCALE)))
    if width and least < width:
        entry = F.concat(entry, F.transform(F.array_repeat(F.lit(0), F.lit(width) - F.size("v")), lambda c: c.cast("long")))
    return rows.select("vec_id", entry.alias("x")), width


def bit_planes(y: np.ndarray, bits: int) -> np.ndarray:
    """Words of (dimension, bit, 64 rows) for unsigned numbers (row, dimension)."""
    rows, width = y.shape
    padded = -(-rows // 64) * 64
    out = np.zeros((width, bits, padded // 8), np.uint8)
    for b in range(bits):
        bit = np.ascontiguousarray(((y >> np.uint64(b)) & np.uint64(1)).astype(np.uint8).T)
        packed = np.packbits(bit, axis=1)
        out[:, b, : packed.shape[1]] = packed
    return out.view(np.uint64)


def scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums by dimension, and sums of products (upper triangle), of integer rows; exact, as Python integers."""
    rows, width = x.shape
    low = x.min(axis=0)
    y = x.astype(np.uint64) - low.astype(np.uint64)  # the difference modulo 2^64 is the true one
    bits = int(y.max()).bit_length() if y.size else 0
    planes = bit_planes(y, bits)
    ones = np.bitwise_count(planes).sum(axis=2, dtype=np.int64)
    weights = np.array([1 << b for b in range(bits)], object)
    sums = (ones.astype(object) * weights).sum(axis=1) if bits else np.zeros(width, object)
    by_weight = np.zeros((max(1, 2 * bits - 1), width, width), np.int64)
    for i in range(width):
        for a in range(bits):
            both = np.bitwise_count(planes[i:] & planes[i, a]).sum(axis=2, dtype=np.int64)
            by_weight[a : a + bits, i, i:] += both.T
    products = sum((by_weight[s].astype(object) * (1 << s) for s in range(len(by_weight))), np.zeros((width, width), object))
    shift = low.astype(object)
    products = products + np.outer(shift, sums) + np.outer(sums, shift) + rows * np.outer(shift, shift)
    return sums + rows * shift, products


def vectors(column: pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), width)


def _blocks(batches, place: int, width: int):
    held, rows = [], 0
    for batch in batches:
        if len(batch):
            held.append(vectors(batch.column(place), width))
            rows += len(batch)
        if rows >= BLOCK:
            yield np.concatenate(held)
            held, rows = [], 0
    if rows:
        yield np.concatenate(held)


def _joined(sums: dict) -> pa.RecordBatch:
    """One row a dimension and share: n and the dimension's sum and products, as decimal text, as they may have any width."""
    keys = sorted(sums)
    return pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([" ".join(map(str, sums[k])) for k in keys], pa.string())],
        names=["dim", "share", "numbers"],
    )


def fit_sums(fit: DataFrame, width: int) -> tuple[int, list[int], np.ndarray]:
    """n, the sums S, and the matrix of products of the fit list (rows with x)."""

    def run(batches):
        total: dict = {}
        share = TaskContext.get().partitionId() % SHARES
        for x in _blocks(batches, 0, width):
            sums, products = scatter(x)
            for i in range(width):
                new = [len(x), sums[i], *products[i, i:]]
                old = total.get((i, share))
                total[i, share] = [a + b for a, b in zip(old, new)] if old else new
        yield _joined(total)

    def add_up(batches):
        total: dict = {}
        for batch in batches:
            for dim, share, numbers in zip(*(c.to_pylist() for c in batch.columns)):
                new = list(map(int, numbers.split(" ")))
                old = total.get((dim, share))
                total[dim, share] = [a + b for a, b in zip(old, new)] if old else new
        yield _joined(total)

    schema = "dim int, share int, numbers string"
    some = fit.select("x").mapInArrow(run, schema).repartition("dim", "share").mapInArrow(add_up, schema)
    rows = some.withColumn("share", F.lit(0)).repartition("dim").mapInArrow(add_up, schema).collect()  # a row a dimension
    n, sums, products = 0, [0] * width, np.zeros((width, width), object)
    for r in rows:
        n, sums[r.dim], *rest = map(int, r.numbers.split(" "))
        products[r.dim, r.dim :] = rest
        products[r.dim :, r.dim] = rest
    return n, sums, products


@dataclass
class Whitener:
    """n, S, and the first components of the covariance of x: unit vectors (rows), eigenvalues, and the trace."""

    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    trace: float

    @classmethod
    def of(cls, n: int, sums: list[int], products: np.ndarray, components: int = COMPONENTS) -> Whitener:
        width = len(sums)
        centred = [[n * products[i, j] - sums[i] * sums[j] for j in range(width)] for i in range(width)]
        trace = sum(centred[i][i] for i in range(width)) / (n * n) if n else 0.0
        if not n or not width:
            return cls(n, sums, np.zeros((0, width)), np.zeros(0), trace)
        values, axes = np.linalg.eigh(np.array([[v / (n * n) for v in row] for row in centred], float))
        order = np.arange(width)[::-1][:components]
        axes = axes[:, order].T
        signs = np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])
        return cls(n, sums, axes * signs[:, None], np.maximum(values[order], 0), trace)

    @property
    def usable(self) -> np.ndarray:
        """Which components vary by more than rounding."""
        return self.values > self.trace * len(self.sums) * 1e-14

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact."""
        most = self.n * int(np.abs(x.astype(float)).max(initial=0) + 1) + max(map(abs, self.sums), default=0)
        if most < 1 << 62:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def squares(self, d: np.ndarray) -> list[int]:
        """Sum of squares of each row, exact."""
        if d.dtype != object and d.shape[1] * float(np.abs(d).max(initial=0)) ** 2 < 1e18:
            return (d * d).sum(axis=1).tolist()
        d = d.astype(object)
        return list((d * d).sum(axis=1)) if d.size else [0] * len(d)

    def whitened(self, d: np.ndarray) -> np.ndarray:
        """(row, component) of the deviations; zero where a component is not usable."""
        scale = np.where(self.usable, 1 / np.sqrt(np.where(self.usable, self.values, 1)), 0)
        return (d.astype(float) / self.n) @ self.axes.T * scale


def identity_error(fit: DataFrame, width: int, known, k: int) -> float | None:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    usable = np.flatnonzero(known.value.usable).tolist()
    if not usable:
        return None

    def run(batches):
        model = known.value
        for batch in batches:
            if len(batch):
                w = model.whitened(model.deviations(vectors(batch.column(0), width)))
                yield pa.RecordBatch.from_arrays([pa.array(w[:, j]) for j in range(k)], names=[f"w{j}" for j in range(k)])

    spread = fit.select("x").mapInArrow(run, ", ".join(f"w{j} double" for j in range(k)))
    pairs = [(i, j) for i in usable for j in usable if i <= j]
    found = spread.agg(*[F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whiten(table: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, deviation_digits for each remaining row of `table` and component."""
    spark = table.sparkSession
    prepare(spark)
    rows, width = grid(table)
    fit = stash(rows.select("x").distinct())
    model = Whitener.of(*fit_sums(fit, width), components)
    known = spark.sparkContext.broadcast(model)
    k = len(model.axes)
    error = identity_error(fit, width, known, k)
    discard(fit)

    def run(batches):
        model = known.value
        explained = [v / model.trace if model.trace else None for v in model.values.tolist()]
        for batch in batches:
            if not len(batch) or not k:
                continue
            d = model.deviations(vectors(batch.column(1), width))
            exact = model.squares(d)
            w, rows = model.whitened(d), len(batch)
            place = np.repeat(np.arange(rows), k)
            white = pa.array(w.ravel(), mask=np.tile(~model.usable, rows))
            told = pa.array([v if v <= LARGEST else None for v in exact], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(place)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, model.n)), told.take(pa.array(place)), white,
                    pa.array(explained * rows, pa.float64()), pa.array([error] * (rows * k), pa.float64()), pa.array([str(v) for v in exact], pa.string()).take(pa.array(place)),
                ],
                names=[x.split()[0] for x in SCHEMA.split(", ")],
            )

    return rows.mapInArrow(run, SCHEMA)
