"""Whitening of embeddings from bit-sliced integer cross-products (operator 11).

Components become whole numbers ``x = floor(scale * c)``. The fit list holds each distinct vector of
them once. A task shifts a block of the list so that no number is negative, packs each bit plane of
each dimension across the rows into 64-bit words, and adds up the weighted popcounts of ``AND`` for all
pairs of planes: the block's exact cross-products and sums. They travel as limbs of 30 bits, so that
Spark's sums stay exact at any size, and are put together as whole numbers. ``n * Sxy - Sx * Sy`` is
centred before it is turned into doubles for ``eigh``.

The driver holds one number per pair of dimensions, nothing that grows with the rows.

Defined cases: vectors that are NULL, empty, or hold NULL or non-finite components are left out, as are
vectors of another length than the most frequent one (of equally frequent ones the longest). Rows with
a NULL or repeated key are rows like any other. Numbers beyond a long are its smallest or largest.
Components without variance (fewer than two distinct vectors, or dependent dimensions) have a NULL
``whitened``; ``explained`` is NULL when nothing varies. ``deviation`` is a decimal of 38 digits, NULL
where it has more. ``identity_error`` is measured on the whitened fit list, over components that vary.
An empty table gives an empty one. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.session import durable

# Rows sliced at a time: 128 words a plane.
ROWS = 8192
# Bits of a limb, and limbs of a sum: 2^180 is beyond the products of any number of rows.
LIMB, LIMBS = 30, 6
# An eigenvalue below this share of the largest one is no variance but rounding.
LEAST_SHARE = 1e-13


def whole(vector: str, scale: int) -> Column:
    """The components as longs; NULL if the vector takes no part."""
    usable = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    # A cast of a double beyond a long fails in ANSI mode: cut off before.
    top = float(2**63 - 1024)
    number = lambda c: F.floor(F.greatest(F.lit(-(2.0**63)), F.least(F.lit(top), F.lit(float(scale)) * c.cast("double"))))
    return F.when(F.col(vector).isNotNull() & (F.size(vector) > 0) & usable, F.transform(vector, lambda c: number(c).cast("long")))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def planes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed bit planes of unsigned rows, with dimension and bit of each; planes without a bit are left out."""
    owners, bits, words = [], [], []
    padded = np.zeros((-(-len(rows) // 64) * 64, rows.shape[1]), np.uint64)
    padded[: len(rows)] = rows
    for bit in range(int(rows.max()).bit_length()):
        plane = ((padded >> np.uint64(bit)) & np.uint64(1)).astype(np.uint8)
        used = np.flatnonzero(plane.any(axis=0))
        packed = np.packbits(np.ascontiguousarray(plane[:, used].T), axis=1, bitorder="little")
        words.append(packed.view(np.uint64).reshape(len(used), len(padded) // 64))
        owners.append(used)
        bits.append(np.full(len(used), bit))
    if not words:
        return np.empty(0, int), np.empty(0, int), np.empty((0, 1), np.uint64)
    return np.concatenate(owners), np.concatenate(bits), np.concatenate(words)


def cross_products(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums and cross-products (upper triangle) of unsigned rows, as Python numbers."""
    owners, bits, words = planes(rows)
    d = rows.shape[1]
    sums, products = np.zeros(d, object), np.zeros((d, d), object)
    for bit in np.unique(bits):
        at = bits == bit
        sums[owners[at]] += np.bitwise_count(words[at]).sum(axis=1, dtype=np.int64).astype(object) << int(bit)
    # Counts of one pair of bits go to one matrix, weighted once: 2^(a+b) may be beyond a long.
    for a in np.unique(bits):
        left = np.flatnonzero(bits == a)
        for b in np.unique(bits[bits >= a]):
            right = np.flatnonzero(bits == b)
            count = np.zeros((d, d), np.int64)
            for i in left:
                count[owners[i], owners[right]] = np.bitwise_count(words[i] & words[right]).sum(axis=1, dtype=np.int64)
            both = count if a == b else count + count.T
            if int(a) + int(b) <= 40:  # at most 2^13 rows and two terms
                products += both << int(a + b)
            else:
                products += both.astype(object) << int(a + b)
    return sums, products


def limbs(value: int) -> list[int]:
    return [(value >> (LIMB * k)) & ((1 << LIMB) - 1) for k in range(LIMBS)]


def unlimb(parts) -> int:
    return sum(int(p) << (LIMB * k) for k, p in enumerate(parts))


@dataclass
class Whitening:
    """``size`` dimensions and ``n`` fitted rows, their exact sums, the leading axes as columns, and eigenvalues."""

    size: int
    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def live(self) -> np.ndarray:
        return self.values > max(0.0, LEAST_SHARE * (self.values[0] if len(self.values) else 0.0))

    def centred(self, rows: np.ndarray) -> np.ndarray:
        """``n * x - S``, exact; Python numbers only where a long would not do."""
        most = max([abs(s) for s in self.sums] + [self.n * max(abs(int(rows.max())), abs(int(rows.min())))])
        if most < 2**62:
            return self.n * rows - np.array(self.sums, np.int64)
        return self.n * rows.astype(object) - np.array(self.sums, object)

    def deviations(self, centred: np.ndarray) -> list[Decimal | None]:
        if not centred.size:
            return []
        if int(np.abs(centred).max()) ** 2 * self.size < 2**63:
            found = (centred.astype(np.int64) ** 2).sum(axis=1).tolist()
        else:
            found = (centred.astype(object) ** 2).sum(axis=1).tolist()
        return [Decimal(v) if v < 10**38 else None for v in found]

    def project(self, centred: np.ndarray) -> np.ndarray:
        """Whitened coordinates; NaN for components without variance."""
        scale = np.sqrt(np.where(self.live, self.values, np.nan))
        return (centred.astype(np.float64) / self.n) @ self.axes / scale


def common_size(rows: DataFrame) -> int | None:
    """The most frequent number of components."""
    found = rows.groupBy(F.size("__x").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    return None if found is None else found["size"]


def _scatter(size: int, shift: list[int]):
    """Blocks of the fit list to ``(i, j, rows, limbs...)``; ``j`` is -1 for the sums of a dimension."""

    def run(batches):
        low = np.array(shift, np.int64).view(np.uint64)
        sums, products, n = np.zeros(size, object), np.zeros((size, size), object), 0
        held, waiting = [], 0

        def add(parts):
            nonlocal sums, products
            rows = np.concatenate(parts).view(np.uint64) - low  # wraps around to the true difference
            s, p = cross_products(rows)
            sums, products = sums + s, products + p

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = matrix(batch.column(0).slice(at, ROWS))
                n += len(part)
                if waiting + len(part) > ROWS:
                    add(held)
                    held, waiting = [], 0
                held.append(part)
                waiting += len(part)
        if held:
            add(held)
        if n:
            i, j = np.triu_indices(size)
            values = [int(v) for v in sums] + [int(v) for v in products[i, j]]
            parts = np.array([limbs(v) for v in values], np.int64)
            first = np.r_[np.arange(size), i].astype(np.int32)
            second = np.r_[np.full(size, -1), j].astype(np.int32)
            counts = np.where(np.arange(len(values)) == 0, n, 0).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(first), pa.array(second), pa.array(counts)] + [pa.array(parts[:, k]) for k in range(LIMBS)],
                names=["i", "j", "n", *[f"l{k}" for k in range(LIMBS)]],
            )

    return run


def _least(size: int):
    def run(batches):
        low = None
        for batch in batches:
            if batch.num_rows:
                found = matrix(batch.column(0)).min(axis=0)
                low = found if low is None else np.minimum(low, found)
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(low)], names=["i", "low"])

    return run


def fit(distinct: DataFrame, size: int, components: int = 4) -> Whitening | None:
    """The whitening of a *stored* table of distinct vectors ``__x`` of ``size`` longs; None if it is empty."""
    lows = distinct.mapInArrow(_least(size), "i int, low long").groupBy("i").agg(F.min("low").alias("low")).collect()
    if not lows:
        return None
    low = [r["low"] for r in sorted(lows)]
    names = [f"l{k}" for k in range(LIMBS)]
    schema = "i int, j int, n long, " + ", ".join(f"{k} long" for k in names)
    rows = distinct.mapInArrow(_scatter(size, low), schema).groupBy("i", "j").agg(*[F.sum(k).alias(k) for k in ["n", *names]])
    got = rows.toArrow()
    n = sum(got["n"].to_pylist())
    sums, products = [0] * size, {}
    for i, j, *parts in zip(*[got[k].to_pylist() for k in ["i", "j", *names]]):
        if j < 0:
            sums[i] = unlimb(parts)
        else:
            products[i, j] = unlimb(parts)
    cov = np.empty((size, size))
    for (i, j), p in products.items():
        cov[i, j] = cov[j, i] = (n * p - sums[i] * sums[j]) / (n * n)
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(values, kind="stable")[::-1][:components]
    axes = axes[:, order]
    # One sign for all rows: the largest entry of an axis is positive.
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)
    true_sums = [s + n * k for s, k in zip(sums, low)]
    return Whitening(size, n, true_sums, axes, np.maximum(values[order], 0.0), float(np.trace(cov)))


def identity_error(distinct: DataFrame, model: Whitening) -> float:
    """Largest entry of the whitened fit list's covariance minus the identity, over components that vary."""
    live = np.flatnonzero(model.live)
    k = len(live)
    if not k:
        return 0.0

    def run(batches):
        total, squares = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = model.project(model.centred(matrix(batch.column(0).slice(at, ROWS))))[:, live]
                total, squares = total + part.sum(axis=0), squares + part.T @ part
        values = np.r_[total, squares.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], names=["i", "v"])

    found = distinct.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    values = np.array([r["v"] for r in sorted(found)]) / model.n
    mean, squares = values[:k], values[k:].reshape(k, k)
    return float(np.abs(squares - np.outer(mean, mean) - np.eye(k)).max())


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 256, components: int = 4) -> DataFrame:
    """``key, component, n, deviation, whitened, explained, identity_error``: a row per vector and leading component."""
    rows = df.select(F.col(key).alias("__key"), whole(vector, scale).alias("__x")).where(F.col("__x").isNotNull())
    out = T.StructType(
        [
            T.StructField(key, df.schema[key].dataType), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
            T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("whitened", T.DoubleType()),
            T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType()),
        ]
    )
    size = common_size(rows)
    if size is None:
        return df.sparkSession.createDataFrame([], out)
    rows = rows.where(F.size("__x") == size)
    distinct = durable(rows.select("__x").distinct())
    model = fit(distinct, size, components)
    error = identity_error(distinct, model)
    shares = [float(v) / model.trace if model.trace > 0 else None for v in model.values]
    k = len(model.values)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                centred = model.centred(matrix(part.column(1)))
                m = part.num_rows
                owner = pa.array(np.repeat(np.arange(m), k))
                values = model.project(centred).ravel()
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(owner), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)),
                        pa.array(model.deviations(centred), pa.decimal128(38, 0)).take(owner), pa.array(values, mask=np.isnan(values)),
                        pa.array(shares * m, pa.float64()), pa.array(np.full(m * k, error)),
                    ],
                    names=out.names,
                )

    return rows.mapInArrow(run, out)
