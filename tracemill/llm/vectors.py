"""Near-duplicate embeddings by Euclidean p-stable hashing (operator 8).

Equal vectors of a label form one class with a number of its own. Every class's unit vector is projected on random normal
directions, shifted and cut into cells of width ``w``; the cells of ``bits`` projections make a bucket
of a table. Two unit vectors of cosine ``c`` are ``sqrt(2 - 2c)`` apart, and fall into one cell with a
known probability, from which the number of tables follows; the defaults find a pair at the threshold
of 0.98 with probability 0.98, closer pairs almost surely. Classes that share a bucket of a table are
compared by their exact cosine in double precision; a pair is counted in the first table only that
brings it together, which both know from their lists of buckets.

Buckets of many classes are cut into blocks; each pair of blocks is a group of its own, so no task
gets more than two blocks of a bucket. A task returns, for each class, how many vectors it linked, and
a spanning forest of the links; never the pairs.

Defined cases: vectors that are NULL, zero, or hold NULL or non-finite components, and rows with a
NULL label or id, link with nothing (a row without an id is not in its own component's name).
Repeated ids are rows of their own. Vectors of differing length are not linked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.components import components
from tracemill.operators.joins import join_spread
from tracemill.session import durable

TABLES = 14
BITS = 8
WIDTH = 1.0
BLOCK = 2048


def usable(vector: str):
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit(rows: np.ndarray) -> np.ndarray:
    """Unit vectors; components are scaled first, so that no square overflows."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def buckets(rows: np.ndarray, tables: int, bits: int, width: float, seed: int) -> np.ndarray:
    """A 32-bit bucket for each row and table."""
    rng = np.random.default_rng([seed, rows.shape[1]])
    a, b = rng.normal(size=(rows.shape[1], tables * bits)), rng.uniform(0, width, tables * bits)
    cells = np.floor((rows @ a + b) / width).astype(np.int64).reshape(len(rows), tables, bits)
    odd = rng.integers(1, 2**62, bits) * 2 + 1
    with np.errstate(over="ignore"):
        mixed = (cells * odd).sum(axis=2)
        mixed ^= mixed >> 29
        mixed *= np.int64(-4658895280553007687)
    return (mixed >> 32).astype(np.int32)


def _hash_rows(tables: int, bits: int, width: float, seed: int):
    """Class rows to one row per table."""

    def run(batches):
        for b in batches:
            sizes = np.array([len(v) for v in b.column("v")], np.int64)
            for size in np.unique(sizes):
                part = b.filter(pa.array(sizes == size))
                found = buckets(unit(matrix(part.column("v"))), tables, bits, width, seed)
                n = part.num_rows
                all_buckets = pa.ListArray.from_arrays(pa.array(np.arange(0, n * tables + 1, tables, dtype=np.int32)), pa.array(found.ravel()))
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays(
                        [part.column("class"), part.column("label"), part.column("n"), pa.array(np.full(n, size)), all_buckets, pa.array(np.full(n, t, np.int32)), pa.array(found[:, t])],
                        names=["class", "label", "n", "size", "buckets", "table", "bucket"],
                    )

    return run


def _group_links(classes: np.ndarray, weights: np.ndarray, vectors: np.ndarray, signs: np.ndarray, table: int, side: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of one group: per member the vectors linked, and the member it hangs under (or itself).

    ``side`` is 0 for all members of a lone block; in a pair of blocks only members of different
    blocks are compared.
    """
    n = len(classes)
    linked, parent = np.zeros(n, np.int64), np.arange(n)
    for i in range(0, n, 512):
        cosine = vectors[i : i + 512] @ vectors.T
        x, y = np.nonzero(cosine >= least - 1e-9)
        x = x + i
        keep = x < y
        if side.any():
            keep &= side[x] != side[y]
        x, y = x[keep], y[keep]
        if table and len(x):
            fresh = ~(signs[x, :table] == signs[y, :table]).any(axis=1)
            x, y = x[fresh], y[fresh]
        close = np.einsum("ij,ij->i", vectors[x], vectors[y]) >= least
        x, y = x[close], y[close]
        np.add.at(linked, x, weights[y])
        np.add.at(linked, y, weights[x])
        while len(x):  # union by smallest position
            while not np.array_equal(parent[x], x):
                x = parent[x]
            while not np.array_equal(parent[y], y):
                y = parent[y]
            apart = x != y
            x, y = x[apart], y[apart]
            np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
    return linked, parent, np.flatnonzero((linked > 0) | (parent != np.arange(n)))


def _link_runs(least: float):
    """Sorted rows of groups to rows (class, linked, other); a group may span batches."""
    keys = ("table", "label", "size", "bucket", "i", "j")

    def solve(rows: pa.Table):
        key = np.stack([rows[k].to_numpy().astype(np.int64) for k in keys])
        starts = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)])
        ends = np.r_[starts[1:], key.shape[1]]
        many = ends - starts > 1
        out = []
        classes, weights, side = (rows[c].to_numpy() for c in ("class", "n", "side"))
        vectors, signs = rows["v"].combine_chunks(), rows["buckets"].combine_chunks()
        for a, b in zip(starts[many], ends[many]):
            v, s = unit(matrix(vectors.slice(a, b - a))), signs.slice(a, b - a).flatten().to_numpy().reshape(b - a, -1)
            linked, parent, told = _group_links(classes[a:b], weights[a:b], v, s, int(key[0, a]), side[a:b], least)
            out.append((classes[a:b][told], linked[told], classes[a:b][parent[told]]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["class", "linked", "other"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:
            key = np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in keys])
            changes = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            held.append(b)
            joined = pa.Table.from_batches(held)
            # Up to the last change of the key all groups are complete; one may end with the batch.
            cut = joined.num_rows - b.num_rows + int(changes[-1]) if len(changes) else 0
            if not cut and len(held) > 1 and joined.num_rows > b.num_rows:
                before = np.array([held[-2].column(k)[held[-2].num_rows - 1].as_py() for k in keys], np.int64)
                cut = joined.num_rows - b.num_rows if (before != key[:, 0]).any() else 0
            if cut:
                yield from solve(joined.slice(0, cut).combine_chunks())
                held = joined.slice(cut).combine_chunks().to_batches()
        if held:
            yield from solve(pa.Table.from_batches(held).combine_chunks())

    return run


def near_duplicates(
    rows: DataFrame, least: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    tables: int = TABLES, bits: int = BITS, width: float = WIDTH, block: int = BLOCK, seed: int = 29,
) -> DataFrame:
    """``key, n_links, component_id, kept`` of every row."""
    vectors = rows.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    good = F.col("id").isNotNull() & F.col("label").isNotNull() & usable("v")
    vectors = durable(vectors.withColumn("v", F.when(good, F.col("v"))))
    # A class is a number of its own: an id may stand for several vectors, or under several labels.
    classes = durable(
        vectors.where("v IS NOT NULL").groupBy("label", "v").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
        .withColumn("class", F.monotonically_increasing_id())
    )
    total = classes.agg(F.sum("n")).head()[0] or 0
    # The label only keeps classes apart: it travels as a number.
    tagged = classes.select("class", F.xxhash64(F.col("label").cast("string")).alias("label"), "n", "v")
    hashed = durable(
        tagged.mapInArrow(
            _hash_rows(tables, bits, width, seed),
            "class long, label long, n long, size long, buckets array<int>, table int, bucket int",
        )
    )
    place = ["table", "label", "size", "bucket"]
    full = hashed.groupBy(*place).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    full = full.withColumn("__blocks", F.ceil(F.col("__n") / block).cast("int"))
    # Each row goes to the pairs of blocks that its own block is in.
    dealt = (
        join_spread(hashed, full, place, "__n", ["class"], heavy_rows=max(1000, total // 10_000))
        .withColumn("__own", F.pmod(F.xxhash64("class"), F.col("__blocks")).cast("int"))
        .withColumn("__with", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
        .withColumn("i", F.least("__own", "__with")).withColumn("j", F.greatest("__own", "__with"))
        .withColumn("side", F.when(F.col("i") == F.col("j"), 0).otherwise(F.when(F.col("__own") == F.col("i"), 1).otherwise(2)))
        .drop("__own", "__with", "__blocks", "__n")
        # Only members of shared buckets fetch their vector.
        .join(classes.select("class", "v"), "class")
    )
    group = [*place, "i", "j"]
    linked = durable(
        dealt.repartition(*group).sortWithinPartitions(*group, "class").mapInArrow(_link_runs(least), "class long, linked long, other long")
    )
    sums = linked.groupBy("class").agg(F.sum("linked").alias("linked"))
    roots = components(linked.where("class <> other").select(F.col("class").alias("a"), F.col("other").alias("b")))
    found = (
        classes.join(sums, "class", "left")
        .join(roots.select(F.col("node").alias("class"), "root"), "class", "left")
        .select("label", "v", "n", "least", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "class").alias("root"))
    )
    found = durable(found)
    # A component is named after the smallest id of its vectors.
    names = found.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("__n"))
    found = join_spread(found, names, ["root"], "__n", ["label", "v"], heavy_rows=max(1000, total // 10_000)).drop("__n", "root", "least")
    joined = join_spread(vectors, durable(found), ["label", "v"], "n", ["id"], how="left", heavy_rows=max(1000, total // 10_000))
    return joined.select(
        F.col("id").cast(rows.schema[key].dataType).alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"), (F.col("id") == F.coalesce("component_id", "id")).alias("kept"),
    )
