"""Exact top-k search by inner product over an impact-ordered index, score at a time (operator 1).

Vectors of integers are dealt out to shards of bounded size. The index of a shard holds, for each
dimension, its vectors in order of their component, cut into segments of quantised impact: the
segment's vectors and the largest and smallest component in it. For a query a segment can add at most
``q * max`` (or ``q * min`` for a negative ``q``); what it falls short of the best segment of its
dimension is its loss. Segments of all dimensions are processed by growing loss, in rounds: a vector's
accumulator takes the losses of its segments; a dimension in which it was not met yet loses at least
the round's bound. So after every round each vector has an upper bound, ``best - losses - bound * (dims
not met)``. Vectors with the best bounds are scored exactly; their k-th best score is a threshold, and
the search of the shard ends only when the bound proves every vector outside that can reach it, or
nothing is left to process. All vectors whose bound reaches the threshold, ties included, are scored
exactly. The results of the shards are merged by rank.

Queries meet shards block by block: both travel as packed blocks, and each task gets one block of
queries and one shard. Result rows are at most k for each query and shard.

Defined cases: vectors that are NULL or hold NULL or non-finite components take no part, neither do
rows without an id. Vectors may differ in length; missing components count 0. Every row is a
candidate of its own; a query never meets rows of its own id. Queries are distinct ids (the row with
the smallest vector counts if an id repeats). Ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.session import durable

SHARD_ROWS = 8192
QUERY_ROWS = 512
SEGMENTS = 16


def quantise(df: DataFrame, scale: int = 1024, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id, v``: whole-number vectors, ``floor(scale * x)`` of every component as double."""
    fits = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & fits).select(
        F.col(key).cast("long").alias("id"),
        F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("v"),
    )


def _dense(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and a matrix, short vectors filled with 0."""
    ids = rows["id"].to_numpy()
    lists = rows["v"].combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else lists.chunk(0)
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy()
    out = np.zeros((len(ids), int(sizes.max(initial=0))), np.int64)
    row = np.repeat(np.arange(len(ids)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return ids, out


def build_index(matrix: np.ndarray, segments: int = SEGMENTS) -> dict[str, np.ndarray]:
    """Postings in impact order and the limits of each dimension's segments.

    ``order[d]`` lists the vectors by component; segment ``s`` of dimension ``d`` is
    ``order[d, cuts[s]:cuts[s + 1]]`` with components from ``low[d, s]`` to ``high[d, s]``.
    """
    n, dims = matrix.shape
    order = np.argsort(matrix, axis=0, kind="stable").T.astype(np.int32)
    cuts = np.unique(np.linspace(0, n, min(segments, n) + 1).astype(np.int64))
    values = np.take_along_axis(matrix.T, order, axis=1)
    return {"order": order, "cuts": cuts, "low": values[:, cuts[:-1]], "high": values[:, cuts[1:] - 1]}


def search(matrix: np.ndarray, ids: np.ndarray, index: dict[str, np.ndarray], query: np.ndarray, query_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (ids, scores) of one shard for one query, exactly."""
    n, dims = matrix.shape
    q = np.zeros(dims, np.int64)
    m = min(dims, len(query))
    q[:m] = query[:m]
    used = np.flatnonzero(q)
    best_of = np.where(q[:, None] >= 0, q[:, None] * index["high"], q[:, None] * index["low"])[used]
    top = best_of.max(axis=1, initial=np.iinfo(np.int64).min, keepdims=True) if len(used) else best_of
    loss = top - best_of
    ceiling = int(top.sum()) if len(used) else 0
    own = ids == query_id
    exact = np.full(n, np.iinfo(np.int64).min)
    known = own.copy()

    def rescore(pick: np.ndarray) -> None:
        pick = pick[~known[pick]]
        exact[pick] = matrix[pick] @ q
        known[pick] = True

    lost, met = np.zeros(n, np.int64), np.zeros(n, np.int64)
    done = np.zeros(loss.shape, bool)
    cuts, want = index["cuts"], min(k, int((~own).sum()))
    rounds = np.quantile(loss, (0.1, 0.3)) if loss.size else []
    for bound in [*np.floor(rounds).astype(np.int64), None]:
        ready = ~done if bound is None else ~done & (loss < bound)
        picked = [index["order"][used[d], cuts[s] : cuts[s + 1]] for d, s in zip(*np.nonzero(ready))]
        if picked:
            postings = np.concatenate(picked)
            # Sums of whole numbers as doubles: exact below 2^53.
            lost += np.bincount(postings, np.repeat(loss[ready], [len(p) for p in picked]), n).astype(np.int64)
            met += np.bincount(postings, minlength=n)
        done |= ready
        upper = ceiling - lost - (0 if bound is None else (len(used) - met) * bound)
        upper[own] = np.iinfo(np.int64).min
        first = np.argpartition(upper, max(0, n - 4 * k))[max(0, n - 4 * k) :]
        rescore(first)
        if want == 0:
            break
        threshold = np.partition(exact, n - want)[n - want]
        open_rows = np.flatnonzero((upper >= threshold) & ~known)
        if bound is None or len(open_rows) <= max(64, n // 16):
            rescore(open_rows)  # proof: all others are below the threshold
            break
    scored = np.flatnonzero(known & ~own)
    order = scored[np.lexsort((ids[scored], -exact[scored]))][:k]
    return ids[order], exact[order]


def _pack(rows: pa.Table, column: str) -> pa.Table:
    ids, matrix = _dense(rows)
    order = np.argsort(ids, kind="stable")
    small = matrix.astype(np.int32) if np.array_equal(matrix.astype(np.int32), matrix) else matrix
    return pa.table(
        {column: rows[column].slice(0, 1), "ids": [ids[order].tobytes()], "width": pa.array([small.dtype.itemsize], pa.int32()), "data": [np.ascontiguousarray(small[order]).tobytes()]}
    )


def _unpack(ids: bytes, width: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    keys = np.frombuffer(ids, np.int64)
    values = np.frombuffer(data, np.int32 if width == 4 else np.int64)
    return keys, values.reshape(len(keys), -1).astype(np.int64)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows ``id, v`` of ``vectors`` where ``is_query`` holds."""
    vectors = durable(vectors)
    queries = vectors.where(is_query).groupBy("id").agg(F.min("v").alias("v"))
    n, m = vectors.count(), queries.count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-m // query_rows))
    packed = "ids binary, width int, data binary"
    deal = lambda parts, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(parts)).cast("int")
    shard = vectors.withColumn("shard", deal(shards, 1)).groupBy("shard").applyInArrow(lambda rows: _pack(rows, "shard"), f"shard int, {packed}")
    block = queries.withColumn("block", deal(blocks, 2)).groupBy("block").applyInArrow(lambda rows: _pack(rows, "block"), f"block int, {packed}")
    # Every block of queries meets every shard: both are copied once per partner and joined by pair.
    left = shard.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = block.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    pairs = left.join(right.withColumnsRenamed({"ids": "q_ids", "width": "q_width", "data": "q_data"}), ["shard", "block"])

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                ids, matrix = _unpack(row["ids"], row["width"], row["data"])
                q_ids, q = _unpack(row["q_ids"], row["q_width"], row["q_data"])
                index = build_index(matrix)
                found = [search(matrix, ids, index, v, i, k) for i, v in zip(q_ids, q)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(q_ids, [len(f[0]) for f in found]), pa.int64()),
                        pa.array(np.concatenate([f[0] for f in found]), pa.int64()),
                        pa.array(np.concatenate([f[1] for f in found]), pa.int64()),
                    ],
                    names=["query_id", "vec_id", "score"],
                )

    # One pair of blocks to a task, or a few.
    wide = pairs.repartition(min(4096, max(8, shards * blocks)), "shard", "block")
    found = wide.mapInArrow(run, "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
