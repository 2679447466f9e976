"""Top-k search, embedding links, SimHash groups and components against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.llm import simhash, topk, vectors
from tracemill.llm.components import components


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def roots(n, pairs):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


# --- Top-k -----------------------------------------------------------------------------------


def brute_top(rows, k):
    ok = [(i, np.floor(1024 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, v in ok:
        if i % 100 == 0:
            width = max(len(w) for _, w in ok)
            pad = lambda x: np.pad(x, (0, width - len(x)))
            found = sorted((-int(pad(v) @ pad(w)), j) for j, w in ok if j != i)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("shard", [7, 50, 1000])
def test_top_k_equals_brute_force(spark, shard):
    rng = np.random.default_rng(shard)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=6).round(1))]) for i in range(0, 420, 2)]
    rows += [(401, [0.5] * 6), (403, [0.5] * 6), (405, None), (407, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (409, [float("nan")] * 6), (411, [1.0, 2.0]), (None, [1.0] * 6)]
    df = frame(spark, rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("rank", F.lit("x"))
    found = topk.top_k(topk.quantise(df), F.col("id") % 100 == 0, 10, shard_rows=shard, query_rows=2)
    assert sorted(map(tuple, found.collect())) == brute_top(rows, 10)


def test_top_k_of_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    few = topk.top_k(topk.quantise(frame(spark, [(0, [1.0]), (1, [1.0])], schema)), F.col("id") % 100 == 0, 10)
    assert [tuple(r) for r in few.collect()] == [(0, 1, 1, 1024 * 1024)]
    assert topk.top_k(topk.quantise(frame(spark, [], schema)), F.col("id") % 100 == 0).count() == 0


# --- Embeddings ------------------------------------------------------------------------------


def test_embedding_links_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(20, 16))
    rows, i = [], 0
    for c, b in enumerate(base):
        for _ in range(1 + 6 * (c % 3 == 0)):
            rows.append((i, [float(x) for x in np.float32(b + rng.normal(0, 0.05, 16))], c % 2))
            i += 1
    rows += [(i, rows[0][1], 0), (i + 1, rows[0][1], 0), (i + 2, rows[0][1], 1), (i + 3, rows[0][1], None)]
    rows += [(i + 4, None, 0), (i + 5, [0.0] * 16, 0), (i + 6, [float("inf")] * 16, 0), (i + 7, [2 * x for x in rows[0][1]], 0), (i + 8, [1.0], 0)]
    df = frame(spark, rows, "vec_id long, embedding array<float>, label int").withColumn("n_links", F.lit(7)).withColumn("v", F.lit(7))
    got = {r[0]: tuple(r)[1:] for r in vectors.near_duplicates(df, block=4).collect()}
    v = {k: np.array(x, float) for k, x, label in rows if x is not None and label is not None and np.isfinite(x).all() and np.any(x)}
    label = {k: x for k, _, x in rows}
    links = [(a, b) for a in v for b in v if a < b and label[a] == label[b] and len(v[a]) == len(v[b]) and v[a] @ v[b] / np.linalg.norm(v[a]) / np.linalg.norm(v[b]) >= 0.98]
    root = roots(len(rows), links)
    for k, _, _ in rows:
        n = sum(k in p for p in links)
        assert got[k] == (n, root[k], root[k] == k), (k, got[k], n)
    assert len(links) > 100
    assert vectors.near_duplicates(frame(spark, [], "vec_id long, embedding array<float>, label int")).count() == 0


def test_repeated_ids_are_rows_of_their_own(spark):
    rng = np.random.default_rng(6)
    a, b, other = (rng.normal(size=8) for _ in range(3))
    near = lambda v: v + 1e-3 * rng.normal(size=8)
    for label_of_b in (0, 1):
        rows = [(1, a, 0), (1, b, label_of_b), (2, near(a), 0), (3, near(b), label_of_b), (None, a, 0), (4, other, 1), (4, other, 1)]
        df = frame(spark, [(i, [float(x) for x in v], label) for i, v, label in rows], "vec_id long, embedding array<double>, label int")
        got = sorted(map(tuple, vectors.near_duplicates(df.withColumn("class", F.lit(1)).withColumn("least", F.lit(1))).collect()), key=str)
        want = [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 1, 4, True), (4, 1, 4, True), (None, 0, None, None)]
        assert got == sorted(want, key=str)


def test_embedding_recall_at_the_threshold():
    """Pairs of a cosine of just 0.98 share a bucket of some table in at least 0.9 of the cases."""
    rng = np.random.default_rng(8)
    a = vectors.unit(rng.normal(size=(3000, 64)))
    side = rng.normal(size=a.shape)
    side -= (side * a).sum(1, keepdims=True) * a
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * vectors.unit(side)
    h = [vectors.buckets(x, vectors.TABLES, vectors.BITS, vectors.WIDTH, 29) for x in (a, b)]
    assert (h[0] == h[1]).any(axis=1).mean() > 0.95
    far = vectors.buckets(vectors.unit(rng.normal(size=a.shape)), vectors.TABLES, vectors.BITS, vectors.WIDTH, 29)
    assert (h[0] == far).any(axis=1).mean() < 0.01


# --- SimHash ---------------------------------------------------------------------------------


def test_fingerprint_by_definition():
    import xxhash

    text = "The  cat\tsat ON the mat. É é"
    words = ["the", "cat", "sat", "on", "the", "mat.", "É", "é"]
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.fingerprint(text) & (2**64 - 1) == want
    assert simhash.fingerprint("a B") & (2**64 - 1) == xxhash.xxh64_intdigest("a b", 42)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n\t") == 0


def test_tree_finds_all_links():
    rng = np.random.default_rng(5)
    points = rng.integers(0, 2**63, 3000).astype(np.uint64)
    near = points[:800] ^ (np.uint64(1) << rng.integers(0, 64, 800).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 800).astype(np.uint64))
    points = np.unique(np.concatenate([points, near]))
    want = np.arange(len(points))
    x, y = np.nonzero(np.bitwise_count(points[:, None] ^ points[None]) <= 2)
    simhash._unite(want, x, y)
    want = simhash._find(want, np.arange(len(points)))
    assert (simhash.link_forest(points, 2) == want).all()
    nodes = simhash.build_tree(points[::3], 4, 2)
    at, leaves = simhash.route(points, nodes, 2)
    together = np.arange(len(points))
    for leaf in np.unique(leaves):
        here = np.sort(at[leaves == leaf])
        root = simhash.link_forest(points[here], 2)
        simhash._unite(together, here, here[root])
    assert (simhash._find(together, np.arange(len(points))) == want).all()
    assert len(np.unique(leaves)) == 16 and len(at) < 3 * len(points)


def test_near_duplicates_by_brute_force(spark):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(500)]
    texts = [" ".join(rng.choice(words, 300)) for _ in range(30)]
    texts += [t + " more" for t in texts[:10]] + texts[:5] * 3 + [None, "", "  ", "x", "X"]
    rows = [(i, t) for i, t in enumerate(texts)]
    df = frame(spark, rows, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    got = {r[0]: (r[1] & (2**64 - 1), r[2]) for r in simhash.near_duplicates(df).collect()}
    prints = [simhash.fingerprint(t) & (2**64 - 1) for t in texts]
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2]
    root = roots(len(texts), pairs)
    assert got == {i: (prints[i], root[i]) for i in range(len(texts))}
    assert simhash.near_duplicates(frame(spark, [], "doc_id long, text string")).count() == 0
    odd = simhash.near_duplicates(frame(spark, [(None, "a"), (None, "a"), (3, "a"), (3, "a")], "doc_id long, text string"))
    assert sorted((r[0] or -1, r[2]) for r in odd.collect()) == [(-1, 3), (-1, 3), (3, 3), (3, 3)]


def test_components_of_chains_stars_and_loops(spark):
    rng = np.random.default_rng(3)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(200, 260)] + [(7, 7), (1, 2), (2, 1), (1, 2)]
    perm = rng.permutation(300)
    pairs = [(int(perm[a]), int(perm[b])) for a, b in pairs] + [(None, 4)]
    want = roots(300, [p for p in pairs if None not in p])
    got = dict(map(tuple, components(frame(spark, pairs, T.StructType.fromDDL("a long, b long"))).collect()))
    nodes = {x for p in pairs if None not in p for x in p}
    assert got == {n: want[n] for n in nodes}
