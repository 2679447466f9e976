"""SimHash near-duplicates by vantage-point trees (operator 5).

Fingerprints: 64 bits; a bit is set if it is set in more than half of the XXH64 hashes (seed 42) of
the text's word shingles. Two fingerprints are linked if they differ in at most ``radius`` bits.

A vantage-point tree cuts the distinct fingerprints into shards: a node has a vantage and a distance
``mu``; fingerprints within ``mu + radius`` go inside, those beyond ``mu`` go outside, those in the
overlap to both. By the triangle inequality two fingerprints within the radius are then together in
at least one child, hence in at least one leaf: if both are beyond ``mu`` both are outside, else the
one within ``mu`` draws the other inside. The tree is fitted on a bounded sample of distinct
fingerprints; its number of leaves follows from their count. Every task goes on in the same way below
its leaf and compares what is left in blocks. It returns a spanning forest of the links it found,
never all pairs, and the forests are joined by connected components.

Defined cases: a NULL or blank text has fingerprint 0 and is linked like any other. A text with fewer
words than a shingle is one shingle. Rows with a NULL id keep their fingerprint and component but
never name one. Repeated ids are repeated in the result.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.llm.common import map_blocks
from tracemill.llm.components import components
from tracemill.operators.joins import join_spread
from tracemill.session import durable

BITS = 64
# Fingerprints the top of the tree is fitted on, and those aimed at in a leaf of it.
SAMPLE = 1 << 17
LEAF = 20_000
MAX_DEPTH = 14
# Below so many fingerprints a task compares all of them.
BLOCK = 1024


# --- Fingerprints --------------------------------------------------------------------------


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest, join = xxhash.xxh64_digest, b" ".join
    if len(words) <= size:
        found = [digest(join(words), 42)]
    else:
        found = [digest(join(s), 42) for s in zip(*[islice(words, i, None) for i in range(size)])]
    return np.frombuffer(b"".join(found), ">u8").astype(np.uint64)


def fingerprint(text: str | None, size: int = 3) -> int:
    hashes = shingle_hashes(text, size)
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, keys: list[str], text: str = "text", size: int = 3) -> DataFrame:
    """``keys`` with ``fp``: the fingerprint of the whole text as a signed 64-bit number."""
    schema = T.StructType([T.StructField("fp", T.LongType())])
    return map_blocks(docs, keys, text, schema, lambda: lambda texts: {"fp": [fingerprint(t, size) for t in texts]})


# --- Vantage-point trees -------------------------------------------------------------------


def distance(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage)


def choose_node(points: np.ndarray, radius: int, rng: np.random.Generator) -> tuple[np.uint64, int] | None:
    """Vantage and ``mu`` with the fewest fingerprints in the larger child and in both together."""
    sample = points if len(points) <= 2048 else rng.choice(points, 2048, replace=False)
    best = None
    for vantage in rng.choice(points, min(6, len(points)), replace=False):
        upto = np.cumsum(np.bincount(distance(sample, vantage), minlength=BITS + 1 + radius))
        inside, outside = upto[np.minimum(np.arange(BITS) + radius, BITS)], len(sample) - upto[:BITS]
        larger = np.maximum(inside, outside)
        cost = larger + 0.5 * (inside + outside)
        mu = int(cost.argmin())
        if best is None or cost[mu] < best[0]:
            best = (cost[mu], vantage, mu, larger[mu])
    return None if best is None or best[3] >= 0.97 * len(sample) else (best[1], best[2])


def build_tree(points: np.ndarray, depth: int, radius: int, seed: int = 3) -> list[tuple[int, int]]:
    """The top of the tree as a heap: ``(vantage, mu)`` for each of ``2^depth - 1`` nodes.

    A node with ``mu = -1`` is not split; everything below it is its left-most leaf.
    """
    rng = np.random.default_rng(seed)
    nodes: list[tuple[int, int]] = [(0, -1)] * (2**depth - 1)
    parts = {0: points}
    for i in range(len(nodes)):
        here = parts.pop(i, None)
        if here is None or len(here) < 4:
            continue
        chosen = choose_node(here, radius, rng)
        if chosen is None:
            continue
        nodes[i] = (int(chosen[0]), chosen[1])
        far = distance(here, chosen[0]).astype(np.int64)
        parts[2 * i + 1], parts[2 * i + 2] = here[far <= chosen[1] + radius], here[far > chosen[1]]
    return nodes


def route(points: np.ndarray, nodes: list[tuple[int, int]], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Leaves of the top tree that each fingerprint belongs to: (positions of points, leaves)."""
    todo, found = [(0, np.arange(len(points)))], []
    while todo:
        i, at = todo.pop()
        if not len(at):
            continue
        if i >= len(nodes) or nodes[i][1] < 0:
            found.append((at, np.full(len(at), i)))
            continue
        far = distance(points[at], np.uint64(nodes[i][0])).astype(np.int64)
        todo += [(2 * i + 1, at[far <= nodes[i][1] + radius]), (2 * i + 2, at[far > nodes[i][1]])]
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _find(parent: np.ndarray, i: np.ndarray) -> np.ndarray:
    while True:
        up = parent[i]
        if np.array_equal(up, i):
            return i
        i = up


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the trees of ``a[i]`` and ``b[i]`` for all i; roots are smallest positions."""
    while len(a):
        a, b = _find(parent, a), _find(parent, b)
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def link_forest(points: np.ndarray, radius: int, seed: int = 3) -> np.ndarray:
    """For distinct points: position of the root of each one's component within the radius."""
    parent, rng = np.arange(len(points)), np.random.default_rng(seed)
    todo = [np.arange(len(points))]
    while todo:
        at = todo.pop()
        chosen = choose_node(points[at], radius, rng) if len(at) > BLOCK else None
        if chosen is None:
            here = points[at]
            for i in range(0, len(here), 256):
                x, y = np.nonzero(np.bitwise_count(here[i : i + 256, None] ^ here[None, i:]) <= radius)
                x, y = x[x < y] + i, y[x < y] + i
                _unite(parent, at[x], at[y])
            continue
        far = distance(points[at], chosen[0]).astype(np.int64)
        todo += [at[far <= chosen[1] + radius], at[far > chosen[1]]]
    return _find(parent, np.arange(len(points)))


# --- Links and components ------------------------------------------------------------------


def fingerprint_links(classes: DataFrame, n: int, radius: int = 2, sample: int = SAMPLE, leaf: int = LEAF) -> DataFrame:
    """Spanning forests ``(a, b)`` of the links between distinct fingerprints ``fp``; ``n`` of them."""
    depth = min(MAX_DEPTH, max(0, int(np.ceil(np.log2(max(1.0, n / leaf))))))
    nodes: list[tuple[int, int]] = []
    if depth:
        share = min(1.0, sample / n)
        low = F.pmod(F.xxhash64("fp", F.lit(11)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))
        got = classes.where(low).select("fp").limit(2 * sample).toArrow()["fp"].to_numpy()
        nodes = build_tree(np.sort(got).view(np.uint64), depth, radius)

    def deal(batches):
        for b in batches:
            points = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            at, leaves = route(points, nodes, radius)
            yield pa.RecordBatch.from_arrays([pa.array(leaves, pa.int64()), pa.array(points[at].view(np.int64))], names=["leaf", "fp"])

    def link(rows):
        points = np.sort(rows["fp"].to_numpy()).view(np.uint64)
        roots = link_forest(points, radius)
        moved = np.flatnonzero(roots != np.arange(len(points)))
        signed = points.view(np.int64)
        return pa.table({"a": signed[roots[moved]], "b": signed[moved]})

    dealt = classes.select("fp").mapInArrow(deal, "leaf long, fp long")
    return dealt.groupBy("leaf").applyInArrow(link, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, radius: int = 2) -> DataFrame:
    """``key, fp, component_id`` of every row; the component is named by its smallest key."""
    prints = durable(fingerprints(docs.select(key, text), [key], text, size))
    classes = durable(prints.groupBy("fp").agg(F.min(key).alias("__least"), F.count(F.lit(1)).alias("__n")))
    totals = classes.agg(F.count(F.lit(1)), F.sum("__n")).head()
    linked = components(fingerprint_links(classes, totals[0], radius)).select(F.col("node").alias("fp"), "root")
    members = durable(linked.join(classes, "fp"))
    least = members.groupBy("root").agg(F.min("__least").alias("component_id"), F.count(F.lit(1)).alias("__members"))
    # At most 10,000 fingerprints can each hold a ten-thousandth of all rows: those are spread.
    heavy = max(1000, (totals[1] or 0) // 10_000)
    named = join_spread(members.select("fp", "root"), least, ["root"], "__members", ["fp"], heavy_rows=heavy)
    known = durable(
        classes.join(named.select("fp", "component_id"), "fp", "left")
        .select("fp", "__n", F.coalesce("component_id", "__least").alias("component_id"))
    )
    return join_spread(prints, known, ["fp"], "__n", [key], heavy_rows=heavy).select(key, "fp", "component_id")
