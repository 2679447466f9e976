"""Trees from counts, against a plain learner."""

import random

import pytest
from pyspark.sql import functions as F

from tracemill.operators import rules, trees

SPARSE = "trace_id long, label string, pattern_ids array<bigint>, scores array<int>"


def sparse(spark, data):
    """``data``: (trace, label, {pattern: score})."""
    return spark.createDataFrame([(t, c, sorted(s), [s[p] for p in sorted(s)]) for t, c, s in data], SPARSE)


def random_data(seed, n=120):
    r = random.Random(seed)
    data = []
    for t in range(n):
        s = {p * 7: r.randint(1, 6) for p in range(5) if r.random() < 0.8}
        label = "amber" if s.get(0, 0) > 3 else "upx" if s.get(14, 0) > 2 and s.get(7, 0) < 4 else "mew"
        data.append((t, label if r.random() < 0.9 else r.choice(["mew", "upx", None]), s))
    return data


def plain_tree(data, depth, node=1, level=0):
    """{node: (depth, pattern, k, cls, n)} by the definition."""
    count = lambda rows: {c: sum(x[1] == c for x in rows) for c in {x[1] for x in rows}}
    squares = lambda rows: sum(v * v for v in count(rows).values())
    cls = min(count(data).items(), key=lambda cv: (-cv[1], cv[0]))[0]
    best = None
    if level < depth:
        for p in sorted({p for x in data for p in x[2]}):
            for k in range(1, max(x[2].get(p, 0) for x in data) + 1):
                left, right = [x for x in data if x[2].get(p, 0) < k], [x for x in data if x[2].get(p, 0) >= k]
                if not left or not right:
                    continue
                top = squares(right) * len(left) + squares(left) * len(right)
                if top * len(data) <= squares(data) * len(left) * len(right):
                    continue
                key = (-(top * 1000 // (len(left) * len(right))), p, k)
                best = min(best, (key, left, right), key=lambda b: b[0]) if best else (key, left, right)
    if best is None:
        return {node: (level, None, None, cls, len(data))}
    (_, p, k), left, right = best
    out = {node: (level, p, k, cls, len(data))}
    return out | plain_tree(left, depth, 2 * node, level + 1) | plain_tree(right, depth, 2 * node + 1, level + 1)


def said(tree, scores, depth):
    node, cls = 1, None
    while node in tree:
        level, p, k, cls, _ = tree[node]
        if p is None or level == depth:
            break
        node = 2 * node + (scores.get(p, 0) >= k)
    return cls


@pytest.mark.parametrize("seed,cells", [(1, 1 << 28), (2, 0), (3, 150)])
def test_tree_equals_plain_learner(spark, seed, cells):
    """In one task, by counts level by level, and first one and then the other."""
    data = random_data(seed)
    nodes = trees.fit_trees(sparse(spark, data), 4, local_cells=cells)
    want = plain_tree([x for x in data if x[1]], 4)
    assert {r.node: (r.depth, r.pattern_id, r.k, r.cls, r.n) for r in nodes.collect()} == want
    rows = sparse(spark, data)
    got = {(r.trace_id, r.depth): r.predicted for r in trees.predict_trees(rows, nodes, [0, 2, 4]).collect()}
    assert got == {(t, d): said(want, s, d) for t, _, s in data for d in (0, 2, 4)}
    for depth in (2, None):
        conditions = trees.tree_conditions(nodes, depth)
        ruled = {r.trace_id: r.verdict for r in rules.tree_verdict(rows, conditions).collect()}
        assert ruled == {t: said(want, s, 4 if depth is None else depth) for t, _, s in data}
        assert [r.n for r in rules.holding_rules(rows, conditions).select(F.size("holds").alias("n")).distinct().collect()] == [1]


def test_folds_and_grid(spark):
    data = random_data(5)
    rows = sparse(spark, data).withColumn("fold", (F.col("trace_id") % 3).cast("int"))
    report, nodes = trees.grid_report(rows, "fold", 3, [1, 3])
    labelled = [x for x in data if x[1]]
    want = {}
    for depth in (1, 3):
        scores = []
        for fold in range(3):
            tree = plain_tree([x for x in labelled if x[0] % 3 != fold], 3)
            pairs = [(c, said(tree, s, depth)) for t, c, s in labelled if t % 3 == fold]
            f1 = 0
            for c in {a for a, _ in pairs}:
                support, told, hits = sum(a == c for a, _ in pairs), sum(b == c for _, b in pairs), sum(a == b == c for a, b in pairs)
                f1 += support * 2 * hits / (support + told)
            scores.append(f1 / len(pairs))
        want[depth] = sum(scores) / 3
    got = {r.max_depth: (r.f1, r.chosen) for r in report.collect()}
    assert {d: f for d, (f, _) in got.items()} == pytest.approx(want)
    assert [d for d, (_, c) in got.items() if c] == [max(want, key=lambda d: (round(want[d], 9), -d))]
    assert {r.node: (r.depth, r.pattern_id, r.k, r.cls, r.n) for r in nodes.collect()} == plain_tree(labelled, 3)


def test_trees_of_little(spark):
    none = sparse(spark, [(1, None, {})])
    assert trees.fit_trees(none, 3).count() == 0
    assert [r.predicted for r in trees.predict_trees(none, trees.fit_trees(none, 3), [1]).collect()] == [None]
    alike = sparse(spark, [(1, "b", {}), (2, "a", {}), (3, "b", {5: 1}), (4, "a", {5: 1})])
    assert [tuple(r) for r in trees.fit_trees(alike, 3).collect()] == [(0, 1, 0, None, None, "a", 4)]
    rows = trees.tree_conditions(trees.fit_trees(alike, 3)).collect()
    assert [tuple(r) for r in rows] == [("a", 1, None, None, None)]
