"""Scores by the nodes that patterns own: the same scores and trees, without a row or entry per pattern."""

import functools
import random

import pytest
from pyspark.sql import functions as F

import brute
from tracemill.operators import similarity, trees, trie
from tracemill.workload import learning


def pattern_rows(spark, patterns):
    return spark.createDataFrame([(i + 1, list(p)) for i, p in enumerate(patterns)], "pattern_id long, gram array<int>")


def random_case(seed):
    r = random.Random(seed)
    traces = {(0, t): [r.randint(1, 3) for _ in range(r.randint(1, 30))] for t in range(40)}
    patterns = [[r.randint(1, 3) for _ in range(r.randint(1, 8))] for _ in range(25)]
    return traces, patterns + [patterns[3], patterns[3] + [1], [9, 9], [2]]


@pytest.mark.parametrize("seed,part", [(1, 10**6), (2, 50)])
def test_paths_tell_all_scores(spark, tokens, monkeypatch, seed, part):
    monkeypatch.setattr(trie, "share_tries", functools.partial(trie.share_tries, part_symbols=part))
    monkeypatch.setattr(trie, "BATCH_SCORES", 100)
    traces, patterns = random_case(seed)
    df, rows = tokens(traces), pattern_rows(spark, patterns)
    want = {(t, i + 1): brute.score(p, s) for (_, t), s in traces.items() for i, p in enumerate(patterns) if brute.score(p, s)}
    paths = similarity.score_paths(rows, df)
    long = [((x.trace_id, x.pattern_id), x.score) for x in similarity.long_scores(paths).collect()]
    assert len(long) == len(want) and dict(long) == want
    sparse = {(x.trace_id, p): s for x in similarity.score_rows(rows, df).collect() for p, s in zip(x.pattern_ids, x.scores)}
    assert sparse == want
    names = spark.createDataFrame([(t, "a") for t in range(41)], "trace_id long, label string")
    dense = {x.trace_id: x.scores for x in similarity.feature_rows(names, paths, len(patterns)).collect()}
    assert dense == {t: [want.get((t, i + 1), 0) for i in range(len(patterns))] for t in range(41)}
    top = {}
    for (_, p), s in want.items():
        top[p] = max(s, top.get(p, 0))
    assert {x.pattern_id: x.max_score for x in similarity.feature_maxima(paths).collect()} == top
    bounds = [(i + 1, len(p) - 2.5) for i, p in enumerate(patterns) if i % 4] + [(2, 1.0), (None, 0.0), (5, None), (6, float("nan"))]
    limits = spark.createDataFrame(bounds, "pattern_id long, value double")
    least = {}
    for p, v in bounds:
        if p is not None and v is not None and v == v:
            least[p] = min(v, least.get(p, v))
    above = {(x.trace_id, x.pattern_id): x.score for x in similarity.prefix_similarity(rows, df, thresholds=limits).collect()}
    assert above == {k: s for k, s in want.items() if k[1] in least and s > least[k[1]]}


def test_score_rows_of_trees_do_not_grow_with_the_patterns(spark, tokens):
    """Fifty patterns that begin alike: a trace that has their beginning lists one of them, not fifty."""
    df = tokens({(0, t): [1, 2, 3, 4, t] for t in range(10, 16)})
    patterns = pattern_rows(spark, [[1, 2, 3, 4, k] for k in range(10, 60)])
    traces = spark.createDataFrame([(t, "a") for t in range(10, 17)], "trace_id long, label string")
    found = {x.trace_id: dict(zip(x.pattern_ids, x.scores)) for x in learning.sparse_rows(traces, df, patterns).collect()}
    assert found == {10: {1: 5}, 16: {}} | {t: {1: 4, t - 9: 5} for t in range(11, 16)}


@pytest.mark.parametrize("seed,cells,part", [(1, 1 << 21, 10**6), (2, 0, 10**6), (3, 60, 50)])
def test_trees_are_those_of_all_scores(spark, tokens, monkeypatch, seed, cells, part):
    """In one task and by counts, from one trie and from several."""
    monkeypatch.setattr(trie, "share_tries", functools.partial(trie.share_tries, part_symbols=part))
    traces, patterns = random_case(seed)
    r = random.Random(seed)
    df, rows = tokens(traces), pattern_rows(spark, patterns)
    labels = {t: "abc"[(brute.score(patterns[4], s) + brute.score(patterns[9], s) + (r.random() < 0.2)) % 3] for (_, t), s in traces.items()}
    names = spark.createDataFrame(list(labels.items()), "trace_id long, label string")
    full = names.join(similarity.score_rows(rows, df).drop("grp"), "trace_id")
    few = learning.sparse_rows(names, df, rows)
    nodes = trees.fit_trees(few, 4, local_cells=cells)
    assert sorted(map(str, nodes.collect())) == sorted(map(str, trees.fit_trees(full, 4).collect()))
    said = lambda rows: {(x.trace_id, x.depth): x.predicted for x in trees.predict_trees(rows, nodes, [1, 4]).collect()}
    assert said(few) == said(full)
    assert few.select(F.sum(F.size("scores"))).first()[0] < full.select(F.sum(F.size("scores"))).first()[0]
