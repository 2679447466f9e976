import functools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from tracemill.operators import rules, similarity, substrings, trie
from tracemill.operators.automata import prefix_automaton


def pattern_rows(spark, patterns):
    return spark.createDataFrame(
        [(i + 1, list(p)) for i, p in enumerate(patterns)], "pattern_id long, gram array<int>"
    )


def test_score_golden(spark, tokens):
    df = tokens({(0, 0): [1, 2, 1, 2, 3, 9], (0, 1): [9, 1, 2, 9], (0, 2): [7, 7]})
    scores = similarity.prefix_similarity(pattern_rows(spark, [[1, 2, 3]]), df)
    traces = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b"), (3, "b")], "trace_id long, label string")
    rows = {r.trace_id: r.scores for r in similarity.feature_rows(traces, scores, 1).collect()}
    assert rows == {0: [3], 1: [2], 2: [0], 3: [0]}


@pytest.mark.parametrize("seed,part", [(1, 10**6), (2, 20), (4, 1)])
def test_score_against_definition(spark, tokens, monkeypatch, seed, part):
    """Small parts deal the patterns to several tries."""
    monkeypatch.setattr(trie, "share_tries", functools.partial(trie.share_tries, part_symbols=part))
    r = random.Random(seed)
    traces = {(0, t): [r.randint(1, 3) for _ in range(r.randint(1, 30))] for t in range(12)}
    patterns = [[r.randint(1, 3) for _ in range(r.randint(1, 8))] for _ in range(15)]
    got = {
        (x.trace_id, x.pattern_id): x.score
        for x in similarity.prefix_similarity(pattern_rows(spark, patterns), tokens(traces)).collect()
    }
    want = {
        (t, i + 1): brute.score(p, s) for (_, t), s in traces.items() for i, p in enumerate(patterns) if brute.score(p, s)
    }
    assert got == want


@pytest.mark.parametrize("part", [10**6, 15])
def test_match_lengths_against_definition(spark, tokens, monkeypatch, part):
    monkeypatch.setattr(trie, "share_tries", functools.partial(trie.share_tries, part_symbols=part))
    r = random.Random(part)
    traces = {(0, t): [r.randint(1, 3) for _ in range(r.randint(1, 30))] for t in range(6)}
    patterns = [[r.randint(1, 3) for _ in range(r.randint(1, 6))] for _ in range(12)] + [[9, 9], [1], [1], [1, 2]]
    df, rows = tokens(traces), pattern_rows(spark, patterns)
    want = {}
    for (_, t), s in traces.items():
        for p in range(len(s)):
            for i, w in enumerate(patterns):
                k = next((k for k in range(len(w), 0, -1) if s[p : p + k] == w[:k]), 0)
                if k:
                    want[(t, p, i + 1)] = k
    got = [((x.trace_id, x.pos, x.pattern_id), x.match_len) for x in similarity.match_lengths(rows, df).collect()]
    assert len(got) == len(want) and dict(got) == want
    whole = {(x.trace_id, x.pos, x.pattern_id) for x in similarity.match_lengths(rows, df, whole=True).collect()}
    assert whole == {k for k, n in want.items() if n == len(patterns[k[2] - 1])}


@pytest.mark.parametrize("cells", [0, 1 << 20])
def test_trie_nodes_are_the_distinct_prefixes(spark, monkeypatch, cells):
    monkeypatch.setattr(trie, "DENSE_CELLS", cells)
    patterns = [[5, 6], [5, 6, 7], [5, 7], [8], [5, 6]]
    nodes = trie.trie_table(pattern_rows(spark, patterns)).collect()
    prefixes = {tuple(p[:k]) for p in patterns for k in range(1, len(p) + 1)}
    assert len(nodes) == len(prefixes) and sum(n.n_patterns for n in nodes) == len(patterns)
    (one,) = trie.build_tries(pattern_rows(spark, patterns))
    assert one.deepest(one.codes(np.array([5, 6, 1, 5, 7, 8])), np.array([0, 1, 3, 5])).tolist() == [
        next(n.node for n in nodes if n.depth == 2 and n.sym_id == 6), 0, next(n.node for n in nodes if n.depth == 2 and n.sym_id == 7),
        next(n.node for n in nodes if n.depth == 1 and n.sym_id == 8),
    ]


def test_no_patterns_no_traces(spark, tokens):
    none = pattern_rows(spark, [[1]]).limit(0)
    assert similarity.prefix_similarity(none, tokens({(0, 0): [1, 2]})).count() == 0
    assert similarity.prefix_similarity(pattern_rows(spark, [[1]]), tokens({(0, 0): [1]}).limit(0)).count() == 0


def test_patterns_longer_than_a_block(spark, tokens):
    r = random.Random(9)
    s = [r.randint(1, 5) for _ in range(4000)]
    long = s[900:3200]
    got = similarity.prefix_similarity(pattern_rows(spark, [long, long[:-1] + [7]]), tokens({(0, 0): s})).collect()
    assert {x.pattern_id: x.score for x in got} == {1: 2300, 2: 2299}


def test_lookup(spark, tokens):
    df = tokens({(0, 0): [1, 2, 3, 4, 5, 6], (0, 1): [3, 4, 9]})
    queries = pattern_rows(spark, [[3, 4, 5, 7], [9, 1], [8, 8], [2, 3, 4, 5, 6, 1]])
    got = {r.pattern_id: r.found_len for r in substrings.substring_lookup(queries, df).collect()}
    assert got == {1: 3, 2: 1, 3: 0, 4: 5}


def test_feature_rows_fill_gaps(spark):
    traces = spark.createDataFrame([(0, "a"), (1, "b")], "trace_id long, label string")
    scores = spark.createDataFrame([(0, 2, 5), (0, 5, 1)], "trace_id long, pattern_id long, score int")
    rows = {r.trace_id: r.scores for r in similarity.feature_rows(traces, scores, 6).collect()}
    assert rows == {0: [0, 5, 0, 0, 1, 0], 1: [0] * 6}
    maxima = {r.pattern_id: r.max_score for r in similarity.feature_maxima(scores).collect()}
    assert maxima == {2: 5, 5: 1}


def test_automaton_golden(spark):
    got = {(r.src, r.sym_id): r.dst for r in prefix_automaton(pattern_rows(spark, [[1, 2, 1]])).collect()}
    assert got == {(0, 1): 1, (0, 2): 0, (1, 1): 1, (1, 2): 2, (2, 1): 3, (2, 2): 0}


def test_automaton_finds_substrings(spark):
    r = random.Random(3)
    patterns = [[r.randint(1, 2) for _ in range(r.randint(1, 6))] for _ in range(20)]
    moves = {}
    for row in prefix_automaton(pattern_rows(spark, patterns)).collect():
        moves[(row.pattern_id, row.src, row.sym_id)] = row.dst
    for i, p in enumerate(patterns):
        for _ in range(20):
            s = [r.randint(1, 3) for _ in range(15)]
            state, hit = 0, False
            for x in s:
                state = moves.get((i + 1, state, x), 0)
                if state == len(p):
                    hit = True
                    break
            assert hit == any(s[j : j + len(p)] == p for j in range(len(s)))


def test_threshold_golden(spark):
    got = [r.k for r in spark.createDataFrame([(2.5,), (3.0,)], "v double").select(rules.prefix_length("v").alias("k")).collect()]
    assert got == [3, 4]


def test_rules(spark):
    rows = spark.createDataFrame([(0, [3, 0]), (1, [1, 2]), (2, [0, 0])], "trace_id long, scores array<int>")
    conditions = spark.createDataFrame(
        [("a", 1, 1, ">", 2.5), ("b", 2, 1, "<=", 2.5), ("b", 2, 2, ">", 1.0), ("c", 3, 9, ">", 0.0), ("d", 4, 2, "==", 2.0)],
        "cls string, rule_id long, pattern_id long, op string, value double",
    )
    got = {r.trace_id: r.verdict for r in rules.tree_verdict(rows, conditions).collect()}
    assert got == {0: "a", 1: "b", 2: "unpacked"}
    classes = {(r.trace_id, r.cls) for r in rules.class_verdicts(rows, conditions).collect()}
    assert classes == {(0, "a"), (1, "b"), (1, "d")}
    always = conditions.where("rule_id < 0").unionByName(
        spark.createDataFrame([("only", 0, None, None, None)], conditions.schema)
    )
    assert {r.verdict for r in rules.tree_verdict(rows, always).collect()} == {"only"}
    flags = {r.cls: (r.n_rules, r.flags) for r in rules.flags_by_class(conditions).collect()}
    assert flags["b"] == (1, [1, 2])
    detectors = rules.rule_detectors(conditions, pattern_rows(spark, [[1, 2, 1], [5, 5]]))
    got = {(r.cls, r.rule_id, r.pattern_id, r.k) for r in detectors.collect()}
    # A threshold beyond the pattern has no detector: it can never be passed.
    assert got == {("a", 1, 1, 3), ("b", 2, 1, 3), ("b", 2, 2, 2)}
    assert rules.with_prefixes(conditions.where("cls = 'b'"), pattern_rows(spark, [[1, 2, 1], [5, 5]])).count() == 2
    assert F is not None
