"""What must not grow with the traces: broadcast tables, batches, tasks."""

import os
import random

from pyspark.sql import functions as F

from tracemill.operators import joins, longrepeats, repeats, rules, similarity, trie
from tracemill.session import shared_folder
from tracemill.sources.traces import read_traces
from tracemill.workload import learning

SPARSE = "grp long, trace_id long, pattern_ids array<bigint>, scores array<int>"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def pattern_rows(spark, patterns):
    return spark.createDataFrame([(i + 1, list(p)) for i, p in enumerate(patterns)], "pattern_id long, gram array<int>")


def test_score_rows_are_not_broadcast(spark, tokens):
    """A few thousand score rows are gigabytes: they never go through the driver."""
    df = tokens({(0, t): [1, 2, 3, t] for t in range(5)})
    traces = spark.createDataFrame([(t, "a") for t in range(6)], "trace_id long, label string")
    patterns = pattern_rows(spark, [[1, 2, 3], [2, 9]])
    sparse = learning.sparse_rows(traces, df, patterns)
    assert "BroadcastHashJoin" not in plan(sparse)
    assert {(r.trace_id, tuple(r.pattern_ids), tuple(r.scores)) for r in sparse.collect()} == {(t, (1, 2), (3, 1)) for t in range(5)} | {(5, (), ())}
    dense = similarity.feature_rows(traces, similarity.score_rows(patterns, df), 2)
    assert "BroadcastHashJoin" not in plan(dense)
    assert {r.trace_id: r.scores for r in dense.collect()} == {t: [3, 1] for t in range(5)} | {5: [0, 0]}


def test_thresholds_are_broadcast_not_scores(spark):
    scores = spark.createDataFrame([(t, p, t % 4) for t in range(8) for p in (1, 2)], "trace_id long, pattern_id long, score int")
    thresholds = spark.createDataFrame([(1, 1.5, 2, [5, 6]), (2, 2.5, 3, [7, 8, 9]), (None, 0.5, 1, [1])], "pattern_id long, value double, k int, prefix array<int>")
    found = rules.above(scores, thresholds)
    assert "BuildLeft" not in plan(found) and "prefix" not in plan(found).split("BroadcastExchange")[1].split("\n")[0]
    got = {(r.trace_id, r.pattern_id, r.score, r.k, tuple(r.prefix)) for r in found.select("trace_id", "pattern_id", "score", "k", "prefix").collect()}
    assert got == {(t, 1, t % 4, 2, (5, 6)) for t in range(8) if t % 4 > 1.5} | {(t, 2, 3, 3, (7, 8, 9)) for t in (3, 7)}


def test_batches_of_scores_are_bounded(spark, tokens, monkeypatch):
    monkeypatch.setattr(trie, "BATCH_SCORES", 40)
    tries = trie.share_tries(pattern_rows(spark, [[1, k] for k in range(20)]))
    found = trie.trace_scores(tries, trie.trie_blocks(tries, tokens({(0, t): [1, t] for t in range(30)})))

    def sizes(batches):
        for b in batches:
            yield b.select(["grp"]).slice(0, 0)

    assert found.select(F.sum(F.size("scores"))).first()[0] == 30 * 20
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) < 1 << 28
    assert found.mapInArrow(sizes, "grp long").count() == 0


def test_maxima_need_no_row_per_trace_and_pattern(spark):
    r = random.Random(3)
    data = []
    for t in range(300):
        ids = sorted(r.sample(range(1, 50), r.randint(0, 9)))
        data.append((0, t, ids, [r.randint(1, 9) for _ in ids]))
    want = {}
    for _, _, ids, scores in data:
        for p, s in zip(ids, scores):
            want[p] = max(want.get(p, 0), s)
    found = similarity.feature_maxima(spark.createDataFrame(data, SPARSE))
    assert "Generate" not in plan(found)
    assert {x.pattern_id: x.max_score for x in found.collect()} == want


def test_matches_are_dealt_by_pairs(spark, tokens, monkeypatch):
    monkeypatch.setattr(similarity, "TASK_PAIRS", 4)
    df = tokens({(0, t): [1, 2, 1] for t in range(20)})
    found = similarity.match_lengths(pattern_rows(spark, [[1, 2], [2]]), df)
    assert "30), REPARTITION_BY_NUM" in plan(found)
    assert found.count() == 20 * 3


def test_only_grams_that_repeat_are_made(spark, tokens):
    """Seven equal symbols at the ends of two long traces: no gram of the rest is longer than its match."""
    traces = {(0, 0): [1, 2, 3, 4, 5, 6, 7, *range(100, 140)], (0, 1): [*range(200, 240), 1, 2, 3, 4, 5, 6, 7]}
    df = tokens(traces)
    found = repeats.repeat_grams(df, 1)
    assert "rangepartitioning" in plan(found)
    assert found.count() == 2 * 28
    got = {(tuple(r.gram), r.neighbour, r.n) for r in repeats.context_histogram(df).collect()}
    want = set()
    for a in range(1, 8):
        for b in range(a, 8):
            gram = tuple(range(a, b + 1))
            want |= {(gram, a - 1, 2)} if a > 1 else {(gram, None, 1), (gram, 239, 1)}
    assert got == want
    assert [tuple(r.gram) for r in repeats.maximal_repeats(repeats.repeat_profile(df)).collect()] == [(1, 2, 3, 4, 5, 6, 7)]


def test_trace_files_are_opened_once(spark, tmp_path):
    (tmp_path / "a_1.json").write_text('{"FunctionName": "f"}\n\n{"FunctionName": "g"}\n')
    found = read_traces(spark, f"{tmp_path}/*.json")
    assert "FileScan text" not in plan(found) and "Scan text" not in plan(found)
    assert [(r.trace_id, r.pos, r.sym) for r in found.orderBy("pos").collect()] == [("a_1.json", 0, "f"), ("a_1.json", 1, "g")]


def test_plans_do_not_grow_with_the_longest_repeat(spark, tokens):
    """The driver's work on a plan is the same however many doublings there are."""
    r = random.Random(5)
    seq = [r.randint(1, 4) for _ in range(70)]
    found = longrepeats.doubling_repeats(tokens({(0, 0): seq, (0, 1): seq}))
    assert plan(found).count("FileScan parquet") <= 4
    assert [(x.len, x.n_occ, x.n_traces) for x in found.where("n_witness = n_occ AND len > 30").collect()] == [(70, 2, 2)]


def test_stored_sides_without_heavy_keys_are_joined_plainly(spark):
    left = spark.createDataFrame([(k % 5 or None, i) for i, k in enumerate(range(40))], "k long, i long")
    right = spark.createDataFrame([(k, 8, k * 10) for k in range(1, 4)], "k long, n long, v long")
    for how in ("inner", "left"):
        light = joins.join_spread(left, right, ["k"], "n", ["i"], how=how, stored=True)
        want = sorted(joins.join_spread(left, right, ["k"], "n", ["i"], how=how, heavy_rows=3).collect(), key=lambda x: x.i)
        assert sorted(light.collect(), key=lambda x: x.i) == want
        assert len(want) == (24 if how == "inner" else 40)
        assert "__parts" not in plan(light)


def test_matches_of_places_alike_lie_together(spark, tokens, monkeypatch):
    """A row for every place and pattern that begin alike: pattern after pattern, so that columns store runs."""
    r = random.Random(2)
    df = tokens({(0, t): [r.randint(1, 4) for _ in range(400)] for t in range(4)})
    patterns = pattern_rows(spark, [[r.randint(1, 4) for _ in range(5)] for _ in range(200)])
    rows = [tuple(x) for x in similarity.match_lengths(patterns, df).select("pattern_id", "trace_id", "pos", "match_len").collect()]
    changes = sum(a[0] != b[0] for a, b in zip(rows, rows[1:]))
    assert len(rows) > 50_000 and changes < len(rows) / 5
    monkeypatch.setattr(trie, "MATCH_ROWS", 50)
    again = similarity.match_lengths(patterns, df).select("pattern_id", "trace_id", "pos", "match_len").where("trace_id = 1").collect()
    assert sorted(map(tuple, again)) == sorted(x for x in rows if x[1] == 1)


def test_finished_tables_of_the_doubling_are_removed(spark, tokens):
    folder = shared_folder(spark).removeprefix("file:")
    r = random.Random(6)
    seq = [r.randint(1, 3) for _ in range(40)]
    df = tokens({(0, 0): seq, (0, 1): seq, (1, 2): seq[:9]})
    before = set(os.listdir(folder))
    found = longrepeats.doubling_repeats(df)
    assert len(set(os.listdir(folder)) - before) <= 2
    assert [(x.len, x.n_occ) for x in found.where("n_witness = n_occ AND n_traces = 2").collect()] == [(40, 2)]


def test_windows_of_wide_symbols_are_shorter(spark, tokens):
    """A window of four-byte symbols holds as many bytes as one of single bytes; the repeats are the same."""
    r = random.Random(7)
    passage = [r.randint(1, 90_000) for _ in range(40)]
    traces = {(0, t): [r.randint(1, 90_000) for _ in range(5)] + passage[t : 40 - 3 * t] + [r.randint(1, 20) for _ in range(30)] for t in range(5)}
    df = longrepeats.durable(tokens(traces))
    coding = longrepeats.window_matches(df).coding
    assert (coding.size, coding.width) == (4, 16)
    columns = ["grp", "len", "trace_id", "pos", "n_occ", "n_traces", "n_witness", "percent"]
    found = [sorted(map(tuple, f(df).select(columns).collect())) for f in (longrepeats.long_repeats, longrepeats.doubling_repeats)]
    assert found[0] == found[1] and {x[1] for x in found[0]} & set(range(16, 41)) and {x[1] for x in found[0]} & set(range(1, 16))
