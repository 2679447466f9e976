import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.operators import evaluation, rules
from tracemill.operators.trie import build_tries
from tracemill.plans import learn, pipeline
from tracemill.streaming import detect


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(2)
    data = []
    for t in range(240):
        s = [r.randint(0, 6) for _ in range(4)]
        label = "amber" if s[0] > 3 else "upx" if s[2] > 2 and s[1] < 4 else "mew"
        data.append((t, label if r.random() < 0.95 else "mew", s))
    return spark.createDataFrame(data, "trace_id long, label string, scores array<int>")


def test_rules_say_what_the_tree_says(spark, rows):
    model = learn.fit_tree(rows, 4)
    said = {r.filename: r.predicted_label for r in learn.predict(model, rows).collect()}
    found = learn.tree_rules(learn.tree_nodes(model, spark), 4)
    conditions = learn.rule_conditions(found)
    ruled = {r.filename: r.y_pred for r in pipeline.detect(rows, conditions).collect()}
    assert said == ruled and len(set(said.values())) == 3
    holds = rules.holding_rules(rows, conditions).select(F.size("holds").alias("n")).distinct().collect()
    assert [r.n for r in holds] == [1]


def test_flags_operators_and_rules_without_conditions(spark, rows):
    schema = "cls string, rule_id long, pattern_id long, op string, value double"
    always = spark.createDataFrame([("upx", 1, None, None, None), ("mew", 2, 3, ">", 1.0), ("mew", 2, 1, ">", 2.0)], schema)
    flags = {r.cls: (r.n_rules, r.n_flags, r.flags) for r in rules.flags_by_class(always).collect()}
    assert flags == {"upx": (1, 0, []), "mew": (1, 2, [1, 3])}
    assert {r.y_pred for r in pipeline.detect(rows, always.where("cls = 'upx'")).collect()} == {"upx"}
    with pytest.raises(ValueError):
        pipeline.detect(rows, spark.createDataFrame([("a", 1, 1, "<>", 1.0)], schema))


def test_single_leaf(spark, rows):
    one = rows.where("label = 'upx'")
    model = learn.fit_tree(one, 2)
    conditions = learn.rule_conditions(learn.tree_rules(learn.tree_nodes(model, spark), 2))
    assert {r.y_pred for r in pipeline.detect(one, conditions).collect()} == {"upx"}


def test_no_patterns(spark, rows):
    bare = rows.withColumn("scores", F.array().cast("array<int>"))
    model = learn.fit_tree(bare, 2)
    conditions = learn.rule_conditions(learn.tree_rules(learn.tree_nodes(model, spark), 2))
    said = {r.filename: r.predicted_label for r in learn.predict(model, bare).collect()}
    assert said == {r.filename: r.y_pred for r in pipeline.detect(bare, conditions).collect()}


def test_grid_search(spark, rows):
    search = learn.grid_search(rows, depths=(1, 3))
    report = {r.max_depth: (r.f1, r.chosen) for r in learn.grid_report(search, spark, (1, 3)).collect()}
    assert report[3][1] and report[3][0] > 0.8 > report[1][0]
    _ = search.bestModel.transform(learn.with_vector(rows)).count()


def test_metrics(spark):
    pairs = [("a", "a")] * 3 + [("a", "b")] + [("b", "b")] * 2 + [("c", "a")]
    df = spark.createDataFrame(pairs, "y_true string, y_pred string")
    m = evaluation.classification_metrics(df).first()
    assert m.accuracy == pytest.approx(100 * 5 / 7)
    assert m.precision == pytest.approx(100 * (4 * 3 / 4 + 2 * 2 / 3 + 0) / 7)
    assert m.recall == pytest.approx(100 * 5 / 7)
    assert m.f1 == pytest.approx(100 * (4 * 6 / 8 + 2 * 4 / 5 + 0) / 7)
    matrix = {r.y_true: (r.a, r.b, r.c) for r in evaluation.confusion_matrix(df, evaluation.class_labels(df)).collect()}
    assert matrix == {"a": (3, 1, 0), "b": (0, 2, 0), "c": (1, 0, 0)}
    cross = {(r.y_true, r.y_pred): r.n for r in evaluation.crosstab_margins(df).collect()}
    assert cross[("All", "All")] == 7 and cross[("a", "All")] == 4 and cross[("All", "b")] == 3
    assert evaluation.misclassified(df).count() == 2


def call_rows(spark, traces, grp="g"):
    rows = [(grp, t, i, s) for t, seq in traces.items() for i, s in enumerate(seq)]
    return spark.createDataFrame(rows, "grp string, trace_id long, pos long, sym string")


def test_pipeline_end_to_end(spark):
    """Two classes with their own call habits; unseen symbols and an empty trace at the end."""
    r = random.Random(4)
    habits = {"upx": ["open", "read", "map", "jump"], "mew": ["alloc", "copy", "copy", "free", "exit"]}
    calls, labels = [], []
    for t in range(40):
        name = ("upx", "mew")[t % 2]
        noise = [r.choice("abcdefgh") for _ in range(12)]
        k = r.randint(0, 12)
        seq = noise[:k] + habits[name] + noise[k:]
        calls += [(name, t, i, s) for i, s in enumerate(seq)]
        labels.append((t, name))
    labels.append((99, "upx"))
    df = spark.createDataFrame(calls, "grp string, trace_id long, pos long, sym string")
    traces = spark.createDataFrame(labels, "trace_id long, label string")
    learned = pipeline.learn_patterns(df)
    assert learned.count > 0
    rows = pipeline.score_traces(df, traces, learned).cache()
    assert set(rows.where("trace_id = 99").first().scores) == {0}
    model, conditions = pipeline.train(rows.where("trace_id < 90"))
    quality = evaluation.classification_metrics(pipeline.detect(rows.where("trace_id < 90"), conditions)).first()
    assert quality.accuracy > 90
    fresh = call_rows(spark, {7: ["new", "open", "read", "map", "jump"]})
    scored = pipeline.score_traces(fresh, spark.createDataFrame([(7, "upx")], "trace_id long, label string"), learned)
    assert pipeline.detect(scored, conditions).count() == 1
    coded, grown = pipeline.encode_with_growth(fresh, learned.dictionary)
    assert grown.count() == learned.dictionary.count() + 1 and coded.count() == 5


def stream_case(spark, r):
    patterns = spark.createDataFrame(
        [(1, [1, 2, 1, 3]), (2, [2, 2, 3]), (3, [3, 3, 3, 3, 1])], "pattern_id long, gram array<int>"
    )
    conditions = spark.createDataFrame(
        [("a", 1, 1, ">", 2.5), ("b", 2, 1, "<=", 2.5), ("b", 2, 2, ">=", 2.0), ("c", 3, 1, "<=", 2.5), ("c", 3, 2, "<", 2.0), ("c", 3, 3, "==", 2.0)],
        "cls string, rule_id long, pattern_id long, op string, value double",
    )
    traces = {t: [r.randint(1, 4) for _ in range(n)] for t, n in enumerate([0, 1, 3, 4, 7, 8, 9, 12, 30, 30, 31, 40])}
    return patterns, conditions, traces


def batch_verdicts(spark, patterns, conditions, traces):
    from brute import score

    grams = [list(p.gram) for p in patterns.orderBy("pattern_id").collect()]
    table = [(t, [score(g, s) for g in grams]) for t, s in traces.items()]
    batch = rules.tree_verdict(spark.createDataFrame(table, "trace_id long, scores array<int>"), conditions)
    return {x.trace_id: x.verdict for x in batch.collect()}


@pytest.mark.parametrize("block_size,part", [(4, 10**6), (4096, 3)])
def test_stream_equals_batch(spark, tmp_path, block_size, part):
    """Events out of order and repeated, over several files and runs; verdicts appear once, after the end.

    With parts of three symbols every prefix has an automaton of its own."""
    r = random.Random(block_size)
    patterns, conditions, traces = stream_case(spark, r)
    events = [(t, i, s, False) for t, seq in traces.items() for i, s in enumerate(seq)]
    ends = [(t, len(seq), None, True) for t, seq in traces.items() if t != 11]  # trace 11 goes on
    r.shuffle(events)
    feed, folder = str(tmp_path / "feed"), str(tmp_path / "work")
    detectors = detect.Detectors(conditions, patterns, part)
    assert (len(detectors.parts) > 1) == (part == 3)

    def add(rows):
        spark.createDataFrame(rows, detect.EVENTS_SCHEMA).coalesce(2).write.mode("append").parquet(feed)

    add(events[: len(events) // 2] + ends[:6])
    first = detect.run_available(spark, feed, folder, detectors, conditions, block_size)
    early = {x.trace_id for x in first.collect()}
    add(events[len(events) // 2 :] + ends[6:] + events[:60])
    detect.run_available(spark, feed, folder, detectors, conditions, block_size)
    add(r.sample(events, 100) + ends)  # all of it again
    out = detect.run_available(spark, feed, folder, detectors, conditions, block_size).collect()
    got = {x.trace_id: x.verdict for x in out}
    assert len(out) == len(got) and early < set(got) and all(x.ended for x in out)
    want = batch_verdicts(spark, patterns, conditions, traces)
    del want[11]
    assert got == want and len(set(want.values())) > 1


def test_idle_traces_get_a_verdict(spark, tmp_path):
    """A trace without an end is judged after a time without events; one that has its verdict keeps it."""
    r = random.Random(3)
    patterns, conditions, traces = stream_case(spark, r)
    feed, folder = str(tmp_path / "feed"), str(tmp_path / "work")
    detectors = detect.Detectors(conditions, patterns)

    def run(rows):
        spark.createDataFrame(rows, detect.EVENTS_SCHEMA).coalesce(1).write.mode("append").parquet(feed)
        return {x.trace_id: (x.verdict, x.ended) for x in detect.run_available(spark, feed, folder, detectors, conditions, 16, idle="1 second").collect()}

    open_ = {t: s for t, s in traces.items() if s and t in (5, 8, 11)}
    assert run([(t, i, s, False) for t, seq in open_.items() for i, s in enumerate(seq)]) == {}
    found = {}
    for i in range(4):  # timers go off with the next batch
        time.sleep(1.5)
        found = run([(100 + i, 0, 1, False)])
    want = batch_verdicts(spark, patterns, conditions, open_)
    assert {t: found[t] for t in open_} == {t: (v, False) for t, v in want.items()}


def test_failure_links_by_definition(spark):
    r = random.Random(8)
    patterns = [[r.randint(1, 2) for _ in range(r.randint(1, 7))] for _ in range(12)]
    rows = spark.createDataFrame(list(enumerate(patterns)), "pattern_id long, gram array<int>")
    (trie,) = build_tries(rows)
    automaton = detect.Automaton(trie)
    path = {0: ()}
    for node in range(1, len(trie)):
        path[node] = (*path[trie.parent[node]], int(trie.alphabet[trie.symbol[node]]))
    number = {p: n for n, p in path.items()}
    for node, p in path.items():
        assert automaton.fail[node] == next((number[p[i:]] for i in range(1, len(p) + 1) if p[i:] in number), 0)
    text = [r.randint(1, 3) for _ in range(200)]
    node, hits = automaton.advance(0, trie.codes(np.array(text)).tolist(), set())
    found = {g for h in hits for g in automaton.goals(h)}
    assert found == {i for i, p in enumerate(patterns) if any(text[j : j + len(p)] == p for j in range(len(text)))}
