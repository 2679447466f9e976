import json
import random

import pytest

from pyspark.sql import functions as F

from tracemill.functions import calls, labels
from tracemill.operators import dictionary, ordering, ranges, sampling, substrings
from tracemill.operators.similarity import feature_rows
from tracemill.sources import rules_text, tables, traces


def words(spark, rows):
    return spark.createDataFrame(rows, "grp string, trace_id long, pos long, sym string")


def test_dictionary_golden(spark):
    base = dictionary.build_dictionary(words(spark, [("g", 0, i, s) for i, s in enumerate("bacab")]))
    assert {r.sym: r.sym_id for r in base.collect()} == {"a": 1, "b": 2, "c": 3}
    new = words(spark, [("g", 1, 0, "b"), ("g", 1, 1, "z"), ("g", 2, 0, "d"), ("g", 2, 1, "z")])
    grown = dictionary.extend_dictionary(base, new)
    assert {r.sym: r.sym_id for r in grown.collect()} == {"a": 1, "b": 2, "c": 3, "z": 4, "d": 5}
    coded = dictionary.encode(new, base, unknown="mark").orderBy("trace_id", "pos").collect()
    assert [r.sym_id for r in coded] == [2, -1, -1, -1]
    assert dictionary.encode(new, base).count() == 1
    back = dictionary.decode(dictionary.encode(new, base, unknown="mark"), base)
    assert sorted(r.sym for r in back.collect()) == ["b", "unknown", "unknown", "unknown"]
    kept = dictionary.decode(dictionary.encode(new, base, unknown="mark"), base, default=None)
    assert sorted(r.sym for r in kept.collect()) == ["-1", "-1", "-1", "b"]


def test_large_dictionary_takes_the_shuffle(spark):
    text = words(spark, [("g", i % 7, i, "hot" if i % 3 else f"w{i}") for i in range(600)])
    full = dictionary.build_dictionary(text)
    for unknown in ("drop", "mark"):
        for known in (full, full.where("sym_id % 2 = 0")):
            a = dictionary.encode(text, known, unknown).select("trace_id", "pos", "sym_id").collect()
            b = dictionary.encode(text, known, unknown, broadcast_rows=10).select("trace_id", "pos", "sym_id").collect()
            assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_numbers_and_running_values(spark):
    r = random.Random(1)
    data = [(k, x, r.randint(0, 9)) for k in (0, 1) for x in r.sample(range(1000), 200 if k else 5)]
    df = spark.createDataFrame(data, "k long, x long, v long")
    seg = F.floor(F.col("x") / 37)
    out = ordering.number_rows(df, ["k"], seg, ["x"], "n", heavy_rows=20)  # one heavy key, one light
    out = ordering.running_total(out, ["k"], seg, ["x"], "v", "before")
    out = ordering.running_max(out, ["k"], seg, ["x"], "v", "top").collect()
    for k in (0, 1):
        total, top = 0, None
        for n, row in enumerate(sorted((x for x in out if x.k == k), key=lambda x: x.x)):
            assert (row.n, row.before, row.top) == (n, total, top)
            total += row.v
            top = row.v if top is None else max(top, row.v)
    whole = ordering.number_rows(df, ["k"], seg, ["x"], "m").join(spark.createDataFrame(out).select("k", "x", "n"), ["k", "x"])
    assert whole.where("m <> n").count() == 0 and whole.count() == len(data)
    ranked = ordering.rank_all(df, ["k", "x"], "id").orderBy("k", "x").collect()
    assert [x.id for x in ranked] == list(range(1, len(data) + 1))


def test_ranges(spark):
    pts = spark.createDataFrame([(0, i) for i in range(10)], "k long, at long")
    rng = spark.createDataFrame([(0, 3, "a"), (0, 7, "b"), (1, 0, "c")], "k long, s long, name string")
    got = {r.at: r.name for r in ranges.latest_start(pts, rng, ["k"], "at", "s", ["name"], segment=2).collect()}
    assert got == {**dict.fromkeys((0, 1, 2)), **dict.fromkeys((3, 4, 5, 6), "a"), **dict.fromkeys((7, 8, 9), "b")}
    one = spark.createDataFrame([(5, 2, 6), (5, 2, 7)], "s long, n long, at long")
    assert [r[0] for r in one.select(ranges.inside("s", "n", "at")).collect()] == [True, False]


def test_offsets(spark):
    text = words(spark, [("g", 0, 0, "a"), ("g", 0, 1, "a"), ("g", 3, 0, "b"), ("h", 9, 0, "a")])
    off = substrings.concat_offsets(substrings.trace_lengths(text), F.floor(F.col("trace_id") / 2))
    got = {r.trace_id: (r["first"], r.separator) for r in off.collect()}
    assert got == {0: (0, 2), 3: (3, 4), 9: (0, 1)}
    at = spark.createDataFrame([("g", i) for i in range(6)], "grp string, at long")
    found = {(r.at, r.trace_id, r.pos) for r in substrings.position_to_trace(at, off).collect()}
    assert found == {(0, 0, 0), (1, 0, 1), (3, 3, 0)}


def test_split_golden(spark):
    names = [f"a_{i}" for i in range(5)] + ["x_1", "y_1", "z_1"]
    files = sampling.prefix_groups(spark.createDataFrame([(n + ".json",) for n in names], "name string"))
    assert {r.name: r.grp for r in files.collect()}["x_1.json"] == "ungrouped"
    counts = {(r.grp, r.split): r["count"] for r in sampling.stratified_split(files).groupBy("grp", "split").count().collect()}
    assert counts == {("a", "train"): 2, ("a", "test"): 3, ("ungrouped", "train"): 1, ("ungrouped", "test"): 2}
    lone = sampling.prefix_groups(spark.createDataFrame([("q_1.json",)], "name string"))
    assert [r.split for r in sampling.stratified_split(lone).collect()] == ["train"]
    sizes = [("g2", 2), ("g3", 3), ("g8", 8)]
    df = spark.createDataFrame([(g, f"{g}_{i}") for g, n in sizes for i in range(n)], "grp string, name string")
    got = {r.grp: r["count"] for r in sampling.group_sample(df).groupBy("grp").count().collect()}
    assert got == {"g3": 3, "g8": 5}
    folds = sampling.stratified_folds(df, "grp", "name").groupBy("grp", "fold").count().collect()
    assert {(r.grp, r.fold): r["count"] for r in folds if r.grp == "g8"} == {("g8", 2): 3, ("g8", 0): 3, ("g8", 1): 2}
    single = spark.createDataFrame([(c, c) for c in "abcdef"], "grp string, name string")
    assert sorted(r.fold for r in sampling.stratified_folds(single, "grp", "name").collect()) == [0, 0, 1, 1, 2, 2]


def test_labels_golden(spark):
    df = spark.createDataFrame([("my_UPX_amber.json",), ("bero_x.json",), ("Mew-1.json",)], "n string")
    got = [tuple(r) for r in df.select(labels.label_anywhere("n"), labels.label_from_prefix("n")).collect()]
    assert got == [("upx", "unpacked"), ("bero", "unpacked"), ("mew", "mew")]


def test_trace_files(spark, tmp_path):
    lines = [json.dumps({"FunctionName": f"f{i}", "Return": i, "Arguments": [1, {"a": 2}]}) for i in range(3000)]
    (tmp_path / "upx_1.json").write_text("\n".join(lines))
    odd = ['{"Functionname": "é1", "Address": "0x1"}', "", '{"FunctionName": "a"', '{"name": "b"}', '[1]', '{"FunctionName": ""}', '{"FunctionName": "z"}']
    (tmp_path / "mew_2.json").write_text("\n".join(odd) + "\n", encoding="utf-8")
    (tmp_path / "mew_3.json").write_text("")
    path = str(tmp_path / "*.json")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")  # several splits per file
    try:
        assert spark.read.text(path).rdd.getNumPartitions() > 3
        got = traces.read_traces(spark, path).where("trace_id = 'upx_1.json'").orderBy("pos").collect()
        assert [(r.pos, r.sym, r.result) for r in got] == [(i, f"f{i}", str(i)) for i in range(3000)]
        assert {r.grp for r in got} == {"upx"}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)

    def syms(**options):
        rows = traces.read_traces(spark, path, **options).where("trace_id = 'mew_2.json'").orderBy("pos").collect()
        return [r.sym for r in rows]

    assert syms() == ["1", "z"]
    assert syms(ascii_names=False) == ["é1", "z"]
    assert syms(policy="empty") == ["1", "", "", "z"]
    assert syms(policy="na") == ["1", "b", "", "z"]
    assert syms(bad_lines="stop") == ["1"]
    assert sorted(r.trace_id for r in traces.list_traces(spark, path).collect()) == ["mew_2.json", "mew_3.json", "upx_1.json"]
    marked = calls.mark_bad_lines(traces.read_lines(spark, path))
    stats = {r.trace_id: (r.n_good, r.n_bad) for r in calls.line_stats(marked).collect()}
    assert stats["mew_2.json"] == (4, 2)


def test_undecodable_bytes(spark):
    df = spark.createDataFrame([(bytearray(b"ab\xffc"),)], "b binary")
    assert df.select(calls.replace_undecodable("b")).first()[0] == "ab�c"


def test_round_trips(spark, tmp_path):
    text = words(spark, [("g", 0, i, s) for i, s in enumerate("abcab")] + [("h", 1, 0, "c")])
    known = dictionary.build_dictionary(text)
    tables.write_dictionary(known, str(tmp_path / "dict"))
    known = tables.read_dictionary(spark, str(tmp_path / "dict"))
    coded = dictionary.encode(text, known).withColumn("split", F.when(F.col("trace_id") == 0, "train").otherwise("test"))
    tables.write_encoded(coded, str(tmp_path / "enc"))
    back = spark.read.json(str(tmp_path / "enc")).where("split = 'train'").collect()
    assert [r.ids for r in back] == [[1, 2, 3, 1, 2]]
    patterns = spark.createDataFrame(
        [("g", 1, [1, 2], 2, 1), ("h", 2, [3], 2, 2)], "grp string, pattern_id long, gram array<int>, n_occ long, n_traces long"
    )
    tables.write_patterns(patterns, str(tmp_path / "pat"))
    again = tables.read_patterns(spark, str(tmp_path / "pat"))
    assert sorted((r.grp, r.pattern_id, r.gram) for r in again.collect()) == [("g", 1, [1, 2]), ("h", 2, [3])]
    names = tables.pattern_names(again, known.where("sym <> 'c'"))
    tables.write_pattern_names(names, str(tmp_path / "names"))
    spelled = {r.pattern: r.names for r in spark.read.json(str(tmp_path / "names")).collect()}
    assert spelled == {"Patron_1": ["a", "b"], "Patron_2": ["unknown"]}
    rows = feature_rows(
        spark.createDataFrame([("f1", "upx"), ("f2", "mew")], "trace_id string, label string"),
        spark.createDataFrame([("f1", 2, 7)], "trace_id string, pattern_id long, score int"),
        3,
    )
    tables.write_features(rows, 3, str(tmp_path / "csv"))
    wide = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert wide.columns == ["Fichier", "Patron_1", "Patron_2", "Patron_3", "label"]
    got = {r.trace_id: (r.label, r.scores) for r in tables.read_features(spark, str(tmp_path / "csv")).collect()}
    assert got == {"f1": ("upx", [0, 7, 0]), "f2": ("mew", [0, 0, 0])}
    said = spark.createDataFrame([("f1", "upx", "upx"), ("f2", "mew", "upx")], "filename string, true_label string, predicted_label string")
    tables.write_predictions(said, str(tmp_path / "pred"))
    assert spark.read.option("header", True).csv(str(tmp_path / "pred")).count() == 2
    tables.write_misclassified(said.toDF("filename", "y_true", "y_pred"), str(tmp_path / "wrong"))
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "wrong")).collect()] == [("f2", "mew", "upx")]
    lines = calls.feed_lines(text, substrings.trace_lengths(text)).where("trace_id = 1").orderBy("pos").collect()
    assert [r.line for r in lines] == ["e(c)", "end"]


def test_rule_files(spark, tmp_path):
    (tmp_path / "rules_upx.txt").write_text("Titre\nRègle 1: Patron_3 > 2.5 && Patron_10 <= 4\n  Règle 2: Patron_1 == 7\n", encoding="utf-8")
    (tmp_path / "rules_x1.txt").write_text("Règle 9: Patron_3 > 2.5\n", encoding="utf-8")
    got = sorted(tuple(r) for r in rules_text.read_rules(spark, str(tmp_path)).collect())
    assert got == [("upx", 1, 0, 3, ">", 2.5), ("upx", 1, 1, 10, "<=", 4.0), ("upx", 2, 0, 1, "==", 7.0)]
    rules = spark.createDataFrame(
        [("upx", 5, [(3, ">", 2.5), (4, "<=", 1.0)])], "cls string, rule_id long, conditions array<struct<pattern_id:long,op:string,value:double>>"
    )
    text = rules_text.rule_lines(rules)
    assert text.first().line == "Règle 5: Patron_3 > 2.5 && Patron_4 <= 1.0"
    assert [tuple(r) for r in rules_text.parse_rules(text).collect()] == [("upx", 5, 0, 3, ">", 2.5), ("upx", 5, 1, 4, "<=", 1.0)]


def test_rules_without_conditions_and_large_numbers(spark):
    kind = "cls string, rule_id long, conditions array<struct<pattern_id:long,op:string,value:double>>"
    given = [("upx", 7, []), ("upx", 8, [(1, ">", 12345678.5), (2, "<=", -0.25), (3, "==", 1e-30)])]
    back = rules_text.parse_rules(rules_text.rule_lines(spark.createDataFrame(given, kind)))
    got = sorted(map(tuple, back.collect()), key=str)
    want = [("upx", 7, None, None, None, None), ("upx", 8, 0, 1, ">", 12345678.5), ("upx", 8, 1, 2, "<=", -0.25), ("upx", 8, 2, 3, "==", 1e-30)]
    assert got == want
    assert "12345678.5 " in rules_text.rule_lines(spark.createDataFrame(given[1:], kind)).first().line
    with pytest.raises(Exception, match="without a number"):
        rules_text.parse_rules(spark.createDataFrame([("a", "Règle x: Patron_1 > 2")], "cls string, line string")).collect()


def test_kept_lines_are_counted_without_blanks(spark):
    lines = ["", '{"FunctionName": "a"}', "{broken", '{"FunctionName": "b"}']
    df = spark.createDataFrame([(0, i, x) for i, x in enumerate(lines)], "trace_id long, pos long, line string")
    stats = calls.line_stats(calls.mark_bad_lines(df)).collect()
    assert [(r.n_good, r.n_bad, r.n_kept) for r in stats] == [(2, 1, 1)]


def test_trace_files_round_trip(spark, tmp_path):
    """Broken, blank and missing lines; an empty file; one long trace; nothing temporary is left."""
    from tracemill.sources.traces import list_traces, read_traces, write_traces

    rows = [("a_1.json", i, f'{{"FunctionName": "f{i % 7}"}}') for i in range(5000)]
    rows += [("b_2.json", 1, '{"FunctionName": "x"}'), ("b_2.json", 0, "{broken"), ("b_2.json", 3, ""), ("b_2.json", 5, '{"Functionname": "é"}'), ("c_3.json", 0, None)]
    df = spark.createDataFrame(rows[::-1], "trace_id string, pos long, line string")
    write_traces(df, f"file://{tmp_path}/out")
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a_1.json", "b_2.json", "c_3.json"]
    assert (tmp_path / "out" / "c_3.json").read_bytes() == b"" and (tmp_path / "out" / "b_2.json").read_text().splitlines()[0] == "{broken"
    calls = read_traces(spark, f"file://{tmp_path}/out/*.json", ascii_names=False).collect()
    assert [(r.pos, r.sym) for r in sorted(calls, key=lambda r: r.pos) if r.trace_id == "b_2.json"] == [(0, "x"), (1, "é")]
    assert [r.sym for r in sorted(calls, key=lambda r: r.pos) if r.grp == "a"] == [f"f{i % 7}" for i in range(5000)]
    assert {r.trace_id for r in list_traces(spark, f"file://{tmp_path}/out/*.json").collect()} == {"a_1.json", "b_2.json", "c_3.json"}
    with pytest.raises(Exception, match="no file name"):
        write_traces(spark.createDataFrame([("../x", 0, "y")], df.schema), f"file://{tmp_path}/bad")
    assert list((tmp_path / "bad").iterdir()) == []
