"""Queries: similarity, rules, evaluation, trees and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tracemill.operators import evaluation, rules, similarity, substrings, trees
from tracemill.operators.automata import prefix_automaton
from tracemill.operators.blocks import as_text
from tracemill.operators.dictionary import encode
from tracemill.operators.ordering import rank_all
from tracemill.operators.sampling import name_prefix, stratified_folds, stratified_split
from tracemill.plans import pipeline
from tracemill.session import durable, shared_folder
from tracemill.sources.rules_text import parse_rules
from tracemill.sources.traces import list_traces, read_traces, write_traces
from tracemill.streaming import detect
from tracemill.workload.registry import query
from tracemill.workload.tables import (
    PATTERNS_SQL,
    SCORES_SQL,
    SEQ_SQL,
    coded_events,
    event_tokens,
    feature_patterns,
    load,
)
from tracemill.workload.tree_sql import FOLDED, FOLDS, HOLDS, LABELLED_SQL, RULES, TRAINED, half_sql, tree_sql, walked


def events_and_patterns(spark, d):
    """Stored events and the patterns mined from them."""
    coded = durable(coded_events(spark, d))
    return coded, durable(feature_patterns(coded).select("pattern_id", "grp", "len", "gram", "pattern"))


def event_traces(coded):
    """One row per trace with its class."""
    return (
        coded.groupBy("trace_id", "grp")
        .agg(F.count(F.lit(1)).alias("__n"))
        .select("trace_id", F.concat(F.lit("g"), "grp").alias("label"))
    )


def sparse_rows(traces, coded, patterns):
    """Score rows ``(pattern_ids, scores, floors)`` of all traces, those without any match too.

    They list what tells all scores (``similarity.own_scores``), which is all that a tree can ask for: of the
    splits by one start of several patterns it takes that of the smallest id. The table is never broadcast,
    however few its rows.
    """
    found = similarity.own_scores(similarity.score_paths(patterns, coded)).drop("grp").hint("merge")
    nothing = lambda c, t: F.coalesce(c, F.array().cast(t)).alias(c)
    lists = [nothing("pattern_ids", "array<bigint>"), nothing("scores", "array<int>"), nothing("floors", "array<int>")]
    return traces.join(found, "trace_id", "left").select(*traces.columns, *lists)


def halves(traces):
    """Stored traces ``(trace_id, label)`` with a train/test split within each class; their scores are joined after."""
    grouped = traces.withColumn("grp", F.col("label"))
    return durable(stratified_split(grouped, "trace_id").drop("grp"))


def event_halves(spark, d):
    """Stored score rows of the events' traces with their split, the patterns and the events."""
    coded, patterns = events_and_patterns(spark, d)
    return durable(sparse_rows(halves(event_traces(coded)), coded, patterns)), patterns, coded


def event_rules(spark, d):
    """Score rows, patterns, events and the fitted rules: a tree of six levels of the training half."""
    rows, patterns, coded = event_halves(spark, d)
    nodes = trees.fit_trees(rows.where("split = 'train'"), TREE_DEPTH)
    return rows, patterns, coded, durable(trees.tree_conditions(nodes))


@query(
    "match_lengths",
    PATTERNS_SQL
    + """SELECT p.pattern_id, occ.trace_id, occ.pos, max(k) AS match_len
FROM (SELECT pattern_id, w, unnest(range(1, len(w) + 1)) AS k FROM patterns) p
JOIN (SELECT trace_id, pos, len(w) AS l, array_to_string(w, ' ') AS t FROM occ WHERE len(w) <= (SELECT max(len(w)) FROM patterns)) occ
  ON occ.l = k AND occ.t = array_to_string(p.w[1:k], ' ') GROUP BY ALL""",
)
def match_lengths(spark, d):
    """At each position, how far each pattern matches from there, from one symbol on."""
    coded, patterns = events_and_patterns(spark, d)
    return similarity.match_lengths(patterns, coded).select("pattern_id", "trace_id", "pos", "match_len")


@query("prefix_similarity", SCORES_SQL + "SELECT trace_id, pattern_id, score FROM scores")
def prefix_similarity(spark, d):
    coded, patterns = events_and_patterns(spark, d)
    return similarity.prefix_similarity(patterns, coded).select("trace_id", "pattern_id", "score")


@query(
    "feature_matrix",
    SCORES_SQL
    + """SELECT seq.trace_id, 'g' || seq.grp AS label,
  coalesce(string_agg(CASE WHEN p.pattern_id IS NOT NULL THEN coalesce(score, 0)::VARCHAR END, ' ' ORDER BY p.pattern_id), '') AS scores
FROM seq LEFT JOIN patterns p ON true
LEFT JOIN scores s ON s.trace_id = seq.trace_id AND s.pattern_id = p.pattern_id
GROUP BY seq.trace_id, seq.grp""",
)
def feature_matrix(spark, d):
    coded, patterns = events_and_patterns(spark, d)
    rows = similarity.feature_rows(event_traces(coded), similarity.score_paths(patterns, coded), patterns.count())
    return rows.select("trace_id", "label", as_text("scores").alias("scores"))


@query("feature_maxima", SCORES_SQL + "SELECT pattern_id, max(score) AS max_score FROM scores GROUP BY pattern_id")
def feature_maxima(spark, d):
    coded, patterns = events_and_patterns(spark, d)
    return similarity.feature_maxima(similarity.score_paths(patterns, coded))


@query(
    "threshold_predicate",
    SCORES_SQL
    + """SELECT s.trace_id, s.pattern_id, len(p.w) - 2 AS k, array_to_string(p.w[1:len(p.w) - 2], ' ') AS prefix, s.score
FROM scores s JOIN patterns p USING (pattern_id) WHERE s.score > len(p.w) - 2.5""",
)
def threshold_predicate(spark, d):
    """Scores above a threshold, with the prefix whose presence they stand for."""
    coded, patterns = events_and_patterns(spark, d)
    thresholds = rules.with_prefixes(patterns.select("pattern_id", (F.col("len") - 2.5).alias("value")), patterns)
    found = rules.above(similarity.prefix_similarity(patterns, coded, thresholds=thresholds), thresholds)
    return found.select("trace_id", "pattern_id", "k", as_text("prefix").alias("prefix"), "score")


@query(
    "prefix_detect",
    PATTERNS_SQL
    + """SELECT occ.trace_id, p.pattern_id, count(*) AS n_hits, min(occ.pos) AS first_pos
FROM patterns p JOIN occ ON array_to_string(occ.w, ' ') = array_to_string(p.w[1:len(p.w) - 1], ' ') GROUP BY ALL""",
)
def prefix_detect(spark, d):
    """Traces that contain all but the last symbol of a pattern."""
    coded, patterns = events_and_patterns(spark, d)
    prefixes = patterns.select("pattern_id", F.slice("gram", F.lit(1), F.col("len") - 1).alias("gram"))
    return (
        similarity.match_lengths(prefixes, coded, whole=True)
        .groupBy("trace_id", "pattern_id")
        .agg(F.count(F.lit(1)).alias("n_hits"), F.min("pos").alias("first_pos"))
    )


@query(
    "dfa_transitions",
    PATTERNS_SQL
    + """, steps AS (
  SELECT pattern_id, w, q, c FROM patterns, range(0, len(w)) AS t(q), (SELECT sym_id AS c FROM dict) a
  WHERE q < len(w) AND list_contains(w, c))
SELECT pattern_id, q AS src, c AS sym_id, max(j) AS dst
FROM steps, range(0, q + 2) AS u(j)
WHERE j <= q + 1 AND array_to_string(w[1:j], ' ') = array_to_string(list_append(w[1:q], c)[q + 2 - j:q + 1], ' ')
GROUP BY ALL""",
)
def dfa_transitions(spark, d):
    _, patterns = events_and_patterns(spark, d)
    return prefix_automaton(patterns)


# --- Rules ---------------------------------------------------------------------------------


def part_rule_lines(spark, d):
    """Rule texts made from the parts, with some lines that are no rules."""
    key = F.col("p_partkey")
    text = lambda c: c.cast("string")
    op = F.element_at(F.array(F.lit(">"), F.lit("<="), F.lit("==")), (key % 3 + 1).cast("int"))
    line = F.concat(
        F.when(key % 11 == 0, F.lit("Classe ")).otherwise(F.lit("Règle ")), text(key), F.lit(": Patron_"), text(F.col("p_size")),
        F.lit(" "), op, F.lit(" "), text(key % 9), F.lit(".5 && Patron_"), text(F.col("p_size") + 1), F.lit("<="), text(key % 4),
    )
    return load(spark, d, "part").select(F.col("p_type").alias("cls"), line.alias("line"))


_RULE_SQL = """WITH lines AS (
  SELECT p_type AS cls, CASE WHEN p_partkey % 11 = 0 THEN 'Classe ' ELSE 'Règle ' END || p_partkey || ': Patron_' || p_size
    || ' ' || (['>', '<=', '=='])[p_partkey % 3 + 1] || ' ' || (p_partkey % 9) || '.5 && Patron_' || (p_size + 1) || '<=' || (p_partkey % 4) AS line
  FROM part),
found AS (
  SELECT cls, regexp_extract(line, 'Règle\\s+(\\d+):', 1)::BIGINT AS rule_id,
    regexp_extract_all(line, 'Patron_\\d+\\s*(?:[<>]=?|==)\\s*[\\d.]+') AS c
  FROM lines WHERE line LIKE 'Règle%'),
items AS (SELECT cls, rule_id, unnest(c) AS c, generate_subscripts(c, 1) - 1 AS nr FROM found),
conditions AS (
  SELECT cls, rule_id, nr, regexp_extract(c, 'Patron_(\\d+)', 1)::BIGINT AS pattern_id,
    regexp_extract(c, '([<>]=?|==)', 1) AS op, regexp_extract(c, '([\\d.]+)$', 1)::DOUBLE AS value FROM items)
"""


@query("rule_parse", _RULE_SQL + "SELECT cls, rule_id, nr, pattern_id, op, value FROM conditions")
def rule_parse(spark, d):
    return parse_rules(part_rule_lines(spark, d))


@query(
    "class_flags",
    _RULE_SQL
    + """SELECT cls, count(DISTINCT rule_id) AS n_rules, count(DISTINCT pattern_id) AS n_flags,
  (SELECT string_agg(p::VARCHAR, ' ' ORDER BY p) FROM (SELECT DISTINCT pattern_id AS p FROM conditions x WHERE x.cls = c.cls) u) AS flags
FROM conditions c GROUP BY cls""",
)
def class_flags(spark, d):
    found = rules.flags_by_class(parse_rules(part_rule_lines(spark, d)))
    return found.select("cls", "n_rules", "n_flags", as_text("flags").alias("flags"))


TREE_DEPTH = 6

_FITTED_SQL = LABELLED_SQL + TRAINED + tree_sql(TREE_DEPTH) + RULES


@query("rule_eval", _FITTED_SQL + HOLDS + " SELECT trace_id, cls, count(*) AS n_rules FROM holds GROUP BY ALL")
def rule_eval(spark, d):
    """Classes whose rules hold, by the rules of a fitted tree."""
    rows, _, _, conditions = event_rules(spark, d)
    return rules.class_verdicts(rows, conditions)


_VERDICT_SQL = (
    _FITTED_SQL
    + HOLDS
    + """ SELECT seq.trace_id, coalesce(h.cls, 'unpacked') AS verdict FROM seq LEFT JOIN holds h ON h.trace_id = seq.trace_id"""
)


@query("tree_as_rules", _VERDICT_SQL)
def tree_as_rules(spark, d):
    """Verdicts of all traces by the rules of a fitted tree."""
    rows, _, _, conditions = event_rules(spark, d)
    return rules.tree_verdict(rows, conditions).select("trace_id", "verdict")


def event_feed(coded, folder):
    """Writes events and ends as the files of a stream."""
    calls = coded.select("trace_id", "pos", "sym_id", F.lit(False).alias("is_end"))
    lengths = substrings.trace_lengths(coded)
    ends = lengths.select("trace_id", F.col("n").alias("pos"), F.lit(None).cast("int").alias("sym_id"), F.lit(True).alias("is_end"))
    calls.unionByName(ends).write.parquet(folder)
    return folder


@query("stream_detect", _VERDICT_SQL)
def stream_detect(spark, d):
    """The same verdicts from a stream of the events."""
    _, patterns, coded, conditions = event_rules(spark, d)
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    detectors = detect.Detectors(conditions, patterns)
    said = detect.run_available(spark, event_feed(coded, f"{folder}/feed"), folder, detectors, conditions)
    return said.select("trace_id", "verdict")


@query(
    "rule_detectors",
    _FITTED_SQL
    + """, prefixes AS (
  SELECT DISTINCT c.cls, c.rule_id, c.pattern_id, c.k, p.w[1:c.k] AS w FROM conditions c JOIN patterns p USING (pattern_id)),
steps AS (
  SELECT cls, rule_id, pattern_id, k, w, q, c FROM prefixes, range(0, len(w)) AS t(q), (SELECT sym_id AS c FROM dict) a
  WHERE len(w) = k AND q < len(w) AND list_contains(w, c))
SELECT cls, rule_id, pattern_id, k, q AS src, c AS sym_id, max(j) AS dst
FROM steps, range(0, q + 2) AS u(j)
WHERE j <= q + 1 AND array_to_string(w[1:j], ' ') = array_to_string(list_append(w[1:q], c)[q + 2 - j:q + 1], ' ')
GROUP BY ALL""",
)
def rule_detectors(spark, d):
    """The automaton of every condition of the fitted rules."""
    _, patterns, _, conditions = event_rules(spark, d)
    return rules.rule_detectors(conditions, patterns)


# --- Files to verdicts ---------------------------------------------------------------------


def write_event_files(spark, d):
    """The events as trace files, with broken and blank lines in between, and an empty file per nation."""
    folder = f"{shared_folder(spark)}/traces-{uuid.uuid4().hex}"
    tokens = event_tokens(spark, d)
    name = F.concat(F.lit("g"), "grp", F.lit("_"), "trace_id", F.lit(".json"))
    call = F.to_json(F.struct(F.col("sym").alias("FunctionName")))
    more = F.when(F.col("pos") % 5 == 1, F.array(call, F.lit('{"FunctionName": "cut'))).when(F.col("pos") % 7 == 3, F.array(F.lit(""), call))
    lines = tokens.select(name.alias("trace_id"), "pos", F.posexplode(F.coalesce(more, F.array(call))).alias("k", "line"))
    lines = lines.select("trace_id", (F.col("pos") * 2 + F.col("k")).alias("pos"), "line")
    key = F.col("n_nationkey").cast("string")
    empty = load(spark, d, "nation").select(
        F.concat(F.lit("g"), (F.col("n_nationkey") % 5).cast("string"), F.lit("_none"), key, F.lit(".json")).alias("trace_id"),
        F.lit(0).cast("long").alias("pos"), F.lit(None).cast("string").alias("line"),
    )
    write_traces(lines.unionByName(empty), folder)
    return folder


_FILES = """, files AS (
  SELECT trace_id AS tid, 'g' || grp || '_' || trace_id || '.json' AS trace_id, 'g' || grp AS label FROM seq
  UNION ALL SELECT NULL, 'g' || (n_nationkey % 5) || '_none' || n_nationkey || '.json', 'g' || (n_nationkey % 5) FROM nation)"""


@query(
    "trace_files",
    SEQ_SQL.rstrip() + _FILES + """ SELECT f.trace_id, tok.pos, tok.sym FROM files f LEFT JOIN tok ON tok.trace_id = f.tid""",
)
def trace_files(spark, d):
    """Trace files read back: broken and blank lines are skipped, empty files have a row without a call."""
    folder = write_event_files(spark, d)
    calls = read_traces(spark, f"{folder}/*.json").select("trace_id", "pos", "sym")
    return list_traces(spark, f"{folder}/*.json").join(calls, "trace_id", "left")


_DETECT_SQL = (
    SCORES_SQL.rstrip()
    + _FILES
    + f""", named AS (SELECT f.trace_id, s.pattern_id, s.score FROM scores s JOIN files f ON f.tid = s.trace_id),
halves AS ({half_sql('files')}),
feats AS MATERIALIZED (SELECT trace_id, pattern_id, unnest(range(1, score + 1)) AS k FROM named)"""
    + TRAINED + tree_sql(TREE_DEPTH) + RULES + HOLDS.replace("seq", "files").replace("scores s", "named s")
    + """ SELECT h.trace_id AS filename, h.label AS true_label, h.split, coalesce(o.cls, 'unpacked') AS verdict, coalesce(o.cls, 'unpacked') AS stream_verdict
FROM halves h LEFT JOIN holds o ON o.trace_id = h.trace_id"""
)


@query("pipeline_detect", _DETECT_SQL)
def pipeline_detect(spark, d):
    """Trace files to patterns, scores, a tree, its rules, and their verdicts in batch and on a stream."""
    folder = write_event_files(spark, d)
    calls = durable(read_traces(spark, f"{folder}/*.json").select("grp", "trace_id", "pos", "sym"))
    names = durable(rank_all(list_traces(spark, f"{folder}/*.json"), ["trace_id"], "number"))
    learned = pipeline.learn_patterns(calls)
    coded = durable(encode(calls, learned.dictionary).select("grp", "trace_id", "pos", "sym_id"))
    traces = names.select("trace_id", name_prefix("trace_id").alias("label"))
    rows = durable(sparse_rows(halves(traces), coded, learned.patterns))
    conditions = durable(trees.tree_conditions(trees.fit_trees(rows.where("split = 'train'"), TREE_DEPTH)))
    batch = rules.tree_verdict(rows, conditions)
    # The stream knows traces by number; every trace ends, empty ones too.
    numbered = coded.join(names, "trace_id").select(F.col("number").alias("trace_id"), "pos", "sym_id", F.lit(False).alias("is_end"))
    ends = names.join(substrings.trace_lengths(coded), "trace_id", "left").select(
        F.col("number").alias("trace_id"), F.coalesce("n", F.lit(0)).cast("long").alias("pos"), F.lit(None).cast("int").alias("sym_id"), F.lit(True).alias("is_end")
    )
    work = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    numbered.unionByName(ends).write.parquet(f"{work}/feed")
    detectors = detect.Detectors(conditions, learned.patterns)
    said = detect.run_available(spark, f"{work}/feed", work, detectors, conditions)
    streamed = said.join(names.withColumnRenamed("trace_id", "filename"), F.col("trace_id") == F.col("number")).select("filename", F.col("verdict").alias("stream_verdict"))
    return batch.select(F.col("trace_id").alias("filename"), F.col("label").alias("true_label"), "split", "verdict").join(streamed, "filename", "left")


# --- Evaluation ----------------------------------------------------------------------------


def part_predictions(spark, d):
    """Part types as the truth, and a prediction that is wrong for every third size."""
    wrong = F.element_at(
        F.array(*[F.lit(x) for x in ("SMALL", "MEDIUM", "LARGE", "PROMO")]), (F.col("p_partkey") % 4 + 1).cast("int")
    )
    return load(spark, d, "part").select(
        F.col("p_partkey").alias("filename"),
        F.col("p_type").alias("y_true"),
        F.when(F.col("p_size") % 3 == 0, wrong).otherwise(F.col("p_type")).alias("y_pred"),
    )


_PREDICTIONS_SQL = """WITH predictions AS (
  SELECT p_partkey AS filename, p_type AS y_true,
    CASE WHEN p_size % 3 = 0 THEN (['SMALL', 'MEDIUM', 'LARGE', 'PROMO'])[p_partkey % 4 + 1] ELSE p_type END AS y_pred
  FROM part)
"""


@query(
    "classification_metrics",
    _PREDICTIONS_SQL
    + """, classes AS (
  SELECT c, (SELECT count(*) FROM predictions WHERE y_true = c) AS support,
    (SELECT count(*) FROM predictions WHERE y_pred = c) AS predicted,
    (SELECT count(*) FROM predictions WHERE y_true = c AND y_pred = c) AS tp
  FROM (SELECT DISTINCT y_true AS c FROM predictions UNION SELECT DISTINCT y_pred FROM predictions) u)
SELECT round(100.0 * sum(tp) / sum(support), 6) AS accuracy,
  round(100.0 * sum(support * coalesce(tp / nullif(predicted, 0), 0)) / sum(support), 6) AS "precision",
  round(100.0 * sum(support * coalesce(tp / nullif(support, 0), 0)) / sum(support), 6) AS recall,
  round(100.0 * sum(support * coalesce(2 * tp / nullif(support + predicted, 0), 0)) / sum(support), 6) AS f1
FROM classes""",
)
def classification_metrics(spark, d):
    found = evaluation.classification_metrics(part_predictions(spark, d))
    return found.select(*[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


@query(
    "confusion_matrix",
    _PREDICTIONS_SQL
    + "SELECT y_true, "
    + ", ".join(f"count(*) FILTER (WHERE y_pred = '{t}') AS \"{t}\"" for t in _TYPES)
    + " FROM predictions GROUP BY y_true",
)
def confusion_matrix(spark, d):
    rows = part_predictions(spark, d)
    return evaluation.confusion_matrix(rows, evaluation.class_labels(rows))


@query(
    "crosstab_margins",
    _PREDICTIONS_SQL
    + """SELECT CASE WHEN grouping(y_true) = 1 THEN 'All' ELSE y_true END AS y_true,
  CASE WHEN grouping(y_pred) = 1 THEN 'All' ELSE y_pred END AS y_pred, count(*) AS n
FROM predictions GROUP BY CUBE (y_true, y_pred)""",
)
def crosstab_margins(spark, d):
    return evaluation.crosstab_margins(part_predictions(spark, d))


@query(
    "misclassified",
    """SELECT doc_id AS filename, CASE quality WHEN 1 THEN 'good' ELSE 'bad' END AS y_true,
  CASE toxic WHEN 0 THEN 'good' ELSE 'bad' END AS y_pred
FROM labels WHERE (quality = 1) <> (toxic = 0)""",
)
def misclassified(spark, d):
    """Documents whose toxicity label contradicts their quality label."""
    rows = load(spark, d, "labels").select(
        F.col("doc_id").alias("filename"),
        F.when(F.col("quality") == 1, "good").otherwise("bad").alias("y_true"),
        F.when(F.col("toxic") == 0, "good").otherwise("bad").alias("y_pred"),
    )
    return evaluation.misclassified(rows)


# --- Trees ---------------------------------------------------------------------------------


DEPTHS = (2, 3, 4, 6, 8, 10)

_GRID_SQL = (
    LABELLED_SQL + FOLDED + tree_sql(max(DEPTHS)) + ", folded AS (SELECT trace_id, label, fold, fold AS tree FROM dealt)"
    + walked("folded", max(DEPTHS), "trace_id, label, fold")
    + f""", cut AS (
  SELECT fold, d.depth, trace_id, label, arg_max(cls, said.depth) AS cls FROM said JOIN (SELECT unnest({list(DEPTHS)}) AS depth) d ON said.depth <= d.depth GROUP BY ALL),
per AS (
  SELECT fold, depth, label, count(*) AS support, count(*) FILTER (WHERE cls = label) AS hits FROM cut GROUP BY ALL),
told AS (SELECT fold, depth, cls AS label, count(*) AS told FROM cut GROUP BY ALL),
f AS (
  SELECT depth, avg(f1) AS f1 FROM (
    SELECT fold, depth, sum(support * 2.0 * hits / (support + coalesce(told, 0))) / sum(support) AS f1
    FROM per LEFT JOIN told USING (fold, depth, label) GROUP BY ALL) g GROUP BY depth)
SELECT depth AS max_depth, round(f1, 6) AS f1, row_number() OVER (ORDER BY round(f1, 9) DESC, depth) = 1 AS chosen FROM f"""
)


@query("tree_grid_search", _GRID_SQL)
def tree_grid_search(spark, d):
    """F1 of every depth over stratified folds."""
    rows = event_halves(spark, d)[0].where("split = 'train'")
    report, _ = trees.grid_report(stratified_folds(rows, "label", "trace_id", FOLDS), "fold", FOLDS, list(DEPTHS))
    return report.withColumn("f1", F.round("f1", 6))


@query(
    "tree_predictions",
    LABELLED_SQL + TRAINED + tree_sql(TREE_DEPTH) + ", tested AS (SELECT trace_id, label, 0 AS tree FROM halves WHERE split = 'test')"
    + walked("tested", TREE_DEPTH, "trace_id, label")
    + " SELECT trace_id AS filename, label AS true_label, arg_max(cls, depth) AS predicted_label FROM said GROUP BY ALL",
)
def tree_predictions(spark, d):
    """Predictions for the test half of each class."""
    rows = event_halves(spark, d)[0]
    nodes = trees.fit_trees(rows.where("split = 'train'"), TREE_DEPTH)
    said = trees.predict_trees(rows.where("split = 'test'"), nodes, [TREE_DEPTH])
    return said.select(F.col("trace_id").alias("filename"), F.col("label").alias("true_label"), F.col("predicted").alias("predicted_label"))


@query("tree_rules", _FITTED_SQL + " SELECT cls, rule_id, pattern_id, op, value::DOUBLE AS value FROM conditions")
def tree_rules(spark, d):
    """The rules of a fitted tree in long form."""
    return event_rules(spark, d)[3]


@query("tree_nodes", LABELLED_SQL + TRAINED + tree_sql(TREE_DEPTH) + " SELECT node, depth, pattern_id, k, cls, n::BIGINT AS n FROM nodes")
def tree_nodes(spark, d):
    """A fitted tree: its splits, and class and size of every node."""
    rows = event_halves(spark, d)[0]
    return trees.fit_trees(rows.where("split = 'train'"), TREE_DEPTH).drop("tree")
