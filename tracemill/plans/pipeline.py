"""The three entry points: learn patterns, train and specify, detect."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.operators.dictionary import build_dictionary, encode, extend_dictionary
from tracemill.operators.longrepeats import supermaximal_repeats
from tracemill.operators.repeats import pattern_catalog
from tracemill.operators.rules import tree_verdict
from tracemill.operators.similarity import feature_rows, score_paths
from tracemill.plans.learn import grid_search, rule_conditions, tree_nodes, tree_rules
from tracemill.session import durable


@dataclass
class Patterns:
    """What mining learned: the dictionary and the numbered patterns."""

    dictionary: DataFrame
    patterns: DataFrame
    count: int


def learn_patterns(calls: DataFrame, min_traces: int = 2, min_len: int = 3) -> Patterns:
    """Mines the repeats, of any length, shared by the traces of each group."""
    dictionary = durable(build_dictionary(calls))
    coded = durable(encode(calls, dictionary).select("grp", "trace_id", "pos", "sym_id"))
    shared = supermaximal_repeats(coded, min_traces=min_traces, min_len=min_len)
    patterns = durable(pattern_catalog(shared))
    return Patterns(dictionary, patterns, patterns.count())


def score_traces(calls: DataFrame, traces: DataFrame, learned: Patterns) -> DataFrame:
    """Feature rows ``(trace_id, label, scores)``; unknown symbols match nothing.

    ``traces`` has ``(trace_id, label)`` and also lists traces without calls.
    """
    coded = encode(calls, learned.dictionary, unknown="mark").select("grp", "trace_id", "pos", "sym_id")
    scores = score_paths(learned.patterns.select("pattern_id", "gram"), coded)
    return feature_rows(traces, scores, learned.count)


def train(rows: DataFrame) -> tuple[object, DataFrame]:
    """Grid search on training rows; returns the fitted model and its rules in long form."""
    search = grid_search(rows)
    model = search.bestModel
    depth = model.stages[1].depth
    conditions = rule_conditions(tree_rules(tree_nodes(model, rows.sparkSession), depth))
    return model, durable(conditions)


def detect(rows: DataFrame, conditions: DataFrame) -> DataFrame:
    """``(filename, y_true, y_pred)`` by the rules alone."""
    return tree_verdict(rows, conditions).select(
        F.col("trace_id").alias("filename"), F.col("label").alias("y_true"), F.col("verdict").alias("y_pred")
    )


def encode_with_growth(calls: DataFrame, dictionary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Encodes new traces, giving new symbols new ids; returns the calls and the grown dictionary."""
    grown = durable(extend_dictionary(dictionary, calls))
    return encode(calls, grown), grown
