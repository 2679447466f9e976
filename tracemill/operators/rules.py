"""Rules over pattern scores.

A rule is a conjunction of conditions ``score(pattern) op value``; a class is the
disjunction of its rules. A condition ``score > t`` holds exactly when the pattern's
prefix of ``floor(t) + 1`` symbols occurs in the trace.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.labels import DEFAULT_LABEL
from tracemill.operators.automata import prefix_automaton
from tracemill.session import durable, small_side

OPERATORS = (">", "<=", ">=", "<", "==")
_RULES_TYPE = (
    "array<struct<cls:string,rule_id:bigint,"
    "conds:array<struct<pattern_id:bigint,op:string,value:double>>>>"
)


def prefix_length(value: str | Column) -> Column:
    """Number of pattern symbols that must match for ``score > value``."""
    column = F.col(value) if isinstance(value, str) else value
    return (F.floor(column) + 1).cast("int")


def with_prefixes(conditions: DataFrame, patterns: DataFrame) -> DataFrame:
    """Adds ``k`` and the prefix each condition asks for."""
    return (
        conditions.join(patterns.select("pattern_id", "gram"), "pattern_id")
        .withColumn("k", prefix_length("value"))
        .withColumn("prefix", F.slice("gram", F.lit(1), F.col("k")))
        .drop("gram")
    )


def detector_lengths(conditions: DataFrame) -> DataFrame:
    """Prefixes whose presence decides the conditions: distinct ``(pattern_id, k)``.

    ``>`` and ``<=`` ask for ``floor(value) + 1`` symbols, ``>=`` and ``<`` for ``ceil(value)``, ``==`` for the
    value and one more. Lengths below 1 are always there and need no detector.
    """
    value, op = F.col("value"), F.col("op")
    more, least = F.floor(value) + 1, F.ceil(value)
    lengths = F.when(op.isin(">", "<="), F.array(more)).when(op.isin(">=", "<"), F.array(least)).otherwise(F.array(least, more))
    found = conditions.where("pattern_id IS NOT NULL").select("pattern_id", F.explode(lengths.cast("array<int>")).alias("k"))
    return found.where("k >= 1").distinct()


def above(scores: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Scores above the pattern's threshold: the pattern prefix of length ``k`` is present.

    The scores meet the bare thresholds first; prefixes travel to what is left of them only. There may be a
    score for every trace and pattern, so the scores are never the broadcast side.
    """
    keyed = durable(thresholds.withColumn("__nr", F.monotonically_increasing_id()))
    bare = small_side(keyed.select("pattern_id", "value", "__nr"))
    found = scores.hint("merge").join(bare, "pattern_id").where(F.col("score") > F.col("value"))
    return found.drop("value").hint("merge").join(keyed.drop("pattern_id"), "__nr").drop("__nr")


def rules_literal(conditions: DataFrame) -> Column:
    """The rule set as one constant column.

    A rule set is a model: its size follows from the depth of its trees, not from the data. As a
    constant it is evaluated next to the scores, without a join or a shuffle. Operators other than
    those of ``OPERATORS`` are refused.
    """
    rules: dict[tuple[str, int], list[dict]] = {}
    for row in conditions.select("cls", "rule_id", "pattern_id", "op", "value").toLocalIterator():
        conds = rules.setdefault((row["cls"], row["rule_id"]), [])
        if row["pattern_id"] is not None:  # a rule without conditions always holds
            if row["op"] not in OPERATORS:
                raise ValueError(f"unknown operator {row['op']!r} in rule {row['rule_id']} of {row['cls']}")
            conds.append({"pattern_id": row["pattern_id"], "op": row["op"], "value": float(row["value"])})
    document = [{"cls": c, "rule_id": r, "conds": conds} for (c, r), conds in sorted(rules.items())]
    return F.from_json(F.lit(json.dumps(document)), _RULES_TYPE)


def holding_rules(rows: DataFrame, conditions: DataFrame) -> DataFrame:
    """Adds ``holds``: the ``(cls, rule_id)`` of the rules that hold for ``scores``.

    ``scores`` has one number per pattern, or, beside ``pattern_ids``, those of the patterns listed there.
    """
    score = "coalesce(get(scores, CAST(c.pattern_id - 1 AS INT)), 0)"
    if "pattern_ids" in rows.columns:
        score = "coalesce(get(scores, CAST(array_position(pattern_ids, c.pattern_id) AS INT) - 1), 0)"
    test = (
        f"CASE c.op WHEN '>' THEN {score} > c.value WHEN '<=' THEN {score} <= c.value "
        f"WHEN '>=' THEN {score} >= c.value WHEN '<' THEN {score} < c.value ELSE {score} = c.value END"
    )
    kept = F.expr(f"filter(__rules, r -> forall(r.conds, c -> {test}))")
    return (
        rows.withColumn("__rules", rules_literal(conditions))
        .withColumn("holds", F.transform(kept, lambda r: F.struct(r["cls"].alias("cls"), r["rule_id"].alias("rule_id"))))
        .drop("__rules")
    )


def class_verdicts(rows: DataFrame, conditions: DataFrame) -> DataFrame:
    """One row per trace and class with a holding rule: ``(trace_id, cls, n_rules)``."""
    return (
        holding_rules(rows, conditions)
        .select("trace_id", F.explode("holds").alias("h"))
        .groupBy("trace_id", F.col("h.cls").alias("cls"))
        .agg(F.count(F.lit(1)).alias("n_rules"))
    )


def tree_verdict(rows: DataFrame, conditions: DataFrame) -> DataFrame:
    """Adds ``verdict``: the class of the leaf that holds, else the default label.

    Exactly one leaf of a tree holds; of overlapping rules the one with the lowest id counts.
    """
    decided = holding_rules(rows, conditions)
    best = F.expr("array_min(transform(holds, h -> struct(h.rule_id AS rule_id, h.cls AS cls)))")
    return decided.withColumn("verdict", F.coalesce(best["cls"], F.lit(DEFAULT_LABEL))).drop("holds")


def flags_by_class(conditions: DataFrame) -> DataFrame:
    """Patterns each class looks at: ``(cls, n_rules, n_flags, flags)``.

    The set holds at most one entry per pattern of the model.
    """
    pairs = conditions.where("pattern_id IS NOT NULL").groupBy("cls", "pattern_id").agg(F.count(F.lit(1)).alias("n"))
    rules = conditions.groupBy("cls", "rule_id").agg(F.count(F.lit(1)).alias("n")).groupBy("cls").agg(
        F.count(F.lit(1)).alias("n_rules")
    )
    flags = pairs.groupBy("cls").agg(
        F.count(F.lit(1)).alias("n_flags"), F.sort_array(F.collect_list("pattern_id")).alias("flags")
    )
    return rules.join(flags, "cls", "left").select(
        "cls", "n_rules", F.coalesce("n_flags", F.lit(0)).alias("n_flags"), F.coalesce("flags", F.array().cast("array<bigint>")).alias("flags")
    )


def rule_detectors(conditions: DataFrame, patterns: DataFrame) -> DataFrame:
    """The automaton of every condition: ``(cls, rule_id, pattern_id, k, src, sym_id, dst)``."""
    prefixed = with_prefixes(conditions, patterns).where(F.size("prefix") == F.col("k"))
    # Conditions with the same prefix share one automaton.
    distinct = prefixed.select("pattern_id", "k", F.col("prefix").alias("gram")).distinct()
    keyed = distinct.withColumn("__key", F.struct("pattern_id", "k"))
    automata = prefix_automaton(keyed.drop("pattern_id").withColumnRenamed("__key", "pattern_id")).select(
        F.col("pattern_id.pattern_id").alias("pattern_id"), F.col("pattern_id.k").alias("k"), "src", "sym_id", "dst"
    )
    return prefixed.select("cls", "rule_id", "pattern_id", "k").distinct().join(automata, ["pattern_id", "k"])
