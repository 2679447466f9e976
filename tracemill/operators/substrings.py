"""Global positions, n-grams and substring lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.operators.blocks import grams, to_blocks
from tracemill.operators.ordering import running_total
from tracemill.operators.ranges import latest_start
from tracemill.operators.similarity import best_anywhere


def trace_lengths(tokens: DataFrame) -> DataFrame:
    """``(grp, trace_id, n)``."""
    return tokens.groupBy("grp", "trace_id").agg(F.count(F.lit(1)).alias("n"))


def concat_offsets(lengths: DataFrame, segment: Column) -> DataFrame:
    """Where each trace lies in its group's concatenation with one separator after every trace.

    ``segment`` must grow with ``trace_id``. Returns ``(grp, trace_id, n, first, separator)``.
    """
    sized = lengths.withColumn("__step", F.col("n") + 1)
    placed = running_total(sized, ["grp"], segment, ["trace_id"], "__step", "first")
    return placed.select("grp", "trace_id", "n", "first", (F.col("first") + F.col("n")).alias("separator"))


def position_to_trace(positions: DataFrame, offsets: DataFrame) -> DataFrame:
    """Maps ``(grp, at)`` to ``(trace_id, pos)``; separators and positions beyond the end drop out."""
    found = latest_start(positions, offsets, ["grp"], "at", "first", ["trace_id", "first", "n"])
    return (
        found.withColumn("pos", F.col("at") - F.col("first"))
        .where("pos >= 0 AND pos < n")
        .drop("first", "n")
    )


def ngrams(tokens: DataFrame, min_len: int, max_len: int) -> DataFrame:
    """Counts of all contiguous subsequences: ``(grp, gram, n_occ, n_traces)``."""
    found = grams(to_blocks(tokens, before=0, after=max_len), min_len, max_len)
    return (
        found.groupBy("grp", "gram", "trace_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("grp", "gram")
        .agg(F.sum("n").alias("n_occ"), F.count(F.lit(1)).alias("n_traces"))
    )


def substring_lookup(queries: DataFrame, tokens: DataFrame, value: str = "sym_id") -> DataFrame:
    """Longest prefix of each query found anywhere in the text: ``(pattern_id, found_len)``.

    ``queries`` has ``(pattern_id, gram)``; a query without any match gets 0.
    """
    best = best_anywhere(queries, tokens, value)
    return queries.join(best, "pattern_id", "left").select(
        "pattern_id", F.coalesce("score", F.lit(0)).alias("found_len")
    )
