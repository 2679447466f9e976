"""Symbol dictionaries and encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.operators.joins import join_spread
from tracemill.operators.ordering import rank_all
from tracemill.session import BROADCAST_ROWS, durable, small_side

UNKNOWN_ID = -1


def symbols(tokens: DataFrame) -> DataFrame:
    """Distinct symbols."""
    return tokens.select("sym").distinct()


def build_dictionary(tokens: DataFrame) -> DataFrame:
    """``(sym, sym_id)`` with ids 1, 2, ... in symbol order."""
    return rank_all(symbols(tokens), ["sym"], "sym_id").select("sym", "sym_id")


def extend_dictionary(base: DataFrame, tokens: DataFrame) -> DataFrame:
    """``base`` plus the unseen symbols of ``tokens``, numbered in first-seen order.

    ``tokens`` needs ``trace_id``; traces are read in ascending ``trace_id``.
    """
    unseen = (
        tokens.groupBy("sym")
        .agg(F.min(F.struct("trace_id", "pos")).alias("first_seen"))
        .join(base.select("sym"), "sym", "left_anti")
    )
    top = base.agg(F.coalesce(F.max("sym_id"), F.lit(0))).first()[0]
    added = rank_all(unseen, ["first_seen"], "sym_id", start=top + 1)
    return base.select("sym", "sym_id").unionByName(added.select("sym", "sym_id"))


def encode(
    tokens: DataFrame,
    dictionary: DataFrame,
    unknown: str = "drop",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Adds ``sym_id``. ``unknown`` is ``"drop"`` or ``"mark"`` (id -1).

    A dictionary of at most ``broadcast_rows`` rows is broadcast, so common symbols cause no
    skew. A larger one is joined by shuffle with the frequent symbols salted.
    """
    if unknown not in ("drop", "mark"):
        raise ValueError(unknown)
    words = dictionary.select("sym", F.col("sym_id").cast("int").alias("sym_id"))
    if words.limit(broadcast_rows + 1).count() <= broadcast_rows:
        how = "inner" if unknown == "drop" else "left"
        coded = tokens.join(F.broadcast(words), "sym", how)
    else:
        # Count first: the counts decide which symbols are salted.
        counted = tokens.groupBy("sym").agg(F.count(F.lit(1)).alias("__n"))
        how = "inner" if unknown == "drop" else "left"
        known = counted.join(words, "sym", how)
        coded = join_spread(tokens, known, ["sym"], "__n", ["trace_id", "pos"]).drop("__n")
    if unknown == "mark":
        coded = coded.withColumn("sym_id", F.coalesce("sym_id", F.lit(UNKNOWN_ID)))
    return coded


def decode(coded: DataFrame, dictionary: DataFrame, default: str | None = "unknown") -> DataFrame:
    """Adds ``sym`` for ``sym_id``; ``default=None`` falls back to the id itself."""
    fallback = F.col("sym_id").cast("string") if default is None else F.lit(default)
    words = small_side(durable(dictionary.select("sym_id", "sym")))
    return coded.drop("sym").join(words, "sym_id", "left").withColumn("sym", F.coalesce("sym", fallback))


def count_singletons(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Number of symbols that occur exactly once, per ``keys``."""
    return (
        tokens.groupBy(*keys, "sym")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*keys)
        .agg(F.count_if(F.col("n") == 1).alias("n_singletons"), F.count(F.lit(1)).alias("n_symbols"))
    )
