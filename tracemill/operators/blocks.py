"""Traces as arrays of bounded size with overlapping margins.

``to_blocks`` cuts each trace into blocks of ``size`` positions and gives every
block copies of the ``before`` positions in front of it and of the ``after``
positions behind it. All work that looks at neighbours then happens inside one
block, however long the trace is, and costs one shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_SIZE = 1024


def to_blocks(
    tokens: DataFrame,
    value: str = "sym_id",
    before: int = 1,
    after: int = 32,
    size: int = BLOCK_SIZE,
) -> DataFrame:
    """``(grp, trace_id, pos, value)`` to ``(grp, trace_id, block, first_pos, own_from, own_count, syms)``.

    ``syms[own_from .. own_from + own_count - 1]`` (1-based) are the positions the
    block owns; ``first_pos`` is the position of ``syms[1]``. Positions must be
    0, 1, 2, ... without gaps in each trace.
    """
    if max(before, after) >= size:
        raise ValueError("a margin must be shorter than the block")
    block = F.floor(F.col("pos") / size)
    offset = F.col("pos") - block * size
    first_home = block - F.when((block > 0) & (offset < after), 1).otherwise(0)
    last_home = block + F.when(offset >= size - before, 1).otherwise(0)
    homes = F.sequence(first_home, last_home)
    # Shuffle first: collecting on the map side would not make the rows fewer.
    copies = tokens.select(
        "grp", "trace_id", "pos", F.col(value).alias("__v"), F.explode(homes).alias("block")
    ).repartition("trace_id", "block")
    ordered = F.sort_array(F.collect_list(F.struct("pos", "__v")))
    first_own = F.col("block") * size
    return (
        copies.groupBy("grp", "trace_id", "block")
        .agg(ordered.alias("__rows"), F.min("pos").alias("first_pos"), F.max("pos").alias("__last"))
        # A block that only received the margin of its predecessor owns nothing.
        .where(F.col("__last") >= first_own)
        .select(
            "grp",
            "trace_id",
            "block",
            "first_pos",
            (first_own - F.col("first_pos") + 1).cast("int").alias("own_from"),
            (F.least(F.lit(size), F.col("__last") - first_own + 1)).cast("int").alias("own_count"),
            F.col("__rows.__v").alias("syms"),
        )
    )


def own_positions(blocks: DataFrame) -> DataFrame:
    """One row per owned position: adds ``at`` (1-based index into ``syms``) and ``pos``."""
    last = F.col("own_from") + F.col("own_count") - 1
    return blocks.withColumn("at", F.explode(F.sequence("own_from", last))).withColumn(
        "pos", F.col("first_pos") + F.col("at") - 1
    )


def grams(blocks: DataFrame, min_len: int, max_len: int) -> DataFrame:
    """All subsequences of ``min_len`` to ``max_len`` symbols starting at owned positions.

    Returns ``(grp, trace_id, pos, len, gram, left_sym, right_sym)``; a neighbour beyond the
    trace is NULL. The blocks need ``after >= max_len`` (and ``before >= 1`` for ``left_sym``).
    """
    room = F.size("syms") - F.col("at") + 1
    return (
        own_positions(blocks)
        .where(room >= min_len)
        .withColumn("len", F.explode(F.sequence(F.lit(min_len), F.least(F.lit(max_len), room))))
        .select(
            "grp",
            "trace_id",
            "pos",
            "len",
            F.slice("syms", F.col("at"), F.col("len")).alias("gram"),
            F.get("syms", F.col("at") - 2).alias("left_sym"),
            F.get("syms", F.col("at") + F.col("len") - 1).alias("right_sym"),
        )
    )


def as_text(array_column: str):
    """Space-joined text of an array column."""
    return F.array_join(F.col(array_column).cast("array<string>"), " ")
