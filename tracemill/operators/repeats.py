"""Repeated subsequences of each group, from counts of grams.

A repeat is a subsequence with at least two occurrences in one group. All results
come from aggregates over the gram table, so no group, trace or gram is ever
brought together in one task. With a bound the table has one row per position and length. Without one, the
longest match of each position is found first, grams that occur once are never made, and equal ones are
counted before they are shuffled (``repeat_grams``); no length is left out. ``tracemill.operators.longrepeats`` finds (near-)supermaximal repeats of any
length without the gram table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.operators.blocks import BLOCK_SIZE, as_text, grams, own_positions, to_blocks
from tracemill.operators.longrepeats import longest_matches
from tracemill.operators.ordering import rank_all
from tracemill.operators.trie import position_matches, share_tries, trie_blocks
from tracemill.session import durable

# Positions whose grams one task counts.
TASK_POSITIONS = 200_000


def gram_blocks(tokens: DataFrame, before: int, after: int) -> DataFrame:
    """Blocks whose margin may be of any length."""
    return to_blocks(tokens, before=before, after=after, size=max(BLOCK_SIZE, 2 * after))


def repeat_grams(tokens: DataFrame, min_len: int) -> DataFrame:
    """The repeats at each position, ``(grp, gram, left_sym, right_sym)``, however long.

    A gram repeats exactly if it is no longer than the longest match of its position, so no other is made.
    The positions are range-sorted by the symbols from there on: equal grams are neighbours, and are counted
    where they are before they travel. Positions without a group go up to the longest length of all.
    """
    tokens = durable(tokens.select("grp", "trace_id", "pos", "sym_id"))
    matches = durable(longest_matches(tokens))
    total = tokens.count()
    bound = max(min_len, matches.agg(F.max("len")).first()[0] or 0)
    most = F.when(F.col("grp").isNull(), F.lit(bound)).otherwise(F.coalesce("len", F.lit(0))).cast("int")
    cells = tokens.join(matches, ["trace_id", "pos"], "left").select("grp", "trace_id", "pos", F.struct("sym_id", most.alias("most")).alias("cell"))
    blocks = to_blocks(cells, "cell", before=1, after=bound + 1, size=max(BLOCK_SIZE, 2 * (bound + 1)))
    places = own_positions(blocks).withColumn("most", F.expr("syms[at - 1].most")).where(F.col("most") >= min_len)
    windows = durable(
        places.select(
            "grp", "trace_id", "pos", "most", F.get("syms", F.col("at") - 2)["sym_id"].alias("left_sym"),
            F.slice(F.col("syms.sym_id"), F.col("at"), F.col("most") + 1).alias("window"),
        )
    )
    parts = max(int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_POSITIONS))
    dealt = windows.repartitionByRange(parts, "grp", "window", "trace_id", "pos")
    room = F.least("most", F.size("window"))
    lengths = dealt.where(room >= min_len).withColumn("len", F.explode(F.sequence(F.lit(min_len), room)))
    return lengths.select("grp", F.slice("window", F.lit(1), F.col("len")).alias("gram"), "left_sym", F.get("window", F.col("len")).alias("right_sym"))


def repeated_grams(tokens: DataFrame, min_len: int, max_len: int) -> DataFrame:
    """``(grp, gram, n_occ, n_traces)`` of all grams with two or more occurrences.

    Occurrences are first counted per trace, so that the number of traces needs no
    distinct aggregate.
    """
    found = grams(gram_blocks(tokens, 0, max_len), min_len, max_len)
    per_trace = found.groupBy("grp", "gram", "trace_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        per_trace.groupBy("grp", "gram")
        .agg(F.sum("n").alias("n_occ"), F.count(F.lit(1)).alias("n_traces"))
        .where("n_occ >= 2")
    )


def supermaximal_repeats(tokens: DataFrame, max_len: int, min_len: int = 1) -> DataFrame:
    """Repeats not contained in a longer repeat: ``(grp, len, gram, n_occ, n_traces)``.

    Every repeat of two or more symbols marks its prefix and its suffix as contained;
    one aggregate puts marks and repeats together. ``max_len + 1`` is counted as well, so
    the result is exact for all lengths up to ``max_len``. ``longest_repeat`` tells whether
    longer repeats exist.
    """
    repeats = repeated_grams(tokens, min_len, max_len + 1).withColumn("len", F.size("gram"))
    inner = F.col("len") - 1
    itself = F.struct(F.col("gram"), F.col("n_occ"), F.col("n_traces"))
    nothing = F.lit(None).cast("long")

    def mark(start: int):
        part = F.slice("gram", F.lit(start), inner)
        return F.struct(part.alias("gram"), nothing.alias("n_occ"), nothing.alias("n_traces"))

    rows = repeats.select(
        "grp",
        F.inline(F.when(F.col("len") > min_len, F.array(itself, mark(1), mark(2))).otherwise(F.array(itself))),
    )
    return (
        rows.groupBy("grp", "gram")
        .agg(
            F.max("n_occ").alias("n_occ"),
            F.max("n_traces").alias("n_traces"),
            F.count_if(F.col("n_occ").isNull()).alias("n_longer"),
        )
        .where((F.col("n_longer") == 0) & (F.size("gram") <= max_len))
        .select("grp", F.size("gram").alias("len"), "gram", "n_occ", "n_traces")
    )


def longest_repeat(tokens: DataFrame, max_len: int) -> DataFrame:
    """Per group the longest repeat up to ``max_len`` and whether the bound was reached.

    ``reached`` true means that longer repeats may exist: raise ``max_len`` or use
    ``tracemill.operators.longrepeats``.
    """
    return (
        repeated_grams(tokens, 1, max_len)
        .groupBy("grp")
        .agg(F.max(F.size("gram")).alias("longest"))
        .withColumn("reached", F.col("longest") >= max_len)
    )


def shared_repeats(repeats: DataFrame, min_traces: int = 2, min_len: int = 3) -> DataFrame:
    """Repeats found in several traces and of some length; applied after supermaximality."""
    return repeats.where((F.col("n_traces") >= min_traces) & (F.col("len") >= min_len))


def context_histogram(tokens: DataFrame, min_len: int = 1, max_len: int | None = None, side: str = "left") -> DataFrame:
    """Occurrences of each repeated gram by neighbour: ``(grp, gram, neighbour, n)``; NULL is a trace border.

    Without ``max_len`` all repeats are taken, however long; with it also grams that occur once.
    """
    # Rows without a group have no repeats here.
    found = grams(gram_blocks(tokens, 1, max_len + 1), min_len, max_len) if max_len else repeat_grams(tokens.where("grp IS NOT NULL"), min_len)
    return found.withColumnRenamed(f"{side}_sym", "neighbour").groupBy("grp", "gram", "neighbour").agg(F.count(F.lit(1)).alias("n"))


def repeat_profile(tokens: DataFrame, max_len: int | None = None, min_len: int = 1) -> DataFrame:
    """Occurrence, neighbour and witness counts of every repeat (up to ``max_len`` if it is given).

    Returns ``(grp, len, gram, n_occ, n_left, n_right, n_witness, percent)``. A witness is an
    occurrence whose left and right neighbours occur once each among the gram's occurrences;
    a trace border is a neighbour of its own. The totals per neighbour are taken under
    ``(gram, left)`` and ``(gram, right)``, never under the gram alone.
    """
    found = grams(gram_blocks(tokens, 1, max_len + 1), min_len, max_len) if max_len else repeat_grams(tokens, min_len)
    pairs = found.groupBy("grp", "gram", "left_sym", "right_sym").agg(F.count(F.lit(1)).alias("n"))

    def with_side(rows: DataFrame, side: str, other: str) -> DataFrame:
        same = W.partitionBy("grp", "gram", side)
        border = F.col(side).isNull()
        first = F.row_number().over(same.orderBy(other)) == 1
        return (
            rows.withColumn(f"__{side}_first", first)
            .withColumn(f"__{side}_once", border | (F.sum("n").over(same) == 1))
            .withColumn(
                f"__{side}_kinds",
                F.when(border, F.col("n")).when(F.col(f"__{side}_first"), F.lit(1)).otherwise(F.lit(0)),
            )
            .drop(f"__{side}_first")
        )

    rows = with_side(with_side(pairs, "left_sym", "right_sym"), "right_sym", "left_sym")
    witness = F.when(F.col("__left_sym_once") & F.col("__right_sym_once"), F.col("n")).otherwise(F.lit(0))
    return (
        rows.groupBy("grp", "gram")
        .agg(
            F.sum("n").alias("n_occ"),
            F.sum("__left_sym_kinds").alias("n_left"),
            F.sum("__right_sym_kinds").alias("n_right"),
            F.sum(witness).alias("n_witness"),
        )
        .where("n_occ >= 2")
        .select(
            "grp",
            F.size("gram").alias("len"),
            "gram",
            "n_occ",
            "n_left",
            "n_right",
            "n_witness",
            F.expr("CAST(100 * n_witness DIV n_occ AS INT)").alias("percent"),
        )
    )


def near_supermaximal_repeats(profile: DataFrame, min_percent: int) -> DataFrame:
    """Repeats whose witnesses make up at least ``min_percent`` of the occurrences.

    0 keeps any repeat with a witness, 100 keeps the supermaximal ones.
    """
    kept = profile.where("n_witness >= 1")
    if min_percent >= 100:
        return kept.where("n_witness = n_occ")
    return kept.where(F.col("percent") >= min_percent)


def maximal_repeats(profile: DataFrame) -> DataFrame:
    """Repeats that cannot be extended on either side at all their occurrences."""
    return profile.where("n_left >= 2 AND n_right >= 2")


def occurrences(tokens: DataFrame, repeats: DataFrame) -> DataFrame:
    """Start positions of each repeat, of any length: ``(grp, gram, trace_id, pos)``.

    The repeats of all groups are one trie, which every position goes down once; a match counts in the
    repeat's own group.
    """
    wanted = durable(rank_all(repeats.select("grp", "gram"), ["grp", "gram"], "pattern_id"))
    tries = share_tries(wanted, starts=False)
    found = position_matches(tries, trie_blocks(tries, tokens), whole=True).select("grp", "trace_id", "pos", "pattern_id")
    return found.join(wanted, ["grp", "pattern_id"]).select("grp", "gram", "trace_id", "pos")


def pattern_catalog(repeats: DataFrame) -> DataFrame:
    """Numbers the repeats of all groups by ``(grp, len desc, text)``: adds ``pattern_id`` and ``pattern``."""
    texts = repeats.withColumn("pattern", as_text("gram"))
    return rank_all(texts, ["grp", F.desc("len"), "pattern"], "pattern_id")
