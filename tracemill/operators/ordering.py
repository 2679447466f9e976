"""Numbering and running values that never put a whole key into one task.

A plain ``row_number() OVER (PARTITION BY key ORDER BY ...)`` sends every row of a
key to one task. Here the caller names a *segment*: a column that grows with the
order, such as the hour of a timestamp or the leading digits of a hash. Each
segment is worked on alone, the small table of per-segment totals is accumulated,
and the totals are added back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.session import durable

_SEG = "__segment"
_BASE = "__base"

# A key with more rows than this is cut into segments; at most (rows / HEAVY_ROWS) keys are.
HEAVY_ROWS = 10_000_000


def _with_base(df: DataFrame, keys: Sequence[str], total: Column, accumulate) -> DataFrame:
    """Join each row to the accumulated total of the earlier segments of its key."""
    earlier = W.partitionBy(*keys).orderBy(_SEG).rowsBetween(W.unboundedPreceding, -1)
    base = (
        df.where(F.col(_SEG).isNotNull())
        .groupBy(*keys, _SEG)
        .agg(total.alias("__total"))
        .select(*keys, _SEG, accumulate("__total").over(earlier).alias(_BASE))
    )
    return df.join(base, [*keys, _SEG], "left")


def _cut_heavy(df: DataFrame, keys: Sequence[str], segment: Column, heavy_rows: int) -> DataFrame:
    """A segment for the rows of heavy keys, NULL for all others, whose keys stay in one piece."""
    heavy = (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > heavy_rows)
        .select(*keys, F.lit(True).alias("__heavy"))
    )
    marked = df.join(F.broadcast(heavy), list(keys), "left")
    return marked.withColumn(_SEG, F.when(F.col("__heavy"), segment)).drop("__heavy")


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    segment: Column,
    order: Sequence[str | Column],
    name: str = "pos",
    start: int = 0,
    heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """Consecutive numbers within ``keys`` in the given order.

    Only keys of more than ``heavy_rows`` rows are cut into segments. Without such a key the table
    of segment totals is empty and the numbering costs one shuffle.
    """
    rows = _with_base(_cut_heavy(df, keys, segment, heavy_rows), keys, F.count(F.lit(1)), F.sum)
    inside = W.partitionBy(*keys, _SEG).orderBy(*order)
    number = F.coalesce(F.col(_BASE), F.lit(0)) + F.row_number().over(inside) + F.lit(start - 1)
    return rows.withColumn(name, number.cast("long")).drop(_SEG, _BASE)


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    segment: Column,
    order: Sequence[str | Column],
    value: str,
    name: str,
) -> DataFrame:
    """Sum of ``value`` over the rows before the current one (0 for the first)."""
    rows = _with_base(df.withColumn(_SEG, segment), keys, F.sum(value), F.sum)
    inside = W.partitionBy(*keys, _SEG).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    total = F.coalesce(F.col(_BASE), F.lit(0)) + F.coalesce(F.sum(value).over(inside), F.lit(0))
    return rows.withColumn(name, total.cast("long")).drop(_SEG, _BASE)


def running_max(
    df: DataFrame,
    keys: Sequence[str],
    segment: Column,
    order: Sequence[str | Column],
    value: str,
    name: str,
) -> DataFrame:
    """Largest ``value`` over the rows before the current one (NULL for the first)."""
    rows = _with_base(df.withColumn(_SEG, segment), keys, F.max(value), F.max)
    inside = W.partitionBy(*keys, _SEG).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn(name, F.greatest(F.col(_BASE), F.max(value).over(inside))).drop(_SEG, _BASE)


def rank_all(df: DataFrame, order: Sequence[str | Column], name: str, start: int = 1) -> DataFrame:
    """Consecutive numbers over the whole table, without a one-task window.

    The table is range-sorted and stored once, so that the partition numbers seen
    by the count and by the numbering are the same.
    """
    stored = durable(
        df.orderBy(*order)
        .withColumn("__part", F.spark_partition_id())
        .withColumn("__row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    # One row per partition of the sort: this window is over partition counts only.
    earlier = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        stored.groupBy("__part")
        .agg(F.count(F.lit(1)).alias("__n"))
        .select("__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__offset"))
    )
    return (
        stored.join(F.broadcast(offsets), "__part")
        .withColumn(name, (F.col("__offset") + F.col("__row") + F.lit(start)).cast("long"))
        .drop("__part", "__row", "__offset")
    )
