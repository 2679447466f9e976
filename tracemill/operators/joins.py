"""Equi-joins whose left side may hold a third of its rows under one key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key with more left rows than this is spread over several tasks. At most
# (left rows / HEAVY_ROWS) keys can be heavy.
HEAVY_ROWS = 10_000_000

# Heavy keys up to which their table is broadcast; beyond it, the planner decides.
HEAVY_KEYS = 100_000


def join_spread(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    weight: str,
    spread_by: Sequence[str],
    how: str = "inner",
    heavy_rows: int = HEAVY_ROWS,
    stored: bool = False,
) -> DataFrame:
    """Inner or left join; the rows of ``right`` know how many left rows their key has.

    A key of ``n`` left rows is cut into ``ceil(n / heavy_rows)`` parts, so that no part grows with the
    data: its left rows get a salt from ``spread_by``, its row of ``right`` is copied once per part.
    Left rows with a NULL key, which match nothing, are spread in the same way over 64 parts.

    A ``stored`` right side is looked through first: without a heavy key only the rows with a NULL key are
    spread, and the plan stays small.
    """
    parts = F.ceil(F.col(weight) / F.lit(heavy_rows)).cast("long")
    no_key = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on])
    above = right.where(F.col(weight) > heavy_rows)
    if stored and above.isEmpty():
        if how == "inner":
            return left.join(right, list(on))
        salt = F.when(no_key, F.pmod(F.xxhash64(*spread_by), F.lit(64))).otherwise(F.lit(0).cast("long"))
        unsalted = right.withColumn("__salt", F.lit(0).cast("long"))
        return left.withColumn("__salt", salt).join(unsalted, [*on, "__salt"], how).drop("__salt")
    heavy = above.select(*on, parts.alias("__parts")).distinct()
    few = heavy.limit(HEAVY_KEYS + 1).count() <= HEAVY_KEYS
    n_parts = F.when(no_key, F.lit(64)).otherwise(F.coalesce("__parts", F.lit(1)))
    salted_left = (
        left.join(F.broadcast(heavy) if few else heavy, list(on), "left")
        .withColumn("__salt", F.pmod(F.xxhash64(*spread_by), n_parts))
        .drop("__parts")
    )
    copies = F.sequence(F.lit(0).cast("long"), F.greatest(F.coalesce(parts, F.lit(1)), F.lit(1)) - 1)
    salted_right = right.withColumn("__salt", F.explode(copies))
    return salted_left.join(salted_right, [*on, "__salt"], how).drop("__salt")
