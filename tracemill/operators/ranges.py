"""Which range does a point fall into? An as-of lookup without a range join.

Points and range starts are merged in one ordered stream and each point takes the
last start before it. The two-phase running maximum keeps this free of skew.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.operators.ordering import running_max

SEGMENT = 4096


def latest_start(
    points: DataFrame,
    ranges: DataFrame,
    keys: Sequence[str],
    point: str,
    start: str,
    payload: Sequence[str],
    segment: int = SEGMENT,
) -> DataFrame:
    """Adds ``payload`` (NULL if none) of the range with the largest ``start <= point``."""
    merged_points = points.select(
        *points.columns, F.col(point).cast("long").alias("__at"), F.lit(1).alias("__kind")
    )
    merged_starts = ranges.select(
        *keys,
        F.col(start).cast("long").alias("__at"),
        F.lit(0).alias("__kind"),
        F.struct(F.col(start).cast("long").alias("__start"), *payload).alias("__range"),
    )
    merged = merged_points.unionByName(merged_starts, allowMissingColumns=True)
    marked = running_max(
        merged, keys, F.floor(F.col("__at") / segment), ["__at", "__kind"], "__range", "__found"
    )
    return marked.where("__kind = 1").select(
        *points.columns, *[F.col(f"__found.{name}").alias(name) for name in payload]
    )


def inside(start: str, length: str, point: str):
    """True where ``point`` lies in ``[start, start + length)``."""
    return (F.col(point) >= F.col(start)) & (F.col(point) < F.col(start) + F.col(length))
