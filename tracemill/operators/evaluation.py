"""Classification quality from ``(y_true, y_pred)`` rows.

Everything is derived from the counts of label pairs, which have at most
(number of classes) squared rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pair_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def classification_metrics(rows: DataFrame) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1, all times 100; one row."""
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(F.lit(0))
    as_true = F.struct(F.col("y_true").alias("label"), hit.alias("tp"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"))
    as_pred = F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"))
    per_label = (
        pair_counts(rows)
        .select(F.inline(F.array(as_true, as_pred)))
        .groupBy("label")
        .agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted")])
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, support, predicted = F.col("tp"), F.col("support"), F.col("predicted")
    weighted = lambda c: F.sum(support * c) / F.sum(support) * 100
    return per_label.agg(
        (F.sum(tp) / F.sum(support) * 100).alias("accuracy"),
        weighted(ratio(tp, predicted)).alias("precision"),
        weighted(ratio(tp, support)).alias("recall"),
        weighted(ratio(2 * tp, support + predicted)).alias("f1"),
    )


def class_labels(rows: DataFrame, column: str = "y_true") -> list[str]:
    """Sorted labels: one name per class of the model. ``pair_counts`` has the same in long form."""
    return sorted(r[0] for r in rows.select(column).distinct().toLocalIterator() if r[0] is not None)


def confusion_matrix(rows: DataFrame, labels: Sequence[str]) -> DataFrame:
    """One row per true label and one column per predicted label, zero-filled."""
    spark = rows.sparkSession
    counted = (
        pair_counts(rows)
        .where(F.col("y_true").isin(*labels))
        .groupBy("y_true")
        .pivot("y_pred", list(labels))
        .agg(F.sum("n"))
    )
    every = spark.createDataFrame([(label,) for label in labels], "y_true string")
    return every.join(counted, "y_true", "left").na.fill(0)


def crosstab_margins(rows: DataFrame) -> DataFrame:
    """Counts per pair of labels with row and column totals under ``All``."""
    pairs = pair_counts(rows)
    name = lambda c: F.when(F.grouping(c) == 1, F.lit("All")).otherwise(F.col(c))
    return (
        pairs.cube("y_true", "y_pred")
        .agg(F.sum("n").alias("n"), name("y_true").alias("__t"), name("y_pred").alias("__p"))
        .select(F.col("__t").alias("y_true"), F.col("__p").alias("y_pred"), "n")
    )


def misclassified(rows: DataFrame) -> DataFrame:
    """Rows whose prediction differs from the truth."""
    return rows.where(~F.col("y_true").eqNullSafe(F.col("y_pred")))
