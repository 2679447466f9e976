"""Stored forms of dictionaries, encoded traces, patterns, features and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.operators.blocks import BLOCK_SIZE, as_text
from tracemill.operators.dictionary import decode
from tracemill.operators.evaluation import misclassified



def write_dictionary(dictionary: DataFrame, path: str) -> None:
    dictionary.select("sym", "sym_id").write.mode("overwrite").parquet(path)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("sym string, sym_id long").parquet(path)


def encoded_blocks(coded: DataFrame, size: int = BLOCK_SIZE) -> DataFrame:
    """Encoded traces as rows of at most ``size`` ids: ``(trace_id, block, ids)``."""
    ordered = F.sort_array(F.collect_list(F.struct("pos", "sym_id")))
    return (
        coded.withColumn("block", F.floor(F.col("pos") / size))
        .groupBy("trace_id", "block")
        .agg(ordered.alias("__rows"))
        .select("trace_id", "block", F.col("__rows.sym_id").alias("ids"))
    )


def write_encoded(coded: DataFrame, path: str, split: str = "split") -> None:
    """One folder per split; ``coded`` needs the split column next to the tokens."""
    blocks = (
        encoded_blocks(coded)
        .join(coded.select("trace_id", split).distinct(), "trace_id")
    )
    blocks.write.mode("overwrite").partitionBy(split).json(path)


def write_patterns(patterns: DataFrame, path: str) -> None:
    """Patterns of all groups, one folder per group."""
    patterns.select("grp", "pattern_id", "gram", "n_occ", "n_traces").write.mode("overwrite").partitionBy(
        "grp"
    ).json(path)


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    schema = "grp string, pattern_id long, gram array<int>, n_occ long, n_traces long"
    return spark.read.schema(schema).json(path)


def pattern_names(patterns: DataFrame, dictionary: DataFrame, default: str | None = "unknown") -> DataFrame:
    """Patterns spelled with symbols: ``(pattern_id, names)``."""
    items = patterns.select("pattern_id", F.posexplode("gram").alias("k", "sym_id"))
    named = decode(items, dictionary, default)
    ordered = F.sort_array(F.collect_list(F.struct("k", "sym")))
    # At most one entry per symbol of a pattern.
    return named.groupBy("pattern_id").agg(ordered.alias("__n")).select(
        "pattern_id", F.col("__n.sym").alias("names")
    )


def write_pattern_names(names: DataFrame, path: str) -> None:
    names.select(F.concat(F.lit("Patron_"), "pattern_id").alias("pattern"), "names").write.mode(
        "overwrite"
    ).json(path)


def wide_features(rows: DataFrame, n_patterns: int) -> DataFrame:
    """Feature rows with one column per pattern: ``Fichier, Patron_1 .. Patron_n, label``."""
    columns = [F.get("scores", F.lit(i)).alias(f"Patron_{i + 1}") for i in range(n_patterns)]
    return rows.select(F.col("trace_id").alias("Fichier"), *columns, "label")


def write_features(rows: DataFrame, n_patterns: int, path: str) -> None:
    wide_features(rows, n_patterns).write.mode("overwrite").option("header", True).csv(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Feature CSV back as ``(trace_id, label, scores)``."""
    wide = spark.read.option("header", True).option("inferSchema", True).csv(path)
    scores = F.array(*[F.col(c) for c in wide.columns if c.startswith("Patron_")])
    return wide.select(F.col("Fichier").alias("trace_id"), "label", scores.alias("scores"))


def write_predictions(predictions: DataFrame, path: str) -> None:
    """All predictions: ``filename, true_label, predicted_label``."""
    predictions.select("filename", "true_label", "predicted_label").write.mode("overwrite").option(
        "header", True
    ).csv(path)


def write_misclassified(rows: DataFrame, path: str) -> None:
    """Only the rows where ``y_pred`` differs: ``filename, y_true, y_pred``."""
    misclassified(rows).select("filename", "y_true", "y_pred").write.mode("overwrite").option("header", True).csv(path)
