"""Rule files: ``rules_<class>.txt`` with lines ``Règle N: Patron_i > x ... Patron_j <= y``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The file name, rule number and condition formats of a rule file.
FILE_PATTERN = r"rules_([a-zA-Z]+)\.txt"
RULE_PATTERN = r"Règle\s+(\d+):"
RULE_START = "Règle"
CONDITION_PATTERN = r"Patron_(\d+)\s*([<>]=?|==)\s*([-+]?[\d.]+(?:[eE][-+]?\d+)?)"


def parse_rules(lines: DataFrame) -> DataFrame:
    """``(cls, line)`` to one row per condition: ``(cls, rule_id, nr, pattern_id, op, value)``.

    A rule without conditions always holds; it keeps one row with NULL conditions. A rule line without a
    readable number is an error.
    """
    part = [F.regexp_extract_all("line", F.lit(CONDITION_PATTERN), F.lit(i)) for i in (1, 2, 3)]
    zipped = F.arrays_zip(part[0].alias("id"), part[1].alias("op"), part[2].alias("value"))
    return (
        lines.withColumn("line", F.trim(F.col("line")))
        .where(F.col("line").startswith(RULE_START))
        .select(
            "cls",
            F.coalesce(
                F.regexp_extract("line", RULE_PATTERN, 1).try_cast("long"),
                F.raise_error(F.concat(F.lit("rule without a number: "), "line")).cast("long"),
            ).alias("rule_id"),
            F.posexplode_outer(zipped).alias("nr", "c"),
        )
        .select(
            "cls",
            "rule_id",
            "nr",
            F.col("c.id").cast("long").alias("pattern_id"),
            F.col("c.op").alias("op"),
            F.col("c.value").try_cast("double").alias("value"),
        )
    )


def read_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Conditions of all rule files of a folder; files with other names are left out."""
    lines = spark.read.text(f"{folder}/rules_*.txt").select(
        F.regexp_extract(F.col("_metadata.file_name"), FILE_PATTERN, 1).alias("cls"),
        F.col("value").alias("line"),
    )
    return parse_rules(lines.where("cls <> ''"))


def rule_lines(rules: DataFrame) -> DataFrame:
    """Rule texts of ``(cls, rule_id, conditions)``: ``(cls, line)``."""
    # Plain decimals where they say the value exactly, else Spark's own form, which has an exponent.
    plain = "format_number(c.value, '0.0###############')"
    number = f"if(CAST(replace({plain}, ',', '') AS DOUBLE) = c.value, replace({plain}, ',', ''), CAST(c.value AS STRING))"
    text = F.expr(f"transform(conditions, c -> concat('Patron_', c.pattern_id, ' ', c.op, ' ', {number}))")
    line = F.concat(F.lit("Règle "), "rule_id", F.lit(": "), F.array_join(text, " && "))
    return rules.select("cls", line.alias("line"))
