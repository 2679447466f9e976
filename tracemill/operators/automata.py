"""Automata that recognise a pattern prefix symbol by symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def prefix_automaton(patterns: DataFrame) -> DataFrame:
    """Transitions ``(pattern_id, src, sym_id, dst)`` over the symbols of each pattern.

    State q means that the first q symbols have just been read. On symbol c the next state is
    the longest prefix that ends the text ``pattern[1..q] c``. Any other symbol leads to state 0,
    and the accepting state has no transitions. Works row by row: no shuffle.
    """
    steps = (
        patterns.where(F.size("gram") > 0)
        .withColumn("src", F.explode(F.sequence(F.lit(0), F.size("gram") - 1)))
        .withColumn("sym_id", F.explode(F.array_distinct("gram")))
        .withColumn("__read", F.concat(F.slice("gram", F.lit(1), F.col("src")), F.array("sym_id")))
    )
    dst = F.expr(
        "array_max(filter(sequence(0, src + 1), "
        "j -> slice(gram, 1, j) = slice(__read, src + 2 - j, j)))"
    )
    return steps.select("pattern_id", "src", "sym_id", dst.alias("dst"))
