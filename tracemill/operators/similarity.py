"""Prefix similarity: how far does a pattern match from its start inside a trace?

Patterns are one trie (``tracemill.operators.trie``); positions go down as far as their symbols lead. The
deepest nodes of a trace, each once, tell the score of every pattern: the depth at which its path leaves
theirs. Scores travel as paths, one row per trace with the patterns of whose own nodes it reaches some; sparse
rows with an entry per pattern, a row per trace and pattern, or a dense array are made only where they are
asked for, a bounded number of scores at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.operators import trie
from tracemill.session import bounded_batches

# Pairs of a position and a pattern that a task of ``match_lengths`` tries, and most tasks.
TASK_PAIRS = 1 << 26
MATCH_TASKS = 10_000
# Rows of a batch of single scores.
LONG_ROWS = 1 << 16


def match_lengths(patterns: DataFrame, tokens: DataFrame, value: str = "sym_id", whole: bool = False) -> DataFrame:
    """How far each pattern matches from each position, ``(grp, trace_id, pos, pattern_id, match_len)``, from 1 on.

    ``whole`` keeps the matches of whole patterns only. The result has a row per position and pattern that
    start alike; ``score_rows`` has the best per trace without them.
    """
    tries = trie.share_tries(patterns, starts=False)
    blocks = trie.trie_blocks(tries, tokens, value)
    if not whole:
        # The blocks are small beside what comes of them: they are dealt by the pairs to be tried, not by their bytes.
        pairs = tokens.count() * tries.count
        parts = max(int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MATCH_TASKS, -(-pairs // TASK_PAIRS)))
        blocks = blocks.repartition(parts, "trace_id", "first_pos")
    return trie.position_matches(tries, blocks, whole)


@dataclass
class Paths:
    """Scores of traces in their short form: ``rows`` of ``trie.trace_paths``, and the ``Starts`` they are read with."""

    rows: DataFrame
    starts: list


def score_paths(patterns: DataFrame, tokens: DataFrame, value: str = "sym_id") -> Paths:
    """All scores, not yet unfolded: ``score_rows`` and the other forms are made of them."""
    tries = trie.share_tries(patterns)
    return Paths(trie.trace_paths(tries, trie.trie_blocks(tries, tokens, value)), tries.starts)


def score_rows(patterns: DataFrame, tokens: DataFrame, value: str = "sym_id") -> DataFrame:
    """Sparse rows ``(grp, trace_id, pattern_ids, scores)``: the longest start of each pattern in each trace.

    Patterns of score 0 are not listed; ids ascend. A trace without any match has no row.
    """
    tries = trie.share_tries(patterns)
    found = trie.trace_scores(tries, trie.trie_blocks(tries, tokens, value))
    return _join_parts(found, ["pattern_ids", "scores"]) if len(tries.parts) > 1 else found.drop("part")


def _join_parts(rows: DataFrame, lists: list[str]) -> DataFrame:
    """Rows of one trace in several tries as one, entries by ascending id."""
    both = F.sort_array(F.flatten(F.collect_list(F.arrays_zip(*lists))))
    joined = rows.groupBy("grp", "trace_id").agg(both.alias("__both"))
    return joined.select("grp", "trace_id", *[F.col(f"__both.{c}").alias(c) for c in lists])


def own_scores(paths: Paths) -> DataFrame:
    """``(grp, trace_id, pattern_ids, scores, floors)``: the patterns of whose own nodes a trace reaches some.

    Their first ``floors`` symbols are also the start of a pattern with a smaller id, which stands for all that
    depends on no more of them. Every other score follows from these.
    """
    starts = paths.starts
    kinds = trie._types(paths.rows)

    def run(batches):
        for batch in batches:
            parts = batch.column("part").to_numpy(zero_copy_only=False)
            row, numbers = trie._flat(batch.column("numbers"))
            ids, floors = np.empty(len(row), np.int64), np.empty(len(row), np.int32)
            for part in np.unique(parts):
                mine, own = parts[row] == part, starts[part].value
                ids[mine], floors[mine] = own.ids[numbers[mine]], own.floor[numbers[mine]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("grp"), batch.column("trace_id"), trie._lists(row, batch.num_rows, ids), batch.column("depths"), trie._lists(row, batch.num_rows, floors)],
                names=["grp", "trace_id", "pattern_ids", "scores", "floors"],
            )

    found = paths.rows.mapInArrow(run, f"{kinds}, pattern_ids array<bigint>, scores array<int>, floors array<int>")
    return _join_parts(found, ["pattern_ids", "scores", "floors"]) if len(starts) > 1 else found


def long_scores(paths: Paths, thresholds: DataFrame | None = None) -> DataFrame:
    """Paths as ``(grp, trace_id, pattern_id, score)``.

    With ``thresholds (pattern_id, value)``, only scores above the least value of their pattern are unfolded.
    """
    starts, spark = paths.starts, paths.rows.sparkSession
    bounds = None
    if thresholds is not None:
        # At most a row per pattern: a model, like the patterns' starts.
        least = thresholds.groupBy("pattern_id").agg(F.min(F.col("value").cast("double")).alias("value")).dropna().orderBy("pattern_id").toArrow()
        bounds = spark.sparkContext.broadcast((least["pattern_id"].to_numpy(), np.r_[least["value"].to_numpy(), np.inf]))

    def bound(ids):
        known, values = bounds.value
        at = np.searchsorted(known, ids)
        hit = at < len(known)
        hit[hit] = known[at[hit]] == ids[hit]
        return values[np.where(hit, at, len(known))]

    def run(batches):
        last, above = None, None
        for batch, own, best in trie.scored(batches, starts):
            wanted = best > 0
            if bounds is not None:
                if own is not last:
                    last, above = own, bound(own.ids)
                wanted &= best > above
            row, which = np.nonzero(wanted)
            for at in range(0, len(row), LONG_ROWS):
                r, w = row[at : at + LONG_ROWS], which[at : at + LONG_ROWS]
                who = pa.array(r)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("grp").take(who), batch.column("trace_id").take(who), pa.array(own.ids[w]), pa.array(best[r, w])],
                    names=["grp", "trace_id", "pattern_id", "score"],
                )

    return paths.rows.mapInArrow(run, f"{trie._types(paths.rows)}, pattern_id long, score int")


def prefix_similarity(patterns: DataFrame, tokens: DataFrame, value: str = "sym_id", thresholds: DataFrame | None = None) -> DataFrame:
    """Longest pattern prefix occurring in each trace: ``(grp, trace_id, pattern_id, score)``, scores from 1 on.

    With ``thresholds (pattern_id, value)``, only scores above the least value of their pattern.
    """
    return long_scores(score_paths(patterns, tokens, value), thresholds)


def best_anywhere(patterns: DataFrame, tokens: DataFrame, value: str = "sym_id") -> DataFrame:
    """Longest prefix of each pattern in any trace: ``(pattern_id, score)``, scores from 1 on."""
    tries = trie.share_tries(patterns, starts=False)
    nodes = trie.trace_nodes(tries, trie.trie_blocks(tries, tokens, value)).select("part", "node").distinct()
    parts = tries.parts

    def best(rows: pa.Table) -> pa.Table:
        one = parts[rows["part"][0].as_py()].value
        depth = one.best_depths(rows["node"].to_numpy())
        some = np.flatnonzero(depth)
        return pa.table({"pattern_id": one.ids[some], "score": depth[some]})

    # A part has no more rows than its trie has nodes.
    return nodes.groupBy("part").applyInArrow(best, "pattern_id long, score int")


def dense_rows(traces: DataFrame, rows: DataFrame, n_patterns: int) -> DataFrame:
    """Adds ``scores``, one number per pattern 1..n and 0 where nothing matched, from sparse rows."""
    # A row has an entry per pattern: few rows are no small table, and none is broadcast.
    some = rows.select("trace_id", F.col("pattern_ids").alias("__ids"), F.col("scores").alias("__scores")).hint("merge")
    joined = traces.drop("scores").join(some, "trace_id", "left")
    names = [c for c in joined.columns if not c.startswith("__")]
    schema = T.StructType([joined.schema[c] for c in names] + [T.StructField("scores", T.ArrayType(T.IntegerType()))])

    def fill(batches):
        step = trie.score_step(n_patterns)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                out = np.zeros((part.num_rows, n_patterns), np.int32)
                ids = part.column("__ids")
                sizes = np.array([len(x) if x.is_valid else 0 for x in ids], np.int64)
                row = np.repeat(np.arange(len(sizes)), sizes)
                out[row, ids.flatten().to_numpy(zero_copy_only=False) - 1] = part.column("__scores").flatten().to_numpy(zero_copy_only=False)
                offsets = np.arange(part.num_rows + 1, dtype=np.int32) * n_patterns
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in names] + [pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel()))], names=[*names, "scores"]
                )

    return joined.mapInArrow(fill, schema)


def _path_rows(traces: DataFrame, paths: Paths, n_patterns: int) -> DataFrame:
    """``dense_rows`` from paths: only these meet the traces, and scores are made after that."""
    told = F.collect_list(F.struct("part", "numbers", "depths")).alias("__paths")
    some = paths.rows.groupBy("grp", "trace_id").agg(told).drop("grp").hint("merge")
    joined = traces.drop("scores").join(some, "trace_id", "left")
    names = [c for c in joined.columns if not c.startswith("__")]
    schema = T.StructType([joined.schema[c] for c in names] + [T.StructField("scores", T.ArrayType(T.IntegerType()))])
    starts = paths.starts

    def fill(batches):
        step = trie.score_step(n_patterns)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                rows = batch.slice(at, step)
                out = np.zeros((rows.num_rows, n_patterns), np.int32)
                row = trie._rows_of(rows.column("__paths"))
                told = rows.column("__paths").flatten()
                parts = told.field("part").to_numpy(zero_copy_only=False)
                for part in np.unique(parts):
                    own = starts[part].value
                    mine = told.filter(pa.array(parts == part))
                    entry, numbers = trie._flat(mine.field("numbers"))
                    depths = trie._flat(mine.field("depths"))[1]
                    out[np.ix_(row[parts == part], own.ids - 1)] = own.scores(entry, numbers, depths, len(mine))
                offsets = np.arange(rows.num_rows + 1, dtype=np.int32) * n_patterns
                yield pa.RecordBatch.from_arrays(
                    [rows.column(c) for c in names] + [pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel()))], names=[*names, "scores"]
                )

    return joined.mapInArrow(fill, schema)


def feature_rows(traces: DataFrame, scores: DataFrame | Paths, n_patterns: int) -> DataFrame:
    """Adds ``scores``: one number per pattern 1..n, 0 where nothing matched, also for empty traces.

    ``scores`` are paths, sparse rows, or rows ``(trace_id, pattern_id, score)``. A trace's list holds at most one entry per pattern; the zeros between entries are filled in
    place, so the trace x pattern table is never joined or shuffled.
    """
    if isinstance(scores, Paths):
        return _path_rows(traces, scores, n_patterns)
    if "pattern_ids" in scores.columns:
        return dense_rows(traces, scores, n_patterns)
    entries = F.sort_array(F.collect_list(F.struct("pattern_id", "score")))
    sparse = scores.groupBy("trace_id").agg(entries.alias("__e"))
    filled = F.expr(
        "flatten(transform(__e, (x, i) -> concat("
        "array_repeat(0, CAST(x.pattern_id - CASE WHEN i = 0 THEN 0 ELSE __e[greatest(i - 1, 0)].pattern_id END - 1 AS INT)), "
        "array(x.score))))"
    )
    return (
        traces.join(sparse, "trace_id", "left")
        # A trace that meets every pattern has no gaps to fill.
        .withColumn(
            "__head",
            F.when(F.col("__e").isNull(), F.array().cast("array<int>"))
            .when(F.size("__e") == n_patterns, F.col("__e.score"))
            .otherwise(filled),
        )
        .withColumn(
            "scores",
            F.concat("__head", F.array_repeat(F.lit(0), F.lit(n_patterns) - F.size("__head"))),
        )
        .drop("__e", "__head")
    )


def _path_maxima(paths: Paths) -> DataFrame:
    """Largest score per pattern, ``(pattern_id, max_score)``: what is reached of the own nodes of each, unfolded once."""
    starts = paths.starts
    pairs = paths.rows.select("part", F.inline(F.arrays_zip(F.col("numbers").alias("number"), F.col("depths").alias("depth"))))
    deepest = pairs.groupBy("part", "number").agg(F.max("depth").alias("depth"))

    def unfold(rows: pa.Table) -> pa.Table:
        own = starts[rows["part"][0].as_py()].value
        best = own.scores(np.zeros(len(rows), np.int64), rows["number"].to_numpy(), rows["depth"].to_numpy(), 1)[0]
        some = np.flatnonzero(best)
        return pa.table({"pattern_id": own.ids[some], "max_score": best[some]})

    # A part has no more rows than its trie has patterns.
    return deepest.groupBy("part").applyInArrow(unfold, "pattern_id long, max_score int")


def feature_maxima(scores: DataFrame | Paths) -> DataFrame:
    """Largest score per pattern, from paths, sparse rows or ``(trace_id, pattern_id, score)``."""
    if isinstance(scores, Paths):
        return _path_maxima(scores).groupBy("pattern_id").agg(F.max("max_score").alias("max_score"))
    if "pattern_ids" in scores.columns:
        scores = _batch_maxima(scores)
    return scores.groupBy("pattern_id").agg(F.max("score").alias("max_score"))


def _batch_maxima(rows: DataFrame) -> DataFrame:
    """Largest score per pattern of the sparse rows that a task has, ``(pattern_id, score)``: they never become a
    row per trace and pattern."""
    bounded_batches(rows.sparkSession)

    def run(batches):
        ids, top = np.empty(0, np.int64), np.empty(0, np.int32)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                new = part.column("pattern_ids").flatten().to_numpy(zero_copy_only=False)
                if not len(new):
                    continue
                every, where = np.unique(np.concatenate([ids, new]), return_inverse=True)
                best = np.zeros(len(every), np.int32)
                np.maximum.at(best, where, np.concatenate([top, part.column("scores").flatten().to_numpy(zero_copy_only=False)]))
                ids, top = every, best
        if len(ids):
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(top)], names=["pattern_id", "score"])

    return rows.select("pattern_ids", "scores").mapInArrow(run, "pattern_id long, score int")
