"""Queries: repeats and tandem repeats."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.operators import longrepeats, repeats, tandem
from tracemill.operators.blocks import as_text
from tracemill.operators.dictionary import build_dictionary, encode
from tracemill.session import durable
from tracemill.sources.tables import pattern_names
from tracemill.workload.registry import query
from tracemill.workload.tables import (
    OCC_SQL,
    PATTERNS_SQL,
    PROFILE_SQL,
    SEQ_SQL,
    SHARED_SQL,
    coded_events,
    document_words,
    event_tokens,
    feature_patterns,
    mined,
)


@query(
    "supermax_repeats",
    PROFILE_SQL
    + """SELECT grp, len(w) AS len, array_to_string(w, ' ') AS pattern, n_occ, n_traces
FROM profile WHERE n_witness = n_occ""",
)
def supermax_repeats(spark, d):
    found = longrepeats.supermaximal_repeats(coded_events(spark, d))
    return found.select("grp", "len", as_text("gram").alias("pattern"), "n_occ", "n_traces")


_PROFILE_COLUMNS = "grp, len(w) AS len, array_to_string(w, ' ') AS pattern, n_occ, n_left, n_right, n_witness, 100 * n_witness // n_occ AS percent"


def profile_columns(profile):
    return profile.select(
        "grp", "len", as_text("gram").alias("pattern"), "n_occ", "n_left", "n_right", "n_witness", "percent"
    )


@query(
    "near_supermax_repeats",
    PROFILE_SQL
    + """SELECT grp, len(w) AS len, array_to_string(w, ' ') AS pattern, n_occ, n_traces, n_witness, 100 * n_witness // n_occ AS percent
FROM profile WHERE n_witness >= 1 AND 100 * n_witness // n_occ >= 50""",
)
def near_supermax_repeats(spark, d):
    coded = durable(coded_events(spark, d))
    found = durable(repeats.near_supermaximal_repeats(longrepeats.long_repeats(coded), 50))
    return longrepeats.spelled(found, coded).select("grp", "len", "pattern", "n_occ", "n_traces", "n_witness", "percent")


@query("maximal_repeats", PROFILE_SQL + f"SELECT {_PROFILE_COLUMNS} FROM profile WHERE n_left >= 2 AND n_right >= 2")
def maximal_repeats(spark, d):
    return profile_columns(repeats.maximal_repeats(repeats.repeat_profile(durable(coded_events(spark, d)))))


@query(
    "shared_supermax",
    SHARED_SQL + "SELECT grp, len(w) AS len, array_to_string(w, ' ') AS pattern, n_occ, n_traces FROM shared",
)
def shared_supermax(spark, d):
    return mined(coded_events(spark, d)).select("grp", "len", as_text("gram").alias("pattern"), "n_occ", "n_traces")


@query(
    "longest_repeat",
    PROFILE_SQL + "SELECT grp, max(len(w)) AS longest FROM profile GROUP BY grp",
)
def longest_repeat(spark, d):
    return longrepeats.long_repeats(coded_events(spark, d)).groupBy("grp").agg(F.max("len").alias("longest"))


@query(
    "repeat_occurrences",
    SHARED_SQL
    + """SELECT occ.grp, array_to_string(occ.w, ' ') AS pattern, occ.trace_id, occ.pos
FROM occ JOIN shared ON occ.grp = shared.grp AND array_to_string(occ.w, ' ') = array_to_string(shared.w, ' ')""",
)
def repeat_occurrences(spark, d):
    coded = durable(coded_events(spark, d))
    found = repeats.occurrences(coded, mined(coded))
    return found.select("grp", as_text("gram").alias("pattern"), "trace_id", "pos")


@query(
    "context_histogram",
    OCC_SQL
    + """SELECT grp, gram, neighbour, n FROM (
  SELECT *, sum(n) OVER (PARTITION BY grp, gram) AS total FROM (
    SELECT grp, array_to_string(w, ' ') AS gram, CASE WHEN lf < 0 THEN NULL ELSE lf END AS neighbour, count(*) AS n FROM occ GROUP BY ALL) c) t
WHERE total >= 2""",
)
def context_histogram(spark, d):
    """Every repeat of any length."""
    found = repeats.context_histogram(durable(coded_events(spark, d)))
    return found.select("grp", as_text("gram").alias("gram"), "neighbour", "n")


@query(
    "pattern_catalog",
    SHARED_SQL
    + """SELECT row_number() OVER (ORDER BY grp, len(w) DESC, array_to_string(w, ' ')) AS pattern_id,
  grp, len(w) AS len, array_to_string(w, ' ') AS pattern, n_occ, n_traces FROM shared""",
)
def pattern_catalog(spark, d):
    found = repeats.pattern_catalog(mined(coded_events(spark, d)))
    return found.select("pattern_id", "grp", "len", "pattern", "n_occ", "n_traces")


@query(
    "decode_patterns",
    PATTERNS_SQL
    + """, items AS (
  SELECT pattern_id, unnest(w) AS sym_id, generate_subscripts(w, 1) AS k FROM patterns)
SELECT pattern_id, string_agg(CASE WHEN sym_id = 2 THEN 'unknown' ELSE sym END, ' ' ORDER BY k) AS names
FROM items JOIN dict USING (sym_id) GROUP BY pattern_id""",
)
def decode_patterns(spark, d):
    """Patterns spelled out with a dictionary that lacks symbol 2."""
    coded = coded_events(spark, d)
    known = build_dictionary(event_tokens(spark, d)).where("sym_id <> 2")
    names = pattern_names(feature_patterns(coded), known)
    return names.select("pattern_id", F.array_join("names", " ").alias("names"))


@query(
    "near_supermax_any_length",
    PROFILE_SQL
    + """SELECT grp, len(w) AS len, array_to_string(w, ' ') AS pattern, n_occ, n_traces, n_witness,
  100 * n_witness // n_occ AS percent FROM profile WHERE n_witness >= 1""",
)
def near_supermax_any_length(spark, d):
    """By doubling, without a length bound."""
    coded = durable(coded_events(spark, d))
    found = longrepeats.spelled(durable(longrepeats.long_repeats(coded)), coded)
    return found.select("grp", "len", "pattern", "n_occ", "n_traces", "n_witness", "percent")


@query("document_repeats")
def document_repeats(spark, d):
    """Supermaximal word repeats of the documents of a language, of any length: whole copied
    passages. Given by their first place; SQL would need one row per length."""
    words = document_words(spark, d)
    coded = encode(words, build_dictionary(words)).select("grp", "trace_id", "pos", "sym_id")
    found = longrepeats.long_repeats(coded).where("n_witness = n_occ AND n_traces >= 2 AND len >= 3")
    return found.select("grp", "len", F.col("trace_id").alias("doc_id"), "pos", "n_occ", "n_traces")


# --- Tandem repeats ------------------------------------------------------------------------

_SQUARES = """hits AS (
  SELECT grp, trace_id, i AS start, l AS period, s[i:i + l - 1] AS w,
         i + 2 * l > len(s) OR s[i + 2 * l] <> s[i] AS branching,
         NOT EXISTS (FROM range(1, l) d(x) WHERE l % x = 0 AND s[i:i + l - 1 - x] = s[i + x:i + l - 1]) AS primitive
  FROM places, range(1, len(s) // 2 + 1) AS t(l)
  WHERE i + 2 * l - 1 <= len(s) AND s[i:i + l - 1] = s[i + l:i + 2 * l - 1])"""

# Runs: consecutive starts of one period.
_RUNS = """runs AS (
  SELECT grp, trace_id, period, min(start) AS start, max(start) + 2 * period AS stop,
         (max(start) + 2 * period - min(start)) // period AS reps
  FROM (SELECT *, start - row_number() OVER (PARTITION BY trace_id, period ORDER BY start) AS island
        FROM hits WHERE primitive) h
  GROUP BY grp, trace_id, period, island)"""

SQUARES_SQL = SEQ_SQL.rstrip() + ",\n" + _SQUARES + "\n"
RUNS_SQL = SEQ_SQL.rstrip() + ",\n" + _SQUARES + ",\n" + _RUNS + "\n"


@query(
    "tandem_primitive",
    SEQ_SQL
    + """SELECT trace_id, i AS start, l AS period FROM (
  SELECT trace_id, i, l, lead(i) OVER (PARTITION BY trace_id, l, s[i:i + l - 1] ORDER BY i) AS next_i
  FROM places, range(1, len(s) // 2 + 1) AS t(l) WHERE i + l - 1 <= len(s)) n
WHERE next_i - i = l""",
)
def tandem_primitive(spark, d):
    return tandem.primitive_tandem_repeats(durable(coded_events(spark, d)))


@query("tandem_runs", RUNS_SQL + "SELECT trace_id, period, start, stop, reps FROM runs")
def tandem_runs(spark, d):
    return tandem.tandem_runs(durable(coded_events(spark, d))).drop("grp")


@query(
    "tandem_periods",
    RUNS_SQL
    + """SELECT trace_id, max(period) AS longest, count(DISTINCT period) AS n_periods, count(*) AS n_runs
FROM runs GROUP BY trace_id""",
)
def tandem_periods(spark, d):
    return tandem.period_summary(tandem.tandem_runs(durable(coded_events(spark, d))))


@query(
    "tandem_fused",
    RUNS_SQL.rstrip()
    + """, spans AS (SELECT trace_id, start, period, start + period * reps AS stop FROM runs),
reach AS (
  SELECT *, max(stop) OVER (PARTITION BY trace_id ORDER BY start, stop, period
                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM spans),
islands AS (
  SELECT *, sum(CASE WHEN r IS NULL OR start >= r THEN 1 ELSE 0 END)
              OVER (PARTITION BY trace_id ORDER BY start, stop, period ROWS UNBOUNDED PRECEDING) AS island FROM reach)
SELECT trace_id, min(start) AS start, max(stop) AS stop, count(*) AS n_runs FROM islands GROUP BY trace_id, island""",
)
def tandem_fused(spark, d):
    return tandem.fuse_overlapping(tandem.tandem_runs(durable(coded_events(spark, d))))


@query(
    "rotation_classes",
    SQUARES_SQL.rstrip()
    + """, words AS (SELECT w, count(*) AS n FROM hits WHERE primitive GROUP BY w),
canon AS (
  SELECT w, n, (SELECT min(array_to_string(w[x:] || w[:x - 1], ' ')) FROM range(1, len(w) + 1) t(x)) AS rotation FROM words)
SELECT rotation, count(*) AS n_words, sum(n)::BIGINT AS n_squares FROM canon GROUP BY rotation""",
)
def rotation_classes(spark, d):
    found = tandem.squares(durable(coded_events(spark, d))).where("primitive")
    return tandem.rotation_classes(found).withColumn("rotation", as_text("rotation"))


@query(
    "collapse_runs",
    SEQ_SQL + "SELECT trace_id, i - 1 AS pos, s[i] AS sym_id FROM places WHERE i = 1 OR s[i] <> s[i - 1]",
)
def collapse_runs(spark, d):
    return tandem.collapse_runs(coded_events(spark, d)).drop("grp")


@query(
    "collapse_tandem",
    RUNS_SQL
    + """SELECT trace_id, i - 1 AS pos, s[i] AS sym_id FROM places p
WHERE NOT EXISTS (FROM runs r WHERE r.trace_id = p.trace_id AND r.period = 2
                  AND p.i >= r.start + 2 AND p.i < r.start + 2 * r.reps)""",
)
def collapse_tandem(spark, d):
    return tandem.collapse_tandem(durable(coded_events(spark, d)), 2).select("trace_id", "pos", "sym_id")


@query("collapse_fixpoint")
def collapse_fixpoint(spark, d):
    """Loop until stable: no SQL; tested against a plain loop."""
    return tandem.collapse_until_stable(coded_events(spark, d)).select("trace_id", "pos", "sym_id")


@query(
    "tandem_classes",
    SQUARES_SQL + "SELECT trace_id, start, period, \"primitive\", branching FROM hits",
)
def tandem_classes(spark, d):
    found = tandem.squares(durable(coded_events(spark, d)))
    return found.select("trace_id", "start", "period", "primitive", "branching")


@query(
    "tandem_arrays",
    RUNS_SQL
    + """SELECT h.trace_id, h.start, h.period, (r.stop - h.start) // h.period AS reps
FROM hits h JOIN runs r ON r.trace_id = h.trace_id AND r.period = h.period AND h.start >= r.start AND h.start < r.stop - r.period
WHERE h.primitive AND h.start + 2 * h.period <= r.stop AND (r.stop - h.start) // h.period >= 2""",
)
def tandem_arrays(spark, d):
    return tandem.tandem_arrays(durable(coded_events(spark, d)))
