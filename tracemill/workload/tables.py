"""The given tables as sequences, and the SQL text for the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.operators.dictionary import build_dictionary, encode
from tracemill.operators.ordering import number_rows
from tracemill.operators.longrepeats import supermaximal_repeats
from tracemill.operators.repeats import pattern_catalog
from tracemill.session import durable

GROUPS = 5

# Characters that separate words; the same class in both engines.
WORD_BREAK = "[ \\t\\n\\f\\r]+"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as traces: one per user, in time order, the event type as symbol."""
    events = load(spark, sf_dir, "events").select(
        (F.col("user_id") % GROUPS).alias("grp"),
        F.col("user_id").alias("trace_id"),
        "ts",
        "event_id",
        F.col("event_type").alias("sym"),
    )
    numbered = number_rows(events, ["trace_id"], F.date_trunc("day", "ts"), ["ts", "event_id"])
    return numbered.select("grp", "trace_id", "pos", "sym")


def coded_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The dictionary needs no positions: it is built from the bare column.
    names = load(spark, sf_dir, "events").select(F.col("event_type").alias("sym"))
    coded = encode(event_tokens(spark, sf_dir), durable(build_dictionary(names)))
    return coded.select("grp", "trace_id", "pos", "sym_id")


def word_tokens(spark: SparkSession, sf_dir: str, table: str, key: str, grp) -> DataFrame:
    """The words of a text column as traces."""
    words = F.filter(F.split("text", WORD_BREAK), lambda w: w != "")
    return load(spark, sf_dir, table).select(
        grp.alias("grp"), F.col(key).alias("trace_id"), F.posexplode(words).alias("pos", "sym")
    ).withColumn("pos", F.col("pos").cast("long"))


def document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_tokens(spark, sf_dir, "documents", "doc_id", F.col("lang"))


def mined(coded: DataFrame) -> DataFrame:
    """Repeats of three or more symbols shared by two or more traces of a group."""
    return supermaximal_repeats(coded, min_traces=2, min_len=3)


def feature_patterns(coded: DataFrame) -> DataFrame:
    """The shared repeats, numbered: ``pattern_id, grp, len, gram, pattern, ...``."""
    return pattern_catalog(mined(coded))


# --- The same in SQL -----------------------------------------------------------------------

TOK = """tok AS (
  SELECT user_id % 5 AS grp, user_id AS trace_id, event_type AS sym,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos
  FROM events)"""

DICT = """dict AS (
  SELECT sym, row_number() OVER (ORDER BY sym) AS sym_id FROM (SELECT DISTINCT sym FROM tok) d)"""

SEQ = """seq AS (
  SELECT tok.grp, tok.trace_id, list(dict.sym_id ORDER BY tok.pos) AS s
  FROM tok JOIN dict USING (sym) GROUP BY tok.grp, tok.trace_id)"""

PLACES = """places AS (
  SELECT grp, trace_id, s, unnest(range(1, len(s) + 1)) AS i FROM seq)"""

# Occurrences with neighbours; a trace border is a neighbour of its own.
OCC = """occ AS MATERIALIZED (
  SELECT grp, trace_id, i - 1 AS pos, s[i:i + l - 1] AS w,
         CASE WHEN i = 1 THEN -1 - trace_id ELSE s[i - 1] END AS lf,
         CASE WHEN i + l > len(s) THEN -1 - trace_id ELSE s[i + l] END AS rt
  FROM places, range(1, len(s) + 1) AS t(l) WHERE i + l - 1 <= len(s))"""

PROFILE = """profile AS (
  SELECT grp, w, count(*) AS n_occ, count(DISTINCT lf) AS n_left, count(DISTINCT rt) AS n_right,
         count(*) FILTER (WHERE cl = 1 AND cr = 1) AS n_witness, count(DISTINCT trace_id) AS n_traces
  FROM (SELECT *, count(*) OVER (PARTITION BY grp, w, lf) AS cl,
               count(*) OVER (PARTITION BY grp, w, rt) AS cr FROM occ) o
  GROUP BY grp, w HAVING count(*) >= 2)"""

SHARED = """shared AS MATERIALIZED (
  SELECT grp, w, n_occ, n_traces FROM profile WHERE n_witness = n_occ AND n_traces >= 2 AND len(w) >= 3)"""

PATTERNS = """patterns AS (
  SELECT row_number() OVER (ORDER BY grp, len(w) DESC, array_to_string(w, ' ')) AS pattern_id, *
  FROM shared)"""

SCORES = """scores AS (
  SELECT q.grp, q.trace_id, p.pattern_id, max(k) AS score
  FROM (SELECT pattern_id, unnest(range(1, len(w) + 1)) AS k, w FROM patterns) p,
       (SELECT DISTINCT grp, trace_id, len(w) AS l, array_to_string(w, ' ') AS t FROM occ WHERE len(w) <= (SELECT max(len(w)) FROM patterns)) q
  WHERE q.l = k AND q.t = array_to_string(p.w[1:k], ' ')
  GROUP BY ALL)"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


EVENTS_SQL = with_(TOK, DICT)
SEQ_SQL = with_(TOK, DICT, SEQ, PLACES)
OCC_SQL = with_(TOK, DICT, SEQ, PLACES, OCC)
PROFILE_SQL = with_(TOK, DICT, SEQ, PLACES, OCC, PROFILE)
SHARED_SQL = with_(TOK, DICT, SEQ, PLACES, OCC, PROFILE, SHARED)
PATTERNS_SQL = with_(TOK, DICT, SEQ, PLACES, OCC, PROFILE, SHARED, PATTERNS)
SCORES_SQL = with_(TOK, DICT, SEQ, PLACES, OCC, PROFILE, SHARED, PATTERNS, SCORES)


def words_sql(name: str, table: str, key: str, grp: str) -> str:
    """CTE with the words of a text column."""
    return (
        f"{name}_w AS (SELECT {grp} AS grp, {key} AS trace_id, "
        f"string_split_regex(text, '[ \\t\\n\\f\\r]+') AS w FROM {table}),\n"
        f"{name}_r AS (SELECT grp, trace_id, unnest(w) AS sym, generate_subscripts(w, 1) AS k FROM {name}_w),\n"
        f"{name} AS (SELECT grp, trace_id, sym, "
        f"row_number() OVER (PARTITION BY trace_id ORDER BY k) - 1 AS pos FROM {name}_r WHERE sym <> '')"
    )
