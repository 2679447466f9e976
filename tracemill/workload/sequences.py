"""Queries: ingest, dictionary, sampling and substrings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions.calls import (
    ascii_only,
    attributes,
    feed_lines,
    line_stats,
    mark_bad_lines,
    parse_call,
    replace_undecodable,
    stop_at_first_bad,
    symbol_or_empty,
    symbol_or_na,
    symbol_or_null,
)
from tracemill.functions.labels import label_anywhere, label_from_prefix
from tracemill.operators import dictionary, sampling, substrings
from tracemill.operators.blocks import as_text
from tracemill.operators.ordering import number_rows
from tracemill.session import durable
from tracemill.sources.tables import encoded_blocks
from tracemill.sources.traces import parse_lines
from tracemill.workload.registry import query
from tracemill.workload.tables import (
    EVENTS_SQL,
    OCC_SQL,
    TOK,
    coded_events,
    document_words,
    event_tokens,
    load,
    with_,
    word_tokens,
    words_sql,
)


@query("trace_tokens", with_(TOK) + "SELECT trace_id, pos, sym FROM tok")
def trace_tokens(spark, d):
    """JSON call lines, written from the events, parsed back to calls."""
    lines = event_tokens(spark, d).select(
        "trace_id", "pos", F.to_json(F.struct(F.col("sym").alias("FunctionName"))).alias("line")
    )
    return parse_lines(lines).select("trace_id", "pos", "sym")


@query(
    "encode_traces",
    EVENTS_SQL
    + """SELECT trace_id, pos // 1024 AS block, string_agg(sym_id::VARCHAR, ' ' ORDER BY pos) AS ids
FROM tok JOIN dict USING (sym) GROUP BY ALL""",
)
def encode_traces(spark, d):
    return encoded_blocks(coded_events(spark, d)).select("trace_id", "block", as_text("ids").alias("ids"))


def call_lines(spark, d):
    """Call records with the different spellings of the name key, built from the events."""
    e = load(spark, d, "events").select("event_id", "event_type", "value", "props")
    key = F.element_at(
        F.array(*[F.lit(k) for k in ("FunctionName", "Functionname", "functionName", "function_name", "name", "other")]),
        (F.col("event_id") % 6 + 1).cast("int"),
    )
    name = F.when(F.col("event_id") % 7 == 0, F.lit("")).otherwise(F.col("event_type"))
    line = F.concat(
        F.lit('{"'), key, F.lit('": "'), name, F.lit('", "Address": "0x'), F.hex("event_id"),
        F.lit('", "Return": '), F.get_json_object("props", "$.k"), F.lit("}"),
    )
    return e.select("event_id", line.alias("line"))


_LINES_SQL = """WITH lines AS (
  SELECT event_id, '{"' || (['FunctionName', 'Functionname', 'functionName', 'function_name', 'name', 'other'])[event_id % 6 + 1]
    || '": "' || CASE WHEN event_id % 7 = 0 THEN '' ELSE event_type END || '", "Address": "0x' || hex(event_id)
    || '", "Return": ' || json_extract_string(props, '$.k') || '}' AS line
  FROM events)
"""


@query(
    "symbol_extract",
    _LINES_SQL
    + """SELECT event_id,
  coalesce(line->>'$.FunctionName', line->>'$.Functionname', '') AS kept,
  coalesce(nullif(line->>'$.FunctionName', ''), nullif(line->>'$.Functionname', '')) AS dropped,
  coalesce(line->>'$.FunctionName', line->>'$.Functionname', line->>'$.functionName', line->>'$.function_name', line->>'$.name', 'N/A') AS feed,
  line->>'$.Address' AS address, line->>'$.Timesptamp' AS "timestamp", line->>'$.Return' AS "result"
FROM lines""",
)
def symbol_extract(spark, d):
    records = call_lines(spark, d).withColumn("record", parse_call("line"))
    return records.select(
        "event_id",
        symbol_or_empty("record").alias("kept"),
        symbol_or_null("record").alias("dropped"),
        symbol_or_na("record").alias("feed"),
        *attributes("record"),
    )


@query(
    "ascii_clean",
    """SELECT doc_id, length(c)::BIGINT AS n_ascii, length(text)::BIGINT AS n_all, md5(c) AS digest, true AS valid
FROM (SELECT doc_id, text, regexp_replace(text, '[^\\x00-\\x7F]', '', 'g') AS c FROM documents) t""",
)
def ascii_clean(spark, d):
    clean = load(spark, d, "documents").select("doc_id", "text", ascii_only("text").alias("c"))
    return clean.select(
        "doc_id",
        F.length("c").alias("n_ascii"),
        F.length("text").alias("n_all"),
        F.md5("c").alias("digest"),
        (replace_undecodable(F.encode("text", "UTF-8")) == F.col("text")).alias("valid"),
    )


def damaged_lines(spark, d):
    """Property records of the events; some are cut short and some are no objects."""
    e = load(spark, d, "events").select("event_id", "user_id", "ts", "props")
    line = (
        F.when(F.col("event_id") % 97 == 0, F.expr("left(props, length(props) - 1)"))
        .when(F.col("event_id") % 89 == 0, F.lit("[1]"))
        .when(F.col("event_id") % 83 == 0, F.lit(" "))
        .otherwise(F.col("props"))
    )
    lines = e.select(F.col("user_id").alias("trace_id"), "ts", "event_id", line.alias("line"))
    return number_rows(lines, ["trace_id"], F.date_trunc("day", "ts"), ["ts", "event_id"])


_DAMAGED_SQL = """WITH lines AS (
  SELECT user_id AS trace_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
    CASE WHEN event_id % 97 = 0 THEN left(props, length(props) - 1) WHEN event_id % 89 = 0 THEN '[1]'
         WHEN event_id % 83 = 0 THEN ' ' ELSE props END AS line
  FROM events),
marked AS (
  SELECT trace_id, pos, CASE WHEN json_valid(line) THEN json_type(line) <> 'OBJECT' ELSE true END AS bad
  FROM lines WHERE trim(line) <> ''),
stopped AS (
  SELECT *, min(CASE WHEN bad THEN pos END) OVER (PARTITION BY trace_id) AS first_bad FROM marked)
"""


@query(
    "bad_line_stats",
    _DAMAGED_SQL
    + """SELECT trace_id, count(*) FILTER (WHERE NOT bad) AS n_good, count(*) FILTER (WHERE bad) AS n_bad,
  count(*) FILTER (WHERE first_bad IS NULL OR pos < first_bad) AS n_kept
FROM stopped GROUP BY trace_id""",
)
def bad_line_stats(spark, d):
    marked = mark_bad_lines(damaged_lines(spark, d))
    return line_stats(marked).select("trace_id", "n_good", "n_bad", "n_kept")


def named_files(spark, d):
    """File names built from the pages: a class-like word, the page number and the URL."""
    words = ("UPX", "my_telock", "petite", "molebox", "mew", "amber", "bero", "yoda", "notepad", "calc")
    word = F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("page_id") % 10 + 1).cast("int"))
    joint = F.when(F.col("page_id") % 3 == 0, "-").otherwise("_")
    return load(spark, d, "pages").select("page_id", F.concat(word, joint, F.col("page_id").cast("string"), F.lit("_"), "url").alias("name"))


@query(
    "label_from_name",
    """WITH files AS (
  SELECT page_id, (['UPX', 'my_telock', 'petite', 'molebox', 'mew', 'amber', 'bero', 'yoda', 'notepad', 'calc'])[page_id % 10 + 1]
    || CASE WHEN page_id % 3 = 0 THEN '-' ELSE '_' END || page_id || '_' || url AS name FROM pages),
parts AS (SELECT *, lower(split_part(replace(name, '-', '_'), '_', 1)) AS p FROM files)
SELECT page_id, name,
  coalesce(nullif(regexp_extract(lower(name), '(upx|telock|petite|molebox|mew|amber|bero|yoda)', 1), ''), 'unpacked') AS anywhere,
  CASE WHEN p IN ('upx', 'mew', 'molebox', 'telock', 'petite', 'amber', 'yoda') THEN p ELSE 'unpacked' END AS as_prefix
FROM parts""",
)
def label_from_name(spark, d):
    return named_files(spark, d).select(
        "page_id", "name", label_anywhere("name").alias("anywhere"), label_from_prefix("name").alias("as_prefix")
    )


@query(
    "event_stream",
    with_(TOK)
    + """SELECT trace_id, pos, 'e(' || sym || ')' AS line FROM tok
UNION ALL SELECT trace_id, count(*) AS pos, 'end' AS line FROM tok GROUP BY trace_id""",
)
def event_stream(spark, d):
    tokens = event_tokens(spark, d)
    return feed_lines(tokens, substrings.trace_lengths(tokens))


@query("symbol_dictionary", EVENTS_SQL + "SELECT sym, sym_id FROM dict")
def symbol_dictionary(spark, d):
    return dictionary.build_dictionary(event_tokens(spark, d))


@query(
    "word_dictionary",
    "WITH " + words_sql("tok", "documents", "doc_id", "lang")
    + " SELECT sym, row_number() OVER (ORDER BY sym) AS sym_id FROM (SELECT DISTINCT sym FROM tok) t",
)
def word_dictionary(spark, d):
    """A large vocabulary: every word of the documents."""
    return dictionary.build_dictionary(document_words(spark, d))


def base_dictionary(spark, d):
    return dictionary.build_dictionary(word_tokens(spark, d, "benchmark", "item_id", F.lit(0)))


_BASE_SQL = "WITH " + words_sql("b", "benchmark", "item_id", "0") + ",\n" + words_sql("tok", "documents", "doc_id", "lang") + """,
base AS (SELECT sym, row_number() OVER (ORDER BY sym) AS sym_id FROM (SELECT DISTINCT sym FROM b) t)
"""


@query(
    "dictionary_extend",
    _BASE_SQL
    + """SELECT sym, sym_id FROM base UNION ALL
SELECT sym, (SELECT max(sym_id) FROM base) + row_number() OVER (ORDER BY t, p) AS sym_id
FROM (SELECT sym, min(trace_id) AS t, arg_min(pos, (trace_id, pos)) AS p FROM tok
      WHERE sym NOT IN (SELECT sym FROM base) GROUP BY sym) f""",
)
def dictionary_extend(spark, d):
    return dictionary.extend_dictionary(base_dictionary(spark, d), document_words(spark, d))


@query(
    "encode_unknown",
    _BASE_SQL
    + """SELECT trace_id AS doc_id, coalesce(sym_id, -1) AS sym_id, count(*) AS n, sum(pos)::BIGINT AS pos_sum
FROM tok LEFT JOIN base USING (sym) GROUP BY ALL""",
)
def encode_unknown(spark, d):
    """Document words in the benchmark's dictionary, summed per document and id."""
    coded = dictionary.encode(document_words(spark, d), base_dictionary(spark, d), unknown="mark")
    return coded.groupBy(F.col("trace_id").alias("doc_id"), "sym_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("pos").alias("pos_sum")
    )


@query(
    "count_singletons",
    "WITH " + words_sql("tok", "documents", "doc_id", "lang")
    + """ SELECT grp, count(*) FILTER (WHERE n = 1) AS n_singletons, count(*) AS n_symbols
FROM (SELECT grp, sym, count(*) AS n FROM tok GROUP BY ALL) t GROUP BY grp""",
)
def count_singletons(spark, d):
    return dictionary.count_singletons(document_words(spark, d), ["grp"])


def trace_files(spark, d):
    """File names grouped by the host of a page."""
    host = F.regexp_extract("url", "//([^/]+)", 1)
    return load(spark, d, "pages").select(F.concat(host, F.lit("_"), F.col("page_id").cast("string"), F.lit(".json")).alias("name"))


_FILES_SQL = """WITH files AS (
  SELECT regexp_extract(url, '//([^/]+)', 1) || '_' || page_id || '.json' AS name FROM pages),
prefixed AS (SELECT name, split_part(name, '_', 1) AS p FROM files),
grouped AS (
  SELECT name, CASE WHEN count(*) OVER (PARTITION BY p) = 1 THEN 'ungrouped' ELSE p END AS grp FROM prefixed),
ranked AS (
  SELECT name, grp, count(*) OVER (PARTITION BY grp) AS n,
         row_number() OVER (PARTITION BY grp ORDER BY md5('42|' || name), name) AS rn FROM grouped)
"""


@query("prefix_groups", _FILES_SQL + "SELECT name, grp FROM grouped")
def prefix_groups(spark, d):
    return sampling.prefix_groups(trace_files(spark, d)).select("name", "grp")


@query(
    "stratified_split",
    _FILES_SQL + "SELECT name, grp, CASE WHEN rn <= greatest(1, floor(n * 0.5)) THEN 'train' ELSE 'test' END AS split FROM ranked",
)
def stratified_split(spark, d):
    return sampling.stratified_split(sampling.prefix_groups(trace_files(spark, d))).select("name", "grp", "split")


@query(
    "split_sizes",
    _FILES_SQL
    + """SELECT split, count(*) AS n FROM (
  SELECT CASE WHEN rn <= greatest(1, floor(n * 0.5)) THEN 'train' ELSE 'test' END AS split FROM ranked) s GROUP BY split""",
)
def split_sizes(spark, d):
    return sampling.split_sizes(sampling.stratified_split(sampling.prefix_groups(trace_files(spark, d))))


@query("group_sample", _FILES_SQL + "SELECT name, grp FROM ranked WHERE n > 2 AND rn <= 5")
def group_sample(spark, d):
    return sampling.group_sample(sampling.prefix_groups(trace_files(spark, d))).select("name", "grp")


_OFFSETS_SQL = """sizes AS (SELECT grp, trace_id, count(*) AS n FROM tok GROUP BY ALL),
offsets AS (
  SELECT grp, trace_id, n,
    (coalesce(sum(n + 1) OVER (PARTITION BY grp ORDER BY trace_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS first
  FROM sizes)"""


def event_offsets(spark, d):
    lengths = substrings.trace_lengths(event_tokens(spark, d))
    return substrings.concat_offsets(lengths, F.floor(F.col("trace_id") / 1024))


@query("concat_offsets", with_(TOK, _OFFSETS_SQL) + "SELECT grp, trace_id, n, first, first + n AS separator FROM offsets")
def concat_offsets(spark, d):
    return event_offsets(spark, d)


@query(
    "position_to_trace",
    with_(TOK, _OFFSETS_SQL)
    + """SELECT e.event_id, e.grp, e.at, o.trace_id, e.at - o.first AS pos
FROM (SELECT event_id, user_id % 5 AS grp, event_id // 5 AS at FROM events) e
JOIN offsets o ON o.grp = e.grp AND e.at >= o.first AND e.at < o.first + o.n""",
)
def position_to_trace(spark, d):
    """Looks up one global position of its group per event."""
    wanted = load(spark, d, "events").select(
        "event_id", (F.col("user_id") % 5).alias("grp"), F.floor(F.col("event_id") / 5).alias("at")
    )
    return substrings.position_to_trace(wanted, event_offsets(spark, d))


@query(
    "ngrams",
    OCC_SQL
    + """SELECT grp, array_to_string(w, ' ') AS gram, count(*) AS n_occ, count(DISTINCT trace_id) AS n_traces
FROM occ WHERE len(w) BETWEEN 2 AND 5 GROUP BY grp, w""",
)
def ngrams(spark, d):
    counted = substrings.ngrams(coded_events(spark, d), 2, 5)
    return counted.select("grp", as_text("gram").alias("gram"), "n_occ", "n_traces")


@query(
    "substring_lookup",
    "WITH " + words_sql("q", "benchmark", "item_id", "0") + ",\n" + words_sql("tok", "documents", "doc_id", "lang") + """,
hits AS (
  SELECT q.trace_id AS item_id, tok.trace_id AS doc_id, tok.pos - q.pos AS diag, q.pos AS k
  FROM q JOIN tok USING (sym)
  SEMI JOIN (SELECT a.trace_id AS item_id, b.trace_id AS doc_id, b.pos AS diag
             FROM q a JOIN tok b ON a.sym = b.sym WHERE a.pos = 0) f
    ON f.item_id = q.trace_id AND f.doc_id = tok.trace_id AND f.diag = tok.pos - q.pos),
runs AS (
  SELECT item_id, k + 1 AS n, row_number() OVER (PARTITION BY item_id, doc_id, diag ORDER BY k) AS rn FROM hits)
SELECT items.trace_id AS item_id, coalesce(max(n), 0) AS found_len
FROM (SELECT DISTINCT trace_id FROM q) items LEFT JOIN (SELECT * FROM runs WHERE rn = n) r ON r.item_id = items.trace_id
GROUP BY items.trace_id""",
)
def substring_lookup(spark, d):
    """How much of each benchmark item, from its first word on, occurs in some document."""
    known = durable(base_dictionary(spark, d))
    items = dictionary.encode(word_tokens(spark, d, "benchmark", "item_id", F.lit(0)), known)
    # An item is one short text: its words form one array.
    gram = F.sort_array(F.collect_list(F.struct("pos", "sym_id")))
    queries = items.groupBy(F.col("trace_id").alias("pattern_id")).agg(gram.alias("g")).select(
        "pattern_id", F.col("g.sym_id").alias("gram")
    )
    # Words that no item has match nothing and share one id.
    coded = dictionary.encode(document_words(spark, d), known, unknown="mark")
    found = substrings.substring_lookup(durable(queries), coded)
    return found.select(F.col("pattern_id").alias("item_id"), "found_len")
