"""The corpus operators on the given tables: one query ``opN_<name>`` each, with SQL where it can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import bpe, fim, html, langid, lm, mixing, pieces, quality, simhash, topk, vectors, warc, whiten
from tracemill.llm.common import in_fold, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
KEEP_QUALITY = 0.7


def tokens_estimate(text: str) -> F.Column:
    """Whitespace-separated words of a text: the token count that mixing budgets with."""
    words = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[^ \t\n\u000b\f\r]+", "x")
    return (F.length(words) - F.length(F.replace(words, F.lit("x"), F.lit("")))).cast("long")


# Domains of the sources, and the weights of the mixture. Unlisted names weigh 1.
DOMAINS = {"web": ["src0", "src1", "src2", "src3"], "books": ["src4", "src5", "src6", "src7"], "code": ["src8", "src9"]}
WEIGHTS = {"domain": {"web": 40.0, "books": 30.0, "code": 10.0, "other": 20.0}, "lang": {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0}}
MAX_EPOCHS, MIX_SEED = 4, 17


def mixing_tree(docs: DataFrame, *carry: str) -> DataFrame:
    """The documents with their place in the tree and their token count, and the columns of ``carry``."""
    domain = F.lit("other")
    for name, sources in DOMAINS.items():
        domain = F.when(F.col("source").isin(sources), name).otherwise(domain)
    levels = {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}
    return mixing.name_levels(docs.select("doc_id", "lang", "source", *carry, tokens_estimate("text").alias("n_tokens")), levels)


@query(
    "op1_topk",
    """WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 10""",
)
def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk.quantise(table(spark, sf_dir, "embeddings"))
    return topk.top_k(found, F.col("id") % 100 == 0, 10)


@query("op2_warc")
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive(table(spark, sf_dir, "pages"), min_bytes=0)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _case(column: str, given: dict[str, float]) -> str:
    whens = " ".join(f"WHEN {column} = '{k}' THEN {v}" for k, v in given.items())
    return f"CASE {whens} ELSE 1.0 END::DOUBLE" if given else "1.0::DOUBLE"


def _share_sql(source: str, path: list[str], deeper: list[str]) -> str:
    """CTEs that share each parent's budget among the nodes of one level; ends with ``<level>_budget``."""
    level, keys = path[-1], ", ".join(path)
    parent = f"PARTITION BY {', '.join(path[:-1])}" if path[:-1] else ""
    before = f"OVER ({parent} ORDER BY fill, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    usable = " AND ".join([f"w_{c} > 0" for c in deeper]) or "true"
    n = level
    return f"""{n}_1 AS (
  SELECT {keys}, sum(CASE WHEN {usable} THEN tokens * {MAX_EPOCHS} ELSE 0 END)::BIGINT AS cap, max(w_{level}) AS w, max(budget)::BIGINT AS parent
  FROM {source} GROUP BY {keys}),
{n}_2 AS (SELECT *, CASE WHEN w > 0 AND cap > 0 THEN w ELSE 0.0 END AS live, CASE WHEN w > 0 AND cap > 0 THEN cap / w ELSE 0.0 END AS fill FROM {n}_1),
{n}_3 AS (
  SELECT *, coalesce(sum(CASE WHEN live > 0 THEN cap ELSE 0 END) {before}, 0)::BIGINT AS used,
    sum(live) OVER ({parent}) - coalesce(sum(live) {before}, 0.0) AS weight_left FROM {n}_2),
{n}_4 AS (SELECT *, greatest(parent - used, 0) / weight_left AS lv FROM {n}_3),
{n}_5 AS (
  SELECT *, first_value(CASE WHEN live > 0 AND fill > lv THEN lv END IGNORE NULLS) OVER ({parent} ORDER BY fill, {level} ROWS UNBOUNDED PRECEDING) AS lvl FROM {n}_4),
{n}_6 AS (SELECT *, CASE WHEN live <= 0 THEN 0.0 WHEN lvl IS NULL THEN cap::DOUBLE ELSE least(lvl * live, cap::DOUBLE) END AS exact FROM {n}_5),
{n}_7 AS (
  SELECT *, floor(exact)::BIGINT AS fl, live > 0 AND floor(exact)::BIGINT < cap AS can,
    least(greatest(parent, 0), sum(CASE WHEN live > 0 THEN cap ELSE 0 END) OVER ({parent})) - sum(floor(exact)::BIGINT) OVER ({parent}) AS missing FROM {n}_6),
{n}_8 AS (SELECT *, row_number() OVER ({parent} ORDER BY can DESC, exact - fl DESC, {level}) AS place FROM {n}_7),
{n}_budget AS (
  SELECT s.* EXCLUDE (budget), (n.fl + CASE WHEN n.can AND n.place <= n.missing THEN 1 ELSE 0 END)::BIGINT AS budget
  FROM {source} s JOIN {n}_8 n USING ({keys}))"""


_MIX_SQL = f"""WITH docs AS MATERIALIZED (
  SELECT doc_id, CASE {' '.join(f"WHEN source IN ({', '.join(repr(x) for x in v)}) THEN '{k}'" for k, v in DOMAINS.items())} ELSE 'other' END AS domain,
    coalesce(lang, '(null)') AS lang, coalesce(source, '(null)') AS source,
    len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0b\\f\\r]+')) AS n_tokens FROM documents),
leaves AS (
  SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, {_case('domain', WEIGHTS['domain'])} AS w_domain, {_case('lang', WEIGHTS['lang'])} AS w_lang,
    1.0::DOUBLE AS w_source, (SELECT sum(n_tokens)::BIGINT FROM docs) AS budget FROM docs GROUP BY domain, lang, source),
{_share_sql('leaves', ['domain'], ['lang', 'source'])},
{_share_sql('domain_budget', ['domain', 'lang'], ['source'])},
{_share_sql('lang_budget', ['domain', 'lang', 'source'], [])},
plan AS (SELECT domain, lang, source, tokens, budget, ceil(budget / tokens)::BIGINT AS epochs FROM source_budget WHERE budget > 0),
entries AS (SELECT d.*, p.tokens, p.budget, unnest(range(p.epochs)) AS epoch FROM docs d JOIN plan p USING (domain, lang, source)),
counted AS (
  SELECT *, (epoch * tokens + coalesce(sum(n_tokens) OVER (
    PARTITION BY domain, lang, source, epoch ORDER BY md5('{MIX_SEED}:' || epoch || ':' || doc_id), doc_id, n_tokens
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start FROM entries)
SELECT doc_id, domain, lang, source, epoch, start, n_tokens, least(n_tokens, budget - start) AS take_tokens FROM counted WHERE start < budget"""


@query("op3_mixing", _MIX_SQL)
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source gives to the mixture: documents, epochs and tokens taken."""
    return mixing.mix(mixing_tree(table(spark, sf_dir, "documents")), WEIGHTS, None, MAX_EPOCHS, MIX_SEED)


@query("op4_quality")
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = quality.fit(docs, table(spark, sf_dir, "labels"), ~in_fold("doc_id", 4, 2))
    return quality.score(docs, machine, ["doc_id"]).select(
        "doc_id", in_fold("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= KEEP_QUALITY).cast("int").alias("predicted")
    )


@query("op5_simhash")
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op6_language")
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = langid.fit(docs, ~in_fold("doc_id", 4, 2))
    return langid.predict(docs, net, ["doc_id"]).select("doc_id", in_fold("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


@query("op7_html")
def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query(
    "op8_embeddings",
    """WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
comp AS (SELECT x, least(x, min(y)) AS c FROM reach GROUP BY x)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.x = e.vec_id) AS n_links, coalesce(c.c, e.vec_id) AS component_id,
  e.vec_id = coalesce(c.c, e.vec_id) AS kept
FROM embeddings e LEFT JOIN comp c ON c.x = e.vec_id""",
)
def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op9_bpe")
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), ["doc_id"], VOCABULARY, public_tokenizers.PATTERN)


@query("op10_lm")
def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = lm.fit(docs, F.col("doc_id").isNotNull() & ~in_fold("doc_id", 10, 0))
    return lm.score(docs, model, ["doc_id"]).select(
        "doc_id", in_fold("doc_id", 10, 0).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score", "score",
    )


@query("op11_whiten")
def op11_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deviation that no long holds is NULL; ``deviation_exact`` has it."""
    found = whiten.whiten(table(spark, sf_dir, "embeddings"))
    long = F.col("deviation").try_cast("long")
    return found.select("vec_id", "component", "n", long.alias("deviation"), "whitened", "explained", "identity_error", F.col("deviation").alias("deviation_exact"))


@query(
    "op12_fim",
    """WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS toks FROM documents),
c AS (
  SELECT doc_id, text, toks, len(toks) AS n, ('0x' || h[1:8])::BIGINT % (len(toks) + 1) AS r1, ('0x' || h[9:16])::BIGINT % (len(toks) + 1) AS r2,
    ('0x' || h[17:24])::BIGINT % 100 AS r3, ('0x' || h[25:32])::BIGINT % 100 AS r4 FROM d),
f AS (
  SELECT doc_id, text, n,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r3 >= 50 THEN 'plain'
      WHEN r4 < 80 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(toks[1:least(r1, r2)], '') AS p, array_to_string(toks[least(r1, r2) + 1:greatest(r1, r2)], '') AS m,
    array_to_string(toks[greatest(r1, r2) + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM f""",
)
def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
        digest(fim.restore("output", "form")).alias("restored_sha256"),
    )


@query("op13_pieces")
def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_digests(table(spark, sf_dir, "documents"), ["doc_id"], PIECES)
