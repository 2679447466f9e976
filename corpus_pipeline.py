"""From raw documents to token ids: language, quality, near-duplicates, mixture, encoding.

Defined cases, for every stage: an empty table gives an empty one. Rows are told apart by their place in
the stored table, never by their id: rows with a NULL or repeated id are documents of their own. Every
stage but the last returns all columns that it got, extra ones too, whatever their names.

* language: where no language can be learned, none is rejected. Texts without a letter are (NULL and
  empty ones too); a NULL ``lang`` is filled in.
* quality: where nothing can be learned (no labelled id among the documents), nothing is rejected.
* near_duplicates: of texts that are linked, directly or through others, the row with the smallest id
  stays (rows without an id come last; of equal ids that with the smallest hash of its text, then the
  first row). NULL and blank texts are copies of each other.
* mixing: NULLs in a level of the tree are a node of their own; a document is repeated for each epoch
  that reads it.
* encoding: a NULL text has no tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import bpe, langid, mixing, overlap, quality, queries, simhash
from tracemill.llm.common import free_name, in_fold, shared_path, table, with_row_key

# A language is accepted with this probability or more; with four languages a guess has 0.25.
LEAST_LANGUAGE_SCORE = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognised language; a missing language is filled in."""
    net = langid.fit(docs, ~in_fold("doc_id", 4, 2))
    if net is None:
        return docs
    found = free_name(docs, "__found")
    rows = docs.withColumn(found, langid.predicted(net, F.col("text").cast("string")))
    kept = rows.where((F.col(f"{found}.lang_pred") != langid.UND) & (F.col(f"{found}.score") >= LEAST_LANGUAGE_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", f"{found}.lang_pred")).select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier scores below the threshold."""
    machine = quality.fit(docs, table(spark, sf_dir, "labels"), ~in_fold("doc_id", 4, 2))
    if machine is None:
        return docs
    found = free_name(docs, "__found")
    rows = docs.withColumn(found, quality.scored(machine, F.col("text").cast("string"), F.col("n_chars").cast("long")))
    return rows.where(F.col(f"{found}.score") >= queries.KEEP_QUALITY).drop(found)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates.

    Texts are linked whose SimHash fingerprints differ in two bits at most, as in operator 5, and those whose 5-word
    shingles agree to 0.8, which two bits do not reach.
    """
    row = free_name(docs, "__row")
    rows = with_row_key(docs, row)
    kept = overlap.near_duplicates(rows, row=row, prints_linked=simhash.fingerprint_links)
    return rows.join(kept.select(row), row, "left_semi").drop(row)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the mixture reads, once for each epoch in which it does."""
    row = free_name(docs, "__row")
    rows = with_row_key(docs, row)
    taken = mixing.mix(queries.mixing_tree(rows, row), queries.WEIGHTS, None, carry=[row]).select(row)
    return rows.join(taken, row).drop(row)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document of the mixture."""
    return bpe.encode_digests(docs, ["doc_id"], queries.VOCABULARY, public_tokenizers.PATTERN, keep=False)


STAGES = [
    ("language", identify_language),
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("encoding", encode),
]

# Learned models and a tokenizer: not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
