"""Quality classifier: a factorisation machine over words, structure and metadata (operator 4).

Features of a text are its lower-cased words, hashed to buckets and weighted by ``log(1 + count)``
with unit length, and a vector of structure statistics and metadata. The score is the logistic of
``w0 + w.x + 1/2 * sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)``, which takes one pass over the
non-zero features. It is fitted in numpy on the driver from a bounded sample of labelled rows; label,
language, source and id are never features.

Defined cases: NULL texts score as empty ones. Without a labelled row every score is 0.5. Rows with
a NULL id are scored, never learned from. A label above 0 counts as good; of repeated labels of an id
the larger counts. Other columns are ignored.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from dataclasses import dataclass
from itertools import islice
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.llm.common import text_function

BUCKETS = 1 << 17
FACTORS = 6
# Bound on the labelled rows that are learned from.
TRAIN_ROWS = 4000

_UPPER = string.ascii_uppercase.encode()
_DIGIT = string.digits.encode()
_SPACE = b" \t\n\r\v\f"
_STOPS = b".,;:!?'\"()-"
_MARKS = b"".join(bytes([c]) for c in range(33, 127) if not chr(c).isalnum() and c not in _STOPS)

STATS = (
    "n_bytes", "n_words", "word_length", "upper", "digits", "stops", "marks", "other", "lines", "recurring",
    "top_word", "repeated", "shouted", "n_chars", "no_n_chars",
)


def describe(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets and weights of the words of a text, and its statistics, each about 0 to 3."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.lower().split()
    counts = Counter(words)
    n, m = len(raw), len(words)
    share = lambda chars: (n - len(raw.translate(None, chars))) / max(1, n)
    upper = share(_UPPER)
    stats = np.array(
        [
            math.log1p(n) / 20, math.log1p(m) / 16, min(3.0, n / max(1, m) / 6 - 1), 4 * upper, 4 * share(_DIGIT),
            4 * share(_STOPS), 4 * share(_MARKS), share(bytes(range(128))) - 1, min(3.0, 40 * raw.count(b"\n") / max(1, n)),
            1 - len(counts) / max(1, m), max(0, max(counts.values(), default=0) - 1) / max(1, m),
            sum(map(eq, words, islice(words, 1, None))) / max(1, m),
            float(upper > 0.3), 0.0 if n_chars is None else math.log1p(max(0, n_chars)) / 20, float(n_chars is None),
        ],
        np.float32,
    )
    buckets = np.fromiter(map(crc32, counts), np.int64, len(counts)) & (BUCKETS - 1)
    weights = np.log1p(np.fromiter(counts.values(), np.float32, len(counts)))
    return buckets.astype(np.int32), weights / max(1e-6, float(np.linalg.norm(weights))), stats


@dataclass
class Machine:
    """Rows of ``table`` are the linear weight and the factors of a bucket, then of a statistic."""

    bias: float
    table: np.ndarray

    def score(self, rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
        """Probability of a good text for each described row."""
        stats = np.arange(BUCKETS, BUCKETS + len(STATS))
        out = np.empty(len(rows))
        for i, (buckets, weights, values) in enumerate(rows):
            index, x = np.concatenate([buckets, stats]), np.concatenate([weights, values])
            part = self.table[index] * x[:, None]
            both = part[:, 1:].sum(axis=0, dtype=np.float64)
            squares = float((part[:, 1:].astype(np.float64) ** 2).sum())
            out[i] = self.bias + float(part[:, 0].sum(dtype=np.float64)) + 0.5 * (float(both @ both) - squares)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def train(rows: list, good: np.ndarray, seed: int = 5, epochs: int = 12, rate: float = 0.05, decay: float = 2e-3) -> Machine:
    """Logistic loss by AdaGrad over shuffled batches; words are held back more than statistics."""
    rng = np.random.default_rng(seed)
    width = BUCKETS + len(STATS)
    table = np.zeros((width, 1 + FACTORS), np.float32)
    table[:, 1:] = rng.normal(0, 0.02, (width, FACTORS))
    squares = np.full(table.shape, 1e-2, np.float32)
    hold = np.full((width, 1), decay, np.float32)
    hold[BUCKETS:] = 1e-5
    bias, bias_squares = 0.0, 1e-2
    stats = np.arange(BUCKETS, width)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 64):
            pick = order[at : at + 64]
            index = np.concatenate([np.concatenate([rows[i][0], stats]) for i in pick])
            x = np.concatenate([np.concatenate([rows[i][1], rows[i][2]]) for i in pick])[:, None]
            sizes = np.array([len(rows[i][0]) + len(stats) for i in pick])
            begin = np.r_[0, np.cumsum(sizes)[:-1]]
            owner = np.repeat(np.arange(len(pick)), sizes)
            w = table[index]
            part = w * x
            sums = np.add.reduceat(part, begin)
            both = sums[:, 1:]
            z = bias + sums[:, 0] + 0.5 * ((both**2).sum(axis=1) - np.add.reduceat((part[:, 1:] ** 2).sum(axis=1), begin))
            miss = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - good[pick]) / len(pick)
            g = np.empty_like(w)
            g[:, :1] = x
            g[:, 1:] = x * (both[owner] - part[:, 1:])
            g = g * miss[owner][:, None]
            order_by = np.argsort(index, kind="stable")
            run = index[order_by]
            starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
            seen, total = run[starts], np.add.reduceat(g[order_by], starts)
            total += hold[seen] * table[seen]
            squares[seen] += total**2
            table[seen] -= rate * total / np.sqrt(squares[seen])
            step = float(miss.sum())
            bias_squares += step**2
            bias -= rate * step / math.sqrt(bias_squares)
    return Machine(bias, table)


def fit(
    docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", label: str = "quality",
    n_chars: str = "n_chars", limit: int = TRAIN_ROWS, seed: int = 5,
) -> Machine | None:
    """Learns from at most ``limit`` labelled rows where ``learn`` (of the id) holds.

    They are the ones with the smallest hash of their id. None if there is none.
    """
    known = (
        labels.where(learn & F.col(key).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(key).alias("__key"))
        .agg(F.max((F.col(label) > 0).cast("int")).alias("__good"))
    )
    ids = docs.select(F.col(key).alias("__key")).where(F.col("__key").isNotNull()).distinct()
    chosen = (
        known.join(ids, "__key", "left_semi")
        .withColumn("__hash", F.xxhash64("__key", F.lit(seed)))
        .orderBy("__hash", "__key")
        .limit(limit)
    )
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"), F.col(n_chars).cast("long").alias("__n"))
    rows = rows.join(F.broadcast(chosen), "__key")

    def features(batches):
        for b in batches:
            found = [describe(t, n) for t, n in zip(b.column("__text").to_pylist(), b.column("__n").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column("__hash"), b.column("__good")] + [pa.array([f[k].tobytes() for f in found], pa.binary()) for k in range(3)],
                names=["hash", "good", "buckets", "weights", "stats"],
            )

    schema = "hash long, good int, buckets binary, weights binary, stats binary"
    got = rows.mapInArrow(features, schema).dropDuplicates(["hash"]).toArrow().sort_by("hash")
    if not got.num_rows:
        return None
    described = [
        (np.frombuffer(b, np.int32), np.frombuffer(w, np.float32), np.frombuffer(s, np.float32))
        for b, w, s in zip(*[got[c].to_pylist() for c in ("buckets", "weights", "stats")])
    ]
    epochs = int(np.clip(32_000 / len(described), 8, 60))
    return train(described, got["good"].to_numpy().astype(np.float64), seed, epochs)


SCHEMA = T.StructType([T.StructField("score", T.DoubleType())])


def score(docs: DataFrame, machine: Machine | None, keys: list[str], text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``keys`` with the ``score`` of every row's whole text, 0 to 1.

    The table of the machine (a few megabytes, fixed by ``BUCKETS`` and ``FACTORS``) is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    schema = T.StructType([docs.schema[k] for k in keys] + list(SCHEMA))
    source = docs.select(*keys, F.col(text).alias("__text"), F.col(n_chars).cast("long").alias("__n"))

    def run(batches):
        model = shared.value
        for b in batches:
            values = []
            for t, n in zip(b.column("__text"), b.column("__n").to_pylist()):
                values.append(0.5 if model is None else float(model.score([describe(t.as_py(), n)])[0]))
            yield pa.RecordBatch.from_arrays([b.column(k) for k in keys] + [pa.array(values, pa.float64())], names=[*keys, "score"])

    return source.mapInArrow(run, schema)


def scored(machine: Machine | None, text: Column, n_chars: Column) -> Column:
    """The same as a struct column with the ``score`` of each row's text."""
    shared = SparkSession.active().sparkContext.broadcast(machine)

    def start():
        model = shared.value

        def work(texts, sizes):
            return {"score": [0.5 if model is None else float(model.score([describe(t, n)])[0]) for t, n in zip(texts, sizes)]}

        return work

    return text_function(SCHEMA, start)(text, n_chars)
