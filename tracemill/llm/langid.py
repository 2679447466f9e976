"""Language identification by a convolutional network over bytes (operator 6).

A text is lower-cased, ASCII characters that are no letters become spaces, and its UTF-8 bytes are
cut into windows of fixed length that overlap by the widest filter. A byte embedding, filters of
several widths, maximum pooling over the window and a softmax layer give a distribution for each
window; the text's distribution is the mean over all its windows, weighted by their bytes. The
network is trained in numpy on the driver from a bounded sample of labelled rows and travels to the
tasks as a constant of about 50 kB.

Defined cases: a NULL text or one without a letter is ``und`` with score 0. Rows with a NULL id are
predicted, never learned from, and not held out. Without any labelled row everything is ``und``.
Repeated rows are predicted alike; ties go to the language that sorts first. Other columns are
ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.llm.common import map_blocks, text_function
from tracemill.session import durable

UND = "und"
WINDOW = 256
WIDTHS = (2, 3, 4)
DIM = 8
FILTERS = 16
PAD = max(WIDTHS) - 1

# Bound on what is learned from: so many texts of each language, so many windows of each text.
TRAIN_TEXTS = 1500
TRAIN_WINDOWS = 4

_LETTER = re.compile(r"[^\W\d_]")
_TO_SPACE = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def to_bytes(text: str) -> np.ndarray:
    """The bytes the network sees."""
    raw = text.lower().encode("utf-8", "replace").translate(_TO_SPACE)
    return np.frombuffer(raw, np.uint8)


def windows(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a text, padded with spaces, and the bytes each of them adds."""
    n = max(1, -(-len(data) // WINDOW))
    padded = np.full(n * WINDOW + PAD, 32, np.uint8)
    padded[: len(data)] = data
    cut = np.lib.stride_tricks.sliding_window_view(padded, WINDOW + PAD)[::WINDOW]
    sizes = np.full(n, WINDOW, np.float64)
    sizes[-1] = max(1, len(data) - (n - 1) * WINDOW)
    return cut, sizes


@dataclass
class ByteNet:
    """Parameters of the network; filters of all widths are columns of one matrix."""

    langs: list[str]
    embed: np.ndarray = field(default=None)
    filters: np.ndarray = field(default=None)
    bias: np.ndarray = field(default=None)
    out: np.ndarray = field(default=None)
    out_bias: np.ndarray = field(default=None)

    def init(self, seed: int) -> ByteNet:
        rng = np.random.default_rng(seed)
        n = FILTERS * len(WIDTHS)
        self.embed = rng.normal(0, 0.5, (256, DIM)).astype(np.float32)
        self.filters = (rng.normal(0, 0.3, ((PAD + 1) * DIM, n)) * self.mask()).astype(np.float32)
        self.bias = np.zeros(n, np.float32)
        self.out = rng.normal(0, 0.1, (n, len(self.langs))).astype(np.float32)
        self.out_bias = np.zeros(len(self.langs), np.float32)
        return self

    @staticmethod
    def mask() -> np.ndarray:
        """Rows of the filter matrix that a filter of each width uses."""
        wide = np.repeat(WIDTHS, FILTERS)
        return (np.arange((PAD + 1) * DIM)[:, None] < wide[None, :] * DIM).astype(np.float32)

    def pooled(self, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximum of each filter over each window, where it is, and the patches."""
        x = self.embed[cut].reshape(len(cut), -1)
        patches = np.lib.stride_tricks.sliding_window_view(x, (PAD + 1) * DIM, axis=1)[:, ::DIM]
        patches = np.ascontiguousarray(patches)
        score = (patches.reshape(-1, patches.shape[2]) @ self.filters).reshape(len(cut), WINDOW, -1)
        at = score.argmax(axis=1)
        return np.take_along_axis(score, at[:, None, :], 1)[:, 0], at, patches

    def logits(self, cut: np.ndarray) -> np.ndarray:
        """For many windows; a few at a time, so that the scores stay in the cache.

        Patches that start at every fourth byte lie side by side in memory: four products without
        overlapping copies, joined by halving maxima.
        """
        wide, step = (PAD + 1) * DIM, WINDOW // (PAD + 1)
        top = np.empty((len(cut), len(self.bias)), np.float32)
        for i in range(0, len(cut), 16):
            part = cut[i : i + 16]
            x = np.take(self.embed, part.ravel(), axis=0).reshape(len(part), -1)
            best = None
            for phase in range(PAD + 1):
                shifted = np.ascontiguousarray(x[:, phase * DIM : phase * DIM + step * wide])
                score = (shifted.reshape(-1, wide) @ self.filters).reshape(len(part), step, -1)
                best = score if best is None else np.maximum(best, score, out=best)
            while best.shape[1] > 1:
                half = best.shape[1] // 2
                best = np.maximum(best[:, :half], best[:, half:])
            top[i : i + 16] = best[:, 0]
        return np.maximum(top + self.bias, 0) @ self.out + self.out_bias

    def distribution(self, cut: np.ndarray) -> np.ndarray:
        z = self.logits(cut).astype(np.float64)
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def train(cut: np.ndarray, labels: np.ndarray, langs: list[str], seed: int = 7, epochs: int = 3, batch: int = 64, rate: float = 4e-3) -> ByteNet:
    """Cross-entropy by Adam over shuffled batches of windows."""
    net = ByteNet(langs).init(seed)
    names = ("embed", "filters", "bias", "out", "out_bias")
    first = {k: np.zeros_like(getattr(net, k)) for k in names}
    second = {k: np.zeros_like(getattr(net, k)) for k in names}
    mask, rng, step = net.mask(), np.random.default_rng(seed + 1), 0
    rows = np.arange(PAD + 1)
    for _ in range(epochs):
        order = rng.permutation(len(cut))
        for i in range(0, len(order), batch):
            pick = order[i : i + batch]
            x, y = cut[pick], labels[pick]
            top, at, patches = net.pooled(x)
            hidden = np.maximum(top + net.bias, 0)
            z = hidden @ net.out + net.out_bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(pick)), y] -= 1
            dz = p / len(pick)
            dh = (dz @ net.out.T) * (hidden > 0)
            won = patches[np.arange(len(pick))[:, None], at]  # window, filter, patch
            grad = {
                "out": hidden.T @ dz,
                "out_bias": dz.sum(axis=0),
                "bias": dh.sum(axis=0),
                "filters": np.einsum("bf,bfp->pf", dh, won) * mask,
                "embed": np.zeros_like(net.embed),
            }
            back = (dh[:, :, None] * net.filters.T[None]).reshape(len(pick), len(net.bias), PAD + 1, DIM)
            seen = x[np.arange(len(pick))[:, None, None], at[:, :, None] + rows]
            np.add.at(grad["embed"], seen.ravel(), back.reshape(-1, DIM))
            step += 1
            for k in names:
                g = grad[k]
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                change = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                setattr(net, k, (getattr(net, k) - rate * change).astype(np.float32))
    return net


def _sample_windows(texts: list, seeds: list) -> list[list[bytes]]:
    out = []
    for text, seed in zip(texts, seeds):
        if not has_letter(text):
            out.append([])
            continue
        cut, _ = windows(to_bytes(text))
        pick = np.random.default_rng(abs(seed)).permutation(len(cut))[:TRAIN_WINDOWS]
        out.append([cut[i].tobytes() for i in sorted(pick)])
    return out


# Hashes are cut into 2^14 slices, in each of which few rows of the wanted ones lie.
SLICE_BITS = 14


def fit(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", key: str = "doc_id", texts: int = TRAIN_TEXTS, seed: int = 7) -> ByteNet | None:
    """Learns from at most ``texts`` rows of each language among the rows where ``learn`` holds.

    The rows are those with the smallest hash of their id. None if no row can be learned from.
    """
    known = (
        docs.where(learn & F.col(lang).isNotNull() & F.col(key).isNotNull())
        .groupBy(F.col(key).alias("__key"))
        .agg(F.min(F.col(lang).cast("string")).alias("__lang"))
        .withColumn("__hash", F.xxhash64("__key", F.lit(seed)))
    )
    # The smallest hashes of a language lie in its first slices: whole slices are taken as long as they
    # are needed, so that only rows about as many as wanted are ranked.
    known = durable(known.withColumn("__slice", F.shiftright("__hash", 64 - SLICE_BITS)))
    sizes = known.groupBy("__lang", "__slice").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy("__lang").orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    needed = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).where(F.col("__before") < texts)
    ranked = (
        known.join(needed.select("__lang", "__slice"), ["__lang", "__slice"])
        .withColumn("__rank", F.row_number().over(W.partitionBy("__lang").orderBy("__hash", "__key")))
        .where(F.col("__rank") <= texts)
        .drop("__rank", "__slice")
    )
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).join(F.broadcast(ranked), "__key")

    def cut(batches):
        import pyarrow as pa

        for b in batches:
            found = _sample_windows(b.column("__text").to_pylist(), b.column("__hash").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column("__lang"), b.column("__hash"), pa.array(found, pa.list_(pa.binary()))], names=["lang", "hash", "cut"]
            )

    got = rows.mapInArrow(cut, "lang string, hash long, cut array<binary>").dropDuplicates(["hash"]).toArrow().sort_by("hash")
    langs = sorted({v for v, c in zip(got["lang"].to_pylist(), got["cut"].to_pylist()) if c})
    if not langs:
        return None
    data, labels = [], []
    for v, c in zip(got["lang"].to_pylist(), got["cut"].to_pylist()):
        data += c
        labels += [langs.index(v)] * len(c)
    cut_rows = np.frombuffer(b"".join(data), np.uint8).reshape(len(data), WINDOW + PAD)
    # A small sample is gone through more often.
    epochs = int(np.clip(60_000 / max(1, len(data)), 3, 40))
    return train(cut_rows, np.array(labels), langs, seed, epochs)


def predict_texts(net: ByteNet | None, texts: list) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    langs, scores = [UND] * len(texts), [0.0] * len(texts)
    if net is None:
        return langs, scores
    cuts, sizes, owner = [], [], []
    for i, text in enumerate(texts):
        if has_letter(text):
            c, n = windows(to_bytes(text))
            cuts.append(c)
            sizes.append(n)
            owner.append(np.full(len(c), i))
    if not cuts:
        return langs, scores
    sizes, owner = np.concatenate(sizes), np.concatenate(owner)
    p = np.concatenate([net.distribution(np.concatenate(cuts[i : i + 64])) for i in range(0, len(cuts), 64)]) * sizes[:, None]
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    mean = np.add.reduceat(p, starts) / np.add.reduceat(sizes, starts)[:, None]
    best = mean.argmax(axis=1)
    for i, b, m in zip(owner[starts], best, mean):
        langs[i], scores[i] = net.langs[b], float(min(1.0, m[b]))
    return langs, scores


SCHEMA = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def predicted(net: ByteNet | None, text: Column) -> Column:
    """The same as a struct column of each row's text."""

    def start():
        def work(texts):
            langs, scores = predict_texts(net, texts)
            return {"lang_pred": langs, "score": scores}

        return work

    return text_function(SCHEMA, start)(text)


def predict(docs: DataFrame, net: ByteNet | None, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` with ``lang_pred`` and ``score`` of every row's whole text."""

    def start():
        def work(texts):
            langs, scores = predict_texts(net, texts)
            return {"lang_pred": langs, "score": scores}

        return work

    return map_blocks(docs, keys, text, SCHEMA, start)
