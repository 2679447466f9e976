"""Fill-in-the-middle rewriting of texts with a learned rank index (operator 12).

A text is a run of tokens: white space and the word after it, or the white space at the end. Prefix
and middle end at two hashed ranks among the ``n + 1`` token boundaries. The offsets of all boundaries
of a block of texts are kept as line segments with whole-number arithmetic, fitted so that no offset is
off by more than a byte can hold, and a residual of one byte for each: ``RankIndex``. A cut is predicted
by its segment's line and corrected by its residual, which is exact.

Segments are fitted from the whole text downwards: those that miss the bound are halved, all at once,
until none does; a segment of one token always fits.

Defined cases: a NULL text is empty. Empty texts and texts that hold a marker stay plain. Rows with a
NULL id are hashed as if it had no digits; rows that repeat an id are cut by the same hashes. Texts of
any length are cut whole. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.llm.common import text_blocks

MARKS = ("<P>", "<S>", "<M>")
SEED = 42
RATE, SPM_RATE = 50, 80
# A residual fits into a signed byte.
BOUND = 127
# Bytes of text in one index.
BLOCK = 2_000_000


def boundaries(text: str) -> np.ndarray:
    """Offsets, in code points, of the token boundaries: 0 and each token's end."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    space = (points == 32) | ((points >= 9) & (points <= 13))
    after = np.r_[space[1:], True]
    ends = np.flatnonzero(~space & after) + 1
    tail = [len(points)] if len(points) and space[-1] else []
    return np.concatenate([[0], ends, tail]).astype(np.int64)


class RankIndex:
    """Offsets of several rising runs as segments ``(first, last, base, rise)`` and one-byte residuals."""

    def __init__(self, runs: list[np.ndarray], bound: int = BOUND) -> None:
        sizes = np.array([len(r) for r in runs], np.int64)
        offsets = np.concatenate(runs) if runs else np.empty(0, np.int64)
        self.begin = np.r_[0, np.cumsum(sizes)]
        self.residual = np.zeros(len(offsets), np.int8)
        # Segments share their end points; a run of one boundary is a segment of its own.
        first, last = self.begin[:-1], np.maximum(self.begin[1:] - 1, self.begin[:-1])
        done = []
        while len(first):
            counts = last - first + 1
            at = np.repeat(first - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())
            owner = np.repeat(np.arange(len(first)), counts)
            base, rise = offsets[first], offsets[last] - offsets[first]
            missed = offsets[at] - self._line(at, first[owner], last[owner], base[owner], rise[owner])
            worst = np.maximum.reduceat(np.abs(missed), np.r_[0, np.cumsum(counts)[:-1]])
            fits = worst <= bound
            inside = fits[owner]
            self.residual[at[inside]] = missed[inside]
            done.append((first[fits], last[fits], base[fits], rise[fits]))
            first, last = first[~fits], last[~fits]
            middle = (first + last) // 2
            first, last = np.r_[first, middle], np.r_[middle, last]
        columns = [np.concatenate(c) for c in zip(*done)] if done else [np.empty(0, np.int64)] * 4
        order = np.argsort(columns[0], kind="stable")
        self.first, self.last, self.base, self.rise = (c[order] for c in columns)

    @staticmethod
    def _line(at, first, last, base, rise):
        return base + (at - first) * rise // np.maximum(last - first, 1)

    def cut(self, run: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The exact offset of each rank in its run."""
        at = self.begin[run] + rank
        k = np.searchsorted(self.first, at, side="right") - 1
        return self._line(at, self.first[k], self.last[k], self.base[k], self.rise[k]) + self.residual[at]


def hashes(key, seed: int = SEED) -> list[int]:
    """Four unsigned 32-bit numbers of an id."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def rewrite(keys: list, texts: list[str], seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> dict[str, list]:
    """Tokens, form, output and the lengths of prefix and middle of each text."""
    index = RankIndex([boundaries(t) for t in texts])
    n = np.diff(index.begin) - 1
    h = np.array([hashes(k, seed) for k in keys], np.int64).reshape(len(keys), 4)
    ranks = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    rows = np.arange(len(texts))
    ends = zip(index.cut(rows, ranks[:, 0]).tolist(), index.cut(rows, ranks[:, 1]).tolist())
    out: dict[str, list] = {"n": n.tolist(), "form": [], "prefix_chars": [], "middle_chars": [], "output": []}
    p, s, m = MARKS
    for text, (a, b), (h3, h4) in zip(texts, ends, h[:, 2:].tolist()):
        plain = not text or any(mark in text for mark in MARKS) or h3 % 100 >= rate
        form = "plain" if plain else "spm" if h4 % 100 < spm_rate else "psm"
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        out["form"].append(form)
        out["prefix_chars"].append(None if plain else a)
        out["middle_chars"].append(None if plain else b - a)
        out["output"].append(text if plain else f"{s}{suffix}{p}{prefix}{m}{middle}" if form == "spm" else f"{p}{prefix}{s}{suffix}{m}{middle}")
    return out


def fill_in_middle(
    df: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE
) -> DataFrame:
    """``key, n, form, prefix_chars, middle_chars, output`` of every row's whole text."""
    source = df.select(F.col(key).alias("__key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    kinds = {"n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.string()}
    long, string = T.LongType(), T.StringType()
    schema = T.StructType(
        [T.StructField(key, df.schema[key].dataType)]
        + [T.StructField(k, string if v == pa.string() else long) for k, v in kinds.items()]
    )

    def run(batches):
        for batch in batches:
            for block in text_blocks(batch, "__text", BLOCK):
                found = rewrite(block.column("__key").to_pylist(), block.column("__text").to_pylist(), seed, rate, spm_rate)
                arrays = [pa.array(found[k], v) for k, v in kinds.items()]
                yield pa.RecordBatch.from_arrays([block.column("__key"), *arrays], names=[key, *kinds])

    return source.mapInArrow(run, schema)


def restore(output: str = "output", form: str = "form") -> Column:
    """The text that an output of that form was made from: its parts between the markers, put back in order."""
    part = F.split(output, "<[PSM]>", -1)
    psm = F.concat(F.element_at(part, 2), F.element_at(part, 4), F.element_at(part, 3))
    spm = F.concat(F.element_at(part, 3), F.element_at(part, 4), F.element_at(part, 2))
    return F.when(F.col(form) == "plain", F.col(output)).when(F.col(form) == "psm", psm).otherwise(spm)
