"""Interpolated modified Kneser-Ney bigram model, counted in Spark (operator 10).

Tokens are the words of a text, A-Z lower-cased, then one end token; the context of the first token is
a start mark, which is never predicted. Words are known by a 64-bit hash. Counting:

1. every task counts the bigrams of its texts and deals them out in sorted arrays to the cells of a
   grid over (context, word), so that a context that a third of all tokens follow is cut as well;
2. every cell adds up its bigrams and writes them as a sorted array of hashes with their counts; it
   returns what it knows of each context (tokens, bigrams seen once, twice, more often) and how many
   contexts each word follows;
3. these are added up by word range and written as sorted arrays too.

Only the numbers that the discounts need come to the driver. Workers map the arrays into memory and
look up the sorted distinct bigrams of a block of texts by binary search, so the model is never
loaded and no task sees more than its own texts.

With counts ``c``, discounts ``D`` by count (1, 2, 3 and more), ``N1+`` numbers of distinct neighbours,
``V`` distinct training tokens: ``p(w|v) = max(c(vw) - D, 0) / c(v) + gamma(v) p(w)``,
``p(w) = max(N1+(.w) - D', 0) / N1+(..) + gamma' / (V + 1)``; an unseen context leaves ``p(w)``.

Defined cases: a NULL or blank text is its end token. Rows with a NULL id are scored, never learned
from and not held out. Without training texts every probability is 1. Repeated rows are counted and
scored as often as they occur.
"""

from __future__ import annotations

import math
import os
import tempfile
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.llm.common import map_blocks, open_folder, shared_path, text_blocks

# Word hashes of the marks; a word that hashed to one of them would be taken for it.
END, START = np.uint64(1), np.uint64(2)
# Bigrams a task collects before it deals them out, and bytes of text to aim at in a cell.
DEAL = 2_500_000
CELL_BYTES = 24_000_000
CACHE = 250_000


class Words:
    """Hashes of words, kept between texts."""

    def __init__(self) -> None:
        self.seen: dict[bytes, int] = {}

    def tokens(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the tokens of all texts one after the other, and the number of each text's."""
        if len(self.seen) > CACHE:
            self.seen.clear()
        seen, digest, parts, sizes = self.seen, xxhash.xxh64_intdigest, [], []
        for text in texts:
            words = (text or "").encode("utf-8", "replace").lower().split()
            found = list(map(seen.get, words))
            if None in found:
                for w, h in zip(words, found):
                    if h is None:
                        seen[w] = digest(w)
                found = list(map(seen.get, words))
            found.append(1)
            parts.append(np.array(found, np.uint64))
            sizes.append(len(found))
        return np.concatenate(parts) if parts else np.empty(0, np.uint64), np.array(sizes, np.int64)


def contexts(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The token before each token; the start mark before the first one of a text."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.cumsum(sizes) - sizes] = START
    return before


def mix(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a bigram."""
    h = (context * np.uint64(0x9E3779B97F4A7C15)) ^ (word + np.uint64(0x7F4A7C159E3779B9))
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def range_edges(parts: int) -> np.ndarray:
    """Hashes at which the parts 1, 2, ... begin."""
    if parts == 1:
        return np.empty(0, np.uint64)
    return np.arange(1, parts, dtype=np.uint64) * np.uint64(2**64 // parts)


def runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys in sorted arrays."""
    if not len(keys[0]):
        return np.empty(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def add_up(context: np.ndarray, word: np.ndarray, count: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct bigrams, sorted by context and word, with their counts (1 each if not given)."""
    order = np.lexsort((word, context))
    context, word = context[order], word[order]
    at = runs(context, word)
    total = np.diff(np.r_[at, len(context)]) if count is None else np.add.reduceat(count[order], at) if len(at) else count
    return context[at], word[at], total


@dataclass(frozen=True)
class Grid:
    """Cells by the first bits of the context's hash and the first bits of the word's."""

    context_bits: int
    word_bits: int

    @classmethod
    def of(cls, cells: int) -> Grid:
        bits = max(0, math.ceil(math.log2(max(1, cells))))
        return cls(bits - bits // 4, bits // 4)

    def cell(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        spread = np.uint64(0x9E3779B97F4A7C15)  # the marks are small numbers
        high = lambda x, bits: ((x * spread) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(x), np.int64)
        return (high(context, self.context_bits) << self.word_bits) + high(word, self.word_bits)


# --- Small files of sorted arrays ----------------------------------------------------------


def write_arrays(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """One file per array, written under a name of its own and renamed; a second try replaces it."""
    fs, path = open_folder(folder)
    fs.create_dir(path, recursive=True)
    for kind, values in arrays.items():
        temporary = f"{path}/.{name}.{kind}.{os.getpid()}.{xxhash.xxh64_hexdigest(os.urandom(8))}"
        with fs.open_output_stream(temporary) as out:
            out.write(memoryview(np.ascontiguousarray(values)).cast("B") if len(values) else b"")
        fs.move(temporary, f"{path}/{name}.{kind}")


def map_array(folder: str, file: str, kind: str) -> np.ndarray:
    """Maps a file; one that is not on a local path is copied to the worker's own folder first."""
    fs, path = open_folder(folder)
    local = f"{path}/{file}"
    if not os.path.exists(local):
        cache = f"{tempfile.gettempdir()}/{xxhash.xxh64_hexdigest(folder)}"
        local = f"{cache}/{file}"
        if not os.path.exists(local):
            os.makedirs(cache, exist_ok=True)
            part = f"{local}.{os.getpid()}"
            with fs.open_input_stream(f"{path}/{file}") as src, open(part, "wb") as out:
                while chunk := src.read(1 << 22):
                    out.write(chunk)
            os.replace(part, local)
    if os.path.getsize(local) == 0:
        return np.empty(0, kind)
    return np.memmap(local, kind, "r")


# --- Counting ------------------------------------------------------------------------------


def _deal(grid: Grid):
    """Map side: texts to rows (cell, arrays of distinct contexts, run lengths, words, counts)."""

    def rows(context, word):
        context, word, count = add_up(context, word)
        cell = grid.cell(context, word)
        order = np.argsort(cell, kind="stable")
        context, word, count, cell = context[order], word[order], count[order], cell[order]
        starts = runs(cell)
        for a, b in zip(starts, [*starts[1:], len(cell)]):
            at = runs(context[a:b])
            lengths = np.diff(np.r_[at, b - a]).astype(np.uint32)
            yield int(cell[a]), context[a:b][at].tobytes(), lengths.tobytes(), word[a:b].tobytes(), np.minimum(count[a:b], 2**32 - 1).astype(np.uint32).tobytes()

    def batch(found):
        columns = list(zip(*found))
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int64())] + [pa.array(c, pa.binary()) for c in columns[1:]], names=["cell", "contexts", "lengths", "words", "counts"]
        )

    def run(batches):
        words, held, n = Words(), [], 0
        for b in batches:
            for block in text_blocks(b, "__text"):
                tokens, sizes = words.tokens(block.column("__text").to_pylist())
                held.append((contexts(tokens, sizes), tokens))
                n += len(tokens)
                if n >= DEAL:
                    yield batch(rows(*[np.concatenate(x) for x in zip(*held)]))
                    held, n = [], 0
        if n:
            yield batch(rows(*[np.concatenate(x) for x in zip(*held)]))

    return run


def _unpack(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    context, word, count = [], [], []
    for c, n, w, k in zip(*[rows[name].to_pylist() for name in ("contexts", "lengths", "words", "counts")]):
        context.append(np.repeat(np.frombuffer(c, np.uint64), np.frombuffer(n, np.uint32)))
        word.append(np.frombuffer(w, np.uint64))
        count.append(np.frombuffer(k, np.uint32).astype(np.int64))
    return np.concatenate(context), np.concatenate(word), np.concatenate(count)


_CELL = "part long, kind string, keys binary, v0 binary, v1 binary, v2 binary, v3 binary, n0 long, n1 long, n2 long, n3 long"


def _count_cell(folder: str, word_parts: int):
    """Reduce side: one cell's bigrams to a file, and rows of its context and word statistics."""

    def run(rows):
        cell = rows["cell"][0].as_py()
        context, word, count = add_up(*_unpack(rows))
        key = mix(context, word)
        order = np.argsort(key)
        small = np.minimum(count[order], 255).astype(np.uint8)
        large = np.flatnonzero(count[order] >= 255)
        write_arrays(folder, f"bigram-{cell:08d}", {"key": key[order], "count": small, "large_at": large, "large": count[order][large]})
        of_counts = np.bincount(np.minimum(count, 5), minlength=6)[1:5].tolist()
        at = runs(context)
        per = lambda flag: np.add.reduceat(flag.astype(np.uint32), at, dtype=np.uint32)
        out = [dict(part=-1, kind="total", keys=None, v=[None] * 4, n=of_counts)]
        stats = [np.add.reduceat(count, at).astype(np.uint32), per(count == 1), per(count == 2), per(count > 2)]
        out += _by_part("context", context[at], stats, word_parts)
        word = np.sort(word)
        at = runs(word)
        out += _by_part("word", word[at], [np.diff(np.r_[at, len(word)]).astype(np.uint32)], word_parts)
        return _cell_table(out)

    return run


def _by_part(kind: str, keys: np.ndarray, values: list[np.ndarray], parts: int) -> list[dict]:
    """Rows of sorted keys, cut by key range."""
    edges = np.searchsorted(keys, range_edges(parts))
    out = []
    for i, (a, b) in enumerate(zip([0, *edges], [*edges, len(keys)])):
        if b > a:
            out.append(dict(part=i, kind=kind, keys=keys[a:b].tobytes(), v=[v[a:b].tobytes() for v in values] + [None] * (4 - len(values)), n=[0] * 4))
    return out


def _cell_table(rows: list[dict]) -> pa.Table:
    data = {k: pa.array([r[k] for r in rows], t) for k, t in (("part", pa.int64()), ("kind", pa.string()), ("keys", pa.binary()))}
    data |= {f"v{i}": pa.array([r["v"][i] for r in rows], pa.binary()) for i in range(4)}
    data |= {f"n{i}": pa.array([r["n"][i] for r in rows], pa.int64()) for i in range(4)}
    return pa.table(data)


def _sum_by_key(rows: pa.Table, values: int) -> tuple[np.ndarray, list[np.ndarray]]:
    if not rows.num_rows:
        return np.empty(0, np.uint64), [np.empty(0, np.int64)] * values
    keys = np.concatenate([np.frombuffer(k, np.uint64) for k in rows["keys"].to_pylist()])
    order = np.argsort(keys)
    keys, out = keys[order], []
    at = runs(keys)
    for i in range(values):
        v = np.concatenate([np.frombuffer(x, np.uint32) for x in rows[f"v{i}"].to_pylist()])[order]
        out.append(np.add.reduceat(v, at, dtype=np.int64))
    return keys[at], out


def _count_part(folder: str):
    """One range of words: statistics as context and as word, to files."""

    def run(rows):
        part = rows["part"][0].as_py()
        kinds = np.array(rows["kind"].to_pylist())
        keys, (total, once, twice, more) = _sum_by_key(rows.filter(pa.array(kinds == "context")), 4)
        write_arrays(folder, f"context-{part:08d}", {"key": keys, "total": total, "once": once.astype(np.uint32), "twice": twice.astype(np.uint32), "more": more.astype(np.uint32)})
        keys, (follows,) = _sum_by_key(rows.filter(pa.array(kinds == "word")), 1)
        write_arrays(folder, f"word-{part:08d}", {"key": keys, "follows": follows})
        of = np.bincount(np.minimum(follows, 5), minlength=6)[1:5].tolist()
        return pa.table({"words": [len(keys)], "follows": [int(follows.sum())], **{f"n{i}": [of[i]] for i in range(4)}})

    return run


@dataclass
class Model:
    """Where the arrays are, and the numbers that belong to no key."""

    folder: str
    context_bits: int
    word_bits: int
    parts: int
    tokens: int = 0  # N
    words: int = 0  # V
    ends: int = 0
    bigrams: int = 0
    discounts: list[float] = field(default_factory=lambda: [0.0] * 3)
    word_discounts: list[float] = field(default_factory=lambda: [0.0] * 3)
    word_counts: list[int] = field(default_factory=lambda: [0] * 3)  # words that follow 1, 2, more contexts


def discounts(n: list[int]) -> list[float]:
    """The three discounts from the numbers of counts 1 to 4; 0.75, or the count if less, where they do not exist."""
    if min(n) <= 0:
        return [0.75] * 3
    y = n[0] / (n[0] + 2 * n[1])
    return [min(k, max(0.0, k - (k + 1) * y * n[k] / n[k - 1])) for k in (1, 2, 3)]


def fit(docs: DataFrame, learn: Column, text: str = "text", cells: int | None = None) -> Model:
    """Counts the texts where ``learn`` holds and writes the model into the shared folder."""
    spark = docs.sparkSession
    chosen = docs.where(learn).select(F.col(text).cast("string").alias("__text"))
    size = chosen.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.coalesce("__text", F.lit("")))), ).head()
    grid = Grid.of(cells or -(-(size[1] or 0) // CELL_BYTES))
    parts = 1 << max(0, grid.context_bits - 1)
    model = Model(shared_path(spark, "ngrams"), grid.context_bits, grid.word_bits, parts)
    if not size[0]:
        return model
    dealt = chosen.mapInArrow(_deal(grid), "cell long, contexts binary, lengths binary, words binary, counts binary")
    counted = dealt.groupBy("cell").applyInArrow(_count_cell(model.folder, parts), _CELL)
    stored = f"{model.folder}-cells"
    counted.write.parquet(stored)
    counted = spark.read.parquet(stored)
    n = counted.where("part = -1").agg(*[F.sum(f"n{i}") for i in range(4)]).head()
    words = counted.where("part >= 0").drop("n0", "n1", "n2", "n3").groupBy("part").applyInArrow(
        _count_part(model.folder), "words long, follows long, n0 long, n1 long, n2 long, n3 long"
    )
    w = words.agg(*[F.sum(c) for c in ("words", "follows", "n0", "n1", "n2", "n3")]).head()
    model.words, model.bigrams, model.ends = w[0], w[1], size[0]
    model.discounts, model.word_discounts = discounts(list(n)), discounts(list(w[2:]))
    model.word_counts = [w[2], w[3], w[0] - w[2] - w[3]]
    # Every token but the ends is the context of the next one; texts start with the start mark.
    totals = spark.range(parts).mapInArrow(_context_totals(model), "total long").agg(F.sum("total")).head()[0]
    model.tokens = totals
    return model


def _context_totals(model: Model):
    def run(batches):
        store = Store(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([int(store.context(p)["total"].sum()) for p in b.column("id").to_pylist()], pa.int64())], names=["total"])

    return run


# --- Scoring -------------------------------------------------------------------------------


class Store:
    """The mapped arrays of a model."""

    def __init__(self, model: Model) -> None:
        self.model, self.maps = model, {}

    def _file(self, name: str, kinds: dict[str, str]) -> dict[str, np.ndarray]:
        if name not in self.maps:
            try:
                self.maps[name] = {k: map_array(self.model.folder, f"{name}.{k}", t) for k, t in kinds.items()}
            except FileNotFoundError:  # no key fell into this range
                self.maps[name] = {k: np.empty(0, t) for k, t in kinds.items()}
        return self.maps[name]

    def bigram(self, cell: int):
        return self._file(f"bigram-{cell:08d}", {"key": "u8", "count": "u1", "large_at": "i8", "large": "i8"})

    def context(self, part: int):
        return self._file(f"context-{part:08d}", {"key": "u8", "total": "i8", "once": "u4", "twice": "u4", "more": "u4"})

    def word(self, part: int):
        return self._file(f"word-{part:08d}", {"key": "u8", "follows": "i8"})

    @staticmethod
    def look_up(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of keys that are there: (indices into ``keys``, indices into ``sorted_keys``)."""
        at = np.searchsorted(sorted_keys, keys)
        at[at == len(sorted_keys)] = 0
        hit = np.flatnonzero(sorted_keys[at] == keys) if len(sorted_keys) else np.empty(0, np.int64)
        return hit, at[hit]

    def by_part(self, keys: np.ndarray):
        """Ranges of sorted keys that lie in each part."""
        parts = self.model.parts
        edges = np.searchsorted(keys, range_edges(parts))
        return [(p, a, b) for p, (a, b) in enumerate(zip([0, *edges], [*edges, len(keys)])) if b > a]

    def words(self, keys: np.ndarray) -> dict[str, np.ndarray]:
        """For sorted distinct word hashes: statistics as context and as word."""
        out = {k: np.zeros(len(keys), np.int64) for k in ("total", "once", "twice", "more", "follows")}
        for part, a, b in self.by_part(keys):
            for table, names in ((self.context(part), ("total", "once", "twice", "more")), (self.word(part), ("follows",))):
                hit, at = self.look_up(table["key"], keys[a:b])
                for name in names:
                    out[name][a + hit] = table[name][at]
        return out

    def bigrams(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Counts of bigrams."""
        grid = Grid(self.model.context_bits, self.model.word_bits)
        cell, key, out = grid.cell(context, word), mix(context, word), np.zeros(len(word), np.int64)
        order = np.lexsort((key, cell))
        starts = runs(cell[order])
        for a, b in zip(starts, [*starts[1:], len(order)]):
            here = order[a:b]
            table = self.bigram(int(cell[here[0]]))
            hit, at = self.look_up(table["key"], key[here])
            found = table["count"][at].astype(np.int64)
            if len(table["large_at"]):
                big = np.flatnonzero(found == 255)
                found[big] = table["large"][np.searchsorted(table["large_at"], at[big])]
            out[here[hit]] = found
        return out


def score_tokens(store: Store, tokens: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
    """Per text: tokens, known tokens, base score and model score (log10)."""
    m = store.model
    starts = np.cumsum(sizes) - sizes
    before = contexts(tokens, sizes)
    words, place = np.unique(np.concatenate([tokens, [START]]), return_inverse=True)
    found = store.words(words)
    start_at, end_at = np.searchsorted(words, START), np.searchsorted(words, END)
    count = found["total"].copy()  # a word occurs as often as it is a context
    count[start_at] = 0
    if end_at < len(words) and words[end_at] == END:
        count[end_at] = m.ends
    w, v = place[: len(tokens)], np.empty(len(tokens), np.int64)
    v[1:] = w[:-1]
    v[starts] = start_at
    base = np.log10((count + 0.1) / (m.tokens + 0.1 * (m.words + 1)))
    if not m.tokens:
        return dict(n=sizes, known=np.zeros(len(sizes), np.int64), base=np.zeros(len(sizes)), score=np.zeros(len(sizes)))
    d = np.array([0.0, *m.word_discounts])
    follows = found["follows"]
    spare = sum(a * b for a, b in zip(m.word_discounts, m.word_counts)) / m.bigrams
    single = np.maximum(follows - d[np.minimum(follows, 3)], 0) / m.bigrams + spare / (m.words + 1)
    if spare == 0:  # no discount can be estimated away entirely: keep unseen words possible
        single = np.maximum(single, 1.0 / (m.bigrams + m.words + 1) * 1e-3)
    total = found["total"].astype(np.float64)
    d = np.array([0.0, *m.discounts])
    gamma = np.ones(len(words))
    seen = total > 0
    gamma[seen] = (d[1] * found["once"] + d[2] * found["twice"] + d[3] * found["more"])[seen] / total[seen]
    pair = v * np.int64(len(words)) + w
    distinct, back = np.unique(pair, return_inverse=True)
    dv, dw = distinct // len(words), distinct % len(words)
    c = store.bigrams(words[dv], words[dw])
    high = np.divide(np.maximum(c - d[np.minimum(c, 3)], 0), total[dv], out=np.zeros(len(c)), where=seen[dv])
    log_p = np.log10(np.maximum(high + gamma[dv] * single[dw], 1e-300))[back]
    return dict(
        n=sizes, known=np.add.reduceat((count > 0)[w].astype(np.int64), starts),
        base=np.add.reduceat(base[w], starts), score=np.add.reduceat(log_p, starts),
    )


SCHEMA = T.StructType(
    [T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())]
)


def score(docs: DataFrame, model: Model, keys: list[str], text: str = "text") -> DataFrame:
    """``keys, n_tokens, n_known, base_score, score, perplexity`` of every row's whole text."""

    def start():
        store, words = Store(model), Words()

        def work(texts):
            tokens, sizes = words.tokens(texts)
            found = score_tokens(store, tokens, sizes)
            return {"n_tokens": found["n"], "n_known": found["known"], "base_score": found["base"], "score": found["score"]}

        return work

    scored = map_blocks(docs, keys, text, SCHEMA, start, 10_000_000)
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
