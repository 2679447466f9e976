"""Near-duplicate texts by the exact similarity of their word shingles.

Two texts are linked if the Jaccard similarity of their sets of word shingles is at least 0.8. No link
is missed: of two such sets, the first ``n - ceil(0.8 n) + 1`` shingles of each, in any order that is
the same for all texts, have one in common (``n``: shingles of the set). The order puts shingles that
are frequent in a sample last, so that common lines and passages rarely bring texts together.

Texts with equal sets are one class. Up to ``FEW`` classes that share a prefix shingle are paired; shingles
of larger buckets are put last and the prefixes taken again, and what is still large then becomes a star
of candidates. Candidates that hang together are compared in tiles of bounded size on their whole sets;
the links of a tile are a spanning forest. SimHash fingerprints alone cannot do this: copies with a
similarity of 0.8 are ten and more of 64 bits apart, where a vantage-point tree no longer cuts anything off.
Their links can be joined to these (``prints_linked``); both kinds then make the groups.

Defined cases: NULL and blank texts have the empty set and are copies of each other. A text with fewer
words than a shingle is one shingle. Rows are told apart by key and text: rows with a NULL key, or
with the key of another text, are judged by their own text.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.llm.common import map_blocks, text_blocks
from tracemill.llm.components import components
from tracemill.llm.simhash import _find, _unite, fingerprint, shingle_hashes
from tracemill.operators.joins import join_spread
from tracemill.session import durable, small_side

# Classes of a bucket that are paired one by one, and classes in half a tile.
FEW = 32
TILE = 256
# Texts of the sample that shows which shingles are frequent, and those in which one is.
SAMPLE = 20_000
FREQUENT = 10
# Shingles that the order knows by their number, and rounds in which it gets better.
MOST_FREQUENT = 200_000
ROUNDS = 2
# Rows up to which the classes to be compared are looked up next to the texts.
NEAR = 1_000_000


def shingle_set(text: str | None, size: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, size))


def signature(found: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh64_intdigest(found.astype("<u8").tobytes(), 7)).view(np.int64)))


def frequent_shingles(docs: DataFrame, text: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles that many sampled texts hold, and in how many; they only order the shingles."""
    total = docs.count()
    picked = F.pmod(F.xxhash64(text, F.lit(5)), F.lit(1 << 20)) < F.lit(int(min(1.0, SAMPLE / max(1, total)) * (1 << 20)))

    def unfold(batches):
        for batch in batches:
            for b in text_blocks(batch, "__sampled"):
                found = [shingle_set(t, size) for t in b.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64))], names=["h"])

    got = (
        docs.where(picked).select(F.col(text).alias("__sampled")).distinct().mapInArrow(unfold, "h long")
        .groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FREQUENT)
        .orderBy(F.desc("n"), "h").limit(MOST_FREQUENT).toArrow()
    )
    hashes = got["h"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], got["n"].to_numpy()[order] * max(1.0, total / SAMPLE)


def prefix(found: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first shingles of a set, one of which any set of similarity 0.8 or more has among its first."""
    keep = len(found) - (4 * len(found) + 4) // 5 + 1 if len(found) else 0
    hashes, counts = frequent
    if not len(hashes):
        return found[:keep]
    at = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
    rank = np.where(hashes[at] == found, counts[at], 0)
    return found[np.argsort(rank, kind="stable")[:keep]]


def bucket_pairs(rows: DataFrame, few: int = FEW) -> DataFrame:
    """``(a, b, hot)`` from ``(h, sig, n)``: pairs of small buckets; stars of large ones, which are hot.

    Two sets without a hot shingle in common are paired in every bucket they share, ``c`` of them. Beyond
    their prefixes they have at most as many shingles in common as the longer rest holds: pairs that
    cannot reach the similarity so are left out here, as are pairs of unequal sizes.
    """

    def pair(batches):
        def runs(h, s, n, last):
            """Pairs of all complete buckets, and the rows of the bucket that may go on."""
            ends = np.r_[np.flatnonzero(h[1:] != h[:-1]) + 1, len(h)]
            starts = np.r_[0, ends[:-1]]
            if not last:
                starts, ends = starts[:-1], ends[:-1]
            sizes = ends - starts
            found = []
            for m in np.unique(sizes[(sizes > 1) & (sizes <= few)]):
                at = starts[sizes == m][:, None] + np.arange(m)
                x, y = (at[:, i].ravel() for i in np.triu_indices(m, 1))
                alike = 5 * np.minimum(n[x], n[y]) >= 4 * np.maximum(n[x], n[y])
                x, y = x[alike], y[alike]
                found.append((s[x], s[y], n[x], n[y], np.zeros(len(x), bool)))
            for i in np.flatnonzero(sizes > few):
                y = np.arange(starts[i] + 1, ends[i])
                found.append((np.full(len(y), s[starts[i]]), s[y], 0 * n[y], 0 * n[y], np.ones(len(y), bool)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["a", "b", "na", "nb", "hot"])

        held = []
        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held.append(new)
            # A bucket that fills whole batches is put together once, at its end.
            if not len(new[0]) or new[0][-1] == held[0][0][0]:
                continue
            h, s, n = (np.concatenate([x[k] for x in held]) for k in range(3))
            yield from runs(h, s, n, False)
            at = np.searchsorted(h, h[-1])
            held = [[h[at:], s[at:], n[at:]]]
        if held:
            h, s, n = (np.concatenate([x[k] for x in held]) for k in range(3))
            if len(h):
                yield from runs(h, s, n, True)

    dealt = rows.repartition("h").sortWithinPartitions("h", "sig")
    found = dealt.select("h", "sig", "n").mapInArrow(pair, "a long, b long, na long, nb long, hot boolean")
    counted = found.groupBy("a", "b", "na", "nb", "hot").agg(F.count(F.lit(1)).alias("c"))
    rest = F.floor((F.lit(4) * F.greatest("na", "nb") + 4) / 5) - 1
    return counted.where(F.col("hot") | (F.lit(9) * (F.col("c") + rest) >= F.lit(4) * (F.col("na") + F.col("nb")))).select("a", "b", "hot")


def tile_forest(sigs: np.ndarray, flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links between the sets ``flat[ends[i-1]:ends[i]]``."""
    sizes = np.diff(np.r_[0, ends])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(flat, kind="stable")
    first = np.r_[True, flat[order][1:] != flat[order][:-1]] if len(flat) else np.empty(0, bool)
    row, who = np.cumsum(first) - 1, owner[order]
    common = np.zeros((len(sizes), len(sizes)), np.float32)
    for at in range(0, int(row[-1]) + 1 if len(row) else 0, 4096):
        lo, hi = np.searchsorted(row, [at, at + 4096])
        held = np.zeros((4096, len(sizes)), np.float32)
        held[row[lo:hi] - at, who[lo:hi]] = 1
        common += held.T @ held
    x, y = np.nonzero(np.triu(9 * common >= 4 * (sizes[:, None] + sizes[None, :]), 1))
    parent = np.arange(len(sizes))
    _unite(parent, x, y)
    roots = _find(parent, np.arange(len(sizes)))
    moved = np.flatnonzero(roots != np.arange(len(sizes)))
    return sigs[roots[moved]], sigs[moved]


def tile_links(members: DataFrame, sets: DataFrame, tile: int = TILE) -> DataFrame:
    """Links ``(a, b)`` within groups of classes ``(root, sig, n)``, block against block.

    A set travels once for each block of its group that it is compared with. The classes of a group are cut
    into blocks by size: blocks whose sizes are too far apart for the similarity never meet.
    """
    totals = members.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / F.lit(tile)).cast("int").alias("blocks"), F.percentile_approx("n", F.array(*[F.lit(k / 64) for k in range(1, 64)])).alias("cuts"))
    totals = small_side(durable(totals))
    # Large groups go by size first: up to 64 bands, each cut into blocks by hash.
    placed = (
        members.join(totals, "root")
        .withColumn("band", F.when(F.col("blocks") > 1, F.size(F.filter("cuts", lambda c: c < F.col("n")))).otherwise(F.lit(0)))
        .drop("cuts", "blocks")
    )
    bands = placed.groupBy("root", "band").agg(F.ceil(F.count(F.lit(1)) / F.lit(tile)).cast("int").alias("parts"), F.min("n").alias("low"), F.max("n").alias("high"))
    bands = small_side(durable(bands))
    other = bands.select("root", F.col("band").alias("band2"), F.col("parts").alias("parts2"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    # Pairs of bands of one root: 64 times 64 at most.
    meets = bands.join(other, "root").where((F.lit(5) * F.col("high2") >= F.lit(4) * F.col("low")) & (F.lit(5) * F.col("high") >= F.lit(4) * F.col("low2")))
    mine = F.pmod(F.xxhash64("sig", F.lit(13)), F.col("parts")).cast("int")
    dealt = (
        placed.join(small_side(durable(meets.select("root", "band", "parts", "band2", "parts2"))), ["root", "band"])
        .withColumn("mine", F.struct("band", mine.alias("part")))
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts2") - 1)))
        .withColumn("with", F.struct(F.col("band2").alias("band"), F.col("with").alias("part")))
        .select("root", F.least("mine", "with").alias("i"), F.greatest("mine", "with").alias("j"), "sig")
        .join(sets, "sig")
    )

    def link(rows):
        lists = rows["shingles"].combine_chunks()
        sigs = rows["sig"].to_numpy()
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        a, b = tile_forest(sigs, flat, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))
        return pa.table({"a": a, "b": b})

    return dealt.groupBy("root", "i", "j").applyInArrow(link, "a long, b long")


def refined(classes: DataFrame, docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], size: int, few: int) -> tuple[DataFrame, tuple]:
    """Classes with prefixes of a better order, in which the shingles of buckets of more than ``few`` classes come last.

    Only texts with such a shingle in their prefix change theirs: they are read again.
    """
    unfolded = classes.select("sig", "text_key", F.explode("firsts").alias("h"))
    busy = durable(unfolded.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > few).orderBy(F.desc("n"), "h").limit(MOST_FREQUENT))
    got = busy.toArrow()
    if not got.num_rows:
        return classes, frequent
    order = dict(zip(frequent[0].tolist(), frequent[1].tolist()))
    for h, n in zip(got["h"].to_numpy().view(np.uint64).tolist(), got["n"].to_pylist()):
        order[h] = max(n, order.get(h, 0))
    hashes = np.array(sorted(order), np.uint64)
    better = hashes, np.array([order[h] for h in hashes.tolist()], np.float64)
    touched = durable(unfolded.join(small_side(busy), "h", "left_semi").select(F.col("text_key").alias("__text_key")).distinct())
    texts = docs.join(small_side(touched, NEAR), "__text_key", "left_semi").groupBy("__text_key").agg(F.first("text").alias("text"))
    kinds = T.StructType([T.StructField("sig", T.LongType()), T.StructField("again", T.ArrayType(T.LongType()))])
    shared = docs.sparkSession.sparkContext.broadcast(better)

    def work(texts):
        found = [shingle_set(t, size) for t in texts]
        return {"sig": [signature(f) for f in found], "again": pa.array([prefix(f, shared.value).view(np.int64) for f in found], pa.list_(pa.int64()))}

    again = map_blocks(texts, ["__text_key"], "text", kinds, lambda: work).select("sig", "again")
    return durable(classes.join(again, "sig", "left").withColumn("firsts", F.coalesce("again", "firsts")).drop("again")), better


def print_links(marks: DataFrame, prints_linked: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """Links ``(a, b)`` between classes ``sig`` whose fingerprints ``fp`` are equal or linked, as stars."""
    points = durable(marks.groupBy("fp").agg(F.min("sig").alias("first"), F.count(F.lit(1)).alias("__n")))
    equal = join_spread(marks.select("fp", "sig"), points, ["fp"], "__n", ["sig"], heavy_rows=10_000).select(F.col("first").alias("a"), F.col("sig").alias("b"))
    ends = prints_linked(points, points.count())
    for end in ("a", "b"):
        ends = ends.join(points.select(F.col("fp").alias(end), F.col("first").alias(f"first_{end}")), end)
    return equal.union(ends.select("first_a", "first_b")).where("a <> b")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, few: int = FEW, tile: int = TILE, row: str | None = None, prints_linked: Callable[[DataFrame, int], DataFrame] | None = None
) -> DataFrame:
    """``key, __text_key`` of one row, that with the smallest key, of each group of linked texts.

    ``row`` names a column that tells every row from every other one; it breaks ties and is returned too.
    ``prints_linked`` gives links ``(a, b)`` between distinct SimHash fingerprints ``fp`` from them and their number, such
    as ``simhash.fingerprint_links``; they link the texts that have these fingerprints as well.
    """
    extra = [row] if row else []
    docs = docs.select(key, *extra, F.col(text).cast("string").alias("text"))
    docs = docs.withColumn("__text_key", F.xxhash64("text"))
    frequent = frequent_shingles(docs, "text", size)
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    kinds = [T.StructField("sig", T.LongType()), T.StructField("n", T.LongType()), T.StructField("firsts", T.ArrayType(T.LongType()))]
    kinds += [T.StructField("fp", T.LongType())] if prints_linked else []

    def work(texts):
        found = [shingle_set(t, size) for t in texts]
        columns = {"sig": [signature(f) for f in found], "n": [len(f) for f in found], "firsts": pa.array([prefix(f, shared.value).view(np.int64) for f in found], pa.list_(pa.int64()))}
        return columns | ({"fp": [fingerprint(t) for t in texts]} if prints_linked else {})

    prints = map_blocks(docs, [key, "__text_key", *extra], "text", T.StructType(kinds), lambda: work)
    least = F.min(F.struct(F.col(key).isNull(), F.col(key), F.col("__text_key"), *[F.col(c) for c in extra]))
    same = [F.first("n").alias("n"), F.first("firsts").alias("firsts")]
    if prints_linked:
        # Texts of a class may differ in how often they repeat a shingle, and so in their fingerprints.
        marks = durable(prints.groupBy("sig", "fp").agg(least.alias("least"), F.min("__text_key").alias("text_key"), *same))
        classes = durable(marks.groupBy("sig").agg(F.min("least").alias("least"), F.min("text_key").alias("text_key"), *same))
    else:
        classes = durable(prints.groupBy("sig").agg(least.alias("least"), F.min("__text_key").alias("text_key"), *same))
    ordered = classes.select("sig", "text_key", "n", "firsts")
    for _ in range(ROUNDS):
        ordered, frequent = refined(ordered, docs, frequent, size, few)
    pairs = durable(bucket_pairs(ordered.select(F.explode("firsts").alias("h"), "sig", "n"), few))
    used = pairs.select(F.col("a").alias("sig")).union(pairs.select(F.col("b").alias("sig"))).distinct()
    wanted = durable(classes.join(used, "sig", "left_semi").select(F.col("text_key").alias("__text_key")))
    full = T.StructType([T.StructField("sig", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))])

    def whole(texts):
        found = [shingle_set(t, size) for t in texts]
        return {"sig": [signature(f) for f in found], "shingles": pa.array([f.view(np.int64) for f in found], pa.list_(pa.int64()))}

    texts = docs.join(small_side(wanted, NEAR), "__text_key", "left_semi").groupBy("__text_key").agg(F.first("text").alias("text"))
    sets = map_blocks(texts, ["__text_key"], "text", full, lambda: whole).select("sig", "shingles")
    # Candidates that hang together are compared together: every set is read once for each block it meets.
    members = components(pairs.select("a", "b")).select("root", F.col("node").alias("sig"))
    links = tile_links(durable(members.join(classes.select("sig", "n"), "sig")), sets, tile)
    if prints_linked:
        links = links.union(print_links(marks, prints_linked))
    linked = components(durable(links)).select(F.col("node").alias("sig"), "root")
    groups = classes.select("sig", "least").join(linked, "sig", "left").groupBy(F.coalesce("root", "sig")).agg(F.min("least").alias("least"))
    return groups.select(F.col(f"least.{key}").alias(key), F.col("least.__text_key").alias("__text_key"), *[F.col(f"least.{c}").alias(c) for c in extra])
