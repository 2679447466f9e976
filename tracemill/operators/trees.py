"""Decision trees over sparse whole-number scores, level by level.

A candidate split asks whether a pattern's score is at least ``k``: the pattern's first ``k`` symbols
occur. With ``L`` and ``R`` traces on its two sides, of which ``L_c`` and ``R_c`` are of class ``c``, it is
worth the whole part of ``1000 * (sum(L_c^2) / L + sum(R_c^2) / R)``, the Gini criterion written in whole
numbers, so that every engine ranks alike. Of equal worths the smallest pattern, then the smallest ``k``
is taken. A node is split if that makes it purer. Its class is the most frequent one, of equal ones that
which sorts first.

Several trees grow at once, such as those of all folds. A level is one count of ``(tree, node, pattern, score,
class)``, taken where the traces are and added up; zeros are implied. Nodes whose scores fit into one
task are finished there, all levels at once, with the same arithmetic.

Tables: ``rows (trace_id, label, pattern_ids, scores)``, sparse, ids ascending. They may have ``floors``: a pattern
is then listed for traces that go beyond its first ``floors`` symbols only, and no split asks for so few of them,
since they are also the start of a smaller pattern (``similarity.own_scores``). ``nodes (tree, node, depth,
pattern_id, k, cls, n)``, where node 1 is the root, ``2 i`` lacks the prefix of node ``i`` and ``2 i + 1`` has
it, and leaves have no pattern. A tree cut at any depth is the tree that would have been grown to it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from tracemill.session import bounded_batches, durable, small_side

# Scores listed for the traces of a node that one task may hold.
LOCAL_CELLS = 1 << 21
# Scores taken from a batch, and splits rated, at a time.
SLICE_CELLS = 1 << 18

NODES = "tree int, node long, depth int, pattern_id long, k int, cls string, n long"


def _worth(right: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Worth of splits with ``right[c]`` rows of each class on the right of ``total[c]``; -1 where a side is empty
    or nothing gets purer. All numbers are whole."""
    big = object if int(total.sum()) > 20_000 else np.int64
    right, total = right.astype(big), total.astype(big)
    r = right.sum(axis=0)
    n = total.sum()
    left = n - r
    a = (right**2).sum(axis=0)
    b = ((total.reshape(-1, *[1] * (right.ndim - 1)) - right) ** 2).sum(axis=0)
    sides = np.where((r > 0) & (left > 0), r * left, 1)
    top = a * left + b * r
    purer = (r > 0) & (left > 0) & (top * n > (total**2).sum() * sides)
    return np.where(purer, top * 1000 // sides, -1)


def _worths(right: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``_worth`` of many splits, a bounded number at a time."""
    step = SLICE_CELLS // max(1, len(total))
    parts = [_worth(right[:, at : at + step], total).astype(np.int64) for at in range(0, right.shape[1], step)]
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


@dataclass
class Entries:
    """Scores in the order of pattern and score, one entry each: row, pattern, score, and the pattern's floor."""

    row: np.ndarray
    pattern: np.ndarray
    score: np.ndarray
    floor: np.ndarray

    def of(self, some: np.ndarray) -> "Entries":
        return Entries(self.row[some], self.pattern[some], self.score[some], self.floor[some])


def _best(entries: Entries, labels: np.ndarray, total: np.ndarray) -> tuple[int, int] | None:
    """The best split ``(pattern, k)`` of the rows that ``entries`` belong to, if there is any."""
    if not len(entries.row):
        return None
    pattern, score = entries.pattern, entries.score
    fresh = np.r_[True, pattern[1:] != pattern[:-1]]
    # Every score that occurs is a split: the smallest ``k`` that tells it from the scores below.
    first = np.flatnonzero(fresh | np.r_[True, score[1:] != score[:-1]])
    group = np.cumsum(fresh[first]) - 1
    ends = np.r_[np.flatnonzero(fresh[first])[1:], len(first)][group]
    counts = np.stack([np.add.reduceat((labels[entries.row] == c).astype(np.int64), first) for c in range(len(total))])
    behind = np.concatenate([np.cumsum(counts[:, ::-1], axis=1)[:, ::-1], np.zeros((len(total), 1), np.int64)], axis=1)
    worth = _worths(behind[:, :-1] - behind[:, ends], total)
    at = int(np.argmax(worth))
    if worth[at] < 0:
        return None
    below = entries.floor[first[at]] if fresh[first[at]] else score[first[at - 1]]
    return int(pattern[first[at]]), int(below) + 1


def _grow(entries: Entries, labels: np.ndarray, classes: list[str], node: int, depth: int, most: int) -> list[tuple]:
    """Nodes of the subtree at ``node``, ``(node, depth, pattern_id, k, cls, n)``, from the scores of its rows."""
    out = []
    todo = [(node, depth, np.arange(len(labels)), entries)]
    while todo:
        node, depth, rows, mine = todo.pop()
        total = np.bincount(labels[rows], minlength=len(classes))
        split = _best(mine, labels, total) if depth < most and (total > 0).sum() > 1 else None
        cls = classes[int(total.argmax())]
        if split is None:
            out.append((node, depth, None, None, cls, len(rows)))
            continue
        pattern, k = split
        out.append((node, depth, pattern, k, cls, len(rows)))
        has = np.zeros(len(labels), bool)
        low, high = np.searchsorted(mine.pattern, [pattern, pattern + 1])
        has[mine.row[low:high][mine.score[low:high] >= k]] = True
        on = has[mine.row]
        todo += [(2 * node, depth + 1, rows[~has[rows]], mine.of(~on)), (2 * node + 1, depth + 1, rows[has[rows]], mine.of(on))]
    return out


def score_of(pattern: Column, ids: str = "pattern_ids", scores: str = "scores") -> Column:
    """A pattern's score in a sparse row; 0 if it is not listed."""
    at = F.array_position(F.col(ids), pattern).cast("int")
    return F.when(at > 0, F.get(F.col(scores), at - 1)).otherwise(F.lit(0))


def fit_trees(rows: DataFrame, depth: int, trees: Column | None = None, local_cells: int = LOCAL_CELLS) -> DataFrame:
    """The ``nodes`` of one tree per number in ``trees``, an array column: the trees that a row is learned by.

    Rows with a NULL label are not learned from; without any row there are no nodes.
    """
    bounded_batches(rows.sparkSession)
    trees = F.array(F.lit(0)) if trees is None else trees
    floors = F.col("floors") if "floors" in rows.columns else F.transform("scores", lambda x: F.lit(0))
    spread = rows.where("label IS NOT NULL").select(
        "trace_id", "label", "pattern_ids", "scores", floors.cast("array<int>").alias("floors"), F.explode(trees.cast("array<int>")).alias("tree")
    )
    live = durable(spread.withColumn("node", F.lit(1).cast("long")))
    # The classes: the model's width.
    classes = sorted(r[0] for r in live.select("label").distinct().collect())
    if not classes:
        return rows.sparkSession.createDataFrame([], NODES)
    shared = rows.sparkSession.sparkContext.broadcast(classes)
    done: list[DataFrame] = []
    level = 0
    while True:
        if level == depth:
            # No more splits: only the classes are wanted.
            done.append(_leaves(live, level))
            break
        cells = F.sum(F.greatest(F.size("pattern_ids"), F.lit(0)))
        sized = durable(live.groupBy("tree", "node").agg(cells.alias("__n")))
        small = sized.where(F.col("__n") <= local_cells)
        done.append(_finish(live.join(small_side(small.drop("__n")), ["tree", "node"]), shared, level, depth))
        large = sized.where(F.col("__n") > local_cells)
        if large.isEmpty():
            break
        live = durable(live.join(small_side(large.drop("__n")), ["tree", "node"]))
        splits = durable(_best_splits(live, shared))
        leaves = _leaves(live, level).alias("l").join(splits, ["tree", "node"], "left")
        done.append(leaves.select("tree", "node", "depth", splits["pattern_id"], splits["k"], "cls", "n"))
        moved = live.join(small_side(splits), ["tree", "node"])
        has = score_of(F.col("pattern_id")) >= F.col("k")
        live = durable(moved.withColumn("node", F.col("node") * 2 + has.cast("int")).drop("pattern_id", "k"))
        level += 1
        if live.isEmpty():
            break
    return durable(reduce(DataFrame.unionByName, done))


def _leaves(live: DataFrame, level: int) -> DataFrame:
    """The class of every node, as if none was split."""
    counts = live.groupBy("tree", "node", "label").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("less"), F.col("label"))).alias("best")
    nothing = lambda kind: F.lit(None).cast(kind)
    return counts.groupBy("tree", "node").agg(best, F.sum("n").alias("n")).select(
        "tree", "node", F.lit(level).alias("depth"), nothing("long").alias("pattern_id"), nothing("int").alias("k"), F.col("best.label").alias("cls"), "n"
    )


def _finish(rows: DataFrame, shared, level: int, depth: int) -> DataFrame:
    """Subtrees of nodes whose rows fit into a task, each grown there."""

    def grow(key, group):
        classes = shared.value
        labels = np.searchsorted(np.array(classes), group["label"].combine_chunks().to_numpy(zero_copy_only=False).astype(str))
        ids = group["pattern_ids"].combine_chunks()
        row = np.repeat(np.arange(len(ids), dtype=np.int32), ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        flat = lambda c: group[c].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        entries = Entries(row, flat("pattern_ids"), flat("scores"), flat("floors"))
        entries = entries.of(np.lexsort((entries.score, entries.pattern)))
        found = _grow(entries.of(entries.score > entries.floor), labels, classes, key[1].as_py(), level, depth)
        tree = key[0].as_py()
        names = ["tree", "node", "depth", "pattern_id", "k", "cls", "n"]
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int64()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*[(tree, *f) for f in found]), kinds)], names=names)

    return rows.select("tree", "node", "label", "pattern_ids", "scores", "floors").groupBy("tree", "node").applyInArrow(grow, NODES)


def _best_splits(live: DataFrame, shared) -> DataFrame:
    """``(tree, node, pattern_id, k)`` of every large node that can be split."""

    def count(batches):
        classes = np.array(shared.value)
        for batch in batches:
            sizes = batch.column("pattern_ids").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // SLICE_CELLS)) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                part = batch.slice(low, high - low)
                row = np.repeat(np.arange(high - low), sizes[low:high])
                flat = lambda c: part.column(c).flatten().to_numpy(zero_copy_only=False)  # noqa: B023, E731
                label = np.searchsorted(classes, part.column("label").to_numpy(zero_copy_only=False).astype(str))
                tree, node = part.column("tree").to_numpy(), part.column("node").to_numpy()
                pattern, score, floor = flat("pattern_ids"), flat("scores"), flat("floors")
                keys = (label[row], score, floor, pattern, node[row], tree[row])
                order = np.lexsort(keys)
                order = order[score[order] > floor[order]]
                keys = [k[order] for k in keys]
                first = np.flatnonzero(np.any([np.r_[True, k[1:] != k[:-1]] for k in keys], axis=0)) if len(order) else order
                n = np.diff(np.r_[first, len(order)])
                kinds = (None, pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
                said, scores, floors, patterns, nodes, trees = (pa.array(k[first] if t else classes[k[first]].tolist(), t or pa.string()) for k, t in zip(keys, kinds))
                yield pa.RecordBatch.from_arrays(
                    [trees, nodes, patterns, floors, scores, said, pa.array(n, pa.int64())], names=["tree", "node", "pattern_id", "floor", "score", "label", "n"]
                )

    schema = "tree int, node long, pattern_id long, floor int, score int, label string, n long"
    found = live.select("tree", "node", "label", "pattern_ids", "scores", "floors").mapInArrow(count, schema)
    own = ["tree", "node", "pattern_id", "floor"]
    # Dealt by pattern once: all that follows stays there.
    counts = found.groupBy(*own, "score", "label").agg(F.sum("n").alias("n")).repartition("tree", "node", "pattern_id")
    whole = T.DecimalType(38, 0)
    totals = durable(live.groupBy("tree", "node", "label").agg(F.count(F.lit(1)).alias("t")))
    node = totals.groupBy("tree", "node").agg(F.sum("t").alias("rows"), F.sum(F.col("t").cast(whole) * F.col("t")).alias("squares"))
    # Every score that occurs is a split: the smallest ``k`` that tells it from the scores below. What lies on its
    # right is added up from the highest score on; so are the squares of the classes' rows, by what each score adds.
    down = W.partitionBy(*own).orderBy(F.desc("score"))
    of_class = W.partitionBy(*own, "label").orderBy(F.desc("score"))
    upto = F.sum("n").over(of_class).cast(whole)
    sides = (
        counts.join(small_side(totals), ["tree", "node", "label"])
        .withColumn("more", (upto * upto - (upto - F.col("n")) * (upto - F.col("n"))).cast(whole))
        .groupBy(*own, "score")
        .agg(F.sum("n").alias("n"), F.sum("more").cast(whole).alias("more"), F.sum(F.col("n").cast(whole) * F.col("t")).cast(whole).alias("both"))
        .select(
            "tree", "node", "pattern_id", (F.coalesce(F.lead("score").over(down), "floor") + 1).alias("k"),
            F.sum("n").over(down).alias("r"), F.sum("more").over(down).cast(whole).alias("a"), F.sum("both").over(down).cast(whole).alias("cross"),
        )
        .join(small_side(durable(node)), ["tree", "node"])
        .withColumn("l", F.col("rows") - F.col("r"))
        .where("l > 0")
        .withColumn("b", (F.col("squares") - 2 * F.col("cross") + F.col("a")).cast(whole))
        .withColumn("top", (F.col("a") * F.col("l") + F.col("b") * F.col("r")).cast(whole))
        .where((F.col("top") * F.col("rows")).cast(whole) > (F.col("squares") * F.col("l") * F.col("r")).cast(whole))
        .withColumn("worth", F.expr("CAST(top * 1000 AS DECIMAL(38, 0)) DIV (CAST(l AS DECIMAL(38, 0)) * r)"))
    )
    best = F.min(F.struct((-F.col("worth")).alias("less"), "pattern_id", "k")).alias("best")
    return sides.groupBy("tree", "node").agg(best).select("tree", "node", "best.pattern_id", "best.k")


def predict_trees(rows: DataFrame, nodes: DataFrame, depths: list[int], tree: str | None = None) -> DataFrame:
    """``rows`` with ``depth`` and ``predicted``, a row for each of ``depths``; ``tree`` names the column with a row's tree.

    The nodes are a model: their number is bounded by the depth, and they travel with the tasks.
    """
    model: dict[int, dict[int, tuple]] = {}
    for r in nodes.select("tree", "node", "pattern_id", "k", "cls").toLocalIterator():
        model.setdefault(r["tree"], {})[r["node"]] = (r["pattern_id"], r["k"], r["cls"])
    asked = np.array(sorted({p for own in model.values() for p, _, _ in own.values() if p is not None}), np.int64)
    shared = rows.sparkSession.sparkContext.broadcast((model, asked))
    source = rows.select("*", (F.col(tree).cast("int") if tree else F.lit(0)).alias("__tree"))
    schema = T.StructType([*rows.schema.fields, T.StructField("depth", T.IntegerType()), T.StructField("predicted", T.StringType())])

    names = list(rows.columns)

    def walk(batches):
        model, asked = shared.value
        for batch in batches:
            row, at, said = [], [], []
            # Only the scores that the trees ask for become Python objects.
            lists = batch.column("pattern_ids")
            owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            ids, scores = lists.flatten().to_numpy(zero_copy_only=False), batch.column("scores").flatten().to_numpy(zero_copy_only=False)
            wanted = np.isin(ids, asked)
            known: dict[int, dict] = {}
            for i, p, s in zip(owner[wanted].tolist(), ids[wanted].tolist(), scores[wanted].tolist()):
                known.setdefault(i, {})[p] = s
            for i, t in enumerate(batch.column("__tree").to_pylist()):
                own, found = model.get(t, {}), known.get(i, {})
                node, path = 1, []
                while node in own:
                    pattern, k, cls = own[node]
                    path.append(cls)
                    if pattern is None:
                        break
                    node = 2 * node + (found.get(pattern, 0) >= k)
                for d in depths:
                    row.append(i)
                    at.append(d)
                    said.append(path[min(d, len(path) - 1)] if path else None)
            picked = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(c).take(picked) for c in names] + [pa.array(at, pa.int32()), pa.array(said, pa.string())], names=[*names, "depth", "predicted"])

    return source.mapInArrow(walk, schema)


def tree_conditions(nodes: DataFrame, depth: int | None = None) -> DataFrame:
    """Rules of a single tree, cut at ``depth``, in long form ``(cls, rule_id, pattern_id, op, value)``; the id is the leaf's node.

    ``score > k - 0.5`` says that the first ``k`` symbols occur. A node's number spells its path: halving it
    goes up. A tree of one leaf has one rule without conditions.
    """
    depth = F.lit(depth if depth is not None else 1 << 30)
    stored = durable(nodes.where(F.col("depth") <= depth))
    leaves = stored.where(F.col("pattern_id").isNull() | (F.col("depth") == depth)).select("cls", F.col("node").alias("rule_id"), "depth")
    steps = leaves.withColumn("up", F.explode_outer(F.when(F.col("depth") > 0, F.sequence(F.lit(1), F.col("depth")))))
    on_path = steps.withColumn("node", F.expr("shiftright(rule_id, up)")).withColumn("yes", F.expr("shiftright(rule_id, up - 1) % 2"))
    inner = stored.select("node", "pattern_id", "k")
    return on_path.join(inner, "node", "left").select(
        "cls", "rule_id", "pattern_id", F.when(F.col("yes") == 1, ">").when(F.col("yes") == 0, "<=").alias("op"), (F.col("k") - 0.5).alias("value")
    )


def grid_report(rows: DataFrame, fold: str, folds: int, depths: list[int], local_cells: int = LOCAL_CELLS) -> tuple[DataFrame, DataFrame]:
    """``(max_depth, f1, chosen)`` of every depth, and the nodes of the tree of all rows (number ``folds``).

    Each fold is predicted by the tree of the others; one tree per fold, grown to the largest depth, serves
    all depths. F1 is weighted by the classes' rows and averaged over the folds; the best depth is chosen, of
    equal ones the smallest.
    """
    numbers = F.sequence(F.lit(0), F.lit(folds))
    learned = F.filter(numbers, lambda t: t != F.col(fold))
    rows = durable(rows.where("label IS NOT NULL"))
    nodes = fit_trees(rows, max(depths), learned, local_cells)
    said = predict_trees(rows, nodes, list(depths), fold)
    pairs = durable(said.groupBy(F.col(fold).alias("fold"), "depth", "label", "predicted").agg(F.count(F.lit(1)).alias("n")))
    hit = F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(F.lit(0))
    true = pairs.groupBy("fold", "depth", "label").agg(F.sum("n").alias("support"), F.sum(hit).alias("hits"))
    told = pairs.groupBy("fold", "depth", F.col("predicted").alias("label")).agg(F.sum("n").alias("told"))
    per_class = true.join(told, ["fold", "depth", "label"], "left")
    f1 = F.col("support") * 2 * F.col("hits") / (F.col("support") + F.coalesce("told", F.lit(0)))
    per_fold = per_class.groupBy("fold", "depth").agg((F.sum(f1) / F.sum("support")).alias("f1"))
    scores = durable(per_fold.groupBy(F.col("depth").cast("int").alias("max_depth")).agg(F.avg("f1").alias("f1")))
    # One row per depth.
    first = scores.orderBy(F.desc(F.round("f1", 9)), "max_depth").first()
    report = scores.select("max_depth", "f1", (F.col("max_depth") == F.lit(first["max_depth"] if first else None)).alias("chosen"))
    return report, nodes.where(F.col("tree") == folds)
