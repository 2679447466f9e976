"""Mixing sources to target weights by hierarchical budgeting (operator 3).

Leaves of a tree (domain, language, source) hold documents; every node has a weight among its
siblings. A token budget goes down the tree: each node's share follows the weights, but no node gets
more than its documents can give in ``max_epochs`` passes; what it cannot use goes to its siblings by
their weights, and leaves the parent only when all siblings are full. Since every node's capacity is
known before its parent shares out, one pass from the root down does this.

A leaf then reads its documents in a seeded order, in epoch after epoch, each epoch in an order of its
own, and takes the prefix whose tokens fill its budget. The last document may be used in part.

Scale: the tree is a small table, one row per leaf, and is shared out with window functions. The
order within an epoch is by a hash, cut into slices: sums per (leaf, slice) tell which slices are
wholly within the prefix; only rows of a slice are ever sorted together, so a leaf with a third of
all rows is spread over all its slices.

Defined cases: NULLs in a level are a node of their own (``(null)``). NULL or negative token counts
count 0; documents of 0 tokens are taken with the place they fall on. Repeated rows are documents of
their own, ordered by their whole content and then alike. A non-positive budget takes nothing.
Weights that are missing are 1; a weight of 0 or less takes nothing. Columns of the input that have
the names of the result are not kept.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.session import durable

LEVELS = ("domain", "lang", "source")
# Rows aimed at in a slice of a leaf's order.
SLICE_ROWS = 4096


def share_out(nodes: DataFrame, parent: Sequence[str], budget: str, weight: str, capacity: str, name: str) -> DataFrame:
    """Adds ``name``: each node's whole-token part of its parent's budget.

    Parts are proportional to the weights, limited by the capacities, and add up to the smaller of the
    budget and all capacities. Nodes are filled in the order of ``capacity / weight``: as long as the
    level of the budget that is left over the weight that is left reaches it, a node is full.
    Tokens lost to rounding go one each to the nodes with the largest remainders that have room.
    """
    key = list(parent)
    fill = F.col(capacity) / F.col(weight)
    order = W.partitionBy(*key).orderBy(F.col("__fill").asc(), *[F.col(c) for c in nodes.columns if c not in key])
    before, whole = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy(*key)
    live = F.when((F.col(weight) > 0) & (F.col(capacity) > 0), F.col(weight)).otherwise(F.lit(0.0))
    df = nodes.withColumn("__live", live).withColumn("__fill", F.when(F.col("__live") > 0, fill).otherwise(F.lit(0.0)))
    df = df.withColumn("__used", F.coalesce(F.sum(F.when(F.col("__live") > 0, F.col(capacity)).otherwise(0)).over(before), F.lit(0)))
    df = df.withColumn("__weight_left", F.sum("__live").over(whole) - F.coalesce(F.sum("__live").over(before), F.lit(0.0)))
    left = F.greatest(F.col(budget) - F.col("__used"), F.lit(0))
    level = left / F.col("__weight_left")
    full = (F.col("__live") > 0) & (F.col("__fill") <= level)
    # The first node that is not full sets the level for itself and all later ones.
    df = df.withColumn("__level", F.when(~full & (F.col("__live") > 0), level))
    df = df.withColumn("__level", F.first("__level", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)))
    exact = F.when(F.col("__live") <= 0, F.lit(0.0)).when(F.col("__level").isNull(), F.col(capacity).cast("double"))
    exact = exact.otherwise(F.least(F.col("__level") * F.col("__live"), F.col(capacity).cast("double")))
    df = df.withColumn("__exact", exact).withColumn("__floor", F.floor("__exact").cast("long"))
    room = F.sum(F.when(F.col("__live") > 0, F.col(capacity)).otherwise(0)).over(whole)
    df = df.withColumn("__missing", F.least(F.greatest(F.col(budget), F.lit(0)), room) - F.sum("__floor").over(whole))
    can = (F.col("__live") > 0) & (F.col("__floor") < F.col(capacity))
    rest = W.partitionBy(*key).orderBy(can.desc(), (F.col("__exact") - F.col("__floor")).desc(), *[F.col(c) for c in nodes.columns if c not in key])
    df = df.withColumn("__place", F.row_number().over(rest))
    part = F.col("__floor") + F.when(can & (F.col("__place") <= F.col("__missing")), F.lit(1)).otherwise(F.lit(0))
    return df.select(*[F.col(c) for c in nodes.columns if c != name], part.cast("long").alias(name))


def budgets(leaves: DataFrame, budget: int, max_epochs: int, levels: Sequence[str] = LEVELS) -> DataFrame:
    """``levels, tokens, budget`` of every leaf; ``leaves`` has a weight ``w_<level>`` for each level."""
    df = leaves.withColumn("__cap", F.col("tokens") * F.lit(max_epochs)).withColumn("budget", F.lit(budget).cast("long"))
    for depth, level in enumerate(levels):
        path = list(levels[: depth + 1])
        usable = reduce(lambda a, b: a & b, [F.col(f"w_{c}") > 0 for c in levels[depth + 1 :]], F.lit(True))
        nodes = df.groupBy(*path).agg(
            F.sum(F.when(usable, F.col("__cap")).otherwise(0)).alias("__node_cap"), F.max(f"w_{level}").alias("__w"), F.max("budget").alias("__parent"),
        )
        shared = share_out(nodes, path[:-1], "__parent", "__w", "__node_cap", "budget")
        df = df.drop("budget").join(shared.select(*path, "budget"), path)
    return df.select(*levels, "tokens", "budget")


def name_levels(df: DataFrame, levels: dict[str, Column]) -> DataFrame:
    return df.withColumns({k: F.coalesce(v.cast("string"), F.lit("(null)")) for k, v in levels.items()})


def mix(docs: DataFrame, weights: dict[str, dict[str, float]], budget: int | None, max_epochs: int = 4, seed: int = 17, key: str = "doc_id", tokens: str = "n_tokens", levels: Sequence[str] = LEVELS, slice_rows: int = SLICE_ROWS, carry: Sequence[str] = ()) -> DataFrame:
    """Rows ``key, levels, epoch, start, n_tokens, take_tokens``: what each leaf reads, in its order.

    ``docs`` has the key, the token count and one text column per level. ``weights`` gives the weights of
    the names of each level; without a budget it is the number of all tokens. ``carry`` names columns that
    each row keeps, such as one that tells apart rows with the same key; they also break ties.
    """
    docs = durable(
        docs.select(F.col(key).alias("__key"), *levels, *carry, F.greatest(F.coalesce(F.col(tokens).cast("long"), F.lit(0)), F.lit(0)).alias("n_tokens"))
    )
    leaves = docs.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("__rows"))
    for level in levels:
        given = weights.get(level, {})
        chosen = F.lit(1.0)
        for name, w in given.items():
            chosen = F.when(F.col(level) == name, F.lit(float(w))).otherwise(chosen)
        leaves = leaves.withColumn(f"w_{level}", chosen)
    leaves = durable(leaves)
    if budget is None:
        budget = leaves.agg(F.sum("tokens")).head()[0] or 0
    plan = durable(
        budgets(leaves, budget, max_epochs, levels)
        .join(leaves.select(*levels, "__rows"), list(levels))
        .where("budget > 0")
        .withColumn("__slices", F.greatest(F.lit(1), F.ceil(F.col("__rows") / slice_rows)).cast("long"))
        # Whole epochs are taken entirely; the last one up to the rest.
        .withColumn("__epochs", F.ceil(F.col("budget") / F.col("tokens")).cast("int"))
        .drop("__rows")
    )
    # One row per document and epoch; the epochs of a leaf are at most max_epochs.
    rows = (
        docs.join(plan, list(levels))
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("__epochs") - 1)))
        .withColumn("__hash", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch"), F.col("__key").cast("string"))))
        .withColumn("__slice", F.conv(F.substring("__hash", 1, 8), 16, 10).cast("long") * F.col("__slices"))
        .withColumn("__slice", F.shiftright("__slice", 32))
    )
    place = [*levels, "epoch", "__slice"]
    sums = rows.groupBy(*place).agg(F.sum("n_tokens").alias("__sum"))
    earlier = W.partitionBy(*levels, "epoch").orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    base = sums.select(*place, F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__base"))
    inside = W.partitionBy(*place).orderBy("__hash", "__key", "n_tokens", *carry).rowsBetween(W.unboundedPreceding, -1)
    counted = rows.join(base, place).withColumn(
        "start", F.col("epoch") * F.col("tokens") + F.col("__base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    )
    taken = counted.where(F.col("start") < F.col("budget"))
    return taken.select(
        F.col("__key").alias(key), *levels, *carry, F.col("epoch").cast("long").alias("epoch"), "start", "n_tokens",
        F.least(F.col("n_tokens"), F.col("budget") - F.col("start")).alias("take_tokens"),
    )
