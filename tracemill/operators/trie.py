"""Prefix tries of patterns, and how far traces go down them.

All patterns that begin alike share the nodes of what they have in common: a trie is a table ``(node,
parent, depth, symbol)`` whose nodes are numbered level by level from the root, 0, so that every parent
has a smaller number than its children. A position of a trace goes down as far as its symbols lead. All
positions of a batch of blocks take a step together, so the work is the number of symbols matched, and
no pattern is compared on its own.

A trie is a model: its size is that of the patterns, not of the traces. Patterns of more than
``PART_SYMBOLS`` symbols are dealt to several tries, each of which fits into a worker and is broadcast
by itself; every part sees all blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.operators.blocks import BLOCK_SIZE, to_blocks
from tracemill.session import bounded_batches, durable

# Symbols of the patterns of one trie.
PART_SYMBOLS = 4_000_000
# Cells up to which children are looked up in a table of nodes and symbols.
DENSE_CELLS = 1 << 24
# Scores of a batch of sparse rows.
BATCH_SCORES = 1 << 20


class Trie:
    """``patterns`` are ``(pattern_id, symbols)``; equal and empty patterns are allowed."""

    def __init__(self, ids: np.ndarray, lists: np.ndarray, symbols: np.ndarray) -> None:
        """``symbols`` of pattern ``i`` are those from ``lists[i]`` up to ``lists[i + 1]``."""
        self.ids = ids
        self.alphabet, codes = np.unique(symbols, return_inverse=True)
        width = max(1, len(self.alphabet))
        sizes = np.diff(lists)
        at = np.zeros(len(ids), np.int64)  # node that each pattern has come to
        parent, depth, symbol, key, child = [np.array([-1])], [np.array([0])], [np.array([-1])], [], []
        total = 1
        open_ = np.flatnonzero(sizes > 0)
        step = 0
        while len(open_):
            edge = at[open_] * width + codes[lists[open_] + step]
            new, inverse = np.unique(edge, return_inverse=True)
            numbers = total + np.arange(len(new))
            at[open_] = numbers[inverse]
            parent.append(new // width)
            symbol.append(new % width)
            depth.append(np.full(len(new), step + 1))
            key.append(new)
            child.append(numbers)
            total += len(new)
            step += 1
            open_ = open_[sizes[open_] > step]
        self.ends = at
        self.parent, self.depth, self.symbol = (np.concatenate(c).astype(np.int32) for c in (parent, depth, symbol))
        self.levels = np.searchsorted(self.depth, np.arange(step + 2))  # first node of each depth
        self.keys = np.concatenate(key) if key else np.empty(0, np.int64)
        self.children = np.concatenate(child) if child else np.empty(0, np.int64)
        self.width = width
        self._index()

    def arrays(self) -> dict[str, np.ndarray]:
        """What ``from_arrays`` needs to make the trie again."""
        return {k: getattr(self, k) for k in ("ids", "alphabet", "ends", "parent", "depth", "symbol", "levels", "keys", "children")}

    @classmethod
    def from_arrays(cls, arrays: dict[str, np.ndarray]) -> "Trie":
        trie = cls.__new__(cls)
        for name in ("ids", "alphabet", "ends", "parent", "depth", "symbol", "levels", "keys", "children"):
            setattr(trie, name, arrays[name])
        trie.width = max(1, len(trie.alphabet))
        trie._index()
        return trie

    def _index(self) -> None:
        cells = len(self.parent) * self.width
        self.dense = None
        if cells <= DENSE_CELLS:
            self.dense = np.full(cells, -1, np.int32)
            self.dense[self.keys] = self.children

    def __len__(self) -> int:
        return len(self.parent)

    def codes(self, symbols: np.ndarray) -> np.ndarray:
        """Numbers of symbols in the trie's alphabet; -1 for others."""
        if not len(self.alphabet):
            return np.full(len(symbols), -1)
        at = np.minimum(np.searchsorted(self.alphabet, symbols), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == symbols, at, -1)

    def step(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Child of each node by a symbol; -1 if there is none."""
        edge = nodes.astype(np.int64, copy=False) * self.width + codes
        if self.dense is not None:
            return np.where(codes >= 0, self.dense[np.where(codes >= 0, edge, 0)], -1)
        at = np.minimum(np.searchsorted(self.keys, edge), len(self.keys) - 1)
        return np.where((codes >= 0) & (self.keys[at] == edge), self.children[at], -1)

    def deepest(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Deepest node that the symbols from each start lead to; a symbol of -1 leads nowhere."""
        found = np.zeros(len(starts), np.int64)
        live, at = np.arange(len(starts)), starts.copy()
        while len(live):
            inside = at < len(codes)
            live, at = live[inside], at[inside]
            nodes = self.step(found[live], codes[at])
            on = nodes >= 0
            live, at = live[on], at[on] + 1
            found[live] = nodes[on]
        return found

    def owners(self) -> tuple[np.ndarray, "Starts"]:
        """For each node, the number of the first pattern through it, which owns it; and the patterns' ``Starts``."""
        n = len(self.ids)
        owner = np.full(len(self), n, np.int32)
        np.minimum.at(owner, self.ends, np.arange(n, dtype=np.int32))
        for a, b in reversed(list(zip(self.levels[1:], [*self.levels[2:], len(self)]))):
            np.minimum.at(owner, self.parent[a:b], owner[a:b])
        # A pattern that shares its end with an earlier one owns no node at all.
        floor, up = self.depth[self.ends].copy(), owner[self.ends].copy()
        tops = 1 + np.flatnonzero(owner[1:] != owner[self.parent[1:]])
        floor[owner[tops]], up[owner[tops]] = self.depth[tops] - 1, owner[self.parent[tops]]
        if n:
            floor[owner[0]], up[owner[0]] = 0, owner[0]
        return owner, Starts(self.ids, floor, up)

    def best_depths(self, nodes: np.ndarray) -> np.ndarray:
        """For each pattern, the depth at which its path leaves the paths to ``nodes``."""
        reached = np.zeros(len(self), bool)
        reached[0] = True
        while len(nodes):
            nodes = nodes[~reached[nodes]]
            reached[nodes] = True
            nodes = np.unique(self.parent[nodes])
        best = np.zeros(len(self), np.int32)
        for a, b in zip(self.levels[1:], [*self.levels[2:], len(self)]):
            best[a:b] = np.where(reached[a:b], self.depth[a:b], best[self.parent[a:b]])
        return best[self.ends]


class Starts:
    """How patterns share their starts, without their symbols.

    Every node of a trie is owned by the first pattern through it. Of a pattern's path, the nodes down to depth
    ``floor`` are owned by earlier patterns, the last of them by ``up``; those below are its own. So a trace's
    scores are all told by the patterns of whose own nodes it reaches some: any other pattern has the score of
    ``up``, at most ``floor``. Patterns go by their number, in the order of their ids.
    """

    def __init__(self, ids: np.ndarray, floor: np.ndarray, up: np.ndarray) -> None:
        self.ids, self.floor, self.up = ids, floor, up
        # Patterns by the number of owners on the way to their own nodes.
        rank = np.zeros(len(ids), np.int32)
        self.steps: list[np.ndarray] = []
        open_ = np.flatnonzero(floor > 0)
        for p in open_.tolist():  # ``up`` comes before the pattern itself
            rank[p] = rank[up[p]] + 1
        if len(open_):
            open_ = open_[np.argsort(rank[open_], kind="stable")]
            self.steps = np.split(open_, 1 + np.flatnonzero(np.diff(rank[open_])))

    def reached(self, numbers: np.ndarray, depths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All patterns of whose own nodes some lie on the paths to the given ones, ascending, and how deep."""
        numbers, depths = [numbers], [depths]
        while len(numbers[-1]):
            last = np.unique(numbers[-1])
            last = last[self.floor[last] > 0]
            numbers.append(self.up[last])
            depths.append(self.floor[last])
        numbers, depths = np.concatenate(numbers), np.concatenate(depths)
        order = np.lexsort((depths, numbers))
        last = np.r_[numbers[order][1:] != numbers[order][:-1], True] if len(order) else order
        return numbers[order[last]], depths[order[last]]

    def scores(self, row: np.ndarray, numbers: np.ndarray, depths: np.ndarray, rows: int) -> np.ndarray:
        """Scores of all patterns, one row per trace, from what ``reached`` says of each."""
        best = np.zeros((rows, len(self.ids)), np.int32)
        best[row, numbers] = depths
        for step in self.steps:
            own = best[:, step]
            best[:, step] = np.where(own > 0, own, np.minimum(best[:, self.up[step]], self.floor[step]))
        return best


def build_tries(patterns: DataFrame, part_symbols: int = PART_SYMBOLS) -> Iterator[Trie]:
    """The tries of ``(pattern_id, gram)``, one for each part of the patterns; one part at a time is held."""
    stored = durable(patterns.select(F.col("pattern_id").cast("long").alias("pattern_id"), "gram"))
    symbols = stored.agg(F.sum(F.size("gram"))).first()[0] or 0
    parts = max(1, -(-symbols // part_symbols))
    for part in range(parts):
        mine = stored.where(F.pmod(F.xxhash64("pattern_id"), F.lit(parts)) == part) if parts > 1 else stored
        got = mine.orderBy("pattern_id").toArrow()
        lists = got["gram"].combine_chunks()
        offsets = np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)
        yield Trie(got["pattern_id"].to_numpy(), offsets, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64))


@dataclass
class Tries:
    """Broadcast tries of a pattern table, and the length of its longest pattern."""

    parts: list
    longest: int
    count: int
    starts: list  # ``Starts`` of each part, where scores are wanted


def share_tries(patterns: DataFrame, part_symbols: int = PART_SYMBOLS, starts: bool = True) -> Tries:
    """With ``starts``, the nodes' owners travel with each trie, and the patterns' starts by themselves."""
    sc = patterns.sparkSession.sparkContext
    parts, longest, count, shared = [], 0, 0, []
    for trie in build_tries(patterns, part_symbols):
        longest, count = max(longest, int(trie.depth.max())), count + len(trie.ids)
        if starts:
            trie.owner, found = trie.owners()
            shared.append(sc.broadcast(found))
        parts.append(sc.broadcast(trie))
    return Tries(parts, longest, count, shared)


def trie_table(patterns: DataFrame, part_symbols: int = PART_SYMBOLS) -> DataFrame:
    """``(part, node, parent, depth, sym_id, n_patterns)``: every node but the roots, and the patterns that end there."""
    spark = patterns.sparkSession
    found = None
    for part, trie in enumerate(build_tries(patterns, part_symbols)):
        n = len(trie)
        ends = np.bincount(trie.ends, minlength=n)
        rows = pa.table(
            {
                "part": np.full(n - 1, part), "node": np.arange(1, n), "parent": trie.parent[1:], "depth": trie.depth[1:],
                "sym_id": trie.alphabet[trie.symbol[1:]] if n > 1 else np.empty(0, np.int64), "n_patterns": ends[1:],
            }
        )
        df = spark.createDataFrame(rows)
        found = df if found is None else found.unionByName(df)
    return found


def trie_blocks(tries: Tries, tokens: DataFrame, value: str = "sym_id") -> DataFrame:
    """Blocks whose margin covers the longest pattern."""
    longest = max(tries.longest, 1)
    return to_blocks(tokens, value, before=0, after=longest, size=max(BLOCK_SIZE, 2 * longest))


def _walk(trie: Trie, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Block, position and deepest node of every owned position of a batch of blocks."""
    sizes = np.array([len(s) for s in batch.column("syms")], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    flat = np.full(int((sizes + 1).sum()), -1, np.int64)  # blocks are kept apart by a symbol that leads nowhere
    inside = np.ones(len(flat), bool)
    inside[starts + sizes] = False
    flat[inside] = trie.codes(batch.column("syms").flatten().to_numpy(zero_copy_only=False).astype(np.int64))
    own = batch.column("own_from").to_numpy(zero_copy_only=False).astype(np.int64) - 1
    counts = batch.column("own_count").to_numpy(zero_copy_only=False).astype(np.int64)
    block = np.repeat(np.arange(len(sizes)), counts)
    offset = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + own[block]
    pos = batch.column("first_pos").to_numpy(zero_copy_only=False)[block] + offset
    return block, pos, trie.deepest(flat, starts[block] + offset)


# Blocks unfolded at a time.
BLOCKS = 256


def _slices(batches, size: int = BLOCKS):
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def _types(blocks: DataFrame) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema}
    return f"grp {kinds['grp']}, trace_id {kinds['trace_id']}"


COLUMNS = ("grp", "trace_id", "first_pos", "own_from", "own_count", "syms")


def part_nodes(tries: Tries, part: int, blocks: DataFrame) -> DataFrame:
    """Deepest nodes of each trace's positions in one trie, ``(grp, trace_id, part, node)``, each once per trace."""
    shared = tries.parts[part]

    def run(batches):
        trie = shared.value
        for batch in _slices(batches):
            block, _, node = _walk(trie, batch)
            found = np.unique(block * len(trie) + node)
            found = found[found % len(trie) > 0]
            at = pa.array(found // len(trie))
            yield pa.RecordBatch.from_arrays(
                [batch.column("grp").take(at), batch.column("trace_id").take(at), pa.array(np.full(len(at), part, np.int32)), pa.array(found % len(trie))],
                names=["grp", "trace_id", "part", "node"],
            )

    return blocks.select(*COLUMNS).mapInArrow(run, f"{_types(blocks)}, part int, node long").distinct()


def trace_nodes(tries: Tries, blocks: DataFrame) -> DataFrame:
    """Deepest nodes of each trace's positions in all tries."""
    return reduce(DataFrame.unionByName, [part_nodes(tries, i, blocks) for i in range(len(tries.parts))])


def _rows_of(lists: pa.ListArray) -> np.ndarray:
    """Row of every entry of a list column; a NULL list has none."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(sizes)), sizes)


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of every entry of a list column."""
    return _rows_of(lists), lists.flatten().to_numpy(zero_copy_only=False)


def _lists(row: np.ndarray, rows: int, values: np.ndarray) -> pa.ListArray:
    """Values of ascending rows as a list column."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)), pa.array(values))


def score_step(patterns: int) -> int:
    """Traces whose scores by so many patterns make a batch."""
    return max(1, min(64, BATCH_SCORES // max(1, patterns)))


def trace_paths(tries: Tries, blocks: DataFrame) -> DataFrame:
    """What each trace reaches, ``(grp, trace_id, part, numbers, depths)``: patterns, by their numbers in the trie,
    of whose own nodes it reaches some, and how deep (see ``Starts``).

    These are few, since nodes that patterns share are told once: no more than the trace has positions and turns
    on their paths, however many patterns there are. They tell all scores of a trace.
    """
    bounded_batches(blocks.sparkSession)
    kinds = _types(blocks)

    def walk(part: int):
        shared = tries.parts[part]

        def run(batches):
            trie = shared.value
            for batch in _slices(batches):
                block, _, node = _walk(trie, batch)
                block, node = block[node > 0], node[node > 0]
                # The deepest own node of each pattern in a block.
                key, depth = block * len(trie.ids) + trie.owner[node], trie.depth[node]
                order = np.lexsort((depth, key))
                last = order[np.r_[key[order][1:] != key[order][:-1], True]] if len(order) else order
                at = pa.array(block[last])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("grp").take(at), batch.column("trace_id").take(at), pa.array(trie.owner[node[last]]), pa.array(depth[last])],
                    names=["grp", "trace_id", "number", "depth"],
                )

        return run

    def gather(part: int):
        shared = tries.starts[part]

        def run(batches):
            starts = shared.value
            for batch in _slices(batches):
                row, numbers = _flat(batch.column("numbers"))
                depths = _flat(batch.column("depths"))[1]
                ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
                found = [starts.reached(numbers[a:b], depths[a:b]) for a, b in zip(ends, ends[1:])]
                row = np.repeat(np.arange(batch.num_rows), [len(x) for x, _ in found])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("grp"), batch.column("trace_id"), pa.array(np.full(batch.num_rows, part, np.int32)),
                        *(_lists(row, batch.num_rows, np.concatenate(x).astype(np.int32)) for x in zip(*found)),
                    ],
                    names=["grp", "trace_id", "part", "numbers", "depths"],
                )

        return run

    found = []
    for part in range(len(tries.parts)):
        nodes = blocks.select(*COLUMNS).mapInArrow(walk(part), f"{kinds}, number int, depth int")
        deepest = nodes.groupBy("grp", "trace_id", "number").agg(F.max("depth").alias("depth"))
        both = F.collect_list(F.struct("number", "depth")).alias("__both")
        lists = deepest.groupBy("grp", "trace_id").agg(both).select("grp", "trace_id", F.col("__both.number").alias("numbers"), F.col("__both.depth").alias("depths"))
        found.append(lists.mapInArrow(gather(part), f"{kinds}, part int, numbers array<int>, depths array<int>"))
    return reduce(DataFrame.unionByName, found)


def trace_scores(tries: Tries, blocks: DataFrame) -> DataFrame:
    """Sparse rows ``(grp, trace_id, part, pattern_ids, scores)``: the patterns that a trace shares a start with.

    Made from ``trace_paths``, as many traces at a time as make ``BATCH_SCORES`` scores.
    """
    shared = tries.starts

    def run(batches):
        for batch, own, best in scored(batches, shared):
            at, which = np.nonzero(best)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("grp", "trace_id", "part")), _lists(at, batch.num_rows, own.ids[which]), _lists(at, batch.num_rows, best[at, which])],
                names=["grp", "trace_id", "part", "pattern_ids", "scores"],
            )

    return trace_paths(tries, blocks).mapInArrow(run, f"{_types(blocks)}, part int, pattern_ids array<bigint>, scores array<int>")


def scored(batches, starts: list):
    """Slices of batches of ``trace_paths``, each of one part, with the part's ``Starts`` and all scores of its rows."""
    for batch in batches:
        parts = batch.column("part").to_numpy(zero_copy_only=False)
        at = 0
        while at < batch.num_rows:
            own = starts[parts[at]].value
            step = score_step(len(own.ids))
            same = int(np.argmin(np.r_[parts[at : at + step] == parts[at], False]))
            rows = batch.slice(at, same)
            row, numbers = _flat(rows.column("numbers"))
            yield rows, own, own.scores(row, numbers, _flat(rows.column("depths"))[1], same)
            at += same


# Rows of a batch of single matches, and blocks whose matches are put together.
MATCH_ROWS = 1 << 17
MATCH_BLOCKS = 64


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of the runs of equal keys. A run ends with a multiple of eight rows, what is left is one of its own."""
    fresh = np.any([np.r_[True, k[1:] != k[:-1]] for k in keys], axis=0)
    heads = np.flatnonzero(fresh)
    sizes = np.diff(np.r_[heads, len(fresh)])
    most = sizes // 8 * 8
    heads, sizes = np.stack([heads, heads + most], axis=1).ravel(), np.stack([most, sizes - most], axis=1).ravel()
    return heads[sizes > 0], sizes[sizes > 0]


def _pairs(heads: np.ndarray, sizes: np.ndarray, low: np.ndarray, high: np.ndarray):
    """Every row of each run with every number from its ``low`` up to its ``high``, at most about ``MATCH_ROWS`` at a time.

    The rows of a run come again for number after number. Stored in columns, the numbers are runs then and the rows
    repeat bit by bit, if there are a multiple of eight of them, which takes a small part of the room.
    """
    step = np.maximum(1, MATCH_ROWS // sizes)
    pieces = -(-np.maximum(high - low, 0) // step)
    run = np.repeat(np.arange(len(heads)), pieces)
    start = low[run] + (np.arange(len(run)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * step[run]
    many = np.minimum(step[run], high[run] - start)
    rows = many * sizes[run]
    cuts = np.flatnonzero(np.diff(np.cumsum(rows) // MATCH_ROWS)) + 1 if len(run) else []
    for at, to in zip([0, *cuts], [*cuts, len(run)]):
        if at == to:
            continue
        n = rows[at:to]
        piece = np.repeat(np.arange(at, to), n)
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        size = sizes[run[piece]]
        yield heads[run[piece]] + within % size, start[piece] + within // size


def position_matches(tries: Tries, blocks: DataFrame, whole: bool = False) -> DataFrame:
    """``(grp, trace_id, pos, pattern_id, match_len)``: how far each pattern matches from each position, from 1 on.

    ``whole`` keeps the matches of whole patterns only. There are as many rows as matches.
    """

    def walk(shared):
        def run(batches):
            trie = shared.value
            # Patterns in the order of their paths, so that those below a node are neighbours.
            order, first, last = _path_order(trie)
            ending = np.argsort(trie.ends, kind="stable")
            ends = trie.ends[ending]
            for batch in _slices(batches, MATCH_BLOCKS):
                block, pos, node = _walk(trie, batch)
                came = np.zeros(len(node), np.int64)  # the node below, whose patterns match further
                while True:
                    on = np.flatnonzero(node > 0)
                    if not len(on):
                        break
                    # Places that have come the same way lie together: they match the same patterns.
                    on = on[np.lexsort((came[on], node[on]))]
                    block, pos, node, came = block[on], pos[on], node[on], came[on]
                    heads, sizes = _runs(node, came)
                    top, below = node[heads], came[heads]
                    if whole:
                        spans = [(np.searchsorted(ends, top, "left"), np.searchsorted(ends, top, "right"))]
                        table = ending
                    else:
                        # The patterns below this node but not below the one that was left.
                        a, b = first[top], last[top]
                        c = np.where(below > 0, first[below], b)
                        d = np.where(below > 0, last[below], b)
                        spans, table = [(a, c), (d, b)], order
                    for low, high in spans:
                        for row, which in _pairs(heads, sizes, low, high):
                            who = pa.array(block[row])
                            yield pa.RecordBatch.from_arrays(
                                [batch.column("grp").take(who), batch.column("trace_id").take(who), pa.array(pos[row]), pa.array(trie.ids[table[which]]), pa.array(trie.depth[node[row]].astype(np.int32))],
                                names=["grp", "trace_id", "pos", "pattern_id", "match_len"],
                            )
                    came, node = node, trie.parent[node].astype(np.int64)

        return run

    schema = f"{_types(blocks)}, pos long, pattern_id long, match_len int"
    found = [blocks.select(*COLUMNS).mapInArrow(walk(shared), schema) for shared in tries.parts]
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    return rows


def _path_order(trie: Trie) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Patterns in an order where those below each node are a run, and the run of each node."""
    below = np.bincount(trie.ends, minlength=len(trie)).astype(np.int64)
    own = below.copy()
    for a, b in reversed(list(zip(trie.levels[1:], [*trie.levels[2:], len(trie)]))):
        np.add.at(below, trie.parent[a:b], below[a:b])
    first = np.zeros(len(trie), np.int64)
    for a, b in zip(trie.levels[1:], [*trie.levels[2:], len(trie)]):
        # Children of one parent lie side by side: its own patterns come first, then theirs.
        before = np.cumsum(below[a:b]) - below[a:b]
        parents = trie.parent[a:b]
        heads = np.r_[True, parents[1:] != parents[:-1]] if b > a else np.empty(0, bool)
        base = before[heads][np.cumsum(heads) - 1] if b > a else before
        first[a:b] = first[parents] + own[parents] + before - base
    order = np.argsort(first[trie.ends], kind="stable")
    return order, first, first + below
