"""Continuous detection: one verdict per trace once its end has been seen, or once it has been idle.

All prefixes that the rules ask for are one automaton after Aho and Corasick: the trie of the prefixes with
a failure link from every node to the longest other node that its symbols end with. One node is the whole
state of a trace, however many prefixes there are.

Two streaming queries with a table between them:

1. Events are keyed by ``(trace_id, block)``. A block owns ``block_size`` positions and also receives the
   first positions of the next block, as many as a prefix may reach over. The automaton advances over the
   block in position order; early events wait in the state. A trace of any length is thereby spread over
   many keys, and a state holds at most one block.
2. The hits are keyed by ``trace_id``, a few rows per block, and joined until all blocks up to the end event
   are complete. Then the rules decide.

Events may arrive in any order and more than once: a block that is complete and a trace that has its
verdict stay known, as one small state each, and ignore what comes late. With ``idle``, a block without
events for that time is closed, and a trace all of whose blocks are closed and that has shown no end for
that time again gets the verdict of what was seen (``ended`` is false).
"""

from __future__ import annotations

import functools
import io
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracemill.operators.rules import detector_lengths, tree_verdict
from tracemill.operators.trie import PART_SYMBOLS, Trie, build_tries
from tracemill.session import file_system, shared_folder

EVENTS_SCHEMA = "trace_id long, pos long, sym_id int, is_end boolean"
HITS_SCHEMA = "trace_id long, block long, hits array<int>, complete boolean, idle boolean, end_pos long"
DONE_SCHEMA = "trace_id long, pattern_ids array<bigint>, scores array<int>, ended boolean"
BLOCK_SIZE = 4096


class Automaton:
    """A trie with failure links; ``goals`` are the numbers of the prefixes that end at a node."""

    def __init__(self, trie: Trie) -> None:
        self.trie = trie
        n = len(trie)
        self.fail = np.zeros(n, np.int64)
        for a, b in zip(trie.levels[2:], [*trie.levels[3:], n]):
            # Children look where their parent's link leads, level after level.
            nodes = np.arange(a, b)
            links = self.fail[trie.parent[a:b]]
            while len(nodes):
                down = trie.step(links, trie.symbol[nodes])
                found = down >= 0
                self.fail[nodes[found]] = down[found]
                go_on = ~found & (links > 0)
                nodes, links = nodes[go_on], self.fail[links[go_on]]
        # The nearest node on the chain of links, the node itself included, where a prefix ends; 0 if none.
        ends = np.zeros(n, bool)
        ends[trie.ends] = True
        ends[0] = False
        self.hit = np.where(ends, np.arange(n), 0)
        for a, b in zip(trie.levels[1:], [*trie.levels[2:], n]):
            open_ = np.arange(a, b)[~ends[a:b]]
            self.hit[open_] = self.hit[self.fail[open_]]
        order = np.argsort(trie.ends, kind="stable")
        self.goal_ids, self.goal_ends = trie.ids[order], trie.ends[order]

    def store(self, uri: str) -> None:
        """Writes the automaton as one file of arrays."""
        data = io.BytesIO()
        np.savez(data, **self.trie.arrays(), fail=self.fail, hit=self.hit, goal_ids=self.goal_ids, goal_ends=self.goal_ends)
        system, path = file_system(uri)
        system.create_dir(os.path.dirname(path), recursive=True)
        with system.open_output_stream(path) as out:
            out.write(data.getvalue())

    @classmethod
    def load(cls, uri: str) -> "Automaton":
        system, path = file_system(uri)
        with system.open_input_stream(path) as source:
            arrays = dict(np.load(io.BytesIO(source.read())))
        automaton = cls.__new__(cls)
        automaton.trie = Trie.from_arrays(arrays)
        for name in ("fail", "hit", "goal_ids", "goal_ends"):
            setattr(automaton, name, arrays[name])
        return automaton

    def goals(self, node: int) -> list[int]:
        a, b = np.searchsorted(self.goal_ends, [node, node + 1])
        return self.goal_ids[a:b].tolist()

    def advance(self, node: int, codes: list[int], known: set[int]) -> tuple[int, list[int]]:
        """The node after some symbols, and the nodes newly hit on the way, which join ``known``."""
        trie, fail, hit, new = self.trie, self.fail, self.hit, []
        dense = trie.dense
        for code in codes:
            if code < 0:
                node = 0
                continue
            while True:
                down = dense[node * trie.width + code] if dense is not None else trie.step(np.array([node]), np.array([code]))[0]
                if down >= 0 or not node:
                    break
                node = fail[node]
            node = max(int(down), 0)
            at = int(hit[node])
            while at and at not in known:  # what is known has had its own chain reported
                known.add(at)
                new.append(at)
                at = int(hit[fail[at]])
        return node, new


@functools.lru_cache(maxsize=8)
def stored_automaton(uri: str) -> Automaton:
    """An automaton, read once per worker."""
    return Automaton.load(uri)


class Detectors:
    """The automata of all prefixes of a rule set, as files in the shared folder; one unless the prefixes are very many."""

    def __init__(self, conditions: DataFrame, patterns: DataFrame, part_symbols: int = PART_SYMBOLS):
        wanted = (
            detector_lengths(conditions)
            .join(patterns.select("pattern_id", "gram"), "pattern_id")
            .where(F.size("gram") >= F.col("k"))
            .select("pattern_id", "k", F.slice("gram", F.lit(1), F.col("k")).alias("gram"))
        )
        # A goal is a prefix of a pattern; the rules, and so the goals, are a model.
        goals = wanted.orderBy("pattern_id", "k").toArrow()
        self.patterns = goals["pattern_id"].to_numpy()
        self.lengths = goals["k"].to_numpy()
        self.margin = int(self.lengths.max()) - 1 if len(self.lengths) else 0
        spark = patterns.sparkSession
        numbered = spark.createDataFrame(goals.select(["gram"]).append_column("pattern_id", [np.arange(goals.num_rows)])) if goals.num_rows else wanted.select("pattern_id", "gram")
        folder = f"{shared_folder(spark)}/automata-{uuid.uuid4().hex}"
        self.parts = []
        for i, trie in enumerate(build_tries(numbered, part_symbols)):
            self.parts.append(f"{folder}/{i}.npz")
            Automaton(trie).store(self.parts[-1])


def spread_events(events: DataFrame, margin: int, block_size: int = BLOCK_SIZE) -> DataFrame:
    """Sends each event to its block and, near the block's start, to the blocks before that reach so far."""
    block = F.floor(F.col("pos") / block_size)
    first = F.greatest(F.lit(0), F.floor((F.col("pos") - margin) / block_size))
    return events.withColumn("block", F.explode(F.sequence(F.least(first, block), block)))


class _Timed(StatefulProcessor):
    """A processor whose keys wake up after a time without rows."""

    def __init__(self, idle: str | None) -> None:
        self.idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None

    def rest(self, timers) -> None:
        """Sets the only timer of the key anew."""
        if self.idle_ms:
            self.wake()
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.idle_ms)

    def wake(self) -> None:
        if self.idle_ms:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)

    def close(self) -> None:
        pass


class BlockDetector(_Timed):
    """State of a block: how far it is, its end if known, a node per automaton, the nodes hit, waiting events."""

    SCHEMA = "at long, end_pos long, complete boolean, nodes array<long>, hit array<long>, waiting_pos array<long>, waiting_sym array<long>"

    def __init__(self, parts: list, margin: int, block_size: int, idle: str | None) -> None:
        super().__init__(idle)
        self.parts, self.margin, self.block_size = parts, margin, block_size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("block", self.SCHEMA)

    def row(self, key, hits, complete, idle, end_pos) -> pd.DataFrame:
        return pd.DataFrame({"trace_id": [int(key[0])], "block": [int(key[1])], "hits": [hits], "complete": [complete], "idle": [idle], "end_pos": [end_pos]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        start = int(key[1]) * self.block_size
        stop = start + self.block_size + self.margin
        n = len(self.parts)
        new_key = not self.state.exists()
        if new_key:
            at, end_pos, nodes, known, waiting = start, -1, [0] * n, [set() for _ in range(n)], {}
        else:
            at, end_pos, complete, nodes, hit, waiting_pos, waiting_sym = self.state.get()
            if complete:  # a repeated event
                for _ in rows:
                    pass
                return
            nodes, waiting = list(nodes), dict(zip(waiting_pos, waiting_sym))
            known = [set() for _ in range(n)]
            for h in hit:
                known[h % n].add(h // n)
        known_end = end_pos
        for frame in rows:
            ends = frame.loc[frame["is_end"], "pos"]
            if len(ends):
                end_pos = int(ends.iloc[0])
            calls = frame.loc[~frame["is_end"]]
            # The end rows have no symbol, which turns the column to floats.
            waiting.update((p, s) for p, s in zip(calls["pos"].tolist(), calls["sym_id"].astype("int64").tolist()) if p >= at)
        ready = []
        while at in waiting and at < stop:
            ready.append(waiting.pop(at))
            at += 1
        hits: list[int] = []
        for i, uri in enumerate(self.parts):
            automaton = stored_automaton(uri)
            codes = automaton.trie.codes(np.array(ready, np.int64)).tolist() if ready else []
            nodes[i], new = automaton.advance(int(nodes[i]), codes, known[i])
            for node in new:
                hits.extend(automaton.goals(node))
        complete = at == stop or 0 <= end_pos <= at
        if complete:
            self.state.update((at, end_pos, True, [], [], [], []))
            self.wake()
        else:
            hit = [h * n + i for i in range(n) for h in known[i]]
            self.state.update((at, end_pos, False, [int(x) for x in nodes], hit, list(waiting), list(waiting.values())))
            self.rest(timerValues)
        told_end = end_pos if end_pos != known_end else -1
        if hits or complete or told_end >= 0 or new_key:
            yield self.row(key, hits, bool(complete), False, end_pos)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists() and not self.state.get()[2]:
            yield self.row(key, [], False, True, self.state.get()[1])


class TraceDetector(_Timed):
    """State of a trace: the goals hit, complete and open blocks, its end if known, whether it has its verdict."""

    SCHEMA = "done boolean, hits array<int>, complete array<long>, open array<long>, end_pos long"

    def __init__(self, patterns: np.ndarray, lengths: np.ndarray, block_size: int, idle: str | None) -> None:
        super().__init__(idle)
        self.patterns, self.lengths, self.block_size = patterns, lengths, block_size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("trace", self.SCHEMA)

    def verdict(self, key, hits, ended: bool) -> pd.DataFrame:
        """The longest prefix seen of each pattern, as a sparse row of scores."""
        best: dict[int, int] = {}
        for h in hits:
            p = int(self.patterns[h])
            best[p] = max(best.get(p, 0), int(self.lengths[h]))
        self.state.update((True, [], [], [], -1))
        self.wake()
        ids = sorted(best)
        return pd.DataFrame({"trace_id": [int(key[0])], "pattern_ids": [ids], "scores": [[best[p] for p in ids]], "ended": [ended]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        hits, complete, open_, end_pos = set(), set(), set(), -1
        if self.state.exists():
            done, *rest = self.state.get()
            if done:
                for _ in rows:
                    pass
                return
            hits, complete, open_, end_pos = set(rest[0]), set(rest[1]), set(rest[2]), rest[3]
        for frame in rows:
            for block, found, whole, idle, end in zip(frame["block"], frame["hits"], frame["complete"], frame["idle"], frame["end_pos"]):
                hits.update(int(h) for h in found)
                (complete if whole else open_).add(int(block))
                if idle or whole:
                    open_.discard(int(block))
                end_pos = max(end_pos, int(end))
        if end_pos >= 0 and all(b in complete for b in range(end_pos // self.block_size + 1)):
            yield self.verdict(key, hits, True)
            return
        self.state.update((False, sorted(hits), sorted(complete), sorted(open_), end_pos))
        if open_:
            self.wake()
        else:
            self.rest(timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists() and not self.state.get()[0]:
            yield self.verdict(key, self.state.get()[1], False)


def block_hits(events: DataFrame, detectors: Detectors, block_size: int = BLOCK_SIZE, idle: str | None = None) -> DataFrame:
    """First query: newly hit prefixes per block and whether the block is complete."""
    processor = BlockDetector(detectors.parts, detectors.margin, block_size, idle)
    spread = spread_events(events, detectors.margin, block_size).groupBy("trace_id", "block")
    return spread.transformWithStateInPandas(processor, HITS_SCHEMA, "Append", "ProcessingTime" if idle else "None")


def finished_traces(hits: DataFrame, detectors: Detectors, block_size: int = BLOCK_SIZE, idle: str | None = None) -> DataFrame:
    """Second query: sparse scores of a trace over the prefixes asked for, once all its blocks are complete."""
    processor = TraceDetector(detectors.patterns, detectors.lengths, block_size, idle)
    return hits.groupBy("trace_id").transformWithStateInPandas(processor, DONE_SCHEMA, "Append", "ProcessingTime" if idle else "None")


def verdicts(done: DataFrame, conditions: DataFrame) -> DataFrame:
    """Scores to classes: ``(trace_id, verdict, ended)``.

    A hit of a prefix says that the pattern's score is at least its length, and none that it is less, which
    is all that the rules ask for.
    """
    return tree_verdict(done, conditions).select("trace_id", "verdict", "ended")


_STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run_available(
    spark: SparkSession,
    feed: str,
    folder: str,
    detectors: Detectors,
    conditions: DataFrame,
    block_size: int = BLOCK_SIZE,
    idle: str | None = None,
) -> DataFrame:
    """Processes all files of ``feed`` and returns the verdicts so far.

    ``folder`` keeps the checkpoints and the tables of both queries: run again after more files
    have arrived, or after a failure, it goes on where it stopped. With ``idle`` a run is one batch, in
    which the timers go off that are due.
    """
    spark.conf.set(*_STATE_STORE)  # states of several kinds and timers need it
    events = spark.readStream.schema(EVENTS_SCHEMA).option("maxFilesPerTrigger", 64).parquet(feed)
    _finish(block_hits(events, detectors, block_size, idle), f"{folder}/hits", f"{folder}/hits-checkpoint", bool(idle))
    hits = spark.readStream.schema(HITS_SCHEMA).parquet(f"{folder}/hits")
    _finish(finished_traces(hits, detectors, block_size, idle), f"{folder}/done", f"{folder}/done-checkpoint", bool(idle))
    return verdicts(spark.read.schema(DONE_SCHEMA).parquet(f"{folder}/done"), conditions)


def _finish(stream: DataFrame, table: str, checkpoint: str, once: bool) -> None:
    writer = stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append")
    # With timers there is always another batch to run: a single one ends.
    writer = writer.trigger(once=True) if once else writer.trigger(availableNow=True)
    writer.start().awaitTermination()
