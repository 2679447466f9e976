"""Repeats from the suffix order of windows.

Every position gets a *window*, the next ``WIDTH`` symbols or as many as ``WINDOW_BYTES`` hold, written so that bytes sort like symbols. The
windows of all groups are range-sorted; ties go on by place, so that equal windows never fill one task.
In this order a position's longest repeated match is shared with one of its two neighbours, and the
occurrences of a repeat are one run of rows. Each partition looks at its own rows:

* the longest match of each position, from its neighbours;
* for the repeat that a longest match spells, the rows of its run, counted by trace;
* the same for every prefix of the partition's first and last window, whose runs may go on next door.

Counts are added up by the repeat's symbols, so runs over several partitions need no further care; the
first and last rows of neighbouring partitions are compared in one small step. The whole costs two
shuffles of one row per position. Matches and repeats shorter than a window are exact; a match that fills
its window may be longer, and ``tracemill.operators.longrepeats`` follows those by doubling.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.operators.blocks import to_blocks
from tracemill.session import durable

WIDTH = 64
# Bytes of a window, of which every position has one: wide symbols make it shorter.
WINDOW_BYTES = 64
# Rows aimed at in a partition, which one task holds at a time.
PARTITION_ROWS = 1_000_000

PLACE, COUNT, EDGE = 0, 1, 2


@dataclass
class Coding:
    """Symbols as big-endian numbers from 1 on; 0 stands behind the end of a trace."""

    least: int
    size: int  # bytes of a symbol
    width: int = WIDTH

    @property
    def kind(self) -> str:
        return f">u{self.size}"

    def gram(self, column: str) -> Column:
        """The symbols of a coded repeat."""
        number = lambda k: F.conv(F.hex(F.substring(F.col(column), k * self.size + 1, F.lit(self.size))), 16, 10).cast("long")
        steps = F.sequence(F.lit(0), F.floor(F.length(column) / F.lit(self.size)).cast("int") - F.lit(1))
        return F.transform(steps, lambda k: (number(k) + F.lit(self.least - 1)).cast("int"))


def _windows(coding: Coding):
    """Blocks to ``(grp, trace_id, pos, win)``, one row per position that the block owns."""
    width = coding.width

    def run(batches):
        for batch in batches:
            flat = batch.column("syms").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum([len(s) for s in batch.column("syms")])
            for i in range(batch.num_rows):
                first, n = batch.column("own_from")[i].as_py() - 1, batch.column("own_count")[i].as_py()
                syms = flat[(ends[i - 1] if i else 0) : ends[i]]
                padded = np.zeros(len(syms) + width, coding.kind)
                padded[: len(syms)] = syms - (coding.least - 1)
                rows = np.lib.stride_tricks.sliding_window_view(padded, width)[first : first + n]
                size = width * coding.size
                data = pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), n, [None, pa.py_buffer(np.ascontiguousarray(rows).tobytes())])
                one = pa.array(np.zeros(n, np.int32))
                start = batch.column("first_pos")[i].as_py() + first
                yield pa.RecordBatch.from_arrays(
                    [batch.column("grp").slice(i, 1).take(one), batch.column("trace_id").slice(i, 1).take(one), pa.array(np.arange(start, start + n, dtype=np.int64)), data.cast(pa.binary())],
                    names=["grp", "trace_id", "pos", "win"],
                )

    return run


def common_lengths(windows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Symbols that each window shares with the one before; 0 for the first."""
    out = np.zeros(len(windows), np.int64)
    for at in range(1, len(windows), 65536):
        a, b = windows[at - 1 : at + 65535], windows[at : at + 65536]
        differs = a[: len(b)] != b
        shared = np.where(differs.any(axis=1), differs.argmax(axis=1), windows.shape[1])
        out[at : at + 65536] = np.minimum(shared, np.minimum(sizes[at - 1 : at + 65535][: len(b)], sizes[at : at + 65536]))
    return out


def _match(coding: Coding):
    """Sorted windows of a partition to places, counts and edges."""
    names = ["kind", "grp", "trace_id", "pos", "len", "code", "n", "part"]

    def batch_of(kind, groups, traces, pos, lens, codes, n, part):
        m = len(lens)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(m, kind, np.int32)), groups, traces, pa.array(pos, pa.int64()), pa.array(lens, pa.int64()),
                pa.array(codes, pa.binary()), pa.array(n, pa.int64()), pa.array(np.full(m, part, np.int32)),
            ],
            names=names,
        )

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        rows = pa.Table.from_batches(batches).combine_chunks()
        n, part = rows.num_rows, TaskContext.get().partitionId()
        raw = b"".join(rows["win"].to_pylist())
        windows = np.frombuffer(raw, coding.kind).reshape(n, coding.width)
        step = coding.width * coding.size
        code = lambda i, length: raw[i * step : i * step + length * coding.size]
        sizes = (windows != 0).sum(axis=1)
        shared = common_lengths(windows, sizes)
        groups, traces, pos = rows["grp"].combine_chunks(), rows["trace_id"].combine_chunks(), rows["pos"].to_numpy()
        numbers = lambda c: c.dictionary_encode().indices.to_numpy()
        group, who = numbers(groups), numbers(traces)
        shared[1:][group[1:] != group[:-1]] = 0
        matched = np.maximum(shared, np.r_[shared[1:], 0])

        inner = np.arange(1, n - 1)
        for at in range(0, len(inner), 100_000):
            pick = inner[at : at + 100_000]
            yield batch_of(PLACE, groups.take(pa.array(pick)), traces.take(pa.array(pick)), pos[pick], matched[pick], [code(i, m) for i, m in zip(pick.tolist(), matched[pick].tolist())], np.zeros(len(pick)), part)
        edges = np.unique([0, n - 1])
        yield batch_of(EDGE, groups.take(pa.array(edges)), traces.take(pa.array(edges)), pos[edges], matched[edges], [code(i, int(sizes[i])) for i in edges.tolist()], (edges > 0).astype(int), part)

        deepest = int(max(sizes[0], sizes[-1], matched.max()))
        used = np.unique(matched)
        for d in range(1, deepest + 1):
            starts = np.flatnonzero(shared < d)
            run_of = np.cumsum(shared < d) - 1
            wanted = np.zeros(len(starts), bool)
            if d in used:
                wanted[run_of[matched == d]] = True
            for i in (0, n - 1):
                if sizes[i] >= d:
                    wanted[run_of[i]] = True
            inside = np.flatnonzero(wanted[run_of])
            if not len(inside):
                continue
            key, count = np.unique(run_of[inside] * (int(who.max()) + 1) + who[inside], return_counts=True)
            # The first row of each (run, trace), for its trace; the run's first row, for its symbols.
            order = inside[np.argsort(run_of[inside] * (int(who.max()) + 1) + who[inside], kind="stable")]
            heads = order[np.r_[0, np.cumsum(count)[:-1]]]
            at = starts[run_of[heads]]
            for k in range(0, len(heads), 100_000):
                h = pa.array(heads[k : k + 100_000])
                yield batch_of(COUNT, groups.take(h), traces.take(h), np.zeros(len(h), np.int64), np.full(len(h), d), [code(i, d) for i in at[k : k + 100_000].tolist()], count[k : k + 100_000], part)

    return run


def _compare_edges(coding: Coding):
    """Edges of all partitions, in order, to places: first rows may match the last row before, and so on."""

    def run(batches):
        batches = list(batches)
        rows = [r for b in batches for r in b.to_pylist()]

        def shared(a, b):
            if a["grp"] != b["grp"]:
                return 0
            x, y = (np.frombuffer(r["code"], coding.kind) for r in (a, b))
            m = min(len(x), len(y))
            differs = x[:m] != y[:m]
            return int(differs.argmax()) if differs.any() else m

        for i, r in enumerate(rows):
            near = [rows[j] for j in (i - 1, i + 1) if 0 <= j < len(rows) and rows[j]["part"] != r["part"]]
            r["len"] = max([r["len"], *(shared(r, x) for x in near)])
            r["code"] = r["code"][: r["len"] * coding.size]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=batches[0].schema)

    return run


@dataclass
class Matches:
    """Longest matches of the windows of a token table.

    ``places (grp, trace_id, pos, len, code)`` has the longest repeated match of every position, cut at the
    window; ``counts (grp, code, trace_id, n)`` the occurrences of those matches (and of some others), to be
    added up. ``filled``: some match fills its window.
    """

    places: DataFrame
    counts: DataFrame
    coding: Coding
    filled: bool


def window_matches(tokens: DataFrame, width: int = WIDTH) -> Matches:
    """Longest matches and run counts of a *stored* token table."""
    tokens = tokens.where(F.col("grp").isNotNull())
    total, least, most = tokens.agg(F.count(F.lit(1)), F.min("sym_id"), F.max("sym_id")).first()
    span = most - least + 2 if total else 1
    size = 1 if span <= 1 << 8 else 2 if span <= 1 << 16 else 4
    width = max(1, min(width, WINDOW_BYTES // size))
    coding = Coding(least or 0, size, width)
    kinds = {f.name: f.dataType.simpleString() for f in tokens.schema}
    blocks = to_blocks(tokens, before=0, after=width)
    windows = blocks.select("grp", "trace_id", "first_pos", "own_from", "own_count", "syms").mapInArrow(
        _windows(coding), f"grp {kinds['grp']}, trace_id {kinds['trace_id']}, pos long, win binary"
    )
    parts = max(int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PARTITION_ROWS))
    order = ["grp", "win", "trace_id", "pos"]
    dealt = windows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    schema = f"kind int, grp {kinds['grp']}, trace_id {kinds['trace_id']}, pos long, len long, code binary, n long, part int"
    found = durable(dealt.mapInArrow(_match(coding), schema))
    # Two rows per partition.
    edges = found.where(F.col("kind") == EDGE).repartition(1).sortWithinPartitions("part", "n").mapInArrow(_compare_edges(coding), schema)
    places = found.where(F.col("kind") == PLACE).unionByName(edges).select("grp", "trace_id", "pos", "len", "code")
    filled = (places.agg(F.max("len")).first()[0] or 0) >= width
    return Matches(places, found.where(F.col("kind") == COUNT).select("grp", "code", "trace_id", "n"), coding, filled)


def window_repeats(matches: Matches) -> DataFrame:
    """All repeats with a witness that are shorter than a window, ``(grp, len, trace_id, pos, n_occ, n_traces,
    n_witness, percent, gram)``."""
    places, counts, coding = matches.places, matches.counts, matches.coding
    before = places.select("trace_id", (F.col("pos") + 1).alias("pos"), F.col("len").alias("len_before"))
    witnesses = places.join(before, ["trace_id", "pos"], "left").where(
        F.col("len").between(1, coding.width - 1) & (F.coalesce("len_before", F.lit(0)) <= F.col("len"))
    )
    classes = witnesses.groupBy("grp", "code").agg(
        F.count(F.lit(1)).alias("n_witness"), F.min(F.struct("trace_id", "pos")).alias("place"), F.first("len").alias("len")
    )
    per_trace = counts.groupBy("grp", "code", "trace_id").agg(F.sum("n").alias("n"))
    totals = per_trace.groupBy("grp", "code").agg(F.sum("n").alias("n_occ"), F.count(F.lit(1)).alias("n_traces"))
    return classes.join(totals, ["grp", "code"]).select(
        "grp", "len", "place.trace_id", "place.pos", "n_occ", "n_traces", "n_witness",
        F.expr("CAST(100 * n_witness DIV n_occ AS INT)").alias("percent"), coding.gram("code").alias("gram"),
    )
