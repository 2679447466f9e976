"""Repeats of any length, by doubling.

Every position gets a *name* for the 1, 2, 4, 8, ... symbols that start there: two
positions of a group have the same name exactly when those symbols are equal. The name
of twice the length follows from two names, so each step is one join and one count, and
positions whose symbols occur only once drop out. Going back down the lengths, each
position extends its match by the largest step that still occurs twice, which gives the
longest repeated match of every position after log2(longest) steps.

Rows have a fixed width whatever the length of a repeat, and all keys are positions or
names; names with many positions are salted.

Matches shorter than a window come from the sorted windows of ``tracemill.operators.suffixes``. Doubling is
left with the positions that the longer ones cover: all occurrences of a repeat that fills a window lie there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.operators.blocks import as_text
from tracemill.operators.joins import HEAVY_ROWS, join_spread
from tracemill.operators.suffixes import WIDTH, Matches, window_matches, window_repeats
from tracemill.session import durable, forget


def _name_levels(places: DataFrame, heavy_rows: int) -> list[DataFrame]:
    """Per level the positions whose ``2 ** level`` symbols occur twice: ``(trace_id, pos, gid, name)``."""
    levels = []
    keyed, keys = places, ["grp", "sym_id"]
    while True:
        classes = durable(keyed.groupBy(*keys).agg(F.min("gid").alias("name"), F.count(F.lit(1)).alias("n")).where("n >= 2"))
        named = join_spread(keyed, classes, keys, "n", ["gid"], heavy_rows=heavy_rows, stored=True)
        level = durable(named.select("trace_id", "pos", "gid", "name"))
        forget(classes, *([keyed] if levels else []))
        if level.isEmpty():
            forget(level)
            return levels
        levels.append(level)
        step = 1 << (len(levels) - 1)
        following = level.select("trace_id", (F.col("pos") - step).alias("pos"), F.col("name").alias("second"))
        keyed, keys = durable(level.withColumnRenamed("name", "first").join(following, ["trace_id", "pos"])), ["first", "second"]


def _longest_matches(places: DataFrame, levels: list[DataFrame], heavy_rows: int) -> DataFrame:
    """Length and class of the longest repeated match at each position: ``(grp, trace_id, pos, gid, len, cur)``.

    ``(len, cur)`` names the symbols matched so far. A position that cannot make the step of
    ``2 ** level`` symbols may still share fewer symbols with those that made it. One of them
    therefore stays behind as a stand-in that counts for two.
    """
    node = ["grp", "len", "cur"]
    keys = [*node, "following"]
    state = places.select(
        "grp", "trace_id", "pos", "gid",
        F.lit(0).cast("long").alias("len"), F.lit(-1).cast("long").alias("cur"), F.lit(False).alias("stand_in"),
    )
    before: tuple[DataFrame, ...] = ()  # what ``state`` is read from
    for number in range(len(levels) - 1, -1, -1):
        ahead = levels[number].select("trace_id", F.col("pos").alias("ahead"), F.col("name").alias("following"))
        tried = durable(
            state.withColumn("ahead", F.col("pos") + F.col("len")).join(ahead, ["trace_id", "ahead"], "left").drop("ahead")
        )
        forget(*before)
        classes = durable(
            tried.where("following IS NOT NULL")
            .groupBy(*keys)
            .agg(
                F.min(F.struct("gid", "trace_id", "pos")).alias("first"),
                F.count(F.lit(1)).alias("n"),
                F.sum(F.when(F.col("stand_in"), 2).otherwise(1)).alias("weight"),
                F.bool_or(~F.col("stand_in")).alias("wanted"),
            )
            .where("weight >= 2")
        )
        steps = classes.where("wanted").select(*keys, "n", F.col("first.gid").alias("longer"))
        joined = join_spread(tried, steps, keys, "n", ["gid"], how="left", heavy_rows=heavy_rows, stored=True)
        grows = F.col("longer").isNotNull()
        moved = joined.where(grows | ~F.col("stand_in")).select(
            "grp", "trace_id", "pos", "gid",
            F.when(grows, F.col("len") + (1 << number)).otherwise(F.col("len")).alias("len"),
            F.coalesce("longer", "cur").alias("cur"),
            "stand_in",
        )
        stay = classes.select(
            "grp", "first.trace_id", "first.pos", "first.gid", "len", "cur", F.lit(True).alias("stand_in")
        )
        state, before = moved.unionByName(stay), (tried, classes)
    found = durable(state.where("NOT stand_in").drop("stand_in"))
    forget(*before)
    return found


def long_repeats(tokens: DataFrame, heavy_rows: int = HEAVY_ROWS, width: int = WIDTH) -> DataFrame:
    """All repeats with a witness, of any length; see ``doubling_repeats`` for the columns.

    Repeats shorter than a window (``width`` symbols, or fewer if they are wide) come from the sorted windows of the positions, longer ones by doubling
    over what the windows' full matches cover. The rows are those that doubling gives for the whole table, which
    is what is done where places come twice. Without longer ones there is a further column ``gram``.
    """
    tokens = durable(tokens.select("grp", "trace_id", "pos", "sym_id"))
    matches = window_matches(tokens, width)
    if not matches.filled:
        return window_repeats(matches)
    if _places_repeat(tokens):
        return doubling_repeats(tokens, heavy_rows)
    width = matches.coding.width
    longer = doubling_repeats(_covered(tokens, matches), heavy_rows).where(F.col("len") >= width)
    return window_repeats(matches).drop("gram").unionByName(longer)


def _places_repeat(tokens: DataFrame) -> bool:
    """Whether a place comes more than once or has no key; windows stand for single symbols of known places."""
    return not tokens.groupBy("trace_id", "pos").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR trace_id IS NULL OR pos IS NULL").isEmpty()


def _covered(tokens: DataFrame, matches: Matches) -> DataFrame:
    """The tokens that matches of a full window cover, and some next to them.

    Every window of a repeat that fills one is itself a full match, so all occurrences of such repeats are covered
    from end to end, and their longest matches are the same among these tokens alone. Traces are cut into pieces of
    a window's width: a full match lies in its own piece and the next.
    """
    width = matches.coding.width
    piece = F.floor(F.col("pos") / width)
    full = matches.places.where(F.col("len") >= width).select("trace_id", piece.alias("__piece")).distinct()
    wanted = full.select("trace_id", F.explode(F.array(F.col("__piece"), F.col("__piece") + 1)).alias("__piece"))
    return tokens.where(F.col("grp").isNotNull()).withColumn("__piece", piece).join(wanted, ["trace_id", "__piece"], "left_semi").drop("__piece")


def doubling_repeats(tokens: DataFrame, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """All repeats with a witness, of any length.

    Returns ``(grp, len, trace_id, pos, n_occ, n_traces, n_witness, percent)``; a repeat is given by
    its length and its first place. ``n_witness = n_occ`` are the supermaximal repeats,
    ``percent`` selects the near-supermaximal ones.

    An occurrence is a witness when neither it nor its left extension has a longer repeated
    match, that is, when the match of the position before is not longer than its own.
    """
    places = durable(tokens.select("grp", "trace_id", "pos", "sym_id", F.monotonically_increasing_id().alias("gid")))
    levels = _name_levels(places, heavy_rows)
    if not levels:
        empty = places.limit(0).select("grp", F.lit(0).cast("long").alias("len"), "trace_id", "pos")
        zero = F.lit(0).cast("long")
        return empty.select("*", *[zero.alias(c) for c in ("n_occ", "n_traces", "n_witness")], F.lit(0).alias("percent"))
    state = _longest_matches(places, levels, heavy_rows)

    before = state.select("trace_id", (F.col("pos") + 1).alias("pos"), F.col("len").alias("len_before"))
    witnesses = state.join(before, ["trace_id", "pos"], "left").where(
        (F.col("len") >= 1) & (F.coalesce("len_before", F.lit(0)) <= F.col("len"))
    )
    found = durable(
        witnesses.groupBy("grp", "len", "cur").agg(
            F.count(F.lit(1)).alias("n_witness"), F.min(F.struct("trace_id", "pos")).alias("place")
        )
        # The level whose two names, at the start and at the end, identify the repeat.
        .withColumn("level", F.floor(F.log2("len")).cast("int"))
        .select("grp", "len", "cur", "n_witness", "place.trace_id", "place.pos", "level")
        .withColumn("shift", F.expr("len - shiftleft(CAST(1 AS BIGINT), level)"))
    )
    # Stored as one table, and the steps below one by one: a plan over all levels at once is a burden for the driver.
    names = durable(
        reduce(
            DataFrame.unionByName,
            [level.select(F.lit(i).alias("level"), "trace_id", "pos", "name") for i, level in enumerate(levels)],
        )
    )
    forget(*levels, places)
    at_start = names.withColumnRenamed("name", "first")
    at_end = names.select("level", "trace_id", F.col("pos").alias("end"), F.col("name").alias("second"))
    wanted = durable(
        found.join(at_start, ["level", "trace_id", "pos"])
        .withColumn("end", F.col("pos") + F.col("shift"))
        .join(at_end, ["level", "trace_id", "end"])
        .drop("end")
    )
    # Every position of a class looks for the lengths of the repeats that start with this class, as
    # far as its own longest match reaches.
    sizes = at_start.groupBy("level", "first").agg(F.count(F.lit(1)).alias("n"))
    shifts = durable(wanted.select("level", "first", "shift").distinct().join(sizes, ["level", "first"]))
    reach = at_start.join(state.select("trace_id", "pos", F.col("len").alias("reach")), ["trace_id", "pos"])
    tried = (
        join_spread(reach, shifts, ["level", "first"], "n", ["trace_id", "pos"], heavy_rows=heavy_rows, stored=True)
        .where("shift + shiftleft(CAST(1 AS BIGINT), level) <= reach")
        .withColumn("end", F.col("pos") + F.col("shift"))
        .join(at_end, ["level", "trace_id", "end"])
    )
    counted = durable(
        tried.groupBy("level", "first", "shift", "second", "trace_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("level", "first", "shift", "second")
        .agg(F.sum("n").alias("n_occ"), F.count(F.lit(1)).alias("n_traces"))
    )
    forget(names, state, found, shifts)
    return wanted.join(counted, ["level", "first", "shift", "second"]).select(
        "grp", "len", "trace_id", "pos", "n_occ", "n_traces", "n_witness",
        F.expr("CAST(100 * n_witness DIV n_occ AS INT)").alias("percent"),
    )


def spell(repeats: DataFrame, tokens: DataFrame) -> DataFrame:
    """The symbols of each repeat in long form: ``(grp, len, trace_id, pos, k, sym_id)``, k from 0."""
    steps = repeats.select(
        "grp", "len", "trace_id", "pos", F.explode(F.sequence(F.lit(0).cast("long"), F.col("len") - 1)).alias("k")
    ).withColumn("at", F.col("pos") + F.col("k"))
    symbols = tokens.select("trace_id", F.col("pos").alias("at"), "sym_id")
    return steps.join(symbols, ["trace_id", "at"]).drop("at")


def spelled(repeats: DataFrame, tokens: DataFrame) -> DataFrame:
    """Adds ``gram`` (the symbols, one array as long as the repeat), if it is not there, and ``pattern``."""
    if "gram" in repeats.columns:
        return repeats.withColumn("pattern", as_text("gram"))
    keys = ["grp", "len", "trace_id", "pos"]
    letters = F.sort_array(F.collect_list(F.struct("k", "sym_id")))
    words = spell(repeats, tokens).groupBy(*keys).agg(letters.alias("__s"))
    named = words.withColumn("gram", F.col("__s.sym_id")).drop("__s").withColumn("pattern", as_text("gram"))
    return repeats.join(named, keys)


def supermaximal_repeats(tokens: DataFrame, heavy_rows: int = HEAVY_ROWS, min_traces: int = 1, min_len: int = 1) -> DataFrame:
    """Repeats of any length that no longer repeat contains: ``(grp, len, gram, n_occ, n_traces)``.

    ``min_traces`` and ``min_len`` are applied before the repeats are spelled out.
    """
    tokens = durable(tokens)
    found = durable(
        long_repeats(tokens, heavy_rows).where(
            (F.col("n_witness") == F.col("n_occ")) & (F.col("n_traces") >= min_traces) & (F.col("len") >= min_len)
        )
    )
    return spelled(found, tokens).select("grp", F.col("len").cast("int").alias("len"), "gram", "n_occ", "n_traces")


def longest_matches(tokens: DataFrame, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Length of the longest repeated match of each position, ``(trace_id, pos, len)``; 0 or no row if there is none.

    ``tokens`` is a stored table; rows without a group have no match.
    """
    matches = window_matches(tokens)
    found = matches.places.select("trace_id", "pos", "len")
    if not matches.filled:
        return found
    if _places_repeat(tokens):
        return _doubled_matches(tokens, heavy_rows)
    width = matches.coding.width
    longer = _doubled_matches(_covered(tokens, matches), heavy_rows).where(F.col("len") >= width)
    return found.where(F.col("len") < width).unionByName(longer)


def _doubled_matches(tokens: DataFrame, heavy_rows: int) -> DataFrame:
    """Longest matches by doubling alone, ``(trace_id, pos, len)``."""
    places = durable(tokens.select("grp", "trace_id", "pos", "sym_id", F.monotonically_increasing_id().alias("gid")))
    levels = _name_levels(places, heavy_rows)
    found = _longest_matches(places, levels, heavy_rows).select("trace_id", "pos", "len")
    forget(places, *levels)
    return found


def longest_repeated(tokens: DataFrame, heavy_rows: int = HEAVY_ROWS) -> int:
    """Length of the longest repeat of any group; 0 if nothing repeats."""
    tokens = durable(tokens.select("grp", "trace_id", "pos", "sym_id"))
    return longest_matches(tokens, heavy_rows).agg(F.max("len")).head()[0] or 0
