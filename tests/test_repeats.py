import random

import pytest
from pyspark.sql import functions as F

import brute
from tracemill.operators import longrepeats, repeats, substrings, suffixes
from tracemill.operators.dictionary import encode
from tracemill.operators.joins import join_spread
from tracemill.plans import pipeline


def random_traces(seed, alphabet=3, groups=2, traces=4, longest=25):
    r = random.Random(seed)
    out = {}
    for g in range(groups):
        for t in range(traces):
            s = [r.randint(1, alphabet) for _ in range(r.randint(0, longest))]
            if t and r.random() < 0.5:  # a copied passage
                other = out[(g, g * 100 + t - 1)]
                s = s[:5] + other[2:20] + s[5:]
            out[(g, g * 100 + t)] = s
    return out


def test_supermaximal_golden(tokens):
    df = tokens({(0, 0): [4, 1, 2, 3, 4, 1, 2, 3, 2, 2]})
    found = [(tuple(r.gram), r.n_occ) for r in repeats.supermaximal_repeats(df, 6).collect()]
    assert found == [((4, 1, 2, 3), 2)]
    places = repeats.occurrences(df, longrepeats.supermaximal_repeats(df))
    assert sorted(r.pos for r in places.collect()) == [0, 4]
    near = repeats.near_supermaximal_repeats(repeats.repeat_profile(df, 6), 50)
    got = {tuple(r.gram): (r.n_occ, r.n_witness, r.percent) for r in near.collect()}
    assert got[(2,)] == (4, 2, 50)
    assert got[(4, 1, 2, 3)] == (2, 2, 100)


def test_shared_filter_golden(tokens):
    two = tokens({(0, 0): [1, 2, 3, 9], (0, 1): [8, 1, 2, 3]})
    kept = repeats.shared_repeats(repeats.supermaximal_repeats(two, 5)).collect()
    assert [(tuple(r.gram), r.n_traces) for r in kept] == [((1, 2, 3), 2)]
    one = tokens({(0, 0): [1, 2, 3, 7, 1, 2, 3]})
    assert repeats.shared_repeats(repeats.supermaximal_repeats(one, 5)).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_bounded_against_definition(tokens, seed):
    traces = random_traces(seed)
    df = tokens(traces)
    found = repeats.supermaximal_repeats(df, 60).collect()
    full = repeats.repeat_profile(df, 60).collect()
    for g in (0, 1):
        want = brute.supermaximal(traces, g)
        got = {tuple(r.gram): (r.n_occ, r.n_traces) for r in found if r.grp == g}
        assert got == {w: (len(p), len({t for t, _ in p})) for w, p in want.items()}
        got = {tuple(r.gram): (r.n_occ, r.n_left, r.n_right, r.n_witness) for r in full if r.grp == g}
        assert got == brute.profile(traces, g)


@pytest.mark.parametrize("seed,heavy,width", [(1, 10_000_000, 0), (4, 3, 0), (5, 0, 64), (6, 0, 64), (7, 0, 4)])
def test_any_length_against_definition(spark, tokens, seed, heavy, width):
    """By doubling (the second run treats nearly every name as hot, which salts all joins), by sorted
    windows, and by windows that repeats fill."""
    traces = random_traces(seed, alphabet=2 + seed % 2)
    df = tokens(traces)
    found = (longrepeats.long_repeats(df, width=width) if width else longrepeats.doubling_repeats(df, heavy_rows=heavy)).collect()
    assert ("gram" in found[0]) == (width == 64)
    for g in (0, 1):
        want = {}
        for w, (n, _, _, wit) in brute.profile(traces, g).items():
            if wit:
                places = brute.occurrences(traces, g)[w]
                want[w] = (n, len({t for t, _ in places}), wit)
        got = {}
        for r in found:
            if r.grp == g:
                w = tuple(traces[(g, r.trace_id)][r.pos : r.pos + r.len])
                assert w not in got
                got[w] = (r.n_occ, r.n_traces, r.n_witness)
        assert got == want


def test_runs_over_many_partitions(spark, tokens, monkeypatch):
    """Equal windows in more partitions than one, three bytes a symbol, and one group with next to nothing."""
    monkeypatch.setattr(suffixes, "PARTITION_ROWS", 7)
    big = 70_000
    traces = {(0, t): [big, 1, 2] * 5 + [t + 5] for t in range(8)} | {(0, 90): [3] * 12, (0, 91): [3] * 12, (1, 200): [4, 4]}
    df = tokens(traces)
    found = longrepeats.long_repeats(df).collect()
    for g in (0, 1):
        want = {w: (n, wit) for w, (n, _, _, wit) in brute.profile(traces, g).items() if wit}
        assert {tuple(r.gram): (r.n_occ, r.n_witness) for r in found if r.grp == g} == want
    assert all(tuple(traces[(r.grp, r.trace_id)][r.pos : r.pos + r.len]) == tuple(r.gram) for r in found)


def test_any_length_without_repeats(tokens):
    assert longrepeats.long_repeats(tokens({(0, 0): [1, 2, 3]})).count() == 0


def test_long_copies(tokens):
    """Two copies far longer than any bound."""
    r = random.Random(5)
    passage = [r.randint(1, 50) for _ in range(600)]
    df = tokens({(0, 0): [101] + passage + [102], (0, 1): [103, 104] + passage})
    best = longrepeats.long_repeats(df).orderBy(F.desc("len")).first()
    assert (best.len, best.trace_id, best.pos, best.n_occ, best.n_traces) == (600, 0, 1, 2, 2)
    bound = repeats.longest_repeat(df, 8).collect()
    assert [r.reached for r in bound] == [True]


def test_patterns_of_any_length_are_learned(spark):
    """A repeat of 3,000 symbols, longer than a block, through the entry point."""
    r = random.Random(7)
    passage = [f"s{r.randint(1, 60)}" for _ in range(3000)]
    rows = [("g", t, i, s) for t, seq in ((0, ["a", *passage, "b"]), (1, ["c", "d", *passage])) for i, s in enumerate(seq)]
    calls = spark.createDataFrame(rows, "grp string, trace_id long, pos long, sym string")
    learned = pipeline.learn_patterns(calls)
    best = learned.patterns.orderBy(F.desc("len")).first()
    assert best.len == len(best.gram) == 3000 and best.n_traces == 2
    coded = encode(calls, learned.dictionary).select("grp", "trace_id", "pos", "sym_id")
    places = repeats.occurrences(coded, learned.patterns.where("len = 3000")).collect()
    assert sorted((x.trace_id, x.pos) for x in places) == [(0, 1), (1, 2)]


def test_contexts_and_profiles_without_a_bound(tokens):
    traces = random_traces(9)
    df = tokens(traces)
    full = repeats.repeat_profile(df).collect()
    contexts = repeats.context_histogram(df).groupBy("grp", "gram").agg(F.sum("n").alias("n")).collect()
    for g in (0, 1):
        want = brute.profile(traces, g)
        assert {tuple(r.gram): (r.n_occ, r.n_left, r.n_right, r.n_witness) for r in full if r.grp == g} == want
        assert {tuple(r.gram): r.n for r in contexts if r.grp == g} == {w: v[0] for w, v in want.items()}


def test_blocks_do_not_change_the_result(tokens):
    """One trace over several blocks: repeats across the seams are found once."""
    r = random.Random(6)
    s = [r.randint(1, 4) for _ in range(2600)]
    df = tokens({(0, 0): s})
    got = {tuple(x.gram): x.n_occ for x in substrings.ngrams(df, 3, 3).collect()}
    want = {}
    for i in range(len(s) - 2):
        want[tuple(s[i : i + 3])] = want.get(tuple(s[i : i + 3]), 0) + 1
    assert got == want
    hist = repeats.context_histogram(df, 2, 2).groupBy().agg(F.sum("n")).first()[0]
    assert hist == len(s) - 1


def test_join_spread_keeps_all_rows(spark):
    left = spark.range(1000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 2).alias("k"), "id")
    right = spark.createDataFrame([(0, 400, "a"), (1, 5, "b")], "k long, n long, v string")
    plain = left.join(right, "k", "left").select("id", "v")
    salted = join_spread(left, right, ["k"], "n", ["id"], how="left", heavy_rows=10).select("id", "v")
    assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, salted.collect()), key=str)
    inner = join_spread(left, right, ["k"], "n", ["id"], heavy_rows=10)
    assert inner.count() == left.where("k IS NOT NULL").count()


def test_doubling_takes_only_what_full_windows_cover(tokens, monkeypatch):
    r = random.Random(11)
    passage = [r.randint(1, 4) for _ in range(23)]
    traces = {(0, t): [r.randint(1, 4) for _ in range(60)] for t in range(6)}
    traces[(0, 1)][10:33], traces[(0, 4)][30:53], traces[(0, 5)][:19] = passage, passage, passage[4:]
    df = tokens(traces)
    sizes, doubling = [], longrepeats.doubling_repeats

    def counted(some, *rest):
        sizes.append(some.count())
        return doubling(some, *rest)

    monkeypatch.setattr(longrepeats, "doubling_repeats", counted)
    columns = ("grp", "len", "trace_id", "pos", "n_occ", "n_traces", "n_witness", "percent")
    found = longrepeats.long_repeats(df, width=8)
    assert 0 < sizes[0] < 200
    want = {tuple(x) for x in doubling(df).select(*columns).collect()}
    assert {tuple(x) for x in found.select(*columns).collect()} == want
