"""Whitening, fill-in-the-middle and pieces, against brute force and the library."""

import hashlib
import os
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tracemill.llm import fim, pieces, queries, whiten

SMALL = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables not present")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- Whitening --------------------------------------------------------------------------------


@given(st.data())
@settings(max_examples=30, deadline=None)
def test_bit_planes_give_exact_products(data):
    n, d, bits = data.draw(st.integers(1, 200)), data.draw(st.integers(1, 5)), data.draw(st.integers(1, 64))
    rng = np.random.default_rng(data.draw(st.integers(0, 9)))
    rows = rng.integers(0, 2**bits - 1, (n, d), dtype=np.uint64, endpoint=True)
    sums, products = whiten.cross_products(rows)
    exact = rows.astype(object)
    assert (sums == exact.sum(axis=0)).all()
    assert (np.triu(products) == np.triu(exact.T @ exact)).all()


def brute_whitening(vectors):
    """Rows of ``(n, deviation, whitened...)`` of each vector by plain arithmetic, and what the axes explain."""
    x = [[int(np.floor(256 * float(c))) for c in v] for v in vectors]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[n * a - s for a, s in zip(v, sums)] for v in fit], object)
    cov = np.array((centred.T @ centred) / (n**3), float)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:4], axes[:, ::-1][:, :4]
    rows = []
    for v in x:
        c = [n * a - s for a, s in zip(v, sums)]
        rows.append((n, sum(a * a for a in c), np.array(c, float) / n @ axes / np.sqrt(values)))
    return rows, values / np.trace(cov)


def compare(got, keys, vectors):
    want, shares = brute_whitening(vectors)
    by_key = {k: w for k, w in zip(keys, want)}
    signs = np.zeros(len(shares))
    for r in sorted(got, key=lambda r: -abs(r["whitened"])):
        k = r["component"] - 1
        signs[k] = signs[k] or np.sign(r["whitened"] * by_key[r["vec_id"]][2][k])
    for r in got:
        n, deviation, white = by_key[r["vec_id"]]
        k = r["component"] - 1
        assert r["n"] == n and r["deviation"] == deviation and abs(r["explained"] - shares[k]) < 1e-9
        assert abs(r["whitened"] - signs[k] * white[k]) < 1e-6 and r["identity_error"] < 1e-9
    assert len(got) == len(keys) * len(shares)


@needs_tables
def test_whitening_of_the_tables(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    compare(queries.QUERIES["op11_whiten"](spark, SMALL).collect(), [r["vec_id"] for r in rows], [r["embedding"] for r in rows])


def test_whitening_of_odd_rows(spark):
    schema = "vec_id long, embedding array<double>, __x string, component int, n long"
    rng = np.random.default_rng(3)
    good = [[float(c) for c in rng.normal(size=3)] for _ in range(40)]
    vectors = good + good[:5] * 3 + [good[0]]
    keys = list(range(len(vectors)))
    left_out = [None, [1.0, None, 2.0], [1.0, float("nan"), 0.0], [float("inf"), 0.0, 0.0], [], [1.0, 2.0]]
    rows = [(k, v, "x", 1, 2) for k, v in zip(keys, vectors)] + [(900 + i, v, None, None, None) for i, v in enumerate(left_out)]
    compare(whiten.whiten(spark.createDataFrame(rows, schema)).collect(), keys, vectors)
    # Nulls and repeats of keys are rows like others.
    again = whiten.whiten(spark.createDataFrame([(None, v, None, None, None) for v in good] + [(7, v, None, None, None) for v in good[:2]], schema)).collect()
    assert sum(r["vec_id"] is None for r in again) == 40 * 3 and sum(r["vec_id"] == 7 for r in again) == 6
    assert whiten.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whiten.whiten(spark.createDataFrame([(1, None, None, None, None)], schema)).collect() == []


def test_whitening_without_variance_and_beyond_longs(spark):
    schema = "vec_id long, embedding array<double>"
    one = whiten.whiten(spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5, 0.25])], schema)).collect()
    assert {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one} == {(1, 0, None, None, 0.0)}
    flat = whiten.whiten(spark.createDataFrame([(i, [float(i), 1.0]) for i in range(4)], schema)).orderBy("vec_id", "component").collect()
    assert [r["whitened"] is None for r in flat] == [False, True] * 4 and abs(flat[0]["explained"] - 1) < 1e-12
    vast = [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [2.0**50, 2.0])]
    got = {r["vec_id"]: r for r in whiten.whiten(spark.createDataFrame(vast, schema)).where("component = 1").collect()}
    x = [[2**63 - 1024, 0], [-(2**63), 256], [2**58, 512]]
    sums = [sum(c) for c in zip(*x)]
    want = [sum((3 * a - s) ** 2 for a, s in zip(v, sums)) for v in x]
    assert [got[i]["deviation"] for i in (1, 2, 3)] == [w if w < 10**38 else None for w in want]


# --- Fill in the middle -----------------------------------------------------------------------

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute_middle(key, text):
    tokens = TOKEN.findall(text)
    h = [int(sha(f"42:{key}")[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted(x % (len(tokens) + 1) for x in h[:2])
    prefix, middle, suffix = ("".join(t) for t in (tokens[:a], tokens[a:b], tokens[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(tokens), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(tokens), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(tokens), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@given(st.lists(st.lists(st.integers(0, 400), max_size=300), max_size=5), st.sampled_from([0, 1, 7, 127]))
@settings(max_examples=40, deadline=None)
def test_rank_index_is_exact_and_bounded(gaps, bound):
    runs = [np.cumsum([0, *g]).astype(np.int64) for g in gaps]
    index = fim.RankIndex(runs, bound)
    assert not len(index.residual) or np.abs(index.residual.astype(int)).max() <= bound
    for k, run in enumerate(runs):
        assert (index.cut(np.full(len(run), k), np.arange(len(run))) == run).all()


def test_index_is_smaller_than_its_offsets():
    run = np.cumsum(np.r_[0, np.random.default_rng(1).integers(2, 9, 200_000)])
    assert len(fim.RankIndex([run]).first) < 2000


@given(st.lists(st.text(alphabet=" \t\n\x0b\x0c\rab<P>SMé漢  😀", max_size=40), max_size=8))
@settings(max_examples=60, deadline=None)
def test_rewriting_equals_brute_force(texts):
    got = fim.rewrite(list(range(len(texts))), texts)
    for i, text in enumerate(texts):
        assert tuple(got[c][i] for c in ("n", "form", "prefix_chars", "middle_chars", "output")) == brute_middle(i, text)


def test_fill_in_middle_of_odd_rows(spark):
    long = ("word \n" * 30_000 + "z" * 50_000 + " é") * 2
    texts = [None, "", " ", "\n\n", "one", " one", "one ", "a <P> b c", "<", "a < b <S", "x y z", long]
    rows = [(i, t, "o", "f") for i, t in enumerate(texts * 8)] + [(3, "other text of an id", None, None), (None, "no id here", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, output string, form string")
    made = fim.fill_in_middle(df).withColumn("restored", fim.restore())
    got = sorted((r for r in made.collect()), key=str)
    want = sorted((brute_middle("" if i is None else i, t or "") + (t or "",) for i, t, _, _ in rows), key=str)
    assert sorted((tuple(r)[1:] for r in got), key=str) == want
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(df.limit(0)).collect() == []
    other = fim.fill_in_middle(df, rate=100, spm_rate=0).where("form <> 'plain'").select("form").distinct().collect()
    assert [r[0] for r in other] == ["psm"]


@needs_tables
def test_middle_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    want = {}
    for d in docs:
        n, form, a, b, out = brute_middle(d["doc_id"], d["text"] or "")
        want[d["doc_id"]] = (n, form, a, b, sha(out), sha(d["text"] or ""))
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.QUERIES["op12_fim"](spark, SMALL).collect()}
    assert got == want


# --- Pieces -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def codec():
    return pieces.PieceCodec(queries.PIECES)


ODD = ["", " ", "   ", "a", "<s></s><unk><0x0A>", "▁", "▁▁ ▁", "x" * 20_000, " " * 999, "漢字" * 500, "a\0b", "Words, words. (words) 1234 x.y", "é ﬁ ½ 😀👩‍👩‍👧"]


@given(st.lists(st.text(alphabet=st.sampled_from(list("ab the in er.,()0123\n\t▁é漢😀<>s'_")), max_size=60), max_size=6))
@settings(max_examples=200, deadline=None)
def test_pieces_equal_the_library(codec, texts):
    assert all(agrees for _, agrees in codec.encode_batch(texts))


def test_pieces_of_odd_texts(codec, monkeypatch):
    theirs = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    for limit in (pieces.CACHE, 3):
        monkeypatch.setattr(pieces, "CACHE", limit)
        found = codec.encode_batch([*ODD, None])
        assert [i for i, _ in found] == theirs.encode([*ODD, ""]) and all(a for _, a in found)
    # The heap of a long word and the rows of short ones are one agenda.
    monkeypatch.setattr(pieces, "LONG", 1)
    codec.seen.clear()
    assert all(a for _, a in codec.encode_batch(ODD))
    codec.seen.clear()
    # A wrong word shows.
    codec.seen["▁cat"] = codec.encode(["dog"])[0]
    assert [a for _, a in codec.encode_batch(["cat", "dog"])] == [False, True]
    codec.seen.clear()


def test_whole_texts_where_pieces_span_spaces(codec, monkeypatch):
    monkeypatch.setattr(codec, "words", lambda text: [text] if text else [])
    assert all(a for _, a in codec.encode_batch(["some words  and more\nof them", *ODD]))
    codec.seen.clear()


@needs_tables
def test_piece_query_equals_the_library(spark):
    theirs = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {}
    for d in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        ids = theirs.encode(d["text"] or "")
        want[d["doc_id"]] = (len(ids), sha(",".join(map(str, ids))), sha(theirs.decode(ids)), True)
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.QUERIES["op13_pieces"](spark, SMALL).collect()}
    assert got == want
    rows = spark.createDataFrame([(1, None, "x"), (None, "a b", "y"), (1, "c" * 300_000, "z")], "doc_id long, text string, ids string")
    got = pieces.encode(rows, ["doc_id"], queries.PIECES).collect()
    assert [r["decoded"] for r in got] == ["", "a b", "c" * 300_000] and all(r["agrees"] for r in got) and got[0]["ids"] == []
    assert pieces.encode(rows.limit(0), ["doc_id"], queries.PIECES).collect() == []
