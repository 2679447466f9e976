"""Near-duplicates by the similarity of shingle sets, as the pipeline drops them."""

import numpy as np
import pytest

import corpus_pipeline
from tracemill.llm import overlap, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def similarity(a, b):
    a, b = set(overlap.shingle_set(a, 5).tolist()), set(overlap.shingle_set(b, 5).tolist())
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rng, words, least, most):
    """A copy of a similarity in the given bounds."""
    text = " ".join(words)
    for n in range(1, len(words)):
        copy = list(words)
        for at in rng.choice(len(words), n, replace=False):
            copy[at] = f"x{rng.integers(10**9)}"
        s = similarity(text, " ".join(copy))
        if s < least:
            n = 1
        if least <= s <= most:
            return " ".join(copy)
    return edited(rng, words, least, most)


def survivors(texts):
    """Smallest id of each group, by brute force."""
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if group[i] != group[j] and similarity(texts[i], texts[j]) >= 0.8:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    return sorted(set(group))


def stage(spark, rows):
    return corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, DOCS), "")


def test_planted_copies_leave(spark):
    rng = np.random.default_rng(5)
    texts = []
    for least in (0.8, 0.82, 0.85, 0.88, 0.91, 0.94):
        for _ in range(8):
            words = [f"w{rng.integers(10**6)}" for _ in range(200)]
            texts += [" ".join(words), edited(rng, words, least, least + 0.03)]
    kept = stage(spark, [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)])
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(0, len(texts), 2))


@pytest.mark.parametrize("few", [2, 32])
def test_groups_equal_brute_force(spark, few):
    rng = np.random.default_rng(few)
    line = [f"common{i}" for i in range(30)]
    texts = [None, "", "a b", "A  b", "a b c"]
    for _ in range(4):
        words = line + [f"w{rng.integers(10**6)}" for _ in range(int(rng.integers(20, 120)))]
        texts += [" ".join(f"y{rng.integers(10**6)}" if rng.random() < 0.02 else w for w in words) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = overlap.near_duplicates(df, few=few, tile=8)
    want = survivors(texts)
    assert sorted(r["doc_id"] for r in got.collect()) == want and 5 < len(want) < len(texts)
    assert overlap.near_duplicates(df.limit(0)).count() == 0


def test_fingerprints_link_too(spark):
    """Texts whose fingerprints are within two bits are near-duplicates, whatever their sets say; a chain over both kinds is one group."""
    rng = np.random.default_rng(9)
    body = [f"w{i}" for i in range(9)]
    # The repeated passage decides the fingerprint; what is around it makes the sets differ.
    texts = [" ".join([*body * 40, *(f"a{rng.integers(10**6)}" for _ in range(12))]) for _ in range(3)]
    words = [f"v{rng.integers(10**6)}" for _ in range(200)]
    texts += [" ".join(words), edited(rng, words, 0.8, 0.83), "quite another text", None, " "]
    prints = [simhash.fingerprint(t) & (2**64 - 1) for t in texts]
    near = lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2
    assert any(near(0, j) and similarity(texts[0], texts[j]) < 0.8 for j in (1, 2)) and not near(3, 4)
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if group[i] != group[j] and (near(i, j) or similarity(texts[i], texts[j]) >= 0.8):
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    kept = stage(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(group)) and len(set(group)) < len(survivors(texts))
