"""Language, quality, mixing, encoding, the n-gram model, archives and page text."""

import base64
import collections
import hashlib
import html as htmllib
import io
import math
import os
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tracemill.llm import bpe, html, langid, lm, mixing, overlap, quality, queries, warc
from tracemill.llm.common import in_fold

SMALL = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables not present")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_folds_are_crc32_of_the_id(spark):
    got = spark.createDataFrame([(0,), (17,), (None,)], "doc_id long").select("doc_id", in_fold("doc_id", 4, 2)).collect()
    assert [r[1] for r in got] == [zlib.crc32(b"0") % 4 == 2, zlib.crc32(b"17") % 4 == 2, False]


# --- Language and quality --------------------------------------------------------------------


@needs_tables
def test_language_of_held_out_texts(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = queries.QUERIES["op6_language"](spark, SMALL).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.9
    net = langid.fit(docs.withColumn("score", F.lit(0)).withColumn("lang_pred", F.lit(0)), ~in_fold("doc_id", 4, 2))
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !"), (None, "the and of"), (5, "the and with " * 40_000)], "doc_id long, text string")
    got = {r[0]: (r[1], r[2]) for r in langid.predict(odd, net, ["doc_id"]).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0)
    assert got[5][0] == "en" and 0 <= got[None][1] <= 1
    empty = spark.createDataFrame([], DOCS)
    assert langid.fit(empty, ~in_fold("doc_id", 4, 2)) is None
    assert [r[1] for r in langid.predict(odd, None, ["doc_id"]).collect()] == ["und"] * 5


def test_window_maxima_equal_a_plain_convolution():
    net = langid.ByteNet(["a", "b"]).init(3)
    cut, _ = langid.windows(langid.to_bytes("Some text, é über " * 40))
    top, _, _ = net.pooled(cut)
    want = np.maximum(top + net.bias, 0) @ net.out + net.out_bias
    assert np.allclose(net.logits(cut), want, atol=1e-4)


@needs_tables
def test_quality_of_held_out_texts(spark):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    rows = queries.QUERIES["op4_quality"](spark, SMALL).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.85
    docs = spark.createDataFrame([(1, None, None), (2, "", 0), (3, "x " * 200_000, None), (None, "a", 1)], "doc_id long, text string, n_chars long")
    none = quality.fit(docs, spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int"), F.lit(True))
    assert none is None
    assert [r[1] for r in quality.score(docs, None, ["doc_id"]).collect()] == [0.5] * 4
    one = quality.fit(docs, spark.createDataFrame([(1, 1), (1, 0), (3, 0)], "doc_id long, quality int"), F.lit(True))
    got = [r[1] for r in quality.score(docs, one, ["doc_id"]).collect()]
    assert len(got) == 4 and all(0 <= s <= 1 for s in got)


def test_machine_equals_the_pairwise_sum():
    rng = np.random.default_rng(1)
    machine = quality.Machine(0.3, rng.normal(0, 0.1, (quality.BUCKETS + len(quality.STATS), 1 + quality.FACTORS)).astype(np.float32))
    buckets, weights, stats = quality.describe("some words and some more words, a b c", 30)
    index = np.concatenate([buckets, np.arange(quality.BUCKETS, quality.BUCKETS + len(stats))])
    x = np.concatenate([weights, stats]).astype(float)
    t = machine.table[index].astype(float)
    z = 0.3 + t[:, 0] @ x + sum((t[i, 1:] @ t[j, 1:]) * x[i] * x[j] for i in range(len(x)) for j in range(i))
    assert machine.score([(buckets, weights, stats)])[0] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-6)


# --- Mixing ----------------------------------------------------------------------------------


def test_budgets_go_to_siblings_before_ancestors(spark):
    rows = [("a", "x", "1", 10), ("a", "x", "2", 100), ("a", "y", "3", 100), ("b", "x", "4", 1000), ("b", "x", "5", 0)]
    leaves = spark.createDataFrame(rows, "domain string, lang string, source string, tokens long")
    for level in mixing.LEVELS:
        leaves = leaves.withColumn(f"w_{level}", F.lit(1.0))
    got = {r["source"]: r["budget"] for r in mixing.budgets(leaves, 200, 1).collect()}
    assert got == {"1": 10, "2": 40, "3": 50, "4": 100, "5": 0}
    got = {r["source"]: r["budget"] for r in mixing.budgets(leaves, 600, 1).collect()}
    assert got == {"1": 10, "2": 100, "3": 100, "4": 390, "5": 0}
    got = {r["source"]: r["budget"] for r in mixing.budgets(leaves, 10**6, 2).collect()}
    assert got == {"1": 20, "2": 200, "3": 200, "4": 2000, "5": 0}
    got = {r["source"]: r["budget"] for r in mixing.budgets(leaves.withColumn("w_lang", F.when(F.col("lang") == "x", 0.0).otherwise(1.0)), 600, 1).collect()}
    assert got == {"1": 0, "2": 0, "3": 100, "4": 0, "5": 0}
    odd = {r["source"]: r["budget"] for r in mixing.budgets(leaves, 101, 1).collect()}
    assert sum(odd.values()) == 101


def test_prefixes_fill_their_budgets(spark):
    rng = np.random.default_rng(6)
    rows = [(i, f"d{i % 2}", None if i % 7 == 0 else "l", f"s{i % 3}", int(rng.integers(0, 50))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, domain string, lang string, source string, n_tokens long")
    docs = mixing.name_levels(docs, {c: F.col(c) for c in mixing.LEVELS}).withColumn("epoch", F.lit("clash"))
    total = sum(r[4] for r in rows)
    wide = mixing.mix(docs, {"domain": {"d0": 5.0}}, None, slice_rows=8).collect()
    assert sum(r["take_tokens"] for r in wide) == total
    again = mixing.mix(docs, {"domain": {"d0": 5.0}}, None, slice_rows=10_000).collect()
    assert sorted(wide) == sorted(again)  # the slices do not change the result
    for leaf in {(r["domain"], r["lang"], r["source"]) for r in wide}:
        mine = sorted((r for r in wide if (r["domain"], r["lang"], r["source"]) == leaf), key=lambda r: (r["start"], r["n_tokens"]))
        at = 0
        for r in mine:
            assert r["start"] == at
            at += r["n_tokens"]
    assert max(r["epoch"] for r in wide) >= 1
    assert mixing.mix(docs.limit(0), {}, None).count() == 0
    assert mixing.mix(docs, {}, 0).count() == 0


# --- Encoding --------------------------------------------------------------------------------

PATH = queries.VOCABULARY


@pytest.fixture(scope="module")
def tokenizer():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def same_as_library(encoder, tokenizer, texts):
    for text, (ids, decoded) in zip(texts, encoder.encode(texts)):
        want = tokenizer.encode_ordinary(text or "")
        assert ids == " ".join(map(str, want)), text
        assert decoded == (text or "").encode()


def test_encoding_equals_the_library(tokenizer):
    same_as_library(
        bpe.Encoder(PATH, public_tokenizers.PATTERN), tokenizer,
        [None, "", " ", "  ", "a  b", "a   b \n c", "\n\n x", "it's 's  're", "a" * 3000, "ab" * 400 + "=-" * 500, " \t\n ", "x\x1cy \x1c z", "\xa0a \xa0 b",
         "é" * 60, "  lead", "trail  ", "日本語 テキスト 🙂🙂", "123 4567  89", "x\u0085 y", "<|endoftext|>", "same same same same"],
    )


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aAbe é\n\t'st1.-—日🙂"), max_size=30), max_size=6))
def test_encoding_of_any_text(tokenizer, texts):
    same_as_library(bpe.Encoder(PATH, public_tokenizers.PATTERN), tokenizer, texts)


def test_long_words_contract_as_short_ones(tokenizer, monkeypatch):
    words = ["thanonontioniner", "xyxyxyxyxyxyxy", "aaaaaaaaaaaaaaaaa", "bababaaabab"]
    monkeypatch.setattr(bpe, "LONG", 0)
    codec = bpe.Codec(PATH, public_tokenizers.PATTERN)
    assert codec.contract([w.encode() for w in words]) == [" ".join(map(str, tokenizer.encode_ordinary(w))) for w in words]


def test_encode_returns_ids_and_digests(spark, tokenizer):
    rows = spark.createDataFrame([(1, "Hello, big world"), (2, None), (None, " ")], "doc_id long, text string").withColumn("ids", F.lit(0))
    got = {r["doc_id"]: r for r in bpe.encode(rows, ["doc_id"], PATH, public_tokenizers.PATTERN).collect()}
    assert got[1]["ids"] == tokenizer.encode_ordinary("Hello, big world") and bytes(got[1]["decoded"]) == b"Hello, big world"
    assert got[2]["n_tokens"] == 0 and got[None]["n_tokens"] == 1
    digest = {r["doc_id"]: r for r in bpe.encode_digests(rows, ["doc_id"], PATH, public_tokenizers.PATTERN).collect()}
    assert digest[1]["ids_sha256"] == hashlib.sha256(" ".join(map(str, got[1]["ids"])).encode()).hexdigest()
    assert digest[2]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()


# --- Language model --------------------------------------------------------------------------


def brute_lm(rows, learned):
    tok = {i: [*re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), "</s>"] for i, t in rows}
    train = [i for i in tok if learned(i)]
    c = collections.Counter(w for i in train for w in tok[i])
    big = collections.Counter(p for i in train for p in zip(["<s>"] + tok[i], tok[i]))
    n, v = sum(c.values()), len(c)
    total, kinds, follows = collections.Counter(), collections.defaultdict(lambda: [0, 0, 0]), collections.Counter(w for _, w in big)
    for (a, _), k in big.items():
        total[a] += k
        kinds[a][min(k, 3) - 1] += 1
    of = lambda values: lm.discounts([sum(x == k for x in values) for k in (1, 2, 3, 4)])
    d, e = of(big.values()), of(follows.values())
    spare = sum(e[min(x, 3) - 1] for x in follows.values()) / len(big)
    single = lambda w: max(follows[w] - (e[min(follows[w], 3) - 1] if follows[w] else 0), 0) / len(big) + spare / (v + 1)

    def p(a, w):
        if not total[a]:
            return single(w)
        k = big[(a, w)]
        return max(k - (d[min(k, 3) - 1] if k else 0), 0) / total[a] + sum(x * y for x, y in zip(d, kinds[a])) / total[a] * single(w)

    return {
        i: (len(t), sum(w in c for w in t), sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), sum(math.log10(p(a, w)) for a, w in zip(["<s>"] + t, t)))
        for i, t in tok.items()
    }, n, p, c


@pytest.mark.parametrize("cells", [1, 2, 32])
def test_model_equals_brute_force(spark, cells):
    rng = np.random.default_rng(cells)
    words = [f"W{int(x)}" for x in rng.zipf(1.4, 4000) % 300]
    rows = [(i, " ".join(words[i * 40 : i * 40 + 40])) for i in range(100)] + [(100, None), (101, ""), (102, "unseen words HERE"), (103, "w1 " * 3000)]
    learned = lambda i: zlib.crc32(str(i).encode()) % 10 != 0
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    model = lm.fit(df, F.col("doc_id").isNotNull() & ~in_fold("doc_id", 10, 0), cells=cells)
    want, n, p, c = brute_lm(rows, learned)
    assert model.tokens == n and model.words == len(c)
    assert sum(p("w1", w) for w in c) + p("w1", "unseen!") == pytest.approx(1)
    for r in lm.score(df, model, ["doc_id"]).collect():
        assert (r["n_tokens"], r["n_known"]) == want[r["doc_id"]][:2]
        assert (r["base_score"], r["score"]) == pytest.approx(want[r["doc_id"]][2:], abs=1e-7)


def test_model_of_nothing(spark):
    df = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    got = lm.score(df, lm.fit(df, F.lit(False)), ["doc_id"]).collect()
    assert [(r["n_tokens"], r["n_known"], r["score"]) for r in got] == [(3, 0, 0.0), (1, 0, 0.0)]


# --- Archives --------------------------------------------------------------------------------


def test_archives_round_trip(spark):
    pages = [(i, f"http://h/{i} é", "same" if i % 3 == 0 else f"<p>{i}</p>\r\n\r\n" * i) for i in range(60)]
    pages += [(7, "u", "same"), (57, "u", "same"), (57, "u", "same"), (100, None, None), (101, None, ""), (None, "n", "same"), (None, "n", "alone")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("id", F.lit(1))
    got = warc.archive(df, roll=2000, shard_bytes=5000).collect()
    last = {}
    for i, _, h in pages:
        last[h or ""] = max(-1 if i is None else i, last.get(h or "", -1))
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    assert collections.Counter((r["page_id"], r["payload_digest"], r["payload_bytes"]) for r in got) == collections.Counter((i, digest(h), len((h or "").encode())) for i, _, h in pages)
    for h, biggest in last.items():
        mine = [r for r in got if r["payload_digest"] == digest(h)]
        first = [r for r in mine if r["record_type"] == "response"]
        assert len(first) == 1 and (first[0]["page_id"] if first[0]["page_id"] is not None else -1) == biggest and first[0]["refers_to"] is None
        assert all(r["refers_to"] == biggest for r in mine if r["record_type"] == "revisit")
    all_response = warc.archive(df, min_bytes=10**6).collect()
    assert {r["record_type"] for r in all_response} == {"response"} and len(all_response) == len(pages)
    assert warc.archive(df.limit(0)).count() == 0


def test_archives_are_the_same_bytes_again(spark, tmp_path):
    """Files and bytes depend on the rows alone, not on their partitions or those of the shuffles."""
    rows = spark.range(200).select((F.col("id") * F.col("id")).alias("id"), F.lit("http://h/").alias("url"), F.encode(F.repeat(F.col("id").cast("string"), 50), "utf-8").alias("payload"))
    rows = rows.unionByName(rows.where("id % 9 = 0").withColumn("url", F.lit("again"))).unionByName(rows.limit(3).withColumn("id", F.lit(None).cast("long")))
    found = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for folder, partitions in (("a", 1), ("b", 7)):
            spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
            listed = warc.write_archives(rows.repartition(partitions), f"file://{tmp_path}/{folder}", roll=3000, shard_bytes=9000).collect()
            files = {f: (tmp_path / folder / f).read_bytes() for f in os.listdir(tmp_path / folder)}
            assert not [f for f in files if f.endswith(".tmp")] and {r["file"] for r in listed} == {f for f in files if f.endswith(".gz")}
            assert max(len(d) for f, d in files.items() if f.endswith(".gz")) <= 3000
            found.append(files)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] and len({f.split("-")[1] for f in found[0]}) > 3


def test_shards_hold_about_as_much(spark):
    ids = [0, 1, 2, 3, 10**15, 10**15 + 1, -(2**63), 2**63 - 1] + [500] * 40
    rows = spark.createDataFrame([(i, b"x" * 488) for i in ids], "id long, payload binary")
    bounds = warc.shard_bounds(rows, 3000)
    assert bounds == sorted(set(bounds)) and bounds == warc.shard_bounds(rows.repartition(3), 3000)
    shards = {}
    for i in ids:
        shards.setdefault(sum(b <= i + 2**63 for b in bounds), []).append(i)
    assert all(len(s) <= 3 or set(s) == {500} for s in shards.values())
    assert warc.shard_bounds(rows.limit(0), 10) == []


def test_damaged_archives_are_noticed():
    record = warc.make_record(1, 0, "u", b"payload", None, False)
    (header, block), = warc.read_records(io.BytesIO(warc.gzip_member(record)))
    assert warc.parse_record(header, block)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parse_record(header, block.replace(b"payload", b"pAyload"))
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(warc.gzip_member(record)[:-4])))


# --- Page text -------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="page-12">
<header><h2>Site</h2></header><nav><ul><li><a href=/a>menu</a></li></ul></nav><div class="cookie-notice">We use cookies, a lot of them, really.</div>
<div class="main-7 content"><h1>Head &amp; line</h1><p>First<b>bold</b> para <i>graph</i>&nbsp;one.<p>Second  &lt;x&gt;<br>line.
<div class="ad">buy</div><form><input><p>form</p></form><aside>side</aside><ul><li>item one<li>item two</ul><!-- a <p>comment</p> --><blockquote>quote</blockquote></div>
<section id="comments"><p>Reader says a very long thing that is much longer than the article itself, again and again, and again, and again.</p></section><footer>foot</footer>"""


def test_main_text_of_a_page():
    page = html.Page(PAGE)
    want = "Head & line Firstbold para graph one. Second <x> line. item one item two quote"
    assert page.text(None) == want
    assert page.text("html>body.page-#>div.content.main-#") == want
    assert html.Page(None).text(None) == html.Page("").text("x") == ""
    assert html.Page("just < text & more").text(None) == "just < text & more"
    assert html.Page("<p>" * 3000 + "deep").text(None) == "deep"


ARTICLE = "<p>" + "The article text, as it stands. " * 20 + "</p>"
PLAIN = " ".join(("The article text, as it stands. " * 20).split())


@pytest.mark.parametrize("before", ["<svg class=i />", "<iframe src=x/>", "<iframe src=y>", "<svg>", "<title>", "<noscript>", "<p title=it's>", "<a href='>"])
def test_broken_markup_keeps_the_article(before):
    got = html.Page(f"<html><body>{before}<article>{ARTICLE}</article></body></html>").text(None)
    assert got.endswith(PLAIN) and "<" not in got


@pytest.mark.parametrize("names", ["content-with-sidebar", "elementor-widget-text", "post comment-status-open", "banner", "widget", "social"])
def test_names_around_the_article_do_not_lose_it(names):
    page = f"<body><nav>menu</nav><div class='{names}'>%s<div class=sidebar><p>side</p></div></div><footer>foot</footer></body>"
    assert html.Page(page % f"<article>{ARTICLE}</article>").text(None) == PLAIN
    assert html.Page(f"<body><nav>menu</nav><div class='{names}'>{ARTICLE}</div><footer>foot</footer></body>").text(None) == PLAIN
    assert html.Page(f"<form id=aspnet><nav>menu</nav><main>{ARTICLE}</main></form>").text(None) == PLAIN


def test_parts_inside_the_article():
    inside = "<article><p>x <math><mi>a</mi><mo>=</mo><mn>1</mn></math> y<span class=share>share</span>z</p><div class=post-comments><p>%s</p></div></article>" % ("reader " * 200)
    assert html.Page(inside).text(None) == "x a=1 yz"
    assert html.Page("<main><p>one</main><section id=comments><article>" + ARTICLE + "</article></section>").text(None) == "one"


@pytest.mark.parametrize(
    "page",
    ["<a b" * 250_000, "<a href='" * 20_000, "<a href='" * 20_000 + ">", "<div>" * 20_000 + "x", '<a b="x>"' * 50_000, "<b>" * 20_000 + "<h1>" * 20_000,
     "<div>" * 20_000 + "</span>" * 20_000, "<svg>" * 50_000, "<div class=ad>" * 20_000 + "deep", "<script>" * 50_000, "<!--" * 50_000, "<" * 1_000_000],
    ids=range(12),
)
def test_hostile_pages_take_linear_time(page):
    start = time.process_time()
    assert isinstance(html.Page(page).text(None), str)
    assert time.process_time() - start < 5


def test_hosts_agree_on_a_path(spark):
    long = "<html><body><div class=post><p>" + "word " * 50 + "</p></div><div class=other><p>more</p></div></body></html>"
    short = "<html><body><div class=post><p>tiny</p></div><div class=other><p>" + "noise " * 20 + "</p></div></body></html>"
    rows = [(i, "http://U@Host.example:80/x", long) for i in range(5)] + [(9, "https://host.example", short), (10, "http://alone.example/", short), (11, None, None), (12, "bad", "plain")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(0)).withColumn("path", F.lit(0))
    got = {r["page_id"]: r["text"] for r in html.extract(df).collect()}
    assert got[9] == "tiny" and got[10] == " ".join(["noise"] * 20) and got[11] == "" and got[12] == "plain" and got[0] == " ".join(["word"] * 50)
    assert html.extract(df.limit(0)).count() == 0


@needs_tables
def test_main_text_of_the_test_pages(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    for r in queries.QUERIES["op7_html"](spark, SMALL).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        plain = htmllib.unescape(re.sub(r"<[^>]+>", "", re.sub(r"</?(?:p|h1|br)\b[^>]*>", " ", article)))
        assert r["text"] == " ".join(plain.split()) and r["n_chars"] == len(r["text"])


# --- Pipeline --------------------------------------------------------------------------------


@needs_tables
def test_stages_against_plain_python(spark, tokenizer):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").unionByName(
        spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", "en", "x", 0), (10**6 + 2, "12 34", "en", "x", 5)], DOCS)
    )
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, spark.createDataFrame(stage(spark, docs, SMALL).toPandas().astype(object).where(lambda x: x.notna(), None).values.tolist(), stage(spark, docs.limit(0), SMALL).schema)
        kept[name] = [r["doc_id"] for r in docs.collect()]
        if name == "language":
            assert not {10**6, 10**6 + 1, 10**6 + 2} & set(kept[name]) and len(kept[name]) >= 195
        if name == "near_duplicates":
            sets = {r["doc_id"]: set(overlap.shingle_set(r["text"], 5).tolist()) for r in before.collect()}
            group = {i: i for i in sets}
            for i, a in sets.items():
                for j, b in sets.items():
                    if j < i and 10 * len(a & b) >= 8 * len(a | b) and group[i] != group[j]:
                        low, high = sorted((group[i], group[j]))
                        group = {k: low if g == high else g for k, g in group.items()}
            assert sorted(kept[name]) == sorted(i for i, g in group.items() if i == g)
        if name == "encoding":
            text = {r["doc_id"]: r["text"] for r in before.collect()}
            for r in docs.collect():
                ids = tokenizer.encode_ordinary(text[r["doc_id"]])
                assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    known = [labels[i] for i in set(kept["quality"]) & set(labels)]
    assert len(known) > 50 and np.mean(known) > 0.95


EXTRA = DOCS + ", score double, lang_pred string, __found string, __row long, epoch int, path string"


def odd_documents(spark):
    """Documents with NULLs and repeats everywhere, and columns that have the names of results."""
    more = (0.5, "x", "y", 1, 2, "z")
    words = ["the cat and the dog of the house went to the market with all of them " + f"on day {i} of the year {i * 7}" for i in range(40)]
    rows = [(i, w, "en", "src0", len(w), *more) for i, w in enumerate(words)]
    rows += [(None, words[0] + " and nobody knew the reason for it at all or so they said in the end", None, None, None, *more)]
    rows += [(3, "another text of the same id that is about the sea and the ships on it", "en", None, 70, *more)] * 2
    rows += [(99, None, None, None, None, *more), (98, "", "en", "src1", 0, *more), (97, "word " * 100_000, "en", "src2", 500_000, *more)]
    return spark.createDataFrame(rows, EXTRA)


@needs_tables
def test_stages_on_odd_documents(spark):
    docs = odd_documents(spark)
    stages = dict(corpus_pipeline.STAGES)
    for name in ("language", "quality", "near_duplicates", "mixing"):
        got = stages[name](spark, docs, SMALL)
        assert got.columns == docs.columns
        assert stages[name](spark, docs.limit(0), SMALL).count() == 0
    found = stages["language"](spark, docs, SMALL).collect()
    assert not {99, 98} & {r["doc_id"] for r in found} and len(found) == docs.count() - 2
    assert next(r for r in found if r["doc_id"] is None)["lang"] == "en" and found[0]["lang_pred"] == "x" and found[0]["__found"] == "y"
    # Nothing to learn from: nothing is rejected.
    assert stages["language"](spark, docs.withColumn("lang", F.lit(None).cast("string")), SMALL).count() == docs.count()
    assert stages["quality"](spark, docs.withColumn("doc_id", F.lit(10**9)), SMALL).count() == docs.count()
    # Rows without an id or with that of another text stay; true copies do not.
    kept = [(r["doc_id"], (r["text"] or "")[:12]) for r in stages["near_duplicates"](spark, docs, SMALL).collect()]
    assert (None, "the cat and ") in kept and kept.count((3, "another text")) == 1 and (3, "the cat and ") in kept
    assert (98, "") in kept and (99, "") not in kept


def test_mixture_takes_rows_not_ids(spark):
    rows = [(1, "a b c", "en", "src0", 5), (1, "d e f g", "en", "src0", 7), (None, "h i", "en", "src0", 3), (2, "j", "en", "src0", 1), (2, "j", "en", "src0", 1)]
    got = corpus_pipeline.mix_sources(spark, spark.createDataFrame(rows, DOCS), SMALL).collect()
    # A single leaf gets its own tokens once: every row is read once.
    assert sorted(map(str, got)) == sorted(map(str, spark.createDataFrame(rows, DOCS).collect()))
