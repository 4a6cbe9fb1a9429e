"""Extraction, whitening and spelling variants against brute force and planted cases; long keys, equal ids and hostile pages of others."""

import math
import random
import time
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm import brute
from tidewake.llm import extract, kdsearch, quality, spelling, surrogates, warc, whitening
from tidewake.llm.common import written

# 11: extraction


def test_articles_of_the_table(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in extract.main_texts(pages.repartition(3)).collect()}
    for r in pages.collect():
        want = brute.article_between_tags(r["html"])
        assert got[r["page_id"]] == (want, len(want))


PARTS = [
    "<header><h1>Site name</h1><p>The best of all sites there are, since the year 2000 and on.</p></header>",
    '<div id="cookie-notice"><p>We use cookies here, a great many of them, and you should agree to all.</p></div>',
    '<aside><p>Other stories that you may like to read when you are done with this one.</p></aside>',
    '<div class="sidebar widget"><ul><li>About us and all that we have done so far</li></ul></div>',
    '<form action="/x"><label>Your mail</label><textarea>write to us about whatever you please</textarea></form>',
    '<section class="comments"><article class="comment"><p>I liked this very much, says a reader at some length.</p></article></section>',
    "<footer><p>All rights are ours, and so on, and so forth, for as long as may be.</p></footer>",
    "<script>if (a < b) { document.write('<p>not text</p>') }</script><style>p { margin: 0 }</style>",
    "<nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav>",
]


@pytest.mark.parametrize("outer", ["article", "main", 'div class="post"', 'div role="main"'])
def test_planted_articles(outer):
    rng = random.Random(outer)
    for _ in range(25):
        words = lambda n: " ".join(rng.choice("river boat gate tide wake sonar fish delta".split()) for _ in range(n))
        lines = [words(4)] + [words(rng.randint(1, 60)) for _ in range(rng.randint(3, 9))]
        body = f"<h1>{lines[0]}</h1>" + "".join(f"<p>{x.replace(' ', rng.choice([' ', '  ', chr(10), '&#32;', '<br>', ' <b>', '</b> ']), 1)}" + rng.choice(["</p>", ""]) for x in lines[1:])
        around = rng.sample(PARTS, rng.randint(2, len(PARTS)))
        cut = rng.randint(0, len(around))
        html = f'<!DOCTYPE html><html><head><title>T</title></head><body class="has-sidebar">{"".join(around[:cut])}<{outer}>{body}</{outer.split()[0]}>{"".join(around[cut:])}</body></html>'
        assert extract.main_text(html) == "\n".join(lines)


def test_odd_pages(spark):
    for html, want in (
        (None, ""), ("", ""), ("<p></p>", ""), ("plain", "plain"), ("<p>2<3 &amp; 4>1 &copy", "2<3 & 4>1 ©"), ("<p>x<![foo[ y ]]> z<?php echo ?> w</p><!-- c -->", "x z w"), ("<p>a<!-- never closed <p>b", "a"),
        ("<article></article><div class=ad>Buy</div>", ""), ("<p>one<script>two", "one"), ("<article><p>a  b\tc</article>", "a b c"), ("<nav>x<article><p>y</article>", "y"), ("<p>a<p class='q>b", "a\nb"),
    ):
        assert extract.main_text(html) == want, html
    rows = [(1, "u", "<p>a"), (1, "u", "<p>a"), (None, None, None)]
    got = extract.main_texts(spark.createDataFrame([(*r, "t", 5) for r in rows], "page_id long, url string, html string, text string, n_chars int"))
    assert sorted(map(str, got.collect())) == sorted(map(str, [(1, "u", "a", 1)] * 2 + [(None, None, "", 0)])) or got.count() == 3
    assert got.columns == ["page_id", "url", "text", "n_chars"] and extract.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("bit", ["<!--", "<a ", "<a b='", '<a href="', "<script>", "<title>", "</", "<![CDATA[", "<div>", "<p><b>", "&", "<", "<td>"])
def test_hostile_pages_take_linear_time(bit):
    began = time.process_time()
    extract.main_text(bit * (300_000 // len(bit)))
    extract.main_text(bit * (300_000 // len(bit)) + ">")
    assert time.process_time() - began < 8


# 12: whitening


def _held(df):
    return [(r["vec_id"], r["embedding"]) for r in df.collect()]


def test_whitening_of_the_table(spark, data):
    vectors = spark.read.parquet(f"{data}/embeddings.parquet")
    got = whitening.whitened(vectors).collect()
    n, deviation, share = brute.whitening([v for _, v in _held(vectors)], 4)
    x = {i: tuple(math.floor(256 * c) for c in v) for i, v in _held(vectors)}
    assert len(got) == 4 * len(x) and {r["n"] for r in got} == {n} and len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    for r in got:
        assert r["deviation"] == deviation[x[r["vec_id"]]] and abs(r["explained"] / share[r["component"] - 1] - 1) < 1e-6
    w = np.zeros((len(x), 4))
    place = {i: k for k, i in enumerate(x)}
    for r in got:
        w[place[r["vec_id"]], r["component"] - 1] = r["whitened"]
    fit = np.array([w[place[i]] for i in {v: i for i, v in x.items()}.values()])
    assert np.abs(np.cov(fit.T, bias=True) - np.eye(4)).max() < 1e-9 and np.abs(fit.mean(0)).max() < 1e-9
    values, axes = np.linalg.eigh(np.cov(np.array(sorted(set(x.values())), float).T, bias=True))
    centred = np.array([x[i] for i in x], float) - np.array(sorted(set(x.values())), float).mean(0)
    for k in range(4):
        want = centred @ axes[:, -1 - k] / np.sqrt(values[-1 - k])
        assert min(np.abs(w[:, k] - want).max(), np.abs(w[:, k] + want).max()) < 1e-7


def test_whitening_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, n long, component int"
    frame = lambda vs: spark.createDataFrame([(i, v, 1, 1) for i, v in enumerate(vs)], schema)
    nan, inf = float("nan"), float("inf")
    square = [[1.0, 0.0, 5.0], [-1.0, 0.0, 5.0], [0.0, 1.0, 5.0], [0.0, -1.0, 5.0]]  # two equal eigenvalues, one of zero
    rows = whitening.whitened(frame([*square, *square, None, [], [nan, 0.0, 0.0], [0.0, inf, 0.0], [0.0, None, 1.0], [1.0]])).collect()
    assert len(rows) == 16 and {r["n"] for r in rows} == {4} and {round(r["explained"], 12) for r in rows} == {0.5} and rows[0]["identity_error"] < 1e-12
    assert {r["deviation"] for r in rows} == {(4 * 256) ** 2}
    for none in ([], [None], [[2.0, 3.0]] * 5, [[]]):
        assert whitening.whitened(frame(none)).count() == 0
    large = whitening.whitened(frame([[1e12, 0.0], [-1e12, 3.0], [0.5, -2e12]])).collect()
    assert len(large) == 6 and large[0]["identity_error"] < 1e-6 and all(r["deviation"] is None for r in large)


@settings(max_examples=40, deadline=None)
@given(st.integers(2, 7).flatmap(lambda d: st.lists(st.lists(st.integers(-9, 9), min_size=d, max_size=d), min_size=2, max_size=12)))
def test_roots_are_those_of_the_matrix(rows):
    x = np.array(rows)
    s = x.sum(0).astype(object)
    m = len(x) * whitening.moments(x) - np.outer(s, s)
    primes = whitening.primes_for(int(sum(m.diagonal())), len(m))
    product, poly = math.prod(primes), [0] * (len(m) + 1)
    for p in primes:
        rest = product // p
        for k, c in enumerate(whitening.polynomial_modulo(m, p)):
            poly[k] += rest * pow(rest, -1, p) * int(c)
    poly = [c % product if (len(m) - k) % 2 == 0 else -(-c % product) for k, c in enumerate(poly)]
    want = np.linalg.eigvalsh(m.astype(float))[::-1]
    roots = whitening.largest_roots(poly, 4)
    assert np.allclose([a / 2**b for a, b in roots], want[: len(roots)], atol=1e-6 * max(1, want[0])) and all(abs(v) < 1e-6 * max(1, want[0]) for v in want[len(roots) : 4])
    v = whitening.null_vectors(m, roots)
    assert np.abs(v.T @ v - np.eye(len(roots))).max(initial=0) < 1e-12 and np.abs(m.astype(float) @ v - v * [a / 2**b for a, b in roots]).max(initial=0) < 1e-9 * max(1, want[0])


def test_moments_are_exact():
    x = np.random.default_rng(1).integers(-(2**62), 2**62, (50, 3))
    assert (whitening.moments(x) == x.astype(object).T @ x.astype(object)).all()


# 13: spelling variants


def _variants(df):
    return {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()}


def test_variants_of_the_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    counts = brute.spelling_words([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert _variants(spelling.variants(docs.repartition(5))) == brute.spelling_variants(counts)


def test_variants_of_odd_rows(spark, odd, none):
    counts = brute.spelling_words([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert counts and _variants(spelling.variants(odd)) == brute.spelling_variants(counts)
    assert spelling.variants(none).count() == 0


def test_near_pairs_by_brute_force(spark, monkeypatch):
    """A low frequency of extension makes grams of every length; words of one letter make all grams of a word change at once."""
    monkeypatch.setattr(spelling, "FREQUENCY", 2)
    rng = random.Random(8)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(5, 9))) for _ in range(700)} | {"a" * n for n in range(5, 12)} | {"ab" * 3, "ab" * 3 + "a"}
    got = spelling.near_pairs(spark.createDataFrame([(w,) for w in words], "word string")).collect()
    want = {frozenset((v[0], w)) for v in brute.spelling_variants(Counter(dict.fromkeys(words, 3))) for w in words if _one_edit(v[0], w)}
    assert len(got) == len(want) and {frozenset(r) for r in got} == want


def _one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab", min_size=5, max_size=8), min_size=1, max_size=30), st.integers(0, 6), st.data())
def test_an_edit_changes_no_more_grams_than_the_bound(words, frequency, data):
    counts = Counter(f"^{w}$"[p : p + q] for w in words for q in range(2, 5) for p in range(len(w) + 3 - q))
    d = spelling.Dictionary({g: n for g, n in counts.items() if len(g) == 2 or counts[g[:-1]] > frequency}, frequency)
    a = data.draw(st.sampled_from(words))
    i, kind, c = data.draw(st.integers(0, len(a))), data.draw(st.sampled_from("idr")), data.draw(st.sampled_from("abc"))
    b = a[:i] + c + a[i:] if kind == "i" else a[:i] + a[i + 1 :] if kind == "d" else a[:i] + c + a[i + 1 :]
    if a == b:
        return
    for x, y in ((a, b), (b, a)):
        mine, other = d.grams(f"^{x}$"), d.grams(f"^{y}$")
        shift = len(y) - len(x)
        kept = sum((p, g) in other or (p + shift, g) in other for p, g in mine)
        assert len(mine) - kept <= d.affected(f"^{x}$", mine)


# Others: what was cut off or slow


def test_keys_and_names_of_any_length(spark):
    texts = ["sk-" + "a1B" * 22 + "zz tail", "sk-" + "x9" * 100, "sk-proj-Ab1_" + "q" * 30 + "-Z2", "Mr. " + "A" + "b" * 60 + " " + "C" + "d" * 45 + ".", "sk-short", "risk-free-is-not-a-key-of-any-kind-at-all"]
    got = [r["text"] for r in surrogates.replace_entities(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    assert got[0].endswith(" tail") and "a1Ba1B" not in got[0] and "x9x9" not in got[1] and "q" * 30 not in got[2] and "b" * 60 not in got[3] and got[4:] == texts[4:]


def test_vectors_of_one_id_are_candidates_each(spark):
    rows = [(1, [2.0, 0.0]), (1, [5.0, 0.0]), (1, [5.0, 0.0]), (0, [1.0, 0.0]), (3, [4.0, 0.0])]
    got = kdsearch.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") == 0, k=5, scale=1)
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got.collect()) == [(1, 1, 5), (2, 3, 4), (3, 1, 2)]


@pytest.mark.parametrize("bit", ["<!--", "<script>", "<script ", "<a ", "<title>", "<title ", "<html ", "<br ", "<", "&", "</script"])
def test_hostile_records_take_linear_time(spark, bit):
    pages = spark.createDataFrame([(1, "u", bit * (1_000_000 // len(bit)))], "page_id long, url string, html string")
    warc.derivatives(warc.responses(pages.limit(0))).count()
    began = time.perf_counter()
    assert warc.derivatives(warc.responses(pages)).count() == 2 and warc.derivatives(warc.responses(pages)).agg(F.sum("content_length")).first()[0] > 0
    assert time.perf_counter() - began < 20


def test_more_headers_than_any_bound(spark):
    header = "HTTP/1.1 200 OK\r\n" + "".join(f"X-{i}: v\r\n" for i in range(3000)) + "\r\n"
    record = spark.createDataFrame([(1, "<urn:a>", "u", "d", "t", header, "x")], "page_id long, record_id string, target_uri string, date string, content_type string, http_header string, payload string")
    block = warc.derivatives(record).where("warc_type = 'metadata'").first()["block"]
    assert block.count("http-header-x-") == 3000


# 4: what co-training teaches


def _ranked(score: np.ndarray, label: np.ndarray) -> float:
    place, good = np.argsort(np.argsort(score)), label == 1
    return (place[good].sum() - good.sum() * (good.sum() - 1) / 2) / (good.sum() * (~good).sum())


def test_the_exchange_teaches_words_that_no_label_has(spark, monkeypatch):
    """Twenty labels hold half of the vocabulary; the other half's worth is known from the record alone, and the ranked documents'
    records say nothing. Only lessons from the metadata view teach it to the content view."""
    rng, rows, labels = random.Random(3), [], []
    of = {(half, good): [f"{'ab'[half]}{'xy'[good]}{i:02d}q" for i in range(8)] for half in (0, 1) for good in (0, 1)}
    for i in range(1500):
        labelled, ranked = i < 20, i >= 1200
        good, half = (i % 2 == 0, 0) if labelled else (rng.random() < 0.5, 1 if ranked else rng.randrange(2))
        words = [f"cc{rng.randrange(20):02d}w" for _ in range(20)] + [rng.choice(of[half, good if rng.random() < 0.85 else not good]) for _ in range(20)]
        rng.shuffle(words)
        source = rng.choice(["s0", "s1"]) if ranked else f"s{int(good == (rng.random() < 0.95))}"
        rows.append((i, " ".join(words), "en", source, 239))
        labels.append(int(good))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    table, known = written(quality.features(docs), "test-features"), spark.createDataFrame(list(enumerate(labels[:20])), "doc_id long, quality int")
    last = quality.Rows.of(table.toPandas().sort_values("doc_id").iloc[-300:])
    fit = quality.CoTraining.fit
    taught = _ranked(quality.train_on(table, known).content.raw(last), np.array(labels[-300:]))
    monkeypatch.setattr(quality.CoTraining, "fit", lambda self, c, m, y, pool=None, **more: fit(self, c, m, y, None, **more))
    alone = _ranked(quality.train_on(table, known).content.raw(last), np.array(labels[-300:]))
    assert taught > alone + 0.1 and taught > 0.6, (taught, alone)
