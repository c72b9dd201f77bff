import html
import re

import numpy as np
import pytest

from kiloqueue.llm import html_text, language_id, quality_model
from kiloqueue.llm.common import read
from tests.conftest import SF
from tests.llm import brute
from tests.llm.tables import documents, edge_rows, empty, rows

MEDIUM = SF.replace("0.001", "0.01")


def test_classifier_separates_held_out_labels(spark):
    docs, labels = read(spark, MEDIUM, "documents"), read(spark, MEDIUM, "labels")
    got = quality_model.score_documents(docs, labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= 0.7)).all()
    assert [brute.held(i, 4, 2) for i in got.doc_id] == got.held_out.tolist()
    both = got.merge(labels.toPandas(), on="doc_id")
    unseen = both[both.held_out]
    assert (unseen.predicted == unseen.quality).mean() >= 0.95


def test_classifier_never_learns_from_held_out_rows(spark):
    docs = documents(spark, [(i, f"text {i}", "en", "a") for i in range(40)])
    labels = spark.createDataFrame([(i, int(brute.held(i, 4, 2)), 0) for i in range(40)], "doc_id long, quality int, toxic int")
    got = quality_model.score_documents(docs, labels).toPandas()
    assert (got.score < 0.5).all()  # label 1 only occurs on rows that it must not see


def test_classifier_edge_rows(spark):
    labels = spark.createDataFrame([(7, 1, 0), (8, 0, 0), (None, 1, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality_model.score_documents(documents(spark, edge_rows()), labels).toPandas()
    assert len(got) == len(edge_rows()) and got.score.between(0, 1).all() and not got.score.isna().any()
    sevens = got[got.doc_id == 7].score
    assert len(sevens) == 2 and sevens.nunique() == 1
    nothing = quality_model.score_documents(documents(spark, edge_rows()), labels.limit(0)).toPandas()
    assert np.allclose(nothing.score, 0.5, atol=0.05)
    assert quality_model.score_documents(empty(spark), labels).count() == 0


def test_features_do_not_depend_on_neighbours():
    texts = ["the the cat", None, "", "É x x", "  cat  ", "the"]
    rows_, owner = quality_model.features(texts)
    for i, t in enumerate(texts):
        alone, _ = quality_model.features([t])
        assert sorted(rows_[owner == i].tolist()) == sorted(alone.tolist()), t


def test_language_accuracy(spark):
    docs = read(spark, MEDIUM, "documents")
    got = language_id.identify(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    assert len(got) == docs.count()
    unseen = got[got.held_out]
    assert (unseen.lang_pred == unseen.lang).mean() >= 0.98
    assert got.score.between(0, 1).all()


def test_language_edge_rows(spark):
    got = language_id.identify(documents(spark, [*edge_rows(), (60, "123 456 !!", "en", "a")])).toPandas()
    by = got.set_index(got.doc_id.fillna(-1)).lang_pred.groupby(level=0).first()
    assert by[1] == by[2] == by[3] == by[60] == "und"
    assert set(got.lang_pred) <= {"und", "en", "de", "fr"} and by[7] != "und"
    assert (got[got.lang_pred == "und"].score == 0).all()
    no_labels = documents(spark, [(1, "some text", None, "a")])
    assert [r.lang_pred for r in language_id.identify(no_labels).collect()] == ["und"]
    assert language_id.identify(empty(spark)).count() == 0


def test_gradient_through_time_equals_differences():
    rng = np.random.default_rng(3)
    langs, words = 3, [b"ab", b"xyz", b"q"]
    labels, model = np.array([0, 2, 1]), language_id.start_model(3).astype(np.float64)
    data, size = language_id.pack(words)
    loss = lambda m: language_id.gradient(language_id.unpack(m, langs), data, size, labels)[0]
    _, g = language_id.gradient(language_id.unpack(model, langs), data, size, labels)
    touched = np.flatnonzero(np.abs(g) > 1e-5)
    for k in rng.choice(touched, 40, replace=False):
        step = np.zeros_like(model)
        step[k] = 1e-3
        assert (loss(model + step) - loss(model - step)) / 2e-3 == pytest.approx(g[k], rel=0.05, abs=2e-4)


def test_every_position_of_long_words_is_labelled():
    assert b"".join(language_id.segments(b"x" * 1000)) == b"x" * 1000
    labels = language_id.WordLabels(language_id.start_model(2), 2)
    labels.learn([b"abc"])
    assert labels.sums[0].sum() == pytest.approx(5, rel=1e-4)  # three bytes and the marks


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="site-header"><p>Site name, motto, more</p></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies, many, many cookies on this page, all day long, every day.</p></div>
<div id="wrap"><div class="post-body"><h1>Head &amp; line</h1><p>First   para,\n with <b>bold</b> text, commas, and enough words to count.
<p>Second para &eacute; &#233;, with more text, and again more text, to be sure.</p>
<div class="ad">Buy, buy, buy this very good thing, now, today, cheap, and more.</div>
<ul><li>one</li><li>two</li></ul></div>
<div class="sidebar"><p>Side text, with commas, a lot of commas, here, there, everywhere.</p></div>
<div id="comments"><p>Nice article, thanks, really, I mean it, very nice, great.</p></div></div>
<form><p>Your name, please</p><input></form><footer><p>Copyright, 2020, all rights reserved, of course.</p></footer></body></html>"""


def test_extract_keeps_the_article_only():
    assert html_text.extract(PAGE).split("\n") == [
        "Head & line", "First para, with bold text, commas, and enough words to count.",
        "Second para é é, with more text, and again more text, to be sure.", "one", "two"]


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("   ", ""), ("plain words", "plain words"), ("<nav><p>Home, about, contact</p></nav>", ""),
    ("<article><p>Cut off in the mid", "Cut off in the mid"), ("<article><p>cut tag <b", "cut tag"),
    ("<article><p>a < b & c</p></article>", "a < b & c"), ("<article><p>a<br>b</p></article>", "a b"),
    ('<body class="has-sidebar"><div class="layout with-sidebar"><article><p>kept</p></article><div class="sidebar"><p>gone</p></div></div></body>', "kept"),
    ('<div class="page-header-fixed"><p>all of the text, nearly</p></div><div class="notice"><p>gone</p></div>', "all of the text, nearly"),
    ('<article><p>a, b</p><section id="comments"><article class="comment"><p>c, d, e, f, g</p></article></section></article>', "a, b"),
    ("<main><p>x</p><p>y</p></main>", "x\ny"), ("<p>1<p>2<script>bad()</script>", "1\n2"),
])
def test_extract_small(page, text):
    assert html_text.extract(page) == text


def test_extract_deep_and_long():
    assert html_text.extract("<div>" * 5000 + "<p>deep text, here</p>" + "</div>" * 5000) == "deep text, here"
    many = "".join(f"<p>Para {i}, with text.</p>" for i in range(5000))
    assert html_text.extract(f"<body><article>{many}</article></body>").count("\n") == 4999


def test_extract_pages_table(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", "<p>hé</p>")], "page_id long, url string, html string") \
        .selectExpr("*", "1 AS text", "2 AS n_chars")
    got = html_text.extract_pages(pages).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == sorted([(1, len(html_text.extract(PAGE)))] * 2 + [(2, 0), (0, 2)])
    assert html_text.extract_pages(pages.limit(0)).count() == 0


def test_extract_whole_articles(spark):
    got = html_text.extract_pages(read(spark, SF, "pages")).collect()
    for r, (_, page) in zip(sorted(got, key=lambda r: r.page_id), rows(read(spark, SF, "pages"), "page_id", "html")):
        body = page.partition("<article>")[2].partition("</article>")[0]
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split())
                for x in re.split(r"</?p>|</?h1>", body)]
        assert r.text.split("\n") == [x for x in want if x], r.page_id
