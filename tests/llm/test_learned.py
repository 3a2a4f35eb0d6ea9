"""Learned operators: held-out accuracy, empty tables, and the pipeline's stages."""

import pytest
from pyspark.sql import functions as F

from talus.llm import html, langid, lmscore

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def test_language_id(docs):
    found = langid.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id")
    seen = found.where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'")
    right, n = seen.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 50 and right > 0.95
    assert found.where("text IS NULL AND lang_pred <> 'und'").count() == 0
    assert found.where("score < 0 OR score > 1").count() == 0


def test_language_id_without_labels(docs):
    bare = docs.limit(20).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(bare).collect()} == {"und"}
    assert langid.identify(docs.limit(0)).count() == 0


def test_letters():
    assert [langid.lettered(x.encode()) for x in ("12 \u00b3", "\u00bd", "\u2167", "\u2460", "", "_", "\u00e9", "\u65e5", "3a")] == [False] * 6 + [True] * 3


def test_accepted(spark):
    rows = [(1, "the cat and the dog", "x"), (1, "the cat and the dog", "x"), (2, None, "x"), (3, "12 \u00b3", "x"), (None, "a" * 200_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    assert sorted((r.doc_id or 0, r.score) for r in langid.accepted(docs, None).collect()) == [(0, "x"), (1, "x"), (1, "x")]
    assert langid.accepted(docs.limit(0), None).count() == 0
    labelled = docs.withColumn("lang", F.lit("en"))
    found = sorted((r.doc_id or 0, r.lang_pred) for r in langid.identify(labelled).collect())
    assert found == [(0, "en"), (1, "en"), (1, "en"), (2, "und"), (3, "und")]


def test_lm_scoring(spark, docs):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    assert lmscore.score(docs, labels).count() == docs.count()
    assert lmscore.score(docs.limit(0), labels).count() == 0
    assert lmscore.score(docs.limit(30), labels.limit(0)).count() == 30


def test_html(spark):
    model = html.train(pages=120)
    body = " ".join(["The harbour master wrote a long and careful report about tides &amp; ships."] * 6)
    page = f"<html><head><style>.a{{}}</style><script>var x;</script></head><body><nav class='menu'><a>Home</a><a>News</a></nav><article><h1>On tides</h1><p>{body}</p>\n<p>{body}</p></article><footer class='footer'>Copyright</footer></body></html>"
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<" * 500 + "<p>" * 3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit("x"))
    found = {r.page_id: r for r in html.extract(pages, model).collect()}
    assert "tides & ships" in found[1].text and "Copyright" not in found[1].text and "var x" not in found[1].text and "Home" not in found[1].text
    assert found[2].text == "" and found[3].text == "" and set(found) == {1, 2, 3, 4}
    assert all(len(r.text) == r.n_chars for r in found.values())
    assert html.extract(pages.limit(0), model).count() == 0


def test_html_pages_of_the_table(spark):
    """Whole table against the article element, read another way."""
    import html as references
    import re

    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    found = {r.page_id: r.text for r in html.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search("<article>(.*?)(</article>|$)", r.html or "", re.S)
        bare = re.sub("<[^>]*>", " ", re.sub("</?b>", "", inner[1] if inner else ""))
        assert found[r.page_id] == re.sub(r"\s+", " ", references.unescape(bare)).strip()


def test_html_held_out():
    """Pages written with another seed: tokens kept against tokens marked as main text."""
    import re
    from collections import Counter

    model, right, kept, wanted = html.train(), 0, 0, 0
    for k in range(150):
        source = html.sample_page(9_000_000 + k)
        page = html.Page(source.replace(" data-main", ""))
        page.features()
        label = html._labels(page, source)
        want = Counter(re.findall(r"\w+", page.main_text(label)))
        got = Counter(re.findall(r"\w+", html.texts(model, [source.replace(" data-main", "")])[0]))
        right, kept, wanted = right + (want & got).total(), kept + got.total(), wanted + want.total()
    assert 2 * right / (kept + wanted) > 0.95


def test_html_open_quotes_and_spaces():
    model = html.train(pages=120)
    body = "word " * 60
    text = html.texts(model, [f"<body><article><p>{body}<a href=\"unclosed>link</a>\u2003more\u202fwords\u00a0here {body}</p></article></body>"])[0]
    assert "link more words here" in text and "href" not in text and text == text.strip()
