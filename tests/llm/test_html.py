"""Main text of hand-made and given pages."""

import re

import pytest
from samples import SF
from pyspark.sql import functions as F
from tarmac.llm import html_density as H

BODY = "<p>" + "Long plain sentence of the article with many words in it. " * 6 + "</p>"
TEXT = ("Long plain sentence of the article with many words in it. " * 6).strip()


@pytest.mark.parametrize("page,want", [
    ("", ""), ("plain  text\n here", "plain text here"), ("<p>a &amp; b&#33; &eacute;&lt;p&gt;", "a & b! é<p>"),
    (f"<html><body><nav><a href=x>Menu</a></nav><article><h1>T</h1>{BODY}</article><footer>f</footer>", f"T\n{TEXT}"),
    (f"<body><header>h</header><div id=main>{BODY}{BODY}</div><div class='sidebar'><p>side bar words</p></div></body>",
     f"{TEXT}\n{TEXT}"),
    (f"<body><article>{BODY}<div class='ad box'>Buy</div><form>q<input></form><section id='comments'><p>"
     + "a reader comments at length here " * 9 + f"</p></section><script>var a='<p>x</p>';</script>{BODY}</article>",
     f"{TEXT}\n{TEXT}"),
    (f"<body><article><p><b>open bold<br>next<p>second{BODY}</article>", f"open bold next\nsecond\n{TEXT}"),
    (f"<body><article>{BODY}<ul><li>one<li>two</ul></article><footer>&copy; x", f"{TEXT}\none\ntwo"),
    (f"<body><article>{BODY}<p>cut off <a hre", f"{TEXT}\ncut off"),
    (f"<body><!-- c --><article>{BODY}<p hidden>no</p><p style='display: none'>no</p></article>", TEXT)])
def test_hand_made(page, want):
    assert H.main_text(page) == want


@pytest.mark.parametrize("page,want", [
    *((f"<body><div class='container {c}'><div>{BODY}{BODY}</div></div><div class='sidebar'>side words</div></body>",
       f"{TEXT}\n{TEXT}") for c in ("has-sidebar", "no-sidebar", "page-with-toc", "comments-enabled", "notice")),
    (f"<body><div id='search'><article>{BODY}</article></div></body>", TEXT),
    (f"<body><article>{BODY}<section class='related-work'><p>Earlier work.</p></section></article>",
     f"{TEXT}\nEarlier work."),
    (f"<body><article>{BODY}<p title='The hidden valley'>one</p><p data-x='open hidden'>two</p>"
     "<p data-class=ad alt=' class=ad hidden '>three</p></article>", f"{TEXT}\none\ntwo\nthree"),
    (f"<body><article>{BODY}<p title='x' hidden>no</p><div class=\"x side-bar ad_box\">no</div>"
     f"<div id=commentList>no</div><div role=search>no</div></article>", TEXT)])
def test_only_whole_names_drop_blocks(page, want):
    assert H.main_text(page) == want


def test_given_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = H.extract(pages).collect()
    source = {r.page_id: r.html for r in pages.collect()}
    assert len(rows) == len(source)
    for r in rows:
        art = re.search(r"<article>(.*?)(?:</article>|<footer>|\Z)", source[r.page_id], re.S)[1]
        import html
        art = re.sub(r"</?(?:p|h1|ul|li|article)>", "\n", art)
        lines = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in art.split("\n\n")]
        flat = " ".join(" ".join(lines).split())
        assert " ".join(r.text.split()) == re.sub(r" <[^>]*\Z", "", flat), r.page_id
        assert r.n_chars == len(r.text)


def test_nulls_and_names(spark):
    df = spark.createDataFrame([(1, None, None), (None, "u", "<p>x</p>"), (2, "u", ""), (2, "u", "")],
                               "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = H.extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(r.text for r in got.collect()) == ["", "", "", "x"]
    assert H.extract(df.limit(0)).count() == 0


def test_long_and_deep_pages():
    assert len(H.main_text("<body>" + "<div>" * 30_000 + "deep words")) == len("deep words")
    assert H.main_text("<p>" + "w " * 300_000 + "</p>").count("w") == 300_000
    assert H.main_text("<" * 20_000 + "x") is not None


@pytest.mark.parametrize("page,want", [
    ("<body><p title=it's>First para..</p><p>Second para, don't lose it.</p></body>",
     "First para..\nSecond para, don't lose it."),
    ("<body><p alt=6\">One.</p><p>Two \"quoted\" words.</p></body>", "One.\nTwo \"quoted\" words."),
    ("<body><p 'odd class=x>One.</p><p title = 'a > b'>Two.</p><p data-x=\"c > d\">Three.</p></body>", "One.\nTwo.\nThree."),
    ("<body><article><p>Text.</p><div title=it's hidden>no</div><div alt=5' class=\"sidebar\">no</div></article></body>", "Text."),
    ("<body><p title=\"open>Rest of it</p></body>", "Rest of it"),
    ("<body><p title=>Empty.</p><p a=b=c'd>Two.</p></body>", "Empty.\nTwo.")])
def test_quotes_outside_quoted_values(page, want):
    assert H.main_text(page) == want


def test_long_tags_without_an_end():
    assert H.main_text("<p " + "a=\"b\" c='d' " * 40_000) == ""
    assert H.main_text("<p " + "=" * 100_000 + ">x</p>") == "x"
    assert H.main_text("<p " + "=\"" * 30_000 + ">x</p>") is not None
