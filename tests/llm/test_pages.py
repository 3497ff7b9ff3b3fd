import html
import re
import time

import pyarrow.parquet as pq
import pytest

from loomline.llm import pages

PROSE = "It was the best of times and it was the worst of times for all of us who were there. " * 4


def plain(page):
    """What the tables' own pages have between their article tags."""
    article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = (re.sub(r"<[^>]+>", "", re.sub(r"<br>", " ", p)) for p in re.split(r"</?(?:p|h1)>", article))
    return "\n\n".join(t for p in parts if (t := re.sub(r"\s+", " ", html.unescape(p)).strip()))


def test_query_equals_brute_force(spark, sf_dir):
    from loomline.llm.queries import op1_main_text

    want = {r.page_id: plain(r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = op1_main_text(spark, sf_dir).collect()
    assert {r.page_id: r.text for r in got} == want and len(got) == len(want)
    assert all(r.n_chars == len(r.text) for r in got)


def test_furniture_goes_and_prose_stays():
    page = f"""<html><head><title>x</title></head><body><header><h1>Site</h1></header><nav><a href=/>Home</a></nav>
    <div id=content><h2>Heading</h2><p>{PROSE}</p><p>Yes.</p><p>{PROSE}</p></div>
    <div class="side-bar sidebar"><p>{PROSE}</p></div><section class='comments'><p>{PROSE}</p></section>
    <form><p>{PROSE}</p></form><div class="cookie-notice">{PROSE}</div><script>var a = "<p>{PROSE}</p>";</script>
    <ul><li><a href=/a>One</a></li><li><a href=/b>Two</a></li></ul><footer>{PROSE}</footer></body></html>"""
    assert pages.main_text(page).split("\n\n") == ["Heading", PROSE.strip(), "Yes.", PROSE.strip()]


def test_text_rules():
    assert pages.main_text("<article><p>a &lt;b&gt;&nbsp;\n\t c &amp;amp; d<br>e<p>f<!-- <p>no</p> --></article>") == "a <b> c &amp; d e\n\nf"
    assert pages.main_text("<article><header><h1>T</h1></header><p>x</p><aside>y</aside></article>") == "T\n\nx"
    assert pages.main_text('<article><p title="a > b">x</p><p class="ad">y</p><p>z') == "x\n\nz"


def test_second_pass_takes_the_nearest_label():
    assert pages.second_pass(["good", "open", "good"]) == [True] * 3
    assert pages.second_pass(["bad", "open", "bad"]) == [False] * 3
    assert pages.second_pass(["good", "open", "open", "open", "bad"]) == [True, True, True, False, False]
    assert pages.second_pass(["bad", "near", "open", "bad", "open"]) == [False, True, True, False, False]
    assert pages.second_pass(["open", "open"]) == [True, True] and pages.second_pass([]) == []


@pytest.mark.parametrize("tag", ["div", "section", 'div class="text"', "td"])
def test_the_same_without_an_article_element(tag):
    rows = pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).column("html").to_pylist()
    renamed = lambda h: h.replace("<article>", f"<{tag}>").replace("</article>", f"</{tag.split()[0]}>")
    assert sum(pages.main_text(renamed(h)) != plain(h) for h in rows) == 0 and len(rows) == 250


def test_density_decides_without_telling_names():
    links = "".join(f"<li><a href=/{i}>A link with some words {i}</a></li>" for i in range(9))
    page = f"<body><div><ul>{links}</ul></div><div><h2>On a subject</h2><p>{PROSE}</p><p>So it was.</p><p>{PROSE}</p></div><div><p><a href=/x>Next</a></p><p><a href=/y>Previous</a></p></div></body>"
    assert pages.main_text(page).split("\n\n") == ["On a subject", PROSE.strip(), "So it was.", PROSE.strip()]


@pytest.mark.parametrize("part", ["<a ", "<div>", "<head>", "<div></section>", "</script ", "<a '", '<a "<b \'', "<!--", "<", "<p class=", "<![CDATA[", "&#"])
def test_broken_markup_takes_linear_time(part):
    began = time.process_time()
    pages.main_text(part * (1_000_000 // len(part)))
    assert time.process_time() - began < 5


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "<article>x</article>"), (3, "<p>" * 3000 + "x"), (4, "<article>" + "<p>word</p>" * 50_000), (4, "<<>< <a"), (4, "<script>")]
    got = pages.extract(spark.createDataFrame([(i, "u", h, 7) for i, h in rows], "page_id long, url string, html string, text int"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    texts = [r.text for r in got.orderBy("n_chars").collect()]
    assert len(texts) == len(rows) and texts[0] == "" and texts[-1] == "\n\n".join(["word"] * 50_000)
    assert pages.extract(got.withColumn("html", got.text).limit(0)).count() == 0
