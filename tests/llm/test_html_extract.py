import math
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from meterlight.llm import html_extract
from meterlight.llm.html_extract import extract, main_text

LONG = "Words of the article that go on for quite a while, so that their density is high."


def page(body, head=""):
    return f'<!DOCTYPE html><html><head><title>T</title>{head}</head><body>{body}</body></html>'


CASES = [
    (None, ""),
    ("", ""),
    ("plain text &amp; more", "plain text & more"),
    (page("<nav><a href=/>Home</a></nav><article><h1>A</h1><p>x <b>y</b>z<br>w</p></article><footer>f</footer>"), "A x yz w"),
    (page("<article><p>short</p></article><div>" + LONG * 5 + "</div>"), "short"),
    (page("<article>bare text</article>"), "bare text"),
    (page('<main><p>m</p><aside>s</aside><article class="comment">c</article></main>'), "m"),
    (page(f'<div class="content"><p>{LONG}</p><div class="ad-box">Buy!</div><p>{LONG}</p></div><div id="sidebar"><a href=1>one</a></div>'), f"{LONG} {LONG}"),
    (page(f'<article><header><h1>H</h1></header><p>{LONG}<p>b<form><input value="v">go</form><section class="comments">c</section></article>'), f"H {LONG} b"),
    (page(f"<article><script>if (a < b) {{ x = '</p>' }}</script><style>p{{}}</style><p>{LONG}</p><!-- <p>no</p> --></article>"), LONG),
    (page("<article><p>a&nbsp;&lt;b&gt; &#233;&#x1F600;</p></article>"), "a <b> é\U0001f600"),
    (page('<article><p>a <a href="x>y">b</a></p><ul><li>c<li>d</ul><table><tr><td>e<td>f</table></article>'), "a b c d e f"),
    (page('<article><p>a</p><p hidden>b</p><p style="display: none">c</p><div aria-hidden="true">d</div></article>'), "a"),
    (page('<div class="page-with-sidebar"><article><p>kept</p></article></div>'), "kept"),
    (page("<article><p>unclosed <b>bold <p>next</article> after"), "unclosed bold next"),
    ("<p>a<p>b<div>c</div>", "a b c"),
    ("<article><p>x" + "<i>" * 5000 + "deep", "xdeep"),
    ('<article><p title="never closed>text', "text"),
]


@pytest.mark.parametrize("given,expected", CASES)
def test_pages(given, expected):
    assert main_text(given) == expected


def test_densest_container_wins_without_semantic_tags():
    links = "".join(f"<li><a href={i}>some menu entry number {i}</a></li>" for i in range(40))
    body = f"<div><ul>{links}</ul></div><div><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div>"
    assert main_text(page(body)) == " ".join([LONG] * 3)


def test_rows(spark):
    rows = [(1, "http://a/x", CASES[3][0], "t"), (2, None, None, "t"), (2, None, None, "t"), (None, "u", "<article>" + "long " * 100000, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = extract(pages)
    assert got.columns == ["page_id", "url", "text"]
    assert sorted((r.page_id or 0, r.text[:12], len(r.text)) for r in got.collect()) == [(0, "long long lo", 499999), (1, "A x yz w", 8), (2, "", 0), (2, "", 0)]
    assert extract(pages.where("false")).count() == 0


def test_words_of_classes_are_read_whole():
    kept = f'<div class="share-price"><p>{LONG}</p></div><section id="related-work"><p>{LONG}</p></section>'
    gone = '<div class="ad-box"><p>Buy!</p></div><div class="related links">more</div><div id="cookie-banner">ok?</div>'
    assert main_text(page(f"<article><p>{LONG}</p>{kept}{gone}</article>")) == " ".join([LONG] * 3)


def test_links_beside_the_trunk_go():
    links = "".join(f"<li><a href={i}>another story, number {i}</a></li>" for i in range(9))
    text = f"<p>{LONG}</p><p>{LONG} <a href=x>source</a></p><p>See <a href=y>this</a>.</p><ul><li><a href=z>kept</a></li></ul>"
    assert main_text(page(f"<article><h1>T</h1><div>{text}</div><div><ul>{links}</ul></div></article>")) == f"T {LONG} {LONG} source See this. kept"


def test_densities_by_definition():
    links = "".join(f"<li><a href={i}>entry {i}</a></li>" for i in range(5))
    dom = html_extract.Dom(page(f"<nav>{links}</nav><div><ul>{links}</ul></div><div><h1>H</h1><p>{LONG} <b>x</b><a href=z>y</a></p><p>{LONG}</p></div>"))
    noise = html_extract._noise(dom)
    density, sums, body, _ = html_extract._densities(dom, noise)

    def within(i, top):
        while i > top:
            i = dom.parent[i]
        return i == top

    def linked(i):
        return i > 0 and (dom.name[i] == "a" or linked(dom.parent[i]))

    def measures(top):
        texts = [(i, len(t.strip())) for i, t in dom.flow if t is not None and not noise[i] and within(i, top)]
        tags = [i for i in range(len(dom.name)) if i > top and not noise[i] and within(i, top)]
        return sum(n for _, n in texts), len(tags), sum(n for i, n in texts if linked(i)), sum(dom.name[i] == "a" for i in tags)

    share = measures(body)[2] / measures(body)[0]
    for i in range(len(dom.name)):
        c, t, lc, lt = measures(i)
        if noise[i] or not c:
            assert density[i] == 0
            continue
        base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
        ratio = max(c / max(lc, 1) * max(t, 1) / max(lt, 1), 1)
        assert density[i] == pytest.approx(c / max(t, 1) * math.log(ratio) / math.log(base))
        inner = [k for k in range(len(dom.name)) if dom.parent[k] == i and dom.name[k] in html_extract.BLOCK]
        assert sums[i] == pytest.approx(sum(density[k] for k in inner))


def test_query_needs_no_article_tags(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    pages.withColumn("html", F.regexp_replace("html", r"<(/?)(?:article|main)\b", "<$1div")).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.text for r in html_extract.op8_html_extract(spark, str(tmp_path)).collect()}
    assert got == {r.page_id: r.text for r in html_extract.op8_html_extract(spark, "/root/testdata/sf0.001").collect()}


def test_text_that_lies_in_the_body_is_kept():
    long, more = "long text of many words " * 20, "more text " * 40
    body = f"<h1>Title here</h1><p>{long}</p><p>Short end.</p><p>{more}</p>"
    menu = "<div><a href=a>Home page</a> <a href=b>All the news</a> <a href=c>Contact us</a></div>"
    wanted = " ".join(f"Title here {long} Short end. {more}".split())
    assert html_extract.main_text(f"<body>{body}</body>") == wanted
    assert html_extract.main_text(f"<body>{menu}{body}</body>") == wanted
    assert html_extract.main_text(f"<body>{menu}<article>{body}</article></body>") == wanted
    assert html_extract.main_text(body) == wanted


def test_pages_without_their_wrapper_tags_give_the_same_text():
    pages = pd.read_parquet("/root/testdata/sf0.01/pages.parquet").html
    for page in pages.dropna():
        assert html_extract.main_text(re.sub(r"</?(article|main|section)\b[^>]*>", "", page)) == html_extract.main_text(page)
