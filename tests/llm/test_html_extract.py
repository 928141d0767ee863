import math

import numpy as np
import pyarrow.parquet as pq
import pytest

from strandloom.llm import html_extract as H
from strandloom.llm.html_extract import content_lines, extract_pages, main_text

BODY = "".join(f"<p>Paragraph {k} has <b>some</b> words &amp; a few&nbsp;more &lt;signs&gt;,\n  over\tlines.</p>" for k in range(6))
WANT = " ".join(f"Paragraph {k} has some words & a few more <signs>, over lines." for k in range(6))
CHROME = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p><article>";</script></head><body class="has-sidebar">
<header class="site"><a href="/">Home of things</a></header><nav><ul><li><a href="a">One</a></li></ul></nav>
<div class="cookie-notice">We use cookies for everything you do on this page.</div><div id="ad-slot" class="ad">Buy this now, it is very cheap today.</div>"""
TAIL = """<section id="comments"><p>A reader says that this is a very long comment about the text above.</p></section>
<aside><p>Other stories of today that you may want to read.</p></aside><form><label>Mail</label><input name=m><button>Send</button></form>
<div role="complementary">More</div><footer>&copy; all rights kept</footer></body></html>"""


def test_article_without_the_rest():
    page = f"{CHROME}<article><h1>Head line</h1>{BODY}<script>1</script><div class='share'>Share this</div></article>{TAIL}"
    assert main_text(page) == f"Head line {WANT}"
    assert main_text(page[: page.index("</article>")]) == f"Head line {WANT} Share this"[: len(f"Head line {WANT}")]
    assert main_text(page.replace("article", "main")) == f"Head line {WANT}"


def test_without_an_article_regions_are_chosen_by_ratio():
    page = f"{CHROME}<div><a>x</a> <a>y</a></div><div>{BODY}</div><div><a>z</a></div>{TAIL}"
    assert main_text(page) == WANT
    assert main_text(f"{CHROME}<div class='post-content'><h2>Head</h2>{BODY}<p>End.</p></div>{TAIL}") == f"Head {WANT} End."


def test_short_article_unclosed_elements_and_breaks():
    assert main_text("<nav>a long menu of many words that go on</nav><article><h1>A</h1><p><b>B<br><p>C &amp; d<p>e<li>f<li>g") == "A B C & d e f g"


def test_articles_in_main_and_articles_of_comments():
    page = f"{CHROME}<main><h2>Latest</h2><article><h1>Head</h1>{BODY}</article><article class='comment'><p>I think so too, and at length.</p></article></main>{TAIL}"
    assert main_text(page) == f"Head {WANT}"
    assert main_text("<main><article><p>One and two and three.</p></article><article><p>Four and five and six.</p></article></main>") == "One and two and three. Four and five and six."


def test_degenerate_pages():
    for page, text in ((None, ""), ("", ""), ("<html></html>", ""), ("just  text\n", "just text"), ("<p>&#65;&eacute", "Aé"), ("<!-- only -->", ""), ("<nav>menu</nav>", "")):
        assert main_text(page) == text
    assert content_lines(__import__("numpy").array([5.0])).tolist() == [True]


def test_columns_and_rows(spark):
    page = f"<article>{BODY}</article>"
    rows = [(1, "u", page, "old", 3), (1, "u", page, "old", 3), (2, None, None, None, None), (3, "v", f"<article><p>{'word ' * 50000}</article>", "", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    out = extract_pages(pages)
    assert out.columns == ["page_id", "url", "text", "n_chars"] and dict(out.dtypes)["n_chars"] == "bigint"
    assert sorted((r["page_id"], r["n_chars"]) for r in out.collect()) == [(1, len(WANT)), (1, len(WANT)), (2, 0), (3, 249999)]
    assert extract_pages(pages.limit(0)).collect() == []


@pytest.fixture(scope="module")
def pages():
    return pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).column(0).to_pylist()


def brute(html):
    """The text by the scorer's definition, line by line."""
    parser = H._Lines()
    parser.feed(html or "")
    parser.close()
    parser.end_line()
    prior, section = H.priors(parser.lines, parser.kinds)
    raw = [math.log(1 + len(x.text) / x.tags) + p for x, p in zip(parser.lines, prior)]
    smooth = []
    for i in range(len(raw)):
        near = [k for k in range(max(0, i - 3), min(len(raw), i + 4)) if section[k] == section[i]]
        weights = [math.exp(-(((k - i) / 1.5) ** 2) / 2) for k in near]
        smooth.append(sum(w * raw[k] for w, k in zip(weights, near)) / sum(weights))
    if not smooth:
        return ""
    cut = sum(smooth) / len(smooth)
    for _ in range(50):
        high, low = [x for x in smooth if x >= cut], [x for x in smooth if x < cut]
        cut = (sum(high) / len(high) + sum(low) / len(low)) / 2 if high and low else min(smooth)
    cut = min(max(cut, H.LEAST), H.MOST)
    return " ".join(x.text for x, v in zip(parser.lines, smooth) if v >= cut)


def test_scorer_matches_brute_force(pages):
    assert [main_text(x) for x in pages] == [brute(x) for x in pages]


def test_the_clusters_choose_the_lines(pages, monkeypatch):
    found = [main_text(x) for x in pages]
    for other in (lambda r, *_: np.ones(len(r), bool), lambda r, *_: np.zeros(len(r), bool), lambda r, *_: np.arange(len(r)) < 1):
        monkeypatch.setattr(H, "content_lines", other)
        changed = sum(a != main_text(x) for a, x in zip(found, pages))
        assert changed > len(pages) / 3


def test_ratios_decide_where_the_page_names_no_part():
    text = "".join(f"<div>Some {k} words that a reader came for, one after the other, in a plain division.</div>" for k in range(5))
    menu = "".join(f"<div><b>{w}</b><i>{w}</i><u>x</u></div>" for w in ("Home", "News", "Jobs", "Help", "Shop", "More", "Sale", "Play"))
    found = main_text(f"<body>{menu}{text}{menu}</body>")
    assert "Some 0 words" in found and "Some 4 words" in found and not any(w in found for w in ("News", "Jobs", "Help", "Shop", "More"))
    assert "Home" in main_text(f"<body><article>{menu}</article>{text}</body>")
