import html as entities
import re

import pytest

from airstats.llm import html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p > b {x:y}</style></head><body class="has-sidebar">
<header><h1>Site</h1><nav><a href=/>Home</a></nav></header><div id="cookie-notice">We use cookies</div>
<div class="menu"><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></div>
<div class="wrap"><div class="content col-8"><h2>Title &amp; more</h2><p>First&nbsp;paragraph   of
the <b>text</b>.<br>Same block &lt;here&gt;.<p>Second one, with <a href="x>y">a link</a> inside of it.
<script>var x = "<p>no</p>";</script><!-- <p>no</p> --><ul><li>item one<li>item two</ul>
<form><p>Sign up</p><input name=q></form><table><tr><td>cell<td>next</table></div>
<aside><p>Aside text that is quite long indeed, but no article.</p></aside></div>
<div class="comments"><p>A reader says something rather long about all this, and more, and more.</p></div>
<footer>&copy; us</footer></body></html>"""
TEXT = ["Title & more", "First paragraph of the text. Same block <here>.", "Second one, with a link inside of it.",
        "item one", "item two", "cell", "next"]


def test_page_by_page():
    assert html.main_text(PAGE, []) == "\n\n".join(TEXT)


def test_generalised_path():
    path, weight = html.vote(PAGE)
    assert path == "html/html/body.has-sidebar/div.wrap/div.col-#.content" and weight > 50


@pytest.mark.parametrize("source", [None, "", "   ", "plain text", "<p>a", "a < b", "<", "<div", "<a href='", "</p></div>",
                                    "<!-- open", "<script>x", "<form>only <p>form</p></form>", "<p title=\"a>b\">x</p>"])
def test_odd_pages(source):
    text = html.main_text(source, ["nowhere"])
    want = {"plain text": "plain text", "<p>a": "a", "a < b": "a < b", "<": "<", "<p title=\"a>b\">x</p>": "x",
            "<form>only <p>form</p></form>": "only\n\nform"}
    assert text == want.get(source, "")


def test_long_page_with_open_quotes():
    assert html.main_text("<div class=\"" + "x" * 200_000 + "<p>t</p>", []) is not None
    assert len(html.main_text("<p>word </p>" * 20_000, [])) == 20_000 * 6 - 2


def test_consensus_beats_a_page_with_long_comments(spark):
    def page(article, talk):
        return f"<body><div class='post p{len(article)}'><p>{article}</p></div><div class='talk'><p>{talk}</p></div></body>"

    rows = [(i, "http://A.example/x", page(f"article {i} " * 30, "hm"), "h", 0) for i in range(5)]
    rows += [(9, "http://a.example/y?q", page("short", "much talk " * 40), "h", 0), (10, None, None, None, 1),
             (11, "nonsense", page("lonely text", ""), None, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, salt int")
    got = {r["page_id"]: r for r in html.extracted(pages).collect()}
    assert len(got) == len(rows)
    assert got[9]["text"] == "short" and got[0]["text"] == ("article 0 " * 30).strip()
    assert got[10]["text"] == "" and got[10]["n_chars"] == 0 and got[10]["url"] is None
    assert got[11]["text"] == "lonely text"
    assert html.extracted(pages.limit(0)).count() == 0


def test_given_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r["page_id"]: r for r in html.extracted(pages).collect()}
    for row in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", row["html"], re.S)[1]
        inner = re.sub("<[^>]*>", "", re.sub("<br>", " ", re.sub("</?(p|h1)>", "\0", inner)))
        blocks = [" ".join(entities.unescape(b).split()) for b in inner.split("\0")]
        assert got[row["page_id"]]["text"] == "\n\n".join(filter(None, blocks))


LONG = "text that goes on " * 20


@pytest.mark.parametrize("inner, want", [
    (f"<h1>Title</h1><p>lead</p><div class=body><p>{LONG}</p></div>", ["Title", "lead", LONG.strip()]),
    (f"<section><p>{LONG}</p></section><section><p>second</p></section>", [LONG.strip(), "second"]),
    (f"<p>{LONG}</p><ol><li><a href=/a>First source</a><li><a href=/b>Second source</a></ol>",
     [LONG.strip(), "First source", "Second source"])])
@pytest.mark.parametrize("tag", ["article", "main"])
def test_articles_are_whole(tag, inner, want):
    page = f"<body><ul><li><a href=/>Home</a><li><a href=/x>More</a></ul><{tag}>{inner}</{tag}><p>other</p></body>"
    assert html.vote(page)[0].endswith(f"/{tag}")
    assert html.main_text(page, [html.vote(page)[0]]) == "\n\n".join(want)


def test_main_with_an_article_and_further_text():
    page = f"<body><main><article><p>{LONG}</p></article><p>more {LONG}</p></main></body>"
    assert html.main_text(page, []) == f"{LONG.strip()}\n\nmore {LONG.strip()}"


@pytest.mark.parametrize("page, want", [
    (f"<div class=content><h1>Title</h1><p>Lead</p><div class=body><p>{LONG}</p></div></div>", ["Title", "Lead", LONG.strip()]),
    (f"<div class=text><p>{LONG * 3}</p></div><div class=text><p>{LONG}</p></div>", [(LONG * 3).strip(), LONG.strip()]),
    (f"<article class=one><p>{LONG}</p></article><article class=two><p>short</p></article><p>other</p>", [LONG.strip(), "short"]),
    (f"<article><p>a {LONG}</p></article><article><p>b {LONG}</p></article><article><p>c {LONG}</p></article>",
     [f"{c} {LONG.strip()}" for c in "abc"]),
    (f'<article><p class="share">Share of market rose</p><p>{LONG}</p></article>', ["Share of market rose", LONG.strip()]),
    (f'<article><p>{LONG}</p><div class="search-results-analysis"><p>x</p></div></article>', [LONG.strip(), "x"]),
    (f'<article><p>{LONG}</p><div class="share-buttons"><p>x</p></div><div class="ad-slot">y</div></article>', [LONG.strip()]),
    (f'<article><p>{LONG}</p><div class="comment entry"><p>I disagree</p></div></article>', [LONG.strip()]),
    (f'<main class="has-comments"><p>{LONG}</p></main><article class="comment"><p>I disagree</p></article>', [LONG.strip()])])
def test_titles_sections_and_comments(page, want):
    page = f"<body><nav>Home</nav>{page}<footer>us</footer></body>"
    assert html.main_text(page, []) == "\n\n".join(want)
    assert html.main_text(page, [html.vote(page)[0]]) == "\n\n".join(want)


def test_pages_are_not_shuffled_to_meet_small_tables(spark, sf_dir):
    plan = html.extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
