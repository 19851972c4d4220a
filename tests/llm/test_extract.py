import html
import re

import pytest

from modlens.llm.common import documents
from modlens.llm.extract import extracted, main_text

SF01 = "/root/testdata/sf0.01"

BODY = "<p>The first paragraph of the article is long enough to be read.</p><p>Ok.</p><h2>Part &amp; two</h2><p>Another&nbsp;one\n with  <b>bold</b> and <a href='x'>a link</a>.</p>"
WANT = "Title here\nThe first paragraph of the article is long enough to be read.\nOk.\nPart & two\nAnother one with bold and a link."


def page(inside, before="", after=""):
    return ("<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t='</p>no';</script></head><body>"
            f"{before}{inside}{after}</body></html>")


OUT = [
    "<nav><ul><li><a href='/'>Home</a></li><li>News</li></ul></nav>", "<header><h1>Site</h1><p>Slogan of the site</p></header>",
    "<footer>&copy; somebody, some where, some time</footer>", "<aside><p>Read more of this and of that on the side</p></aside>",
    "<div class='ad'>Buy this now, it is cheap and good and red</div>", "<div id='cookie-notice'>We use cookies. <button>Yes</button></div>",
    "<form><label>Name</label><input name=a><select><option>One</select></form>", "<!-- ad 1 -->",
    "<section class='comments'><p>I am a reader and I have a long opinion about all of it, really.</p></section>",
    "<div class=\"sidebar\"><p>Popular things that other people have read lately</p></div>", "<noscript>Turn on scripts</noscript>",
    "<div role='navigation'><a href=1>1</a> <a href=2>2</a></div>", "<div hidden>unseen</div>",
]


@pytest.mark.parametrize("part", OUT)
@pytest.mark.parametrize("tag", ["article", "main"])
def test_boilerplate_goes_wherever_it_stands(part, tag):
    body = f"<{tag}><h1>Title here</h1>{BODY}</{tag}>"
    assert main_text(page(body, before=part)) == WANT
    assert main_text(page(body, after=part)) == WANT
    assert main_text(page(body.replace("<p>Ok.</p>", part + "<p>Ok.</p>"))) == WANT


def test_page_without_article():
    menu = "<div><a href=1>One</a></div><div><a href=2>Two</a></div>"
    assert main_text(page(f"<div id=content><h1>Title here</h1>{BODY}</div>", before=menu, after=menu)) == WANT


def test_broken_markup_and_blanks():
    assert main_text("<article><p><b>One two.<br><p>Three &am four &lt;x&gt;<p class=ad>no<p>Five") == "One two.\nThree &am four <x>\nFive"
    assert main_text(None) == main_text("") == main_text("<html></html>") == ""
    assert main_text("plain words only") == "plain words only"
    assert main_text("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


def test_given_pages_against_the_markup(spark):
    pages = documents(spark, SF01, "pages")
    got = {r["page_id"]: r for r in extracted(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S).group(1)
        blocks = re.split(r"</?(?:p|h1)\b[^>]*>", article.replace("<br>", " "))
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks]
        assert got[r["page_id"]]["text"] == "\n".join(b for b in want if b)
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"]) and got[r["page_id"]]["url"] == r["url"]


def test_edge_cases(spark):
    long = "<article>" + "<p>Some words in a line.</p>" * 60_000 + "</article>"
    rows = [(1, "u", None, 7), (2, "u", "", 7), (3, "u", long, 7), (4, "u", "<article>a</article>", 7), (4, "u", "<article>a</article>", 7)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, n_chars int")
    got = sorted((r["page_id"], r["n_chars"]) for r in extracted(df).collect())
    assert got == [(1, 0), (2, 0), (3, 60_000 * 22 - 1), (4, 1), (4, 1)]
    assert extracted(df.limit(0)).collect() == []


@pytest.mark.parametrize("part", [
    "<section id='discussion'><p>What follows discusses it all.</p></section>", "<div class='social-impact'><p>It changed lives.</p></div>",
    "<section class='related-work'><p>Others did so too.</p></section>", "<div id='search-algorithms'><p>Sorting comes first.</p></div>",
    "<div class='alert-levels'><p>Red is worst.</p></div>"])
def test_sections_named_by_a_topic_stay_in_an_article(part):
    words = re.sub("<[^>]*>", "", part)
    assert main_text(page(f"<article><h1>Title here</h1>{part}{BODY}</article>")) == WANT.replace("Title here", "Title here\n" + words)


@pytest.mark.parametrize("part", [
    "<div class='related-posts'><p>Read this one next.</p></div>", "<div class='share'>Tell all of your friends</div>",
    "<div id='social-share-buttons'>Send it on</div>", "<p class='alert'>Mind the gap</p>", "<div role='search'>Find things</div>"])
def test_marked_parts_of_an_article_go(part):
    assert main_text(page(f"<article><h1>Title here</h1>{part}{BODY}</article>")) == WANT


@pytest.mark.parametrize("part, text", [
    ("<ul><li>One</li><li>Two</li></ul>", "One\nTwo"), ("<blockquote><p>Short.</p></blockquote>", "Short."),
    ("<table><tr><td>1</td><td>2</td></tr></table>", "1\n2"), ("<pre>x = 1</pre>", "x = 1"),
    ("<ol><li>A<ul><li>b</li></ul></li></ol>", "A\nb")])
def test_inner_parts_of_a_body_without_article_stay(part, text):
    menu = "<ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul>"
    body = f"<div id=content><h1>Title here</h1>{BODY}{part}{BODY}</div>"
    assert main_text(page(body, before=menu)) == WANT + "\n" + text + WANT.replace("Title here", "")
