import html
import random
import re

import numpy as np
import pytest

from quire.llm import html_extract

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<div class="topMenu"><ul><li><a href="/">Home</a></li><li><a>About us</a></li></ul></div>
<div id="cookie-notice">We use cookies to improve things on this site for everybody.</div>
<div class="content"><h1>The title</h1><p>First para &amp; more words to read here &#233;.</p><p>Second   para
goes on<br>with a <a href="x">link inside</a> it and <b>on</b> and on.</p>
<div class="ad">Buy this thing now or never</div><script>var t = "</p>";</script><form><input><label>Mail</label></form>
<p>Third paragraph&nbsp;of many words, a &lt; b &copy;.</p></div>
<div class="sidebar"><p>Something else here to read now</p></div>
<section id="comments"><p>Nice post! I like it very much indeed.</p></section><div class="footer">Copyright words here</div></body></html>"""
TEXT = "The title\nFirst para & more words to read here é.\nSecond para goes on with a link inside it and on and on.\nThird paragraph of many words, a < b ©."


@pytest.mark.parametrize("page", [PAGE, PAGE.replace('"content"', '"x"'), PAGE.replace('<div class="content">', "<article>").replace("many words, a &lt; b &copy;.</p></div>", "many words, a &lt; b &copy;.</p></article>"), PAGE.replace("</body></html>", "")])
def test_boilerplate_is_left_out(page):
    assert html_extract.extract(page) == TEXT


def brute_best(scores):
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    return max(0.0, max((float((sums[i + 1 :] - sums[i]).max()) for i in range(len(scores))), default=0.0))


def test_scan_finds_the_maximum(spark):
    rng = random.Random(1)
    parts = ["<p>", "</p>", "<div>", "</div>", "<li>", " some words ", " a longer run of words here ", "<a>link</a>", "<nav>menu</nav>"]
    made = ["".join(rng.choice(parts) for _ in range(25)) for _ in range(30)]
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    weights = html_extract.train(pages)
    for page in made + [r.html for r in pages.limit(100).collect()]:
        for w in (weights, html_extract.Weights()):
            scores = [t[2] for t in html_extract.tokens(page, w)]
            first, last, best = html_extract.region(scores)
            assert best == pytest.approx(brute_best(scores))
            assert sum(scores[first:last]) == pytest.approx(best)


@pytest.mark.parametrize(
    "inner",
    ["<p>Energy is <math>E m c</math> here.</p>", '<p class="popular">Energy is E m c here.</p>', '<div class="search-results-study"><p>Energy is E m c here.</p></div>', "<p>Energy is <a>E</a> <object>m</object> c here.</p>", "<ul><li>Energy is E m c here.</li></ul>"],
)
def test_text_of_the_article_stays(inner):
    page = f"<html><body><nav><a>Home</a></nav><article><h1>On mass and light</h1><p>A first paragraph of words.</p>{inner}<p>A last paragraph of words.</p></article><footer>foot</footer></body></html>"
    assert html_extract.extract(page) == "On mass and light\nA first paragraph of words.\nEnergy is E m c here.\nA last paragraph of words."


def test_marks_are_not_looked_at(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    weights = html_extract.train(pages)
    for r in pages.collect():
        assert html_extract.extract(r.html, weights) == html_extract.extract(re.sub("</?article>", "", r.html), weights)


def test_weights_are_learned_from_labelled_pages():
    page = '<body><div class="zeta">' + "left out words of a part " * 40 + "</div><article><div class='kappa'><p>" + "words of the text " * 40 + "</p></div></article></body>"
    seen = html_extract.counts(page * 1)
    for _ in range(5):
        seen += html_extract.counts(page)
    weights = html_extract.learned(seen)
    assert weights.of("name:zeta") < html_extract.EXCLUDED < 0 < weights.of("name:kappa")
    text = '<div class="zeta">one two</div><p>three four five</p>'
    assert html_extract.extract(text, weights) == "three four five" and html_extract.extract(text) == "one two\nthree four five"
    assert html_extract.counts("<p>no mark</p>") == {}


PARA = "Some words of a paragraph that tell of things at length, and more of them so that it counts."
ARTICLE = "<h1>The title of it</h1>" + f"<p>{PARA}</p>" * 3
MENU = "<ul>" + "".join(f'<li><a href="/x{k}">Item {k}</a></li>' for k in range(6)) + "</ul>"


@pytest.mark.parametrize("learn", [False, True])
@pytest.mark.parametrize(
    "page, there, absent",
    [
        (f"<nav>{MENU}</nav><div class='post'>{ARTICLE}<ul><li>first point of the list here</li><li>second point of the list</li></ul></div><footer>Copyright words</footer>", ["first point", "second point"], ["Item", "Copyright"]),
        (f"<div>{MENU}</div><div>{ARTICLE}<p>Last words end here now.</p></div><div>{MENU}</div>", ["Last words"], ["Item"]),
        (f"{MENU}<div>{ARTICLE}<p>See <a>this link</a>.</p></div>", ["See this link."], ["Item"]),
        (f"<article>{ARTICLE}<div class='ad'>Buy now</div><aside>Aside words</aside>{ARTICLE}<div class='comments'><p>{PARA} comment</p></div></article>", ["The title"], ["Buy", "Aside", "comment"]),
        (f"<main>{ARTICLE}<table><tr><td>cell one</td><td>cell two</td></tr></table><blockquote>A quote here</blockquote><pre>code x</pre></main>", ["cell one", "cell two", "A quote", "code x"], []),
        (f"<nav>{MENU * 3}</nav><article><h1>Short</h1><p>Only this.</p></article><footer>foot {MENU}</footer>", ["Short", "Only this."], ["Item", "foot"]),
        (f"<article>{ARTICLE}</article><div class='related-posts'><ul><li><a>Another long article title that is linked</a></li></ul></div>", ["The title"], ["Another"]),
        (f"<div id='header'>Site name</div><div class='main-content'><section>{ARTICLE}</section><section>{ARTICLE}<ol><li>one thing more</li></ol></section></div><div id='footer'>foot words</div>", ["one thing more"], ["Site name", "foot words"]),
        (f"<div>{ARTICLE}<form><label>Your mail</label><button>Send</button></form><p>After the form there is text too.</p></div>", ["After the form"], ["Your mail", "Send"]),
    ],
)
def test_pages_of_other_makes(page, there, absent, learn):
    """Weights learned from pages of one make, whose lists and links are all in menus, still do on others."""
    weights = html_extract.Weights()
    if learn:
        seen = sum((html_extract.counts(f"<html><body><nav>{MENU}</nav><div class='ad'>Buy it.</div><article>{ARTICLE * 3}</article><footer>foot</footer></body></html>") for _ in range(200)), start=html_extract.Counter())
        weights = html_extract.learned(seen)
    text = html_extract.extract(f"<html><body>{page}</body></html>", weights)
    assert "The title of it" in text or "Short" in text
    assert [t for t in there if t not in text] == [] and [t for t in absent if t in text] == []


NAMED = ['section id="discussion"', 'section class="related-work"', 'div class="share-prices"', 'div class="social-history"', 'div class="notice-text"', 'div class="popular"', 'div id="search"']


@pytest.mark.parametrize("learn", [False, True])
@pytest.mark.parametrize("mark", ["article", "div"])
@pytest.mark.parametrize("named", NAMED)
def test_a_name_is_weighed_against_what_stands_in_it(spark, named, mark, learn):
    weights = html_extract.train(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")) if learn else html_extract.Weights()
    tag = named.split()[0]
    links = "".join(f'<li><a href="/{k}">Read this one number {k}</a></li>' for k in range(5))
    replies = "".join(f"<li><b>Ann {k}</b> I think so too {k}</li>" for k in range(4))
    for where in ("inside", "outside"):
        for filling, stays in ((f"<h2>Over it</h2><p>{PARA} QQQ</p>", True), (f"<ul>{links}</ul>", False), (f"<ul>{replies}</ul>", False), ('<a href="/t">Tell others</a> <a href="/m">Send mail</a>', False)):
            block = f"<{named}>{filling}</{tag}>"
            body = f"<{mark}>{ARTICLE}{block}<p>Last words of it all are these.</p></{mark}>" if where == "inside" else f"<{mark}>{ARTICLE}<p>Last words of it all are these.</p></{mark}>{block}"
            text = html_extract.extract(f"<html><body><nav>{MENU}</nav>{body}<footer>foot words</footer></body></html>", weights)
            assert "The title of it" in text and "Last words" in text and "Item" not in text and "foot" not in text
            if where == "inside" and stays:
                assert "QQQ" in text and "Over it" in text
            assert stays or not [w for w in ("Read this", "I think", "Tell others") if w in text]


@pytest.mark.parametrize("named", ['div class="ad"', 'div class="cookie-notice"', 'section class="comments"', 'div class="sidebar"', 'div class="notice"'])
def test_names_of_one_meaning_and_notices_go(named):
    inner = "Short words here now" if "notice" in named else f"<p>{PARA * 3}</p>"
    text = html_extract.extract(f"<html><body><article>{ARTICLE}<{named}>{inner}</{named.split()[0]}><p>Last words of it.</p></article></body></html>")
    assert text == "The title of it\n" + f"{PARA}\n" * 3 + "Last words of it."


def plain_tree(page):
    """The blocks that a plain reading of a well-formed page leaves: the region is all of it."""
    import xml.etree.ElementTree as ET

    def words(e, link=False, prose=True):
        link, prose = link or e.tag == "a", prose and e.tag not in html_extract._NO_PROSE
        own = lambda t: len((t or "").split()) * (-2 if link else 1 if prose else 0)
        if out(e):
            return 0
        return own(e.text) + sum(words(c, link, prose) + own(c.tail) for c in e)

    def inner(e):
        own = lambda t: len((t or "").split())
        return own(e.text) + sum(words(c) + own(c.tail) for c in e)

    def out(e):
        names = e.get("class", "").split("-")
        if e.tag in ("nav", "aside") or "ad" in names:
            return True
        weight = sum(html_extract.prior(f"name:{n}") for n in names) / len(names)
        return weight <= html_extract.DOUBTED and html_extract.NAME_WORDS * weight + inner(e) < 0

    blocks = [""]

    def walk(e):
        if e.tag in html_extract.BLOCK:
            blocks.append("")
        if not out(e):
            blocks[-1] += e.text or ""
            for c in e:
                walk(c)
                blocks[-1] += c.tail or ""
        if e.tag in html_extract.BLOCK:
            blocks.append("")

    walk(ET.fromstring(page))
    return [" ".join(b.split()) for b in blocks if b.split()]


def test_extraction_is_a_plain_reading_of_small_pages():
    rng = random.Random(6)
    names = ["popular", "share-bar", "related-work", "ad", "notice", "kappa", "search"]

    def block(depth):
        kind = rng.randint(0, 5 if depth else 3)
        if kind <= 1:
            return "<p>" + "words of a text " * rng.randint(1, 6) + "</p>"
        if kind == 2:
            return "<ul>" + "<li>an item</li>" * 3 + "</ul>"
        if kind == 3:
            return "<p>see <a>one link</a> and so on here</p>"
        return f'<div class="{rng.choice(names)}">' + "".join(block(depth - 1) for _ in range(rng.randint(1, 3))) + "</div>"

    for _ in range(150):
        long = "<p>" + "words of the article " * 60 + "</p>"
        page = "<body>" + long + "".join(block(2) for _ in range(4)) + long + "</body>"
        assert html_extract.extract(page).split("\n") == plain_tree(page)


def test_deep_nesting_is_linear():
    import time

    began = time.time()
    assert html_extract.extract("<div>" * 40000 + "words of a page" + "</span>" * 40000 + "</div>" * 40000) == "words of a page"
    assert time.time() - began < 5


@pytest.mark.parametrize("page", ["", None, "<", "<p", "<!-- x", "plain words", "<script>x", "</p></div>", "<p>a<p>b", "<a href='x\">y</a>", "\x00<p>\x00x"])
def test_odd_pages(page):
    assert isinstance(html_extract.extract(page), str)


def test_articles_come_out_whole(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in html_extract.main_texts(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert got[r.page_id] == "\n".join(b for b in blocks if b)


def test_nulls_repeats_and_empty_table(spark):
    rows = [(1, "u", PAGE, 1), (1, "u", PAGE, 2), (None, None, None, None), (2, "v", "", 3)]
    out = html_extract.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string, text int"))
    assert sorted((tuple(r) for r in out.collect()), key=repr) == sorted([(1, "u", TEXT, len(TEXT))] * 2 + [(None, None, "", 0), (2, "v", "", 0)], key=repr)
    assert html_extract.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
