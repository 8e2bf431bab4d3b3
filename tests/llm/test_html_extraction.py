"""Wrapper induction on planted sites, on odd pages, and against a plain reading of the given tables."""

import json
import random
from html.parser import HTMLParser

import pytest

from quern.llm import html_extraction as h
from quern.llm.dom import parse
from quern.llm.storage import Workspace

RNG = random.Random(5)
WORDS = ["".join(RNG.choices("abcdefghijklmnoprstuvw", k=RNG.randint(2, 9))) for _ in range(900)]


def prose(n=40):
    return " ".join(RNG.choices(WORDS, k=n))


def plain_site(k):
    """A site of bare divs: only alignment tells its constant parts from its text."""
    paragraphs = [prose() for _ in range(RNG.randint(1, 6))]
    title = prose(5)
    html = f"""<html><head><title>{title}</title></head><body><div><div>The Daily Example</div><div>Edition for readers everywhere</div></div>
    <div><a href=/1>{prose(2)}</a> <a href=/2>{prose(2)}</a></div>
    <div><h2>{title}</h2>{"".join(f"<p>{p}</p>" for p in paragraphs)}<div>Thank you for reading the Example.</div></div>
    <div><p>All rights reserved by the Example</p></div></body></html>"""
    return html, [title, *paragraphs]


def article_site(k):
    """Everything that is not the main text, with varying words, around and inside an article."""
    paragraphs = [prose() for _ in range(RNG.randint(1, 5))]
    title = prose(4)
    html = f"""<!DOCTYPE html><body class="has-sidebar post-{k}"><header><h1>Site {prose(1)}</h1><nav><ul><li><a>{prose(1)}</a></ul></nav></header>
    <div class="cookie-notice"><p>{prose(9)}</p></div><form action=/s><input name=q><label>{prose(2)}</label><button>Go</button></form>
    <main id="content"><article id=post-{k}><header class="entry-header"><h1>{title}</h1></header><p>{"<p>".join(paragraphs)}
    <p class="legal">The same words under every text</p><div class="ad-slot">{prose(8)}</div><aside>{prose(7)}</aside>
    <section class="comments"><h3>{prose(2)}</h3><article class="comment"><p>{prose(12)}</p></article></section><footer>{prose(3)}</footer></article></main>
    <div class="sidebar"><p>{prose(20)}</p></div><script>var x = "<p>{prose(3)}</p>";</script><footer>&copy; {prose(6)}</footer></body>"""
    return html, [title, *paragraphs]


@pytest.mark.parametrize("site", [plain_site, article_site])
def test_planted_sites(spark, site):
    pages = [site(k) for k in range(30)]
    rows = spark.createDataFrame([(k, f"https://Host.example.org/{k}", html, "x", "y") for k, (html, _) in enumerate(pages)], "page_id long, url string, html string, text string, template string").repartition(4)
    found = {r["page_id"]: r for r in h.extract(spark, rows).collect()}
    for k, (_, want) in enumerate(pages):
        assert found[k]["text"] == "\n\n".join(want)
        assert found[k]["n_chars"] == len(found[k]["text"])


def test_many_templates_are_merged_in_rounds(spark, monkeypatch):
    """The template of many small ones is that of all pages at once, in counts and in what is constant."""
    pages = [plain_site(k)[0] for k in range(60)]
    trees = [h.fold([root], blocks) for root, blocks in map(parse, pages)]
    whole = trees[0]
    for t in trees[1:]:
        whole = h.merge(whole, t)
    monkeypatch.setattr(h, "FAN", 2)
    rows = spark.createDataFrame([("a.example", p) for p in pages] + [(None, "<p>x")], "host string, html string").repartition(12)
    one = h.induce(rows, Workspace(spark, "induce")).collect()
    assert [(r["host"], r["pages"]) for r in one] == [("a.example", 60)]
    assert h.written(h._read(json.loads(one[0]["template"]))) == h.written(whole)


def test_templates_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(h, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(h, "HOT", 3)
    pages = [(k, f"http://{'big' if k % 2 else f'h{k % 5}'}.example/", *plain_site(k)) for k in range(60)] + [(90, None, "<p>no host", ["no host"]), (91, "::", None, [])]
    rows = spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string")
    found = {r["page_id"]: r["text"] for r in h.extract(spark, rows).collect()}
    assert len(found) == len(pages)
    assert all(found[p[0]] == "\n\n".join(p[3]) for p in pages if p[0] >= 90 or p[0] % 2)


def test_copies_are_not_taken_for_a_template(spark):
    html, want = plain_site(0)
    other, text = article_site(1)
    rows = spark.createDataFrame([(k, "http://copies.example/", other) for k in range(20)] + [(k, f"http://one{k}.example/", html) for k in range(20, 23)], "page_id long, url string, html string")
    found = {r["page_id"]: r["text"] for r in h.extract(spark, rows).collect()}
    for k in range(20):
        assert set(text) <= set(found[k].split("\n\n"))
    for k in range(20, 23):
        assert "\n\n".join(want) in found[k]


ODD = {
    None: "",
    "": "",
    "   \n ": "",
    "no markup at  all &amp; more": "no markup at all & more",
    "a < b &lt; c &am": "a < b < c &am",
    "<p>one<p>two<br>lines<p>": "one\n\ntwo lines",
    "<p><b>bold<p>after</b> text": "bold\n\nafter text",
    "<p>x<!-- <p>hidden --> y <!-- never closed <p>z": "x y",
    "<style>p{}</style><p>a</p><script>if (a</b) '</p>'</script>tail": "a\n\ntail",
    "<script>never closed <p>x": "",
    "<p>cut off in a ta<a hre": "cut off in a ta",
    '<div title="a > b">kept</div>': "kept",
    "<div title=don't>kept</div><p title='x'>too": "kept\n\ntoo",
    "<ul><li>1<ul><li>1.1<li>1.2</ul><li>2</ul>": "1\n\n1.1\n\n1.2\n\n2",
    "<table><tr><td>a<td>b<tr><td>c</table>": "a\n\nb\n\nc",
    "<p hidden>no</p><p style='display: none'>no</p><p>yes<span hidden>no</span>": "yes",
    "<nav>menu</nav><p>text</p><aside>side</aside><form><p>Your name</p></form><p>more text that is longer than the form": "text\n\nmore text that is longer than the form",
    "<form><p>the whole page is a form here</p></form>": "the whole page is a form here",
    "<div><a href=x>only links</a> <a>more</a></div><p>text <a>link</a> and more text": "text link and more text",
    "<article>a</article><p>outside</p>": "a",
    "<aside><article>teaser</article></aside><footer><main>x</main></footer><div><p>the text itself</div>": "the text itself",
    "<form><div class=page-banner><article>a<section class=comments><article class=comment>c</article></section></article></div><p>more</form>": "a",
    "&#x41;&#66;&nbsp;&copy;&notanentity;&#xD800;": "AB ©¬anentity;�",
    "</p></div></body>stray": "stray",
}


def test_odd_pages(spark, no_docs):
    rows = spark.createDataFrame([(k, f"http://h{k}.example", html) for k, html in enumerate(ODD)] + [(0, "http://h0.example", None), (None, None, "<p>t")], "page_id long, url string, html string")
    found = [(r["page_id"], r["text"], r["n_chars"]) for r in h.extract(spark, rows).collect()]
    want = [(k, t, len(t)) for k, t in enumerate(ODD.values())] + [(0, "", 0), (None, "t", 1)]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert h.extract(spark, rows.limit(0)).count() == 0


def test_long_and_deep_pages():
    deep = "<div>" * 5000 + "bottom" + "</div>" * 5000 + "<p>after"
    assert h.main_text(deep) == "bottom\n\nafter"
    many = "".join(f"<p>paragraph {k} of many</p><div class='c{chr(97 + k % 26)}'><i>x</i></div>" for k in range(30_000))
    assert h.main_text("<main>" + many).count("paragraph") == 30_000
    assert h.main_text("<p>" + "word " * 1_000_000) == ("word " * 1_000_000).strip()
    assert h.main_text('<a title="' * 3000 + "end").count("end") <= 1
    wide = h.fold([parse("".join(f"<div class=k{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}x><p>t</div>" for k in range(2000)))[0]], [("t", 0)] * 2000)
    assert len(wide.kids) <= h.MOST_KIDS


def test_templates_are_bounded(monkeypatch):
    monkeypatch.setattr(h, "MOST_SLOTS", 10)
    trees = []
    for k in range(30):
        root, blocks = parse(f"<body><div><p>same</p></div><div class=only{chr(97 + k)}><p>{k}</p></div>")
        trees.append(h.fold([root], blocks))
    whole = trees[0]
    for t in trees[1:]:
        whole = h.bounded(h.merge(whole, t))
    assert sum(1 for _ in whole) <= 12
    assert {s.pages for s in whole if s.label in ("", "body", "div")} == {30}


class Article(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag in ("p", "h1", "article"):
            self.blocks.append("")
        elif tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        if tag in ("p", "h1"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


@pytest.mark.parametrize("path", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_given_pages_equal_a_plain_reading(spark, path):
    want = {}
    for r in spark.read.parquet(f"{path}/pages.parquet").collect():
        parser = Article()
        parser.feed(r["html"] or "")
        parser.close()
        want[r["page_id"]] = "\n\n".join(t for b in parser.blocks if (t := " ".join(b.split())))
    assert {r["page_id"]: r["text"] for r in h.op13_html_extraction(spark, path).collect()} == want
