"""Main texts: the given pages against a plain reading of their article, invented layouts, and odd pages."""

import html
import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from tablewarden.llm import queries, wrappers

SF = "/root/testdata/sf0.001"


class Article(HTMLParser):
    """The text of article elements, cut at block tags."""

    def __init__(self, page):
        super().__init__(convert_charrefs=False)
        self.inside, self.parts = 0, [""]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.parts += [""] if tag in wrappers.BLOCKS else []
        self.parts[-1] += " " if tag == "br" else ""

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        self.parts += [""] if tag in wrappers.BLOCKS else []

    def handle_data(self, data):
        self.parts[-1] += data if self.inside else ""

    def handle_entityref(self, name):
        at = self.rawdata.find("&" + name)
        self.parts[-1] += "&" + name + ";" if self.inside else ""

    def handle_charref(self, name):
        self.parts[-1] += "&#" + name + ";" if self.inside else ""

    def text(self):
        return "\n".join(x for x in (" ".join(html.unescape(p).split()) for p in self.parts) if x)


def test_given_pages(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.QUERIES["op12_html_main_text"](spark, SF).collect()
    assert sorted(r["page_id"] for r in got) == sorted(pages)
    for r in got:
        page = pages[r["page_id"]]
        assert r["url"] == page["url"] and r["n_chars"] == len(r["text"])
        if not re.search(r"&[a-z]+(?![a-z;])", page["html"]):              # the reader above closes cut references
            assert r["text"] == Article(page["html"]).text(), r["page_id"]


BODY = "<p>First of {i}: {own}</p><p>Second &amp; last&nbsp;of\n  {i}</p>"
WANT = "First of {i}: {own}\nSecond & last of {i}"
LAYOUTS = {
    "article": ("<header>Site</header><nav><a href=x>Menu</a></nav><article><header><h1>Head {i}</h1><span class='byline'>By us</span></header>" + BODY + "<div class='share'>Share it</div></article>"
                "<section id='comments'><article><p>I like {own} a lot, number {i}</p></article></section><aside>Side {i}</aside><footer>End</footer>", "Head {i}\n" + WANT),
    "named": ("<div id='sidebar'>Side {own} {own}</div><div class='post-content'><h2>Head {i}</h2>" + BODY + "<form>Your name <input></form></div><div class='comment-list'><p>{own} {own} no. {i}</p></div>",
              "Head {i}\n" + WANT),
    "bare": ("<div><ul><li><a href=a>Home page</a></li><li><a href=b>Other page</a></li></ul></div><div><p>Every page says this here</p>" + BODY + "</div><div><a href=c>About</a> <a href=d>Contact</a></div>", "Every page says this here\n" + WANT),
    "around": ("<div class='has-sidebar'><main><div class='cookie-notice'>We use cookies</div>" + BODY + "</main><div class='sidebar'>Side {own}</div></div>", WANT),
}


@pytest.mark.parametrize("limit", [wrappers.BROADCAST, 0])
def test_layouts(spark, limit):
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(8 + i % 5))
    rows = [(f"{name}{i}", f"https://{name}.example/{i}", "<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><!-- <p>no</p> --><script>var t='<p>x</p>'</script>"
             + layout[0].format(i=i, own=own(i)) + "</body></html>") for name, layout in LAYOUTS.items() for i in range(12)]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string").withColumn("host", F.lit("clash")).withColumn("text", F.lit("clash")).repartition(7)
    got = {r["page_id"]: r["text"] for r in wrappers.extract(pages, ["page_id"], limit=limit).collect()}
    assert got == {f"{name}{i}": layout[1].format(i=i, own=own(i)) for name, layout in LAYOUTS.items() for i in range(12)}


def test_wrappers_say_what_repeats_and_what_is_optional(spark, monkeypatch):
    monkeypatch.setattr(wrappers, "FAN", 3)                                # several rounds
    page = lambda i: "<article>" + "<p>x{}</p>".format(i) * (1 + i % 3) + ("<ul><li>only here</li></ul>" if i == 4 else "") + "<h3>same</h3></article>"
    pages = spark.createDataFrame([("h", page(i)) for i in range(40)], "host string, html string").repartition(13)
    row, = wrappers.infer(pages).collect()
    count, root = wrappers._read(row["wrapper"])
    article, = root.items
    found = {k.sign: (k.seen, k.times > k.seen, k.text is None) for k in article.items}
    assert count == 40 and [k.sign for k in article.items] == ["p", "ul", "h3"]
    assert found == {"p": (40, True, True), "ul": (1, False, False), "h3": (40, False, False)}


def test_odd_pages(spark):
    wide = "<article>" + "".join(f"<p>a{i}</p><x{chr(97 + i % 26)} class=ad>no</x{chr(97 + i % 26)}><ul><li>b{i}" for i in range(300))
    deep = "<div>" * 3_000 + "<p>deep text</p>"
    long = "<article><p>" + "wide river " * 200_000 + "</article>"
    cases = [(None, None, ""), ("", "", ""), ("http://h/1", "no markup at all", "no markup at all"), ("http://h/2", "<article>5 < 6 &am &lt;b&gt; <p>open <b>bold<br>line</article>", "5 < 6 &am <b>\nopen bold line"),
             ("http://deep/", deep, "deep text"), ("http://long/", long, ("wide river " * 200_000).strip()), ("http://q/", "<article><a href='x>y'>z</a><p title=\"a > b\">t</p><p class=\"open>u</p>", None),
             ("http://wide/", wide, "\n".join(f"a{i}\nb{i}" for i in range(300))), ("no host", "<p>x</p>", "x"), ("no host", "<p>x</p>", "x"), ("http://e/", "<article></article><p>y</p>", "")]
    pages = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(cases)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in wrappers.extract(pages, ["page_id"]).collect()}
    assert len(got) == len(cases)
    for i, (_, _, want) in enumerate(cases):
        assert want is None or got[i] == want, i
    assert wrappers.extract(pages.limit(0), ["page_id"]).count() == 0
