import re
from html.parser import HTMLParser

from keyloom.llm import html

PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body>
<nav class="menu"><a href="/">Home</a> <a href="/x">More things</a></nav><header>Site name</header>
<div class="post-12"><h1>Head &amp; line</h1><p>First   paragraph
with <b>bold</b> text.</p><script>var a = "<p>no</p>";</script><div class="ads">Buy now</div><ul><li>one<li>two</ul><p>Last &#233;t&eacute;.</p></div>
<div id="comments"><p>I disagree entirely with all of this, as anyone would after reading so much text.</p></div>
<aside>Related</aside><footer>Copyright</footer></body></html>"""
TEXT = "Head & line\n\nFirst paragraph with bold text.\n\none\n\ntwo\n\nLast été."


def test_article_text(spark):
    rows = [(1, "http://A.example/x", PAGE, 0), (2, "http://a.example/y", PAGE.replace("post-12", "post-7"), 0), (3, None, None, 0), (4, "no url", "", 0), (5, "http://b/", "just text", 0), (1, "http://A.example/x", PAGE, 0)]
    got = sorted(((r["page_id"], r["url"], r["text"]) for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, path int")).collect()), key=str)
    assert got == sorted([(1, "http://A.example/x", TEXT), (2, "http://a.example/y", TEXT), (3, None, ""), (4, "no url", ""), (5, "http://b/", "just text"), (1, "http://A.example/x", TEXT)], key=str)
    assert html.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_whole_pages_are_read(spark):
    long = "<div class=content>" + "".join(f"<p>Paragraph {i} of a long page.</p>" for i in range(20000)) + "</div>"
    row = html.main_text(spark.createDataFrame([(1, "http://h/", long)], "page_id long, url string, html string")).first()
    assert row["text"].count("\n\n") == 19999 and row["text"].endswith("19999 of a long page.")


def test_host_votes(spark):
    other = '<html><body><div class="b"><p>{}</p></div><div class="a1"><p>{}</p></div></body></html>'
    rows = [(i, "http://h/", other.format("s", "the article of this host, rather longer " * 3)) for i in range(5)]
    rows.append((9, "http://h/", other.format("a teaser that is longer than the article by far, on this page only " * 3, "brief article")))
    assert [tuple(r) for r in html.consensus(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()] == [("h", "/html/body/div.a0")]
    got = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == "brief article"


def one(page):
    return html.extract(page, None)


def test_weak_names_do_not_drop_an_article():
    long = "A sentence of the article that says something. " * 20
    page = f'<body><nav>x</nav><section class="text-search results"><p>{long}</p><p class="related">A related finding, told here.</p></section><div class="related"><a href="/a">More</a></div></body>'
    assert one(page) == f"{long.strip()}\n\nA related finding, told here."
    page = f'<article><p>{long}</p><p class="related"><a href="/x">Read this too</a></p><div class="legal">All rights reserved</div></article>'
    assert one(page) == long.strip()


def test_rules_end_blocks_and_hosts_fold_ascii_only(spark):
    assert one("<div><p>c</p>d<hr>e</div>") == "c\n\nd\n\ne"
    assert html.host_of("http://É.Example/") == "É.example"
    rows = [(1, "http://É.Example/", PAGE), (2, "http://é.example/", PAGE)]
    assert {r["host"] for r in html.consensus(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {"É.example", "é.example"}


def test_equal_votes_and_both_joins(spark):
    two = '<html><body><div class="{}"><p>same words in both of them</p></div></body></html>'
    rows = [(i, "http://h/", two.format("ba"[i % 2])) for i in range(4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert [r["path"] for r in html.consensus(df).collect()] == ["/html/body/div.a"]
    a, b = (sorted(map(tuple, html.main_text(df, broadcast=n).collect())) for n in (0, 1 << 20))
    assert a == b and len(a) == 4


class Plain(HTMLParser):
    """A second reading of the generated pages: the article's blocks, without what is never text."""

    SKIP = {"nav", "header", "footer", "aside", "form", "script", "style"}
    INLINE = {"a", "b", "i", "em", "strong", "span", "br", "code", "img"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.line, self.inside, self.skip = [], [], 0, []

    def end(self):
        text = re.sub(r"\s+", " ", "".join(self.line)).strip()
        self.out += [text] if text else []
        self.line = []

    def handle_starttag(self, tag, attrs):
        names = dict(attrs).get("class") or ""
        if self.skip:
            self.skip += [tag] if tag == self.skip[0] else []
        elif tag in self.SKIP or re.search(r"\b(ad|comments?)\b", names):
            self.end()
            self.skip = [tag]
        elif tag == "br":
            self.line.append(" ")
        elif tag not in self.INLINE:
            self.end()
            self.inside += tag in ("article", "main")

    def handle_endtag(self, tag):
        if self.skip:
            if tag == self.skip[0]:
                self.skip.pop()
        elif tag not in self.INLINE:
            self.end()
            self.inside -= tag in ("article", "main")

    def handle_data(self, data):
        if self.inside and not self.skip:
            self.line.append(data)


def test_generated_pages_against_a_second_reading(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html.main_text(pages).collect()}
    n = 0
    for r in pages.collect():
        if r["html"] and re.search(r"<(article|main)\b", r["html"]):
            p = Plain()
            p.feed(r["html"])
            p.close()
            n += 1
            assert got[r["page_id"]] == "\n\n".join(p.out), r["page_id"]
    assert n > 50
