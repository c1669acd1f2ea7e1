"""Main text of web pages by a vote of each host's pages on where it lies.

Pass 1 scores the containers of every page (letters outside links and
boilerplate, with a bonus for telling names) and lets the page vote for the
generalised tag-class path of its best one.  Spark sums the votes of a host
and path; the strongest path of a host wins.  Pass 2 extracts each page again:
from the host's winning path where the page has it with text, else from the
page's own best container.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments are dropped by tag, role, class or id, inside the article too.
Character references are decoded; white space inside a block becomes one space;
blocks are trimmed and joined by two line ends in page order; nothing else is
dropped.

Names that also stand on articles (``WEAK``: related, search, legal and the like)
drop a container only while it holds less than half of the page's text outside
links, and a paragraph or heading only if most of it is links.

HTML null, empty or without text outside boilerplate: text empty, n_chars 0.
Plain text without tags is its own article.  URL null: the page belongs to the
host "".  Repeated rows each give a row.  Equal votes: the path that sorts first.
Extra columns are ignored.  Empty table: empty result.

Votes are one row a page, summed before the shuffle, so a host with a third of
all pages is no hot task.  Winning paths are one row a host: while they measure
at most ``BROADCAST`` bytes they are sent to all tasks and no page is shuffled;
beyond that pages meet them in a sort-merge join, whose hot hosts Spark splits by
measured size (spark.sql.adaptive.skewJoin).
"""

from __future__ import annotations

import html as _html
import re
import string

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.llm.common import written

BROADCAST = 32 << 20
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_SPACE = re.compile(r"\s+")
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "select", "object", "canvas"}
_DROP = {"head", "nav", "header", "footer", "aside", "form", "button", "menu", "dialog", *_RAW}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_CONTAINER = {"html", "body", "main", "article", "section", "div", "td", "table", "tbody", "tr"}
_BOILER = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adbox|banner|sponsor\w*|promo\w*|nav\w*|menus?|topbar|toolbar|header|masthead|footer|foot|side-?bar|sidebar\w*|aside|breadcrumbs?|"
    r"cookies?|consent|gdpr|notices?|alerts?|pop-?up|modal|overlay|comments?|comment-?list|commentlist|respond|replies|disqus|share|sharing|newsletter|subscribe|signup|login|pagination|pager|skip|hidden)(?:$|[\s_-])",
    re.I,
)
WEAK = re.compile(r"(?:^|[\s_-])(?:social|related|recommended|search|widget|legal|copyright)(?:$|[\s_-])", re.I)
_TEXT = set("p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption dd dt li".split()) | _INLINE
_GOOD = re.compile(r"(?:^|[\s_-])(?:article|articlebody|content|entry|main|post|story|text|body)(?:$|[\s_-])", re.I)
_DIGITS = re.compile(r"\d+")


_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


class Node:
    __slots__ = ("bonus", "drop", "kids", "links", "parent", "path", "size", "tag", "weak")

    def __init__(self, tag: str, parent: Node | None, drop: bool, bonus: float, path: str, weak: bool = False):
        self.tag, self.parent, self.drop, self.bonus, self.path, self.weak = tag, parent, drop, bonus, path, weak
        self.kids: list[Node | str] = []
        self.size = self.links = 0


def host_of(url: str | None) -> str:
    m = re.match(r"(?s).*?://([^/?#]*)", url or "")
    return m[1].translate(_LOWER) if m else ""  # A-Z alone, like the column expression below


def parse(page: str) -> Node:
    """A tree that forgives: p, li and cells close each other, a stray end tag is ignored, an end tag closes what is open inside it."""
    root = Node("", None, False, 0.0, "")
    node, pos, n = root, 0, len(page)
    while pos < n:
        m = _TOKEN.search(page, pos)
        if m is None:
            node.kids.append(page[pos:])
            break
        if m.start() > pos:
            node.kids.append(page[pos : m.start()])
        pos = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            x = node
            while x.parent is not None and x.tag != tag and (tag in _CONTAINER or tag in _DROP or x.tag not in _CONTAINER):
                x = x.parent
            if x.parent is not None and x.tag == tag:
                node = x.parent
            continue
        if tag in _VOID:
            node.kids.append(Node("hr", node, False, 0.0, node.path) if tag == "hr" else " " if tag in ("br", "img") else "")
            continue
        if tag not in _INLINE:
            closes = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}.get(tag, ())
            x, stop = node, {"ul", "ol", "dl", "table", "tbody"} if closes else set()
            while x.parent is not None and x.tag not in stop and (x.tag in _INLINE or x.tag == "p" or closes and x.tag not in closes and x.tag not in _CONTAINER):
                x = x.parent
            if x.tag in closes:
                node = x.parent
            elif _opens_block(node):
                node = _out_of_p(node)
        attrs = {a.lower(): b or c or d for a, b, c, d in _ATTR.findall(m[3])} if "=" in m[3] else {}
        names = f"{attrs.get('class', '')} {attrs.get('id', '')}"
        role = attrs.get("role", "").lower()
        drop = tag in _DROP or role in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert") or " hidden" in f"{m[3]} ".lower().replace("=", " ") and "hidden" not in names
        drop = drop or tag not in ("html", "body", "article", "main") and bool(_BOILER.search(names)) or tag == "article" and bool(re.search(r"(?:^|[\s_-])comments?(?:$|[\s_-])", names, re.I))
        bonus = 1.0 * (tag in ("article", "main") or role in ("main", "article") or "articlebody" in attrs.get("itemprop", "").lower()) + 0.5 * bool(_GOOD.search(names))
        step = tag + "".join(f".{c}" for c in sorted(_DIGITS.sub("0", attrs.get("class", "")).lower().split()))
        weak = not drop and tag not in ("html", "body", "article", "main") and bool(WEAK.search(names))
        new = Node(tag, node, drop, bonus, f"{node.path}/{step}" if tag in _CONTAINER else node.path, weak)
        node.kids.append(new)
        if m[3].endswith("/"):
            continue
        if tag in _RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, pos)
            pos = end.end() if end else n
            continue
        node = new
    return root


def _opens_block(node: Node) -> bool:
    x = node
    while x.parent is not None and x.tag in _INLINE:
        x = x.parent
    return x.tag == "p"


def _out_of_p(node: Node) -> Node:
    while node.tag != "p":
        node = node.parent
    return node.parent


def measure(root: Node) -> list[Node]:
    """Letters of each node outside boilerplate and those of them in links; weak names are decided; the containers in page order."""
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        order.append(x)
        stack.extend(k for k in reversed(x.kids) if isinstance(k, Node) and not k.drop)
    for x in reversed(order):
        x.size += sum(len(k) - k.count(" ") for k in x.kids if isinstance(k, str) and not k.isspace())
        if x.tag == "a":
            x.links = x.size
        if x.parent is not None:
            x.parent.size += x.size
            x.parent.links += x.links
    total, out, gone = root.size - root.links, [], set()
    for x in order:  # parents first
        if x.parent is not None and id(x.parent) in gone:
            gone.add(id(x))
            continue
        if x.weak and (2 * x.links > x.size if x.tag in _TEXT else 2 * (x.size - x.links) < total):
            x.drop = True
            gone.add(id(x))
            for y in _above(x):
                y.size, y.links = y.size - x.size, y.links - x.links
    for x in order:
        if x.tag in _CONTAINER and id(x) not in gone:
            out.append(x)
    return out


def best(root: Node, containers: list[Node]) -> tuple[Node, float]:
    """The container with the best score; deeper ones win while they keep nearly all of the text."""
    top, most = root, 0.0
    for x in containers:
        score = (x.size - x.links) * (1.0 + x.bonus) * (1.0 + 0.02 * x.path.count("/"))
        if score > most:
            top, most = x, score
    return top, most if top is not root else float(root.size)


def blocks(nodes: list[Node]) -> str:
    out: list[str] = []
    line: list[str] = []

    def end() -> None:
        text = _SPACE.sub(" ", _html.unescape("".join(line))).strip()
        if text:
            out.append(text)
        line.clear()

    for top in nodes:
        stack: list[Node | str | None] = [top]
        while stack:
            x = stack.pop()
            if x is None:
                end()
            elif isinstance(x, str):
                line.append(x)
            elif not x.drop:
                block = x.tag not in _INLINE
                if block:
                    end()
                    stack.append(None)
                stack.extend(reversed(x.kids))
        end()
    return "\n\n".join(out)


def vote(page: str | None) -> tuple[str, float]:
    if not page:
        return "", 0.0
    root = parse(page)
    top, score = best(root, measure(root))
    return top.path, score


def extract(page: str | None, path: str | None) -> str:
    """The text below the host's path, or below the page's own best container."""
    if not page:
        return ""
    root = parse(page)
    containers = measure(root)
    inside = [x for x in containers if x.path == path and x.size] if path else []
    chosen = [x for x in inside if not any(y.path == path for y in _above(x))]
    return blocks(chosen or [best(root, containers)[0]])


def _above(x: Node):
    while x.parent is not None:
        x = x.parent
        yield x


def consensus(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path): the path with the largest sum of scores of each host."""

    def run(batches):
        for pdf in batches:
            got = [vote(h) for h in pdf["html"]]
            yield pd.DataFrame({"host": [host_of(u) for u in pdf["url"]], "path": [g[0] for g in got], "score": [g[1] for g in got]})

    votes = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInPandas(run, "host string, path string, score double")
    # log-sized votes: one enormous page doesn't outvote the others of its host.
    sums = votes.filter("path <> '' AND score > 0").groupBy("host", "path").agg(F.sum(F.log2(1 + F.col("score"))).alias("score"))
    w = Window.partitionBy("host").orderBy(F.desc(F.round("score", 6)), "path")
    return sums.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("host", "path")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast: int = BROADCAST) -> DataFrame:
    """(id, url, text) of every page."""
    paths = written(consensus(pages, url_col, html_col).withColumnRenamed("host", "_host"), "paths")
    size = paths.agg(F.coalesce(F.sum(F.octet_length("_host") + F.octet_length("path") + 64), F.lit(0)).alias("n")).first()["n"]
    host = F.translate(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    d = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("_host"))
    d = d.join(F.broadcast(paths) if size <= broadcast else paths.hint("merge"), "_host", "left")
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "url": pdf["url"], "text": [extract(h, p) for h, p in zip(pdf["html"], pdf["path"], strict=True)]})

    out = d.select("id", "url", "html", "path").mapInPandas(run, f"id {kind}, url string, text string")
    return out.withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
