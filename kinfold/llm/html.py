"""HTML extraction: pages vote on the container path of their host's main text, then the winners are read."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words as W
from .spark import cut, small
from .urls import host

#: A path that wins this share of its host's pages is one of the host's winners.
SHARE = 0.1

# Element kinds of HTML, and names in class, id or role of what is no main text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
CONTAINERS = frozenset("article body div main section td".split())
DROPPED = frozenset("aside button canvas dialog footer form head iframe input menu nav noscript object script select style svg template textarea title".split())
RAW = frozenset("script style textarea title noscript template iframe svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOISE = frozenset("ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs byline comment comments consent cookie cookies disclaimer discussion disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pagination pager paywall popup privacy promo promoted promotion promotions recommended related replies reply search share sharing sidebar signup sitemap skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split())
#: Words that go with those in a name, such as site-footer or comment-list; with any other word a name is no noise.
BESIDE = frozenset("a area article articles b bar block body bottom box btn button center col column container content de en floating fr global group holder inner items l left links list lower main mobile module outer page panel policy post posts primary r region right row rows secondary section sidebar site slot sticky story strip tags text thread title top unit upper user view wrap wrapper zone".split())
#: A start tag on the left ends an open element on the right, up to a container.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|</[^>]*(?:>|\Z)""", re.S)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)


_WORDS = re.compile(r"[a-z]+")


def is_noise(names: str) -> bool:
    """Whether one of the names says by all its words that what it names is no main text."""
    for name in names.split():
        words = _WORDS.findall(name)
        if words and not NOISE.isdisjoint(words) and all(w in NOISE or w in BESIDE for w in words):
            return True
    return False


def step(path: int, name: str) -> int:
    """Number of the path that goes one container on from that of a number."""
    return int.from_bytes(blake2b(f"{path}>{name}".encode(), digest_size=8).digest(), "little")


@dataclass(slots=True)
class Node:
    """A container, or an element that is left out."""

    tag: str
    name: str
    path: int
    parent: int
    noise: int  # 0: main text, 1: left out unless it holds most of the page, 2: left out
    text: int = 0  # characters outside links, here and below
    lead: int = 0  # paragraphs and headings, here and below
    inner: list[int] = field(default_factory=list)


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=list)
    blocks: list[tuple[int, str, int, bool]] = field(default_factory=list)  # node, text, characters outside links, paragraph or heading

    def path(self, k: int) -> str:
        """Tags and classes from the body to a container; written out for one container, as it grows with its depth."""
        names = []
        while k >= 0:
            if not self.nodes[k].noise:
                names.append(self.nodes[k].name)
            k = self.nodes[k].parent
        return ">".join(reversed(names))


def numbered(path: str) -> int:
    first, *rest = path.split(">")
    number = step(0, first)
    for name in rest:
        number = step(number, name)
    return number


def _settle(page: Page) -> Page:
    """Decide what is left out, and sum up the texts of containers."""
    nodes = page.nodes
    size = [0] * len(nodes)
    for k, text, _, _ in page.blocks:
        size[k] += len(text)
    total = 0
    hard = [x.noise == 2 for x in nodes]
    for k, x in enumerate(nodes):
        hard[k] |= x.parent >= 0 and hard[x.parent]
        total += 0 if hard[k] else size[k]
    # Where a page has an article, only what holds one can be main text in spite of its name.
    article = [False] * len(nodes)
    for k in range(len(nodes) - 1, 0, -1):
        if not hard[k]:
            size[nodes[k].parent] += size[k]
            article[k] |= nodes[k].tag in ("article", "main") and size[k] > 0
            article[nodes[k].parent] |= article[k]
    for k, x in enumerate(nodes):
        if x.noise == 1 and not hard[k] and 2 * size[k] > total and article[k] >= article[0]:
            x.noise = 0
        if x.parent >= 0:
            x.noise = max(x.noise, nodes[x.parent].noise)
            x.path = step(nodes[x.parent].path, x.name)
            nodes[x.parent].inner.append(k)
    for k, text, plain, lead in page.blocks:
        if not nodes[k].noise and 2 * plain >= len(text):
            nodes[k].text += plain
            nodes[k].lead += lead
    for k in range(len(nodes) - 1, 0, -1):
        if not nodes[k].noise:
            nodes[nodes[k].parent].text += nodes[k].text
            nodes[nodes[k].parent].lead += nodes[k].lead
    return page


def parse(html: str) -> Page:
    """Containers with their generalised paths, and the text blocks in page order, in time and memory that grow with the page."""
    page = Page([Node("body", "body", step(0, "body"), -1, 0)])
    nodes = page.nodes
    stack: list[tuple[str, int]] = []  # tag, node
    opened: Counter[str] = Counter()
    parts: list[str] = []
    linked = at = 0
    kind = ""

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            page.blocks.append((stack[-1][1] if stack else 0, text, max(len(text) - linked, 0), kind in ("p", "h1", "h2", "h3")))
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        if text and nodes[stack[-1][1] if stack else 0].noise < 2:
            text = unescape(text) if "&" in text else text
            parts.append(text)
            if opened["a"]:
                linked += len(text.strip())

    def shut(k: int) -> None:
        for x in stack[k:]:
            opened[x[0]] -= 1
        del stack[k:]

    while at < len(html):
        m = _TOKEN.search(html, at)
        if not m:
            say(html[at:])
            break
        say(html[at : m.start()])
        at = m.end()
        closing, tag, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag or not html[at - 1 : at] == ">":  # a comment, or a tag that the page breaks off in
            continue
        tag = tag.lower()
        if tag in BLOCKS:
            flush()
            kind = "" if closing else tag
        elif tag == "br":
            parts.append(" ")
        if closing:
            if opened[tag]:
                shut(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
            continue
        if tag in ("html", "body", "thead", "tbody") or tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if rest.endswith("/") and tag not in BLOCKS:
            continue
        ends = ({"p"} if tag in BLOCKS else set()) | ENDS.get(tag, set())
        if any(opened[x] for x in ends):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ends:
                    shut(k)
                elif stack[k][0] in ("article", "body", "div", "main", "ol", "section", "table", "ul"):
                    break
        found = {a.lower(): (b or c or d).lower() for a, b, c, d in _NAMES.findall(rest)} if "=" in rest else {}
        over = stack[-1][1] if stack else 0
        noise = int(any(map(is_noise, found.values())))
        # What stands inside a line is left out whole, so that the words around it stay together.
        if noise and tag not in BLOCKS or tag in DROPPED or tag == "header" and not (opened["article"] or opened["main"]) or _HIDDEN.search(rest):
            noise = 2
        if tag in CONTAINERS or noise:
            name = ".".join([tag, *sorted({re.sub(r"[\d>]+", "", c) for c in found.get("class", "").split()} - {""})])
            nodes.append(Node(tag, name, 0, over, max(noise, 2 * (nodes[over].noise == 2))))
            over = len(nodes) - 1
        stack.append((tag, over))
        opened[tag] += 1
    flush()
    return _settle(page)


def best(page: Page) -> int:
    """The smallest container that holds all paragraphs and headings and nearly all text.

    An article or main element with half the text is where the search starts.
    """
    nodes = page.nodes
    root = next((k for k, x in enumerate(nodes) if x.tag in ("article", "main") and not x.noise and 2 * x.text >= nodes[0].text > 0), 0)
    while True:
        inner = [k for k in nodes[root].inner if not nodes[k].noise and nodes[k].tag in CONTAINERS and nodes[k].text >= 0.9 * nodes[root].text > 0 and nodes[k].lead == nodes[root].lead]
        if not inner:
            return root
        root = inner[0]


def read(page: Page, path: int) -> str:
    """Text blocks in all containers of that path, one on a line."""
    inside = [False] * len(page.nodes)
    for k, x in enumerate(page.nodes):
        inside[k] = not x.noise and (x.path == path or (x.parent >= 0 and inside[x.parent]))
    return "\n".join(t for k, t, _, _ in page.blocks if inside[k])


def extract_one(html: str | None, winners: list[str] | None) -> tuple[str, str]:
    """Text and path: the host's first winner that holds half of the page's text, else the page's own best."""
    page = parse(html or "")
    held: dict[int, int] = {}
    if winners:
        for x in page.nodes:
            if not x.noise and (x.parent < 0 or page.nodes[x.parent].path != x.path):
                held[x.path] = held.get(x.path, 0) + x.text
    path = next((p for p in winners or () if 2 * held.get(numbered(p), 0) >= page.nodes[0].text > 0), None)
    if path is None:
        k = best(page)
        return read(page, page.nodes[k].path), page.path(k)
    return read(page, numbered(path)), path


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in W.slices(batches, "html"):
        paths = []
        for html in batch.column("html").to_pylist():
            page = parse(html or "")
            paths.append(page.path(best(page)) if page.nodes[0].text else None)
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(paths, pa.string())], names=["host", "path"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in W.slices(batches, "html"):
        found = [extract_one(h, p) for h, p in zip(batch.column("html").to_pylist(), batch.column("paths").to_pylist(), strict=True)]
        columns = [batch.column("page_id"), batch.column("url"), *(pa.array([x[k] for x in found], pa.string()) for k in (0, 1))]
        yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "path"])


def extract(pages: DataFrame, share: float = SHARE) -> DataFrame:
    """page_id, url, text and path for each row of ``pages`` (page_id, url, html).

    Pages vote in one narrow pass for their best container's path, of tags and classes without
    digits. A name in class, id or role leaves an element out only if all its words say so, and not if the
    element holds most of the page's text; a header inside an article is part of it. Votes are counted by host and path before they are shuffled; paths with ``share`` of
    the host's votes win, ten at most, the most votes first. The second pass reads them; a page
    in which none of them holds half of the text is read by its own best path. The winners go to it by broadcast if they
    are few, else by a join on the host. A null html is empty and gives an empty text; a null or
    odd URL's host is empty, which is a host too; repeated rows are read alike.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.coalesce(host(F.col("url")), F.lit("")).alias("host"))
    votes = rows.select("host", "html").mapInArrow(_votes, "host string, path string").filter("path IS NOT NULL").groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))
    votes = cut(votes)
    total = votes.groupBy("host").agg(F.sum("n").alias("total"))
    first = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "path")))
    winners = cut(votes.join(total, "host").filter(F.col("n") >= share * F.col("total")).groupBy("host").agg(F.transform(first, lambda x: x["path"]).alias("paths")))
    return rows.join(small(winners), "host", "left").select("page_id", "url", "html", "paths").mapInArrow(_read, "page_id long, url string, text string, path string")
