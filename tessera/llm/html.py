"""Main text of web pages by consensus of their hosts' container paths."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, map_batches

#: Up to so many bytes of winning paths they are broadcast, beyond it joined by a shuffle with the hosts salted.
BROADCAST_BYTES = 16 << 20
SALTS = 64
#: Paths with a smaller share of their host's votes are not kept, so a host has at most 20.
MIN_SHARE = 0.05
#: The deepest container with this share of a page's weighted text gets the page's vote.
HOLDS = 0.8
#: A host's path is taken on a page where it has this share of the page's text outside boilerplate.
COVERS = 0.5

# HTML's element kinds and the words that mark boilerplate in class, id and role.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br center cite code data del dfn em font i img input ins kbd label map mark meter"
    " nobr output picture progress q rp rt ruby s samp small source span strike strong sub sup time track tt u var wbr"
    .split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math noframes xmp".split())
LEAF = frozenset(
    "p li ul ol dl dt dd h1 h2 h3 h4 h5 h6 blockquote pre address table caption thead tbody tfoot tr td th figure"
    " figcaption details summary".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ENDS_P = LEAF | frozenset("article aside div fieldset footer form header hr main menu nav section".split())
DROPPED = frozenset(
    "head nav footer aside button select option dialog menu object audio video canvas script style textarea title"
    " noscript template iframe svg math noframes xmp".split()
)
#: Boilerplate unless they hold the page's text.
DOUBTED = frozenset(["form", "fieldset", "header"])
MAIN = frozenset(["article", "main"])
MAIN_WORDS = frozenset("article content post entry story main body text maincontent articlebody".split())
READER_WORDS = frozenset("comment comments commentlist commentary disqus reply replies respond discussion".split())
BOILER_WORDS = READER_WORDS | frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adbox adslot sponsor sponsored sponsors"
    " promo promos promotion banner banners cookie cookies consent gdpr notice notices notification notifications alert"
    " alerts sidebar sidebars aside widget widgets menu menus nav navbar navi navigation breadcrumb breadcrumbs"
    " pagination pager footer foot masthead topbar header share sharing sharebar social related recommended"
    " recommendations newsletter subscribe subscription signup login search searchbox popup modal overlay toolbar skip"
    " complementary contentinfo form reactions outbrain taboola teaser teasers".split()
)
_KEEPING = frozenset("has with no without non not".split())
# A tag ends at a > outside of quoted values, before the next < or at the page's end. No part is read twice.
_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/><]*+)((?>[^<>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|[="'])*+)(?:>|(?=<)|\Z)|<[!?][^>]*+(?:>|\Z)""",
    re.S,
)
_ATTR = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_WORD = re.compile(r"[a-z]+|[0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)")


@dataclass
class Node:
    tag: str
    label: str
    parent: int
    path: int  # number of the labels from the root to here
    dropped: bool  # never text
    doubted: bool  # boilerplate by its words, unless it holds the page's text
    reader: bool  # by words for readers' comments
    region: bool  # article, main, or a container with a word for main content
    main: bool  # in such a one


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=list)
    blocks: list[tuple[str, int, int]] = field(default_factory=list)  # text, characters in links, node
    paths: dict[tuple[int, str], int] = field(default_factory=dict)

    def settle(self) -> Page:
        """Takes the blocks out that are in boilerplate.

        A doubted container stays if it has the page's articles, which aren't doubted themselves and none of which stands
        outside of doubted containers, or most of the text that isn't in links; one for readers' comments only by the
        first rule.
        """
        nodes = self.nodes
        plain = [0] * len(nodes)
        for text, linked, node in self.blocks:
            if not nodes[node].dropped:
                plain[node] += len(text) - linked
        # Children follow their parents.
        inner, clean, inside = [False] * len(nodes), False, [False] * len(nodes)
        for k, n in enumerate(nodes):
            inside[k] = n.doubted or (n.parent >= 0 and inside[n.parent])
        whole, marked = list(plain), [n.tag in MAIN and not n.doubted and not n.dropped for n in nodes]
        for k in range(len(nodes) - 1, 0, -1):
            up = nodes[k].parent
            whole[up] += whole[k]
            if marked[k] and whole[k]:
                inner[k] = True
                clean |= not inside[k]
            inner[up] |= inner[k]
        # The text that a doubted container is measured by: that of its article, or of the page.
        base = [0] * len(nodes)
        dead = [False] * len(nodes)
        for k, n in enumerate(nodes):
            if n.parent < 0:
                base[k] = whole[k]
                continue
            base[k] = whole[k] if inner[k] and marked[k] else base[n.parent]
            kept = not n.doubted or (inner[k] and not clean) or (not n.reader and 2 * whole[k] > base[n.parent] > 0)
            if n.doubted and clean and kept:
                kept = n.main or inner[k]
            dead[k] = dead[n.parent] or n.dropped or not kept
        self.blocks = [b for b in self.blocks if not dead[b[2]]]
        return self


def _words(text: str) -> list[str]:
    return _WORD.findall(_CAMEL.sub(" ", text).lower())


def _node(page: Page, tag: str, attrs: str, parent: int) -> Node:
    up = page.nodes[parent]
    got = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)} if "=" in attrs else {}
    names = f"{got.get('class', '')} {got.get('id', '')}"
    words = _words(f"{names} {got.get('role', '')}") if got else []
    found = {
        w
        for k, w in enumerate(words)
        if w in BOILER_WORDS and (k == 0 or words[k - 1] not in _KEEPING) and not (w == "header" and up.main)
    }
    hidden = (
        _HIDDEN.search(attrs) is not None
        or "display:none" in got.get("style", "").replace(" ", "").lower()
        or got.get("aria-hidden", "").lower() == "true"
    )
    doubted = tag not in ("html", "body") and (
        (bool(found) and (tag not in MAIN or bool(found & READER_WORDS)))
        or (tag in DOUBTED and not (tag == "header" and up.main))
    )
    label = tag + "".join(f".{w}" for w in sorted({re.sub(r"\d+", "9", w.lower()) for w in names.replace(">", " ").split()}))
    region = tag in MAIN or (tag in ("div", "section", "td") and not found and any(w in MAIN_WORDS for w in words))
    number = page.paths.setdefault((up.path, label), len(page.paths) + 1)
    dropped = up.dropped or tag in DROPPED or hidden
    return Node(tag, label, parent, number, dropped, doubted, bool(found & READER_WORDS), region, up.main or region)


def parse(html: str) -> Page:
    """The containers and text blocks of a page, without those of boilerplate. Forgiving: end tags may miss, what isn't a
    tag is text. Reads the page once, whatever is in it."""
    page = Page([Node("", "", -1, 0, False, False, False, False, False)])
    nodes, stack = page.nodes, [0]
    open_: Counter[str] = Counter()
    buffer: list[str] = []
    linked, in_link, pos = 0, False, 0

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = "".join(buffer)
            text = " ".join((unescape(text) if "&" in text else text).split())
            if text and not nodes[stack[-1]].dropped:
                page.blocks.append((text, min(linked, len(text)), stack[-1]))
            buffer.clear()
        linked = 0

    def close(tags: frozenset[str] | set[str], stop: frozenset[str] | set[str] = frozenset()) -> None:
        if not any(open_[t] for t in tags):
            return
        for k in range(len(stack) - 1, 0, -1):
            tag = nodes[stack[k]].tag
            if tag in tags:
                for gone in stack[k:]:
                    open_[nodes[gone].tag] -= 1
                del stack[k:]
                return
            if tag in stop:
                return

    while True:
        m = _TAG.search(html, pos)
        text = html[pos : m.start() if m else len(html)]
        if text:
            buffer.append(text)
            linked += len(text) if in_link else 0
        if m is None:
            break
        pos = m.end()
        if m[2] is None:
            continue
        tag, attrs, end = m[2].lower(), m[3], bool(m[1])
        if tag in INLINE:
            if tag == "a":
                in_link = not end
            elif tag == "br":
                buffer.append(" ")
            continue
        flush()
        in_link = False
        if end:
            close({tag}, {"td", "th", "table"} - {tag} if tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html") else set())
            continue
        if tag in RAW:
            at = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, pos)
            pos = at.start() if at else len(html)
            if at:
                shut = html.find(">", pos)
                pos = shut + 1 if shut >= 0 else len(html)
            continue
        if tag in VOID:
            continue
        if tag in ENDS_P:
            close({"p"}, {"td", "th", "div", "section", "article", "li", "blockquote", "main", "aside", "form", "body"})
        if tag in HEADINGS:
            close(HEADINGS, {"div", "section", "article", "td", "th", "main", "body"})
        elif tag == "li":
            close({"li"}, {"ul", "ol"})
        elif tag in ("dt", "dd"):
            close({"dt", "dd"}, {"dl"})
        elif tag in ("td", "th"):
            close({"td", "th"}, {"tr", "table"})
        elif tag == "tr":
            close({"tr"}, {"table", "tbody", "thead", "tfoot"})
        elif tag == "body":
            close({"head"})
        nodes.append(_node(page, tag, attrs, stack[-1]))
        if not attrs.endswith("/"):
            stack.append(len(nodes) - 1)
            open_[tag] += 1
    flush()
    return page.settle()


def path(page: Page, node: int) -> str:
    out = []
    while node > 0:
        out.append(page.nodes[node].label)
        node = page.nodes[node].parent
    return ">".join(reversed(out))


def _sums(page: Page, weights: list[float]) -> list[float]:
    """The weights of each node's own and all lower nodes' blocks."""
    out = [0.0] * len(page.nodes)
    for (_, _, node), w in zip(page.blocks, weights, strict=True):
        out[node] += w
    for k in range(len(out) - 1, 0, -1):
        out[page.nodes[k].parent] += out[k]
    return out


def elect(page: Page) -> int | None:
    """The container that gets the page's vote: the deepest one that holds most of the text, links counting nothing and
    text in elements for main content thrice, widened to the article, main element or container for main content around
    it, so that the title and lead stay. None if the page has no text outside boilerplate."""
    nodes = page.nodes
    weight = _sums(page, [(len(t) - linked) * (3.0 if nodes[n].main else 1.0) for t, linked, n in page.blocks])
    if not weight[0]:
        return None
    deep = [0] * len(nodes)
    best, depth = 0, -1
    for k, n in enumerate(nodes):
        deep[k] = deep[n.parent] + 1 if k else 0
        if weight[k] >= HOLDS * weight[0] and deep[k] > depth and n.tag not in LEAF:
            best, depth = k, deep[k]
    around, up = {}, best
    while up > 0:
        if nodes[up].region:
            around.setdefault(nodes[up].tag if nodes[up].tag in MAIN else "other", up)
        up = nodes[up].parent
    return around.get("article", around.get("main", around.get("other", best)))


def vote(page: Page) -> str | None:
    """The generalised path of the elected container."""
    node = elect(page)
    return None if node is None else path(page, node)


def extract(page: Page, paths: list[str]) -> str:
    """The blocks under the first of the paths that has COVERS of the page's text, else under its own vote's."""
    own = vote(page)
    if own is None:
        return ""
    nodes = page.nodes
    total = sum(len(t) - linked for t, linked, _ in page.blocks)
    for wanted in [*paths, own]:
        number = 0
        for label in wanted.split(">") if wanted else ():
            number = page.paths.get((number, label), -1)
        if number < 0:
            continue
        inside = [False] * len(nodes)
        for k, n in enumerate(nodes):
            inside[k] = n.path == number or (n.parent >= 0 and inside[n.parent])
        if sum(len(t) - linked for t, linked, n in page.blocks if inside[n]) < COVERS * total and wanted != own:
            continue
        header = [False] * len(nodes)
        for k, n in enumerate(nodes):
            header[k] = n.tag == "header" or (n.parent >= 0 and header[n.parent])
        out = [t for t, _, n in page.blocks if inside[n] and (not header[n] or nodes[n].tag in HEADINGS)]
        if out:
            return "\n\n".join(out)
    return ""


def votes(pages: DataFrame) -> DataFrame:
    """page_host, path: each page's vote; pages without text have none."""

    def make():  # noqa: ANN202
        def of(batch: pa.RecordBatch) -> dict:
            return {
                "page_host": batch.column(0),
                "path": [vote(parse(h)) if h else None for h in batch.column(1).to_pylist()],
            }

        return of

    return map_batches(pages.select("page_host", "html"), "page_host string, path string", make).where(
        "path is not null"
    )


def host_of(url: str = "url"):  # noqa: ANN201
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def winners(pages: DataFrame) -> DataFrame:
    """page_host, paths: the paths with at least MIN_SHARE of the host's votes, most votes first, ties by the path."""
    counts = votes(pages).groupBy("page_host", "path").agg(F.count("*").alias("n"))
    counts = cut(counts)
    total = counts.groupBy("page_host").agg(F.sum("n").alias("total"))
    kept = counts.join(total, "page_host").where(F.col("n") >= MIN_SHARE * F.col("total"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "path")))
    return kept.groupBy("page_host").agg(F.transform(ranked, lambda x: x["path"]).alias("paths"))


def main_text(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, url, text, n_chars of each row.

    The page's containers vote for one path, votes are counted by host in Spark with a partial count first, and each
    page is extracted again by its host's winning paths. A host with very many pages adds one row for each task and
    path. Null and empty pages and pages without text have an empty text; null urls share a host of no name. Rows that
    repeat are each extracted. Very long pages are read whole, in one pass. Ties between paths go to the first in
    alphabetical order. Other columns are ignored.
    """
    pages = pages.select("page_id", "url", "html", host_of().alias("page_host"))
    won = cut(winners(pages))
    size = won.agg(F.sum(F.length("page_host") + F.length(F.array_join("paths", " ")) + 64)).first()[0] or 0
    if size <= broadcast_bytes:
        joined = pages.join(F.broadcast(won), "page_host", "left")
    else:
        salted = won.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = pages.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(
            salted, ["page_host", "_salt"], "left"
        )
    kind = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"

    def make():  # noqa: ANN202
        def of(batch: pa.RecordBatch) -> dict:
            text = [
                extract(parse(h), p or []) if h else ""
                for h, p in zip(batch.column("html").to_pylist(), batch.column("paths").to_pylist(), strict=True)
            ]
            return {
                "page_id": batch.column("page_id"),
                "url": batch.column("url"),
                "text": text,
                "n_chars": [len(t) for t in text],
            }

        return of

    return map_batches(joined.select("page_id", "url", "html", "paths"), kind, make)
