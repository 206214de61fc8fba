"""Main text of web pages by consensus host paths (operator 4).

1. Every page is read into text blocks, each with the elements that it is in. Blocks in menus, page headers, footers,
   sidebars, notices, adverts, forms and reader comments (by tag, role, class or id) don't count; what an article or main
   element is called doesn't remove it, and an article's own header is part of it. A page's best container is the deepest
   element that holds ``HOLDS`` of the page's weighted text (links weigh nothing), or the article or main element around
   it, or else the outermost element below the body that adds text to it; lists, quotes and tables are never it alone.
2. Pages vote for their best container's generalised path: tags with their sorted classes, digits generalised. Votes
   are summed by host and path before and after a shuffle. A host's winning paths have ``SHARE`` of its votes or more.
3. Pages are read again: of the winning paths that a page has, the one that holds most of its text gives the text (of
   equal ones the deeper, then the one with more votes); a page that has none uses its own best container. Reading twice
   costs less than keeping every page's blocks between the passes, which are as large as the pages.

Blocks are joined by a newline in page order; white space inside a block becomes one space; character references are
decoded. A null page is an empty page; repeated rows are answered once each. Malformed and cut-off pages are read as far
as they go: a tag without its end is dropped, an end without a beginning is ignored, open elements end with the page.
The time that a page takes grows with its length, whatever it holds, and pages go to workers in batches of bounded bytes.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import checkpointed

#: The share of a page's text that its best container holds, the share of a host's votes that wins, and the number of
#: winning (host, path) rows up to which they are broadcast; beyond it they are joined by a shuffle.
HOLDS, SHARE, BROADCAST_ROWS = 0.7, 0.1, 100_000

# No part of it gives back what it has taken, so that a tag is read once. Only after = does a quote begin a value.
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?+)*+)(>|\Z)""",
    re.DOTALL,
)
_NAMES = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden)(?![\w-])(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""", re.IGNORECASE)
#: Kinds of elements.
_RAW = frozenset("script style noscript template iframe textarea title svg object select option canvas audio video head".split())
_CONTAINERS = frozenset("html body main article section div td table tbody thead tfoot tr center header footer nav aside form fieldset ul ol dl figure details blockquote menu dialog".split())
_LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre th caption figcaption summary address legend".split())
_BREAKS = _CONTAINERS | _LEAVES | {"hr"}
_NEVER_ALONE = frozenset("ul ol dl blockquote table tbody thead tfoot tr figure details fieldset".split())
_BOILER_TAGS = frozenset("nav header footer aside form menu dialog".split())
_BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Words that name such a part wherever they begin or end a name, words that do so only alone or beside a general word, and
#: those general words.
_BOILER_WORDS = frozenset(
    "nav navbar navigation menu menus masthead footer sidebar widget widgets ad ads adv advert adverts advertisement sponsor sponsored promo "
    "cookie cookies consent gdpr popup modal newsletter subscribe signup comment comments commentlist disqus breadcrumb breadcrumbs pagination pager toolbar".split()
)
_WEAK_WORDS = frozenset("header foot side aside rail promotion banner notice notices alert overlay login reply replies respond responses share sharing social related recommended recommendations copyright skip".split())
_GENERAL_WORDS = frozenset("page site top bottom main left right col column bar box block list items links link posts articles container wrapper wrap section area inner outer content region module panel buttons icons reader user".split())
_WORDS = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d+")


class Element:
    """An element that is open or was. key names its path: equal paths have equal keys."""

    __slots__ = ("boiler", "depth", "key", "label", "parent", "score", "tag")

    def __init__(self, tag: str, label: str, parent: Element | None, boiler: bool) -> None:
        self.tag, self.label, self.parent, self.boiler, self.score = tag, label, parent, boiler, 0.0
        self.depth = parent.depth + 1 if parent else 0
        self.key = _step(parent.key if parent else 0, label)

    @property
    def path(self) -> str:
        labels, e = [], self
        while e is not None:
            labels.append(e.label)
            e = e.parent
        return ">".join(reversed(labels))


def _step(key: int, label: str) -> int:
    return xxhash.xxh64_intdigest(label, key)


def _path_key(path: str) -> int:
    key = 0
    for label in path.split(">"):
        key = _step(key, label)
    return key


def _names_boiler(name: str) -> bool:
    """Does a class or id name such a part? "page-header" does; "has-sidebar" and "related-work" say something else."""
    words = _WORDS.findall(name)
    if not words or words[0] in ("has", "with", "no", "without", "is", "layout"):
        return False
    weak = any(w in _WEAK_WORDS for w in words) and all(w in _WEAK_WORDS or w in _BOILER_WORDS or w in _GENERAL_WORDS for w in words)
    return weak or words[0] in _BOILER_WORDS or words[-1] in _BOILER_WORDS


def _element(tag: str, attributes: str, parent: Element | None, in_article: bool) -> Element:
    label, named, hidden = tag, False, False
    if attributes and not attributes.isspace():
        for name, *values in _NAMES.findall(attributes):
            value, name = next(filter(None, values), "").lower(), name.lower()
            if name == "class":
                label += "".join("." + _DIGITS.sub("#", c.replace(">", "")) for c in sorted(set(value.split())))
            if name in ("class", "id"):
                named = named or any(map(_names_boiler, value.split()))
            elif name == "role":
                named = named or value in _BOILER_ROLES
            elif name == "hidden" or value == "true":
                hidden = True
    holds_it = tag in ("html", "body", "article", "main")  # what it is called doesn't matter
    boiler = hidden or (named and not holds_it) or (tag in _BOILER_TAGS and not (tag == "header" and in_article and not named))
    return Element(tag, label, parent, boiler or (parent is not None and parent.boiler))


def blocks(html: str) -> list[tuple[str, Element | None, int]]:
    """(text, innermost container, characters of links) of the text blocks of a page, in order."""
    stack: list[Element] = []
    out: list[tuple[str, Element | None, int]] = []
    open_tags: dict[str, int] = {}
    endless: set[str] = set()  # raw elements that have no end any more
    pieces: list[str] = []
    linked = at = articles = 0
    link_from = False

    def close() -> None:
        nonlocal linked, pieces
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            if text:
                out.append((text, stack[-1] if stack else None, linked))
            pieces = []
        linked = 0

    def pop(k: int) -> None:
        nonlocal articles
        for e in stack[k:]:
            open_tags[e.tag] -= 1
            articles -= e.tag in ("article", "main")
        del stack[k:]

    def top(*tags: str) -> bool:
        return bool(stack) and stack[-1].tag in tags

    while True:
        m = _TOKEN.search(html, at)
        text = html[at : m.start() if m else len(html)]
        if text:
            pieces.append(text)
            if link_from:
                linked += len(text)
        if m is None:
            break
        at = m.end()
        end, tag, attributes, closed = m.group(1, 2, 3, 4)
        if tag is None:
            continue
        if not closed:
            break  # a tag that the page's end cuts off
        tag = tag.lower()
        inline_button = tag == "button" and bool(stack) and stack[-1].tag in _LEAVES
        if not end and (tag in _RAW or (tag == "button" and not inline_button)):
            stop = None
            if not attributes.endswith("/"):
                if tag not in endless:
                    stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.IGNORECASE).search(html, at)
                if stop is None:
                    endless.add(tag)
                    if tag != "head":  # a head without an end: what follows is the page
                        at = len(html)
                else:
                    gt = html.find(">", stop.end())
                    at = gt + 1 if gt >= 0 else len(html)
            pieces.append(" ")
            continue
        if tag == "a":
            link_from = not end
        elif tag == "br":
            pieces.append(" ")
        if tag not in _BREAKS:
            continue
        close()
        link_from = False
        if end:
            for k in range(len(stack) - 1, -1, -1) if open_tags.get(tag) else ():
                if stack[k].tag == tag:
                    pop(k)
                    break
                if tag in _LEAVES and stack[k].tag in _CONTAINERS and stack[k].tag not in ("ul", "ol", "dl"):
                    break
        elif tag != "hr" and not attributes.endswith("/"):
            if stack and stack[-1].tag in _LEAVES and (tag in _LEAVES or top("p", "h1", "h2", "h3", "h4", "h5", "h6")):
                pop(len(stack) - 1)
            if tag in ("td", "th") and top("td", "th") or tag == "tr" and top("td", "th", "tr"):
                while top("td", "th") or (tag == "tr" and top("tr")):
                    pop(len(stack) - 1)
            stack.append(_element(tag, attributes, stack[-1] if stack else None, articles > 0))
            open_tags[tag] = open_tags.get(tag, 0) + 1
            articles += tag in ("article", "main")
    close()
    return out


def _weight(text: str, links: int) -> float:
    free = max(0.0, 1 - links / max(1, len(text)))
    return len(text) * free * (1.0 if len(text) >= 25 or text[-1] in ".!?" else 0.3)


def _scored(found: list[tuple[str, Element | None, int]]) -> list[Element]:
    """The containers that hold text that counts, with its weight as their score, in any order; each is added to its
    parent once."""
    seen: dict[int, Element] = {}
    for text, element, links in found:
        if element is None or element.boiler:
            continue
        if id(element) not in seen:
            element.score = 0.0
            seen[id(element)] = element
            e = element.parent
            while e is not None and id(e) not in seen:
                e.score = 0.0
                seen[id(e)] = e
                e = e.parent
        element.score += _weight(text, links)
    for e in sorted(seen.values(), key=lambda e: -e.depth):
        if e.parent is not None:
            e.parent.score += e.score
    return [e for e in seen.values() if e.tag in _CONTAINERS]


def best_container(found: list[tuple[str, Element | None, int]]) -> Element | None:
    """The element that holds the article, or None if no element holds text."""
    return _best(_scored(found))


def _best(scored: list[Element]) -> Element | None:
    if not scored:
        return None
    most = max(e.score for e in scored)
    best = max((e for e in scored if e.score >= HOLDS * most), key=lambda e: e.depth)
    around = best
    while around is not None and around.tag not in ("article", "main"):
        around = around.parent
    if around is not None:
        return around
    while (up := best.parent) is not None and up.tag in _CONTAINERS and (best.tag in _NEVER_ALONE or (up.tag not in ("html", "body") and up.score > best.score)):
        best = up
    return best


def extract(html: str | None, winners: list[str]) -> str:
    """The main text of a page, given the winning paths of its host."""
    found = blocks(html or "")
    if not found:
        return ""
    scored = _scored(found)
    own, held = _best(scored), {}
    wanted = {_path_key(p): p for p in winners}
    for e in scored:
        if e.key in wanted:
            held[wanted[e.key]] = held.get(wanted[e.key], 0.0) + e.score
    path = max(winners, key=lambda p: (held.get(p, 0.0), p.count(">")), default=None) if held else None
    most = max((e.score for e in scored), default=0.0)
    key = None if path is None else _path_key(path)
    if own is not None and (path is None or held[path] < HOLDS * most):
        key = own.key
    inside: dict[int, bool] = {}

    def is_inside(e: Element | None) -> bool:
        chain = []
        while e is not None and id(e) not in inside:
            chain.append(e)
            e = e.parent
        answer = key is None or (e is not None and inside[id(e)])
        for x in reversed(chain):
            answer = answer or x.key == key
            inside[id(x)] = answer
        return answer

    return "\n".join(text for text, e, _ in found if not (e is not None and e.boiler) and (key is None or is_inside(e)))


def host_of(url: Column) -> Column:
    """The URL's host in lower case, without user and port; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def votes(pages: DataFrame) -> DataFrame:
    """(host, path): the best container of each page that has one. pages: (url, html)."""

    def run(batches):
        for batch in batches:
            hosts, paths = [], []
            for host, html in zip(batch.column(0), batch.column(1), strict=True):
                best = best_container(blocks(html.as_py() or ""))
                if best is not None:
                    hosts.append(host.as_py())
                    paths.append(best.path)
            yield pa.record_batch([pa.array(hosts, pa.string()), pa.array(paths, pa.string())], names=["host", "path"])

    return pages.select(host_of(F.col("url").cast("string")).alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(run, "host string, path string")


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, paths): for each host the paths that have ``SHARE`` of its votes (a dozen at most), most votes first."""
    counts = votes(pages).groupBy("host", "path").agg(F.count("*").alias("n"))
    sums = counts.groupBy("host").agg(F.sum("n").alias("all"))
    won = counts.join(sums, "host").where(F.col("n") >= SHARE * F.col("all"))
    ranked = won.groupBy("host").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "path"))).alias("ranked"))
    return ranked.select("host", F.col("ranked.path").alias("paths"))


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    winners = checkpointed(winning_paths(rows))
    side = winners.select(F.col("host").alias("_h"), "paths")
    if winners.count() <= BROADCAST_ROWS:  # each row has a dozen paths at most
        side = F.broadcast(side)
    joined = rows.withColumn("_host", host_of(F.col("url"))).join(side, F.col("_host") == F.col("_h"), "left").select("page_id", "url", "html", "paths")

    def run(batches):
        for batch in batches:
            texts = [extract(html.as_py(), paths.as_py() or []) for html, paths in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
