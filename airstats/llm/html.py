"""Main text of web pages by consensus of their hosts.

Each page's containers are scored by the text they hold; the page votes for the container it would
choose, named by its path of tags and classes with numbers generalised. Spark counts the votes of
each host, and every page is then read again with its host's winning paths; a page without any of
them keeps its own choice.

At most ``PATHS`` paths of a host win, each with ``MIN_SHARE`` of its votes; pages of rarer layouts make
their own choice.

A null or empty page has an empty text; a null url counts as one host. Every row gives one result
row, equal pages of a host get equal texts.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from airstats.llm.phases import finished

#: Winning paths kept for a host, and the share of the host's votes that each needs.
PATHS, MIN_SHARE = 3, 0.1

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"""
    r"""|<(?P<raw>script|style|noscript|template|svg|math|iframe|object|textarea|select|title|canvas|video|audio)\b"""
    r"""(?:[^>"']++|"[^"]*"|'[^']*'|["'])*+>.*?(?:</(?P=raw)\s*>|\Z)"""
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*"|'[^']*')*+)>"""
    r"""|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)""", re.S | re.I)
_ATTR = re.compile(r"""(?<![a-zA-Z-])([a-zA-Z-]++)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")

# fixed values: tags by their part in a page
_CONTAINERS = set("html body main article section div td center fieldset details blockquote ul ol dl table tbody "
                  "tr th thead tfoot figure header li dd dt form nav footer aside menu dialog hgroup address "
                  "summary caption".split())
_BLOCKS = _CONTAINERS | set("p h1 h2 h3 h4 h5 h6 pre hr figcaption head option legend".split())
_VOID = set("br hr img input meta link area base col embed source track wbr param".split())
_SKIPPED = set("nav footer aside form menu dialog head button".split())
_SAME_CLOSES = set("p li td th tr dd dt option".split())
_CHOSEN_FROM = set("html body main article section div td center figure".split())
_BAD_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu "
                 "menubar toolbar".split())
_BAD_WORDS = set("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie "
                 "cookies consent gdpr notice notification alert newsletter subscribe subscription popup modal "
                 "overlay share sharing social sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs "
                 "footer masthead topbar toolbar comment comments reply replies disqus related recommended "
                 "recommendations widget pagination pager login signin signup search skip hidden".split())
_COMMENTS = set("comment comments commentary reply replies disqus".split())
_STRUCTURE = set("area bar block body box button buttons container content footer form head header icon icons inner "
                 "item items link links list outer panel row section slot thread title unit wrap wrapper".split())
_WHOLE = ("article", "main")
_GOOD_NAMES = set("article content main post entry story".split())
_NEUTRAL = set("has with no without".split())


@dataclass
class Page:
    """Containers (path, parent) and text blocks (container, text, characters in links) of a page."""

    paths: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    blocks: list[tuple[int, str, int]] = field(default_factory=list)

    def weights(self) -> list[int]:
        """Characters of text outside links within each container."""
        own = [0] * len(self.paths)
        for at, text, linked in self.blocks:
            own[at] += max(len(text) - linked, 0)
        for i in range(len(own) - 1, 0, -1):
            own[self.parents[i]] += own[i]
        return own

    def best(self) -> list[int]:
        """The containers that one gets to by always going to a child with most of the text.

        One goes no further where a container has text of its own beside that child, or further
        children of the child's path: title, lead and sections belong together. An article or main is
        not gone into, as all its text belongs to it; articles side by side are chosen together. The
        first one chosen has most of the text.
        """
        weights = self.weights()
        children: list[list[int]] = [[] for _ in self.paths]
        for i, parent in enumerate(self.parents[1:], 1):
            children[parent].append(i)
        own = {at for at, text, linked in self.blocks if len(text) > linked}
        at = chosen = 0
        while True:
            heavy = [i for i in children[at] if 10 * weights[i] >= 7 * weights[at] and weights[i]]
            heavy += [i for i in children[at] if i not in heavy and weights[i]
                      and self.tags[i] in _WHOLE and 10 * weights[i] >= 4 * weights[at]]
            if not heavy:
                articles = [i for i in children[at] if self.tags[i] in _WHOLE and weights[i]]
                if 10 * sum(weights[i] for i in articles) >= 7 * weights[at] and articles:
                    return sorted(articles, key=lambda i: -weights[i])
                return [chosen]
            best = max(heavy, key=lambda i: weights[i])
            if self.tags[best] in _WHOLE:
                return [best, *[i for i in children[at] if i != best and self.tags[i] == self.tags[best] and weights[i]]]
            alike = [i for i in children[at] if self.paths[i] == self.paths[best] and weights[i]]
            if at in own or len(alike) > 1:
                return [at if self.tags[at] in _CHOSEN_FROM else chosen]
            at = best
            if self.tags[at] in _CHOSEN_FROM:
                chosen = at

    def text(self, chosen: list[int]) -> str:
        """Blocks inside the chosen containers, in page order; lists of links go unless an article has them."""
        inside = [False] * len(self.paths)
        whole = [False] * len(self.paths)
        for i in range(len(inside)):
            inside[i] = i in chosen or (i > 0 and inside[self.parents[i]])
            whole[i] = self.tags[i] in _WHOLE or (i > 0 and whole[self.parents[i]])
        lists: dict[int, list[int]] = {}
        for at, text, linked in self.blocks:
            owner = self._list_of(at)
            if owner is not None:
                sums = lists.setdefault(owner, [0, 0, 0])
                sums[0] += len(text)
                sums[1] += linked
                sums[2] += 1
        menus = {i for i, (n, linked, k) in lists.items() if k > 1 and 10 * linked >= 9 * n and not whole[i]}
        return "\n\n".join(text for at, text, _ in self.blocks if inside[at] and self._list_of(at) not in menus)

    def _list_of(self, at: int) -> int | None:
        while at > 0:
            if self.tags[at] in ("ul", "ol", "dl"):
                return at
            at = self.parents[at]
        return None


def _bad(tag: str, attrs: dict[str, str], in_article: bool) -> bool:
    if tag in ("html", "body"):
        return False
    if tag == "header":
        return not in_article
    if attrs.get("role", "").lower() in _BAD_ROLES or attrs.get("aria-hidden", "").lower() == "true":
        return True
    if re.search(r"display\s*:\s*none", attrs.get("style", ""), re.I):
        return True
    names = re.findall(r"\S+", f"{attrs.get('class', '')} {attrs.get('id', '')}".lower())
    words_of = [w for w in (re.findall(r"[a-z]+", name) for name in names) if w and w[0] not in _NEUTRAL]
    # readers' comments, whatever else the container is called
    if tag in _CONTAINERS and any(_COMMENTS & set(w) and not set(w) - _COMMENTS - _STRUCTURE for w in words_of):
        return True
    if _GOOD_NAMES & set(names):
        return False
    if in_article:
        # what an article says may be about any of the words: only containers named for nothing else go
        return tag in _CONTAINERS and any(_BAD_WORDS & set(w) and not set(w) - _BAD_WORDS - _STRUCTURE for w in words_of)
    return any(_BAD_WORDS & set(w) for w in words_of)


def read_page(source: str | None, with_forms: bool = False) -> Page:
    """Containers and blocks of a page, without the parts that belong to no article."""
    page = Page(["html"], [-1], ["html"])
    stack: list[tuple[str, int, bool]] = [("html", 0, False)]  # tag, container, left out
    text: list[str] = []
    linked = 0
    in_link = False
    at = 0

    def flush() -> None:
        nonlocal linked
        if text:
            whole = " ".join("".join(text).split())
            if whole and not stack[-1][2]:
                page.blocks.append((stack[-1][1], whole, linked))
            text.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        if not stack[-1][2]:
            piece = html.unescape(piece) if "&" in piece else piece
            text.append(piece)
            if in_link:
                linked += len(piece.strip())

    source = source or ""
    for token in _TOKEN.finditer(source):
        if token.start() > at:
            add(source[at:token.start()])
        at = token.end()
        tag = token["tag"] or token["tag2"]
        if not tag:
            continue
        tag = tag.lower()
        ends = token["end"] or token["end2"]
        if tag == "a":
            in_link = not ends
        elif tag == "br":
            add(" ")
        elif tag in _BLOCKS or tag == "button":
            if ends:
                depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
                flush()
                if depth:
                    del stack[depth:]
                continue
            flush()
            in_link = False
            if stack[-1][0] == "p" or stack[-1][0] == tag and tag in _SAME_CLOSES:
                stack.pop()
            if tag in _VOID:
                continue
            raw = token["attrs"] or token["attrs2"] or ""
            attrs = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(raw)} if "=" in raw else {}
            hidden = bool(re.search(r"(?:^|\s)hidden(?:\s|=|$)", raw)) if "hidden" in raw else False
            out = stack[-1][2] or hidden or tag in _SKIPPED and not (with_forms and tag == "form") or _bad(
                tag, attrs, any(t in ("article", "main") for t, _, _ in stack))
            place = stack[-1][1]
            if tag in _CONTAINERS and not out:
                name = ".".join([tag, *sorted(re.sub(r"\d+", "#", c) for c in attrs.get("class", "").lower().split())])
                page.paths.append(f"{page.paths[place]}/{name}")
                page.parents.append(place)
                page.tags.append(tag)
                place = len(page.paths) - 1
            if not raw.rstrip().endswith("/"):
                stack.append((tag, place, out))
    if at < len(source):
        add(source[at:])
    flush()
    if not page.blocks and not with_forms and "<form" in source.lower():
        return read_page(source, True)
    return page


def vote(source: str | None) -> tuple[str, int] | None:
    """Path of the page's best container and the text it holds."""
    page = read_page(source)
    best = page.best()[0]
    weight = page.weights()[best]
    return (page.paths[best], weight) if weight else None


def main_text(source: str | None, winners: list[str]) -> str:
    """Text of the first of the host's winning paths that this page has, or of its own choice."""
    page = read_page(source)
    weights = page.weights()
    for path in winners:
        chosen = [i for i, p in enumerate(page.paths) if p == path and weights[i]]
        if chosen:
            own = page.best()
            return page.text(chosen if not set(chosen) & set(own) else [*chosen, *own])
    return page.text(page.best())


def host(url: str) -> Column:
    """Lower-cased host of a url column; null or unreadable: empty."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def host_paths(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """``host`` and its winning paths (array, most votes first). A page's vote counts once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes = [vote(s.as_py()) for s in batch.column("html")]
            keep = pa.array([i for i, v in enumerate(votes) if v], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("host").take(keep), pa.array([v[0] for v in votes if v], pa.string())],
                names=["host", "path"])

    cast = (pages.select(host(url).alias("host"), F.col(source).alias("html"))
            .mapInArrow(run, "host string, path string").groupBy("host", "path").agg(F.count("*").alias("votes")))
    of_host = Window.partitionBy("host")
    return (cast.withColumn("share", F.col("votes") / F.sum("votes").over(of_host))
            .withColumn("place", F.row_number().over(of_host.orderBy(F.desc("votes"), "path")))
            .where((F.col("place") <= PATHS) & (F.col("share") >= MIN_SHARE))
            .groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "path"))),
                                             lambda x: x["path"]).alias("paths")))


def extracted(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """``key``, ``url``, text and n_chars for each row of ``pages``."""
    # a written table: its size is known, so pages stay where they are unless it is large
    winners = finished(host_paths(pages, url, source), "hosts")
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(source).alias("html"), host(url).alias("host"))
    joined = rows.join(winners, "host", "left").select("key", "url", "html", "paths")
    kind = pages.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(s.as_py(), p.as_py() or []) for s, p in zip(batch.column("html"), batch.column("paths"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array(map(len, texts), pa.int64())], names=["key", "url", "text", "n_chars"])

    return joined.mapInArrow(run, f"key {kind}, url string, text string, n_chars long").withColumnsRenamed(
        {"key": key, "url": url})
