"""Main-text extraction by consensus host paths.

First pass: every page's elements are walked, and each container that holds blocks of text gets a score: the characters
in its own blocks, less those inside links, and nothing for elements that by tag or by class name are menus, headers,
footers, sidebars, notices, adverts, forms or reader comments.  A wrapper counts what its inner containers have, in full if
it is one text with them (paragraphs or headings of its own, inner containers of one kind, such as sections, or two of which
one has the title), else less a tenth, as do the body, where boilerplate lies (unless it holds sections alone), and whatever is round an article or main
element; so the main column of a page wins over the page.  A container's path is its chain of tags with generalised
classes (digits become #).  In Spark, each page votes for its best path with its score's share; each host's path with the
most votes wins, and all hosts' votes together give the fallback.  Second pass: a page is read again at its host's
winning path; a page that has no such container, or finds no text there, uses the overall path and then its own best one.
Text outside any container belongs to the page itself, which is the outermost container.

Within the container text is gathered block by block.  Character references are decoded, white space in a block becomes
one space, blocks are trimmed, empty ones left out, the others joined by a newline.  A block container with a name that an
article may use too (``share``, ``form``, ``related`` and the like) goes if it is short or mostly links.

A null or empty page, and one without text, gives the empty text.  A null or malformed url belongs to the empty host; of
paths with equal votes the greatest wins.  Pages of any length are read whole, in time and memory in proportion to it:
tags are read by a scanner that never goes back, an unclosed tag or comment ends the page, and open elements are counted
by tag.  Repeated rows vote each time; other columns are carried as they are; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, written
from .urls import host_of

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Content that is no markup, up to the end tag.
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
#: Elements that are never article text.
DROPPED = frozenset("script style noscript template iframe title head nav header footer aside form button select option textarea input svg canvas audio video object dialog menu noembed noframes xmp fieldset label".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Containers that may be chosen.
CONTAINERS = frozenset("article body div main section td".split())
#: Start tags that end an open paragraph.
ENDS_P = BLOCKS - frozenset("body html".split())
#: Block containers, which may be boilerplate by their names.
NAMED = frozenset("div section ul ol dl table tbody td tr address details figure center dir".split())
#: Words of classes, ids and roles that mark boilerplate, those that an article's parts may have too, and those beside them.
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs footer header "
    "masthead sidebar aside widget widgets cookie cookies consent gdpr notice alert popup modal overlay subscribe newsletter signup login comment comments disqus "
    "reply replies respond complementary contentinfo copyright pagination pager commentlist comments-area page-footer page-nav post-comments post-nav post-navigation "
    "disqus_thread".split()
)
#: Ids of what readers wrote, which no article's part is taken for.
COMMENT_IDS = frozenset("comments comments-area commentlist comment-list respond disqus disqus_thread".split())
SOFT_NOISE = frozenset("share sharing social form search side related recommended discussion legal skip toolbar".split())
BESIDE = frozenset("top bottom left right main site box block wrap wrapper container list bar area inner outer primary secondary global fixed links buttons policy us".split())
#: A soft block with fewer characters goes.
SOFT_LEAST = 100
#: Blocks that make a wrapper one text with its inner containers.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt figcaption".split())
TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
#: The end of a tag, or one attribute.  Nothing is tried twice but for the last quote of a kind, if it is unclosed.
ATTRIBUTE = re.compile(r"[\s/]*+(?:(>)|([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+)")
SPACE = re.compile(r"\s+")
_PRIME, _MASK = 0x100000001B3, (1 << 64) - 1


class Element:
    """An open element: its place in the chain of labels, how its text counts, and its container."""

    __slots__ = ("tag", "chain", "key", "dropped", "soft", "link", "container", "in_article")

    def __init__(self, tag: str, chain: tuple | None, key: int, dropped: bool, soft: int, link: bool, container: int, in_article: bool):
        self.tag, self.chain, self.key, self.dropped, self.soft, self.link, self.container, self.in_article = tag, chain, key, dropped, soft, link, container, in_article


class Container:
    """A container: its parent (or -1), its tag, the chain of labels that is its path, and the path's hash."""

    __slots__ = ("parent", "tag", "chain", "key")

    def __init__(self, parent: int, tag: str, chain: tuple | None, key: int):
        self.parent, self.tag, self.chain, self.key = parent, tag, chain, key

    @property
    def path(self) -> str:
        labels, chain = [], self.chain
        while chain:
            chain, own = chain
            labels.append(own)
        return ">".join(reversed(labels))


class Block:
    __slots__ = ("container", "link", "text", "tag", "soft")

    def __init__(self, container: int, link: bool, text: str, tag: str, soft: int):
        self.container, self.link, self.text, self.tag, self.soft = container, link, text, tag, soft


def label(tag: str, attributes: dict[str, str]) -> str:
    """Tag and generalised classes."""
    if not attributes.get("class"):
        return tag
    classes = sorted({re.sub(r"\d+|>", "#", c.lower()) for c in unescape(attributes["class"]).split()})
    return ".".join([tag, *classes])


def _key(above: int, own: str) -> int:
    return (above * _PRIME + crc32(own.encode("utf-8", "surrogatepass")) + 1) & _MASK


def path_key(path: str) -> int:
    key = 0
    for own in path.split(">") if path else ():
        key = _key(key, own)
    return key


def _attributes(html: str, at: int) -> tuple[int, dict[str, str] | None]:
    """The end of the tag that goes on at ``at`` and its attributes; without an end, none."""
    if html.startswith(">", at):
        return at + 1, {}
    out: dict[str, str] = {}
    while found := ATTRIBUTE.match(html, at):
        at = found.end()
        if found[1]:
            return at, out
        out.setdefault(found[2].lower(), found[3] or found[4] or found[5] or "")
    return len(html), None


def noise_of(tag: str, attributes: dict[str, str], in_article: bool) -> str:
    """Whether a block container is boilerplate by its names: "yes", "soft" or "".  Headings and inline elements never are.

    A name counts if it is a word of boilerplate, or all its hyphened parts are or stand beside such words; in an article
    only a class or role that is such a word as a whole.  An id counts as a whole, but not a section's or one in an
    article, as it may name what the section is about, unless it is that of reader comments.
    """
    if tag not in NAMED or not attributes:
        return ""
    names = [unescape(attributes[a]).lower() for a in ("class", "role") if a in attributes]
    found = ""
    for name in " ".join(names).split():
        parts = [name] if in_article or name in NOISE else [p.rstrip("0123456789") for p in re.split(r"[-_]+", name) if p]
        if all(p in NOISE or p in SOFT_NOISE or p in BESIDE or not p for p in parts):
            if any(p in NOISE for p in parts):
                return "yes"
            if any(p in SOFT_NOISE for p in parts):
                found = "soft"
    own = attributes.get("id", "").strip().lower()
    if own in COMMENT_IDS:
        return "yes"
    if not in_article and tag != "section":
        found = "yes" if own in NOISE else found or ("soft" if own in SOFT_NOISE else "")
    return found


class Page:
    """A page's blocks in order and its containers; the first container is the page itself."""

    def __init__(self, html: str):
        self.containers = [Container(-1, "body", None, 0)]
        self.blocks: list[Block] = []
        self._stack = [Element("#page", None, 0, False, -1, False, 0, False)]
        self._open: dict[str, list[int]] = {}  # places in the stack by tag
        self._open_blocks: list[int] = [0]
        self._parts: list[str] = []
        self._linked = 0
        self._soft = 0
        self._read(html)
        self._flush()
        self._drop_soft()

    # text

    def _flush(self) -> None:
        if self._parts:
            top = self._stack[-1]
            text = SPACE.sub(" ", "".join(self._parts)).strip()
            if text:
                self.blocks.append(Block(top.container, 2 * self._linked > len(text), text, self._stack[self._open_blocks[-1]].tag, top.soft))
            self._parts.clear()
        self._linked = 0

    def _push(self, text: str) -> None:
        top = self._stack[-1]
        if not top.dropped:
            if "&" in text:
                text = unescape(text)
            self._parts.append(text)
            if top.link:
                self._linked += len(text.strip())

    def _drop_soft(self) -> None:
        """Leave out soft blocks that are short or mostly links."""
        if not self._soft:
            return
        own, linked = [0] * self._soft, [0] * self._soft
        for b in self.blocks:
            if b.soft >= 0:
                own[b.soft] += len(b.text)
                linked[b.soft] += len(b.text) if b.link else 0
        self.blocks = [b for b in self.blocks if b.soft < 0 or (own[b.soft] >= SOFT_LEAST and 2 * linked[b.soft] <= own[b.soft])]

    # elements

    def _last(self, tag: str) -> int:
        places = self._open.get(tag)
        return places[-1] if places else -1

    def _close_to(self, size: int) -> None:
        while len(self._stack) > size:
            tag = self._stack.pop().tag
            self._open[tag].pop()
            if tag in BLOCKS:
                self._open_blocks.pop()

    def _end(self, tag: str, within: tuple[str, ...]) -> None:
        """Close the nearest open ``tag`` that no element of ``within`` separates."""
        at = self._last(tag)
        if at > 0 and all(self._last(w) < at for w in within):
            self._close_to(at)

    def _end_tag(self, tag: str) -> None:
        at = self._last(tag)
        if tag in BLOCKS:
            self._flush()
        elif at <= self._open_blocks[-1]:
            return  # an inline end tag does not reach beyond its block
        if at > 0:
            if self._open_blocks[-1] >= at:
                self._flush()
            self._close_to(at)

    def _start_tag(self, tag: str, attributes: dict[str, str], closed: bool) -> bool:
        """Whether the element's content is to be read."""
        if tag in BLOCKS:
            self._flush()
            if tag in ENDS_P:
                self._end("p", ("article", "body", "div", "section", "td", "li", "main", "blockquote"))
            for own, within in ENDS.get(tag, ()):
                self._end(own, within)
        if tag in VOID:
            if tag in ("br", "hr"):
                self._push(" ")
            return False
        top = self._stack[-1]
        noise = noise_of(tag, attributes, top.in_article)
        # an article's own header is text, the site's is not
        dropped = (tag in DROPPED and not (tag == "header" and top.in_article)) or (noise == "yes" and not (tag == "header" and top.in_article))
        dropped = dropped or "hidden" in attributes or "display:none" in attributes.get("style", "").replace(" ", "").lower()
        if tag in RAW:
            return True
        if closed and tag not in BLOCKS:
            return False
        soft = top.soft
        if noise == "soft" and soft < 0:
            soft, self._soft = self._soft, self._soft + 1
        own = label(tag, attributes)
        chain, key = (top.chain, own), _key(top.key, own)
        container = top.container
        if tag in CONTAINERS and not (dropped or top.dropped):
            self.containers.append(Container(top.container, tag, chain, key))
            container = len(self.containers) - 1
        self._open.setdefault(tag, []).append(len(self._stack))
        if tag in BLOCKS:
            self._open_blocks.append(len(self._stack))
        self._stack.append(Element(tag, chain, key, top.dropped or dropped, soft, top.link or tag == "a", container, top.in_article or tag in ("article", "main")))
        return True

    # markup

    def _read(self, html: str) -> None:
        at, n = 0, len(html)
        cdata = True  # whether a CDATA section may still end
        while at < n:
            start = html.find("<", at)
            if start < 0:
                self._push(html[at:])
                return
            if start > at:
                self._push(html[at:start])
            after = html[start + 1 : start + 2]
            if after == "!" or after == "?":
                at = -1
                if html.startswith("<!--", start):
                    at = html.find("-->", start + 2)  # <!--> is a whole comment
                    if at < 0:
                        return
                    at += 3
                elif cdata and html.startswith("<![CDATA[", start):
                    at = html.find("]]>", start) + 3
                    cdata = at > 2
                if at < 3:
                    at = html.find(">", start) + 1
                    if not at:
                        return
                continue
            if after == "/":
                name = TAG_NAME.match(html, start + 2)
                at = html.find(">", start) + 1
                if not at:
                    return
                if name:
                    self._end_tag(name[0].lower())
                continue
            name = TAG_NAME.match(html, start + 1)
            if not name:
                self._push("<")
                at = start + 1
                continue
            at, attributes = _attributes(html, name.end())
            if attributes is None:
                return
            tag = name[0].lower()
            if self._start_tag(tag, attributes, html[at - 2] == "/") and tag in RAW:
                end = _RAW_END[tag].search(html, at)
                at = n if not end else (html.find(">", end.start()) + 1 or n)

    # choice

    def scores(self) -> list[float]:
        """Of each container: its blocks' text outside links, and its inner containers' (see the module)."""
        n = len(self.containers)
        own, one_text, titled, title_inside = [0.0] * n, [False] * n, [False] * n, [False] * n
        for b in self.blocks:
            if not b.link:
                own[b.container] += len(b.text)
                one_text[b.container] |= b.tag in PROSE and self.containers[b.container].tag != "body"
            titled[b.container] |= b.tag == "h1"
        inner, kinds = [0.0] * n, [None] * n  # the label of the inner containers with text ("" if they differ), how many
        marked = [False] * n  # whether an article lies inside
        out = [0.0] * n
        for i in range(n - 1, -1, -1):  # children come after their parents
            c = self.containers[i]
            kind, many = kinds[i] or ("", 0)
            if c.tag == "body":
                alike = many > 1 and kind.startswith("section")
            else:
                alike = many > 1 and (kind != "" or (many == 2 and title_inside[i]))
            out[i] = own[i] + inner[i] * (1.0 if (one_text[i] or alike) and not marked[i] else 0.9)
            if c.tag in ("article", "main"):
                out[i] *= 1.2
            if c.parent >= 0 and out[i]:
                marked[c.parent] |= marked[i] or c.tag in ("article", "main")
                title_inside[c.parent] |= titled[i]
                inner[c.parent] += out[i]
                name, before = c.chain[1], kinds[c.parent]
                kinds[c.parent] = (name, 1) if before is None else (name if before[0] == name else "", before[1] + 1)
        return out

    def best(self) -> int:
        """The container with the greatest score, of equals the inner one; -1 without any text."""
        if not self.blocks:
            return -1
        found = self.scores()
        return max(range(len(found)), key=lambda i: (found[i], i if found[i] else -i))

    def text(self, key: int) -> str:
        """The text of all containers with that path."""
        inside: list[bool] = []
        for c in self.containers:
            inside.append(c.key == key or (c.parent >= 0 and inside[c.parent]))
        return "\n".join(b.text for b in self.blocks if inside[b.container])


#: Start tags that end others: (the tag that ends, what separates them).
ENDS = {
    "li": (("li", ("ul", "ol", "menu")),),
    "td": (("td", ("tr", "table")), ("th", ("tr", "table"))),
    "th": (("td", ("tr", "table")), ("th", ("tr", "table"))),
    "tr": (("tr", ("table",)),),
    "dd": (("dd", ("dl",)), ("dt", ("dl",))),
    "dt": (("dd", ("dl",)), ("dt", ("dl",))),
}
_RAW_END = {tag: re.compile(rf"</{tag}[\s/>]", re.I) for tag in RAW}


def best_path(html: str | None) -> tuple[str | None, float]:
    """The path of the page's best container, and its share of all text."""
    page = Page(html or "")
    top = page.best()
    if top < 0:
        return None, 0.0
    return page.containers[top].path, min(1.0, page.scores()[top] / max(1, sum(len(b.text) for b in page.blocks)))


def text_at(html: str | None, paths: list[str | None]) -> str:
    """The text of the containers with the first of the paths that has any; else of the page's best container."""
    page = Page(html or "")
    if not page.blocks:
        return ""
    for path in paths:
        if path is not None and (text := page.text(path_key(path))):
            return text
    return page.text(page.containers[page.best()].key)


def host_paths(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, path, overall): each host's winning path, and that of all hosts.  Votes are added before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "html", 4 << 20):
                found = [best_path(h) for h in part.column("html").to_pylist()]
                votes = pa.array([int(1e6 * s) for _, s in found], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("host"), pa.array([p for p, _ in found], pa.string()), votes], names=["host", "path", "vote"])

    votes = pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html")).mapInArrow(run, "host string, path string, vote long")
    by_path = written(votes.where("path is not null").groupBy("host", "path").agg(F.sum("vote").alias("votes")), "votes")
    best = F.max_by("path", F.struct("votes", "path"))
    everywhere = by_path.groupBy("path").agg(F.sum("votes").alias("votes")).agg(best.alias("overall"))
    return by_path.groupBy("host").agg(best.alias("path")).withColumn("overall", everywhere.scalar())


def extract(pages: DataFrame, url: str = "url", html: str = "html", text: str = "text") -> DataFrame:
    """``pages`` without its html, with the main text.

    The table of host paths is broadcast only where it is under Spark's limit; else the join is by host, and Spark splits
    a hot one.
    """
    names = {text, html}
    kept = [f for f in pages.schema.fields if f.name not in names]
    paths = written(host_paths(pages, url, html), "paths").withColumnsRenamed({"host": "__host", "path": "__path", "overall": "__overall"})
    rows = pages.withColumn("__host_of", host_of(F.col(url))).join(paths, F.col("__host_of") == F.col("__host"), "left")
    schema = T.StructType([*kept, T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "__html", 4 << 20):
                rows = zip(*(part.column(c).to_pylist() for c in ("__html", "__path", "__overall")), strict=True)
                texts = [text_at(h, [p, o]) for h, p, o in rows]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), pa.array(texts, pa.string())], names=schema.names)

    columns = [F.col(f"`{f.name}`") for f in kept]
    return rows.select(*columns, F.col(html).alias("__html"), "__path", "__overall").mapInArrow(run, schema)
