"""Main-text extraction by consensus host paths.

Each page's containers are scored by the running text they hold. A page votes for every container that
comes near its best, under a generalised path of tags and classes (digits and attributes other than
class are left out); Spark sums the votes by host and path, so a host's layout is settled by all its
pages. Every page is then extracted again from the container on its host's winning path, or from its
own best container if it has none there.

Headings and paragraphs are never judged by their names. Elements made for something else than text
(menus, hidden parts) are left out; a form is unless it holds most of the page's running text, and a
container whose class, id or label names a side part is unless it holds nearly all of it. Where the
name is ambiguous it takes a second sign: many links, a place outside the article, or little text.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.columns import column_function, cut, small_batches

#: A page votes for containers with at least this share of its best one's score.
NEAR = 0.5
#: Hosts up to this number are broadcast with their paths; more are joined by a shuffle.
BROADCAST_HOSTS = 100_000
#: A winning container with less than this share of the text of the page's best gives way to it.
LEAST_SHARE = 0.3
#: Siblings of the chosen container with fewer links than this belong to it, if they have its tag and classes or this share of its score.
SIBLING_SHARE, SIBLING_LINKS = 0.2, 0.3
#: A paragraph of fewer characters in an article's own header is a byline or date.
STANDFIRST = 60
#: What no form has: most of the running text. What a small part has: this share of it at most.
MOST, LITTLE = 0.5, 0.1
#: Longer paths are told apart by a digest.
PATH_CHARS = 400
#: Between the paths of siblings that hold a text together.
AND = " + "

#: Kinds of elements.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
SKIPPED = frozenset("head script style noscript template iframe object embed svg canvas math audio video map title noembed noframes xmp".split())
ASIDE = frozenset("nav aside footer button select option textarea input dialog menu menuitem label".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split())
CONTAINERS = frozenset("html body main article section div td center table tbody tr blockquote form fieldset header ul ol dl li".split())
#: Containers that can't be the main one, but can be left out.
SIDES = frozenset("form fieldset header ul ol dl li".split())
WHOLE = frozenset("html body main".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SPACES = frozenset("br td th img".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
ROLES = frozenset("navigation banner complementary contentinfo search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of names. A name is of a side part if its last word is, or its first before neutral ones.
GOOD = frozenset("article content main post entry story body text page".split())
SIDE = frozenset("ad ads advert adverts advertisement advertising adsense adslot adsbygoogle werbung anzeige publicite publicidad sponsor sponsored promo promotion cookie cookies consent gdpr newsletter comment comments commentlist disqus replies sidebar nav navbar navigation menu breadcrumb breadcrumbs share sharing social footer masthead toolbar pagination pager popup modal overlay login signup".split())
UNSURE = frozenset("banner notice notices alert subscribe subscription reply respond discussion widget widgets related recommended recommendations teaser teasers skip header".split())
NEUTRAL = frozenset("area bar block bottom box button buttons container content form group holder icons inner item items left link links list main media message panel posts articles stories right row section slot thread top unit wrap wrapper".split())
#: Side names that are also common words: in an article they need links, or no paragraphs, to count.
WORDS = frozenset("menu share sharing social promo promotion sponsor sponsored masthead overlay popup modal login signup toolbar pager footer".split())
LAYOUT = frozenset("with has no layout".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_ATTRIBUTE = re.compile(r"[\s/]*+([^\s/>=][^\s/>=]*+)(\s*+=\s*+)?+")
_BARE = re.compile(r"[^\s>]*+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
_PARTS = re.compile(r"[^a-z]+")
#: Classes of an article's own header, of which the headings are text.
_TITLED = re.compile(r"(?:^|\s)(?:article|content|main|post|entry|story|page)[-_]*header(?:\s|$)", re.I)
_HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

FREE, FORM, SIDE_PART, PERHAPS, TOLD = range(5)


def tokens(html: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """Texts ("", text, {}), start tags ("<", name, attributes) and end tags (">", name, {}), in one pass that never goes back."""
    at, size = 0, len(html)
    last_quote = {q: html.rfind(q) for q in "\"'"}
    while at < size:
        tag = html.find("<", at)
        if tag < 0 or tag + 1 == size:
            yield "", html[at:], {}
            return
        follows = html[tag + 1]
        closing = follows == "/"
        name = _NAME.match(html, tag + 1 + closing) if closing or follows.isalpha() else None
        if name is None and not closing and follows not in "!?":
            yield "", html[at : tag + 1], {}
            at = tag + 1
            continue
        if tag > at:
            yield "", html[at:tag], {}
        if name is None:
            comment = html.startswith("<!--", tag)
            end = html.find("-->" if comment else ">", tag + 2)
            at = size if end < 0 else end + (3 if comment else 1)
            continue
        word, at, given = name[0].lower(), name.end(), {}
        while (m := _ATTRIBUTE.match(html, at)) is not None:
            key, at = m[1].lower(), m.end()
            value = ""
            if m[2]:
                quote = html[at : at + 1]
                if quote in last_quote and quote and at < last_quote[quote]:
                    end = html.index(quote, at + 1)
                    value, at = html[at + 1 : end], end + 1
                else:
                    bare = _BARE.match(html, at)
                    value, at = bare[0], bare.end()
            given.setdefault(key, value)
        end = html.find(">", at)
        at = size if end < 0 else end + 1
        if closing:
            yield ">", word, {}
            continue
        yield "<", word, given
        if word in RAW:
            end = _RAW_END[word].search(html, at)
            at = end.start() if end else size


def named(attributes: dict[str, str]) -> int:
    """What the class and id say of a container."""
    told = FREE
    label = attributes.get("aria-label", "").lower().split()
    for token in [*f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split(), "-".join(label) if len(label) < 3 else ""]:
        parts = [w for w in _PARTS.split(token) if len(w) > 1]
        if not parts or parts[0] in LAYOUT:
            continue
        head = parts[-1] if parts[-1] in SIDE or parts[-1] in UNSURE else None
        if head is None and (parts[0] in SIDE or parts[0] in UNSURE) and all(w in NEUTRAL or w in SIDE or w in UNSURE for w in parts[1:]):
            head = parts[0]
        if head in SIDE or head in UNSURE and any(w in SIDE for w in parts):
            if head not in WORDS:
                return SIDE_PART
            told = TOLD
            continue
        if head in UNSURE and not GOOD & {*parts} and told == FREE:
            told = PERHAPS
    return told


class Open:
    """An open element, with what holds for all that is in it."""

    __slots__ = ("tag", "container", "own", "dropped", "header", "block", "article")

    def __init__(self, tag: str, over: Open | None):
        self.tag, self.own = tag, False
        self.container, self.dropped, self.header, self.block, self.article = (over.container, over.dropped, over.header, over.block, over.article) if over else (-1, False, False, "", False)


class Page:
    """Blocks of text that may belong to an article, and the containers over them."""

    def __init__(self, html: str, strict: bool = True):
        self.blocks: list[tuple[str, int, str]] = []  # text, characters within links, tag
        self.containers: list[list] = []  # path, first block, last block, tag, parent, weight, kind, in an article
        self.articles: list[int] = []  # the article around each container, or -1
        self.strict, self.pieces, self.links = strict, [], 0
        self.stack = [Open("", None)]
        # Places on the stack of the open elements of each name, and of the open blocks; nothing walks the stack.
        self.at: defaultdict[str, list[int]] = defaultdict(list)
        self.open_blocks: list[int] = []
        self._start("html", {})
        for kind, value, attributes in tokens(html):
            if kind == "<":
                self._start(value, attributes)
            elif kind == ">":
                self._end(value)
            else:
                self._text(value)
        self._flush()
        self._pop_to(1)
        self._leave_out()

    def _text(self, raw: str) -> None:
        top = self.stack[-1]
        if top.dropped or top.header and top.block not in HEADINGS and not (top.block == "p" and top.article):
            return
        text = unescape(raw) if "&" in raw else raw
        self.pieces.append(text)
        if self.at["a"]:
            self.links += len(text.strip())

    def _flush(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            # Of an article's own header, headings and a standfirst are text; bylines and dates are short.
            if text and not (self.stack[-1].header and self.stack[-1].block == "p" and (len(text) < STANDFIRST or self.links * 2 > len(text))):
                self.blocks.append((text, min(self.links, len(text)), self.stack[-1].block))
            self.pieces, self.links = [], 0

    def _start(self, name: str, given: dict[str, str]) -> None:
        if name in ("html", "body") and self.at[name]:
            return
        if name in BLOCKS:
            self._flush()
        self._close_implied(name)
        if name in SPACES:
            self.pieces.append(" ")
        if name in VOID:
            return
        here = Open(name, self.stack[-1])
        if name in BLOCKS:
            here.block = name
        here.article |= name in ("article", "main")
        kind = FREE
        if not here.dropped:
            inline = name == "button" and here.block == "p"
            here.dropped = name in SKIPPED or self.strict and not inline and self._unwanted(name, given)
            if self.strict and name in CONTAINERS and name not in WHOLE:
                kind = FORM if name in ("form", "fieldset") or name == "header" and not here.article else named(given)
            if self.strict and (name == "header" and here.article or name not in WHOLE and _TITLED.search(given.get("class", ""))):
                here.header, kind = True, FREE
        if name in CONTAINERS and not here.dropped:
            parent = here.container
            classes = sorted({w for w in _PARTS.split(given.get("class", "").lower()) if w})
            path = ".".join([name, *classes])
            path = f"{self.containers[parent][0]}>{path}" if parent >= 0 else path
            if len(path) > PATH_CHARS:
                path = "#" + hashlib.md5(path.encode()).hexdigest()
            here.container, here.own = len(self.containers), True
            self.articles.append(here.container if name == "article" else self.articles[parent] if parent >= 0 else -1)
            self.containers.append([path, len(self.blocks), None, name, parent, self._weight(name, classes), kind, self.stack[-1].article])
        self.at[name].append(len(self.stack))
        if name in BLOCKS:
            self.open_blocks.append(len(self.stack))
        self.stack.append(here)

    @staticmethod
    def _unwanted(name: str, given: dict[str, str]) -> bool:
        if name in ASIDE:
            return True
        if name in WHOLE or name in HEADINGS:
            return False
        if name != "article" and given.get("role", "").lower() in ROLES:
            return True
        return "hidden" in given and given["hidden"].lower() != "until-found" or given.get("aria-hidden", "").lower() == "true" or bool(_HIDES.search(given.get("style", "")))

    @staticmethod
    def _weight(name: str, classes: list[str]) -> float:
        if name in SIDES:
            return 0.0
        return (2.0 if name in ("article", "main") else 0.3 if name in ("html", "body") else 1.0) * (1.5 if GOOD & {*classes} else 1.0)

    def _close_implied(self, name: str) -> None:
        """A block ends an open paragraph, a heading an open heading, an item an open item, a row an open row."""
        ends = CLOSES.get(name, ())
        block = self.open_blocks[-1] if self.open_blocks else -1
        tag = self.stack[block].tag if block >= 0 else ""
        # Of what may end: the innermost within the innermost block, else that block itself.
        inner = max((self.at[t][-1] for t in ends if self.at[t]), default=-1)
        if inner > block:
            i = inner
        elif block > 0 and (name in BLOCKS and tag == "p" or tag in HEADINGS and name in HEADINGS or tag in ends):
            i = block
        else:
            return
        self._flush()
        self._pop_to(i)

    def _pop_to(self, i: int) -> None:
        for entry in reversed(self.stack[i:]):
            if entry.tag:
                self.at[entry.tag].pop()
            if entry.own:
                self.containers[entry.container][2] = len(self.blocks)
        del self.stack[i:]
        while self.open_blocks and self.open_blocks[-1] >= i:
            self.open_blocks.pop()

    def _end(self, name: str) -> None:
        if name in BLOCKS:
            self._flush()
        elif name in ("td", "th"):
            self.pieces.append(" ")
        if not self.at[name] or name in ("html", "body"):
            return
        i = self.at[name][-1]
        # An inline end tag behind a block that is still open doesn't close that block.
        if name in BLOCKS or name in ("td", "th") or not (self.open_blocks and self.open_blocks[-1] > i):
            self._pop_to(i)
        else:
            self.at[name].pop()
            self.stack[i].tag = ""

    def _leave_out(self) -> None:
        """Marks the blocks of side parts; the rest is kept."""
        self.kept = [True] * len(self.blocks)
        self.under: dict[int, list[int]] = {}
        self.running: dict[int, list[int]] = {}
        for c, (_, _, _, _, parent, *_) in enumerate(self.containers):
            self.under.setdefault(parent, []).append(c)
        running = [0, *accumulate(max(0, len(t) - links) for t, links, _ in self.blocks)]
        whole = [0, *accumulate(len(t) for t, *_ in self.blocks)]
        prose = [0, *accumulate(len(t) if tag == "p" and len(t) >= STANDFIRST else 0 for t, _, tag in self.blocks)]
        has_article = any(c[3] in ("article", "main") for c in self.containers)
        done = 0
        for _, first, last, _, _, _, kind, inside in self.containers:
            if kind == FREE or last <= done or first == last:
                continue
            own, all_chars = running[last] - running[first], whole[last] - whole[first]
            if own > (1 - LITTLE if kind in (SIDE_PART, TOLD) else MOST) * running[-1]:
                continue
            small = own <= LITTLE * running[-1]
            # Within an article a name alone says little: paragraphs without many links stay.
            if kind == TOLD and inside and prose[last] > prose[first] and own >= (1 - SIBLING_LINKS) * all_chars:
                continue
            if kind != PERHAPS or own < 0.7 * all_chars or has_article and not inside or small:
                self.kept[first:last] = [False] * (last - first)
                done = last
        self.chars = [0, *accumulate(len(t) if k else 0 for (t, *_), k in zip(self.blocks, self.kept, strict=True))]
        self.linked = [0, *accumulate(links if k else 0 for (_, links, _), k in zip(self.blocks, self.kept, strict=True))]

    def scores(self) -> list[float]:
        """Running text under each container: all of a block for its own, half for the one above."""
        total = [0.0] * len(self.containers)
        under: list[int] = []
        k = 0
        for b, (text, links, _) in enumerate(self.blocks):
            while k < len(self.containers) and self.containers[k][1] <= b:
                if self.containers[k][2] > b:
                    while under and self.containers[under[-1]][2] <= b:
                        under.pop()
                    if self.containers[k][3] not in SIDES:
                        under.append(k)
                k += 1
            while under and self.containers[under[-1]][2] <= b:
                under.pop()
            if self.kept[b] and under:
                value = max(0, len(text) - 2 * links)
                total[under[-1]] += value
                if len(under) > 1:
                    total[under[-2]] += value / 2
        return [t * c[5] for t, c in zip(total, self.containers, strict=True)]

    def raised(self, container: int) -> int:
        """The article around a container, if there is one, else the container."""
        return self.articles[container] if self.articles[container] >= 0 else container

    def beside(self, scores: list[float], parent: int) -> list[int]:
        """Containers under one parent that have running text and few links."""
        if parent not in self.running:
            self.running[parent] = [c for c in self.under[parent] if scores[c] > 0 and self.links_of(c) < SIBLING_LINKS]
        return self.running[parent]

    def title(self, container: int) -> list[str]:
        """Headings right before a container: they stand over it."""
        first = last = self.containers[container][1]
        while first and self.kept[first - 1] and self.blocks[first - 1][2] in HEADINGS:
            first -= 1
        return [b[0] for b in self.blocks[first:last]]

    def size(self, container: int) -> int:
        _, first, last, *_ = self.containers[container]
        return self.chars[last] - self.chars[first]

    def links_of(self, container: int) -> float:
        """The share of a container's text that is links."""
        _, first, last, *_ = self.containers[container]
        return (self.linked[last] - self.linked[first]) / max(1, self.size(container))

    def texts(self, containers: list[int]) -> list[str]:
        """Kept blocks of the containers, each once, in page order."""
        return [self.blocks[b][0] for b in sorted({b for c in containers for b in range(self.containers[c][1], self.containers[c][2]) if self.kept[b]})]


def parsed(html: str) -> Page:
    """The page without side parts; if nothing is left, with all but scripts and the like."""
    page = Page(html)
    return page if any(page.kept) else Page(html, strict=False)


def siblings(page: Page, scores: list[float], best: int) -> list[int]:
    """The container and those beside it that go on with its text: enough of it, and few links."""
    tag, parent = page.containers[best][3:5]
    if tag in ("article", "main", "body", "html"):
        return [best]
    path, least = page.containers[best][0], SIBLING_SHARE * scores[best]
    beside = (c for c in page.beside(scores, parent) if scores[c] >= least or page.containers[c][0] == path)
    return sorted({best, *beside})


def votes(html: str) -> list[tuple[str, int]]:
    """Paths of the containers near the best, with those of their siblings, and their share of the best score in thousandths."""
    page = parsed(html)
    scores = page.scores()
    best = max(scores, default=0.0)
    shares: dict[str, int] = {}
    done: set[int] = set()  # parents whose children have been looked at
    for c, score in enumerate(scores):
        top = page.raised(c)
        if score > 0 and score >= NEAR * best and page.containers[top][4] not in done:
            chosen = siblings(page, scores, top)
            done.add(page.containers[top][4])
            path = AND.join(sorted({page.containers[x][0] for x in chosen}))
            shares[path] = max(shares.get(path, 0), round(1000 * score / best))
    return list(shares.items())


def main_text(html: str, path: str | None) -> str:
    """The text of the containers on ``path`` under one parent, or of the page's own best and its siblings."""
    page = parsed(html)
    scores = page.scores()
    if not scores:
        return ""
    best = page.raised(max(range(len(scores)), key=lambda c: (scores[c], -c)))
    wanted = set(path.split(AND)) if path else set()
    there = [c for c in range(len(scores)) if page.containers[c][0] in wanted]
    chosen = siblings(page, scores, best)
    if there:
        first = max(there, key=lambda c: (scores[c], page.size(c), -c))
        if page.size(first) >= LEAST_SHARE * page.size(best):
            tag, parent = page.containers[first][3:5]
            chosen = [first] if tag in ("article", "main", "body", "html") else [c for c in there if page.containers[c][4] == parent and scores[c] > 0] or [first]
    return "\n".join([*page.title(min(chosen)), *page.texts(chosen)])


def host_of(url):
    """Lower-case host of a url column; empty for null or what has none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def host_paths(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, path): each host's winning path over all its pages, ties by the later path."""

    def ballots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(h, p, n) for h, html in zip(*(c.to_pylist() for c in batch.columns), strict=True) for p, n in votes(html)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], ["host", "path", "n"])

    rows = pages.select(host_of(F.col(url)).alias("host"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    summed = rows.mapInArrow(ballots, "host string, path string, n bigint").groupBy("host", "path").agg(F.sum("n").alias("n"))
    return summed.groupBy("host").agg(F.max(F.struct("n", "path")).getField("path").alias("path"))


def extract(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per page: page_id, url, text and n_chars.

    Null or empty pages have an empty text; repeated rows stay; pages of any length are read whole, in
    time proportional to it. Of containers or paths that tie, the earlier container and the later path
    are taken. An empty table gives no rows. Other columns of ``pages`` are not read, whatever their names.
    """
    small_batches(pages.sparkSession)
    paths = cut(host_paths(pages, url, html))
    if paths.count() <= BROADCAST_HOSTS:
        paths = F.broadcast(paths)
    rows = pages.select(F.col(page).alias("page_id"), F.col(url).alias("url"), F.col(html).cast("string").alias("html"), host_of(F.col(url)).alias("host")).join(paths, "host", "left")
    # Page and path travel in one column, so that one function sees both.
    both = F.concat(F.coalesce("path", F.lit("")), F.lit("\n"), F.coalesce("html", F.lit("")))
    read = column_function(lambda: lambda values: [main_text(h, p) for p, _, h in (v.decode().partition("\n") for v in values)], "string")
    out = rows.select("page_id", "url", read(both).alias("text"))
    return out.select(F.col("page_id").alias(page), F.col("url").alias(url), "text", F.length("text").cast("bigint").alias("n_chars"))
