"""Main text of web pages by consensus paths of their hosts.

Each page is read into blocks of text and the containers that hold them. A container is named by its path: tags and
class names from the body down, with numbers and names that look generated made equal. It scores the characters of its
blocks that are not links, less with each level between them, more for the tags and names that articles use. Every page votes for
its paths; Spark sums the votes by host. A host's winning paths are the one with the most points and those that were the
first choice of one page in ``FIRST_SHARE`` or more. Every page is then read again: the first winning path that it has gives its
text; a page that has none of them, or no host, takes its own best path.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are left out by tag, role, hidden
state and class name, and so are lists of links only; in the header of an article its headings stay. Where names alone
would leave a page without any text, only tags, roles and hidden states count.

Votes are summed before they are shuffled. Pages of the hosts that hold more than one page in ``HEAVY`` meet their winning paths
by a broadcast of at most ``HEAVY`` rows with ``FIRST_SHARE`` + 1 numbers each; all other pages are joined by host, none of which is
large then.

Defined results
* null, empty html, or one without text: empty text, 0 characters.
* null url, or one without a host (or with a name of over 255 characters): the page's own best path.
* very long pages are read whole. Repeated rows vote, and are answered, once for each row. Equal points: the smaller path.
* an empty table gives an empty result.
* other columns are ignored by ``main_text``, ``with_main_text`` returns them untouched.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .shared import free_name, release, staged

HEAVY = 256
FIRST_SHARE = 20
#: What a level between a container and a block leaves of the block's worth.
LEVEL = 0.7

# A comment; a declaration; a tag with quoted values, or as it is where quotes don't close.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW = {name: re.compile(rf"</{name}\b", re.I) for name in ("script", "style", "title", "textarea", "noscript", "iframe", "template", "xmp", "noframes")}
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_GENERATED = re.compile(r"[a-z]*\d[a-z\d]*")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Marks inside a line of text. Those in PLAIN are not followed at all.
PLAIN = frozenset("abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small strike strong sub sup time tt u var wbr img picture source map area label".split())
INLINE = PLAIN | {"a", "span"}
CONTAINERS = frozenset("body main article section div td center".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEFT_OUT = frozenset("nav footer aside form button select object canvas dialog menu svg audio video fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Parts of class names and ids.
LEFT_OUT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adsbygoogle adslot adbox adunit sponsor sponsored promo promotion promotions banner banners "
    "sidebar sidebars aside nav navbar navigation navi menu menus submenu breadcrumb breadcrumbs footer masthead topbar toolbar cookie cookies consent gdpr notice notices "
    "notification notifications alert popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended recommendations "
    "comment comments commentlist disqus respond reply replies pagination pager widget widgets hidden copyright".split()
)
ARTICLE_NAMES = frozenset("article post entry content story text main".split())
#: A class name with one of these speaks of the page's state, not of the element.
STATE_NAMES = frozenset("has no with without is layout open closed".split())
#: Opening the first ends an open one of the second, unless one of the third lies between.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"})}

#: How a part of the page is left out: not at all, but for headings, by its name, by its tag.
KEPT, TITLES, NAMED, TAGGED = range(4)


@lru_cache(maxsize=50_000)
def _judged(tag: str, raw: str) -> tuple[str, int, float, bool]:
    """Of a tag with its attributes: the step of a path, how it is left out, the weight as a container, whether it is the article."""
    found = {}
    for name, *values in _ATTRIBUTE.findall(raw):
        found.setdefault(name.lower(), unescape(values[0] or values[1] or values[2]))
    classes = found.get("class", "").split()
    step = ".".join([tag, *sorted({_GENERATED.sub("#", c.lower()) for c in classes})])
    role, style = found.get("role", "").lower(), found.get("style", "").replace(" ", "").lower()
    part = tag in ("article", "main") or role in ("main", "article") or found.get("itemprop", "").lower() == "articlebody"
    names = [{p.lower() for p in _NAME_PARTS.findall(c)} for c in [*classes, found.get("id", "")]]
    how = KEPT
    if tag in LEFT_OUT or role in ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style:
        how = TAGGED
    elif tag == "header" or any("header" in n for n in names) and tag not in ("body", "main", "article"):
        how = TITLES
    elif tag not in ("body", "main") and any(n & LEFT_OUT_NAMES and not n & STATE_NAMES for n in names):
        how = NAMED
    weight = 1.3 if part else 0.9 if tag == "body" else 1.15 if any(n & ARTICLE_NAMES for n in names) else 1.0
    return step, how, weight, part


class Page:
    """Blocks of text in page order and the containers around them."""

    def __init__(self, html: str):
        #: of each container: the one around it, its path, its weight
        self.parents, self.paths, self.weights = [-1], ["body"], [0.9]
        #: of each block: text, characters in links, container, how it is left out, list
        self.blocks: list[tuple[str, int, int, int, int]] = []
        self._text: list[str] = []
        self._links = self._lists = 0
        # tag, container, how left out, inside an article, inside a link, list, heading
        self._open = [("body", 0, KEPT, False, False, 0, False)]
        self._read(html)
        self._drop_menus()

    def _read(self, html: str) -> None:
        at, end = 0, len(html)
        while at < end:
            found = _TOKEN.search(html, at)
            stop = found.start() if found else end
            if stop > at:
                self._add(html[at:stop])
            if not found:
                break
            at = found.end()
            tag = (found[2] or found[5] or "").lower()
            if not tag:
                continue
            if found[1] or found[4]:
                self._close(tag)
            elif tag in _RAW:
                close = _RAW[tag].search(html, at)
                at = close.start() if close else end
            else:
                self._start(tag, found[3] if found[2] else found[6])
        self._flush()

    def _add(self, text: str) -> None:
        text = unescape(text) if "&" in text else text
        self._text.append(text)
        if self._open[-1][4]:
            self._links += sum(map(len, text.split()))

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                _, container, how, _, _, listed, heading = self._open[-1]
                self.blocks.append((text, self._links, container, KEPT if how == TITLES and heading else NAMED if how == TITLES else how, listed))
            self._text, self._links = [], 0

    def _pop_to(self, k: int) -> None:
        if any(x[0] not in INLINE for x in self._open[k:]) or any(x[2] != self._open[k - 1][2] for x in self._open[k:]):
            self._flush()
        del self._open[k:]

    def _close(self, tag: str) -> None:
        if tag in PLAIN or tag in VOID:
            return
        for k in range(len(self._open) - 1, 0, -1):
            if self._open[k][0] == tag:
                self._pop_to(k)
                return
            if tag in INLINE and self._open[k][0] not in INLINE:
                return  # a mark doesn't end the block around it
        if tag == "p":
            self._flush()

    def _start(self, tag: str, raw: str) -> None:
        if tag == "br":
            self._text.append(" ")
            return
        if tag in PLAIN:
            return
        if tag in ("html", "head"):
            return
        if tag not in INLINE:
            self._flush()
            self._end_open(tag)
        elif tag == "a":
            for k in range(len(self._open) - 1, 0, -1):
                if self._open[k][0] not in INLINE:
                    break
                if self._open[k][0] == "a":
                    self._pop_to(k)
                    break
        if tag in VOID:
            return
        _, container, how, inside, link, listed, heading = self._open[-1]
        step, own, weight, part = _judged(tag, raw)
        if tag == "body":
            if len(self.parents) == 1 and not self.blocks:
                self.paths[0] = step
            return
        if own == TITLES and not inside:
            own = NAMED
        if own > how and tag in INLINE:
            self._flush()
        how = max(how, own)
        if tag in CONTAINERS:
            self.parents.append(container)
            self.paths.append(f"{self.paths[container]}/{step}")
            self.weights.append(weight)
            container = len(self.parents) - 1
        if tag in ("ul", "ol"):
            self._lists += 1
            listed = self._lists
        self._open.append((tag, container, how, inside or part, link or tag == "a", listed, heading or tag in HEADINGS))

    def _end_open(self, tag: str) -> None:
        for k in range(len(self._open) - 1, 0, -1):
            if self._open[k][0] not in INLINE:
                if self._open[k][0] == "p" or tag in HEADINGS and self._open[k][0] in HEADINGS:
                    self._pop_to(k)
                break
        if tag in ENDS:
            ended, around = ENDS[tag]
            for k in range(len(self._open) - 1, 0, -1):
                if self._open[k][0] in around:
                    break
                if self._open[k][0] in ended:
                    self._pop_to(k)
                    break

    def _drop_menus(self) -> None:
        """Leaves out lists of three or more lines that are links only, and, if names don't leave out all, what they do."""
        lines, size, links = defaultdict(int), defaultdict(int), defaultdict(int)
        for text, linked, _, _, listed in self.blocks:
            lines[listed] += 1
            size[listed] += len(text) - text.count(" ")
            links[listed] += linked
        least = NAMED if any(b[3] == KEPT for b in self.blocks) else TAGGED
        self.kept = [b for b in self.blocks if b[3] < least and not (b[4] and lines[b[4]] >= 3 and links[b[4]] >= size[b[4]])]

    def scores(self) -> dict[str, float]:
        """The score of each path that has text."""
        worth: dict[int, float] = defaultdict(float)
        for text, linked, container, _, _ in self.kept:
            value = float(len(text) - text.count(" ") - linked)
            while container >= 0:
                worth[container] += value
                container, value = self.parents[container], value * LEVEL
        out: dict[str, float] = defaultdict(float)
        for container, value in worth.items():
            out[self.paths[container]] += value * self.weights[container]
        return out

    def best(self, scores: dict[str, float]) -> str:
        return min(scores, key=lambda path: (-scores[path], path))

    def text(self, path: str) -> str:
        """The blocks inside all containers with this path."""
        inside = [False] * len(self.paths)
        for k, (parent, own) in enumerate(zip(self.parents, self.paths, strict=True)):
            inside[k] = own == path or parent >= 0 and inside[parent]
        return " ".join(b[0] for b in self.kept if inside[b[2]])


@lru_cache(maxsize=50_000)
def path_key(path: str) -> int:
    """A number that stands for a path where it is looked up."""
    return int.from_bytes(blake2b(path.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


@pandas_udf(ArrayType(StructType([StructField("path", StringType()), StructField("points", LongType()), StructField("first", LongType())])))
def _votes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for pages in batches:
        out = []
        for html in pages:
            page = Page(html or "")
            scores = page.scores()
            best = page.best(scores) if scores else ""
            top = max(scores.get(best, 0.0), 1e-9)
            out.append([{"path": path, "points": int(1000 * score / top), "first": int(path == best)} for path, score in scores.items()])
        yield pd.Series(out, dtype=object)


@pandas_udf(StringType())
def _texts(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for pages, winners in batches:
        out = []
        for html, keys in zip(pages, winners, strict=True):
            page = Page(html or "")
            paths = {path_key(path): path for path in page.scores()} if keys is not None else {}
            chosen = next((paths[k] for k in (keys if keys is not None else ()) if k in paths), None)
            if chosen is None and (scores := page.scores()):
                chosen = page.best(scores)
            out.append(page.text(chosen) if chosen is not None else "")
        yield pd.Series(out, dtype=object)


@pandas_udf(LongType())
def _keys(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for paths in batches:
        yield pd.Series([path_key(p) for p in paths], dtype="int64")


def host_of(url: Column) -> Column:
    """The host of a URL in small letters, without user and port; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]+)", 1))
    return F.when((F.length(host) > 0) & (F.length(host) <= 255), host)


def host_paths(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Per host: ``host``, ``pages`` that voted, ``paths`` that win, the strongest first, and their ``keys``."""
    cast = pages.select(host_of(F.col(url)).alias("host"), _votes(F.col(html)).alias("v")).filter(F.col("host").isNotNull())
    cast = cast.select("host", F.explode("v").alias("v")).select("host", "v.*")
    sums = staged(cast.groupBy("host", "path").agg(F.sum("points").alias("points"), F.sum("first").alias("first")))
    rank = F.struct((-F.col("points")).alias("less"), "path")
    hosts = sums.groupBy("host").agg(F.sum("first").alias("pages"), F.min(rank).alias("best"))
    won = sums.join(hosts, "host").filter((F.col("first") * FIRST_SHARE >= F.col("pages")) | (F.col("path") == F.col("best.path")))
    won = won.select("host", "pages", rank.alias("r"), _keys(F.col("path")).alias("key"))
    listed = won.groupBy("host").agg(F.first("pages").alias("pages"), F.sort_array(F.collect_list(F.struct("r", "key"))).alias("w"))  # at most FIRST_SHARE + 1
    out = staged(listed.select("host", "pages", F.col("w.r.path").alias("paths"), F.col("w.key").alias("keys")))
    release(sums)
    return out


def with_main_text(pages: DataFrame, html: str = "html", url: str = "url", out: str = "text") -> DataFrame:
    """``pages`` and their main text as ``out``."""
    host, at, keys = (free_name(pages, n) for n in ("__host", "__at", "__keys"))
    winners = host_paths(pages, html, url)
    voted = winners.agg(F.sum("pages")).first()[0] or 0
    named = winners.select(F.col("host").alias(at), F.col("keys").alias(keys), "pages")
    large = F.col("pages") * HEAVY > voted
    heavy = F.broadcast(named.filter(large).drop("pages"))  # fewer than HEAVY hosts
    light = named.filter(~large).drop("pages")
    whole = pages.withColumn(host, host_of(F.col(url)))
    same = F.col(host) == F.col(at)
    both = whole.join(heavy, same).drop(at), whole.join(heavy, same, "left_anti").join(light, same, "left").drop(at)
    text = _texts(F.col(html), F.col(keys))
    return both[0].unionByName(both[1]).withColumn(out, text).select(*[c for c in pages.columns if c != out], out)


def main_text(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """page_id, url, text, n_chars of each page."""
    found = with_main_text(pages.select("page_id", F.col(url).alias("url"), F.col(html).alias("html")), out="text")
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
