"""Operator 10: main text of web pages by site template removal.

Every container element's subtree (tag, text, children) is hashed. Spark counts, per host, the distinct articles
beside which a subtree stands; one that recurs beside many is template and goes with everything inside it. Counting
distinct articles, not pages, keeps copies of one article at several addresses from looking like template. Inside
``article`` and ``main`` only containers can be template: paragraphs and headings are prose, even when they recur.

Boilerplate that does not recur is known by its element, role or class (menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles, reader comments). Classes and ids count as whole tokens, and never against an element
that holds the article, main or most of the page's text. What remains of the articles (or of ``main``, or of the body when
a page has neither) is the text: references decoded, white space in a block made one space, blocks joined by a blank
line in page order.

Counts are pre-aggregated; a subtree on a third of all pages is one row per map task and article. Pages are joined
with template hashes by (host, hash), which adaptive execution splits where a host is hot.

Edge cases: null and empty html give an empty text; a null url is the host ""; unclosed, stray and truncated tags are
read as browsers do, in one pass whatever the nesting; null or repeated page_ids keep a result row each; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from styloscope.llm.common import materialise, prepare, stream

#: A subtree is template when it stands beside at least this many distinct articles of its host ...
MIN_ARTICLES = 5
#: ... and beside at least this share of them, or this many whatever the host's size.
MIN_SHARE = 0.05
ENOUGH_ARTICLES = 50

# HTML elements by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby "
                   "s samp small span strike strong sub sup time tt u var".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dt dd td th tr tbody thead tfoot caption figcaption".split())
DROPPED = frozenset("head script style noscript template nav footer aside form iframe svg math button select textarea "
                    "object canvas dialog menu title audio video map datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form "
                  "toolbar".split())
CLASSES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie "
                    "cookies consent gdpr notice notices popup modal newsletter subscribe subscription paywall sidebar "
                    "menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments disqus reply "
                    "replies share sharing social related recommended widget toolbar pagination pager login signup "
                    "skip".split())
#: Of these, what marks reader comments (also on an article element), and what may stand on a part of an article.
COMMENTS = frozenset("comment comments disqus reply replies".split())
ASIDES = frozenset("notice notices".split())
#: Elements that a start tag of the key closes when they are open in the same container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"},
          "tfoot": {"tr", "td", "th", "tbody"}}
#: Elements that stop the search for an open paragraph, list item or cell.
SCOPES = frozenset("html body article main section div nav aside header footer form table ul ol dl td th blockquote "
                   "button object figure".split())

_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)
    |<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']+|"[^"]*"|'[^']*'|["'])*)(?:>|\Z)""", re.S | re.X)
#: A whole attribute: its name up to = or white space, and its value if any; names are compared exactly.
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


def is_boilerplate(tag: str, attrs: str, inside_article: bool) -> bool:
    """Whether the element's tag, role or hiding alone tells that it is not article text."""
    if tag in DROPPED or tag == "header" and not inside_article:
        return True
    if not attrs or tag in ("html", "body", "article", "main"):
        return False
    for name, *values in _ATTR.findall(attrs):
        value, name = "".join(values).lower(), name.lower()
        if name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
    return False


def boilerplate_classes(tag: str, attrs: str, inside_article: bool) -> frozenset[str]:
    """The element's classes and id, as whole tokens, that speak against article text."""
    if not attrs or tag in ("html", "body", "main") or inside_article and tag in PROSE:
        return frozenset()
    names = {token for name, *values in _ATTR.findall(attrs) if name.lower() in ("class", "id")
             for token in "".join(values).lower().split()}
    return (COMMENTS if tag == "article" else CLASSES - ASIDES if inside_article else CLASSES) & names


class Element:
    """An open element; ``inner`` is the nearest container and ``doubt`` the nearest doubted element at or around it."""

    __slots__ = ("tag", "drop", "scope", "node", "inner", "doubt", "parts")

    def __init__(self, tag: str, drop: bool, scope: str, node: int, inner: int, doubt: int):
        self.tag, self.drop, self.scope, self.node, self.inner, self.doubt = tag, drop, scope, node, inner, doubt
        self.parts: list[str] = []


class Page:
    """One pass over a page: hashes of container subtrees, and text blocks with the containers around them.

    Containers are numbered as they open, so those inside container k are k + 1 .. ends[k] - 1, and a block needs only the
    nearest one; elements whose class speaks against them know the nearest such element around them. Both keep memory
    linear in the page, whatever its depth.
    """

    def __init__(self, html: str):
        self.hashes: list[int] = []
        self.ends: list[int] = []
        self.blocks: list[tuple[str, str, int, int]] = []  # scope, text, nearest container, nearest doubted element
        # per element with such a class: the one around it, [reader comments here or around, holds article or main]
        self.around: list[int] = []
        self.doubted: list[list[bool]] = []
        self._run: list[str] = []
        self._open = [Element("", False, "", -1, -1, -1)]
        at, size = 0, len(html)
        while at < size:
            found = _MARKUP.search(html, at)
            self._text(html[at:found.start() if found else size])
            if not found:
                break
            at = found.end()
            if tag := found["tag"]:
                tag = tag.lower()
                if found["end"]:
                    self._end(tag)
                else:
                    self._start(tag, found["attrs"])
                    if tag in RAW:
                        close = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(html, at)
                        self._open[-1].parts.append(html[at:close.start() if close else size])
                        at = close.end() if close else size
                        self._end(tag)
        while len(self._open) > 1:
            self._pop()
        self._flush()

    def _text(self, raw: str) -> None:
        if raw:
            top = self._open[-1]
            top.parts.append(raw)
            if not top.drop:
                self._run.append(raw)

    def _flush(self) -> None:
        if self._run:
            text = " ".join(unescape("".join(self._run)).split())
            self._run.clear()
            if text:
                top = self._open[-1]
                self.blocks.append((top.scope, text, top.inner, top.doubt))

    def _start(self, tag: str, attrs: str) -> None:
        if tag == "br" or tag in VOID:
            self._open[-1].parts.append(f"<{tag}>")
            if tag == "hr":
                self._flush()
            elif not self._open[-1].drop and tag == "br":
                self._run.append(" ")
            return
        inline = tag in INLINE
        if not inline:
            self._flush()
            self._close_implied(tag)
        top = self._open[-1]
        scope = tag if tag in ("article", "main") and top.scope != "article" else top.scope
        counted = not inline and tag not in ("html", "head", "body", "article", "main") and tag not in RAW and not (
            tag in PROSE and top.scope)
        node = len(self.hashes) if counted else -1
        if counted:
            self.hashes.append(0)
            self.ends.append(0)
        drop = top.drop or is_boilerplate(tag, attrs, top.scope == "article")
        doubt = top.doubt
        if not drop:
            found = boilerplate_classes(tag, attrs, top.scope == "article")
            if found and inline:
                drop = True
            elif found:
                self.around.append(doubt)
                comments = not COMMENTS.isdisjoint(found) or doubt >= 0 and self.doubted[doubt][0]
                doubt = len(self.doubted)
                self.doubted.append([comments, False])
            elif tag in ("article", "main") and doubt >= 0:
                self.doubted[doubt][1] = True
        self._open.append(Element(tag, drop, scope, node, node if counted else top.inner, doubt))

    def _close_implied(self, tag: str) -> None:
        """Close an open paragraph, and what else ``tag`` ends, up to the nearest container."""
        closes = CLOSES.get(tag, ())
        found = 0
        for k in range(len(self._open) - 1, 0, -1):
            name = self._open[k].tag
            if name == "p" or name in closes:
                found = k
            elif name in SCOPES:
                break
        while found and len(self._open) > found:
            self._pop()

    def _end(self, tag: str) -> None:
        inline = tag in INLINE
        for k in range(len(self._open) - 1, 0, -1):
            name = self._open[k].tag
            if name == tag:
                if not inline:
                    self._flush()
                while len(self._open) > k:
                    self._pop()
                return
            if (inline or tag == "p") and name in SCOPES or inline and name not in INLINE:
                return

    def _pop(self) -> None:
        element = self._open[-1]
        if element.tag not in INLINE:
            self._flush()
        self._open.pop()
        digest = xxhash.xxh3_64_intdigest("\0".join((element.tag, *element.parts)))
        if element.node >= 0:
            self.hashes[element.node] = digest - (1 << 63)
            self.ends[element.node] = len(self.hashes)
        self._open[-1].parts.append(f"\1{digest:x}")

    def content(self) -> list[tuple[str, int]]:
        """Blocks of the articles, else of main, else of the whole page, with their nearest container (-1: none).

        An element goes for its class unless it holds most of the page's text, or the article or main when none
        stands elsewhere; reader comments always go.
        """
        sizes, total, elsewhere = [0] * len(self.doubted), 0, False
        for scope, text, _, doubt in self.blocks:
            if doubt < 0 or not self.doubted[doubt][0]:
                total += len(text)
                if doubt >= 0:
                    sizes[doubt] += len(text)
            elsewhere |= bool(scope) and doubt < 0
        for k in range(len(self.doubted) - 1, -1, -1):  # what an element holds, those around it hold too
            if (outer := self.around[k]) >= 0:
                sizes[outer] += sizes[k]
                self.doubted[outer][1] |= self.doubted[k][1]
        gone: list[bool] = []
        for k, (comments, holds) in enumerate(self.doubted):
            outer = self.around[k]
            gone.append(comments or not (2 * sizes[k] > total or holds and not elsewhere) or outer >= 0 and gone[outer])
        blocks = [block for block in self.blocks if block[3] < 0 or not gone[block[3]]]
        scopes = {block[0] for block in blocks}
        wanted = next((s for s in ("article", "main") if s in scopes), "")
        return [(text, inner) for scope, text, inner, _ in blocks if scope == wanted]


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def keyed(pages: DataFrame) -> DataFrame:
    """page_id, url, key, host, html; equal rows share a key and, being equal, a result."""
    return pages.select("page_id", "url", F.xxhash64("page_id", "url", "html").alias("key"), host_of(F.col("url"))
                        .alias("host"), F.coalesce("html", F.lit("")).alias("html"))


def subtrees(pages: DataFrame) -> DataFrame:
    """key, host, article (hash of the content), hashes and ends of the containers of every page, written once."""
    def parse(batches) -> Iterator[tuple]:
        for keys, hosts, htmls in batches:
            for key, host, html in zip(keys, hosts, htmls):
                page = Page(html)
                article = xxhash.xxh3_64_intdigest("\n".join(text for text, _ in page.content())) - (1 << 63)
                yield key, host, article, page.hashes, page.ends

    return materialise(stream(keyed(pages).select("key", "host", "html"),
                              "key long, host string, article long, hashes array<long>, ends array<int>", parse),
                       "html-subtrees")


def contents(pages: DataFrame) -> DataFrame:
    """page_id, url, key and the blocks of every page; parsed again, as storing the texts takes more disk than it saves."""
    def parse(batches) -> Iterator[tuple]:
        for page_ids, urls, keys, htmls in batches:
            for page_id, url, key, html in zip(page_ids, urls, keys, htmls):
                yield page_id, url, key, Page(html).content()

    return stream(keyed(pages).select("page_id", "url", "key", "html"), "page_id long, url string, key long, "
                  "blocks array<struct<text:string,inner:int>>", parse, per_batch=512)


def templates(pages: DataFrame, min_articles: int = MIN_ARTICLES, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, hash) of the subtrees that recur beside many distinct articles of their host; ``pages`` as ``subtrees``."""
    none = F.array(F.lit(None).cast("long"))  # counts the host's articles
    found = pages.select("host", "article", F.explode(F.concat(none, F.array_distinct("hashes"))).alias("hash"))
    counts = (found.groupBy("host", "hash", "article").agg(F.lit(1).alias("one"))
              .groupBy("host", "hash").agg(F.count("one").alias("n")))
    totals = counts.filter("hash is null").select("host", F.col("n").alias("articles"))
    return (counts.filter((F.col("n") >= min_articles) & F.col("hash").isNotNull()).join(totals, "host")
            .filter(F.col("n") >= F.least(min_share * F.col("articles"), F.lit(float(max(min_articles, ENOUGH_ARTICLES)))))
            .select("host", "hash"))


def main_text(pages: DataFrame, min_articles: int = MIN_ARTICLES, min_share: float = MIN_SHARE) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html)."""
    prepare(pages.sparkSession)
    read = subtrees(pages)
    gone = (read.select("key", "host", F.posexplode(F.arrays_zip("hashes", "ends")).alias("start", "x"))
            .select("key", "host", F.col("x.hashes").alias("hash"), "start", F.col("x.ends").alias("end"))
            .join(templates(read, min_articles, min_share), ["host", "hash"])
            .groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("gone")))
    cut = F.coalesce("gone", F.array().cast("array<struct<start:int,end:int>>"))
    kept = F.filter("blocks", lambda block: ~F.exists(
        F.col("cut"), lambda c: (c["start"] <= block["inner"]) & (block["inner"] < c["end"])))
    text = F.array_join(F.transform(kept, lambda block: block["text"]), "\n\n")
    return (contents(pages).join(gone, "key", "left").withColumn("cut", cut)
            .select("page_id", "url", text.alias("text"))
            .withColumn("n_chars", F.char_length("text").cast("long")))
