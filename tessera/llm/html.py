"""Main text of web pages by composite text density.

Every node of the page's tree has its characters and tags, and those within links; its density is characters per tag,
lowered as links take a larger part. A node's density sum adds up its children's densities. The node with the largest sum
is the article; the smallest density on its path to the body is the threshold, and each node that reaches the threshold
adds the subtree with the largest sum below it. If the article stands in an article element, or else in a main element,
that element is taken whole, and beside an article element only other article elements are added (those of the same
parent also if they have a quarter of its text or more, not mostly links: the smaller are teasers), and subtrees of the box
with the largest sum, where that is below the body. Menus, page headers, footers, sidebars, notices, adverts, forms, scripts,
styles and reader comments are cut out before counting: by element, by role, and by words of class and id. In an article or
main element, and of headings, paragraphs and sections, one such word isn't enough unless it can hardly mean anything else
(ALWAYS); an id of several words on a heading or paragraph doesn't count, as it repeats what they say.

Defined cases: a null or empty page, or one without text outside these parts, gives an empty text. White space inside a
block becomes one space; blocks are joined in page order by one space. Outside article and main elements, and outside the
box that is chosen as the article (the body as a whole isn't), a list, table, div or section with over two links that make
over half its text is a menu and goes, but for a div or section with over half of the page's text. Nothing else is
dropped, whatever the length. Of nodes with equal sums the last in page order is chosen. Rows that repeat have a text each, an empty table has none, and
other columns stay as they are. Unclosed elements end where their parent ends; a truncated page is read as far as it goes.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import refuse

#: A comment, a tag with its attributes (quoted values may hold any sign; where quotes don't pair, up to the next sign), or a declaration.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>|<[!?/][^>]*+(?:>|\Z)", re.S)
#: What begins a tag or comment that the page's end cuts off; it's no text.
UNFINISHED = re.compile(r"<[a-zA-Z/!?]")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
#: Fixed values, elements of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
CUT = RAW | frozenset("head nav footer aside button select option datalist template svg canvas object audio video map dialog menu input annotation annotation-xml".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: An element that starts closes these, up to the boundary elements.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
BOUNDARY = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",), "tbody": ("table",), "tfoot": ("table",)}
ENDS_P = BLOCK - {"br", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "legend", "body", "html", "title"}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form tablist".split())
HINTS = frozenset("""ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion banner banners sidebar
sidenav sidebars aside rail nav navbar navigation menu menus submenu breadcrumb breadcrumbs toolbar footer footers masthead topbar cookie cookies consent gdpr
notice notices notification notifications alert alerts popup popover modal overlay newsletter subscribe subscription signup signin login search share sharing shares
side secondary sidepanel rightcol leftcol privacy announcement announcements toast snackbar interstitial legal imprint colophon
adbox adslot adunit adsbygoogle outbrain taboola leaderboard skyscraper responses feedback reviews guestbook talkback
social related recommended recommendations comment comments commentlist disqus discussion reply replies respond widget widgets pagination pager paywall disclaimer
copyright skiplink tags""".split())
KEEPS = frozenset("content article main body post entry story text".split())
ALWAYS = frozenset("ad ads advert adverts advertisement advertising sponsored comment comments disqus sidebar cookie consent newsletter".split())
CONTAINERS = frozenset("html body main article".split())
#: Elements whose id often is a slug of what they say.
SLUGS = frozenset("h1 h2 h3 h4 h5 h6 p section".split())
#: Elements that an article can be; inline elements and paragraphs raise their parents' sums only.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BOXES = frozenset("#root html body main article section div td center form blockquote details".split())


def attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): unescape((m[2] or "").strip("\"'")) for m in ATTRIBUTE.finditer(source)}


def boilerplate(tag: str, source: str, inside: bool) -> bool:
    """Whether an element is no part of an article. inside: it stands in an article or main element."""
    if tag in CUT:
        return True
    if tag == "header":
        return not inside
    if not source or source.isspace():
        return False
    own = attributes(source)
    if tag not in CONTAINERS and ("hidden" in own or own.get("aria-hidden") == "true" or own.get("role", "").lower() in ROLES or "display:none" in own.get("style", "").replace(" ", "").lower()):
        return True
    # where text of the article is likely, one word that may be its subject doesn't tell
    doubtful, found = inside or tag in SLUGS, set()
    for k, name in enumerate((own.get("id", ""), *own.get("class", "").split())):
        words = [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+|\d+", name)]
        slug = not k and tag in SLUGS - {"section"}
        for j, w in enumerate(words):
            if j and words[j - 1] in ("no", "has", "with", "without", "non"):
                continue
            if w in HINTS and tag in CONTAINERS:
                if len(words) == 1 and w in ALWAYS:
                    return True
            elif w in ALWAYS and not (slug and len(words) > 1):
                return True
            elif w in HINTS and not KEEPS & set(words):
                if not doubtful:
                    return True
                if not slug:
                    found.add(w)
            elif w == "header" and not doubtful and not KEEPS - {"main"} & set(words):
                return True
    return len(found) > 1


class Page:
    """The tree of a page. Nodes are numbered in page order; 0 is the root."""

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.cut = ["#root"], [-1], [False]
        self.inside = [False]
        #: (node, text) in page order; None for text is a block's edge.
        self.flow: list[tuple[int, str | None]] = []
        self.body = 0
        open_ = [0]
        #: How many elements of each kind are open.
        self.open = Counter()
        at, n, closed = 0, len(source), source.rfind(">")
        while at < n:
            m = TOKEN.search(source, at) if at <= closed else None
            if at > closed and (cut := UNFINISHED.search(source, at)):
                n = cut.start()
            if (end := m.start() if m else n) > at:
                self.flow.append((open_[-1], source[at:end]))
            if not m:
                break
            at = m.end()
            if not m[2]:
                if m[0].startswith("<!--") and not m[0].endswith("-->"):
                    break
                continue
            tag = m[2].lower()
            if m[1]:
                self._close(tag, open_)
                continue
            if tag == "body" and self.body:
                continue
            self._open(tag, m[3], open_)
            if tag in RAW:
                stop = re.compile(rf"</{tag}[\s/>]", re.I).search(source, at)
                at = stop.start() if stop else n
        self.flow.append((0, None))

    def _open(self, tag: str, source: str, open_: list[int]) -> None:
        if tag in ENDS_P:
            self._end("p", open_, ("table", "td", "th", "button", "#root"))
        for old in CLOSES.get(tag, ()):
            self._end(old, open_, BOUNDARY[tag])
        if tag in BLOCK:
            self.flow.append((open_[-1], None))
        up = open_[-1]
        self.tag.append(tag)
        self.parent.append(up)
        self.inside.append(self.inside[up] or tag in ("article", "main"))
        self.cut.append(self.cut[up] or boilerplate(tag, source, self.inside[up]))
        if tag == "body":
            self.body = len(self.tag) - 1
        if tag not in VOID and not source.endswith("/"):
            open_.append(len(self.tag) - 1)
            self.open[tag] += 1

    def _shut(self, k: int, open_: list[int]) -> None:
        self.open.subtract(self.tag[i] for i in open_[k:])
        del open_[k:]

    def _end(self, tag: str, open_: list[int], boundary: tuple[str, ...]) -> None:
        if not self.open[tag]:
            return
        for k in range(len(open_) - 1, 0, -1):
            if (own := self.tag[open_[k]]) == tag:
                self.flow.append((open_[k], None))
                self._shut(k, open_)
                return
            if own in boundary:
                return

    def _close(self, tag: str, open_: list[int]) -> None:
        if not self.open[tag]:
            return
        for k in range(len(open_) - 1, 0, -1):
            if self.tag[open_[k]] == tag:
                if tag in BLOCK:
                    self.flow.append((open_[k], None))
                self._shut(k, open_)
                return
            if tag not in BLOCK and self.tag[open_[k]] in BLOCK:
                return

    def counted(self) -> tuple[list[int], list[int], list[int], list[int]]:
        """Characters, tags, link characters and link tags of each node with all below it; cut parts count nothing."""
        n = len(self.tag)
        chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        link = [False] * n
        for i in range(1, n):
            link[i] = link[self.parent[i]] or self.tag[i] == "a"
        for i, text in self.flow:
            if text and not self.cut[i]:
                size = sum(map(len, text.split()))
                chars[i] += size
                if link[i]:
                    link_chars[i] += size
        for i in range(n - 1, 0, -1):
            if not self.cut[i]:
                up = self.parent[i]
                chars[up] += chars[i]
                link_chars[up] += link_chars[i]
                tags[up] += tags[i] + 1
                link_tags[up] += link_tags[i] + (self.tag[i] == "a")
        return chars, tags, link_chars, link_tags

    def sums(self) -> tuple[list[int], list[float], list[float]]:
        """Characters, density and density sum of each node; cut parts have none."""
        n, body = len(self.tag), self.body
        chars, tags, link_chars, link_tags = self.counted()
        share = link_chars[body] / max(1, chars[body])
        density, total = [0.0] * n, [0.0] * n
        for i in range(n):
            if chars[i] > 1 and not self.cut[i]:
                c, t, lc, lt = chars[i], max(1, tags[i]), max(1, link_chars[i]), max(1, link_tags[i])
                base = log(c / max(1, c - link_chars[i]) * link_chars[i] + share * c + e)
                density[i] = max(0.0, c / t * log(max(1.0, c / lc * t / lt)) / log(base + e - 1))
        for i in range(n - 1, 0, -1):
            total[self.parent[i]] += density[i]
        return chars, density, total

    def article(self) -> list[bool]:
        """Which nodes are the article's."""
        n = len(self.tag)
        last = list(range(n))  # of the nodes below each, which follow it
        for i in range(n - 1, 0, -1):
            last[self.parent[i]] = max(last[self.parent[i]], last[i])
        chars, tags, link_chars, link_tags = self.counted()
        menu = [False] * n
        for i in range(1, n):  # menus without a name: lists and boxes that are mostly several links
            if not self.cut[i]:
                links = self.tag[i] in ("ul", "ol", "div", "section", "table") and link_tags[i] > 2 and 2 * link_chars[i] > chars[i]
                most = self.tag[i] in ("div", "section") and 2 * chars[i] > chars[self.body]
                menu[i] = links and not most and not self.inside[i]
                menu[i] |= menu[self.parent[i]]
                self.cut[i] = self.cut[self.parent[i]] or menu[i]
            if self.tag[i] == "form" and not self.cut[i]:  # but for pages that stand in a form as a whole
                inner = sum(t in ("article", "main", "p") for t in self.tag[i + 1 : last[i] + 1])
                self.cut[i] = 2 * chars[i] <= chars[self.body] or inner < 2
        body = self.body
        chars, density, total = self.sums()
        best = list(range(n))
        rank = [x if t in BOXES else -1.0 for x, t in zip(total, self.tag, strict=True)]
        for i in range(n - 1, 0, -1):
            up = self.parent[i]
            if not self.cut[i] and rank[best[i]] > 0 and rank[best[i]] >= rank[best[up]]:
                best[up] = best[i]
        chosen = [False] * n
        if not chars[body]:
            return chosen
        at = box = best[body]
        up = at  # an article that is marked as one is taken whole, or else the main element
        while up > body:
            if self.tag[up] == "article" or self.tag[up] == "main" and self.tag[at] != "article":
                at = up
            up = self.parent[up]
        while (up := self.parent[at]) > body and self.tag[up] in BOXES:
            beside = [*range(up + 1, at), *range(last[at] + 1, last[up] + 1)]
            if chars[up] > chars[at] + sum(chars[i] for i in beside if self.tag[i] in HEADINGS and not self.cut[i]):
                break
            at = up  # what has headings only besides the article belongs to it
        if self.tag[at] != "article":  # or the one that holds most of it
            within = [i for i in range(at + 1, last[at] + 1) if self.tag[i] in ("article", "main") and not self.cut[i] and 2 * chars[i] > chars[at]]
            at = max(within, key=lambda i: (self.tag[i] == "article", chars[i]), default=at)
        chosen[at] = total[at] > 0
        taken = at
        for i in range(at + 1, last[at] + 1 if at > body else 0):  # what looked like menus is text of the article
            if menu[i]:
                self.cut[i] = self.cut[self.parent[i]]
        threshold = density[at]
        while at > body:
            threshold = min(threshold, density[at])
            at = self.parent[at]
        threshold = min(threshold, density[body])
        if total[best[body]] == 0:
            chosen[body] = True
        for i in range(body, n):
            if not self.cut[i] and density[i] >= threshold and rank[best[i]] > 0 and (self.tag[taken] != "article" or self.tag[best[i]] == "article" or body < box < best[i] <= last[box]):
                chosen[best[i]] = True
        beside = [i for i in range(body + 1, n) if self.tag[i] == self.tag[taken] == "article" and self.parent[i] == self.parent[taken] and not self.cut[i] and 4 * chars[i] >= chars[taken]]
        if len(beside) > 1:
            links = self.counted()[2]
            for i in beside:
                chosen[i] |= 2 * links[i] <= chars[i]
        for i in range(body + 1, n):
            chosen[i] = (chosen[i] or chosen[self.parent[i]]) and not self.cut[i]
        return chosen

    def text(self) -> str:
        chosen = self.article()
        blocks, run = [], []
        for i, text in self.flow:
            if text is None:
                if run:
                    blocks.append("".join(run))
                    run = []
            elif chosen[i]:
                run.append(unescape(text))
        return " ".join(" ".join([*blocks, "".join(run)]).split())


def main_text(source: str | None) -> str:
    return Page(source).text() if source else ""


def extracted(pages: DataFrame, name: str = "text") -> DataFrame:
    """pages with the article's text of column html. A column of the name given is an error."""
    from pyspark.sql.functions import arrow_udf

    refuse(pages, name)

    @arrow_udf("string")
    def made(sources: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in sources:
            yield pa.array([main_text(x.as_py()) for x in part], pa.string())

    return pages.withColumn(name, made(F.col("html")))
