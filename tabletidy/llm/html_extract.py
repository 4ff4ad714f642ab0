"""HTML extraction (operator 12): composite text density.

1. *Tree.* A page becomes the tree of its elements; end tags that HTML lets an author leave
   out are implied. Every step is linear in the page, whatever its nesting.
2. *Densities.* For every node the characters C and tags T of its subtree, and those that lie
   in links, LC and LT, give its composite text density
   ``C/T * log(C*T / (LC*LT)) / log(log(C*LC/(C-LC) + LCb/Cb*C + e))``: characters per tag,
   less the more of them are links (``b`` is the body; a count of none counts as one).
   A node's density sum is the sum over its children (its own density if it has none).
3. *Selection.* The node of the largest density sum holds the text. The least density on the path
   from there up to the body is the threshold: below the body, each node that reaches it
   gives the node of the largest density sum in its subtree, whole. Where the text lies in an
   ``article`` (or ``main``) element, nothing outside of it is taken, and an article is whole.

Elements that name themselves as something else than the article (``nav``, ``footer``, a class
``ad`` or ``comments``, ...) count in the densities around them and are never selected or returned.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from tabletidy.llm.common import map_rows

#: The kinds of elements in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary"
    " table tbody td tfoot th thead tr ul".split()
)
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
NO_TEXT = frozenset("head script style noscript template svg math iframe object canvas audio video map title".split())
#: Elements, roles and words of a class or id that say that a part isn't the article.
OTHER_TAGS = frozenset("nav footer aside form button select textarea dialog menu search".split())
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
OTHER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adslot adsense banner sponsor sponsored promo promotion outbrain taboola"
    " nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer sidebar aside widget widgets"
    " cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login paywall"
    " comment comments disqus respond replies share sharing social related recommended pagination pager toolbar skip".split()
)
#: Beside these words a class that says ``header`` or ``banner`` belongs to the article.
ARTICLE_WORDS = frozenset("article post entry story content".split())
HEAD = frozenset("head title meta link style script base noscript template".split())
NEVER_OTHER = frozenset("html body main".split())
#: What an element closes: (the open elements that end, the elements that keep them open).
SCOPE = ("table", "td", "th", "caption", "button", "object", "template")
CLOSES = {
    "li": (("li",), (*SCOPE, "ul", "ol", "menu")),
    "dt": (("dt", "dd"), (*SCOPE, "dl")),
    "dd": (("dt", "dd"), (*SCOPE, "dl")),
    "tr": (("tr", "caption"), ("table", "template")),
    "td": (("td", "th", "caption"), ("table", "tr", "template")),
    "th": (("td", "th", "caption"), ("table", "tr", "template")),
    "thead": (("thead", "tbody", "tfoot", "caption"), ("table", "template")),
    "tbody": (("thead", "tbody", "tfoot", "caption"), ("table", "template")),
    "tfoot": (("thead", "tbody", "tfoot", "caption"), ("table", "template")),
    "option": (("option",), ("select",)),
    "optgroup": (("option", "optgroup"), ("select",)),
    **{h: (HEADINGS, SCOPE) for h in HEADINGS},
}
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Elements whose content is no markup, with the end that each has.
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "iframe", "textarea", "title")}
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
ATTRIBUTE = re.compile(r"""[\s/]*+(?:(>)|([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|(?!["'])([^\s>]*+)))?+)""")
LONG_NUMBER = re.compile(r"&#(?:[0-9]{9,}|[xX][0-9a-fA-F]{9,});?")


def _number(found: re.Match) -> str:
    """A long number reference without its leading zeros; over nine digits it is no character."""
    digits = found[0].strip("&#;xX").lstrip("0") or "0"
    return f"&#{'x' if found[0][2] in 'xX' else ''}{digits};" if len(digits) < 9 else "\ufffd"


def decoded(text: str) -> str:
    """``text`` with its character references decoded."""
    if "&" not in text:
        return text
    return unescape(LONG_NUMBER.sub(_number, text) if "&#" in text else text)


def _other(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> bool:
    """Whether an element says that it isn't part of the article."""
    if tag in NEVER_OTHER:
        return False
    if tag in OTHER_TAGS or tag == "header" and not in_article:
        return True
    for name, value in attrs:
        value = value or ""
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value.strip().lower() in OTHER_ROLES:
            return True
        if name == "style" and "display:none" in value.replace(" ", "").lower():
            return True
        if name in ("class", "id"):
            for one in value.split():
                words = {w.lower() for w in WORDS.findall(one)}
                found = words & OTHER_WORDS
                if words & ARTICLE_WORDS:
                    found -= {"header", "banner", "content"}
                if found and not (tag == "article" and not words <= OTHER_WORDS):
                    return True
    return False


class _Page:
    """The tree of one page as parallel lists, in page order; node 0 is the root."""

    def __init__(self) -> None:
        self.tags, self.parents = ["html"], [-1]
        self.other, self.silent, self.link = [False], [False], [False]
        self.article = [False]
        self.chars, self.body = [0], 0
        self.pieces: list[tuple[int, int, str]] = []  # node, block, text
        self.block = 0
        self.stack = [0]
        self.open_at: dict[str, list[int]] = defaultdict(list)
        self.last_block = [0]  # positions in the stack of open block elements

    def read(self, html: str) -> None:
        """Text, tags and comments in order; what is open at the end goes on to the end."""
        at, n = 0, len(html)
        while at < n:
            less = html.find("<", at)
            while less >= 0 and not (less + 1 < n and (html[less + 1] in "!?/" or html[less + 1].isascii() and html[less + 1].isalpha())):
                less = html.find("<", less + 1)
            less = n if less < 0 else less
            if less > at:
                self.text(decoded(html[at:less]))
            if less == n:
                return
            name = NAME.match(html, less)
            if name is None:  # comments, declarations, and what browsers take for comments
                comment = html.startswith("<!--", less)
                end = html.find("-->", less + 2) if comment else html.find(">", less + 2)
                at = n if end < 0 else end + (3 if comment else 1)
                continue
            at, attrs = name.end(), []
            while (found := ATTRIBUTE.match(html, at)) and not found[1]:
                attrs.append((found[2].lower(), found[3] or found[4] or found[5]))
                at = found.end()
            if found is None:
                return  # the page ends within a tag
            at, tag = found.end(), name[1].lower()
            if html[less + 1] == "/":
                self.end(tag)
                continue
            self.start(tag, attrs)
            if tag in RAW:
                end = RAW[tag].search(html, at)
                at = end.start() if end else n

    def _pop(self, to: int) -> None:
        """Ends the open elements from position ``to`` on."""
        while len(self.stack) > to:
            self.open_at[self.tags[self.stack.pop()]].pop()
            if self.last_block[-1] == len(self.stack):
                self.last_block.pop()

    def _close(self, names: tuple[str, ...], keep: tuple[str, ...]) -> None:
        """Ends the lowest open element of ``names`` above all open elements of ``keep``."""
        least = max((self.open_at[k][-1] for k in keep if self.open_at[k]), default=0)
        found = [self.open_at[n][-1] for n in names if self.open_at[n] and self.open_at[n][-1] > least]
        if found:
            self._pop(min(found))

    def start(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "html":
            return
        if self.open_at["head"] and tag not in HEAD:
            self._pop(self.open_at["head"][0])
        if tag == "body" and self.body:
            return
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        if tag in BLOCKS:
            self.block += 1
            if tag not in ("option", "optgroup", "legend", "summary"):
                self._close(("p",), SCOPE)
        up = self.stack[-1]
        node = len(self.tags)
        self.tags.append(tag)
        self.parents.append(up)
        self.silent.append(self.silent[up] or tag in NO_TEXT)
        self.other.append(self.other[up] or _other(tag, attrs, self.article[up]))
        self.article.append(self.article[up] or tag == "article")
        self.link.append(self.link[up] or tag == "a")
        self.chars.append(0)
        if tag == "body":
            self.body = node
        if tag == "br":
            self.pieces.append((up, self.block, " "))
        if tag in VOID:
            return
        self.open_at[tag].append(len(self.stack))
        if tag in BLOCKS:
            self.last_block.append(len(self.stack))
        self.stack.append(node)

    def end(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if tag in BLOCKS:
            self.block += 1
        if not self.open_at[tag]:
            return
        at = self.open_at[tag][-1]
        if tag in BLOCKS or tag in NO_TEXT or at >= self.last_block[-1]:
            self._pop(at)

    def text(self, data: str) -> None:
        if self.open_at["head"] and self.tags[self.stack[-1]] == "head" and data.strip():
            self._pop(self.open_at["head"][0])
        node = self.stack[-1]
        if not self.silent[node]:
            self.pieces.append((node, self.block, data))
            self.chars[node] += len(" ".join(data.split()))


def densities(page: _Page) -> tuple[list[float], list[float]]:
    """Composite text density and density sum of every node, children before parents."""
    n = len(page.tags)
    chars, links = list(page.chars), [c if link else 0 for c, link in zip(page.chars, page.link)]
    tags, link_tags, children = [0] * n, [0] * n, [0] * n
    for i in range(n - 1, 0, -1):  # a parent stands before its children
        up = page.parents[i]
        if page.silent[i]:
            continue
        chars[up] += chars[i]
        links[up] += links[i]
        tags[up] += tags[i] + 1
        link_tags[up] += link_tags[i] + (page.tags[i] == "a")
        children[up] += 1
    body_links = max(1, links[page.body]) / max(1, chars[page.body])
    density, total = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        c, t = chars[i], max(1, tags[i])
        if c and not page.silent[i]:
            lc = max(1, links[i])
            base = math.log(math.log(c / max(1, c - links[i]) * lc + body_links * c + math.e))
            density[i] = c / t * math.log(c * t / (lc * max(1, link_tags[i]))) / base
        if not children[i]:
            total[i] = density[i]
        if i:
            total[page.parents[i]] += density[i]
    return density, total


def selected(page: _Page) -> list[bool]:
    """Per node whether its own text belongs to the main text."""
    n, up = len(page.tags), page.parents
    density, total = densities(page)
    fits = [not (page.other[i] or page.silent[i]) for i in range(n)]
    best = list(range(n))  # in each subtree the node of the largest density sum; ties: the outer, the first
    for i in range(n - 1, page.body, -1):
        if fits[i]:
            now = best[up[i]]
            if total[best[i]] > total[now] or total[best[i]] == total[now] and now != up[i]:
                best[up[i]] = best[i]
    top = best[page.body]
    if total[top] <= 0:  # links only, or single characters
        return [fits[i] and not page.link[i] for i in range(n)]
    path = [top]
    while path[-1] != page.body:
        path.append(up[path[-1]])
    least = min(density[i] for i in path)
    within = next((i for i in reversed(path) if page.tags[i] == "article"), None)
    whole = within is not None
    if within is None:
        within = next((i for i in path if page.tags[i] == "main"), page.body)
    chosen, inside = [False] * n, [False] * n
    for i in range(page.body, n):
        inside[i] = i == within or up[i] >= 0 and inside[up[i]]
        if inside[i] and fits[i] and density[i] >= least > 0:
            chosen[best[i]] = True
    chosen[within] |= whole
    for i in range(page.body, n):
        chosen[i] = inside[i] and fits[i] and (chosen[i] or i != within and chosen[up[i]])
    return chosen


def main_text(html: str | None) -> str:
    """The main text of one page: its blocks, white space within them single, two newlines between."""
    page = _Page()
    page.read(html or "")
    chosen = selected(page)
    blocks: dict[int, list[str]] = {}
    for node, block, text in page.pieces:
        if chosen[node]:
            blocks.setdefault(block, []).append(text)
    texts = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n\n".join(t for t in texts if t)


def extract_html(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of every page: (page_id, url, text, n_chars), one row per row of ``pages``.

    A null or empty page, and one without text of its own, has the empty text; null ids and urls
    stay null. Pages of any length or nesting take linear time, and a task holds a slice of about
    two million characters of pages, or one longer page. Equal rows give equal rows; where two nodes
    have the same density sum, the outer or earlier one counts. An empty table gives an
    empty result. Other columns are not read. White space is Unicode's.
    """
    taken = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(x) for x in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )

    return map_rows(taken, "html", "page_id long, url string, text string, n_chars long", rows)
