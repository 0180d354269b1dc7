"""Operator 12: the main text of web pages by composite text density over the DOM."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_ROWS

_TAG = re.compile(r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|[!?][^>]*+>?|/(?![a-zA-Z])[^>]*+>?|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)[^>]*+>?)""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|$)""", re.I)
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

_words = lambda text: frozenset(text.split())
#: Elements whose content is no markup: it ends at their own end tag.
RAW = _words("script style title textarea noscript iframe xmp noembed noframes template")
VOID = _words("area base br col embed hr img input link meta param source track wbr")
BLOCK = _words(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption option"
)
#: An open element of the first kind ends where one of the second begins, unless one of the third lies between.
IMPLIED_END = {
    "p": (BLOCK - _words("td th tr tbody thead tfoot caption option body html"), _words("td th caption button")),
    "li": (_words("li"), _words("ul ol menu dir")),
    "dt": (_words("dt dd"), _words("dl")),
    "dd": (_words("dt dd"), _words("dl")),
    "option": (_words("option optgroup"), _words("select")),
    "td": (_words("td th tr tbody thead tfoot"), _words("table")),
    "th": (_words("td th tr tbody thead tfoot"), _words("table")),
    "tr": (_words("tr tbody thead tfoot"), _words("table")),
}
_ENDED_BY = {tag: [x for x, (by, _) in IMPLIED_END.items() if tag in by] for tag in set().union(*(by for by, _ in IMPLIED_END.values()))}

#: What is no part of an article, by element, role, and words in class or id.
OTHER_TAGS = _words("nav footer aside form menu dialog search select button input label fieldset object svg canvas audio video")
OTHER_ROLES = _words("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar status")
OTHER_NAMES = _words(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promotion banner nav navbar navigation menu menus submenu breadcrumb breadcrumbs toolbar footer sidebar sidebars aside rail widget widgets "
    "cookie cookies consent gdpr notice notices alert alerts warning popup modal overlay lightbox newsletter subscribe subscription signup signin login register paywall search form share sharing social related recommended recommendations trending popular "
    "pagination pager skip hidden disclaimer copyright masthead topbar"
)
COMMENT_NAMES = _words("comment comments commentlist respond disqus discussion reply replies responses guestbook")
CONTAINERS = _words("article main")


class Page:
    """The elements of a page in document order, as lists: tag, parent, whether names say that it is no article."""

    def __init__(self, source: str):
        self.tag, self.parent, self.other, self.container = ["#root"], [-1], [False], [False]
        #: (element, text), or (element, None) where a block begins or ends
        self.stream: list[tuple[int, str | None]] = []
        stack, opened = [0], Counter()
        at, n = 0, len(source)
        while at < n:
            found = _TAG.search(source, at)
            if text := source[at : found.start() if found else n]:
                self.stream.append((stack[-1], html.unescape(text) if "&" in text else text))
            if not found:
                break
            at = found.end()
            if not found[2]:
                continue
            tag = found[2].lower()
            if found[1]:
                self._end(tag, stack, opened)
                continue
            for kind in _ENDED_BY.get(tag, ()):
                if opened[kind]:
                    self._end_implied(kind, stack, opened)
            if tag in RAW:
                close = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>?", re.I).search(source, at)
                at = close.end() if close else n
                continue
            if tag in BLOCK:
                self.stream.append((stack[-1], None))
            if tag == "br":
                self.stream.append((stack[-1], "\n"))
            self.tag.append(tag)
            self.parent.append(stack[-1])
            self._names(tag, found[3])
            if tag not in VOID:
                stack.append(len(self.tag) - 1)
                opened[tag] += 1

    def _names(self, tag: str, attributes: str) -> None:
        held = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)} if attributes and not attributes.isspace() else {}
        role = held.get("role", "").lower()
        self.container.append(tag in CONTAINERS or role in CONTAINERS or held.get("itemprop") == "articleBody")
        names = {x.lower() for x in _NAME_PART.findall(f"{held.get('class', '')} {held.get('id', '')}")} if held else set()
        unseen = "hidden" in held or held.get("aria-hidden") == "true" or "display:none" in held.get("style", "").replace(" ", "").lower()
        if tag in OTHER_TAGS or role in OTHER_ROLES or unseen:
            kind = "tag"
        elif names & COMMENT_NAMES:
            kind = "comments"
        elif tag == "header" or "header" in names:
            kind = "header"
        else:
            kind = "name" if names & OTHER_NAMES else None
        self.other.append(kind)

    def _pop(self, stack: list[int], opened: Counter) -> None:
        k = stack.pop()
        opened[self.tag[k]] -= 1
        if self.tag[k] in BLOCK:
            self.stream.append((stack[-1], None))

    def _end(self, tag: str, stack: list[int], opened: Counter) -> None:
        if not opened[tag]:
            return
        if tag not in BLOCK:  # an inline element does not end the block that stands in it
            for k in reversed(stack):
                if self.tag[k] == tag:
                    break
                if self.tag[k] in BLOCK:
                    return
        while self.tag[stack[-1]] != tag:
            self._pop(stack, opened)
        self._pop(stack, opened)

    def _end_implied(self, tag: str, stack: list[int], opened: Counter) -> None:
        stops = IMPLIED_END[tag][1]
        for k in reversed(stack):
            if self.tag[k] in stops:
                return
            if self.tag[k] == tag:
                self._end(tag, stack, opened)
                return

    def dropped(self, by_name: bool) -> list[bool]:
        """Elements that are no article, with all that they hold. Names do not drop what holds the article or its title."""
        holds, titled = list(self.container), [t == "h1" for t in self.tag]
        for k in range(len(self.tag) - 1, 0, -1):
            if holds[k]:
                holds[self.parent[k]] = True
            if titled[k]:
                titled[self.parent[k]] = True
        # an article whose own names speak of comments is one of them only where another article does not
        another = any(c and kind != "comments" for c, kind in zip(self.container, self.other))
        out, inside = [False], [False]
        for k in range(1, len(self.tag)):
            p, kind = self.parent[k], self.other[k]
            inside.append(inside[p] or self.container[k])
            own = kind == "tag" and not holds[k]
            own |= by_name and kind == "comments" and not titled[k] and (not holds[k] or self.container[k] and another)
            own |= by_name and kind == "header" and not holds[k] and not inside[k]
            own |= by_name and kind == "name" and not holds[k] and not titled[k]
            out.append(out[p] or own)
        return out

    def densities(self, gone: list[bool]) -> tuple[list[float], list[float], list[int], list[int]]:
        """Composite density, sum of the children's densities, characters and characters in links of every element.

        chars / tags * log(chars / linked * tags / links) to the base ln(chars / unlinked * linked + linked share of the
        page * chars + e); a divisor of 0 counts as 1, and where the base is 1 (a page without links) the logarithm too.
        """
        n = len(self.tag)
        chars, tags, linked, links = [0] * n, [0] * n, [0] * n, [0] * n
        page_chars = page_linked = 0
        in_link = [False] * n
        for k in range(1, n):
            in_link[k] = in_link[self.parent[k]] or self.tag[k] == "a"
        for k, text in self.stream:
            if text is not None and (c := len(text.strip())):
                page_chars += c
                page_linked += c * in_link[k]
                if not gone[k]:
                    chars[k] += c
                    linked[k] += c * in_link[k]
        for k in range(n - 1, 0, -1):
            p = self.parent[k]
            if not gone[k]:
                chars[p], linked[p] = chars[p] + chars[k], linked[p] + linked[k]
                tags[p], links[p] = tags[p] + tags[k] + 1, links[p] + links[k] + (self.tag[k] == "a")
        share = page_linked / max(page_chars, 1)
        density, total = [0.0] * n, [0.0] * n
        for k in range(n - 1, -1, -1):
            if chars[k] and not gone[k]:
                c, t = chars[k], max(tags[k], 1)
                base = log(log(c / max(c - linked[k], 1) * linked[k] + share * c + e))
                ratio = max(log(c / max(linked[k], 1) * t / max(links[k], 1)), 0.0)
                density[k] = c / t * (ratio / base if base > 1e-12 else 1.0)
                if total[k] == 0.0:
                    total[k] = density[k]  # no child has text
            if k and not gone[k]:
                total[self.parent[k]] += density[k]
        return density, total, chars, linked

    def chosen(self, gone: list[bool]) -> list[bool]:
        """The elements whose text is the article's.

        The subtree with the largest sum, and of each other element that is as dense as the thinnest one between that
        subtree and the page, its subtree with the largest sum. Where the first lies in an article or main element, all of it;
        it is looked for in these alone where they hold a quarter of the text.
        """
        n = len(self.tag)
        density, total, chars, linked = self.densities(gone)
        inside, held = [False] * n, 0
        for k in range(1, n):
            inside[k] = inside[self.parent[k]] or self.container[k]
            held += chars[k] if self.container[k] and not inside[self.parent[k]] else 0
        among = [k for k in range(n) if inside[k]] if held and 4 * held >= chars[0] else range(n)
        first = max(among, key=lambda k: (total[k], -k))
        if not chars[first]:
            return [False] * n
        path, k = [], first
        while k >= 0:
            path.append(k)
            k = self.parent[k]
        keep = [False] * n
        home = next((k for k in path if self.container[k]), None)
        if home is not None:
            keep[home] = True
        else:
            least = min(density[k] for k in path)
            best = list(range(n))  # of each subtree, the element with the largest sum
            for k in range(n - 1, 0, -1):
                p = self.parent[k]
                if not gone[k] and (total[best[k]], -best[k]) > (total[best[p]], -best[p]):
                    best[p] = best[k]
            for k in range(n):
                if not gone[k] and chars[k] and density[k] >= least:
                    keep[best[k]] = True
        for k in range(1, n):
            menu = linked[k] and linked[k] == chars[k] and self.tag[k] in ("ul", "ol", "dl", "table")
            keep[k] = (keep[k] or keep[self.parent[k]]) and not gone[k] and not menu
        return keep

    def text(self, keep: list[bool]) -> str:
        blocks, open_block = [], []
        for k, text in [*self.stream, (0, None)]:
            if text is not None:
                if keep[k]:
                    open_block.append(text)
            elif open_block:
                if block := " ".join("".join(open_block).split()):
                    blocks.append(block)
                open_block = []
        return "\n\n".join(blocks)


def main_text(source: str | None) -> str:
    if not source:
        return ""
    page = Page(source)
    # a page that names drop as a whole is judged by its elements and densities alone
    for by_name in (True, False):
        if found := page.text(page.chosen(page.dropped(by_name))):
            return found
    return ""


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page: the blocks of its article, joined by an empty line.

    Null, empty and blank html, and pages with nothing but what is no article: empty text. Html that is cut off, or whose
    elements do not end, is read as far as it goes. Text without any element is one block. Repeated rows each have a row;
    null ids and urls stay. An empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    pages.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")
