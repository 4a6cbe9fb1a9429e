"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams a page's events. Block tags cut the page into lines; a line's ratio is its characters of
text over its tags. The ratios, smoothed by a Gaussian, fall into two clusters at the threshold that leaves the least squared
deviation within them; the lines of the upper cluster carry a page's content. The element that holds this content is the
page's article: an ``article`` or ``main`` where one holds enough of it, else the smallest container that holds nearly all of it.
Of the article every line stays, however short, but those within elements that are no article text by their tag, role, class
or id: menus, page headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader comments.

Character references are decoded, white space inside a line (a line break too) becomes one space, lines without text go, and
the others are joined by line ends in page order. A null or empty page has an empty text. Unclosed comments, tags and scripts
reach to the page's end, as in browsers; a quote without its partner does not, its tag ends at the first sign. The
parser's scans for the ends of tags and comments are replaced by such that look at each character a bounded number of times, so a
page of nothing but ``<a`` or ``<!--`` takes linear time too. Repeated rows are results of their own; columns but page_id, url and
html are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewake.llm.common import ROWS_PER_PASS

# The markup's vocabulary.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without article text whatever they hold.
NEVER = frozenset("aside audio button canvas datalist dialog embed footer form head iframe menu nav noscript object script select style svg template textarea title video".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words of a class or id that name something beside the article.
NAMES = frozenset(
    "ad ads advert advertisement advertising adverts aside banner breadcrumb breadcrumbs comment comments consent cookie cookies discussion disqus footer form gdpr header login masthead menu modal nav "
    "navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion recommendations recommended related replies respond search share sharing sidebar signup social "
    "sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
#: Of these, what holds articles that are not the page's.
OTHERS = frozenset("comment comments discussion disqus recommendations recommended related replies respond".split())
_STRUCTURE = frozenset(("article", "main", "header", "aside", "footer"))
CONTAINERS = frozenset("article body center div main section table tbody td tr".split())
#: A start tag of these ends an open paragraph; of an item, an open item.
_ENDS_PARAGRAPH = BLOCKS - {"body", "head", "html", "option", "optgroup", "legend", "summary", "caption", "tbody", "thead", "tfoot", "tr", "title"}
_ITEMS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}
_TAG = re.compile(r"""<([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*+)>""")
_END_TAG = re.compile(r"</([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_WANTED = re.compile(r"\b(?:class|id|role)\b", re.IGNORECASE)
_WORDS = re.compile(r"[a-z]+")
_SKIPPED_TEXT = ("script", "style")
SMOOTHING = 1.0
#: Share of a page's content that an article must hold, and that a plain container must hold.
ARTICLE_SHARE, CONTAINER_SHARE = 0.3, 0.95


class Lines(HTMLParser):
    """Lines of a page from the parser's events: text, tags, the element that holds them, and whether they are beside the article."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parent, self.kind = [-1], ["html"]  # elements that hold lines
        self.stack: list[tuple[str, int, str]] = [("html", 0, "")]  # tag, element, why it is beside the article
        self.open: Counter[str] = Counter()
        self.text: list[str] = []
        self.ratio: list[float] = []
        self.node: list[int] = []
        self.beside: list[bool] = []
        self._pieces: list[str] = []
        self._tags = 0

    def of(self, html: str) -> Lines:
        self._no_more: set[str] = set()
        self.feed(html)
        self.close()
        self._end_line()
        return self

    def updatepos(self, i: int, j: int) -> int:
        return j  # line numbers of the source are not wanted

    # The ends of constructs. What has no end reaches to the page's end.
    def _found(self, end: str, i: int) -> int:
        at = -1 if end in self._no_more else self.rawdata.find(end, i)
        if at < 0:
            self._no_more.add(end)
        return at

    def parse_starttag(self, i: int) -> int:
        if self._found(">", i) < 0:
            return len(self.rawdata)
        m = _TAG.match(self.rawdata, i)
        if m:
            name, rest, end = m[1], m[2], m.end()
        else:  # a quote without its partner: the tag ends at the first sign
            end = self.rawdata.find(">", i) + 1
            name, _, rest = self.rawdata[i + 1 : end - 1].partition(" ")
            name = re.split(r"[\s/]", name, maxsplit=1)[0]
        name = name.lower()
        attrs = [(k.lower(), v.strip("\"'")) for k, v in _ATTRIBUTE.findall(rest)] if _WANTED.search(rest) else []
        self.handle_starttag(name, attrs)
        if name in _SKIPPED_TEXT and not rest.endswith("/"):
            self.set_cdata_mode(name)
        return end

    def parse_endtag(self, i: int) -> int:
        end = self._found(">", i)
        if end < 0:
            return len(self.rawdata)
        m = _END_TAG.match(self.rawdata, i)
        if self.cdata_elem is not None:
            if not m or m[1].lower() != self.cdata_elem:
                return i + 2
            self.clear_cdata_mode()
        if m:
            self.handle_endtag(m[1].lower())
        return end + 1

    def parse_comment(self, i: int, report: int = 1) -> int:
        if self.rawdata.startswith((">", "->"), i + 4):
            return self.rawdata.find(">", i) + 1
        end = self._found("-->", i + 4)
        return end + 3 if end >= 0 else len(self.rawdata)

    def parse_html_declaration(self, i: int) -> int:
        return self.parse_pi(i)

    def parse_pi(self, i: int) -> int:
        end = self._found(">", i)
        return end + 1 if end >= 0 else len(self.rawdata)

    # Events.
    def _end_line(self) -> None:
        text = " ".join("".join(self._pieces).split()) if self._pieces else ""
        if text:
            _, node, why = self.stack[-1]
            self.text.append(text)
            self.ratio.append(len(text) / max(1, self._tags))
            self.node.append(node)
            self.beside.append(bool(why))
        if text or len(self._pieces) > 64:
            self._tags = 0
        self._pieces = []

    def _pop(self, tags: tuple[str, ...]) -> None:
        """Closes open elements up to the innermost of these, if one is open."""
        if any(self.open[t] for t in tags):
            while True:
                tag, _, why = self.stack[-1]
                if self._pieces and len(self.stack) > 1 and (tag in BLOCKS or why != self.stack[-2][2]):
                    self._end_line()
                self.stack.pop()
                self.open[tag] -= 1
                if tag in tags:
                    return

    def _why(self, tag: str, attrs: list[tuple[str, str]]) -> str:
        """Why an element is beside the article: a word, empty for none."""
        outer = self.stack[-1][2]
        if not attrs and (outer or tag not in NEVER) and tag not in _STRUCTURE:
            return outer
        inside = self.open["article"] or self.open["main"]
        names = set()
        for k, v in attrs:
            if k == "role" and v.lower() in ROLES:
                return "role"
            if k in ("class", "id") and tag not in ("html", "body", "main"):
                for one in v.lower().split():
                    words = _WORDS.findall(one)
                    if not {"has", "with", "no", "without"} & set(words):
                        names.update(NAMES & set(words))
        if tag == "article":
            names &= OTHERS
        elif inside and not outer:
            names -= {"header", "banner", "masthead"}
        if names & OTHERS:
            return "others"
        if tag in ("article", "main") and outer != "others" and not names:
            return ""
        if outer:
            return outer
        if tag in NEVER or tag == "header" and not inside:
            return "others" if tag in ("aside", "footer") else tag
        return min(names, default="")

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str]]) -> None:
        if tag in _ENDS_PARAGRAPH and self.open["p"]:
            self._pop(("p",))
        elif tag in _ITEMS and self.stack[-1][0] in _ITEMS[tag]:
            self._pop(_ITEMS[tag])
        elif tag == "body":
            self._pop(("head",))
        why = "" if tag in VOID else self._why(tag, attrs)
        if tag in BLOCKS or why != self.stack[-1][2] and tag not in VOID:
            self._end_line()
        elif tag in ("br", "td", "th", "img"):
            self._pieces.append(" ")
        self._tags += 1
        if tag in VOID:
            return
        node = self.stack[-1][1]
        if tag in BLOCKS or tag == "td":
            self.parent.append(node)
            self.kind.append(next((v.lower() for k, v in attrs if k == "role" and v.lower() in ("article", "main")), tag))
            node = len(self.parent) - 1
        self.stack.append((tag, node, why))
        self.open[tag] += 1

    def handle_endtag(self, tag: str) -> None:
        self._tags += 1
        if tag in VOID:
            if tag == "br":
                self._pieces.append(" ")
            return
        self._pop((tag,))
        if tag in BLOCKS:
            self._end_line()

    def handle_data(self, data: str) -> None:
        if self.stack[-1][0] not in _SKIPPED_TEXT:
            self._pieces.append(data)


def smoothed(ratios: np.ndarray, sigma: float = SMOOTHING) -> np.ndarray:
    """Ratios under a Gaussian of three deviations to each side, its weights brought to one at the ends."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma**2))
    return np.convolve(ratios, kernel)[reach:-reach] / np.convolve(np.ones(len(ratios)), kernel)[reach:-reach]


def threshold(values: np.ndarray) -> float:
    """The least value of the upper of two clusters, cut where the squared deviations within them are least; equal values are one cluster."""
    v = np.sort(values)
    n = np.arange(1, len(v))
    left = np.cumsum(v)[:-1]
    between = np.where(v[1:] > v[:-1], n * (len(v) - n) * (left / n - (v.sum() - left) / (len(v) - n)) ** 2, -1.0)
    return float(v[int(np.argmax(between)) + 1]) if len(between) and between.max() > 0 else float(v[0])


def main_text(html: str | None) -> str:
    """The article of one page."""
    page = Lines().of(html or "")
    if not page.text:
        return ""
    smooth = smoothed(np.log1p(np.array(page.ratio)))
    own = ~np.array(page.beside)
    if not own.any():
        return ""
    length = np.array([len(t) for t in page.text], float)
    held = np.where(own & (smooth >= threshold(smooth)), length, 0.0)
    if not held.any():
        held = np.where(own, length, 0.0)
    mass = np.zeros(len(page.parent))
    np.add.at(mass, np.array(page.node), held)
    for i in range(len(mass) - 1, 0, -1):  # children come after their parents
        mass[page.parent[i]] += mass[i]
    root = 0
    for kind in ("article", "main"):
        best = max((i for i, k in enumerate(page.kind) if k == kind), key=lambda i: (mass[i], -i), default=None)
        if best is not None and mass[best] >= ARTICLE_SHARE * mass[0]:
            root = best
            break
    else:
        for i in range(1, len(mass)):
            if page.parent[i] == root and page.kind[i] in CONTAINERS and mass[i] >= CONTAINER_SHARE * mass[root]:
                root = i
    under = np.zeros(len(mass), bool)
    under[root] = True
    for i in range(root + 1, len(mass)):
        under[i] = under[page.parent[i]]
    stays = own & under[np.array(page.node)]
    if page.kind[root] not in ("article", "main"):
        headings = [i for i, x in enumerate(page.node) if page.kind[x] == "h1"]
        if headings and not any(stays[i] for i in headings):  # the title may stand above the container
            first = int(np.argmax(stays))
            stays[[i for i in headings if own[i] and i < first][-1:]] = True
    return "\n".join(t for t, s in zip(page.text, stays, strict=True) if s)


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS_PER_PASS):
                part = b.slice(at, ROWS_PER_PASS)
                texts = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    held = pages.select("page_id", "url", "html")
    kinds = {f.name: f.dataType.simpleString() for f in held.schema}
    return held.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
