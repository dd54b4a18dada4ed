"""Main text of web pages by text-to-tag ratios.

The standard library's streaming parser turns a page into lines: stretches of text between block tags (and br).
Each line has a text-to-tag ratio, its characters over the tags met in it. Ratios are smoothed with a Gaussian
kernel along the page, and the threshold that parts the two clusters is the standard deviation of the smoothed
ratios: lines that reach it are dense. The characters of dense lines that are not mostly links weigh their blocks.

Structure marks what can't be main text: menus, page headers, footers, asides, forms, scripts and the like by tag or
role, and what is hidden. Class and id names say more. A name that consists of the words of such parts (`comments`,
`cookie-consent`, `sidebar left`) condemns its block at any weight, inside articles too, unless the block holds the only
text of the page or of its article, or an article of a page that has no other; reader comments go with their articles.
A name that only contains such a word (`has-sidebar`, `comments-layout`) suggests: its block goes if what nothing
suggests against outweighs a part of it (`OUTWEIGHED`). Inside articles headings are never condemned, and ids only of
containers. An inline span with a condemning class is skipped, unless nothing else is left.

Regions are whole: the articles of the page that hold text, else main, else the innermost block around all dense lines,
with the headings above it. All of a region's lines stay, short ones, cells and lists too. Without article and main, lines that are mostly links go
if they lie outside the dense lines or in a block of their own with others like them, but headings and sentences stay;
before the first and behind the last dense line go short ones that are neither headings nor sentences nor in a block
with dense lines. If only lines of links are dense, they count like others.

Work and memory are linear in the page. Null and empty pages, and pages without text outside marks, give the empty
text; pages of any length are taken whole; repeated pages and ids are rows like others; an empty table gives none;
other columns are left out. Marked sections and comments that never end reach to the end of the page. No shuffle.
"""

from __future__ import annotations

import heapq
import math
import re
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from astraloom.llm.common import map_batches

_words = lambda s: frozenset(s.split())

VOID = _words("area base br col embed hr img input link meta param source track wbr")
INLINE = _words("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark math nobr q rp rt ruby s samp small span strike strong sub sup svg time tt u var wbr")
#: What such a tag holds is never main text.
DROPPED = _words("nav footer aside form script style noscript template button select option textarea input iframe object canvas svg audio video dialog menu head title fieldset datalist map applet frameset noframes")
ROLES = _words("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist")
BLOCKS = _words("article main section div td body")
HEADINGS = _words("h1 h2 h3 h4 h5 h6")
#: Inside an article classes of these say something, and ids of those: other ids are anchors there.
PARTS = _words("div ul ol dl table section p figure dd li blockquote center details address")
NAMED = _words("div ul ol dl section")
#: Words of class or id that suggest that a block is not the article; of the second kind, that readers wrote it.
MARKS = _words(
    "ad ads advert adverts advertisement advertising adbox adsense banner sponsor sponsored sponsors promo promotion promoted "
    "sidebar sidebars aside rail menu menus nav navbar navigation navi breadcrumb breadcrumbs topbar toolbar "
    "header masthead footer foot bottombar cookie cookies consent gdpr notice notices notification alert popup modal overlay lightbox "
    "newsletter subscribe subscription signup signin login register share sharing social follow "
    "related recommended recommendations recirculation teaser trending popular widget widgets pagination pager paging search searchform form copyright disclaimer legal imprint tags taglist skip"
)
COMMENTS = _words("comment comments commentlist disqus respond reply replies discussion")
#: Words that an article's own parts may have too: they only suggest, inside articles by class alone.
AMBIGUOUS = _words("discussion legal tags skip follow popular search form paging login register rail alert copyright disclaimer imprint header social reply respond")
#: Words that say nothing beside one of the above.
FILLER = _words(
    "list area section box block wrap wrapper container content inner outer body text item items bar panel column col top bottom left right upper lower side user users reader readers site page main primary secondary "
    "post posts story stories entry entries links link icons buttons button btn unit slot row group holder module zone region global the and of message form count meta title small large"
)
#: With one of these words a header is that of the article.
OWN_HEADER = _words("article post entry story")
#: A suggested block goes if the unsuggested weight of the page is at least this part of its own; of reader comments, less does.
OUTWEIGHED = {1: 0.25, 2: 0.1}
#: An open tag of the first kind ends when one of the second begins.
ENDED_BY = {"li": _words("li"), "dt": _words("dt dd"), "dd": _words("dt dd"), "option": _words("option optgroup"), "tr": _words("tr"), "td": _words("td th tr"), "th": _words("td th tr")}
#: A p that is open outside such a block is not ended inside.
SCOPES = BLOCKS | _words("table ul ol blockquote")
#: Characters from which a line counts as text though it is neither dense nor a sentence.
TOLD = 25
_SPLIT = re.compile(r"[^a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_SENTENCE = re.compile("[.!?…:;。！？।؟][\"'»”’)\\]]*$")


def condemns(name: str, words: frozenset[str]) -> bool:
    """Does one class or id consist of such words and of filler?"""
    parts = [w for w in _SPLIT.split(name) if w and not w.isdigit()]
    return any(w in words and w not in AMBIGUOUS for w in parts) and all(w in MARKS or w in COMMENTS or w in FILLER for w in parts)


def suggestion(tag: str, attrs: list, inner: bool) -> tuple[int, bool]:
    """What class and id say: 0 nothing, 1 not the article, 2 reader comments; and whether that condemns the block."""
    if inner and tag not in PARTS:
        return 0, False
    names = [x for name, value in attrs if value and (name == "class" or name == "id" and (not inner or tag in NAMED)) for x in value.lower().split()]
    for kind, words in ((2, COMMENTS), (1, MARKS)):
        if any(condemns(x, words) for x in names):
            return kind, True
    classes = [x for name, value in attrs if value and (name == "class" or name == "id" and not inner) for x in value.lower().split()]
    found = {w for x in classes for w in _SPLIT.split(x)}
    if found & COMMENTS:
        return 2, False
    if "header" in found and (inner or found & OWN_HEADER):
        found.discard("header")
    return int(bool(found & MARKS)), False


def excluded(tag: str, attrs: list, article: bool) -> bool:
    """Do tag, role or style say that this is never main text?"""
    if tag in DROPPED or tag == "header" and not article:
        return True
    for name, value in attrs:
        if name == "hidden" or name == "role" and (value or "").strip().lower() in ROLES or name == "aria-hidden" and value == "true":
            return tag not in ("html", "body")
        if name == "style" and value and _HIDDEN.search(value.lower()):
            return tag not in ("html", "body")
    return False


class Page(HTMLParser):
    """Collects lines (text, tags, block, kept out, characters in links, heading) and the tree of blocks."""

    def __init__(self, spans: bool = False):
        """spans: keep the text of condemned spans."""
        super().__init__(convert_charrefs=True)
        self.spans = spans
        self.muted = self.skipped = False
        self.lines: list[tuple[str, int, int, bool, int, bool]] = []
        self.parts: list[str] = []
        self.tags = self.linked = 0
        # blocks: the one around it, what is suggested against it, its tag
        self.around, self.suggested, self.sure, self.kind = [0], [0], [False], ["body"]
        self.stack: list[tuple] = []  # tag and the state before it
        self.out = self.article = self.inner = self.heading = False
        self.block = self.links = 0
        self.open_p = -1  # the innermost open p of this scope
        self.counts: dict[str, int] = {}  # open block tags
        self.inline: dict[str, int] = {}  # open inline tags of the innermost block tag

    def cut(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.lines.append((text, self.tags, self.block, self.out, min(self.linked, len(text)), self.heading))
                self.tags = 0
            self.parts = []
        self.linked = 0

    def pop(self, at: int) -> None:
        while len(self.stack) > at:
            tag, self.out, self.block, self.article, self.inner, self.heading, self.open_p, self.inline, self.muted = self.stack.pop()
            if tag in INLINE:
                self.inline[tag] -= 1
                self.links -= tag == "a"
            else:
                self.counts[tag] -= 1

    def handle_starttag(self, tag: str, attrs: list) -> None:
        block = tag not in INLINE
        if block:
            self.cut()
        self.tags += 1
        if tag in VOID:
            return
        stack = self.stack
        if block:
            if self.open_p >= 0 and (tag == "p" or stack[-1][0] == "p"):
                self.pop(self.open_p)
            elif stack and tag in ENDED_BY.get(stack[-1][0], ()):
                self.pop(len(stack) - 1)
        stack.append((tag, self.out, self.block, self.article, self.inner, self.heading, self.open_p, self.inline, self.muted))
        if not block:
            self.inline[tag] = self.inline.get(tag, 0) + 1
            self.links += tag == "a"
            if tag == "span" and attrs and not self.spans and not self.muted:
                self.muted = any(condemns(x, MARKS | COMMENTS) for name, value in attrs if name == "class" and value for x in value.lower().split())
            return
        self.counts[tag] = self.counts.get(tag, 0) + 1
        self.inline = {}
        if tag == "p":
            self.open_p = len(stack) - 1
        elif tag in SCOPES:
            self.open_p = -1
        self.heading = self.heading or tag in HEADINGS
        if not self.out:
            self.out = excluded(tag, attrs, self.article)
            mark, sure = suggestion(tag, attrs, self.inner) if attrs and not self.out and tag not in ("html", "body", "article", "main") and tag not in HEADINGS else (0, False)
            if mark or tag in BLOCKS:
                self.around.append(self.block)
                self.suggested.append(mark)
                self.sure.append(sure)
                self.kind.append(tag)
                self.block = len(self.around) - 1
        if tag in ("article", "main"):
            self.article = True
            self.inner = self.inner or tag == "article"

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        block = tag not in INLINE
        if block:
            self.cut()
        self.tags += 1
        # an inline tag ends within its block only; an end without a beginning ends nothing
        if (self.counts if block else self.inline).get(tag, 0):
            at = len(self.stack) - 1
            while self.stack[at][0] != tag:
                at -= 1
            self.pop(at)

    def handle_data(self, data: str) -> None:
        if self.muted:
            self.skipped = self.skipped or not data.isspace()
            return
        self.parts.append(data)
        if self.links:
            self.linked += len(data)

    # What never ends is read once, to the end of the page.

    def _bogus(self, i: int) -> int:
        at = self.rawdata.find(">", i + 2)
        return len(self.rawdata) if at < 0 else at + 1

    def parse_comment(self, i: int, report: bool = True) -> int:
        if self.rawdata.startswith((">", "->"), i + 4):
            return self.rawdata.index(">", i + 4) + 1
        at = self.rawdata.find("-->", i + 4)
        return len(self.rawdata) if at < 0 else at + 3

    def parse_html_declaration(self, i: int) -> int:
        return self._bogus(i)

    def parse_pi(self, i: int) -> int:
        return self._bogus(i)

    def parse_starttag(self, i: int) -> int:
        if self.rawdata.find(">", i) < 0:
            self.handle_data(unescape(self.rawdata[i:]))
            return len(self.rawdata)
        return super().parse_starttag(i)

    def parse_endtag(self, i: int) -> int:
        return super().parse_endtag(i) if self.rawdata.find(">", i) >= 0 else len(self.rawdata)

    def close(self) -> None:
        super().close()
        self.cut()
        self.pop(0)


def kernel(sigma: float) -> np.ndarray:
    half = math.ceil(3 * sigma)
    k = np.exp(-((np.arange(-half, half + 1) / sigma) ** 2) / 2)
    return k / k.sum()


def dense_lines(lines: list[tuple], smooth: np.ndarray) -> np.ndarray:
    """Which lines reach the threshold; where none does, all that are not kept out."""
    ratios = np.array([0.0 if out else len(text) / max(1, tags) for text, tags, _, out, _, _ in lines])
    smoothed = np.convolve(ratios, smooth)[len(smooth) // 2 :][: len(ratios)]
    found = (smoothed >= smoothed.std()) & (ratios > 0)
    return found if found.any() else ratios > 0


def dropped_blocks(page: Page, total: list[int], told: list[int]) -> list[bool]:
    """Which blocks go because of what is suggested against them. total: the weight of each block with all it holds; told: the characters
    of its own lines that are dense or sentences."""
    n = len(page.around)
    under = [0] * n  # how many suggested blocks are around or at each
    holds = [k in ("article", "main") for k in page.kind]
    home = [0] * n  # the innermost article around each
    clean, plain = total[0], sum(told)
    plain_in = [0] * n  # of an article: what is told in it outside suggested blocks
    inside: dict[int, list[int]] = {}  # outermost suggested blocks within each suggested one
    near = [0] * n  # the innermost suggested block around each
    every = list(told)  # with all it holds
    for b in range(n - 1, 0, -1):
        every[page.around[b]] += every[b]
    for b in range(1, n):
        up = page.around[b]
        home[b] = b if page.kind[b] == "article" else home[up]
        under[b] = under[up] + (page.suggested[b] > 0)
        near[b] = up if page.suggested[up] else near[up]
        if page.suggested[b]:
            inside.setdefault(near[b] if under[up] else 0, []).append(b)
            if not under[up]:
                clean -= total[b]
                plain -= every[b]
    for b in range(1, n):  # an article that lies in a suggested block counts what is suggested within it
        if home[b] and under[b] == under[home[b]]:
            plain_in[home[b]] += told[b]
    plain_article = any(h and not u for h, u in zip(holds, under))
    for b in range(n - 1, 0, -1):
        holds[page.around[b]] = holds[page.around[b]] or holds[b]
    gone = [False] * n
    # the weightiest first, what it holds after it; what stays speaks against the others
    todo = [(-total[b], b) for b in inside.get(0, ())]
    heapq.heapify(todo)
    while todo:
        _, b = heapq.heappop(todo)
        kind, within = page.suggested[b], inside.get(b, ())
        if page.sure[b]:
            stays = not plain or kind == 1 and (holds[b] and not plain_article or home[b] > 0 and not plain_in[home[b]])
        else:
            stays = clean < OUTWEIGHED[kind] * total[b] or kind == 1 and holds[b] and not plain_article
        if stays and every[b] > 0:
            clean += total[b] - sum(total[x] for x in within)
            own = every[b] - sum(every[x] for x in within)
            plain += own
            plain_in[home[b]] += own
            plain_article = plain_article or holds[b]
            for x in within:
                heapq.heappush(todo, (-total[x], x))
        else:
            gone[b] = True
    for b in range(1, n):
        gone[b] = gone[b] or gone[page.around[b]]
    return gone


def content(page: Page, smooth: np.ndarray) -> list[str]:
    """The lines of the content regions, in page order."""
    lines = page.lines
    if all(line[3] for line in lines):
        return []
    dense = dense_lines(lines, smooth).tolist()
    linky = [2 * line[4] > len(line[0]) for line in lines]
    if not any(d and not x for d, x in zip(dense, linky)):
        linky = [False] * len(lines)

    def weights(gone: list[bool]) -> list[int]:
        total = [0] * len(page.around)
        for line, hit, links in zip(lines, dense, linky):
            if hit and not links and not gone[line[2]]:
                total[line[2]] += len(line[0])
        for b in range(len(total) - 1, 0, -1):
            total[page.around[b]] += total[b]
        return total

    told = [0] * len(page.around)
    for line, hit, links in zip(lines, dense, linky):
        if not line[3] and not links and (hit or not line[5] and (len(line[0]) >= TOLD or _SENTENCE.search(line[0]))):
            told[line[2]] += len(line[0])
    gone = dropped_blocks(page, weights([False] * len(page.around)), told)
    total = weights(gone)
    left = [0 if g else t for g, t in zip(gone, told)]
    for b in range(len(left) - 1, 0, -1):
        left[page.around[b]] += left[b]
    stay = [not line[3] and not gone[line[2]] for line in lines]
    for kind in ("article", "main"):
        region = [False] * len(page.around)
        for b in range(1, len(region)):
            region[b] = region[page.around[b]] or page.kind[b] == kind and left[b] > 0
        if any(region):
            return [line[0] for line, ok in zip(lines, stay) if ok and region[line[2]]]
    top = 0
    held = [b for b in range(1, len(total)) if total[b] == total[0] > 0]
    top = held[-1] if held else 0
    region = [b == top for b in range(len(total))]
    for b in range(1, len(total)):
        region[b] = region[b] or region[page.around[b]]
    hits = [i for i, line in enumerate(lines) if dense[i] and stay[i] and not linky[i] and region[line[2]]]
    if not hits:
        return []
    full = {lines[i][2] for i in hits} - {top}
    outer, up = {0}, top  # a heading that stands above the region, in a block around it, is its title
    while up:
        up = page.around[up]
        outer.add(up)
    near = [i for i, line in enumerate(lines) if stay[i] and (region[line[2]] or line[5] and i < hits[0] and line[2] in outer)]
    found = []
    for k, i in enumerate(near):
        text, _, block, _, _, heading = lines[i]
        within = hits[0] <= i <= hits[-1]
        if linky[i]:
            alone = not any(linky[j] for j in (*near[max(0, k - 1) : k], *near[k + 1 : k + 2]))
            ok = heading and i <= hits[-1] or within and (block in full or block == top and alone or bool(_SENTENCE.search(text)))
        else:
            ok = within or block in full or heading or bool(_SENTENCE.search(text))
        if ok:
            found.append(text)
    return found


def main_text(html: str | None, smooth: np.ndarray = kernel(2.0)) -> str:
    if not html:
        return ""
    for spans in (False, True):
        page = Page(spans)
        page.feed(html)
        page.close()
        found = content(page, smooth)
        if found or not page.skipped:
            break
    return "\n".join(found)


def extract_text(pages: DataFrame, sigma: float = 2.0) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def make():
        smooth = kernel(sigma)

        def fn(batch: pa.RecordBatch) -> dict:
            texts = [main_text(x, smooth) for x in batch.column(2).to_pylist()]
            return {"page_id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": list(map(len, texts))}

        return fn

    kind = pages.schema["page_id"].dataType.simpleString()
    return map_batches(pages.select("page_id", "url", "html"), f"page_id {kind}, url string, text string, n_chars long", make)
