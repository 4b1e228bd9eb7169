"""Main text of web pages from flat text blocks and a small decision tree.

A page is cut into blocks at block-level tags. Each block has its word count and link density, those of the blocks before
and after it, whether an element made for boilerplate, the article's element, a heading or a part of the page with a telling
name encloses it, whether the page has any text outside such parts (if not, names tell nothing), and whether it stands beside a
main text that has an element of its own. A CART tree, grown on the labelled blocks of TRAINING_PAGES, keeps or drops each block.
Names of quotes, paragraphs, headings and the like are not looked at, and how long a block is does not excuse its part's name.

Null html is read as empty; a page without kept blocks has an empty text; repeated rows give repeated rows. Nothing is capped,
and pages are read in linear time, so one very long or broken page is one row of one task, as it is in the table.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import pick, table

#: Element names of HTML.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What stands in these is no text of the page. Unclosed, the first run to its end; the others are elements like any other.
RAW_TAGS = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "textarea", "title")}
CLOSED_TAGS = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("noscript", "template", "iframe", "svg", "canvas", "object")}
#: Elements and roles that are made for what is not the article; header only above it.
BOILER_TAGS = frozenset("nav footer aside form menu button select fieldset dialog".split())
BOILER_ROLES = frozenset("navigation contentinfo complementary banner search dialog alert alertdialog".split())
MAIN_TAGS = frozenset("article main".split())
SHELL_TAGS = frozenset("html body main article".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that a text has for words of others or for itself; what they are called tells nothing.
QUOTE_TAGS = HEADINGS | frozenset("p a b i em strong span q blockquote cite code pre figure figcaption img li td th dd dt mark small sub sup time body html".split())
LINKED = 0.5
#: So many plain words are a text; more tell nothing about the other blocks.
ENOUGH = 10
#: What pages call their parts. A name counts if it is made of these words only, the first kind among them:
#: ad-slot and site-footer do, ad-hoc and search-history do not.
PART_WORDS = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo promoted promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "footer copyright sidebar aside widget widgets related recommended share sharing social comment comments reply replies discussion "
    "cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe signup login form search tags pagination pager".split()
)
HEADER_WORDS = frozenset("header masthead topbar".split())
PLACE_WORDS = frozenset("site page main global left right top bottom inner outer wrapper container box block area section slot unit zone panel row column list item items links bar buttons content body reader readers user users visitor visitors post posts latest recent more".split())

_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_TAG_END = re.compile(r">|=\s*([\"'])")
_MARKS = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[^\W_]+")


class Block(NamedTuple):
    text: str
    words: int
    link_density: float
    in_boiler: int
    in_main: int
    heading: int
    named: int
    label: str


FEATURES = ("words", "link density", "words before", "link density before", "words after", "link density after", "in boilerplate element", "in main", "heading", "named", "plain words", "beside main")


class Frame(NamedTuple):
    """An open element: how many open ones of each kind it is among, and the label of the training table."""

    tag: str
    links: int
    boiler: int
    main: int
    heading: int
    named: int
    label: str


def part_name(name: str, header: bool) -> bool:
    """Whether a class or id names a part of the page that is not the article; header: also what is above it."""
    found = {w.lower() for w in _WORD.findall(name)}
    known = PART_WORDS | HEADER_WORDS if header else PART_WORDS
    return bool(found & known) and found <= known | PLACE_WORDS


class Tags:
    """The tags of a page in order, each looked at once: what is unclosed is found to be so once only, however often it occurs."""

    def __init__(self, page: str) -> None:
        self.page, self.never = page, set()  # what does not occur any more

    def find(self, what: str, at: int) -> int:
        if what in self.never:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.never.add(what)
        return found

    def end(self, at: int) -> int:
        """Past the > of a tag whose name ends at `at`; values in quotes may hold one. -1 if there is none."""
        start = at
        while m := _TAG_END.search(self.page, at):
            if not m[1]:
                return m.end()
            close = self.find(m[1], m.end())
            at = close + 1 if close >= 0 else m.end()
        plain = self.find(">", start)
        return plain + 1 if plain >= 0 else -1


def blocks(page: str) -> list[Block]:
    """The page's non-empty text blocks in order. Unclosed and stray end tags are tolerated; time is linear in the page."""
    out: list[Block] = []
    base = Frame("", 0, 0, 0, 0, 0, "")
    stack, opened, parts, tags = [base], Counter(), [], Tags(page)

    def flush() -> None:
        if not parts:
            return
        text = " ".join(html_lib.unescape("".join(x for _, x in parts)).split())
        if text:
            top, total = stack[-1], len(text.split(" "))
            linked = sum(len(html_lib.unescape(x).split()) for link, x in parts if link)
            out.append(Block(text, total, min(1.0, linked / total), int(top.boiler > 0), int(top.main > 0), int(top.heading > 0), int(top.named > 0), top.label))
        parts.clear()

    def say(a: int, b: int) -> None:
        if b > a:
            parts.append((stack[-1].links > 0, page[a:b]))

    def close(tag: str) -> None:
        while (top := stack.pop()).tag != tag:
            opened[top.tag] -= 1
        opened[tag] -= 1

    at, text_from, missing = 0, 0, set()
    while (lt := page.find("<", at)) >= 0 and ">" not in tags.never:
        m = _NAME.match(page, lt)
        if not m:
            if page.startswith(("<!", "<?"), lt):
                say(text_from, lt)
                mark = "-->" if page.startswith("<!--", lt) else "]]>" if page.startswith("<![CDATA[", lt) else ">"
                end = tags.find(mark, lt + 2)
                at = text_from = end + len(mark) if end >= 0 else len(page)
            else:
                at = lt + 1
            continue
        end = tags.end(m.end())
        if end < 0:
            break  # no tag ends any more, so what follows is text
        say(text_from, lt)
        at = text_from = end
        closing, tag, attrs = bool(m[1]), m[2].lower(), page[m.end() : end - 1]
        if not closing and tag in RAW_TAGS:
            if tag == "title":
                flush()
            found = RAW_TAGS[tag].search(page, at)
            after = tags.find(">", found.end()) + 1 if found else 0
            at = text_from = after or len(page)
            parts.append((stack[-1].links > 0, " "))
            continue
        if not closing and tag in CLOSED_TAGS and tag not in missing and not (tag == "svg" and attrs.endswith("/")):
            if found := CLOSED_TAGS[tag].search(page, at):
                at = text_from = found.end()
                parts.append((stack[-1].links > 0, " "))
                continue
            missing.add(tag)  # there is none further on
        if tag in BLOCK_TAGS:
            flush()
        if tag in VOID_TAGS or attrs.endswith("/") and tag not in BLOCK_TAGS:
            continue
        if closing:
            if opened[tag]:
                close(tag)
            continue
        if tag in ("p", "li", "td", "th", "tr", "dd", "dt", "option") and any(x.tag == tag for x in stack[-2:]):  # implied end tags
            close(tag)
        top = stack[-1]
        marks = [(k.lower(), a or b or c) for k, a, b, c in _MARKS.findall(attrs)] if "=" in attrs and tag not in SHELL_TAGS else ()
        boiler = tag in BOILER_TAGS or tag == "header" and not top.main or any(k == "role" and v.lower() in BOILER_ROLES for k, v in marks)
        named = tag not in QUOTE_TAGS and any(k != "role" and any(part_name(n, not top.main) for n in v.split()) for k, v in marks)
        keep = re.search(r'data-keep="(\d)"', attrs) if "data-keep" in attrs else None
        stack.append(Frame(tag, top.links + (tag == "a"), top.boiler + boiler, top.main + (tag in MAIN_TAGS), top.heading + (tag in HEADINGS), top.named + named, keep[1] if keep else top.label))
        opened[tag] += 1
    say(text_from, len(page))
    flush()
    return out


def features(found: list[Block]) -> np.ndarray:
    """One row a block, in the order of FEATURES; past either end of the page stands a block of no words.

    Plain blocks are those that are neither links nor in elements or parts that are named as no article. "plain words" counts
    those of the page, up to ENOUGH: without any, names tell nothing. "beside main": the page has a main text that the block
    is no part of.
    """
    if not found:
        return np.zeros((0, len(FEATURES)))
    own = np.array([(b.words, b.link_density) for b in found], float)
    ring = np.vstack([[(0, 0)], own, [(0, 0)]])
    flags = np.array([(b.in_boiler, b.in_main, b.heading, b.named) for b in found], float)
    plain = sum(b.words for b in found if not (b.in_boiler or b.named) and b.link_density <= LINKED)
    inside = sum(b.words for b in found if b.in_main and not (b.in_boiler or b.named) and b.link_density <= LINKED)
    page = np.array([(min(plain, ENOUGH), not b.in_main and inside >= ENOUGH) for b in found], float)
    return np.hstack([own, ring[:-2], ring[2:], flags, page])


#: The labelled table: data-keep tells whether the blocks in an element belong to the article. Names mislead in it on purpose
#: (essays in parts called comments or notices; menus, notices and adverts that have no name), and so do single
#: links and short lines within articles: what stands around a block has to tell.
_SHORT = "the market moved up the hill"
_PROSE = "the river rose in spring and the town moved its market up the hill where it has stayed ever since"
_LONG = f"{_PROSE} and {_PROSE} while {_SHORT}"
_ESSAY = f"{_LONG} then {_LONG} until {_LONG}"
_MENU = '<div data-keep="0"><ul><li><a href="/">Home</a></li><li><a href="/n">World news</a></li><li><a href="/s">Sport</a></li><li><a href="/w">Weather today</a></li></ul></div>'
_LEGAL = '<div data-keep="0"><a href="/k">Privacy</a> | <a href="/l">Contact us by mail</a></div>'
_OWN = f'<h1>Short title</h1><p>{_PROSE}</p><p>Yes.</p><p>{_LONG}</p><p>One <a href="/x">link</a></p><p>{_PROSE}</p>'


def said(n: int) -> str:
    """n words."""
    return " ".join((f"{_ESSAY} " * (n // 60 + 1)).split()[:n])


def spoken(n: int) -> list[str]:
    """Labelled pages with comments, sidebars, adverts and quotes of n words."""
    text = said(n)
    return [
        f'<article data-keep="1"><h1>Title</h1><p>{_PROSE}</p><p>{_LONG}</p><section id="comments" data-keep="0"><p>{text}</p><p>ok</p></section></article>',
        f'<div data-keep="1"><p>{_LONG}</p><p>{_PROSE}</p></div><div class="comments" data-keep="0"><div><p>{text}</p></div><div><p>{text} {_SHORT}</p></div></div>',
        f'<article data-keep="1"><p>{_PROSE}</p><div class="sidebar" data-keep="0"><p>{text}</p></div><p>{_LONG}</p><div class="ad" data-keep="0">{text}</div><p>It was late.</p></article>{_LEGAL}',
        f'<main data-keep="1"><p>{_LONG}</p><blockquote class="comment"><p>{text}</p></blockquote><p>{_PROSE}</p><p class="notice">{text}</p><p>No.</p></main>{_MENU}',
        f'{_MENU}<div class="comment" data-keep="1"><h1>Title</h1><p>{text} {_PROSE}</p><p>{text} {_LONG}</p></div>{_LEGAL}',
    ]


TRAINING_PAGES = (
    f'<nav data-keep="0"><ul><li><a href="/">Home</a></li><li>Weather</li></ul></nav><div class="ad" data-keep="0">Buy two shoes and pay for one today only.</div><article data-keep="1">{_OWN}</article><footer data-keep="0">&copy; a place. {_PROSE}</footer>',
    f'<header data-keep="0"><h1>Site name</h1><p>{_SHORT}</p></header><main data-keep="1"><h2>Flood</h2><p>No.</p><p>{_PROSE}</p><ul><li>first</li><li>second point</li></ul></main><aside data-keep="0"><h3>More</h3><p>{_LONG}</p><a href="/y">Read on</a></aside><form data-keep="0"><label>Name</label> {_PROSE}</form>',
    f'{_MENU}<div data-keep="1"><h1>Plain page</h1><p>{_PROSE}</p><p>Short line here.</p><p>{_LONG}</p></div><div class="comments" data-keep="0"><p>{_PROSE}</p><p>I agree.</p></div>{_LEGAL}',
    f'<div id="cookie-notice" data-keep="0"><p>We keep small files. {_PROSE}</p></div><article data-keep="1"><header><h1>Inside</h1><p>By a writer</p></header><p>{_PROSE}</p><p><a href="/z">{_PROSE}</a></p><div class="related" data-keep="0"><a href="/r">Related</a><p>{_PROSE}</p></div><section class="comments" data-keep="0"><p>{_PROSE}</p><p>ok</p></section></article>',
    f'<div class="sidebar" data-keep="0"><p>{_PROSE}</p><p>ok</p></div><p data-keep="1">{_PROSE}</p><p data-keep="1">Then it ended.</p><p data-keep="1">{_LONG}</p><footer data-keep="0"><p>Terms</p></footer>',
    f'<article data-keep="1"><h1>Title</h1><p>{_PROSE}</p><aside data-keep="0"><p>{_PROSE}</p><p>{_LONG}</p></aside><p>{_SHORT}</p><form data-keep="0">{_PROSE}</form><nav data-keep="0">{_SHORT}</nav><p>{_LONG}</p><footer data-keep="0"><p>{_SHORT}</p><p>{_PROSE}</p></footer></article>',
    f'<main data-keep="1"><p>{_PROSE}</p><dialog data-keep="0"><p>{_LONG}</p><p>{_ESSAY}</p></dialog><p>No.</p><aside data-keep="0">{_ESSAY}</aside></main><footer data-keep="0">{_ESSAY}</footer>',
    # names that mislead: long commentary, notices and a review of banners are articles; what readers say is shorter
    f'{_MENU}<div class="comment" data-keep="1"><p>{_ESSAY}</p><p>{_ESSAY}</p><p>{_ESSAY}</p></div>{_LEGAL}',
    f'<div class="notices" data-keep="1"><p>{_ESSAY}</p><p>{_ESSAY} {_LONG}</p><p>{_ESSAY} {_ESSAY}</p></div>',
    f'<article data-keep="1"><div class="banner"><p>{_ESSAY}</p><p>{_ESSAY}</p></div></article><footer data-keep="0"><p>{_SHORT}</p></footer>',
    f'<article data-keep="1"><p>{_LONG}</p></article><div id="comments" data-keep="0"><p>{_LONG}</p><p>{_LONG} {_PROSE}</p><p>{_LONG} {_LONG}</p><p>{_SHORT}</p></div>',
    f'<div data-keep="1"><p>{_LONG}</p><p>{_ESSAY}</p></div><div class="sidebar" data-keep="0"><p>{_LONG} {_PROSE}</p></div><div class="reader-comments" data-keep="1"></div><ul class="replies" data-keep="0"><li>{_LONG} {_PROSE}</li><li>{_PROSE}</li></ul>',
    # no names at all: menus, slogans and adverts above and below the text
    f'{_MENU}<div data-keep="0">Home News</div><div data-keep="0">Buy two shoes and pay for one today only.</div><div data-keep="1"><p>{_LONG}</p><p>Not so.</p><p>{_PROSE}</p></div><div data-keep="0">Back to top</div>{_LEGAL}',
    f'<div data-keep="0">Home News</div><div data-keep="0">Big sale of shoes, today only</div><div data-keep="1"><p>{_PROSE}</p><p>{_LONG}</p></div>{_MENU}<div data-keep="0">All times are local</div>',
    f'<div data-keep="0"><a href="/">Logo</a></div><div data-keep="0">The daily paper of the valley</div>{_MENU}<p data-keep="1">{_PROSE}</p><p data-keep="1">{_LONG}</p>{_MENU}<div data-keep="0">Printed in the valley</div>{_LEGAL}',
    f'<div data-keep="1"><p>{_LONG}</p><p>{_PROSE}</p></div><div data-keep="0"><a href="/d">Next page</a></div><div data-keep="0">Share</div>{_LEGAL}',
    # links: one between texts belongs to them, a run of them does not
    f'<article data-keep="1"><h1>A title of some words</h1><p><a href="/s">See here</a></p><p>{_PROSE}</p><p><a href="/t">One more of them here</a></p><p>{_LONG}</p></article><div data-keep="0"><a href="/u">Older</a></div>',
    f'<article data-keep="1"><p>{_PROSE}</p><p>{_LONG}</p><ul data-keep="0"><li><a href="/1">More of the town</a></li><li><a href="/2">More of the river</a></li><li><a href="/3">More of the hill</a></li><li><a href="/4">More of the market</a></li></ul></article>',
    f'<main data-keep="1"><p>{_LONG}</p><p>{_PROSE}</p><p>{_SHORT}</p><ul data-keep="0"><li><a href="/1">One more on this</a></li><li><a href="/2">More on that</a></li><li><a href="/3">And on those two</a></li></ul></main>',
    f'<article data-keep="1"><p>{_SHORT}</p><p>{_PROSE}</p><div data-keep="0"><a href="/1">Next</a></div><div data-keep="0"><a href="/2">Last</a></div></article>{_LEGAL}',
    f'<div data-keep="1"><p>{_LONG}</p><p><a href="/q">The report itself</a></p><p>{_LONG}</p></div>{_MENU}',
    f'{_MENU}<article data-keep="1"><p>No.</p><p>{_SHORT}</p><p><a href="/q">The report</a></p><p>It was late.</p><p><a href="/q">Its second part</a></p><p>So it was.</p><p>{_PROSE}</p></article>{_LEGAL}',
    f'<nav data-keep="0"><a href="/">Home</a></nav><article data-keep="1"><p>{_SHORT}</p><p>And so on</p><p><a href="/q">A source</a></p></article>{_MENU}',
    f'{_MENU}<main data-keep="1"><h1><a href="/self">A title that links to its page</a></h1><p>{_SHORT}</p><p>{_PROSE}</p><h2><a href="/self">Second part</a></h2><p>{_LONG}</p></main>{_MENU}',
    # what readers, sidebars and adverts say, however long, within the article and behind it; quotes are the article's own
    *(page for n in (20, 60, 130, 250, 500) for page in spoken(n)),
    # no article: a heading, short lines and the last ones belong to the long text that they stand beside
    f'{_MENU}<div data-keep="1"><h2>Head</h2><p>Yes.</p><p>{_LONG}</p><p>No.</p><p>Ok then.</p></div>{_LEGAL}',
    f'<div data-keep="0">Home News</div><div data-keep="1"><h2>A longer heading of the day</h2><p>{_PROSE}</p><h3>Then</h3><p>{_LONG}</p><p>So it ended.</p></div><div data-keep="0">Back to top</div>',
    f'<div data-keep="0"><a href="/">Logo</a></div><div data-keep="1"><h1>Flood</h1><p>{_ESSAY}</p><p>By a writer</p></div><div data-keep="0">Printed in the valley</div>{_LEGAL}',
    f'<div data-keep="1"><h2>Head</h2><p>Yes.</p><p>{_ESSAY}</p><p>No.</p></div>',
    f'<div data-keep="1"><h2>Head</h2><p>Yes.</p><p>{_LONG}</p><p>No.</p><p>Ok then.</p></div>',
    # a page that has a main text has no more of it elsewhere
    f'<div data-keep="0">Home News</div><article data-keep="1"><h1>Title</h1><p>{_PROSE}</p><p>{_LONG}</p></article><div data-keep="0">All times are local</div><div data-keep="0"><p>{_LONG}</p></div>',
    f'<div data-keep="0"><p>{_PROSE}</p></div><main data-keep="1"><p>{_PROSE}</p><p>So it was.</p><p>{_ESSAY}</p></main><div data-keep="0"><p>{_SHORT}</p></div>',
    # small pages
    '<article data-keep="1"><p>A.</p></article><footer data-keep="0">B.</footer>',
    '<nav data-keep="0"><a href="/">Home</a></nav><article data-keep="1"><h1>Two words</h1><p>No.</p></article><footer data-keep="0"><a href="/">Home</a> again</footer>',
    f'<nav data-keep="0"><a href="/">Home</a></nav><div class="ad" data-keep="0">Six small words for a sale</div><article data-keep="1"><p>Only this.</p></article><footer data-keep="0">{_SHORT}</footer>',
    f'<nav data-keep="0"><a href="/">Home</a></nav><div class="ad" data-keep="0">{_PROSE}</div><article data-keep="1"><p>a</p><p>b</p><p>{_SHORT}</p><p>c</p></article><footer data-keep="0">{_LONG}</footer>',
    f'<header data-keep="0"><a href="/">Logo</a> {_PROSE}</header><div data-keep="1"><p>{_PROSE}</p></div>',
    '<p data-keep="1">Only two words.</p>',
    f'<p data-keep="1">{_SHORT}</p>',
    f'<h1 data-keep="1">The first block of a page</h1><p data-keep="1">{_PROSE}</p><div data-keep="0"><a href="/v">To the top</a> <a href="/w">Archive of all months</a></div>',
    f'<div data-keep="1">{_PROSE} {_PROSE}<br>A line.<br><p>{_PROSE}</p></div>{_LEGAL}',
    f'<nav data-keep="0"><a href="/">Only a menu</a></nav>',
    f'<div class="newsletter" data-keep="0">{_SHORT}</div><h1 data-keep="1">A story</h1><p data-keep="1">{_LONG}</p><div class="widget" data-keep="0"><p>{_PROSE}</p></div><div class="promo" data-keep="0">{_PROSE}</div>',
)


class Node(NamedTuple):
    feature: int
    cut: float
    low: Node | None
    high: Node | None
    keep: float


def grow(x: np.ndarray, y: np.ndarray, depth: int = 14) -> Node:
    """A CART tree by Gini impurity; ties go to the first feature and the lowest cut."""
    keep = float(y.mean()) if len(y) else 0.0
    best: tuple[float, int, float] | None = None
    if depth and 0 < keep < 1:
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for cut in (values[:-1] + values[1:]) / 2:
                low = x[:, f] <= cut
                cost = sum(side.sum() * y[side].mean() * (1 - y[side].mean()) for side in (low, ~low))
                if best is None or cost < best[0] - 1e-12:
                    best = (cost, f, float(cut))
    if best is None:
        return Node(-1, 0.0, None, None, keep)
    low = x[:, best[1]] <= best[2]
    return Node(best[1], best[2], grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1), keep)


def decide(node: Node, x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), bool)
    todo = [(node, np.arange(len(x)))]
    while todo:
        n, rows = todo.pop()
        if n.feature < 0:
            out[rows] = n.keep >= 0.5
        else:
            low = x[rows, n.feature] <= n.cut
            todo += [(n.low, rows[low]), (n.high, rows[~low])]
    return out


def training_table() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of TRAINING_PAGES."""
    found = [blocks(p) for p in TRAINING_PAGES]
    return np.vstack([features(b) for b in found]), np.array([int(b.label) for bs in found for b in bs], float)


@cache
def model() -> Node:
    return grow(*training_table())


def used(tree: Node) -> set[str]:
    """The features that decide anywhere in the tree."""
    return set() if tree.feature < 0 else {FEATURES[tree.feature]} | used(tree.low) | used(tree.high)


def main_text(page: str | None, tree: Node) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, keep in zip(found, decide(tree, features(found)), strict=True) if keep)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, text, n_chars: one row a page."""
    tree = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [main_text(h, tree) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pick(pages, "page_id", "url", "html")
    return rows.mapInArrow(run, f"page_id {dict(rows.dtypes)['page_id']}, url string, text string, n_chars long")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))
