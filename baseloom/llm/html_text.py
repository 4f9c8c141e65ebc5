"""Main text of web pages by tag-path ratios.

A tolerant tokenizer gives text nodes with their path of tags from the root. Parts that are no content by their
element, role or class (menus, forms, scripts, adverts, notices, comments and so on) are left out first; a class or id
does not leave out what holds the article, the main element or most of the text. For each path the text length and the
punctuation per node are summed up; both ratios are smoothed over the nodes in page order with a Gaussian, fused by
multiplication, and paths above a share of the mean and deviation of all nodes are the content paths. The content is the text below the article element, or else below the closest common ancestor, that
holds the chosen paths; short headings inside it stay, as they belong to the article.

Character references are decoded, white space in a block becomes one space, blocks are trimmed and joined by one space
in page order. Whole pages are read.

Defined cases: null or empty html, and pages without text, give an empty text. Broken mark-up (open elements, cut
ends, stray ``<``) is read as browsers do in the main. Repeated rows are extracted each on its own; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame

from baseloom.llm.registry import query, table

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^'">]|"[^"]*"|'[^']*')*)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
# One attribute after the other: a value is read with its name, so its words are no names; a slash parts attributes.
_ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*)(?:\s*=\s*("[^"]*"?|'[^']*'?|[^\s>]+))?""")
_MARKS = re.compile(r"[.,;:!?。，、！？；：]")
_SPACE = re.compile(r"\s+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noframes xmp svg object canvas audio video".split())
# Elements and roles that never hold the article's text.
OUTSIDE = frozenset("head nav footer aside form menu dialog button select option datalist fieldset input annotation annotation-xml".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
# Words in class and id names that mark such parts.
MARKERS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent notice notification "
    "newsletter subscribe share sharing social related recommended sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead "
    "comment comments reply replies disqus respond widget popup modal overlay pagination pager toolbar login signup paywall skip outbrain taboola".split()
)
# First words of names that say what a layout has, such as has-sidebar; they mark nothing.
LAYOUT = frozenset("has have no not without with".split())
BLOCKS = frozenset(
    "address article aside blockquote body br canvas caption center col dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ENDS_P = BLOCKS - {"br", "body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "col", "option", "legend"}
_ITEMS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
MAIN = frozenset(["article", "main"])
# A path names no more levels; elements below share the path of their ancestor at that depth, so paths stay short.
DEEPEST = 512


class _Element:
    __slots__ = ("tag", "path", "parent", "outside", "main", "marked", "marks", "depth")

    def __init__(self, tag, parent, outside, main, marked=False):
        self.tag, self.parent, self.outside, self.main, self.marked = tag, parent, outside, main, marked
        self.marks = marked + (parent.marks if parent else 0)
        self.depth = parent.depth + 1 if parent else 0
        self.path = tag if not parent else f"{parent.path}/{tag}" if self.depth <= DEEPEST else parent.path


def _marked(value: str) -> bool:
    """Whether a class or id holds a marker."""
    if MARKERS.isdisjoint(re.split(r"[^a-z0-9]+", value)):
        return False
    names = (re.split(r"[^a-z0-9]+", name) for name in value.split())
    return any(n[0] not in LAYOUT and not MARKERS.isdisjoint(n) for n in names)


def _marks(tag: str, attributes: str, in_main: bool) -> tuple[bool, bool, bool]:
    """Whether an element is outside of content, whether it is a main container, and whether a class or id marks it."""
    outside = tag in OUTSIDE or (tag == "header" and not in_main)
    main, marked = tag in MAIN, False
    if attributes and not attributes.isspace():
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
            if name == "role":
                outside |= value in ROLES
                main |= value in ("main", "article")
            elif name == "itemprop":
                main |= value == "articlebody"
            elif name == "hidden":
                outside |= value != "until-found"
            elif name == "style":
                outside |= bool(re.search(r"display\s*:\s*none", value))
            elif name in ("class", "id") and tag not in ("html", "body", "article", "main"):
                marked |= _marked(value)
    return outside, main, marked


def _unmarked(elements: list[_Element], found: list[tuple[_Element, str, int]]) -> list[tuple[_Element, str, int]]:
    """The text nodes without those of marked elements.

    A mark does not count on an element that holds an article or main element; of several, those under the fewest marks are the
    page's. Inside these, or if there are none, it does not count on an element that holds most of the page's text. If no text
    is left, no mark counts.
    """
    if not any(e.marked for e in elements):
        return found
    size: dict[_Element, int] = defaultdict(int)
    for e, text, _ in found:
        size[e] += 0 if text.isspace() else len(text)
    total = sum(size.values())
    for e in reversed(elements):
        size[e.parent] += size[e]
    mains = [e for e in elements if e.main and not e.parent.main and size[e]]
    lifted = {e for e in elements if 2 * size[e] > total and (e.main or not mains)}
    least = min((e.marks for e in mains), default=0)
    for e in mains:
        if e.marks == least:
            lifted.update(_chain(e))
    gone: set[_Element] = set()
    for e in elements:
        if (e.marked and e not in lifted) or e.parent in gone:
            gone.add(e)
    left = [n for n in found if n[0] not in gone]
    return left if any(not t.isspace() for _, t, _ in left) else found


def nodes(page: str) -> list[tuple[_Element, str, int]]:
    """Text nodes in page order: element, decoded text, number of the block; parts outside content are left out."""
    root = _Element("#", None, False, False)
    elements: list[_Element] = []
    here, block, out, at, size = root, 0, [], 0, len(page)
    while at < size:
        lt = page.find("<", at)
        if lt != at:
            text = page[at : lt if lt >= 0 else size]
            if not here.outside:
                out.append((here, entities.unescape(text), block))
            if lt < 0:
                break
            at = lt
        after = page[lt + 1 : lt + 2]
        if after in ("!", "?"):
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = size if end < 0 else end + 3
            else:
                end = page.find(">", lt)
                at = size if end < 0 else end + 1
            continue
        m = (_TAG.match(page, lt) or _LOOSE.match(page, lt)) if after.isalpha() or after == "/" else None
        if m is None:
            if after.isalpha() or (after == "/" and page[lt + 2 : lt + 3].isalpha()):
                break  # a tag that the page's end cuts off
            if after == "/":
                end = page.find(">", lt)
                at = size if end < 0 else end + 1
                continue
            if not here.outside:
                out.append((here, "<", block))
            at = lt + 1
            continue
        at, tag = m.end(), m[2].lower()
        if tag in BLOCKS:
            block += 1
        if m[1]:
            up = here
            while up is not None and up.tag != tag:
                up = up.parent
            if up is not None:
                here = up.parent or root
            elif tag == "p":
                block += 1
            continue
        if tag in RAW:
            if not m[3].endswith("/") or tag in ("script", "style", "title", "textarea", "iframe"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.IGNORECASE).search(page, at)
                at = size if end is None else end.end()
            continue
        if tag in _ENDS_P:
            up = here
            while up is not None and up.tag != "p":
                up = None if up.tag in ("table", "td", "th", "li", "div", "article", "section", "main", "body", "blockquote") else up.parent
            if up is not None:
                here = up.parent
        if tag in _ITEMS:
            ends, within = _ITEMS[tag]
            up, last = here, None
            while up is not None and up.tag not in within:
                last = up if up.tag in ends else last
                up = up.parent
            if last is not None:
                here = last.parent
        if tag in VOID:
            continue
        in_main = here.main
        outside, main, marked = _marks(tag, m[3], in_main)
        here = _Element(tag, here, here.outside or outside, in_main or main, marked)
        elements.append(here)
    return _unmarked(elements, out)


def _smooth(values: list[float], reach: int = 2, sigma: float = 1.0) -> list[float]:
    kernel = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        lo, hi = max(0, i - reach), min(len(values), i + reach + 1)
        weights = kernel[lo - i + reach : hi - i + reach]
        out.append(sum(w * v for w, v in zip(weights, values[lo:hi])) / sum(weights))
    return out


def content_paths(found: list[tuple[_Element, str, int]], share: float = 0.5) -> set[str]:
    """Paths whose fused, smoothed ratio reaches mean minus deviation times ``share``, weighed by text."""
    length, marks, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for element, text, _ in found:
        length[element.path] += len(text)
        marks[element.path] += len(_MARKS.findall(text))
        count[element.path] += 1
    texts = _smooth([length[e.path] / count[e.path] for e, _, _ in found])
    points = _smooth([(1 + marks[e.path]) / count[e.path] for e, _, _ in found])
    fused = [a * b for a, b in zip(texts, points)]
    total = sum(len(t) for _, t, _ in found)
    mean = sum(f * len(t) for f, (_, t, _) in zip(fused, found)) / total
    deviation = math.sqrt(sum((f - mean) ** 2 * len(t) for f, (_, t, _) in zip(fused, found)) / total)
    cut = min(mean, max(mean - share * deviation, 0.1 * mean))
    best: dict[str, float] = defaultdict(float)
    for f, (e, _, _) in zip(fused, found):
        best[e.path] = max(best[e.path], f)
    return {p for p, f in best.items() if f >= cut}


def _chain(element: _Element) -> list[_Element]:
    out = []
    while element is not None:
        out.append(element)
        element = element.parent
    return out[::-1]


def main_text(page: str | None) -> str:
    """The article's text of one page."""
    if not page:
        return ""
    every = nodes(page)
    found = [n for n in every if n[1] and not n[1].isspace()]
    if not found:
        return ""
    good = content_paths(found)
    chosen = [n for n in found if n[0].path in good]
    if 2 * sum(len(t) for e, t, _ in chosen if e.main) >= sum(len(t) for _, t, _ in chosen):

        def wanted(e):
            return e.main

    else:
        top = chosen[0][0]
        for e in {id(e): e for e, _, _ in chosen}.values():
            while e.depth > top.depth:
                e = e.parent
            while top.depth > e.depth:
                top = top.parent
            while e is not top:
                e, top = e.parent, top.parent
        loose = top.tag in ("#", "html", "body")
        below = {top: not loose, None: False}

        def inside(e):
            """Whether an element lies in the top one, or, if that is the whole page, in a heading; known for all above it then."""
            up = []
            while e not in below:
                up.append(e)
                e = e.parent
            known = below[e]
            for x in reversed(up):
                below[x] = known = known or (loose and x.tag in HEADINGS)
            return known

        def wanted(e):
            return (loose and e.path in good) or inside(e)

    # White space between inline elements counts, so all nodes are walked, not only those with text.
    blocks: dict[int, list[str]] = defaultdict(list)
    for element, text, block in every:
        if wanted(element):
            blocks[block].append(text)
    parts = (_SPACE.sub(" ", "".join(b)).strip() for b in blocks.values())
    return " ".join(p for p in parts if p)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page."""
    id_type = pages.schema["page_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {id_type}, url string, text string, n_chars long")


@query("op2_html_text")
def op2_html_text(spark, d):
    return extract(table(spark, d, "pages"))
