"""Main text of web pages by tag-path ratios.

A page is cut into blocks, the text between starts and ends of block-level elements. A block's path leads from the root to its
container: paragraphs, headings, lists, tables, sections and their parts belong to the element around them, unless their name is a hint. Text length and
punctuation of all blocks of one path are added up and divided by the path's blocks, and both ratios are smoothed over the
paths in page order and fused: the root of the length, times one to three by how near punctuation comes to that of prose.

1. Where the article is: ratios are weighed by the share of text outside of links, and by HINTED behind a hint, a name like those in HINTS on an element without
   the page's heading. The article is the outermost `article` and `main` elements if together they hold half of the text so weighed, else the innermost element that holds
   all paths of CONTENT of the mean ratio or more, and the page's h1.
2. What of it stays: a path stays with KEEP of the mean ratio and more, the mean being that of the article's own paths, behind no hint, weighed by length; lists and tables
   with half of that. Paths behind a hint are weighed by HINTED and held against the same bar, however much text there is; paths outside of the article
   by OUTSIDE. Headings stay with what follows them. Links count as text here, as an article's list of sources does; but a list of links only, without
   a heading, is a menu where no tag marks the article or where its path has nothing else.

Only scripts, styles, forms and the like, and HTML's own page parts (header, footer, nav, aside), go without being weighed.

Defined cases: null and empty html, and pages without any text in the body or with none but in menus, give an empty text;
unclosed elements end with the page; pages of any length are read whole; paths of equal ratio are kept or dropped together; repeated rows each get a row; null ids and
urls are kept; other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

# Elements of HTML by how they are shown.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea select iframe object svg math canvas audio video button title".split())
#: Start tags of these close an open p, and those of a pair an open sibling.
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
#: Parts of a page by tag and role that are no article text.
LEFT_OUT = frozenset("header footer nav aside form head menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Words of classes and ids that hint at other parts. A name of several words hints if all are of these or ENDINGS, or if its last is one of these but not WEAK.
HINTS = frozenset(
    """ad ads advert adverts advertisement advertising adslot adsense adbox sponsor sponsors sponsored promo promos promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay
    sidebar rail widget comment comments commentlist disqus discussion reply replies responses respond nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar header masthead topbar footer
    copyright subscribe newsletter signup login share sharing social related recommended form forms""".split()
)
WEAK = frozenset("header masthead widget banner alert".split())
ENDINGS = frozenset("area bar block box button buttons container count feed footer header item items label links list meta post posts section site slot thread text top unit widget wrap wrapper".split())
#: Words before a hint that deny it.
DENIALS = frozenset("no has with without hide".split())
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>?|([^<]+)|(<)""", re.DOTALL)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([^\s=/"'>]+)""")
PUNCTUATION = re.compile(r"""[.,;:!?'"()–—…“”‘’«»、。，；：！？]""")
#: Shares of the mean ratio: from which a path shows where the article is, and from which its blocks are kept.
CONTENT, KEEP = 0.5, 0.2
#: Weights of paths behind a hint, and outside of the article.
HINTED, OUTSIDE = 0.004, 0.1
#: Characters of prose for each punctuation mark.
PROSE = 40
#: Weight of the path itself in smoothing; the rest is its neighbours'.
OWN_WEIGHT = 0.95
#: Elements whose text belongs to the element around them.
PARTS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption colgroup thead tbody tfoot tr td th pre blockquote figure figcaption details summary address center hgroup section".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol dl table pre figure".split())


def is_hint(name: str) -> bool:
    words = [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+|[^\W\d_]+", name)]
    if not words or words[0] in DENIALS:
        return False
    found = [w in HINTS for w in words]
    return any(found) and all(f or w in ENDINGS for f, w in zip(found, words, strict=True)) or found[-1] and words[-1] not in WEAK


class Block(NamedTuple):
    path: tuple[int | str, ...]  # labels from the root to the container
    elements: tuple[int, ...]  # numbers of the open block-level elements, outermost first
    text: str
    left_out: bool
    linked: int  # characters in links


class Element(NamedTuple):
    tag: str
    label: str
    number: int
    out: bool
    hint: bool


def blocks_of(page: str) -> tuple[list[Block], dict[int, str], set[int]]:
    """Blocks in page order, the tag of each block-level element by number, and the elements whose name is a hint."""
    blocks: list[Block] = []
    tags: dict[int, str] = {}
    hints: set[int] = set()
    stack: list[Element] = []
    parts: list[str] = []
    linked, in_link, at = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                path = tuple([e.label for e in stack if e.hint or e.tag not in PARTS])
                blocks.append(Block(path, tuple([e.number for e in stack]), text, any(e.out for e in stack), linked))
            parts.clear()
        linked = 0

    def close(to: int) -> None:
        flush()
        del stack[to:]

    while m := TOKEN.match(page, at):
        at = m.end()
        ended, tag, attributes, text, sign = m.groups()
        if text or sign:
            parts.append(text or sign)
            linked += len(text or sign) if in_link else 0
            continue
        if not tag:
            continue
        tag = tag.lower()
        if tag in RAW:
            if not ended and not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(page, at)
                at = end.end() if end else len(page) if tag in ("script", "style") else at
            continue
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                in_link = int(not ended)
            continue
        if tag in VOID:
            flush()
            continue
        if ended:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
            else:
                flush()
            in_link = 0
            continue
        flush()
        if tag in CLOSES_P and stack and stack[-1].tag == "p":
            close(len(stack) - 1)
        while tag in SIBLINGS and stack and stack[-1].tag in SIBLINGS[tag]:
            close(len(stack) - 1)
        if tag == "body":
            for i, e in enumerate(stack):
                if e.tag == "head":
                    close(i)
                    break
        given = {(x[0] or x[4]).lower(): unescape(x[1] or x[2] or x[3]) for x in ATTRIBUTE.findall(attributes)} if attributes.strip(" /") else {}
        name = f"{given.get('class', '')} {given.get('id', '')}".strip()
        hint = tag not in ("html", "body") and any(map(is_hint, name.split()))
        inside = any(e.tag in ("article", "main") for e in stack)
        out = (
            tag in LEFT_OUT and not (tag == "header" and inside)
            or given.get("role", "").lower() in ROLES
            or "hidden" in given
            or given.get("aria-hidden") == "true"
            or "display:none" in given.get("style", "").replace(" ", "").lower()
        )
        if tag != "html" or not stack:
            number = len(tags)
            tags[number] = tag
            if hint:
                hints.add(number)
            if not attributes.endswith("/"):
                stack.append(Element(tag, f"{tag}.{name}" if name else tag, number, out, hint))
    flush()
    return blocks, tags, hints


def path_sums(blocks: list[Block]) -> dict[tuple, list[float]]:
    """Of each path, in page order: characters, punctuation marks, blocks, characters in links."""
    sums: dict[tuple, list[float]] = {}
    for b in blocks:
        mine = sums.setdefault(b.path, [0.0, 0.0, 0.0, 0.0])
        mine[0] += len(b.text)
        mine[1] += len(PUNCTUATION.findall(b.text))
        mine[2] += 1
        mine[3] += min(b.linked, len(b.text))
    return sums


def length_and_marks(blocks: list[Block]) -> dict[tuple, tuple[float, float]]:
    """Of each path: characters and punctuation marks for each block, smoothed over the paths before and after it."""
    ratios = [(x[0] / x[2], x[1] / x[2]) for x in path_sums(blocks).values()]
    out = {}
    for i, path in enumerate(path_sums(blocks)):
        near = [(ratios[j], w) for j, w in ((i - 1, (1 - OWN_WEIGHT) / 2), (i, OWN_WEIGHT), (i + 1, (1 - OWN_WEIGHT) / 2)) if 0 <= j < len(ratios)]
        whole = sum(w for _, w in near)
        out[path] = (sum(r[0] * w for r, w in near) / whole, sum(r[1] * w for r, w in near) / whole)
    return out


def fused_ratios(blocks: list[Block]) -> dict[tuple, float]:
    return {path: length**0.5 * (1 + 2 * min(1.0, PROSE * marks / max(1.0, length)) ** 2) for path, (length, marks) in length_and_marks(blocks).items()}


def mean_ratio(blocks: list[Block], weighed: list[float]) -> float:
    return sum(len(b.text) * w for b, w in zip(blocks, weighed, strict=True)) / max(1, sum(len(b.text) for b in blocks))


def articles_of(blocks: list[Block], weighed: list[float], tags: dict[int, str], hints: set[int]) -> tuple[set[int], bool]:
    """Numbers of the elements that are the article, none if that is the whole page, and whether their tags say so."""
    mass: dict[int, float] = {}  # of the outermost article and main elements
    for b, w in zip(blocks, weighed, strict=True):
        top = next((e for e in b.elements if tags[e] in ("article", "main")), None)
        if top is not None and hints.isdisjoint(b.elements[: b.elements.index(top)]):
            mass[top] = mass.get(top, 0.0) + len(b.text) * w
    if mass and 2 * sum(mass.values()) >= sum(len(b.text) * w for b, w in zip(blocks, weighed, strict=True)):
        return {e for e, m in mass.items() if m > 0}, True
    cut = CONTENT * mean_ratio(blocks, weighed)
    content = [b.elements for b, w in zip(blocks, weighed, strict=True) if w >= cut or b.elements and tags[b.elements[-1]] == "h1"]
    best: set[int] = set()
    for level in zip(*content, strict=False):
        if len(set(level)) > 1 or tags[level[0]] in PARTS and tags[level[0]] != "section":
            break
        best = {level[0]}
    return best, False


def bare_link_lists(blocks: list[Block], tags: dict[int, str]) -> set[int]:
    """Outermost lists with nothing but links, and no heading or colon right before them."""
    lists: dict[int, list[int]] = {}
    first: dict[int, int] = {}
    for i, b in enumerate(blocks):
        top = next((e for e in b.elements if tags[e] in ("ul", "ol")), None)
        if top is not None:
            first.setdefault(top, i)
            mine = lists.setdefault(top, [0, 0])
            mine[0] += len(b.text)
            mine[1] += min(b.linked, len(b.text))
    headed = {e for e, i in first.items() if i and blocks[i - 1].elements and (tags[blocks[i - 1].elements[-1]] in HEADINGS - {"h1"} or blocks[i - 1].text.endswith(":"))}
    return {e for e, (size, linked) in lists.items() if linked >= 0.9 * size} - headed


def main_text(page: str | None) -> str:
    blocks, tags, hints = blocks_of(page or "")
    shown = [b for b in blocks if not b.left_out]
    if not shown:
        return ""
    titled = {e for b in shown for e in b.elements[:-1] if b.elements and tags[b.elements[-1]] == "h1"} | {e for b in shown for e in b.elements if tags[e] == "main"}
    hints -= titled
    ratios, links = fused_ratios(shown), {path: x[3] / x[0] for path, x in path_sums(shown).items()}
    first = [ratios[b.path] * (1 - links[b.path]) * (1.0 if hints.isdisjoint(b.elements) else HINTED) for b in shown]
    articles, marked = articles_of(shown, first, tags, hints)
    menus = bare_link_lists([b for b in shown if links[b.path] >= 0.9] if marked else shown, tags)
    weighed, own = [], []
    for b in shown:
        at = next((i for i, e in enumerate(b.elements) if e in articles), None)
        hinted = not hints.isdisjoint(b.elements if at is None else b.elements[at + 1 :])
        outside = at is None and bool(articles)
        menu = not menus.isdisjoint(b.elements)
        weighed.append(0.0 if menu else ratios[b.path] * (HINTED if hinted else 1.0) * (OUTSIDE * (1 - links[b.path]) if outside else 1.0))
        own.append(not (hinted or outside or menu))
    mine = [i for i, x in enumerate(own) if x] or range(len(shown))
    cut = KEEP * mean_ratio([shown[i] for i in mine], [weighed[i] for i in mine])
    kept: list[bool] = []
    for i in range(len(shown) - 1, -1, -1):
        b, bar = shown[i], cut / 2 if any(tags[e] in LISTS for e in shown[i].elements) else cut
        heading = bool(b.elements) and tags[b.elements[-1]] in HEADINGS
        kept.append(weighed[i] >= bar > 0 or heading and own[i] and (tags[b.elements[-1]] == "h1" or bool(kept) and kept[-1]))
    return "\n".join([b.text for b, k in zip(shown, reversed(kept), strict=True) if k])


def page_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars."""
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"{id_col} {kinds[id_col]}, {url_col} {kinds[url_col]}, text string, n_chars long")
