"""Main text of web pages, with site templates removed by subtree counts.

Every page is parsed into elements. An element's subtree is hashed from its name, text and
children. Spark counts, per host, on how many different pages a subtree occurs; one that
recurs on ``many`` or more, and on at least ``share`` of the host's pages, is part of the
site's template and is deleted, with all below it. Pages with the same html count once, so
copies of a page are no template. A page that would keep less than a fifth of its text
without its templates is a near copy of others: they are its body, and it keeps them.

What is kept is the article: the ``article`` or ``main`` elements if there are any, else the
body. Besides the templates, elements go whose name says that they are menus, headers,
footers, sidebars, forms, scripts or styles. A role, class or id is a weak sign: one of its
names must consist of such words and of words without a meaning of their own, so that
``site-header`` is a mark, and ``article-header`` or ``related-work`` isn't. No sign holds for an
element around the article, which is the longest one if all are in marked elements, or, on
pages without any, around the first ``h1``; a form that holds most of a page's text is no form.
Headings, paragraphs, list items, cells and parts of a line are content, however often they
recur by themselves.

Defined results: a null html is empty, and gives an empty text; a page without an article
or body is one block of its text; rows with equal html on one host get equal texts; null
ids and urls are returned as they are, the host of a null url being empty; a table without
rows gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.storage import written

# A quotation mark opens a value only after "="; what meets "<" before ">" is text.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/><]*)((?:[^>=<]++|=\s*+(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s><]*+))*+)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"(?<![^\s/\"'])([^\s=/>\"']+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search "
    "section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset(
    "script style noscript template iframe object svg math canvas audio video nav aside footer form button select "
    "textarea input label fieldset dialog menu title head noembed noframes xmp search".split()
)
STRONG = frozenset("nav aside footer header button select textarea menu".split())
CONTENT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre dd dt figcaption td th".split())
INLINE = frozenset("a b i em strong span u s small sub sup code mark q cite abbr time font big del ins kbd var".split())
CLOSES = {  # a start tag ends these open elements
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"},
}
SCOPE = frozenset("ul ol dl table td th div section article main body blockquote".split())
# Words in class, id and role that mark other parts of a page.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar "
    "navigation breadcrumb breadcrumbs header masthead footer sidebar aside widget widgets notice notices alert cookie "
    "cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login search comment comments "
    "commentlist respond disqus reply replies share sharing social related recommended toolbar pagination pager skip "
    "complementary contentinfo dialog form".split()
)
# Words that say nothing beside a mark.
NEUTRAL = frozenset(
    "site page main top bottom left right primary secondary global block box area wrap wrapper container list item items "
    "section bar link links content inner outer module panel unit slot group row col column js mobile desktop sticky "
    "fixed body text thread author meta posts button buttons icon icons media google dfp".split()
)
#: The share of a page's text that is left without its templates, at least.
LEAST = 0.2
_SPLIT = re.compile(r"[^a-z]+")
_CASE = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Element:
    __slots__ = ("name", "marked", "article", "inside", "start", "end", "parts", "parent")

    def __init__(self, name: str, marked: bool, inside: bool, start: int, parent: int):
        self.name, self.marked, self.inside, self.start, self.parent = name, marked, inside, start, parent
        self.article = name in ("article", "main")
        self.end, self.parts = start, [name]


def _marked(name: str, attributes: str, inside: bool) -> bool:
    if name in DROPPED or name == "header" and not inside:
        return True
    if attributes and name not in ("html", "body"):
        for m in _ATTRIBUTE.finditer(attributes):
            if m[1].lower() in ("class", "id", "role"):
                for one in unescape(m[2] or m[3] or m[4] or "").split():
                    words = {w for w in _SPLIT.split(_CASE.sub("-", one).lower()) if w}
                    if not MARKS.isdisjoint(words) and words <= MARKS | NEUTRAL:
                        return True
    return False


def _unmark(elements: list[Element], items: list[tuple[int, str]]) -> None:
    """Takes the mark from what is around the article."""
    length = np.concatenate([[0], np.cumsum([len(value) for _, value in items], dtype=np.int64)])
    size = lambda e: int(length[e.end] - length[e.start])
    dropped = [False] * len(elements)
    for k, e in enumerate(elements):
        dropped[k] = e.marked or e.parent >= 0 and dropped[e.parent]
    articles = [k for k, e in enumerate(elements) if e.article and not e.marked]
    core = -1
    if articles and all(dropped[k] for k in articles):
        core = max(articles, key=lambda k: (size(elements[k]), -k))
    elif not articles:
        core = next((k for k, e in enumerate(elements) if e.name == "h1"), -1)
    while core >= 0:
        e = elements[core]
        if e.name not in STRONG:
            e.marked = False
        core = e.parent
    for e in elements:
        if e.marked and e.name == "form" and 2 * size(e) > length[-1]:
            e.marked = False


def parse(html: str) -> tuple[list[Element], list[int], list[tuple[int, str]]]:
    """Elements in page order, subtree hashes by element (0: without text), and items:
    (number of elements begun, text), a line break between blocks being an empty text."""
    elements: list[Element] = []
    hashes: list[int] = []
    items: list[tuple[int, str]] = []
    stack: list[int] = []
    depths: dict[str, list[int]] = {}  # of each name's open elements: no tag searches the stack
    blocks: list[int] = []
    inside = 0

    def deepest(names: Iterable[str]) -> int:
        return max((depths[n][-1] for n in names if depths.get(n)), default=-1)

    def close() -> None:
        nonlocal inside
        k = stack.pop()
        e = elements[k]
        depths[e.name].pop()
        if e.name in BLOCK:
            blocks.pop()
        e.end = len(items)
        inside -= e.article
        has_text = len(e.parts) > 1
        if has_text:
            h = xxhash.xxh3_64_intdigest("\x00".join(e.parts)) or 1
            hashes[k] = h
            if stack:
                elements[stack[-1]].parts.append(f"\x01{h:x}")
        if e.name in BLOCK:
            items.append((k, ""))

    def text(raw: str) -> None:
        if raw and not (raw.isspace() and not items):
            value = unescape(raw)
            items.append((stack[-1] if stack else -1, value))
            if stack and not value.isspace():
                elements[stack[-1]].parts.append(value)

    at = 0
    while m := _TOKEN.search(html, at):
        slash, name = m[1], m[2]
        if m.start() > at:
            text(html[at : m.start()])
        at = m.end()
        if not name:
            continue
        name = name.lower()
        if slash:
            k = deepest((name,))
            if k >= 0 and not (name in INLINE and blocks and blocks[-1] > k):
                while len(stack) > k:
                    close()
            continue
        if name == "br":
            items.append((stack[-1] if stack else -1, " "))
            continue
        if name in BLOCK:
            k = deepest(("p",))
            if k > deepest(SCOPE):  # a block ends an open paragraph
                while len(stack) > k:
                    close()
            items.append((stack[-1] if stack else -1, ""))
        if name in CLOSES:
            k = deepest(CLOSES[name])
            if k > deepest(("ul", "ol", "dl", "table")):
                while len(stack) > k:
                    close()
        if name in VOID or m[3].endswith("/") and name in ("svg", "path"):
            continue
        if name in RAW:
            end = re.compile(f"</{name}", re.I).search(html, at)
            at = end.start() if end else len(html)
            continue
        elements.append(Element(name, _marked(name, m[3], inside > 0), inside > 0, len(items), stack[-1] if stack else -1))
        hashes.append(0)
        depths.setdefault(name, []).append(len(stack))
        if name in BLOCK:
            blocks.append(len(stack))
        stack.append(len(elements) - 1)
        inside += elements[-1].article
    if at < len(html):
        text(html[at:])
    while stack:
        close()
    _unmark(elements, items)
    return elements, hashes, items


def countable(elements: list[Element], hashes: list[int]) -> list[int]:
    """Hashes of the subtrees that can be a template: with text, no article around or
    below that would go with them, no page roots and no content elements. An
    element that is all its parent holds recurs with it, and isn't counted beside it."""
    holds = [False] * len(elements)
    for k, e in enumerate(elements):
        if e.article and not e.marked and not e.inside:
            while k >= 0 and not holds[k]:
                holds[k] = True
                k = elements[k].parent
    own = [
        bool(h)
        and not holds[k]
        and e.name not in ("html", "body")
        and not (e.name in CONTENT or e.name in INLINE or e.name == "li")
        for k, (e, h) in enumerate(zip(elements, hashes))
    ]
    out = set()
    for k, e in enumerate(elements):
        alone = e.parent >= 0 and own[e.parent] and len(elements[e.parent].parts) == 2
        if own[k] and not alone:
            out.add(hashes[k])
    return list(out)


def _clear(keep: np.ndarray, elements: list[Element], goes: list[bool]) -> None:
    upto = 0
    for e, gone in zip(elements, goes):
        if gone and e.end > upto:  # else it is inside one that went
            keep[e.start : e.end] = False
            upto = e.end


def main_text(html: str, template: set[int]) -> str:
    """The article's text, a line per block, without subtrees of the template."""
    elements, hashes, items = parse(html)
    allowed = set(countable(elements, hashes)) & template if template else set()
    keep = np.ones(len(items), dtype=bool)
    if any(e.article and not e.marked for e in elements):
        keep[:] = False
        for e in elements:
            if e.article and not e.marked and not e.inside:
                keep[e.start : e.end] = True
    _clear(keep, elements, [e.marked for e in elements])
    if allowed:
        left = keep.copy()
        _clear(left, elements, [h in allowed for h in hashes])
        size = np.array([len("".join(value.split())) for _, value in items], dtype=np.int64)
        if LEAST * size[keep].sum() <= size[left].sum():
            keep = left
    blocks, now = [], []
    for (_, value), ok in zip(items, keep):
        if value == "" or not ok:
            if now:
                blocks.append("".join(now))
                now = []
        if ok and value:
            now.append(value)
    blocks.append("".join(now))
    return "\n".join(x for x in (" ".join(b.split()) for b in blocks) if x)


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)", 1)
    return F.lower(found)


def templates(rows: DataFrame, many: int, share: float) -> DataFrame:
    """``page, subtree`` for each page's subtrees that belong to its host's template;
    ``rows`` has ``host`` and ``page`` (64-bit hashes, of the page with its host) and
    ``html``. Pages are parsed once for this; what they hold is written as two hashes a
    subtree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            host, page, sub, key = [], [], [], []
            for h, p, html in zip(*(c.to_pylist() for c in batch.columns)):
                elements, hashes, _ = parse(html)
                found = countable(elements, hashes)
                host += [h] * len(found)
                page += [p] * len(found)
                sub += found
                key += [xxhash.xxh3_64_intdigest(f"{h}/{x}") for x in found]
            signed = [pa.array(np.array(x, np.uint64).astype(np.int64)) for x in (sub, key)]
            whole = [pa.array(x, pa.int64()) for x in (host, page)]
            yield pa.RecordBatch.from_arrays([*whole, *signed], names=["host", "page", "subtree", "key"])

    schema = "host bigint, page bigint, subtree bigint, key bigint"
    found = written(rows.select("host", "page", "html").mapInArrow(run, schema), "subtrees")
    pages = found.groupBy("key", "page").agg(F.first("host").alias("host"))
    often = pages.groupBy("key").agg(F.count(F.lit(1)).alias("pages"), F.first("host").alias("host")).filter(F.col("pages") >= many)
    hosts = rows.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("all"))
    often = often.join(hosts, "host").filter(F.col("pages") >= F.col("all") * share)
    return found.select("page", "subtree", "key").join(often.select("key"), "key").select("page", "subtree")


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", many: int = 5, share: float = 0.3
) -> DataFrame:
    """One row per page: id, url, ``text`` and ``n_chars``."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).alias("_id"),
        F.col(url_col).alias("_url"),
        F.xxhash64(host_of(F.col(url_col))).alias("host"),
        F.xxhash64(host_of(F.col(url_col)), html).alias("page"),
        html.alias("html"),
    )
    own = templates(rows, many, share).groupBy("page").agg(F.collect_set("subtree").alias("subtrees"))

    @F.pandas_udf("string")
    def text(html, subtrees):
        import pandas as pd

        out = []
        for h, s in zip(html, subtrees):
            known = set() if s is None else set(np.asarray(s, dtype=np.int64).astype(np.uint64).tolist())
            out.append(main_text(h, known))
        return pd.Series(out)

    done = rows.drop("host").join(own, "page", "left").select("_id", "_url", text("html", "subtrees").alias("text"))
    return done.select(
        F.col("_id").alias(id_col), F.col("_url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars")
    )
