"""Main text of web pages by tag-path ratios.

A page is cut into blocks of text, each with the path of tags that leads to it. Text, punctuation and link text are summed by path; a
path's worth is its text per block times its punctuation per block, without its share of links. Worths are smoothed along the page, so
that a path amid text gains and one amid menus loses, and both are fused. Paths near the worth of the page's text by weight are content; what
lies in the same container, as headings and short items do, stays with them. Parts that say what they are, by tag, role or
class, as menus, adverts, notices, forms and comments do, don't compete.

A page is a row and needs no other, so all this is a map: nothing is shuffled, and a host with a third of all pages is as good as any.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from emberline.llm.common import table

# Kinds of tags, and words in class, id and role that name a part which is no article.
RAW = {"script", "style", "textarea", "title", "xmp", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img label nobr output".split())
NO_TEXT = set("head script style title noscript template iframe object svg canvas audio video map noframes textarea xmp".split())
ASIDE = set("nav footer aside form dialog menu button select fieldset search".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
PARTS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promos promotion banner sidebar rail nav navbar navigation menu menus breadcrumb breadcrumbs header masthead topbar footer "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login comment comments commentlist respond replies discussion disqus share sharing social "
    "related recommended recommendations widget widgets toolbar pagination pager copyright legal disclaimer search complementary contentinfo form dialog".split()
)
ENDS_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
ROOTS = {"article", "main"}

_ATTRIBUTES = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"
TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)(?:({_ATTRIBUTES})>|([^>]*)>)", re.S)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
MARKS = re.compile(r"[.,;:!?、。，]")
#: Share of the page's worth from which a path is content, share of link text beyond which a block is a menu, and spread of smoothing in blocks.
LEAST, MOST_LINKS, SPREAD = 0.25, 0.6, 1.0
KERNEL = np.exp(-0.5 * (np.arange(-3, 4) / SPREAD) ** 2)
KERNEL /= KERNEL.sum()


@dataclass
class Element:
    tag: str
    path: tuple[str, ...]
    up: int
    off: bool = False  # says that it is no article
    named: bool = False  # only by its class, id or role
    holds_root: bool = False


@dataclass
class Block:
    element: int
    parts: list[str] = field(default_factory=list)
    linked: int = 0


def names_part(attributes: str) -> tuple[bool, str]:
    """Whether class, id or role name a part that is no article; and the first class."""
    found, first = False, ""
    for name, *values in NAMED.findall(attributes):
        value = next((v for v in values if v), "")
        if name.lower() == "class" and value.split():
            first = value.split()[0].lower().rstrip("0123456789")
        found |= any(w.lower() in PARTS for w in WORD.findall(value))
    return found, first


def page_blocks(page: str) -> tuple[list[Element], list[Block]]:
    """Elements and, in page order, blocks of text: what stands between two block-level tags. Inline tags don't end a block; tags that are left open end as browsers end them."""
    elements, blocks, stack = [Element("", (), -1)], [], [0]
    state = {"block": None, "link": 0}

    def text(raw: str) -> None:
        if raw:
            if state["block"] is None or state["block"].element != stack[-1]:
                state["block"] = Block(stack[-1])
                blocks.append(state["block"])
            state["block"].parts.append(raw)
            state["block"].linked += len(raw.strip()) * bool(state["link"])

    def shut(k: int) -> None:
        del stack[k:]
        state["block"] = None

    def open_(tag: str, attributes: str) -> None:
        found, first = names_part(attributes) if attributes else (False, "")
        above = elements[stack[-1]]
        role_free = tag in ROOTS or tag in ("html", "body", "")
        # The header of an article holds its heading, the header of a page doesn't.
        off = tag in ASIDE or tag in NO_TEXT or (tag == "header" and not any(elements[e].tag in ROOTS for e in stack))
        named = found and (not role_free or (tag == "article" and bool(re.search(r"comment|repl|respon", attributes, re.I))))
        elements.append(Element(tag, (*above.path, f"{tag}.{first}" if first else tag), stack[-1], off, named))
        if tag in ROOTS and not named:
            for e in stack:
                elements[e].holds_root = True
        stack.append(len(elements) - 1)
        state["block"] = None

    at = 0
    while m := TAG.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        closing, tag, attributes = m.group(1), (m.group(2) or "").lower(), m.group(3) or m.group(4) or ""
        if not tag:
            continue
        if tag == "br":
            text(" ")
        elif tag in INLINE or (tag in VOID and tag != "hr"):
            if tag == "a":
                state["link"] = 0 if closing else 1
        elif closing:
            k = next((k for k in range(len(stack) - 1, 0, -1) if elements[stack[k]].tag == tag), 0)
            if k:
                shut(k)
            else:
                state["block"] = None
        else:
            if tag in ENDS_P and (k := next((k for k in range(len(stack) - 1, 0, -1) if elements[stack[k]].tag == "p"), 0)) and not any(elements[e].tag in ("table", "button", "object") for e in stack[k:]):
                shut(k)
            if tag in CLOSES:
                ended, bounds = CLOSES[tag]
                hit = 0
                for k in range(len(stack) - 1, 0, -1):
                    if elements[stack[k]].tag in bounds:
                        break
                    if elements[stack[k]].tag in ended:
                        hit = k
                if hit:
                    shut(hit)
            if tag == "hr":
                state["block"] = None
                continue
            open_(tag, attributes)
            if tag in RAW:  # nothing within is a tag
                end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
                at = end.start() if end else len(page)
    text(page[at:])
    return elements, blocks


def content(elements: list[Element], blocks: list[Block]) -> list[str]:
    """The texts of the blocks that belong to the article."""
    # Elements come after those that they lie in.
    off, kind = [False] * len(elements), [""] * len(elements)
    for k, e in enumerate(elements[1:], 1):
        off[k] = off[e.up] or (e.off and not (e.tag == "form" and e.holds_root)) or (e.named and not e.holds_root)
        # What an element is for its blocks: no text, heading, within a header, or nothing special.
        kind[k] = "none" if e.tag in NO_TEXT else kind[e.up] if kind[e.up] in ("none", "heading") else "heading" if e.tag in HEADINGS else "header" if e.tag == "header" else kind[e.up]
    kept = []
    for b in blocks:
        if kind[b.element] != "none" and (plain := " ".join(html.unescape("".join(b.parts)).split())):
            kept.append((b, plain))
    # Within an article's header only its headings count.
    free = [(b, t) for b, t in kept if not off[b.element] and kind[b.element] != "header"]
    if not free:  # a page that is all form or all menu is read as it is
        free = [(b, t) for b, t in kept if not elements[b.element].named]
    if not free:
        return []
    home = [container(elements, b.element) for b, _ in free]
    rooted = np.array([elements[h].tag in ROOTS for h in home])
    chars = np.array([len(t) for _, t in free], float)
    if 2 * chars[rooted].sum() >= chars.sum():  # what an article says of itself holds for the rest of the page too
        free, home, chars = ([x for x, r in zip(free, rooted, strict=True) if r], [h for h, r in zip(home, rooted, strict=True) if r], chars[rooted])
    place: dict[tuple[str, ...], int] = {}
    path = np.array([place.setdefault(elements[b.element].path, len(place)) for b, _ in free])
    marks = np.array([len(MARKS.findall(t)) for _, t in free], float)
    links = np.minimum(1.0, np.array([b.linked for b, _ in free]) / chars)
    sums = lambda x: np.bincount(path, x, len(place))
    n, total = sums(np.ones(len(path))), sums(chars)
    share = sums(links * chars) / total
    worth = total / n * (1 + sums(marks) / n) * (1 - share)
    # Smoothed along the page and fused with what stands on its own.
    smooth = np.convolve(np.pad(worth[path], 3, mode="edge"), KERNEL, "valid")
    fused = np.sqrt(worth * sums(smooth) / n)
    chosen = ((fused >= LEAST * (fused * total).sum() / total.sum()) & (share <= MOST_LINKS))[path]
    homes = {h for h, c in zip(home, chosen, strict=True) if c}
    take = [c or (h in homes or under(elements, b.element, homes)) for (b, _), h, c in zip(free, home, chosen, strict=True)]
    heading = [kind[b.element] == "heading" for b, _ in free]
    for k in range(len(free) - 2, -1, -1):  # a heading right before content belongs to it
        take[k] = take[k] or (heading[k] and take[k + 1])
    return [t for k, (_, t) in enumerate(free) if take[k] and (heading[k] or share[path[k]] <= MOST_LINKS)]


def container(elements: list[Element], at: int) -> int:
    """The element that a block shares with its headings and lists: the outermost article or main around it, else the one right above its own, but for the body, which holds all."""
    k, root = at, -1
    while k > 0:
        if elements[k].tag in ROOTS and not elements[k].named:
            root = k
        k = elements[k].up
    up = elements[at].up
    return root if root > 0 else at if up <= 0 or elements[up].tag in ("body", "html") else up


def under(elements: list[Element], at: int, homes: set[int]) -> bool:
    while at > 0:
        if at in homes:
            return True
        at = elements[at].up
    return False


def main_text(page: str | None) -> str:
    return "\n\n".join(content(*page_blocks(page))) if page else ""


@F.pandas_udf(StringType())
def _main_texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for b in batches:
        yield b.map(main_text)


def extract_text(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """pages with the main text of each: blocks in page order, joined by an empty line; character references decoded, white space within a block one space.

    A null or empty page, or one without text, gives an empty text. Rows that repeat are extracted each by itself; an empty table gives no rows. An
    input column with the name of the result is replaced."""
    return pages.withColumn(text_col, _main_texts(F.col(html_col)))


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
