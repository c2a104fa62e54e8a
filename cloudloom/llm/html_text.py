"""Main text of web pages by tag-path ratios.

A page is read as text nodes with their root-to-leaf tag paths. Per path, text length and punctuation are summed and
divided by the path's nodes; both ratios are smoothed over neighbouring nodes in page order, fused with each other and
with the share of text outside links, and thresholded at a share of the page's own mean. What an element says of itself
(menus, forms, notices and so on, by class, id or role, and forms) only lowers the fused ratio of the paths under it, so a page
that lies in such an element as a whole loses nothing, and prose under a misleading name can still pass; it says nothing of
an element that holds half of the page's text and its title, article or main element. Texts after the last article or main element
whose paths come in turns again and again, as readers' remarks under their names do, are lowered alike, whatever they are called. Only elements
that never hold a page's main text by their definition (nav, footer, aside, buttons, a header outside an article) have no
ratio, as has what a browser shows no text of: scripts, styles, templates, hidden elements. Nodes over the threshold are the content, wherever they
lie. What is too short for a ratio is rescued where it is mostly text outside links: a run of nodes of one path, or a whole list
or table, that touches a node over the threshold in an article or main element, or lies between two such nodes or under a heading
right after one elsewhere; and headings that a chosen node follows.

Reading a page takes time in proportion to its length, whatever its tags: every look at the open elements is a look at a
table kept for it, or closes what it passes.

Edge cases: a null or empty page, or one without content, has an empty text; unclosed and stray tags, comments and character
references without an end are read as browsers do; a page of any length is read whole; repeated rows are extracted each;
other columns are kept, those of clashing names too; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, small_batches

# HTML elements by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp".split())
UNSEEN = frozenset("head template svg math canvas object audio video picture map datalist dialog".split())
ASIDE = frozenset("nav footer aside button select option menu".split())
FORMS = frozenset("form fieldset label".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
HOLDERS = frozenset("article main".split())
# Elements that a start tag closes, if they are open, up to the nearest of the limits.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
CLOSE_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
# Words of a class, id or role that mark what is no main text.
NOISE = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|banner|breadcrumbs?|comments?|commentlist|commentsection|commentthread|cookies?|cookie(?:bar|banner|box|law|notice|wall)|consent|consent(?:banner|bar|box)|copyright|disqus|disclaimer|footer|gdpr|gdpr(?:banner|bar|box|notice)|masthead|menu|menubar|modal|nav|navbar|navigation|newsletter|notices?|overlay|pagination|pager|popup|promo|promoted|recommended|related|replies|respond|share|sharing|sidebar|signup|skip|social|sponsor|sponsored|subscribe|toolbar|widget|contentinfo|complementary)(?:$|[\s_-])", re.I)
# Words that mark it only outside an article or main element: inside, they name its own parts.
NOISE_OUTSIDE = re.compile(r"(?:^|[\s_-])(?:header|discussion|feedback|guestbook|responses)(?:$|[\s_-])", re.I)

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+)>", re.S)
SIMPLE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+>", re.I) for t in RAW}
ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
QUOTED = re.compile(r"=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]++)")
HIDDEN = re.compile(r"aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
BARE_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|/|$)", re.I)
PUNCTUATION = ".,;:!?。，…"
LISTS = frozenset("ul ol dl table".split())
#: What is left of a path's ratio under each element that names itself no main text.
PRIOR = 0.02


@dataclass(slots=True)
class Node:
    """A text node: its path's number, its block's number, its text, and where it lies."""

    path: int
    block: int
    text: str
    linked: bool  # in a link
    held: bool  # in an article or main element
    noisy: int  # elements around it that name themselves no main text
    heading: int  # its level, 0 for none
    run: int  # the number of its outermost list or table, else of its path


class Open(NamedTuple):
    """An open element, with what holds for the text in it."""

    tag: str
    path: int
    unseen: bool
    noisy: int  # the number of the innermost element around it that names itself no main text
    linked: bool
    held: bool
    heading: int
    run: int  # 0: no list around it
    p: int  # place of the nearest open p that only inline elements cover, else -1
    closable: tuple[int, ...]  # of each tag in CLOSES, place of the outermost open element that it closes, else -1


ROOT = Open("", 0, False, 0, False, False, 0, 0, -1, (-1,) * len(CLOSES))
CLOSING = list(CLOSES.items())
SPECIAL = frozenset().union(*(own | limits for own, limits in CLOSES.values()))


@lru_cache(4096)
def _said(attributes: str) -> tuple[str, bool, bool, bool]:
    """What attributes say: class, id and role in one text, whether these name no main text, or none outside an article, whether the element is hidden."""
    marks = " ".join(x or y or z for x, y, z in ATTRIBUTE.findall(attributes)) if "=" in attributes else ""
    hidden = HIDDEN.search(attributes) is not None or BARE_HIDDEN.search(QUOTED.sub(" ", attributes)) is not None
    return marks, NOISE.search(marks) is not None, NOISE_OUTSIDE.search(marks) is not None, hidden


def _pushed(above: Open, tag: str, attributes: str, at: int, number: dict[tuple[int, str], int], around: list[int]) -> Open:
    """The element that a start tag opens under another one, as the at-th of the open ones."""
    marks, named, outside, hidden = (_said(attributes) if len(attributes) < 1000 else _said.__wrapped__(attributes)) if attributes else ("", False, False, False)
    inline = tag in INLINE
    path = above.path if inline else number.setdefault((above.path, f"{tag}.{marks}"), len(number) + 1)
    unseen = tag in UNSEEN or tag in ASIDE or tag == "header" and not above.held
    noisy = tag in FORMS or ((named or outside and not above.held) and tag not in ("html", "body", "article", "main"))
    if noisy:
        around.append(above.noisy)
    p = at if tag == "p" else above.p if inline else -1
    closable = above.closable
    if tag in SPECIAL:
        closable = tuple((at if now < 0 else now) if tag in own else -1 if tag in limits else now for now, (_, (own, limits)) in zip(closable, CLOSING))
    return Open(tag, path, above.unseen or hidden or unseen, len(around) - 1 if noisy else above.noisy, above.linked or tag == "a", above.held or tag in HOLDERS,
                above.heading if inline else int(tag[1]) if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456" else 0, above.run or (path if tag in LISTS else 0), p, closable)


def nodes(html: str) -> list[Node]:
    """The text nodes of a page in page order."""
    out: list[Node] = []
    stack: list[Open] = [ROOT]
    count: Counter[str] = Counter()  # of open elements, by tag
    number: dict[tuple[int, str], int] = {}  # of the paths
    around = [0]  # of each element that names itself no main text, the one around it; 0 is none
    titled: set[int] = set()  # those right around a title, article or main element
    block, at, end = 0, 0, len(html)

    def close(to: int) -> None:
        for x in stack[to:]:
            count[x.tag] -= 1
        del stack[to:]

    last = html.rfind(">")
    while at < end:
        m, begin = None, at
        while (begin := html.find("<", begin)) >= 0:
            if m := TAG.match(html, begin) or (SIMPLE.match(html, begin) if begin < last else None):
                break
            begin += 1  # a bare < is text
            if begin > last and not html.startswith(("<!", "<?"), html.find("<", begin)):
                break  # no tag can end from here on
        text, here = html[at : m.start() if m else end], stack[-1]
        if text and not here.unseen and not text.isspace():
            out.append(Node(here.path, block, unescape(text) if "&" in text else text, here.linked, here.held, here.noisy, here.heading, here.run or here.path))
        if not m:
            break
        at, tag = m.end(), m[2]
        if not tag:
            continue
        tag = tag.lower()
        if tag not in INLINE:
            block += 1
        if m[1]:  # an end tag closes the nearest open element of its name
            if count[tag]:
                place = len(stack) - 1
                while stack[place].tag != tag:
                    place -= 1
                close(place)
            continue
        if tag in CLOSE_P and stack[-1].p >= 0:
            close(stack[-1].p)
        if tag == "body" and count["head"]:
            close(next(j for j, x in enumerate(stack) if x.tag == "head"))
        if tag in CLOSES and (place := stack[-1].closable[KINDS[tag]]) >= 0:
            close(place)
        if tag in RAW:
            ended = RAW_END[tag].search(html, at) if at <= last else None
            at = ended.end() if ended else end
            continue
        if tag in VOID or m[3].endswith("/") and tag not in INLINE and tag not in CLOSE_P:
            continue
        count[tag] += 1
        stack.append(_pushed(stack[-1], tag, m[3], len(stack), number, around))
        if tag == "h1" or tag in HOLDERS:
            titled.add(stack[-1].noisy)
    return _levelled(out, around, titled)


def _levelled(page: list[Node], around: list[int], titled: set[int]) -> list[Node]:
    """The nodes with the count of the elements around them that name themselves no main text, but for those that hold it."""
    if len(around) > 1:
        text, holds = [0] * len(around), [i in titled for i in range(len(around))]
        for x in page:
            text[x.noisy] += len(x.text)
        for i in range(len(around) - 1, 0, -1):
            text[around[i]] += text[i]
            holds[around[i]] |= holds[i]
        level = [0] * len(around)
        for i in range(1, len(around)):
            level[i] = level[around[i]] + (not holds[i] or 2 * text[i] < text[0])
        for x in page:
            x.noisy = level[x.noisy]
    return page


KINDS = {tag: i for i, tag in enumerate(CLOSES)}


def smooth(values: np.ndarray) -> np.ndarray:
    """Means over each value and its neighbours, weighted 1-2-1."""
    padded = np.concatenate([values[:1], values, values[-1:]])
    return (padded[:-2] + 2 * padded[1:-1] + padded[2:]) / 4


def scores(page: list[Node]) -> np.ndarray:
    """Each node's fused ratio: of its path's smoothed text and punctuation per node, and of its text outside links."""
    number: dict[int, int] = {}
    where = np.array([number.setdefault(x.path, len(number)) for x in page])
    length = np.array([len(x.text.strip()) for x in page], float)
    marks = np.array([sum(map(x.text.count, PUNCTUATION)) for x in page], float)
    linked = np.array([x.linked for x in page], float)
    per_path = lambda v: np.bincount(where, v, len(number))
    count, total = per_path(np.ones(len(page))), per_path(length)
    text_ratio, mark_ratio = smooth((total / count)[where]), smooth((per_path(marks) / count)[where])
    return text_ratio * np.log1p(1 + mark_ratio) * (1 - per_path(length * linked) / np.maximum(total, 1))[where]


def in_turns(page: list[Node]) -> np.ndarray:
    """Nodes after the last article or main element whose paths come in turns again and again (a name, its remark, a name, its remark).

    Sections of prose under headings of the first three levels are none, nor are lists among paragraphs.
    """
    out = np.zeros(len(page), bool)
    begin = 1 + max((i for i, x in enumerate(page) if x.held), default=len(page))
    runs = [next(own) for _, own in groupby((x for x in page[begin:] if not 0 < x.heading < 4), lambda x: x.path)]
    often = Counter(x.path for x in runs)
    steps = Counter((a.path, b.path) for a, b in zip(runs, runs[1:]) if (a.run == a.path) == (b.run == b.path))
    turning = {p for (a, b), n in steps.items() if n > 1 and often[a] > 1 and often[b] > 1 for p in (a, b)}
    out[begin:] = [x.path in turning for x in page[begin:]]
    return out


def rescued(page: list[Node], over: np.ndarray, least: int = 0) -> np.ndarray:
    """Nodes of the runs that touch a node over the threshold and are mostly outside links: in an article or main element, or between two
    such nodes, or lists under a heading right after one.

    least: how many elements of a telling name lie around all of the page's text.
    """
    before, after = np.insert(over[:-1], 0, False), np.append(over[1:], False)
    near, out = over | before | after, np.zeros(len(page), bool)
    at = 0
    for (held, noisy, _), run in groupby(page, lambda x: (x.held, x.noisy, x.run)):
        nodes_ = list(run)
        own = slice(at, at := at + len(nodes_))
        begin, under = own.start, False
        if begin > 1 and not held and len(nodes_) > 1 and nodes_[0].run != nodes_[0].path:
            title = page[begin - 1]
            under = title.heading > 1 and title.noisy == least and not title.linked and bool(over[begin - 2])
        if noisy == least and (under or near[own].any() and (held or before[own][0] and after[own][-1])):
            out[own] = 2 * sum(len(x.text.strip()) for x in nodes_ if x.linked) < sum(len(x.text.strip()) for x in nodes_)
    return out


def main_text(html: str | None, share: float = 0.2, prior: float = PRIOR) -> str:
    """The main text of a page; share: the part of the mean fused ratio (weighted by text) that a path must reach."""
    page = nodes(html) if html else []
    if not page:
        return ""
    least = min(x.noisy for x in page)
    trust = np.array([prior ** min(3, x.noisy - least) for x in page]) * np.where(in_turns(page), prior, 1.0)
    fused = scores(page) * trust
    weight = np.array([len(x.text) for x in page], float) * trust
    over = (fused >= share * (fused * weight).sum() / weight.sum()) & (fused > 0)
    if not over.any():
        over = np.array([not x.linked and x.noisy == least for x in page])
    chosen = over | rescued(page, over, least)
    soon = np.zeros(len(page), bool)  # a chosen node comes within three
    for step in (1, 2, 3):
        soon[:-step] |= chosen[step:]
    head = np.array([x.heading if x.noisy == least else 0 for x in page])
    chosen |= (head > 0) & np.append(chosen[1:], False) | (head == 1) & soon
    blocks: dict[int, list[str]] = {}
    for x, good in zip(page, chosen):
        if good:
            blocks.setdefault(x.block, []).append(x.text)
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages without the html, with its main text (main_text)."""
    keep = [c for c in pages.columns if c != html_col]
    rows = small_batches(pages).select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)), F.col(html_col).alias("its html"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    @lean
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = pa.array([main_text(x.as_py()) for x in b.column(b.num_columns - 1)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], text], names=[*b.schema.names[:-1], "its text"])

    done = rows.mapInArrow(work, f"{fields}{', ' if fields else ''}`its text` string")
    return done.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(keep)), F.col("`its text`").alias("main_text"))
