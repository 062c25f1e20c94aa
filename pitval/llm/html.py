"""Main text of web pages by tag-path ratios."""
from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import table

# Element names of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe template xmp noembed noframes annotation annotation-xml".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong "
                   "sub sup time tt u var math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle mpadded mphantom menclose msub msup msubsup munder mover "
                   "munderover mmultiscripts mtable mtr mtd semantics".split())
APART = frozenset("nav header footer aside form button select option fieldset dialog menu object svg canvas audio video head".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
MAIN = frozenset("article main".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)>?|[^<]+|<""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/"'>]|\Z)""", re.I)
# A class or id counts only if all its parts are of these words or words of place and form, at least one of the former.
APART_NAMES = re.compile(r"ads?|advert\w*|sponsor\w*|promo\w*|banner\w*|nav|navbar|navigation|menus?|header|masthead|footer|sidebar|side|aside|"
                         r"widgets?|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletter|subscribe|subscription|share|sharing|social|related|"
                         r"recommend\w*|breadcrumbs?|comments?|commentlist|disqus|repl(?:y|ies)|respond|form|login|signup|search|pagination|pager|toolbar|"
                         r"skip|hidden|copyright|legal|disclaimer", re.I)
PLACES = re.compile(r"\d+|site|main|primary|secondary|global|top|bottom|left|right|box|bar|container|wrap|wrapper|inner|outer|lists?|links?|items?|section|area|"
                    r"block|panel|unit|slot|posts|articles|stories|buttons?|icons?|col|column|row|group|text|message", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
PUNCTUATION = re.compile(r"[^\w\s]")


@dataclass(slots=True)
class Element:
    """An open or closed element; what follows from the elements around it is copied from its parent, so none looks back at the whole stack."""
    name: str
    number: int
    path: int  # number of its path of block tags
    above: Element | None
    home: Element | None  # the element itself, or the nearest one around it, that is no inline element
    named: Element | None  # the same for elements whose class or id hints that they are apart
    apart: bool  # it or one around it is apart
    linked: bool  # it or one around it is a link
    main: int  # number of the outermost article element
    level: int  # elements around it that are no inline elements
    parted: bool  # a block ends where it ends


@dataclass(slots=True)
class Block:
    path: int
    apart: bool
    home: Element | None
    main: int
    named: Element | None
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _listed(value: str) -> bool:
    """Whether a class or id as a whole is a name of what stands apart."""
    parts = [x for x in re.split(r"[-_]+", value) if x]
    if value.lower() == "sr-only":
        return True
    return any(APART_NAMES.fullmatch(x) for x in parts) and all(APART_NAMES.fullmatch(x) or PLACES.fullmatch(x) for x in parts)


def _apart(name: str, rest: str) -> tuple[bool, bool]:
    """Whether an element stands apart by its kind, role or style, and whether its class or id hints at it."""
    if name in APART:
        return True, False
    named = False
    if not rest or name in ("html", "body"):
        return False, False
    for m in ATTRIBUTE.finditer(rest):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "role" and value.lower() in APART_ROLES:
            return True, named
        if key == "style" and HIDDEN.search(value):
            return True, named
        named = named or key in ("class", "id") and name not in MAIN and any(_listed(x) for x in value.split())
    return False, named


def blocks(page: str) -> list[Block]:
    """Text between block-level tags, with its path of block-level tags and the elements it is in; broken markup is repaired as browsers do.

    Time and memory grow with the length of the page, however deep its elements lie.
    """
    stack: list[Element] = []
    places: dict[str, list[int]] = defaultdict(list)  # where in the stack the open elements of a name are
    walls: list[int] = []  # where in the stack the open elements are that are no inline elements
    paths: dict[tuple[int, str], int] = {}
    out: list[Block] = []
    current: Block | None = None
    made, at, n = 0, 0, len(page)

    def shut(down_to: int) -> bool:
        """Close elements; whether one of them ends a block."""
        parted = False
        while len(stack) > down_to:
            e = stack.pop()
            places[e.name].pop()
            if walls and walls[-1] == len(stack):
                walls.pop()
            parted = parted or e.parted
        return parted

    while at < n:
        m = TOKEN.match(page, at)
        at = m.end()
        name = m[2]
        top = stack[-1] if stack else None
        if name is None:
            text = m[0]
            if text.startswith("<") and len(text) > 1:
                continue
            if current is None:
                current = Block(top.path, top.apart, top.home, top.main, top.named) if top else Block(0, False, None, 0, None)
                out.append(current)
            current.parts.append(text)
            if top and top.linked:
                current.linked += len(text.strip())
            continue
        name = name.lower()
        inline = name in INLINE
        if not inline:
            current = None
        if m[1]:
            if places[name] and (not inline or not walls or places[name][-1] > walls[-1]) and shut(places[name][-1]):
                current = None
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = end.start() if end else n
            if end:
                close = page.find(">", at)
                at = close + 1 if close >= 0 else n
            current = None
            continue
        if name in VOID or m[3].endswith("/") and not inline and name not in ("div", "p"):
            continue
        if not inline and walls and (stack[walls[-1]].name == "p" or stack[walls[-1]].name in CLOSES.get(name, ())):
            shut(walls[-1])
            top = stack[-1] if stack else None
        apart, named = _apart(name, m[3])
        if apart or named:
            current = None
        made += 1
        above = top.path if top else 0
        e = Element(name, made, above if inline and name != "a" else paths.setdefault((above, name), len(paths) + 1), top, None, None,
                    apart or bool(top and top.apart), name == "a" or bool(top and top.linked),
                    top.main if top and top.main else made if name in MAIN else 0, (top.level if top else 0) + (not inline), apart or named)
        e.home = (top.home if top else None) if inline else e
        e.named = e if named else top.named if top else None
        places[name].append(len(stack))
        if not inline:
            walls.append(len(stack))
        stack.append(e)
    for b in out:
        b.text = " ".join(html.unescape("".join(b.parts)).split())
    return [b for b in out if b.text]


def _held(starts: list[tuple[Element | None, float]], kind: str) -> dict[int, tuple[Element, float]]:
    """For every element that is the ``home`` or ``named`` of one of the starts or of an element around it: the sum of the weights in it, innermost elements first.

    An element is made after those around it, so each passes its sum on once.
    """
    known: dict[int, Element] = {}
    held: dict[int, float] = defaultdict(float)
    for e, w in starts:
        if e is not None:
            held[e.number] += w
        while e is not None and e.number not in known:
            known[e.number] = e
            e = getattr(e.above, kind) if e.above else None
    out = {}
    for number in sorted(known, reverse=True):
        e = known[number]
        out[number] = e, held[number]
        around = getattr(e.above, kind) if e.above else None
        if around is not None:
            held[around.number] += held[number]
    return out


def _within(elements: dict[int, tuple[Element, float]], kind: str, wanted: set[int]) -> set[int]:
    """Numbers of the elements that are wanted or in a wanted one."""
    inside = set()
    for number in reversed(elements):
        e = elements[number][0]
        around = getattr(e.above, kind) if e.above else None
        if number in wanted or around is not None and around.number in inside:
            inside.add(number)
    return inside


def _smooth(values: list[float], sigma: float = 1.0, reach: int = 2) -> list[float]:
    kernel = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        near = [(kernel[j - i + reach], values[j]) for j in range(max(0, i - reach), min(len(values), i + reach + 1))]
        out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    return out


def _fused(found: list[Block]) -> tuple[list[float], dict[int, int]]:
    """The fused ratio at each block, and the number of blocks of each path."""
    lengths, points, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for b in found:
        lengths[b.path] += max(0, len(b.text) - b.linked)
        points[b.path] += len(PUNCTUATION.findall(b.text))
        count[b.path] += 1
    by_length = _smooth([lengths[b.path] / count[b.path] for b in found])
    by_points = _smooth([points[b.path] / count[b.path] for b in found])
    return [math.sqrt(x * y) for x, y in zip(by_length, by_points)], count


def _unnamed(found: list[Block]) -> list[Block]:
    """The blocks without those in a named element, unless that element holds the article: its mark-up says so, or half of the weight of the ratios."""
    weights = [max(0, len(b.text) - b.linked) * (1 + f) for b, f in zip(found, _fused(found)[0])]
    held = _held([(b.named, w) for b, w in zip(found, weights)], "named")
    if any(b.main and not b.named for b in found):  # the article is marked, and not in a named element
        drop = set(held)
    else:
        marked, whole = _held([(b.named, 0.0) for b in found if b.main], "named"), sum(weights)
        drop = {k for k, (_, w) in held.items() if k not in marked and 2 * w < whole or not w}
    gone = _within(held, "named", drop)
    return [b for b in found if b.named is None or b.named.number not in gone] or found


def main_text(page: str | None, cut: float = 0.8) -> str:
    """Text of the content blocks in page order, joined by one space.

    Blocks in elements that are apart from the article by kind, role or style are left
    out first. A class or id that as a whole names such an element is a hint: the element
    is left out unless it holds half of the page's text, weighted by the ratios, or more,
    and no article element stands outside; one that holds the only article element stays.
    Should nothing be left, all blocks are taken. For each path of block tags the mean text length and the mean punctuation of
    its blocks are the two ratios. Both are smoothed along the page and fused as their
    geometric mean; paths whose mean fused value reaches ``cut`` standard deviations are
    content paths. The smallest element that holds nearly all of their text, or the article
    element around it, is the article, and every remaining block in it belongs to the
    text, short ones too, unless it is mostly links and not on a content path.
    """
    every = blocks(page or "")
    found = _unnamed([b for b in every if not b.apart] or every)
    if not found:
        return ""
    fused, count = _fused(found)
    mean = sum(fused) / len(fused)
    limit = cut * math.sqrt(sum((f - mean) ** 2 for f in fused) / len(fused))
    per_path = defaultdict(float)
    for b, f in zip(found, fused):
        per_path[b.path] += f
    chosen = {p for p, total in per_path.items() if total / count[p] >= limit}
    heavy = [(b, len(b.text) * (1 + f)) for b, f in zip(found, fused) if b.path in chosen]
    held, whole = _held([(b.home, w) for b, w in heavy], "home"), sum(w for _, w in heavy)
    homes = _held([(b.home, 0.0) for b in found], "home")
    weight = {k: w for k, (_, w) in held.items()}
    mains = {b.main for b in found if weight.get(b.main, 0.0) > 0}
    home = 0
    if mains:
        best = max(sorted(mains), key=lambda e: weight[e])
        home = best if weight[best] >= 0.5 * whole else 0
    if not home and whole:
        home = max((k for k in sorted(held) if weight[k] >= 0.95 * whole), key=lambda k: held[k][0].level, default=0)
    inside = _within(homes, "home", {home})
    return " ".join(b.text for b in found if (not home or b.home is not None and b.home.number in inside)
                    and (b.path in chosen or 2 * b.linked <= len(b.text)))


def text_column(page: str) -> Column:
    @F.arrow_udf("string")
    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([main_text(x.as_py()) for x in batch], pa.string())

    return extract(F.col(page))


def extract_text(pages: DataFrame, page: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with the main text of every page in the column ``text``, in place of one that is there.

    A null or empty page, or one without text, gives an empty string. Repeated rows give equal texts, an empty table an empty result.
    """
    return pages.withColumn(text, text_column(page))


def op6(spark, sf_dir: str) -> DataFrame:
    out = extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
