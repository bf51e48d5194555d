"""Main text of web pages by union-free wrappers, inferred for each host.

A page is a stream of block tags (with class and id) and texts. Repeated neighbours in a stream
fold into one repeated group; aligned with the streams of the same host, what only some pages have
becomes an optional group, and a text that differs becomes a slot. Wrappers are merged like sums:
each task folds and aligns the pages that it has of a host, then the partial wrappers of the host
are aligned with each other, over rounds of fixed fan-in, so no task holds a host's pages.

The main text is found in a tree of the elements that hold sections (div, section, article, main): from the page down, as long as one
child's whole subtree has more than half of the slot text. Slot text of an element is its mean over the host's pages that have it, from the
wrapper, without the host's own texts; an article or main element counts WEIGHT times. So an article element is one
that is likely, not one that is taken for itself. The way down ends at an article or main element, and at an element that holds
paragraphs or headings of its own: those are parts of the text, and so are all of its sections. What stands before a
chosen section with a main heading is its title and is kept. Where a page has none of the host's usual elements, its own are weighed.

Left out are menus, headers of the page, footers, sidebars, notices, adverts, forms and markup, known by their elements and names; what is not
shown; texts that the wrapper has as they stand, outside its optional groups, also inside an article: those that all pages of the host share, if at least
SURE of them differ, except a heading with the page's own text below it. By their structure go reader comments, neighbours of one kind that each
begin with a short line and tell an author and a date, with what little stands around them, and outside an article lists of links. Names that may also
be those of a text (tags, search, related) only count where there is no sentence that is not a link.

Streams of any length are aligned, by the items that all pages have; what is optional once stays so, and tells neither
which texts are the host's own nor where the main text is. A gap shows the longest group that a page has there, so a wrapper grows no longer
with the pages of its host. Which pages differ is told by hashes of their texts, a bounded set that is merged over
tasks. A page without texts tells nothing of its host and is not aligned.

Very long pages are read whole, a page at a time. Ties between regions go to the first by their labels.
Nulls: a null or empty page has an empty text; a page without a host is a host of its own kind.
Repeated rows each give a row. An empty table gives an empty result. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from difflib import SequenceMatcher
from functools import lru_cache
from itertools import takewhile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few


#: Parts of a host: FAN * FAN in the first round, then FAN, then one; pages meet their wrapper in FAN parts.
FAN = 64
#: Pages that must differ before an equal text counts as the host's own.
SURE = 4
#: How much more text in an article or main element counts when the main region is chosen.
WEIGHT = 2
#: Words of a sentence, characters of a line with an author or a date, and of what stands around comments.
SENTENCE, LINE, AROUND = 12, 60, 80
#: Share of characters in links, and how many links, of a list of links.
LINKED, LINKS = 0.7, 3
#: Items that are aligned at once; longer streams are first split where a longest common subsequence allows.
DIRECT = 400

# Elements of HTML by what they mean for the main text.
RAW = ("script", "style", "noscript", "template", "textarea", "svg", "iframe", "object", "math", "canvas", "audio", "video", "title")
OUTSIDE = ("nav", "aside", "form", "footer", "header", "menu", "dialog", "button", "select", "fieldset", "head")
MAIN = ("article", "main")
SECTIONS = ("html", "body", "div", "section", "center", "article", "main")
BLOCKS = (
    "address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html",
    "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th",
    "thead", "tr", "ul",
)
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
# Words that tell as a class, id or role what is no main text; a name of several words
# does only if all of them are such words, or words for where and how a part is laid out.
NOISE = (
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent dialog disqus "
    "footer header login masthead menu modal nav navbar navigation newsletter notice notices pagination paywall popup promo promoted "
    "related reply replies respond search share sharing sidebar signup social sponsor sponsored subscribe tags toolbar widget widgets "
    "discussion discussions responses feedback guestbook complementary contentinfo alert disclaimer recommended recommendations"
).split()
# Those of them that may also name a text; words of an author's and of a date's element; what a date looks like.
WEAK = "tags search related recommended recommendations share sharing social respond reply replies".split()
AUTHOR, DATED = "author authors byline by user username nick nickname avatar name poster".split(), "date dated time timestamp datetime posted published ago".split()
LAYOUT = "area bar block bottom box col column container group inner left list main outer right section site top wrap wrapper".split()
#: Elements whose ids are names of what they say, as headings' ids made from their titles.
NAMED = ("section", "h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "dt", "dd", "td", "th", "tr", "pre", "blockquote", "caption", "figcaption", "figure", "summary", "details")

# a quoted value ends before white space, a slash or the tag's end; a quote that is never closed so holds no tag open
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|</?([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"(?=[\s/>])|'[^']*'(?=[\s/>])|[^>])*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?|\"[^\"]*\"|'[^']*'")
_CLOSERS = {x: re.compile(rf"</{x}\s*(?:>|$)|$", re.I | re.S) for x in RAW}
_NUMBER = re.compile(r"\d+")
_NO_MARKS = str.maketrans("<>", "  ")
_DATE = re.compile(r"\b\d{1,2}[:.]\d{2}\b|\b(?:19|20)\d\d\b|\b\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\b|\b\d+ (?:second|minute|hour|day|week|month|year)s? ago\b", re.I)
_TELLS, _INLINE = re.compile(r"\b(?:class|itemprop|rel)\b", re.I), ("time", "cite", "span", "b", "strong", "em", "i", "small", "abbr")
_UNSHOWN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\s*(?:!\s*important\s*)?(?:;|$)", re.I)
_PARTS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
_SIZE = re.compile(r"\d+(?:x\d+)?")
_CLOSES_P = {*BLOCKS} - {"body", "html", "head", "option"}
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_HOLDERS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}


@dataclass
class Text:
    """A block's text and where it is: labels of the elements around it, outermost first."""

    value: str
    path: tuple[str, ...]
    noise: bool
    main: bool
    place: int = 0  #: in the page's stream
    tag: str = ""  #: of the block around it
    own: int = -1  #: the section right around it, by number
    linked: int = 0  #: characters of it in links


@dataclass
class Element:
    """A block with its texts, from begin to end (not included)."""

    parent: int
    tag: str
    kind: str  #: its label without numbers
    main: bool
    weak: bool
    begin: int
    end: int = 0
    links: int = 0
    author: bool = False
    dated: bool = False


@dataclass
class Page:
    stream: list[str] = field(default_factory=list)
    texts: list[Text] = field(default_factory=list)


def _attributes(source: str) -> dict[str, str]:
    """Attributes of a tag by name; as in browsers the first of a name counts."""
    out: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(source):
        if name:
            out.setdefault(name.lower(), "".join(values))
    return out


@lru_cache(10_000)
def _words(name: str) -> tuple[str, ...]:
    return tuple(x.lower() for x in _PARTS.findall(_SIZE.sub(" ", name)))


@lru_cache(10_000)
def _says_noise(name: str) -> tuple[bool, bool]:
    """Does a name tell of noise, and only by words that may also name a text?"""
    parts = _words(name)
    told = [x for x in parts if x in NOISE]
    noise = bool(told) and all(x in NOISE or x in LAYOUT for x in parts)
    return noise, noise and all(x in WEAK for x in told)


def _noise(tag: str, attributes: dict[str, str], main: bool) -> tuple[bool, bool]:
    """Is an element noise; may it be, if its texts do not speak against it?"""
    if tag in OUTSIDE and not (main and tag == "header"):
        return True, False
    if "hidden" in attributes or attributes.get("aria-hidden", "").strip().lower() == "true" or _UNSHOWN.search(attributes.get("style", "")):
        return True, False
    if tag in ("main", "body", "html"):
        return False, False
    names = [*attributes.get("class", "").split(), *attributes.get("role", "").split()]
    told = [_says_noise(x) for x in (names if tag in NAMED else [*names, attributes.get("id", "").strip()])]
    return any(noise and not weak for noise, weak in told), any(weak for _, weak in told)


def _label(tag: str, attributes: dict[str, str]) -> str:
    label = tag + "".join(f".{v}" for n, v in attributes.items() if n in ("class", "id"))
    return " ".join(label.translate(_NO_MARKS).split())


def read(page: str | None) -> Page:
    """Blocks of text of a page and its stream of block tags and texts, mending unclosed elements."""
    out, source = Page(), page or ""
    open_: list[tuple[str, str, bool, bool, int]] = []  # tag, label, noise, main, number
    elements: list[Element] = []
    words: list[str] = []
    linked = links = 0  # characters of words in links; open links

    def flush() -> None:
        nonlocal linked
        value = " ".join(entities.unescape("".join(words)).split())
        words.clear()
        if value:
            tag, _, noise, main, _ = open_[-1] if open_ else ("", "", False, False, -1)
            own = next((x[4] for x in reversed(open_) if x[0] in SECTIONS), -1)
            out.texts.append(Text(value, tuple(x[1] for x in open_), noise, main, len(out.stream), tag, own, min(linked, len(value))))
            out.stream.append(f"#{xxhash.xxh3_64_hexdigest(value.encode('utf-8', 'replace'))}")
        linked = 0

    def close(k: int) -> None:
        flush()
        while len(open_) > k:
            out.stream.append(f"</{open_[-1][1]}>")
            elements[open_.pop()[4]].end = len(out.texts)

    def said(some: str) -> None:
        nonlocal linked
        words.append(some)
        if links:
            linked += len(some)

    def hint(named: dict[str, str], tag: str = "") -> None:
        """What an element's names tell of an author or a date goes to the block around it."""
        told = [w for n in ("class", "itemprop", "rel") for x in named.get(n, "").split() for w in _words(x)]
        if open_:
            block = elements[open_[-1][4]]
            block.author |= any(w in AUTHOR for w in told) or tag == "cite"
            block.dated |= any(w in DATED for w in told) or tag == "time"

    at = 0
    for m in _TOKEN.finditer(source):
        if m.start() < at:
            continue
        said(source[at : m.start()])
        at = m.end()
        tag, attributes = (m[1] or "").lower(), m[2] or ""
        if not tag:
            continue
        if m[0][1] == "/":
            if tag == "a":
                links = 0
            elif tag in BLOCKS:
                k = next((i for i in reversed(range(len(open_))) if open_[i][0] == tag), None)
                if k is None:
                    flush()
                else:
                    close(k)
            continue
        if tag in RAW:
            if not attributes.rstrip().endswith("/"):
                at = _CLOSERS[tag].search(source, at).end()
            words.append(" ")
        elif tag in BLOCKS:
            flush()
            if tag in _CLOSES_P and open_ and open_[-1][0] == "p":
                close(len(open_) - 1)
            if tag in _SIBLINGS:
                for i in reversed(range(len(open_))):
                    if open_[i][0] in _HOLDERS[tag]:
                        break
                    if open_[i][0] in _SIBLINGS[tag]:
                        close(i)
                        break
            main = bool(open_ and open_[-1][3]) or tag in MAIN
            named = _attributes(attributes)
            told, weak = _noise(tag, named, main)
            noise = bool(open_ and open_[-1][2]) or told
            label = _label(tag, named)
            out.stream.append(f"<{label}>")
            if tag in VOID:
                out.stream.append(f"</{label}>")
            else:
                elements.append(Element(open_[-1][4] if open_ else -1, tag, _NUMBER.sub("", label), main, weak, len(out.texts)))
                open_.append((tag, label, noise, main, len(elements) - 1))
                if named:
                    hint(named)
        elif tag in VOID:
            words.append(" ")
        elif tag == "a":
            links = 1
            if open_:
                elements[open_[-1][4]].links += 1
            if _TELLS.search(attributes):
                hint(_attributes(attributes))
        elif tag in _INLINE and (tag in ("time", "cite") or _TELLS.search(attributes)):
            hint(_attributes(attributes), tag)
    said(source[at:])
    close(0)
    _judge(out, elements)
    return out


def _judge(page: Page, elements: list[Element]) -> None:
    """Marks as noise what its structure tells: comments, lists of links, and what is named like noise and says nothing."""
    for x in reversed(elements):  # children before parents
        if x.parent >= 0:
            above = elements[x.parent]
            above.links, above.author, above.dated = above.links + x.links, above.author or x.author, above.dated or x.dated
    drop = lambda x: [setattr(t, "noise", True) for t in page.texts[x.begin : x.end]]
    groups: dict[tuple[int, str], list[Element]] = {}
    for x in elements:
        texts = [t for t in page.texts[x.begin : x.end] if not t.noise]
        if not texts:
            continue
        if x.weak and not any(len(t.value.split()) >= SENTENCE and 2 * t.linked < len(t.value) for t in texts):
            drop(x)
        elif not x.main and x.tag in ("div", "section", "ul", "ol", "table", "dl", "center") and x.links >= LINKS and sum(t.linked for t in texts) >= LINKED * sum(len(t.value) for t in texts):
            drop(x)
        elif x.tag in ("div", "section", "article", "li"):
            groups.setdefault((x.parent, x.kind), []).append(x)
    for (parent, _), some in groups.items():
        if len(some) < 2 or 2 * sum(_is_comment(x, page.texts[x.begin : x.end]) for x in some) <= len(some):
            continue
        for x in some:
            drop(x)
        if parent >= 0 and elements[parent].tag not in ("body", "html", *MAIN):
            left = [t for t in page.texts[elements[parent].begin : elements[parent].end] if not t.noise]
            if sum(len(t.value) for t in left) <= AROUND:
                drop(elements[parent])


def _is_comment(x: Element, texts: list[Text]) -> bool:
    """Does an element begin with a short line, no heading, and tell an author and a date besides what it says?"""
    if len(texts) < 2 or texts[0].tag in _HEADINGS or len(texts[0].value) > LINE:
        return False
    short = [t.value for t in texts if len(t.value) <= LINE]
    line = texts[0].value
    names = [w for w in line.split() if w.strip(",.;:()").isalpha()]
    # a name alone, or one beside a date
    author = x.author or line[-1] not in ".!?" and (1 <= len(line.split()) == len(names) <= 4 or bool(_DATE.search(line)) and 3 <= len(names) <= 6)
    return author and (x.dated or any(_DATE.search(v) for v in short))


_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


# ---------------------------------------------------------------- wrappers

Item = tuple  # ("t", tag) | ("#", hash of a text, or "" for a slot) | ("+", items) | ("?", items)


def stripped(items: list[Item], texts: set[str]) -> list[Item]:
    """Items with slots for all texts but these."""
    return [("#", x[1] if x[1] in texts else "") if x[0] == "#" else ("+", tuple(stripped(list(x[1]), texts))) if x[0] == "+" else x for x in items]


def folded(items: list[Item]) -> list[Item]:
    """Tandem repeats become repeated groups, short ones first. Slots are equal to each other, and a text only to itself, so that it stands out of a repeat."""
    for size in (1, 2, 3, 4, 5, 6, 8, 10, 12):
        k, out = 0, []
        while k < len(items):
            if k + size >= len(items) or items[k] != items[k + size]:
                out.append(items[k])
                k += 1
                continue
            n = 1
            while items[k : k + size] == items[k + n * size : k + (n + 1) * size] and k + (n + 1) * size <= len(items):
                n += 1
            unit = items[k : k + size]
            if n > 1 and all(x[0] != "?" for x in unit) and not (unit[0][0] == "t" and unit[0][1].startswith("</")):
                out.append(unit[0] if size == 1 and unit[0][0] == "+" else ("+", tuple(unit)))
                k += n * size
            else:
                out.append(items[k])
                k += 1
        items = out
    return items


def _gathered(items: list[Item], other: list[Item]) -> list[Item]:
    """items with single occurrences of groups that the other repeats made such groups."""
    for unit in sorted({x[1] for x in other if x[0] == "+"}, key=len, reverse=True):
        k, out, n = 0, [], len(unit)
        while k < len(items):
            if items[k] == unit[0] and tuple(items[k : k + n]) == unit:
                out.append(("+", unit))
                k += n
            else:
                out.append(items[k])
                k += 1
        items = out
    return items


def _lengths(a: list[Item], b: list[Item]) -> np.ndarray:
    """Length of a longest common subsequence of b and each beginning of a, by bits of a whole number."""
    where: dict[Item, int] = {}
    for x, at in _places(a).items():
        bits = np.zeros(len(a), np.uint8)
        bits[at] = 1
        where[x] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & where.get(y, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(a) // 8 + 1, "little"), np.uint8), count=len(a), bitorder="little")
    return np.append(0, np.cumsum(bits == 0))


def _places(items: list[Item]) -> dict[Item, list[int]]:
    out: dict[Item, list[int]] = {}
    for k, x in enumerate(items):
        out.setdefault(x, []).append(k)
    return out


def common(a: list[Item], b: list[Item]) -> list[tuple[int, int, int]]:
    """Runs (start in a, start in b, length) of equal items, ascending in both."""
    out: list[tuple[int, int, int]] = []
    open_ = [(0, len(a), 0, len(b))]
    while open_:
        i, i_end, j, j_end = open_.pop()
        n, m = i_end - i, j_end - j
        if not n or not m:
            continue
        if max(n, m) <= DIRECT:
            out += [(i + x, j + y, size) for x, y, size in SequenceMatcher(None, a[i:i_end], b[j:j_end], autojunk=False).get_matching_blocks() if size]
            continue
        x, y = (a[i:i_end], b[j:j_end]) if m >= n else (b[j:j_end], a[i:i_end])
        half = len(y) // 2
        k = int(np.argmax(_lengths(x, y[:half]) + _lengths(x[::-1], y[half:][::-1])[::-1]))
        ik, jk = (i + k, j + half) if m >= n else (i + half, j + k)
        open_ += [(ik, i_end, jk, j_end), (i, ik, j, jk)]
    return out


def aligned(a: list[Item], b: list[Item]) -> list[Item]:
    """The wrapper of two: common items, and optional groups for what only one has; in a gap the longer group of the two.

    Texts that only one has are slots from here on; those of both hold the two together, and stay out of repeats.
    """
    there = set(texts_of(a))
    both = there & set(texts_of(b))
    a = folded(stripped(a, both)) if there != both else a
    b = folded(stripped(b, both))
    a, b = _gathered(a, b), _gathered(b, a)
    xs, ys = [k for k, x in enumerate(a) if x[0] != "?"], [k for k, y in enumerate(b) if y[0] != "?"]
    out: list[Item] = []
    i = j = 0  # in a and in b

    def gap(to: int, at: int) -> None:
        found = [[y for x in items for y in (x[1] if x[0] == "?" else (x,))] for items in (a[i:to], b[j:at])]
        if to > i or at > j:
            out.append(("?", tuple(max(found, key=lambda g: (len(g), g)))))

    for at, to, size in common([a[k] for k in xs], [b[k] for k in ys]):
        for k in range(size):
            x, y = xs[at + k], ys[to + k]
            gap(x, y)
            out.append(a[x])
            i, j = x + 1, y + 1
    gap(len(a), len(b))
    return out


def stream_items(page: Page) -> list[Item]:
    return [("#", x[1:]) if x[0] == "#" else ("t", x) for x in page.stream]


def texts_of(items: list[Item]) -> Iterator[str]:
    """Texts that a wrapper has as they stand, on all pages: what is optional only some have."""
    for x in items:
        if x[0] == "#":
            if x[1]:
                yield x[1]
        elif x[0] == "+":
            yield from texts_of(list(x[1]))


def written(items: list[Item]) -> str:
    """A wrapper as a pattern: ( )+ repeats, ( )? may be missing, # is a text, * a slot."""
    show = {"t": lambda x: x[1], "#": lambda x: f"#{x[1]}" if x[1] else "*"}
    return " ".join(show[x[0]](x) if x[0] in show else f"( {written(list(x[1]))} ){x[0]}" for x in items)


def parsed(pattern: str) -> list[Item]:
    stack: list[list[Item]] = [[]]
    for x in re.findall(r"\( |<[^>]*>|#[0-9a-f]+|\*| ?\)[+?]", pattern):
        if x == "( ":
            stack.append([])
        elif x.strip()[0] == ")":
            group = tuple(stack.pop())
            stack[-1].append((x[-1], group))
        else:
            stack[-1].append(("#", x[1:]) if x[0] == "#" else ("#", "") if x == "*" else ("t", x))
    return stack[0]


@dataclass
class Wrapper:
    items: list[Item]
    marks: set[int]  #: of pages that differ, the SURE smallest
    slots: dict[str, tuple[int, int]]  #: characters of text in each element by its path, and pages that have it

    def fixed(self) -> set[str]:
        """Texts of the host's own: the same on all its pages, of which enough differ."""
        return set(texts_of(self.items)) if len(self.marks) >= SURE else set()

    def merge(self, other: Wrapper) -> None:
        if self.items != other.items or len(self.marks) < SURE:
            self.items = aligned(self.items, other.items)
        self.marks = set(sorted(self.marks | other.marks)[:SURE])
        for k, v in other.slots.items():
            size, pages = self.slots.get(k, (0, 0))
            self.slots[k] = (size + v[0], pages + v[1])


@lru_cache(10_000)
def _region(path: tuple[str, ...]) -> tuple[str, ...]:
    """The sections around a text, outermost first; numbers in their classes and ids tell nothing."""
    return tuple(_NUMBER.sub("", x) for x in takewhile(lambda x: x.split(".")[0] in SECTIONS, path))


def _sizes(texts: list[Text]) -> dict[str, int]:
    """Characters of text by the section right around, noise left out."""
    out: dict[str, int] = {}
    for x in texts:
        if not x.noise:
            key = "\n".join(_region(x.path))
            out[key] = out.get(key, 0) + len(x.value)
    return out


def _paths(page: Page) -> dict[str, tuple[int, int]]:
    return {k: (n, 1) for k, n in _sizes(page.texts).items()}


def main_region(page: Page, fixed: set[str], slots: dict[str, tuple[int, int]]) -> list[tuple[str, ...]]:
    """The sections of the page that hold its main text, by the slot text of the host's pages: the region, and titles before it."""
    is_fixed = lambda x: page.stream[x.place][1:] in fixed
    own = _sizes([x for x in page.texts if is_fixed(x)])
    below: dict[tuple[str, ...], float] = {}
    for key, here in _sizes(page.texts).items():
        size, pages = slots.get(key, (here, 1))
        path = tuple(key.split("\n")) if key else ()
        weight = WEIGHT if any(x.split(".")[0] in MAIN for x in path) else 1
        for k in range(len(path) + 1):
            below[path[:k]] = below.get(path[:k], 0) + weight * max(0.0, size / pages - own.get(key, 0))
    good = [x for x in page.texts if not x.noise and not is_fixed(x)]
    direct = {_region(x.path) for x in good if x.tag not in SECTIONS}
    top: tuple[str, ...] = ()
    titles: list[tuple[str, ...]] = []
    while True:
        children = [x for x in sorted(below) if len(x) == len(top) + 1 and x[:-1] == top]
        child = max(children, key=below.get, default=None)
        if child is None or 2 * below[child] <= below[top]:
            return [top, *titles]
        if top in direct or any(x.split(".")[0] in MAIN for x in top):
            # an article, or an element with text of its own: nothing is lost if all the rest is in the child
            if any(_region(x.path)[: len(top)] == top and _region(x.path)[: len(child)] != child for x in good):
                return [top, *titles]
        first = next((x.place for x in good if _region(x.path)[: len(child)] == child), 0)
        titles += dict.fromkeys(_region(x.path) for x in good if x.tag == "h1" and x.place < first and _region(x.path)[: len(top)] == top and len(_region(x.path)) > len(top))
        top = child


_ROW = "host string, part int, pattern string, marks array<long>, paths array<string>, sizes array<long>, counts array<long>"
_ARROW = pa.schema([("host", pa.string()), ("part", pa.int32()), ("pattern", pa.string()), ("marks", pa.list_(pa.int64())), ("paths", pa.list_(pa.string())), ("sizes", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])


def _row(host: str, part: int, w: Wrapper) -> dict:
    return {"host": host, "part": part, "pattern": written(w.items), "marks": sorted(w.marks), "paths": list(w.slots), "sizes": [n for n, _ in w.slots.values()], "counts": [n for _, n in w.slots.values()]}


def _wrapper(row: dict) -> Wrapper:
    return Wrapper(parsed(row["pattern"] or ""), set(row["marks"] or ()), dict(zip(row["paths"] or [], zip(row["sizes"] or [], row["counts"] or [], strict=True), strict=True)))


def _mark(page: Page) -> int:
    """A hash of the page's texts, the same in all tasks."""
    return xxhash.xxh3_64_intdigest("\n".join(x.value for x in page.texts).encode("utf-8", "replace")) >> 1


def _host(pages: DataFrame) -> DataFrame:
    url = F.coalesce(F.col("url"), F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)).alias("host"))


def wrappers(pages: DataFrame) -> DataFrame:
    """host, pattern, marks, paths, sizes and counts of each host's wrapper."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Wrapper] = {}
        for batch in few(batches):
            for host, text in zip(batch["host"].to_pylist(), batch["html"].to_pylist(), strict=True):
                page = read(text)
                if not page.texts:
                    continue
                w = Wrapper(stream_items(page), {_mark(page)}, _paths(page))
                if host in found:
                    found[host].merge(w)
                else:
                    found[host] = w
            if len(found) > 5_000:
                yield pa.RecordBatch.from_pylist([_row(h, 0, w) for h, w in found.items()], _ARROW)
                found = {}
        yield pa.RecordBatch.from_pylist([_row(h, 0, w) for h, w in found.items()], _ARROW)

    def combine(key: tuple[pa.Scalar, ...], tab: pa.Table) -> pa.Table:
        total: Wrapper | None = None
        for x in sorted(tab.to_pylist(), key=lambda r: (r["pattern"], r["marks"])):
            w = _wrapper(x)
            if total is None:
                total = w
            else:
                total.merge(w)
        return pa.Table.from_pylist([_row(key[0].as_py(), key[1].as_py() if len(key) > 1 else 0, total)], _ARROW)

    partial = _host(pages).select("host", "html").mapInArrow(learn, _ROW)
    dealt = partial.withColumn("part", F.pmod(F.xxhash64("pattern", "marks", "sizes"), F.lit(FAN * FAN)).cast("int"))
    for parts in (FAN, 1):
        merged = dealt.groupBy("host", "part").applyInArrow(combine, _ROW)
        dealt = merged.withColumn("part", F.pmod(F.col("part"), F.lit(parts)))
    return dealt.groupBy("host").applyInArrow(combine, _ROW).drop("part")


def main_text(page: Page, fixed: set[str], slots: dict[str, tuple[int, int]]) -> str:
    """Blocks of a page's main text in page order, two line breaks between."""
    regions = main_region(page, fixed, slots)
    out: list[str] = []
    heading: Text | None = None  # of the host's own, if it is followed by a text of the page
    for x in page.texts:
        if x.noise or not any(_region(x.path)[: len(r)] == r for r in regions):
            continue
        if page.stream[x.place][1:] not in fixed:
            out += [heading.value] if heading is not None else []
            out.append(x.value)
            heading = None
        elif x.tag in _HEADINGS:
            heading = x if x.main else None
    return "\n\n".join(out)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    found = wrappers(pages).select("host", "pattern", "marks", "paths", "sizes", "counts")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[set[str], dict[str, tuple[int, int]]]] = {}
        for batch in few(batches):
            texts = []
            for x in batch.select(["html", "host", "pattern", "marks", "paths", "sizes", "counts"]).to_pylist():
                host = x["host"]
                if host not in known:
                    if len(known) > 1_000:
                        known.clear()
                    w = _wrapper(x)
                    known[host] = (w.fixed(), w.slots)
                texts.append(main_text(read(x["html"]), *known[host]))
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    # the pages of a host are dealt out, and its wrapper goes to each part
    given = _host(pages).withColumn("part", F.pmod(F.xxhash64("page_id", "html"), F.lit(FAN)).cast("int"))
    everywhere = found.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(FAN - 1))))
    return given.join(everywhere, ["host", "part"], "left").mapInArrow(work, "page_id long, url string, text string, n_chars long")
