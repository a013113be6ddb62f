"""Main text of web pages by wrappers: union-free regular expressions inferred for each host.

A page is a stream of tags and texts. Pages of one host are aligned with each other: texts
that differ become slots, tags that only some pages have become optional groups, and equal
groups that follow each other become repeated groups; there is no union. Pages of one shape
are counted together, which no order changes; shapes are then aligned in an order that
their hashes set, in two steps, so that a host of any size has one result and no task holds
its pages together. The finished wrapper says which region holds the article and which
parts of it are furniture; pages are then read by it. Trees of any depth are walked without
recursion, and a page is scanned once.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from math import isqrt
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import checkpointed, released

# HTML's element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg annotation annotation-xml".split())
MATH = frozenset("math mi mn mo ms mspace mtext mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd semantics".split())
INLINE = MATH | frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("table ul ol dl select html body article section div".split())

# Elements that are never article text, and words of class, id and role that name page parts: those
# that name nothing else, those that are also words of articles, words that go with either in a name, and words that deny one.
FURNITURE_TAGS = frozenset("head nav footer aside form script style noscript template iframe svg button select menu dialog textarea search title object".split())
SURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising breadcrumb breadcrumbs commentlist comments complementary consent contentinfo cookie cookies disqus footer gdpr masthead menu "
    "modal nav navbar navigation newsletter outbrain pager pagination popup sidebar signup sponsor sponsored subscribe taboola toolbar topbar".split()
)
LIKELY_WORDS = frozenset(
    "banner comment header login notice notices popular promo promoted promotion recommended related replies reply respond search share sharing skip social tags teaser widget widgets".split()
)
JOINING_WORDS = frozenset(
    "area article articles bar block body bottom box button buttons column container content entry form global group icon icons inner item items left link links list main outer page panel post posts "
    "primary reader right secondary section site slot stories text thread top unit user wrap wrapper".split()
)
DENYING_WORDS = frozenset("has hide is no not with without".split())
FURNITURE_WORDS = SURE_WORDS | LIKELY_WORDS
BLOCKS = frozenset("blockquote dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre td th".split())

_PLAIN = re.compile(r"[^>\"']*")
_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORDS = re.compile(r"[a-z]+")


def _named(tag: str, kind: str, token: str) -> str:
    """What a token of a class, id or role says about an element: "3" furniture, "2" likely
    furniture, "h" a header, "1" a hint that the wrapper has to bear out, "" nothing.

    A whole token speaks, or one of several words all of which name or go with page parts;
    another one that has such a word in it only hints. Ids are often anchors of headings.
    """
    words = _WORDS.findall(token)
    named = FURNITURE_WORDS.intersection(words)
    if not named or (len(words) > 1 and words[0] in DENYING_WORDS) or (kind == "id" and tag in BLOCKS):
        return ""
    if not all(w in FURNITURE_WORDS or w in JOINING_WORDS for w in words) or (named == {"header"} and len(words) > 1):
        return "1"
    if named & SURE_WORDS:
        return "3"
    if kind == "id" or tag in BLOCKS:
        return "1"
    return "h" if named == {"header"} and kind == "class" else "3" if kind == "role" else "2"


def _key(tag: str, attributes: str) -> str:
    """A tag with the words of its class and role (a hash stands for more than six), and after
    a "!" what its attributes say: "x" hidden, "m" main, or what ``_named`` gives."""
    words, said = set(), set()
    if attributes.strip():
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), unescape(value.strip("\"'")).lower()
            if name in ("class", "id", "role"):
                for token in value.split():
                    said.add(_named(tag, name, token))
                    if token == "main":
                        said.add("m")
                    if name != "id":
                        words.update(_WORDS.findall(token))
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                said.add("x")
    if not words and not said:
        return tag
    kept = sorted(words)
    if len(kept) > 6:
        kept = [*kept[:6], f"{_text_name(' '.join(kept)):x}"]
    mark = next((m for m in "x3m2h1" if m in said), "")
    return ".".join((tag, *kept)) + (f"!{mark}" if mark else "")


class _Scanner:
    """The tags of a page in order; each character is looked at a fixed number of times.

    An attribute's quotes are respected until one is never closed; from there on the next
    ">" ends a tag. What no ">" follows is text.
    """

    def __init__(self, html: str) -> None:
        self.html = html
        self.last = html.rfind(">")
        self.quotes = True
        self.absent: set[str] = set()

    def next(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """(start, end, tag or "" for other markup, whether it is an end tag, attributes) of the next tag."""
        html = self.html
        while 0 <= (start := html.find("<", at)) < self.last:
            if html.startswith("<!--", start):
                end = html.find("-->", start + 4)
                return start, end + 3 if end >= 0 else len(html), "", False, ""
            if html[start + 1] in "!?":
                return start, html.find(">", start) + 1, "", False, ""
            if m := _TAG.match(html, start + 1):
                end = self._end(m.end())
                return start, end + 1, m[2].lower(), bool(m[1]), html[m.end() : end]
            at = start + 1
        return None

    def _end(self, at: int) -> int:
        end = self.html.find(">", at)
        if end == at or ('"' not in (inside := self.html[at:end]) and "'" not in inside):
            return end
        here = at
        while self.quotes:
            here = _PLAIN.match(self.html, here).end()
            if here < len(self.html) and self.html[here] == ">":
                return here
            close = self.html.find(self.html[here], here + 1) if here < len(self.html) else -1
            if close < 0:
                self.quotes = False
            here = close + 1
        return end

    def closing(self, tag: str, at: int) -> int:
        """Where the next end tag of ``tag`` starts, -1 if there is none."""
        if tag in self.absent:
            return -1
        found = _closing(tag).search(self.html, at)
        if not found or found.start() > self.last:
            self.absent.add(tag)
            return -1
        return found.start()


@lru_cache(1000)
def _closing(tag: str) -> re.Pattern:
    return re.compile("</" + re.escape(tag) + r"(?=[\s/>]|\Z)", re.I | re.A)


def parse(html: str) -> list[Any]:
    """The element tree: [key, children], children being elements or (text, linked letters).

    Inline elements leave only their text; a text is what stands between two block tags.
    Missing and surplus end tags are put up with, as browsers do; comments, raw elements and
    hidden inline elements (to their end tag, or that of their block) are left out.
    """
    root: list[Any] = ["#root", []]
    stack: list[tuple[str, list]] = [("#root", root)]
    opened: dict[str, int] = {}
    text: list[str] = []
    scanner = _Scanner(html)
    linked, in_link, at = 0, False, 0
    # A hidden inline element that is open, and how many of its tag are.
    unseen, depth = "", 0

    def add(part: str) -> None:
        nonlocal linked
        if part and not unseen:
            part = unescape(part)
            text.append(part)
            if in_link:
                linked += len(part)

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                stack[-1][1][1].append((joined, min(linked, len(joined))))
            text.clear()
        linked = 0

    def close(tags: Any, barrier: frozenset) -> None:
        if not any(map(opened.get, tags)):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in tags:
                flush()
                for t, _ in stack[i:]:
                    opened[t] -= 1
                del stack[i:]
                return
            if stack[i][0] in barrier:
                return

    while (found := scanner.next(at)) is not None:
        start, end, tag, ending, attributes = found
        add(html[at:start])
        at = end
        if tag == "br":
            text.append("\n")
        elif tag in INLINE:
            if tag == "a":
                in_link = not ending
            if unseen:
                depth += (tag == unseen) * (-1 if ending else tag not in VOID)
                unseen = unseen if depth else ""
            elif not ending and tag not in VOID and ("hidden" in (low := attributes.lower()) or "style" in low) and _key(tag, attributes).endswith("!x"):
                unseen, depth = tag, 1
        elif ending:
            flush()
            in_link, unseen = False, ""
            close({tag}, frozenset())
        elif tag in RAW:
            e = scanner.closing(tag, at)
            at = html.find(">", e) + 1 if e >= 0 else (len(html) if tag in ("script", "style", "textarea", "title") else at)
        elif tag:
            flush()
            in_link, unseen = False, ""
            if tag in CLOSES_P:
                close({"p"}, SCOPE)
            if tag in SAME:
                close(SAME[tag], SCOPE)
            node = [_key(tag, attributes), []]
            stack[-1][1][1].append(node)
            if tag not in VOID:
                stack.append((tag, node))
                opened[tag] = opened.get(tag, 0) + 1
    add(html[at:])
    flush()
    return root


def furniture(key: str, in_article: bool) -> str:
    """Whether an element holds no article text: "yes", "no", "likely" (unless it holds most of
    its article) or "hint" (if the wrapper bears it out). A header within the article holds its title."""
    name, _, mark = key.partition("!")
    tag = name.partition(".")[0]
    if mark == "x":
        return "yes"
    if tag in ("html", "body", "article", "main"):
        return "no"
    if tag in FURNITURE_TAGS or mark == "3" or (tag == "header" and not in_article):
        return "yes"
    return "likely" if mark == "2" or (mark == "h" and not in_article) else "hint" if mark == "1" else "no"


def is_article(key: str) -> bool:
    return key.partition("!")[0].partition(".")[0] == "article"


def is_main(key: str) -> bool:
    return key.endswith("!m") or key.partition("!")[0].partition(".")[0] == "main"


#: Rules of all hosts are broadcast up to so many bytes; beyond, they are joined, a host's pages dealt to FAN parts.
BROADCAST_BYTES, FAN = 16_000_000, 32
#: A text is shared by a host if it is on so many different pages and all pages agree on it.
CONSTANT_PAGES = 4


class Wrapper:
    """A part of a wrapper: an element with its parts, or a text (key "#").

    ``how`` often it comes is one of "1", "?", "+", "*". While all pages agree on a text,
    ``text`` is its hash, followed by the hashes of up to CONSTANT_PAGES different pages.
    """

    __slots__ = ("key", "how", "pages", "letters", "linked", "text", "parts")

    def __init__(self, key: str, how: str, pages: int, letters: int, linked: int, text: list[int] | None, parts: list[Wrapper]) -> None:
        self.key, self.how, self.pages, self.letters, self.linked, self.text, self.parts = key, how, pages, letters, linked, text, parts

    def nodes(self) -> Iterator[tuple[int, Wrapper]]:
        """(depth, part) of all parts in page order."""
        todo = [(0, self)]
        while todo:
            depth, x = todo.pop()
            yield depth, x
            todo += [(depth + 1, p) for p in reversed(x.parts)]

    def dump(self) -> str:
        rows = [[depth, x.key, x.how, x.pages, x.letters, x.linked, x.text] for depth, x in self.nodes()]
        return json.dumps(rows, separators=(",", ":"), ensure_ascii=False)

    @classmethod
    def load(cls, raw: str) -> Wrapper:
        path: list[Wrapper] = []
        for depth, *fields in json.loads(raw):
            one = cls(*fields, [])
            del path[depth:]
            if path:
                path[-1].parts.append(one)
            path.append(one)
        return path[0]

    def shape(self) -> int:
        """A name of the keys and repeats, equal for pages that differ in texts alone."""
        from xxhash import xxh64

        found = xxh64()
        for depth, x in self.nodes():
            found.update(f"{depth} {x.how}{x.key}\0".encode("utf-8", "surrogatepass"))
        return found.intdigest() - (1 << 63)


def _text_name(text: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def wrapper_of(tree: list[Any]) -> Wrapper:
    """A page as a wrapper, with groups that follow each other folded."""
    order, todo = [], [tree]
    while todo:
        x = todo.pop()
        order.append(x)
        todo += [p for p in x[1] if not isinstance(p, tuple)]
    names = [str(_text_name(p[0])) for x in order for p in x[1] if isinstance(p, tuple)]
    page = _text_name(" ".join(names))
    made: dict[int, Wrapper] = {}
    for x in reversed(order):  # parts before what holds them
        parts = [Wrapper("#", "1", 1, len(p[0]), p[1], [_text_name(p[0]), page], []) if isinstance(p, tuple) else made.pop(id(p)) for p in x[1]]
        made[id(x)] = Wrapper(x[0], "1", 1, 0, 0, None, fold(parts))
    return made[id(tree)]


def fold(parts: list[Wrapper], longest: int = 3) -> list[Wrapper]:
    """Equal groups of up to ``longest`` parts in a row become one repeated group."""
    for size in range(1, longest + 1):
        keys = [x.key for x in parts]
        if not any(map(str.__eq__, keys, keys[size:])):
            continue
        out: list[Wrapper] = []
        i = 0
        while i < len(parts):
            group = parts[i : i + size]
            keys, j = [g.key for g in group], i + size
            if len(group) == size and len({*keys}) == size and "#" not in keys[:1]:
                while [g.key for g in parts[j : j + size]] == keys:
                    group = [align(a, b, same_page=True) for a, b in zip(group, parts[j : j + size])]
                    j += size
            if j > i + size:
                for g in group:
                    g.how = "+" if g.how in "1+" else "*"
                out += group
                i = j
            else:
                out.append(parts[i])
                i += 1
        parts = out
    return parts


def align(a: Wrapper, b: Wrapper, same_page: bool = False) -> Wrapper:
    """One wrapper that both match: parts in a common order are aligned, the others become optional."""
    found = _both(a, b, same_page)
    todo = [(a, b, found)]
    while todo:
        a, b, out = todo.pop()
        i = j = 0
        for p, q in _common([x.key for x in a.parts], [x.key for x in b.parts]):
            out.parts += [_optional(x) for x in (*a.parts[i:p], *b.parts[j:q])]
            one = _both(a.parts[p], b.parts[q], same_page)
            out.parts.append(one)
            if a.parts[p].parts or b.parts[q].parts:
                todo.append((a.parts[p], b.parts[q], one))
            i, j = p + 1, q + 1
        out.parts += [_optional(x) for x in (*a.parts[i:], *b.parts[j:])]
    return found


def _both(a: Wrapper, b: Wrapper, same_page: bool) -> Wrapper:
    """What is at the top of two aligned parts, without what they hold."""
    repeated = a.how in "+*" or b.how in "+*"
    optional = a.how in "?*" or b.how in "?*"
    how = ("*" if optional else "+") if repeated else ("?" if optional else "1")
    pages = max(a.pages, b.pages) if same_page else a.pages + b.pages
    text = None
    if a.text and b.text and a.text[0] == b.text[0] and not same_page:
        text = [a.text[0], *sorted({*a.text[1:], *b.text[1:]})[:CONSTANT_PAGES]]
    return Wrapper(a.key, how, pages, a.letters + b.letters, a.linked + b.linked, text, [])


def _optional(x: Wrapper) -> Wrapper:
    return Wrapper(x.key, "*" if x.how in "+*" else "?", x.pages, x.letters, x.linked, x.text, x.parts)


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence. A row of its table is one number whose bits
    say where it doesn't grow; every so many rows are kept, the rest are made again."""
    if a == b:
        return [(i, i) for i in range(len(a))]
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    stop = 0
    while stop < min(len(a), len(b)) - start and a[-1 - stop] == b[-1 - stop]:
        stop += 1
    head = [(i, i) for i in range(start)]
    tail = [(len(a) - stop + i, len(b) - stop + i) for i in range(stop)]
    rows, columns = a[start : len(a) - stop], b[start : len(b) - stop]
    ones, where = (1 << len(columns)) - 1, dict.fromkeys(columns, 0)
    for j, key in enumerate(columns):
        where[key] |= 1 << j

    def after(bits: int, some: list[str]) -> list[int]:
        found = [bits]
        for key in some:
            both = found[-1] & where.get(key, 0)
            found.append((found[-1] + both | found[-1] - both) & ones)
        return found

    step = 1 + isqrt(len(rows))
    kept = [ones]
    for i in range(0, len(rows), step):
        kept.append(after(kept[-1], rows[i : i + step])[-1])
    middle, j = [], len(columns)
    for k in range(len(kept) - 2, -1, -1):
        table = after(kept[k], rows[k * step : (k + 1) * step])
        i = len(table) - 1
        while i and j:
            if table[i] >> (j - 1) & 1:
                j -= 1
            elif table[i - 1] >> (j - 1) & 1:
                i, j = i - 1, j - 1
                middle.append((start + k * step + i, start + j))
            else:
                i -= 1
    return head + middle[::-1] + tail


def to_regex(w: Wrapper) -> str:
    """The wrapper as an expression, for people."""
    out: list[str] = []
    todo: list[Wrapper | str] = [w]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.key == "#":
            out.append("#" if x.how == "1" else f"(#){x.how}")
        else:
            end = f"</{x.key.partition('!')[0].partition('.')[0]}>"
            out.append(f"<{x.key}>" if x.how == "1" else f"(<{x.key}>")
            todo += [end if x.how == "1" else f"{end}){x.how}", *reversed(x.parts)]
    return " ".join(out)


class _Paths:
    """The paths of a wrapper's elements as a tree; a path is known by a hash of its keys."""

    def __init__(self) -> None:
        self.name, self.parent, self.below, self.heading = [], [], [], []
        self.at: dict[tuple[int, str], int] = {}

    def child(self, parent: int, key: str) -> int:
        if (parent, key) not in self.at:
            self.at[parent, key] = len(self.name)
            if parent >= 0:
                self.below[parent].append(len(self.name))
            self.name.append(path_name(self.name[parent] if parent >= 0 else 0, key))
            self.parent.append(parent)
            self.below.append([])
            self.heading.append(key.partition("!")[0].partition(".")[0] in HEADINGS)
        return self.at[parent, key]

    def number(self) -> None:
        """Give each path its place in the tree and the end of what lies below it."""
        self.first, self.end, todo, n = [0] * len(self.name), [0] * len(self.name), [0], 0
        while todo:
            x = todo.pop()
            if x < 0:
                self.end[~x] = n
                continue
            self.first[x], n = n, n + 1
            todo += [~x, *reversed(self.below[x])]

    def common(self, some: list[int]) -> int:
        """The smallest element that all paths lie in: of the first and the last one."""
        lo, hi = min(some, key=self.first.__getitem__), max(some, key=self.first.__getitem__)
        while not self.first[lo] <= self.first[hi] < self.end[lo]:
            lo = self.parent[lo]
        return lo

    def inside(self, path: int, region: int) -> bool:
        return self.first[region] <= self.first[path] < self.end[region]


HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def path_name(parent: int, key: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(f"{parent} {key}".encode("utf-8", "surrogatepass"))


def _is_shared(x: Wrapper, pages: int, constant_pages: int) -> bool:
    """Whether all of several different pages have one text word for word."""
    return x.text is not None and x.how == "1" and x.pages >= pages and len(x.text) > constant_pages


class _Part:
    """A part of a wrapper on its way through ``rules_of``: what it holds besides sure furniture."""

    __slots__ = ("x", "path", "holder", "verdict", "in_article", "in_main", "letters", "linked", "least", "varies", "article")

    def __init__(self, x: Wrapper, path: int, holder: int, verdict: str, in_article: bool, in_main: bool) -> None:
        self.x, self.path, self.holder, self.verdict, self.in_article, self.in_main = x, path, holder, verdict, in_article, in_main
        self.letters = self.linked = 0
        #: Pages that have the rarest text, whether a text varies, and whether there is an article with text that isn't links.
        self.least, self.varies, self.article = float("inf"), False, False


def _walk(w: Wrapper, paths: _Paths, constant_pages: int) -> list[_Part]:
    """All parts outside sure furniture in page order, with what they hold."""
    parts: list[_Part] = []
    order = [(w, -1, -1, False, False)]
    while order:
        x, parent, holder, in_article, in_main = order.pop()
        if x.key == "#":
            one = _Part(x, parent, holder, "no", in_article, in_main)
            one.letters, one.linked, one.least, one.varies = x.letters, x.linked, x.pages, not _is_shared(x, 0, constant_pages)
            parts.append(one)
            continue
        path = paths.child(parent, x.key)
        verdict = furniture(x.key, in_article)
        if verdict == "yes":
            continue
        parts.append(_Part(x, path, holder, verdict, in_article, in_main))
        article = in_article or is_article(x.key)
        order += [(p, path, len(parts) - 1, article, in_main or is_main(x.key)) for p in reversed(x.parts)]
        holder = len(parts) - 1
    for one in reversed(parts):
        own = is_article(one.x.key) and one.x.key != "#"
        one.article = one.article or (own and one.letters > 2 * one.linked)
        if one.holder >= 0:
            up = parts[one.holder]
            up.letters, up.linked = up.letters + one.letters, up.linked + one.linked
            up.least, up.varies, up.article = min(up.least, one.least), up.varies or one.varies, up.article or one.article
    return parts


def rules_of(w: Wrapper, constant_pages: int = CONSTANT_PAGES) -> dict[str, list[int]]:
    """Where the article is: paths of its ``regions``, of texts that are furniture within
    (``fixed``), of elements that are furniture as a whole (``dropped``), and of those that are
    none in spite of their name (``kept``).

    Articles with text that isn't links for the greater part are the regions, and they are taken whole.
    So are main elements, but for texts that all pages of the host share; of a main element around
    articles, headings and texts that vary and aren't links. Without any, the region is the smallest element that
    holds all texts that vary between pages and aren't links (all texts, if little varies). In it, texts that
    all of several different pages of the host share word for word are furniture, if the other
    texts outweigh them, and so are its children that hold links only.

    What a name makes likely furniture is so unless it holds most of its article; what a name hints
    at only if nothing on that path varies. (Whether one is links for the greater part is seen on each page.)
    """
    paths = _Paths()
    parts = _walk(w, paths, constant_pages)
    # By path: letters that aren't links, whether all parts are shared; and the letters of the article around.
    own: Counter = Counter()
    shared_path: dict[int, bool] = {}
    around: dict[int, int] = {}
    kind: dict[int, str] = {}
    enclosing: list[int] = []
    for one in parts:
        x = one.x
        base = one.holder if one.holder >= 0 and (is_article(parts[one.holder].x.key) or is_main(parts[one.holder].x.key)) else (enclosing[one.holder] if one.holder >= 0 else 0)
        enclosing.append(base)
        if one.verdict in ("likely", "hint"):
            own[one.path] += one.letters - one.linked
            shared_path[one.path] = shared_path.get(one.path, True) and not one.varies and one.least >= x.pages
            around[one.path] = max(around.get(one.path, 0), parts[base].letters - parts[base].linked)
            kind[one.path] = one.verdict
    kept = {p for p, k in kind.items() if k == "likely" and 2 * own[p] > around[p] and not shared_path[p]}
    dropped = {p for p, k in kind.items() if k == "hint" and shared_path[p]}
    gone: set[int] = set()
    slots: list[tuple[int, Wrapper]] = []
    regions: set[int] = set()
    mains: dict[int, bool] = {}
    loose: list[tuple[int, Wrapper]] = []  # texts of a main element outside its articles
    plain: list[tuple[int, Wrapper]] = []  # texts of a main element without articles
    pages: dict[int, int] = {}
    main_at: list[int] = []
    for i, one in enumerate(parts):
        x = one.x
        main_at.append(main_at[one.holder] if one.holder >= 0 else -1)
        if one.holder in gone or one.path in dropped or (one.verdict == "likely" and one.path not in kept) or (one.verdict == "hint" and 2 * one.linked >= one.letters > 0):
            gone.add(i)
            continue
        if x.key == "#":
            slots.append((one.path, x))
            if one.in_main and not one.in_article:
                (loose if mains[main_at[i]] else plain).append((one.path, x))
            continue
        pages[one.path] = pages.get(one.path, 0) + x.pages
        if is_article(x.key) and not one.in_article and one.letters > 2 * one.linked:
            regions.add(one.path)
        elif is_main(x.key) and not one.in_article and not one.in_main and one.letters > 0:
            mains[i] = one.article
            main_at[i] = i
            regions.add(one.path)
        elif is_main(x.key) and not one.in_main:
            main_at[i], mains[i] = i, False
    paths.number()
    chosen, fixed = set(regions), set()
    letters: Counter = Counter()
    links: Counter = Counter()
    for p, x in slots:
        letters[p] += x.letters
        links[p] += x.linked
    linked = {p: 2 * links[p] >= letters[p] for p in letters}
    heading = paths.heading.__getitem__
    # Around articles, only what is known to vary stays, and headings.
    varied = {p for p, x in loose if x.text is None}
    fixed |= {p for p, _ in loose if linked[p] or (p not in varied and not heading(p))}
    fixed |= _shared_texts([(p, _is_shared(x, pages[_main_of(paths, p, regions)], constant_pages), x.letters) for p, x in plain if not linked[p]], heading)
    if slots and not chosen:
        text = [(p, x) for p, x in slots if not linked[p]] or slots
        varying = [(p, x.letters) for p, x in text if not _is_shared(x, w.pages, constant_pages)]
        # Where little but titles varies, pages are copies of each other and nothing is told apart.
        outweigh = 2 * sum(n for p, n in varying if not heading(p)) > sum(x.letters for p, x in text if not heading(p))
        region = paths.common([p for p, _ in varying] if outweigh else [p for p, _ in text])
        inside = [(p, x) for p, x in slots if paths.inside(p, region)]
        shared = [(p, _is_shared(x, pages[region], constant_pages), x.letters) for p, x in inside if not linked[p]]
        fixed |= _shared_texts(shared, heading)
        starts = [(paths.first[b], b) for b in paths.below[region]]
        branch = lambda p: bisect_right(starts, (paths.first[p], len(paths.name)))
        branches = {branch(p) for p, _, _ in shared}
        if shared:
            fixed |= {p for p, _ in inside if linked[p] and branch(p) not in branches}
        chosen.add(region)
    named = {"regions": chosen, "fixed": fixed, "dropped": dropped, "kept": kept}
    return {k: sorted(paths.name[p] for p in some) for k, some in named.items()}


def _main_of(paths: _Paths, path: int, regions: set[int]) -> int:
    while path not in regions:
        path = paths.parent[path]
    return path


def _shared_texts(shared: list[tuple[int, bool, int]], heading: Any) -> set[int]:
    """Of (path, whether all pages share the text, letters), the paths of shared texts, if the others outweigh them.
    A constant heading is a title that happens to be shared; a path that varies anywhere is kept."""
    varied = {p for p, c, _ in shared if not c}
    same = {p for p, c, _ in shared if c and not heading(p)} - varied
    return same if sum(n for p, _, n in shared if p in varied and not heading(p)) > sum(n for p, _, n in shared if p in same) else set()


def _links_of(tree: list[Any]) -> dict[int, bool]:
    """By element, whether its text is links for the greater part."""
    order, todo = [], [tree]
    while todo:
        x = todo.pop()
        order.append(x)
        todo += [p for p in x[1] if not isinstance(p, tuple)]
    sums: dict[int, tuple[int, int]] = {}
    for x in reversed(order):
        own = [p if isinstance(p, tuple) else sums[id(p)] for p in x[1]]
        sums[id(x)] = sum(len(n) if isinstance(n, str) else n for n, _ in own), sum(k for _, k in own)
    return {k: 2 * linked >= letters > 0 for k, (letters, linked) in sums.items()}


def main_text(tree: list[Any], rules: dict[str, list[int]]) -> str:
    """The texts of a page's regions in page order, joined by a space."""
    regions, fixed, dropped, kept = (frozenset(rules[k]) for k in ("regions", "fixed", "dropped", "kept"))
    out: list[str] = []
    links: dict[int, bool] = {}
    todo: list[tuple] = [(tree, 0, False, False)]
    while todo:
        x, parent, inside, in_article = todo.pop()
        if isinstance(x, tuple):
            if inside and parent not in fixed:
                out.append(x[0])
            continue
        verdict, path = furniture(x[0], in_article), path_name(parent, x[0])
        if verdict == "hint" and path not in dropped:
            links = links or _links_of(tree)
            if links[id(x)]:
                continue
        elif verdict != "no" and path not in kept:
            continue
        inside, in_article = inside or path in regions, in_article or is_article(x[0])
        todo += [(part, path, inside, in_article) for part in reversed(x[1])]
    return " ".join(out)


def extract(html: str, rules: dict[str, list[int]] | None) -> str:
    """A page's main text; a page that its host's wrapper finds nothing in has its own wrapper."""
    tree = parse(html)
    found = main_text(tree, rules) if rules else ""
    return found or main_text(tree, rules_of(wrapper_of(tree)))


def host(url: str = "url") -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def infer(pages: DataFrame, fan: int = 32) -> DataFrame:
    """(host, wrapper): one wrapper for each host, over all its pages.

    Each task counts its pages of one shape together. The shapes of a host are dealt to
    ``fan`` parts by their hash, which also orders them; their wrappers are aligned within
    the parts and then across them, one after another. Neither the order of pages nor their
    partitioning changes the result.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], Wrapper] = {}
        held = 0
        for batch in batches:
            for name, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                one = wrapper_of(parse(html))
                key = name, one.shape()
                if key in found:
                    found[key] = align(found[key], one)
                else:
                    found[key] = one
                    held += sum(1 for _ in one.nodes())
                if held > 500_000:
                    yield out(found)
                    found, held = {}, 0
        if found:
            yield out(found)

    def out(found: dict[tuple[str, int], Wrapper]) -> pa.RecordBatch:
        columns = [h for h, _ in found], [s for _, s in found], [w.dump() for w in found.values()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string()))], names=["host", "shape", "wrapper"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of sorted rows, those of one shape and then the shapes of one part as one row."""
        at: tuple | None = None
        whole: Wrapper | None = None
        same: tuple[int, Wrapper] | None = None

        def row() -> pa.RecordBatch:
            w = align(whole, same[1]) if whole else same[1]
            return pa.record_batch([pa.array([at[0]], pa.string()), pa.array([at[1]], pa.int64()), pa.array([w.dump()], pa.string())], names=["host", "shape", "wrapper"])

        for batch in batches:
            for name, salt, shape, raw in zip(*(batch.column(c).to_pylist() for c in ("host", "salt", "shape", "wrapper"))):
                if at is not None and at != (name, salt):
                    yield row()
                    whole = same = None
                at, one = (name, salt), Wrapper.load(raw)
                if same and same[0] != shape:
                    whole, same = align(whole, same[1]) if whole else same[1], None
                same = (shape, align(same[1], one) if same else one)
        if at is not None:
            yield row()

    schema = "host string, shape long, wrapper string"
    own = pages.select(host().alias("host"), F.coalesce("html", F.lit("")).alias("html")).mapInArrow(released(part), schema)
    for salt in (F.pmod("shape", F.lit(fan)), F.lit(-1).cast("long")):
        own = own.withColumn("salt", salt).repartition("host", "salt").sortWithinPartitions("host", "salt", "shape").mapInArrow(released(merged), schema)
    return own.select("host", "wrapper")


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``.

    A null or empty html has an empty text; rows without a url form a host of their own;
    repeated rows are kept; an empty table gives an empty result; other columns are
    ignored. Nothing of the article is dropped or cut.
    """
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def rules(wrapper):
        return wrapper.map(lambda w: json.dumps(rules_of(Wrapper.load(w))))

    ruled = checkpointed(infer(pages).select("host", rules("wrapper").alias("rules")))
    bytes_of_rules = ruled.agg(F.sum(F.octet_length("host") + F.octet_length("rules"))).first()[0] or 0

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Any] = {}
        for batch in batches:
            found = []
            for html, raw in zip(batch.column("html").to_pylist(), batch.column("rules").to_pylist()):
                if raw is not None and raw not in known:
                    if len(known) > 10_000:
                        known.clear()
                    known[raw] = json.loads(raw)
                found.append(extract(html, known.get(raw)))
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), host().alias("host"))
    if bytes_of_rules <= BROADCAST_BYTES:
        ruled = own.join(F.broadcast(ruled), "host", "left")
    else:  # pages of one host are dealt out, its rules go to all its parts
        salt = F.pmod(F.xxhash64("html"), F.lit(FAN))
        ruled = own.withColumn("salt", salt).join(ruled.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(FAN - 1)).cast("array<long>"))), ["host", "salt"], "left")
    return ruled.select("page_id", "url", "html", "rules").mapInArrow(released(work), "page_id long, url string, text string, n_chars long")
