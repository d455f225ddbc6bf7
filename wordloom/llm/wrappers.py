"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of a host.

A page is a stream of block tags and texts, nested as the tags nest; inline tags belong to the text that they mark. A text
that stands under the same tags on ``TEMPLATE_SHARE`` of a host's pages (``TEMPLATE_PAGES`` at least) is a symbol of its
own, part of the template; any other text is the symbol of a slot. The streams of a host are then aligned one after the other:
equal symbols match, and what they hold is aligned in turn; a symbol that one side lacks becomes a repetition if it, or the
sequence it stands in, repeats its neighbours, and an optional group otherwise. Repeated groups of several members may
have optional ones. The result is one expression per host without alternatives, for instance
``<ul>(<li>#</li>)+</ul>(<aside>#</aside>)?``. A list of more than ``LIMIT`` symbols is generalised to one repeated group of its
distinct symbols, so an expression does not grow with the number of pages.

Slots carry what they held over all pages (pages, characters, characters in links). From these the slots of the main text
are chosen: those in an article or main element, or else those below the deepest container with most of the slots'
text outside links; never those in menus, page headers, footers, sidebars, notices, adverts, forms and comments as tags, roles and
class names mark them. If a host's text varies only in what class names call noise, the names are not believed.
Extraction aligns each page with its host's expression and keeps the texts that fall into these slots; template texts
fall into none.

Texts are counted by (host, digest), so nothing of a host is in one place. Each task infers expressions of the pages that it
reads, so only expressions are shuffled, by host and a salt and then by host. Templates and wrappers are written, so the
planner knows their size: small, they are broadcast; else pages meet them by host, and a hot host may be split.

Edge cases: null and empty html have the empty text; pages without a usable url share one wrapper; a page none of
whose texts falls into a slot of the main text (a copy that is on most of its host's pages, for instance) is read against a
wrapper of its own; repeated rows get equal results; unclosed and misnested tags close as in browsers, and what is cut off
ends with the page; elements nested deeper than ``DEPTH`` count as part of the element at that depth; pages of any length
are read whole, in linear time; other columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import json
import re
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, table, written

#: Parts that one host's wrappers are merged in first.
SALTS = 64
#: Share of a host's slot text that its main element holds, where no tag names it.
MAIN_SHARE = 0.6
#: A text on this share of a host's pages, and on so many, is part of the template.
TEMPLATE_SHARE = 0.9
TEMPLATE_PAGES = 8
#: Symbols of one list, before it is generalised.
LIMIT = 64
DEPTH = 100
#: Distinct structures that a task holds at a time.
HELD = 4000

_ATTRS = r"(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^'\">])*+"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(script|style|title|textarea|xmp|noscript|template|svg|iframe|noembed|noframes)\b{_ATTRS}>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    rf"|<(/?)([a-zA-Z][^\s/>]*)({_ATTRS})(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style|itemprop)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/"']|$)""", re.IGNORECASE)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section select summary table tbody td tfoot"
    " th thead tr ul".split()
)
#: Elements that may hold the main text as a whole.
_CONTAINERS = frozenset(["", "html", "body", "div", "section", "table", "tbody", "tr", "td", "center", "main", "article", "dl"])
#: A start tag of the key closes an open element of the first set, unless one of the second stands between.
_CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "body": (frozenset(["head"]), frozenset(["body"])),
}
_WALLS = frozenset(["table", "button", "article", "section", "div", "body"])
_NOISE_TAGS = frozenset("head nav footer aside form button select option input label dialog menu object audio video canvas datalist".split())
_NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation"
    " breadcrumb breadcrumbs pagination pager toolbar cookie cookies consent gdpr notice alert popup modal overlay newsletter"
    " subscribe signup login share sharing social related recommended widget footer copyright comment comments commentlist"
    " respond reply replies discussion disqus contentinfo complementary search masthead hidden".split()
)
_ARTICLE_NOISE = frozenset("comment comments reply related teaser ad ads advert promo sponsored".split())
#: A name with one of these tells what a page has or allows, not what the element is.
_STATES = frozenset("has with without no is not enabled disabled open opened closed allowed on off count".split())

#: Marks of a tag: noise by its name or state, noise by its class, main element.
HARD, SOFT, MAIN = "!", "~", "@"


@lru_cache(20_000)
def _element(name: str, attrs: str) -> tuple[str, int, bool]:
    """Tag with its classes, kind of noise (0 none, 1 page layout, 2 header, 3 other, 4 by class only) and main (bool)."""
    found = {k.lower(): v.strip("\"'").lower() for k, v in _ATTR.findall(attrs)} if attrs.strip(" /") else {}
    words = set()
    for n in " ".join(found.get(k, "") for k in ("class", "id", "role")).split():
        parts = [p for p in re.split(r"[^a-z]+", n) if p]
        # the first and the last word of a name say what it is
        if parts and not _STATES & set(parts):
            words.update((parts[0], parts[-1]))
    classes = {re.sub(r"[^a-z_-]+", "", n) for n in found.get("class", "").split()}
    tag = name + "".join("." + n for n in sorted(classes - {""}))
    main = name in ("article", "main") or found.get("role") in ("main", "article") or found.get("itemprop") == "articlebody"
    style = found.get("style", "").replace(" ", "")
    if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style:
        return tag, 3, False
    if name in ("html", "body", "main"):
        return tag, 0, name == "main"
    if name == "article":
        return tag, 3 if words & _ARTICLE_NOISE else 0, not words & _ARTICLE_NOISE
    if name in _NOISE_TAGS:
        return tag, 1 if name in ("nav", "head", "menu") else 3, False
    if words & _NOISE_WORDS:
        return tag, 4, False
    if name == "header" or "header" in words:
        return tag, 2, False
    return tag, 0, main


class _Open:
    __slots__ = ("name", "tag", "path", "kids", "noise", "main", "link", "parts", "links")

    def __init__(self, name, tag, path, noise, main, link):
        self.name, self.tag, self.path, self.noise, self.main, self.link = name, tag, path, noise, main, link
        self.kids: list = []
        self.parts: list[str] = []
        self.links = 0


def digest(path: str, text: str) -> int:
    """A text under its tags, as a signed 64-bit number."""
    return xxhash.xxh64_intdigest(f"{path}\n{text}") - (1 << 63)


def read(html: str | None, template: frozenset = frozenset()):
    """(tree, texts) of a page. tree: nested (tag, children); the children are trees, "#" for a slot's text and "=..." for a
    text of the template. texts: (path or "" in noise, text, characters in links) for each "#" and "=..." in page order."""
    root = _Open("", "", "", 0, False, False)
    stack, texts = [root], []
    deep: dict[str, int] = {}
    html = html or ""

    def flush():
        top = stack[-1]
        if top.parts:
            text = " ".join("".join(top.parts).split())
            if text:
                path = "" if top.noise else top.path
                texts.append((path, text, top.links))
                known = template and path and digest(path, text)
                top.kids.append(f"={known:x}" if known and known in template else "#")
            top.parts, top.links = [], 0

    def close(size: int):
        while len(stack) > size:
            flush()
            done = stack.pop()
            stack[-1].kids.append((done.tag, tuple(done.kids)))

    def text(part: str):
        top = stack[-1]
        part = entities.unescape(part) if "&" in part else part
        top.parts.append(part)
        if top.link:
            top.links += len(part.strip())

    at = 0
    for m in _TOKEN.finditer(html):
        if m.start() > at:
            text(html[at : m.start()])
        at = m.end()
        name = m[3]
        if not name:
            continue
        name = name.lower()
        block = name in _BLOCK
        if m[2]:
            if deep.get(name):
                deep[name] -= 1
                text(" ")
                continue
            if name == "a":
                stack[-1].link = False
                continue
            if not block and all(s.name != name for s in stack[1:]):
                continue
            if block:
                flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    close(k)
                    break
                if not block and stack[k].name in _BLOCK:
                    break
            continue
        if name == "br" or (block and len(stack) > DEPTH):
            text(" ")
        if name in _VOID:
            if block:
                flush()
            continue
        if block:
            flush()
            ends, walls = _CLOSES.get(name, (frozenset(), frozenset()))
            if name not in ("option", "body"):
                ends = ends | {"p"}
                walls = walls | _WALLS - {name}
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in ends:
                    close(k)
                    break
                if stack[k].name in walls:
                    break
        tag, noise, main = _element(name, m[4])
        if not block and not noise and not main:
            if name == "a":
                stack[-1].link = True
            continue
        if main and name in ("article", "main"):
            # an article within an unclosed menu or page header: those have ended
            for k in range(1, len(stack)):
                if stack[k].noise in (1, 2) and all(s.noise < 3 for s in stack[k:]):
                    close(k)
                    break
        if len(stack) > DEPTH:
            deep[name] = deep.get(name, 0) + 1
            continue
        top = stack[-1]
        if noise == 2 and top.main:
            noise = 0  # the article's own heading
        main = main and not noise
        tag += HARD if 0 < noise < 4 else SOFT if noise else MAIN if main else ""
        stack.append(_Open(name, tag, f"{top.path}/{tag}", max(top.noise, noise), top.main or main, top.link or name == "a"))
    if at < len(html):
        text(html[at:])
    close(1)
    flush()
    return ("", tuple(root.kids)), texts


# --- union-free expressions -------------------------------------------------------------------------------------
# A node is [tag, items, key]: an element; ["#", [pages, characters, characters in links], "#"]: a slot; ["=...", [], "=..."]:
# a text of the template; ["()", items, key]: a group. An item is [optional, repeated, node]. Nodes of one key match.


def build(tree, stats) -> list:
    """The expression of one page; stats gives what each text in turn adds to its slot."""
    if isinstance(tree, str):
        n = next(stats)
        return [tree, list(n) if tree == "#" else [], tree]
    items = [[False, False, build(k, stats)] for k in tree[1]]
    # an element that holds template texts and no slot is told from others by them
    fixed = [] if any(_has_slot(x[2]) for x in items) else [x[2][2] for x in items if "=" in x[2][2]]
    return [tree[0], items, tree[0] + (f"={xxhash.xxh64_hexdigest('|'.join(fixed))}" if fixed else "")]


def _has_slot(n: list) -> bool:
    return n[0] == "#" or (n[2] == n[0] and any(_has_slot(x[2]) for x in n[1]) if n[0] != "()" and n[0][:1] != "=" else False)


def letters(item: list) -> list[str]:
    """The keys that an item matches."""
    n = item[2]
    return [k[2][2] for k in n[1]] if n[0] == "()" else [n[2]]


def bare(key: str) -> str:
    """A key without classes and texts."""
    if key[:1] in ("#", "="):
        return key
    marks = "".join(m for m in (HARD, SOFT, MAIN) if m in key)
    return re.split(r"[.!~@=]", key, maxsplit=1)[0] + marks


def merge(a: list, b: list) -> list:
    """The expression of two nodes of one key."""
    if a[0] == "#":
        return ["#", [x + y for x, y in zip(a[1], b[1], strict=True)], "#"]
    if a[0][:1] == "=":
        return a
    return [a[0], align(a[1], b[1]), a[2]]


def group(items: list, anyhow: bool = False) -> list:
    """Items that follow each other as one repeated group; members that some pass lacks, or all (anyhow), are optional."""
    members: dict[str, list] = {}
    lacks: set[str] = set()
    passes: list[set] = [set()]
    place = -1
    optional = True
    for x in items:
        optional = optional and x[0]
        inner = x[2][1] if x[2][0] == "()" else [x]
        if x[2][0] == "()":
            lacks.update(k[2][2] for k in inner if k[0])
            passes.append(set())
            place = -1
        for k in inner:
            key = k[2][2]
            if x[0]:
                lacks.add(key)
            order = list(members)
            at = order.index(key) if key in members else len(order)
            if at <= place:
                passes.append(set())
            place = at
            passes[-1].add(key)
            members[key] = [False, members.get(key, k)[1] or k[1], merge(members[key][2], k[2]) if key in members else k[2]]
        if x[2][0] == "()":
            passes.append(set())
            place = -1
    passes = [p for p in passes if p]
    out = [[anyhow or k in lacks or any(k not in p for p in passes), m[1], m[2]] for k, m in members.items()]
    if len(out) == 1:
        return [optional, True, out[0][2]]
    return [optional or all(x[0] for x in out), True, ["()", out, "(" + " ".join(members) + ")"]]


def coarse(items: list) -> list:
    """Items whose elements are told apart by their bare tags only."""
    out: list = []
    for x in items:
        n = x[2]
        if n[0] == "()":
            out += coarse(n[1])
        else:
            b = bare(n[2])
            out.append([x[0], x[1], n if b == n[2] else [b, n[1], b]])
    return out


def short(items: list) -> list:
    """A list of LIMIT items at most that matches all that items do."""
    if len(items) <= LIMIT:
        return items
    out: list = []
    for x in items:
        if out and out[-1][2][2] == x[2][2] and x[2][0] != "()":
            out[-1] = [out[-1][0] and x[0], True, merge(out[-1][2], x[2])]
        else:
            out.append(x)
    if len(out) <= LIMIT:
        return out
    whole = group(out, anyhow=True)
    if whole[2][0] == "()" and len(whole[2][1]) > LIMIT:
        whole = group(coarse(out), anyhow=True)
    return [whole]


def paired(a: list[list[str]], many_a: list[bool], b: list[list[str]], many_b: list[bool]) -> list[tuple[int, int]]:
    """Longest alignment of two lists of letters, as (i, j) in order; what is repeated may match several in turn."""
    n, m = len(a), len(b)
    sets = [set(x) for x in a]
    fits = [[not s.isdisjoint(y) for y in b] for s in sets]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below, fit, many = best[i], best[i + 1], fits[i], many_a[i]
        for j in range(m - 1, -1, -1):
            v = row[j + 1] if row[j + 1] > below[j] else below[j]
            if fit[j]:
                w = below[j + 1]
                if many and row[j + 1] > w:
                    w = row[j + 1]
                if many_b[j] and below[j] > w:
                    w = below[j]
                v = w + 1 if w >= v else v
            row[j] = v
    out, i, j = [], 0, 0
    while i < n and j < m:
        here = best[i][j]
        if fits[i][j]:
            if here == best[i + 1][j + 1] + 1:
                out.append((i, j))
                i, j = i + 1, j + 1
                continue
            if many_a[i] and here == best[i][j + 1] + 1:
                out.append((i, j))
                j += 1
                continue
            if many_b[j] and here == best[i + 1][j] + 1:
                out.append((i, j))
                i += 1
                continue
        if here == best[i + 1][j]:
            i += 1
        else:
            j += 1
    return out


def align(a: list, b: list) -> list:
    """The expression of two lists of items."""
    if len(a) == len(b) and all(x[2][2] == y[2][2] for x, y in zip(a, b, strict=True)):
        return [[x[0] or y[0], x[1] or y[1], merge(x[2], y[2]) if x[2][0] != "()" else group([x, y])[2]] for x, y in zip(a, b, strict=True)]
    a, b = short(a), short(b)
    pairs = paired([letters(x) for x in a], [x[1] for x in a], [letters(x) for x in b], [x[1] for x in b])
    out: list = []  # (item, whether one side lacks it)
    i = j = at = 0
    while at < len(pairs):
        lo_i, lo_j = pairs[at]
        hi_i, hi_j = lo_i, lo_j
        while at + 1 < len(pairs) and (pairs[at + 1][0] == hi_i or pairs[at + 1][1] == hi_j):
            at += 1
            hi_i, hi_j = pairs[at]
        at += 1
        only_a, only_b = ([([True, x[1], x[2]], True) for x in own] for own in (a[i:lo_i], b[j:lo_j]))
        # what repeats the items that follow stands next to them
        ahead = [x[2][2] for x in a[i:lo_i]] == [x[2][2] for x in a[lo_i : 2 * lo_i - i]]
        out += only_b + only_a if ahead else only_a + only_b
        xs, ys = a[lo_i : hi_i + 1], b[lo_j : hi_j + 1]
        optional = all(x[0] for x in xs) or all(y[0] for y in ys)
        both = xs + ys
        if len({k for x in both for k in letters(x)}) > 1:
            joined = group(both)
            joined[0] = optional or joined[0]
        else:
            node = both[0][2]
            for x in both[1:]:
                node = merge(node, x[2])
            joined = [optional, len(xs) > 1 or len(ys) > 1 or any(x[1] for x in both), node]
        out.append((joined, False))
        i, j = hi_i + 1, hi_j + 1
    out += [([True, x[1], x[2]], True) for x in a[i:]] + [([True, x[1], x[2]], True) for x in b[j:]]
    return short(repeats(out))


def repeats(out: list) -> list:
    """Turns items that one side lacks into repetitions where they repeat their neighbours."""
    done: list = []
    for x, loose in out:
        if done and (loose or done[-1][1]) and not set(letters(x)).isdisjoint(letters(done[-1][0])):
            y, other = done[-1]
            joined = group([y, x])
            joined[0] = x[0] and y[0]
            done[-1] = (joined, loose and other)
        else:
            done.append((x, loose))
    size = 2
    while 2 * size <= len(done):
        keys = [x[2][2] for x, _ in done]
        at = next((k for k in range(len(done) - 2 * size + 1) if keys[k : k + size] == keys[k + size : k + 2 * size] and any(loose for _, loose in done[k : k + 2 * size])), None)
        if at is None:
            size += 1
            continue
        span = [x for x, _ in done[at : at + 2 * size]]
        halves = (span[:size], span[size:])
        joined = group([[False, x[1], x[2]] for x in span])
        joined[0] = all(all(x[0] for x in h) for h in halves)
        done[at : at + 2 * size] = [(joined, all(loose for _, loose in done[at : at + 2 * size]))]
        size = 2
    return [x for x, _ in done]


def expression(n: list) -> str:
    """A node as text; texts of the template are shown as "=" and their digest."""
    if n[0][:1] in ("#", "="):
        return n[0]
    inner = ""
    for optional, repeated, kid in n[1]:
        part = expression(kid)
        many = "*" if optional and repeated else "?" if optional else "+" if repeated else ""
        inner += f"({part}){many}" if many else part
    return inner if n[0] in ("", "()") else f"<{n[0]}>{inner}</{re.split(r'[.!~@]', n[0], maxsplit=1)[0]}>"


def choose(tree: list) -> None:
    """Marks the slots of the main text: a fourth member, True."""
    named, plain, soft = [], [], []

    def walk(n: list, hard: bool, by_class: bool, main: bool):
        if n[0] == "#":
            if not hard:
                (soft if by_class else named if main else plain).append(n)
        elif n[0][:1] != "=":
            marks = n[0]
            hard, by_class, main = hard or HARD in marks, by_class or SOFT in marks, main or MAIN in marks
            for x in n[1]:
                walk(x[2], hard, by_class, main)

    walk(tree, False, False, False)
    if not named:
        linked = [n for n in plain if 2 * n[1][2] < n[1][1]] or plain
        named = _densest(tree, {id(n) for n in linked})
    if not named:
        named = [n for n in soft if n[1][0] >= TEMPLATE_PAGES]
    for n in named:
        n.append(True)


def _densest(tree: list, among: set[int]) -> list:
    """The slots below the deepest container with most of the text of the slots ``among``."""
    below: dict[int, list] = {}

    def gather(n: list) -> list:
        if n[0] == "#":
            return [n] if id(n) in among else []
        found = [] if n[0][:1] == "=" else [s for x in n[1] for s in gather(x[2])]
        below[id(n)] = found
        return found

    weigh = lambda found: sum(max(0, n[1][1] - n[1][2]) for n in found)
    total, here = weigh(gather(tree)), tree
    while total:
        inside = [x[2] for x in here[1] if x[2][0] == "()" or re.split(r"[.!~@]", x[2][0], maxsplit=1)[0] in _CONTAINERS]
        heavy = [n for n in inside if weigh(below[id(n)]) >= MAIN_SHARE * total]
        if not heavy:
            break
        here = heavy[0]
    return below[id(here)]


def fall(page: list, wrapper: list, out: dict[int, bool]) -> None:
    """Aligns a page's expression, whose slots hold [number of the text], with a wrapper; out: whether a text is main text."""
    work = [(page, wrapper)]
    while work:
        page, wrapper = work.pop()
        if page[0] == "#":
            out[page[1][0]] = len(wrapper) > 3
            continue
        if page[0][:1] == "=":
            continue
        for x, item in zip(page[1], placed([x[2][2] for x in page[1]], wrapper[1]), strict=True):
            if item is not None:
                work.append((x[2], item))


def placed(keys: list[str], items: list) -> list:
    """For each key of a page the node of the expression that it falls to, or None."""
    if len(keys) == len(items) and all(k == x[2][2] for k, x in zip(keys, items, strict=True)) and all(x[2][0] != "()" for x in items):
        return [x[2] for x in items]
    runs: list[list[int]] = []
    for k, key in enumerate(keys):
        if runs and keys[runs[-1][0]] == key:
            runs[-1].append(k)
        else:
            runs.append([k])
    if len(keys) <= LIMIT:
        runs = [[k] for k in range(len(keys))]
    nodes = [{k[2][2]: k[2] for k in x[2][1]} if x[2][0] == "()" else {x[2][2]: x[2]} for x in items]
    first: dict[str, dict] = {}
    for own in nodes:
        for key in own:
            first.setdefault(key, own)
    out: list = [None] * len(keys)
    if len(runs) * len(items) <= 4 * LIMIT * LIMIT:
        pairs = paired([[keys[r[0]], bare(keys[r[0]])] for r in runs], [len(r) > 1 for r in runs], [list(n) for n in nodes], [x[1] for x in items])
        for i, j in pairs:
            for k in runs[i]:
                if out[k] is None:
                    out[k] = nodes[j].get(keys[k]) or nodes[j].get(bare(keys[k]))
    for k, key in enumerate(keys):
        if out[k] is None:
            # a repetition that the longest alignment left out falls to the first node of its kind
            known = first.get(key) or first.get(bare(key))
            out[k] = known and (known.get(key) or known.get(bare(key)))
    return out


class Wrapper:
    """The expression of the pages seen so far. Pages of one structure are counted and aligned once."""

    def __init__(self, tree: list | None = None):
        self.tree = tree
        self.held: dict = {}

    def add_page(self, html: str | None, template: frozenset = frozenset()) -> None:
        tree, texts = read(html, template)
        sums = self.held.get(tree)
        if sums is None:
            sums = self.held[tree] = [[0, 0, 0] for _ in texts]
        for s, (_, text, links) in zip(sums, texts, strict=True):
            s[0] += 1
            s[1] += len(text)
            s[2] += links

    def settle(self) -> None:
        """Aligns the structures held."""
        for tree, sums in self.held.items():
            self.add(build(tree, iter(sums)))
        self.held = {}

    def add(self, tree: list) -> None:
        self.tree = tree if self.tree is None else merge(self.tree, tree)

    def dump(self) -> str:
        self.settle()
        return json.dumps(self.tree, separators=(",", ":"))

    @classmethod
    def load(cls, text: str) -> "Wrapper":
        return cls(json.loads(text))


def host(url):
    """Host of a URL column, in lower case; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def templates(pages: DataFrame, share: float = TEMPLATE_SHARE, least: int = TEMPLATE_PAGES) -> DataFrame:
    """pages(url, html) -> host, template: digests of the texts on most of a host's pages. A host has fewer than 1 / share
    times the texts of one of its pages."""

    def run(batches):
        for b in slices(batches):
            hosts, found = [], []
            for h, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = {digest(path, text) for path, text, _ in read(page)[1] if path}
                own.discard(0)
                hosts += [h] * (len(own) + 1)
                found += [0, *own]
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(found, pa.int64())], names=["host", "digest"])

    seen = pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(run, "host string, digest long")
    # 0 stands for every page
    many = written(seen.groupBy("host", "digest").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least), "page-texts")
    all_pages = many.filter("digest = 0").select(F.col("host").alias("of"), F.col("n").alias("pages"))
    common = many.filter("digest != 0").join(all_pages, F.col("host") == F.col("of")).filter(F.col("n") >= share * F.col("pages"))
    return common.groupBy("host").agg(F.array_sort(F.collect_list("digest")).alias("template"))


def infer(pages: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """pages(url, html) -> host, wrapper (JSON, the slots of the main text marked), expression. known: ``templates``."""

    def learn(batches):
        own: dict[str, tuple[Wrapper, frozenset]] = {}

        def done():
            dumped = [(h, w.dump()) for h, (w, _) in own.items()]
            own.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in dumped], pa.string()) for k in (0, 1)], names=["host", "wrapper"])

        for b in slices(batches):
            for h, page, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if h not in own:
                    own[h] = Wrapper(), frozenset(t or ())
                own[h][0].add_page(page, own[h][1])
            if sum(len(w.held) for w, _ in own.values()) + len(own) > HELD:
                yield done()
        yield done()

    def together(rows: pd.DataFrame) -> Wrapper:
        whole = Wrapper()
        for text in sorted(rows["wrapper"]):
            whole.add(json.loads(text))
        return whole

    def combine(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [rows["host"].iloc[0]], "wrapper": [together(rows).dump()]})

    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        whole = together(rows)
        shown = expression(whole.tree)
        choose(whole.tree)
        return pd.DataFrame({"host": [rows["host"].iloc[0]], "wrapper": [whole.dump()], "expression": [shown]})

    known = templates(pages) if known is None else known
    keyed = pages.select(host(F.col("url")).alias("host"), "html").join(known, "host", "left").select("host", "html", "template")
    parts = keyed.mapInArrow(learn, "host string, wrapper string")
    salted = parts.groupBy("host", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)).alias("salt")).applyInPandas(combine, "host string, wrapper string")
    return salted.groupBy("host").applyInPandas(finish, "host string, wrapper string, expression string")


class Reader:
    """Reads pages of one host against its wrapper; pages of one structure are aligned once."""

    def __init__(self, wrapper: list | None, template: frozenset = frozenset()):
        self.wrapper, self.template, self.known = wrapper, template, {}

    def text(self, html: str | None) -> str:
        """The texts of a page in the slots of the main text, blocks joined by one space."""
        if not html:
            return ""
        if self.wrapper is not None:
            tree, texts = read(html, self.template)
            main = self.known.get(tree)
            if main is None:
                if len(self.known) > HELD:
                    self.known.clear()
                main = self.known[tree] = main_texts(tree, len(texts), self.wrapper)
            if main:
                return " ".join(texts[k][1] for k in main)
        tree, texts = read(html)
        own = build(tree, ((1, len(t), links) for _, t, links in texts))
        choose(own)
        return " ".join(texts[k][1] for k in main_texts(tree, len(texts), own))


def main_texts(tree, n: int, wrapper: list) -> list[int]:
    """Numbers of a page's texts that fall into slots of the main text."""
    out: dict[int, bool] = {}
    fall(build(tree, ([k] for k in range(n))), wrapper, out)
    return [k for k in range(n) if out.get(k)]


def extract(pages: DataFrame, wrappers: DataFrame | None = None) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, text, n_chars."""
    common = written(templates(pages), "page-templates")
    known = (wrappers if wrappers is not None else infer(pages, common)).select("host", "wrapper").join(common, "host", "left")
    keyed = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    joined = keyed.join(written(known, "wrappers"), "host", "left")
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches):
        readers: dict[str, Reader] = {}
        for b in slices(batches):
            out = []
            for h, page, wrapper, template in zip(*(b.column(k).to_pylist() for k in range(2, 6)), strict=True):
                if h not in readers:
                    if len(readers) > 200:
                        readers.clear()
                    readers[h] = Reader(json.loads(wrapper) if wrapper else None, frozenset(template or ()))
                out.append(readers[h].text(page))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "host", "html", "wrapper", "template").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op1_wrappers(spark, sf_dir) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
