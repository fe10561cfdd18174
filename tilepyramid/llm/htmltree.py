"""Block trees of HTML pages: parsing, what is never main text, and simple tree matching."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</(?![a-zA-Z])[^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)"
    r"(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|[^>]*(?:>|\Z))", re.S)
ATTRIBUTE = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
WORD = re.compile(r"[a-z0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav "
    "ol optgroup option p pre search section select summary table tbody td tfoot th thead tr "
    "ul".split())
HEAD = frozenset("base head html link meta noscript script style template title".split())
#: An element that ends an open one of these, up to a block that holds them.
ENDED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
         "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
         "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}

#: Elements that never hold main text.
DROPPED = frozenset(
    "aside audio button canvas datalist dialog embed footer form head iframe input menu nav noembed "
    "noframes noscript object script search select style svg template textarea title video".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class, id and role that mark what is not main text.
HINTS = frozenset(
    "ad ads adsense advert advertisement advertising adverts alert announcement banner breadcrumb "
    "breadcrumbs colophon complementary consent contentinfo cookie cookies dialog footer gdpr login "
    "masthead menu menus modal nav navbar navigation newsletter notice notices notification outbrain "
    "pager pagination paywall popup promo promoted promotion recommendations recommended related "
    "search share sharing sidebar sidebars signin signup skip skiplink social sponsor sponsored "
    "submenu subscribe subscription taboola toast toolbar topbar".split())
COMMENTS = frozenset("comment commentlist comments discussion disqus replies reply respond".split())


@dataclass
class Page:
    """Blocks in page order. A text is a node of its own, or of its block if it is all there is."""

    parent: list[int] = field(default_factory=list)
    label: list[str] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    main: list[bool] = field(default_factory=list)  # whether its text is main text by its place


def attributes(told: str) -> dict[str, str]:
    return {k.lower(): html.unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(told)}


def parse(source: str | None) -> Page:
    """The block tree of a page, however broken."""
    source = source or ""
    parent, label, text, strong, weak = [], [], [], [], []
    stack: list[tuple[str, bool, int]] = []  # (tag, whether it is a node, the node around it)
    here, run = -1, []

    def node(name: str, words: str = "", is_strong: bool = False, is_weak: bool = False) -> int:
        parent.append(here)
        label.append(name)
        text.append(words)
        strong.append(is_strong)
        weak.append(is_weak)
        return len(parent) - 1

    def flush() -> None:
        if run:
            words = " ".join(html.unescape("".join(run)).split())
            run.clear()
            if words:
                node("#text", words)

    def pop_to(depth: int) -> None:
        nonlocal here
        for _, is_node, around in reversed(stack[depth:]):
            if is_node:
                flush()
                here = around
        del stack[depth:]

    def end_open(names, through_blocks: bool) -> None:
        """Ends the open elements of these names above the nearest other block."""
        while True:
            for depth in range(len(stack) - 1, -1, -1):
                tag, is_node, _ = stack[depth]
                if tag in names:
                    pop_to(depth)
                    break
                if is_node and tag in BLOCK and not (through_blocks and tag == "p"):
                    return
            else:
                return

    at, size = 0, len(source)
    while at < size:
        m = TOKEN.search(source, at)
        if not m:
            run.append(source[at:])
            break
        if m.start() > at:
            run.append(source[at:m.start()])
        at, tag = m.end(), m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["close"]:
            if tag == "p" and not any(t == "p" for t, _, _ in stack):
                flush()
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    pop_to(depth)
                    break
                if tag not in BLOCK and stack[depth][0] in BLOCK:
                    break  # an inline end tag does not end the block around
            continue
        told = m["attrs"].rstrip(">")
        if tag in RAW:
            close = re.compile(f"</{tag}(?=[\\s/>]|\\Z)", re.I).search(source, at)
            at = close.start() if close else size
            skip = TOKEN.match(source, at) if close else None
            at = skip.end() if skip else at
            run.append(" ")
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                run.append(" ")
            continue
        if tag not in HEAD and any(t == "head" for t, _, _ in stack):
            end_open({"head"}, False)
        block = tag in BLOCK
        if block:
            end_open({"p"}, False)
            if tag in ENDED:
                end_open(ENDED[tag], True)
        found = attributes(told) if told.strip() else {}
        named = " ".join(found.get(k, "") for k in ("class", "id", "role")).lower()
        words = set(WORD.findall(named))
        style = found.get("style", "").replace(" ", "").lower()
        in_article = any(t == "article" for t, _, _ in stack)
        is_strong = (tag in DROPPED or "hidden" in found or found.get("aria-hidden") == "true"
                     or "display:none" in style or "visibility:hidden" in style
                     or bool(words & COMMENTS)
                     or tag == "article" and in_article or tag == "header" and not in_article)
        is_weak = bool(words & HINTS) or (
            "header" in words and not in_article and tag not in HEADINGS)
        if block or is_strong or is_weak:
            flush()
            around, here = here, node(
                tag + "".join(f".{w}" for w in sorted(words)), "", is_strong, is_weak)
            stack.append((tag, True, around))
            if found.get("role") == "main":
                label[here] = "main" + label[here][len(tag):]
        else:
            stack.append((tag, False, here))
    pop_to(0)
    flush()
    return _placed(parent, label, text, strong, weak)


def _placed(parent: list[int], label: list[str], text: list[str], strong: list[bool],
            weak: list[bool]) -> Page:
    """What stays of the tree, single texts folded into their blocks, and where main text is."""
    n = len(parent)
    tag = [name.split(".", 1)[0] for name in label]
    for k in range(n):  # a container of the article is not dropped for what it is called
        if tag[k] in ("article", "main") and not weak[k] and not strong[k]:
            up = parent[k]
            while up >= 0:
                weak[up] = False
                up = parent[up]
    gone = [False] * n
    children = [0] * n
    for k in range(n):
        up = parent[k]
        gone[k] = strong[k] or weak[k] or up >= 0 and gone[up]
        if up >= 0 and not gone[k]:
            children[up] += 1
    page, new, roots = Page(), {}, {"article": [], "main": []}
    for k in range(n):
        if gone[k]:
            continue
        up = parent[k]
        if tag[k] == "#text" and up >= 0 and children[up] == 1:
            page.text[new[up]] = text[k]
            continue
        new[k] = len(page.parent)
        page.parent.append(new[up] if up >= 0 else -1)
        page.label.append(label[k])
        page.text.append(text[k])
        if tag[k] in roots:
            roots[tag[k]].append(new[k])
    for kind in ("article", "main"):
        inside = _inside(page, set(roots[kind]))
        if any(t and i for t, i in zip(page.text, inside)):
            page.main = inside
            return page
    page.main = [True] * len(page.parent)
    return page


def _inside(page: Page, tops: set[int]) -> list[bool]:
    out = []
    for k, up in enumerate(page.parent):
        out.append(k in tops or up >= 0 and out[up])
    return out


def packed(page: Page) -> bytes:
    """The tree as rows (parent + 1, hash of the label, hash of the text or 0)."""
    rows = [(p + 1, crc32(name.encode("utf-8", "replace")), crc32(t.encode("utf-8", "replace")) or 1 if t else 0)
            for p, name, t in zip(page.parent, page.label, page.text)]
    return np.array(rows, dtype="<u4").reshape(-1, 3).tobytes()


class Tree:
    """A packed tree, ready for matching."""

    def __init__(self, raw: bytes):
        rows = np.frombuffer(raw, dtype="<u4").reshape(-1, 3).astype(np.int64)
        self.label, self.text, self.raw = rows[:, 1], rows[:, 2], raw
        self.children: list[list[int]] = [[] for _ in range(len(rows) + 1)]
        for k, up in enumerate(rows[:, 0].tolist()):
            self.children[up].append(k)

    def below(self, node: int) -> list[int]:
        return self.children[node + 1]


#: Above so many cells the table of a list of children is not kept whole.
CELLS = 1 << 22


def aligned(a: Tree, b: Tree) -> list[tuple[int, int]]:
    """The pairs of nodes in a best top-down, order-preserving match of two trees.

    Simple tree matching: a pair of equal labels counts one, and one more if the texts are equal;
    children are matched in order. Of equally good matches the one that pairs later nodes is taken.
    """
    if a.raw == b.raw:
        return [(k, k) for k in range(len(a.label))]
    known: dict[tuple[int, int], int] = {}

    def weights(i: int, ys: np.ndarray, inner: dict[int, list[int]]) -> np.ndarray:
        """What pairing node ``i`` with each of ``ys`` is worth."""
        w = (b.label[ys] == a.label[i]) * (
            1 + ((b.text[ys] == a.text[i]) & (a.text[i] != 0)).astype(np.int64))
        if a.below(i):
            for place in inner.get(int(a.label[i]), ()):
                w[place] += worth(i, int(ys[place]))
        return w

    def worth(i: int, j: int) -> int:
        if (i, j) not in known:
            rows = last_row(a.below(i), np.array(b.below(j), dtype=np.int64))
            known[i, j] = int(rows[-1])
        return known[i, j]

    def internal(ys: np.ndarray) -> dict[int, list[int]]:
        found: dict[int, list[int]] = {}
        for place, j in enumerate(ys.tolist()):
            if b.below(j):
                found.setdefault(int(b.label[j]), []).append(place)
        return found

    def rows_of(xs: list[int], ys: np.ndarray, backward: bool = False):
        """The rows of the table of best scores, first to last (or from the ends)."""
        inner, row = internal(ys), np.zeros(len(ys) + 1, dtype=np.int64)
        for i in reversed(xs) if backward else xs:
            w = weights(i, ys, inner)
            if backward:
                w = w[::-1]
            new = np.zeros_like(row)
            new[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + w))
            row = new
            yield row, w

    def last_row(xs: list[int], ys: np.ndarray, backward: bool = False) -> np.ndarray:
        row = np.zeros(len(ys) + 1, dtype=np.int64)
        for row, _ in rows_of(xs, ys, backward):
            pass
        return row

    def pairs(xs: list[int], ys: np.ndarray) -> list[tuple[int, int]]:
        if not xs or not len(ys):
            return []
        if len(xs) > 1 and len(xs) * len(ys) > CELLS:
            half = len(xs) // 2
            front, back = last_row(xs[:half], ys), last_row(xs[half:], ys, True)
            cut = int(np.argmax(front + back[::-1]))
            return pairs(xs[:half], ys[:cut]) + pairs(xs[half:], ys[cut:])
        table = [(np.zeros(len(ys) + 1, dtype=np.int64), None), *rows_of(xs, ys)]
        found, k = [], len(ys)
        for r in range(len(xs), 0, -1):
            row, w = table[r]
            above = table[r - 1][0]
            while k and row[k] == row[k - 1]:
                k -= 1
            if k and row[k] != above[k] and w[k - 1] and row[k] == above[k - 1] + w[k - 1]:
                found.append((xs[r - 1], int(ys[k - 1])))
                k -= 1
        return found[::-1]

    out, todo = [], [(-1, -1)]
    while todo:
        i, j = todo.pop()
        for x, y in pairs(a.below(i), np.array(b.below(j), dtype=np.int64)):
            out.append((x, y))
            if a.below(x) and b.below(y):
                todo.append((x, y))
    return out
