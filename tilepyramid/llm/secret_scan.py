"""Secret scan by one combined deterministic automaton.

All rules are compiled together: Thompson NFA, subset construction, Moore minimisation, transition
rows by byte. Each rule gives the automaton two patterns, its trigger, the shortest beginning of a
match that decides it, and the whole match, the trigger with any more bytes of its tail. One pass
over the bytes of a text runs all of them and gives the spans: a match opens where its trigger is
accepted and ends with the last byte in a row at which the whole is. Where a trigger has no fixed
length, its openings are patterns of the automaton too, and the match starts with the last one seen.

Defined results: a null text counts as empty and has no span; so has a text without a match, and an
empty table gives no rows. Matches of one rule do not overlap, the leftmost wins; spans of several
rules may, and those that start together are in the order of the rules. Spans are in code points,
end exclusive. Repeated rows give equal rows; other columns, whatever their names, are not read.
Texts are read whole.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tilepyramid.llm.common import read
from tilepyramid.llm.textbytes import with_text_columns

# The patterns of the rules (bytes), as the contract and public token formats state.
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
VALUE = r"[A-Za-z0-9+/_.=-]"
BETWEEN = r"[\"']?\x20*[:=]\x20*[\"']?"
BEGIN = "-----BEGIN "


def either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


KEYWORD = f"({'|'.join(either_case(w) for w in KEYWORDS)})"


@dataclass(frozen=True)
class Rule:
    """A match is ``trigger`` and then all bytes of the class ``tail``, which must hold every byte
    that can end the trigger; without a tail it is the trigger.

    ``lead`` is the number of trigger bytes before the match, ``length`` the trigger's fixed length.
    Without one, ``openings`` are (pattern, length) of what a match can start with; the last one seen
    before a trigger's end must be that of its match. A match, or with ``of_tail`` what follows the
    trigger from its last byte on, must have ``least`` bytes.
    """

    kind: str
    trigger: str
    tail: str = ""
    lead: int = 0
    length: int | None = None
    openings: tuple[tuple[str, int], ...] = ()
    least: int = 0
    of_tail: bool = False


BASE_KINDS = ("assign", "access", "hex")
RULES = (
    Rule("assign", KEYWORD + BETWEEN + VALUE, VALUE,
         openings=tuple((either_case(w), len(w)) for w in KEYWORDS), least=6, of_tail=True),
    Rule("access", r"AKIA[A-Z0-9]", r"[A-Z0-9]", length=5, least=20),
    Rule("hex", r"[^0-9a-f][0-9a-f]{24}", r"[0-9a-f]", lead=1, length=25, least=24),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]", r"[A-Za-z0-9]", length=5, least=24),
    Rule("slack", r"xox[baprs]-[A-Za-z0-9]", r"[A-Za-z0-9-]", length=6, least=15),
    Rule("private_key", BEGIN + r"([A-Z]+ )*PRIVATE KEY-----", openings=((BEGIN, len(BEGIN)),)),
)


class _Nfa:
    """Thompson construction for literals, escapes, classes, groups, ``|``, ``? * +`` and
    ``{n}``."""

    def __init__(self) -> None:
        self.empty: dict[int, list[int]] = defaultdict(list)
        self.on: dict[int, tuple[frozenset[int], int]] = {}
        self.size = 0

    def node(self) -> int:
        self.size += 1
        return self.size - 1

    def add(self, pattern: str) -> tuple[int, int]:
        self.text, self.at = pattern, 0
        ends = self._either()
        assert self.at == len(pattern), f"cannot compile {pattern!r} beyond {self.at}"
        return ends

    def _peek(self) -> str:
        return self.text[self.at:self.at + 1]

    def _either(self) -> tuple[int, int]:
        start, end = self._sequence()
        while self._peek() == "|":
            self.at += 1
            other, other_end = self._sequence()
            fork, join = self.node(), self.node()
            self.empty[fork] += [start, other]
            self.empty[end].append(join)
            self.empty[other_end].append(join)
            start, end = fork, join
        return start, end

    def _sequence(self) -> tuple[int, int]:
        start = end = self.node()
        while self._peek() and self._peek() not in "|)":
            a, b = self._repeated()
            self.empty[end].append(a)
            end = b
        return start, end

    def _repeated(self) -> tuple[int, int]:
        begin = self.at
        a, b = self._atom()
        atom_text = self.text[begin:self.at]
        mark = self._peek()
        if mark and mark in "?*+":
            self.at += 1
            start, end = self.node(), self.node()
            self.empty[start].append(a)
            self.empty[b].append(end)
            if mark in "?*":
                self.empty[start].append(end)
            if mark in "*+":
                self.empty[b].append(a)
            return start, end
        if mark == "{":
            close = self.text.index("}", self.at)
            times = int(self.text[self.at + 1:close])
            outer = self.text
            for _ in range(times - 1):
                self.text, self.at = atom_text, 0
                c, d = self._atom()
                self.empty[b].append(c)
                b = d
            self.text, self.at = outer, close + 1
        return a, b

    def _atom(self) -> tuple[int, int]:
        mark = self._peek()
        if mark == "(":
            self.at += 1
            ends = self._either()
            assert self._peek() == ")"
            self.at += 1
            return ends
        if mark == "[":
            chosen = self._class()
        else:
            chosen = frozenset([self._char()])
        a, b = self.node(), self.node()
        self.on[a] = (chosen, b)
        return a, b

    def _char(self) -> int:
        mark = self._peek()
        self.at += 1
        if mark != "\\":
            return ord(mark)
        mark = self._peek()
        self.at += 1
        if mark == "x":
            self.at += 2
            return int(self.text[self.at - 2:self.at], 16)
        return ord(mark)

    def _class(self) -> frozenset[int]:
        self.at += 1
        negated = self._peek() == "^"
        self.at += negated
        chosen: set[int] = set()
        while self._peek() != "]":
            low = high = self._char()
            if self._peek() == "-" and self.text[self.at + 1] != "]":
                self.at += 1
                high = self._char()
            chosen |= set(range(low, high + 1))
        self.at += 1
        return frozenset(set(range(256)) - chosen if negated else chosen)


@dataclass(frozen=True)
class Automaton:
    """``rows[state][byte]`` is the next state; states from ``first_accept`` on accept the rules
    in ``accepts[state - first_accept]``. ``start`` has already read a line break."""

    rows: list[list[int]] = field(repr=False)
    first_accept: int
    accepts: list[tuple[int, ...]]
    start: int


def compile_rules(patterns: list[str]) -> Automaton:
    """One minimal automaton that accepts wherever a match of any pattern ends."""
    nfa = _Nfa()
    root, final = nfa.node(), {}
    for rule, pattern in enumerate(patterns):
        start, end = nfa.add(pattern)
        nfa.empty[root].append(start)
        final[end] = rule

    def closed(nodes) -> frozenset[int]:
        seen, todo = set(nodes), list(nodes)
        while todo:
            for n in nfa.empty[todo.pop()]:
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        return frozenset(n for n in seen if n in nfa.on or n in final)

    # bytes that no pattern tells apart share a class
    signs = [tuple(b in chosen for chosen, _ in nfa.on.values()) for b in range(256)]
    order = {s: k for k, s in enumerate(dict.fromkeys(signs))}
    byte_class = [order[s] for s in signs]
    sample = [byte_class.index(k) for k in range(len(order))]

    first = closed([root])
    index, todo, table = {first: 0}, [first], []
    for state in todo:
        row = []
        for b in sample:
            moved = closed([to for n in state if n in nfa.on
                            for chosen, to in [nfa.on[n]] if b in chosen]) | first
            if moved not in index:
                index[moved] = len(todo)
                todo.append(moved)
            row.append(index[moved])
        table.append(row)
    accepts = [tuple(sorted(final[n] for n in state if n in final)) for state in todo]

    # Moore: split blocks until all states of a block go to the same blocks
    block = {a: k for k, a in enumerate(dict.fromkeys(accepts))}
    part = [block[a] for a in accepts]
    while True:
        signature = [(part[s], *(part[t] for t in table[s])) for s in range(len(table))]
        number = {x: k for k, x in enumerate(dict.fromkeys(signature))}
        finer = [number[x] for x in signature]
        if len(number) == len(set(part)):
            break
        part = finer
    leader: dict[int, int] = {}
    for s, p in enumerate(part):
        leader.setdefault(p, s)
    blocks = sorted(leader, key=lambda p: (bool(accepts[leader[p]]), p))
    renamed = {p: k for k, p in enumerate(blocks)}
    rows = [[renamed[part[table[leader[p]][byte_class[b]]]] for b in range(256)] for p in blocks]
    tail = [accepts[leader[p]] for p in blocks if accepts[leader[p]]]
    return Automaton(rows, len(blocks) - len(tail), tail, rows[renamed[part[0]]][0x0A])


class Scanner:
    """The rules with their automaton; :meth:`spans` scans one text."""

    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = rules
        #: (rule, length) of each opening, in the order of their patterns.
        self.openings = [(k, n) for k, r in enumerate(rules) for _, n in r.openings]
        # Patterns are accepted in this order: openings, whole matches, triggers.
        self.automaton = compile_rules([
            *[pattern for r in rules for pattern, _ in r.openings],
            *[r.trigger + (r.tail and r.tail + "*") for r in rules], *[r.trigger for r in rules]])

    def spans(self, data: bytes) -> list[tuple[int, str, int, int]]:
        """Byte spans (rule number, kind, start, end) by start, then rule."""
        auto, rules, openings = self.automaton, self.rules, self.openings
        rows, first, accepts = auto.rows, auto.first_accept, auto.accepts
        wholes = len(openings)
        triggers = wholes + len(rules)
        opened = [0] * len(rules)  # where the last opening of each rule starts
        ends = [0] * len(rules)  # of each rule's last match, so far
        matches: list[list] = [[] for _ in rules]  # (start, place of the trigger's last byte, end)
        state = auto.start
        for at, byte in enumerate(data, 1):
            state = rows[state][byte]
            if state >= first:
                for p in accepts[state - first]:
                    if p < wholes:
                        k, length = openings[p]
                        opened[k] = at - length
                    elif p < triggers:
                        k = p - wholes
                        if ends[k] == at - 1 and matches[k]:
                            ends[k] = matches[k][-1][2] = at
                    else:
                        k = p - triggers
                        rule = rules[k]
                        start = opened[k] if rule.length is None else at - rule.length + rule.lead
                        if start >= ends[k]:
                            matches[k].append([start, at - 1, at])
                            ends[k] = at
        return sorted(((k, rule.kind, start, end) for k, rule in enumerate(rules)
                       for start, tail, end in matches[k]
                       if end - (tail if rule.of_tail else start) >= rule.least),
                      key=lambda s: (s[2], s[0]))


def in_code_points(data: bytes, spans: list[tuple[int, str, int, int]]) -> list[tuple]:
    """The spans with offsets counted in code points; one pass over the bytes up to the last."""
    if data.isascii():
        return spans
    marks, at, points = {}, 0, 0
    for mark in sorted({m for s in spans for m in s[2:]}):
        points += len(data[at:mark].decode("utf-8", "replace"))
        at = mark
        marks[mark] = points
    return [(k, kind, marks[a], marks[b]) for k, kind, a, b in spans]


def joined_spans(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for _, kind, a, b in spans)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
         rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of ``docs``: its id and ``spans`` as an array of (kind, start, end)."""
    span = T.StructType([T.StructField("kind", T.StringType()),
                         T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    shipped = docs.sparkSession.sparkContext.broadcast(Scanner(rules))

    def work(texts: list) -> list[list]:
        found = []
        for value in texts:
            data = (value or "").encode("utf-8", "surrogatepass")
            spans = in_code_points(data, shipped.value.spans(data))
            found.append([{"kind": s[1], "start": s[2], "end": s[3]} for s in spans])
        return [found]

    added = T.StructType([T.StructField("spans", T.ArrayType(span))])
    return with_text_columns(docs.select(doc_id, text), text, added, work).drop(text)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents"))
    base = "filter(spans, s -> s.kind IN ('assign', 'access', 'hex'))"
    told = "array_join(transform({}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    count = "CAST(size(filter(spans, s -> s.kind = '{0}')) AS BIGINT) AS n_{0}"
    return found.selectExpr(
        "doc_id", *[count.format(k) for k in BASE_KINDS],
        f"sha2({told.format(base)}, 256) AS base_sha256", f"{told.format('spans')} AS spans")


def digest(spans) -> str:
    """The base digest of spans as :meth:`Scanner.spans` gives them, in code points."""
    return hashlib.sha256(joined_spans(
        [s for s in spans if s[1] in BASE_KINDS]).encode()).hexdigest()
