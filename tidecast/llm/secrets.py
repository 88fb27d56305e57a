"""Secret scans by one combined deterministic automaton.

Every rule's regex is parsed to a nondeterministic automaton over bytes and
turned by subset construction into a searcher that finds leftmost-longest,
non-overlapping matches. The searchers are minimised, multiplied into one
machine and minimised again; its transition arrays are walked once over the
bytes of a text. A transition on which some rule's match ends carries an event;
the match's start is read off by that rule's reversed automaton.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from operator import getitem

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from tidecast.llm.common import column_bytes, map_arrow, table, without

END = 256  # the symbol after the last byte


@dataclass(frozen=True)
class Rule:
    """``pattern`` supports literals, classes, escapes, groups, (?i:...), |, ?, *, +, {m,}; ``least`` is the
    smallest length kept, counted over the whole match or, with ``tail``, over its trailing run of
    those bytes. ``base`` rules come first in the digests; others add spans."""

    kind: str
    pattern: str
    least: int = 1
    tail: str = ""
    base: bool = True


ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
VALUE = ALNUM + "+/_.=-"


# The patterns of the three base kinds.
RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 6, VALUE),
    Rule("access", "AKIA[A-Z0-9]+", 20),
    Rule("hex", "[0-9a-f]{24,}", 24),
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", 40, "", False),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", 15, "", False),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 1, "", False),
)


class _Parser:
    """Regex to a Thompson automaton: ``eps[s]`` and ``moves[s]`` as (set of bytes, target)."""

    def __init__(self, pattern: str):
        self.p, self.i, self.fold = pattern, 0, False
        self.eps: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        tree = self._alternatives()
        assert self.i == len(pattern), f"unread: {pattern[self.i :]}"
        self.tree = tree

    def _peek(self) -> str:
        return self.p[self.i] if self.i < len(self.p) else ""

    def _take(self) -> str:
        self.i += 1
        return self.p[self.i - 1]

    def _alternatives(self):
        parts = [self._sequence()]
        while self._peek() == "|":
            self._take()
            parts.append(self._sequence())
        return parts[0] if len(parts) == 1 else ("or", parts)

    def _sequence(self):
        parts = []
        while self._peek() not in ("", "|", ")"):
            atom = self._atom()
            while self._peek() and self._peek() in "?*+{":
                c = self._take()
                if c == "{":
                    j = self.p.index(",}", self.i)
                    n, self.i = int(self.p[self.i : j]), j + 2
                    atom = ("cat", [atom] * (n - 1) + [("+", atom)])
                else:
                    atom = (c, atom)
            parts.append(atom)
        return ("cat", parts)

    def _escape(self) -> int:
        c = self._take()
        if c == "x":
            self.i += 2
            return int(self.p[self.i - 2 : self.i], 16)
        return ord(c)

    def _atom(self):
        c = self._take()
        if c == "(":
            outside = self.fold
            if self.p.startswith("?i:", self.i):
                self.i, self.fold = self.i + 3, True
            inner = self._alternatives()
            assert self._take() == ")"
            self.fold = outside
            return inner
        if c == "[":
            got: set[int] = set()
            while self._peek() != "]":
                a = self._take()
                lo = self._escape() if a == "\\" else ord(a)
                if self._peek() == "-" and self.p[self.i + 1] != "]":
                    self._take()
                    b = self._take()
                    got |= set(range(lo, (self._escape() if b == "\\" else ord(b)) + 1))
                else:
                    got.add(lo)
            self._take()
            return self._set(got)
        return self._set({self._escape() if c == "\\" else ord(c)})

    def _set(self, got: set[int]):
        """A set of bytes; ASCII letters in either case where the group says so."""
        if self.fold:
            got = got | {c ^ 32 for c in got if chr(c).isalpha() and c < 128}
        return ("set", frozenset(got))


class _Nfa:
    def __init__(self, tree, backwards: bool = False):
        self.eps: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.backwards = backwards
        self.start, self.accept = self._build(tree)

    def _new(self) -> int:
        self.eps.append([])
        self.moves.append([])
        return len(self.eps) - 1

    def _build(self, t) -> tuple[int, int]:
        kind, x = t
        a, b = self._new(), self._new()
        if kind == "set":
            self.moves[a].append((x, b))
        elif kind == "cat":
            at = a
            for part in reversed(x) if self.backwards else x:
                s, e = self._build(part)
                self.eps[at].append(s)
                at = e
            self.eps[at].append(b)
        elif kind == "or":
            for part in x:
                s, e = self._build(part)
                self.eps[a].append(s)
                self.eps[e].append(b)
        else:
            s, e = self._build(x)
            self.eps[a].append(s)
            self.eps[e].append(b)
            if kind in "?*":
                self.eps[a].append(b)
            if kind in "*+":
                self.eps[e].append(s)
        return a, b

    def close(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.eps[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(s for s in seen if self.moves[s] or s == self.accept)

    def step(self, states, c: int) -> frozenset[int]:
        return self.close({t for s in states for on, t in self.moves[s] if c in on})


class _Machine:
    """``rows[s][c]`` is the next state over symbol classes, ``events[s][c]`` the rules whose match ends before c."""

    def __init__(self, rows: list[list[int]], events: list[list[tuple[int, ...]]], start: int = 0):
        self.rows, self.events, self.start = rows, events, start

    def minimised(self) -> _Machine:
        """Merge states that no continuation tells apart, by refining the partition of their events."""
        names: dict = {}
        block = [names.setdefault(tuple(e), len(names)) for e in self.events]
        while True:
            names = {}
            new = [names.setdefault((block[s], tuple([block[t] for t in row])), len(names)) for s, row in enumerate(self.rows)]
            if len(names) == len(set(block)):
                break
            block = new
        kept = {b: s for s, b in reversed(list(enumerate(block)))}
        order = sorted(kept, key=lambda b: kept[b])
        place = {b: i for i, b in enumerate(order)}
        return _Machine([[place[block[t]] for t in self.rows[kept[b]]] for b in order], [self.events[kept[b]] for b in order], place[block[self.start]])


def _searcher(nfa: _Nfa, classes: list[int], rule: int) -> _Machine:
    """Leftmost-longest, non-overlapping search for one rule.

    A state is the tuple of thread groups by age: the oldest start first, each
    group without what an older one holds already. Once the oldest group has
    accepted, younger starts are dropped until it dies; then the match ends
    and the search starts anew at that byte.
    """
    first = nfa.close([nfa.start])
    start = ((), False)

    def advance(state, c):
        groups, hit = state
        moved, seen = [], set()
        for g in [*groups, *([] if hit else [first])]:
            g = nfa.step(g, c) - seen if c != END else frozenset()
            if g:
                moved.append(g)
                seen |= g
            if hit:
                break
        if hit and not moved:
            after, event = advance(start, c)
            assert not event
            return after, True
        if hit and nfa.accept not in moved[0]:
            raise ValueError("a match of this rule could end before the bytes that it has read; such rules are not supported")
        for i, g in enumerate(moved):
            if nfa.accept in g:
                if i == 0:
                    return ((g,), True), False
                raise ValueError("a younger match ends inside an older try; such rules are not supported")
        return (tuple(moved), False), False

    ids, todo, rows, events = {start: 0}, deque([start]), [], []
    while todo:
        state = todo.popleft()
        row, event = [], []
        for c in classes:
            nxt, ended = advance(state, c)
            if nxt not in ids:
                ids[nxt] = len(ids)
                todo.append(nxt)
            row.append(ids[nxt])
            event.append((rule,) if ended else ())
        rows.append(row)
        events.append(event)
    return _Machine(rows, events).minimised()


class _Row(list):
    """A transition array; the entries are the next arrays themselves."""


class _Event:
    """Stands for an array that is reached on an event: touching it stops the walk."""

    __slots__ = ("rules", "row")

    def __init__(self, rules, row):
        self.rules, self.row = rules, row

    def __getitem__(self, _):
        raise _Stop(self)


class _Stop(Exception):
    pass


class SecretScanner:
    """The compiled rules; ``scan`` gives the spans of every rule in a byte string."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        nfas = [_Nfa(_Parser(r.pattern).tree) for r in rules]
        sets = {on for n in nfas for moves in n.moves for on, _ in moves}
        kinds: dict = {}
        symbol = [kinds.setdefault(tuple(c in s for s in sets), len(kinds)) for c in range(256)]
        samples = [symbol.index(k) for k in range(len(kinds))] + [END]
        self.symbol, self.end = bytes(symbol), len(kinds)
        parts = [_searcher(n, samples, i) for i, n in enumerate(nfas)]
        start = tuple(p.start for p in parts)
        ids, todo, rows, events = {start: 0}, deque([start]), [], []
        while todo:
            state = todo.popleft()
            row, event = [], []
            for c in range(len(samples)):
                nxt = tuple(p.rows[s][c] for p, s in zip(parts, state))
                if nxt not in ids:
                    ids[nxt] = len(ids)
                    todo.append(nxt)
                row.append(ids[nxt])
                event.append(tuple(r for p, s in zip(parts, state) for r in p.events[s][c]))
            rows.append(row)
            events.append(event)
        whole = _Machine(rows, events).minimised()
        self.n_states = len(whole.rows)
        arrays = [_Row() for _ in whole.rows]
        for a, row, event in zip(arrays, whole.rows, whole.events):
            a.extend([_Event(e, arrays[t]) if e else arrays[t] for t, e in zip(row, event)])
        self.start = arrays[whole.start]
        self.back = [self._backward(r) for r in rules]
        self.tails = [frozenset(r.tail.encode()) for r in rules]

    @staticmethod
    def _backward(rule: Rule):
        """The reversed rule's automaton as (start row, accepting rows)."""
        nfa = _Nfa(_Parser(rule.pattern).tree, backwards=True)
        start = nfa.close([nfa.start])
        ids, todo, rows = {start: 0}, deque([start]), []
        while todo:
            state = todo.popleft()
            row = []
            for c in range(256):
                nxt = nfa.step(state, c)
                if nxt not in ids:
                    ids[nxt] = len(ids)
                    todo.append(nxt)
                row.append(ids[nxt])
            rows.append(row)
        return rows, [nfa.accept in s for s in ids], ids.get(frozenset(), -1)

    def _begin(self, rule: int, data: bytes, end: int, floor: int) -> int:
        rows, accept, dead = self.back[rule]
        s, found, i = 0, end, end
        while i > floor:
            i -= 1
            s = rows[s][data[i]]
            if s == dead:
                break
            if accept[s]:
                found = i
        return found

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule number, end) in byte offsets, by start and then by rule."""
        it = iter(data.translate(self.symbol) + bytes([self.end]))
        n, row = len(data) + 1, self.start
        floor = [0] * len(self.rules)
        out = []
        while True:
            try:
                row = reduce(getitem, it, row)
                if not isinstance(row, _Event):
                    break
                event, at = row, n - 1
            except _Stop as stop:
                # the symbol after the event's own has been taken already
                event, at = stop.args[0], n - it.__length_hint__() - 2
            for r in event.rules:
                begin = self._begin(r, data, at, floor[r])
                floor[r] = at
                if self._kept(r, data, begin, at):
                    out.append((begin, r, at))
            if at == n - 1:
                break
            row = event.row[self.symbol[data[at + 1]] if at + 1 < len(data) else self.end]
            while isinstance(row, _Event):  # events on neighbouring symbols
                at += 1
                for r in row.rules:
                    begin = self._begin(r, data, at, floor[r])
                    floor[r] = at
                    if self._kept(r, data, begin, at):
                        out.append((begin, r, at))
                if at == n - 1:
                    break
                row = row.row[next(it)]
            if at == n - 1:
                break
        out.sort()
        return out

    def _kept(self, rule: int, data: bytes, begin: int, end: int) -> bool:
        """Whether a match is long enough. The tail is what follows the separator: the value that was assigned."""
        least, tail = self.rules[rule].least, self.tails[rule]
        if not tail:
            return end - begin >= least
        i = begin
        while data[i] not in b":=":
            i += 1
        i += 1
        while data[i] == 32:
            i += 1
        i += data[i] in b"\"'"
        return end - i >= least


@lru_cache(4)
def scanner(rules: tuple[Rule, ...] = RULES) -> SecretScanner:
    return SecretScanner(rules)


def _points(data: bytes, spans):
    """Byte spans as code point spans, by one pass between their edges."""
    edges = sorted({e for a, _, b in spans for e in (a, b)})
    place, last, n = {}, 0, 0
    for e in edges:
        n += len(data[last:e].decode("utf-8", "surrogatepass"))
        place[e], last = n, e
    return [(place[a], r, place[b]) for a, r, b in spans]


def find_secrets(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add ``secrets``, an array of (kind, start, end, base) in code points, by start and then rule order.

    A null or empty text has none. Rows of any length are scanned whole and apart from each
    other, so ties, repeated rows and empty tables need no rule of their own;
    an input column named ``secrets`` is replaced, all others pass through.
    """
    base = without(docs, *["secrets"] * (text != "secrets"))
    kind = "array<struct<kind:string,start:int,end:int,base:boolean>>"
    schema = StructType([*base.schema.fields, *StructType.fromDDL(f"secrets {kind}").fields])
    names = [f.name for f in base.schema.fields]
    element = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = scanner(rules)
        for batch in batches:
            found = []
            for data in column_bytes(batch.column(names.index(text))):
                spans = machine.scan(data)
                found.append([(rules[r].kind, a, b, rules[r].base) for a, r, b in _points(data, spans)] if spans else [])
            rows = [[dict(zip(("kind", "start", "end", "base"), s)) for s in f] for f in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(element))], [*names, "secrets"])

    return map_arrow(base, run, schema)


def op5_secrets(spark, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(joined(F.filter("secrets", lambda s: s["base"])), 256).alias("base_sha256"),
        joined("secrets").alias("spans"),
    )
