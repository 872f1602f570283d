"""Secret scan: all rules compiled into one deterministic automaton.

Each rule's regular expression (literals, classes, groups, ``|``, ``?``, ``*``,
``+``, ``{m}``, ``{m,}``) becomes an NFA over bytes; subset construction over the
union of all NFAs, restarted at every byte, and partition refinement give one
minimal transition array. A text is scanned once, byte by byte, whatever the
number of rules. That pass cuts out the stretches in which some match was under way
from first to last, with the rules that accepted there: mostly single words. Inside
those, exact spans (leftmost, longest, non-overlapping) come from the rule's own
anchored automaton, followed by the lengths that the pattern leaves open.

Nulls: a null text is scanned as empty. A null ``doc_id`` stays null. Repeated
rows are scanned each for itself. Columns other than the id and the text are
not read; ``redact`` keeps them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from voxmill.llm.common import small_batches


@dataclass(frozen=True)
class Rule:
    """``shortest``: characters that a match must have; ``shortest_value``: characters of the value after the first ``:`` or ``=`` and a quote."""

    kind: str
    pattern: str
    ignore_case: bool = False
    shortest: int = 0
    shortest_value: int = 0

    def holds(self, match: str) -> bool:
        if self.shortest_value:
            cut = min(i for i in (match.find(":"), match.find("=")) if i >= 0)
            value = match[cut + 1 :].lstrip(" ")
            if len(value[1:] if value[:1] in "\"'" else value) < self.shortest_value:
                return False
        return len(match) >= self.shortest


# Kinds in the order in which spans at one start are listed. The first three are the contract's.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=\-]+)""", True, shortest_value=6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(-?[A-Za-z0-9+/=:,\\\x20\x09\x0A\x0D])*(-----END [A-Z ]*PRIVATE KEY-----)?"),  # to the END line, or as far as a key's characters go
    Rule("github", r"(ghp|gho|ghs|ghu|ghr)_[A-Za-z0-9]+", shortest=40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9\-]+", shortest=20),
    Rule("google", r"AIza[A-Za-z0-9_\-]+", shortest=39),
)


class Nfa:
    """Thompson automaton over bytes; state 0 starts, ``accept`` maps state to rule."""

    def __init__(self) -> None:
        self.eps: list[list[int]] = [[]]
        self.arc: list[tuple[frozenset[int], int] | None] = [None]
        self.accept: dict[int, int] = {}
        self.first: dict[int, int] = {}

    def new(self) -> int:
        self.eps.append([])
        self.arc.append(None)
        return len(self.eps) - 1

    def add(self, index: int, rule: Rule) -> None:
        self.first[index] = len(self.eps)
        start, end = _Parser(rule.pattern, rule.ignore_case, self).parse()
        self.eps[0].append(start)
        self.accept[end] = index

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.eps[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


class _Parser:
    """Recursive descent over the supported syntax; returns (first, last) states."""

    def __init__(self, text: str, ignore_case: bool, nfa: Nfa):
        self.s, self.i, self.fold, self.n = text, 0, ignore_case, nfa

    def parse(self) -> tuple[int, int]:
        out = self.union()
        if self.i != len(self.s):
            raise ValueError(f"unexpected {self.s[self.i]!r} at {self.i} in {self.s!r}")
        return out

    def union(self) -> tuple[int, int]:
        parts = [self.sequence()]
        while self.s[self.i : self.i + 1] == "|":
            self.i += 1
            parts.append(self.sequence())
        if len(parts) == 1:
            return parts[0]
        a, b = self.n.new(), self.n.new()
        for x, y in parts:
            self.n.eps[a].append(x)
            self.n.eps[y].append(b)
        return a, b

    def sequence(self) -> tuple[int, int]:
        first = last = self.n.new()
        while self.i < len(self.s) and self.s[self.i] not in "|)":
            x, y = self.repeated()
            self.n.eps[last].append(x)
            last = y
        return first, last

    def repeated(self) -> tuple[int, int]:
        begin = self.i
        x, y = self.atom()
        end = self.i
        op = self.s[self.i : self.i + 1]
        if op and op in "?*+":
            self.i += 1
            return self.loop(x, y, op)
        if op == "{":
            close = self.s.index("}", self.i)
            low, _, _ = (bounds := self.s[self.i + 1 : close]).partition(",")
            after = close + 1
            for k in range(int(low) - 1 + bounds.endswith(",")):
                self.i = begin
                x2, y2 = self.atom()
                assert self.i == end
                if k == int(low) - 1:
                    x2, y2 = self.loop(x2, y2, "*")
                self.n.eps[y].append(x2)
                y = y2
            self.i = after
        return x, y

    def loop(self, x: int, y: int, op: str) -> tuple[int, int]:
        a, b = self.n.new(), self.n.new()
        self.n.eps[a].append(x)
        self.n.eps[y].append(b)
        if op in "?*":
            self.n.eps[a].append(b)
        if op in "*+":
            self.n.eps[y].append(x)
        return a, b

    def atom(self) -> tuple[int, int]:
        if self.s[self.i] == "(":
            self.i += 1
            out = self.union()
            self.i += 1
            return out
        a, b = self.n.new(), self.n.new()
        self.n.arc[a] = (self.bytes_of(), b)
        return a, b

    def char(self) -> int:
        c = self.s[self.i]
        self.i += 1
        if c == "\\":
            c = self.s[self.i]
            self.i += 1
            if c == "x":
                self.i += 2
                return int(self.s[self.i - 2 : self.i], 16)
        return ord(c)

    def bytes_of(self) -> frozenset[int]:
        if self.s[self.i] != "[":
            out = {self.char()}
        else:
            self.i += 1
            out: set[int] = set()
            while self.s[self.i] != "]":
                low = high = self.char()
                if self.s[self.i] == "-" and self.s[self.i + 1] != "]":
                    self.i += 1
                    high = self.char()
                out.update(range(low, high + 1))
            self.i += 1
        if self.fold:
            out |= {ord(chr(b).lower()) for b in out} | {ord(chr(b).upper()) for b in out}
        return frozenset(out)


def byte_classes(nfa: Nfa) -> list[int]:
    """For each byte the number of its class: bytes that the same arcs take behave alike."""
    index: dict[tuple, int] = {}
    arcs = [a[0] for a in nfa.arc if a]
    return [index.setdefault(tuple(b in a for a in arcs), len(index)) for b in range(256)]


def determinise(nfa: Nfa, classes: list[int], restart: bool) -> tuple[list[list[int]], list[int]]:
    """Subset construction: for each state its target by byte class (-1: none) and a bit mask of the rules that it accepts.

    ``restart``: a match may begin at every byte, and a rule that has accepted is
    not followed further, as that pass only tells which rules match.
    """
    rule_of = [max(((first, r) for r, first in nfa.first.items() if first <= s), default=(0, -1))[1] for s in range(len(nfa.eps))]
    keep = lambda states: frozenset(s for s in states if nfa.arc[s] or s in nfa.accept)
    byte_of = [classes.index(c) for c in range(max(classes) + 1)]
    reach = {s: keep(nfa.closure([arc[1]])) for s, arc in enumerate(nfa.arc) if arc}
    takes = {s: [c for c, b in enumerate(byte_of) if b in nfa.arc[s][0]] for s in reach}
    start = keep(nfa.closure([0]))
    index, rows, masks, todo = {start: 0}, [], [], [start]
    for states in todo:
        masks.append(sum(1 << r for r in {nfa.accept[s] for s in states if s in nfa.accept}))
        moves: dict[int, set[int]] = {}
        for s in states:
            if s in reach and not (restart and masks[-1] >> rule_of[s] & 1 and s not in start):
                for c in takes[s]:
                    moves.setdefault(c, set()).update(reach[s])
        row = [0 if restart else -1] * len(byte_of)
        for c, targets in moves.items():
            to = frozenset(targets | start) if restart else frozenset(targets)
            if to not in index:
                index[to] = len(index)
                todo.append(to)
            row[c] = index[to]
        rows.append(row)
    return rows, masks


def minimise(rows: list[list[int]], masks: list[int]) -> tuple[list[list[int]], list[int]]:
    """Partition refinement: states with equal masks and equal target classes merge; state 0 stays first."""
    cls, n = masks, 0
    while True:
        index: dict[tuple, int] = {}
        cls = [index.setdefault((c, *(cls[t] if t >= 0 else -1 for t in row)), len(index)) for c, row in zip(cls, rows)]
        if len(index) == n:
            break
        n = len(index)
    first: dict[int, int] = {}
    for s, c in enumerate(cls):
        first.setdefault(c, s)
    return [[cls[t] if t >= 0 else -1 for t in rows[s]] for s in first.values()], [masks[s] for s in first.values()]


def compiled_array(nfa: Nfa, restart: bool) -> tuple[list[list[int]], list[int]]:
    """The minimal automaton as rows of 256 targets, and its accept masks."""
    classes = byte_classes(nfa)
    rows, masks = minimise(*determinise(nfa, classes, restart))
    return [[row[c] for c in classes] for row in rows], masks


class Scanner:
    """Compiled rules: one array for the pass over all rules, one anchored array per rule for spans."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        union = Nfa()
        for i, r in enumerate(rules):
            union.add(i, r)
        self.rows, self.masks = compiled_array(union, True)
        self.own = []
        for r in rules:
            one = Nfa()
            one.add(0, r)
            self.own.append(compiled_array(one, False))

    def stretches(self, data: bytes) -> list[tuple[int, int, int]]:
        """(mask of the rules that accept, begin, end) of the stretches between visits to the start state: one pass, one table step a byte."""
        rows, masks, state, mask, begin, out = self.rows, self.masks, 0, 0, 0, []
        for i, b in enumerate(data):
            state = rows[state][b]
            if state:
                if masks[state]:
                    mask |= masks[state]
            else:
                if mask:
                    out.append((mask, begin, i + 1))
                    mask = 0
                begin = i + 1
        if mask:
            out.append((mask, begin, len(data)))
        return out

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(byte start, rule, byte end), by start, then rule."""
        out, done = [], [0] * len(self.rules)
        for mask, begin, end in self.stretches(data):
            for k in range(len(self.rules)):
                if mask >> k & 1 and done[k] < end:
                    done[k] = self._of(k, data, max(begin, done[k]), end, out)
        return sorted(out)

    def _of(self, k: int, data: bytes, at: int, last: int, out: list) -> int:
        """Appends the matches of a rule that begin in [at, last); gives the end of the last one."""
        (rows, masks), check, n = self.own[k], self.rules[k].holds, len(data)
        first = rows[0]
        while at < last:
            if first[data[at]] < 0:
                at += 1
                continue
            state, end = 0, -1
            for i in range(at, n):
                state = rows[state][data[i]]
                if state < 0:
                    break
                if masks[state]:
                    end = i + 1
            if end < 0:
                at += 1
                continue
            if check(data[at:end].decode()):
                out.append((at, k, end))
            at = end
        return at


@lru_cache(maxsize=4)
def scanner_of(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def text_spans(scanner: Scanner, text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive."""
    data = (text or "").encode()
    found = scanner.spans(data)
    if not found or len(data) == len(text):
        return [(scanner.rules[k].kind, a, b) for a, k, b in found]
    at = {0: 0}
    last = chars = 0
    for p in sorted({x for a, _, b in found for x in (a, b)}):
        chars += len(data[last:p].decode())
        at[p], last = chars, p
    return [(scanner.rules[k].kind, at[a], at[b]) for a, k, b in found]


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: its id and ``spans`` array<struct<kind,start,end>> over the whole text."""
    spark = docs.sparkSession
    small_batches(spark)
    compiled = spark.sparkContext.broadcast(scanner_of(rules))  # bounded by the rules, not by the data

    def run(batches):
        scanner = compiled.value
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in text_spans(scanner, t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    id_type = docs.schema[doc_id].dataType.simpleString()
    return docs.select(docs[doc_id], docs[text].cast("string")).mapInArrow(run, f"doc_id {id_type}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", mark: str = "<secret>") -> DataFrame:
    """The documents with every span replaced by ``mark``; overlapping spans merge. All columns and rows stay; null texts stay null; an ``n_chars`` column of whole numbers is brought up to date, one of another type is left as it is."""
    small_batches(docs.sparkSession)
    compiled = docs.sparkSession.sparkContext.broadcast(scanner_of(rules))
    names = docs.columns
    at, chars = names.index(text), names.index("n_chars") if dict(docs.dtypes).get("n_chars") in ("int", "bigint") else None

    def cleaned(scanner: Scanner, value: str | None) -> str | None:
        if value is None:
            return None
        out, done = [], 0
        for _, a, b in text_spans(scanner, value):
            if a >= done:
                out += [value[done:a], mark]
            done = max(done, b)
        return "".join(out) + value[done:] if out else value

    def run(batches):
        scanner = compiled.value
        for b in batches:
            old = b.column(at).to_pylist()
            new = [cleaned(scanner, t) for t in old]
            cols = list(b.columns)
            cols[at] = pa.array(new, b.schema.field(at).type)
            if chars is not None:
                have = cols[chars].to_pylist()
                cols[chars] = pa.array([n if x is y or y is None else len(y) for n, x, y in zip(have, old, new)], b.schema.field(chars).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)
