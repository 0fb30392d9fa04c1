"""Secret scans by one minimised automaton over bytes that follows all rules in a single pass."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import lru_cache
from operator import length_hint

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinweave.llm.rows import map_texts


@dataclass(frozen=True)
class Rule:
    """``head`` followed by a run of at least one byte of the class ``run``; kept when the run has ``least`` bytes.

    A shorter match, or one of fewer than ``total`` bytes in all, is consumed and
    dropped. Matches are leftmost, longest and do not overlap within a rule. ``least``
    is counted in the automaton's states, ``total`` on the spans that it finds. What
    the expression ``tail`` matches right behind a match belongs to its span.
    """

    kind: str
    head: str
    run: str
    least: int
    fold: bool = False  # letters of the head in either case
    total: int = 0
    tail: str = ""


# What follows a private key's first line: all up to its END line; where that is cut off, header lines and lines of base64.
_GAP = r"""(?:\\[nrt]|[\s"'+,>#*\\])"""
KEY_BODY = (
    r"[^-]*+(?:-(?!----)[^-]*+)*+-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----"
    rf"|(?:{_GAP}*+[A-Za-z-]++: [^\r\n\\]*+)*+(?:{_GAP}++[A-Za-z0-9+/]{{16,}}+={{0,2}}+)++"
    rf"""(?:{_GAP}++[A-Za-z0-9+/]++={{0,2}}+(?=[\r\n"'\\]|\Z))?"""
)

# The rules of the base contract.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]", 6, fold=True),
    Rule("access", "AKIA", "[A-Z0-9]", 1, total=20),
    Rule("hex", "", "[0-9a-f]", 24),
)
MORE_RULES = (
    Rule("forge", "gh[pousr]_", "[A-Za-z0-9]", 1, total=34),
    Rule("live", "[sr]k_live_", "[A-Za-z0-9]", 1, total=24),
    Rule("chat", "xox[abprs]-", "[A-Za-z0-9-]", 1, total=25),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.", "[A-Za-z0-9_-]", 1, total=40),
    Rule("pem", "-----BEGIN ([A-Z0-9]+ )*PRIVATE KEY( BLOCK)?----", "[-]", 1, tail=KEY_BODY),
)


class _Nfa:
    """Thompson construction for literals, classes, groups, ``|``, ``?``, ``*``, ``+`` and ``{n}``/``{n,m}``/``{n,}``."""

    def __init__(self):
        self.eps: list[list[int]] = []
        self.move: list[tuple[frozenset, int] | None] = []

    def state(self) -> int:
        self.eps.append([])
        self.move.append(None)
        return len(self.eps) - 1

    def add(self, pattern: str, start: int, fold: bool) -> int:
        self.p, self.i, self.fold = pattern, 0, fold
        tree = self._choice()
        if self.i != len(pattern):
            raise ValueError(f"cannot read {pattern!r} at {self.i}")
        return self._build(tree, start)

    def _choice(self):
        options = [self._sequence()]
        while self.i < len(self.p) and self.p[self.i] == "|":
            self.i += 1
            options.append(self._sequence())
        return ("or", options)

    def _sequence(self):
        parts = []
        while self.i < len(self.p) and self.p[self.i] not in "|)":
            parts.append(self._repeat(self._atom()))
        return ("cat", parts)

    def _byte(self) -> int:
        c = self.p[self.i]
        self.i += 1
        if c != "\\":
            return ord(c)
        c = self.p[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return int(self.p[self.i - 2 : self.i], 16)
        return ord(c)

    def _atom(self):
        if self.p[self.i] == "(":
            self.i += 1
            inner = self._choice()
            self.i += 1
            return inner
        if self.p[self.i] != "[":
            chars = {self._byte()}
        else:
            self.i, chars = self.i + 1, set()
            while self.p[self.i] != "]":
                low = high = self._byte()
                if self.p[self.i] == "-" and self.p[self.i + 1] != "]":
                    self.i += 1
                    high = self._byte()
                chars |= set(range(low, high + 1))
            self.i += 1
        if self.fold:
            chars |= {b ^ 32 for b in chars if 65 <= b & ~32 <= 90}
        return ("set", frozenset(chars))

    def _repeat(self, atom):
        while self.i < len(self.p) and self.p[self.i] in "?*+{":
            c = self.p[self.i]
            self.i += 1
            low, high = {"?": (0, 1), "*": (0, None), "+": (1, None), "{": (0, 0)}[c]
            if c == "{":
                end = self.p.index("}", self.i)
                a, _, b = self.p[self.i : end].partition(",")
                low, high = int(a), int(b) if b else None if "," in self.p[self.i : end] else int(a)
                self.i = end + 1
            atom = ("rep", atom, low, high)
        return atom

    def _build(self, tree, at: int) -> int:
        if tree[0] == "set":
            out = self.state()
            self.move[at] = (tree[1], out)
            return out
        if tree[0] == "cat":
            for part in tree[1]:
                into = self.state()
                self.eps[at].append(into)
                at = self._build(part, into)
            return at
        out = self.state()
        if tree[0] == "or":
            for option in tree[1]:
                into = self.state()
                self.eps[at].append(into)
                self.eps[self._build(option, into)].append(out)
            return out
        _, inner, low, high = tree
        for _ in range(low):
            into = self.state()
            self.eps[at].append(into)
            at = self._build(inner, into)
        if high is None:
            loop = self.state()
            self.eps[at].append(loop)
            into = self.state()
            self.eps[loop].append(into)
            self.eps[self._build(inner, into)].append(loop)
            self.eps[loop].append(out)
        else:
            for _ in range(high - low):
                self.eps[at].append(out)
                into = self.state()
                self.eps[at].append(into)
                at = self._build(inner, into)
            self.eps[at].append(out)
        return out

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.eps[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(s for s in seen if self.move[s] is not None or s in self.ends)

    def step(self, states, byte: int) -> frozenset:
        return self.closure({self.move[s][1] for s in states if self.move[s] is not None and byte in self.move[s][0]})


def _rule_nfa(rule: Rule) -> tuple[_Nfa, int, dict[int, bool]]:
    """The rule's automaton, its start and its accepting states: False if the run is still too short."""
    nfa = _Nfa()
    start = nfa.state()
    body = nfa.add(rule.head, start, rule.fold) if rule.head else start
    ends = {}
    if rule.least > 1:
        into = nfa.state()
        nfa.eps[body].append(into)
        ends[nfa.add(f"{rule.run}{{1,{rule.least - 1}}}", into, False)] = False
    into = nfa.state()
    nfa.eps[body].append(into)
    ends[nfa.add(f"{rule.run}{{{rule.least},}}", into, False)] = True
    nfa.ends = ends
    return nfa, start, ends


def _byte_classes(nfas: list[_Nfa]) -> list[list[int]]:
    """Bytes that no rule tells apart, together."""
    sets = sorted({m[0] for n in nfas for m in n.move if m is not None}, key=sorted)
    groups: dict[tuple, list[int]] = {}
    for b in range(256):
        groups.setdefault(tuple(b in s for s in sets), []).append(b)
    return list(groups.values())


NOTHING, DROPPED, KEPT = 0, 1, 2


def _forward(rule: Rule, classes: list[list[int]]) -> tuple[list[list[int]], list[list[int]], list[int]]:
    """Subset construction of a scanning automaton: next state and output by byte class, and output at the end.

    A state is the tuple of thread sets by start, earliest first. A thread set that
    has matched silences later starts; when it dies the match is put out and the byte
    that ended it is read afresh.
    """
    nfa, start, ends = _rule_nfa(rule)
    fresh = nfa.closure({start})

    def matched(state):
        for group in state:
            if hit := [ends[s] for s in group if s in ends]:
                return KEPT if any(hit) else DROPPED
        return NOTHING

    def advance(state, byte):
        out, seen = [], set()
        for group in (*state, fresh) if not matched(state) else state:
            if now := frozenset(nfa.step(group, byte)) - seen:
                seen |= now
                out.append(now)
                if any(s in ends for s in now):
                    break
        return tuple(out)

    ids, todo, nxt, put = {(): 0}, [()], [], []
    for state in todo:
        row, said = [], []
        for cls in classes:
            was, new, output = matched(state), advance(state, cls[0]), NOTHING
            if was and not matched(new):
                if new:
                    raise ValueError(f"{rule.kind}: a match must end with its run")
                new, output = advance((), cls[0]), was
            if new not in ids:
                ids[new] = len(ids)
                todo.append(new)
            row.append(ids[new])
            said.append(output if output == KEPT or rule.head else NOTHING)
        nxt.append(row)
        put.append(said)
    return nxt, put, [matched(s) for s in todo]


def _minimise(nxt: np.ndarray, put: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge states that no continuation tells apart; the start stays state 0."""
    label = np.unique(np.column_stack([put, end]), axis=0, return_inverse=True)[1].ravel()
    while True:
        _, first, new = np.unique(np.column_stack([label, label[nxt]]), axis=0, return_index=True, return_inverse=True)
        new = new.ravel()
        if len(first) == label.max() + 1:
            break
        label = new
    rank = np.empty(len(first), dtype=np.int64)
    rank[np.argsort(first, kind="stable")] = np.arange(len(first))
    order = np.sort(first)
    label = rank[new]
    return label[nxt[order]], put[order], end[order]


def _backward(rule: Rule) -> list[tuple[dict[int, int], bool]]:
    """Deterministic automaton of the reversed rule (runs of full length), to walk from a match's end to its start."""
    nfa, start, ends = _rule_nfa(rule)
    into: dict[int, list[tuple[frozenset, int]]] = {}
    back: dict[int, list[int]] = {}
    for s, m in enumerate(nfa.move):
        if m is not None:
            into.setdefault(m[1], []).append((m[0], s))
        for t in nfa.eps[s]:
            back.setdefault(t, []).append(s)

    def closure(states):
        seen, todo = set(states), list(states)
        while todo:
            for t in back.get(todo.pop(), ()):
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    first = closure([s for s, full in ends.items() if full])
    ids, todo, rows = {first: 0}, [first], []
    for state in todo:
        row = {}
        for b in range(256):
            new = closure({s for t in state for chars, s in into.get(t, ()) if b in chars})
            if new:
                if new not in ids:
                    ids[new] = len(ids)
                    todo.append(new)
                row[b] = ids[new]
        rows.append((row, start in state))
    return rows


class _Put:
    """Stands in a transition array where rules put out matches: not indexable, so the scan loop stops on it."""

    __slots__ = ("outputs", "row")

    def __init__(self, row, outputs):
        self.row, self.outputs = row, outputs


class Automaton:
    """All rules in one table of transition arrays."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        classes = _byte_classes([_rule_nfa(r)[0] for r in rules])
        parts = []
        for rule in rules:
            nxt, put, end = _forward(rule, classes)
            parts.append(_minimise(np.array(nxt), np.array(put), np.array(end)))
        nxts = [p[0].tolist() for p in parts]
        puts = [p[1].tolist() for p in parts]
        ids, todo, nxt, put = {(0,) * len(rules): 0}, [(0,) * len(rules)], [], []
        outs: dict[tuple, int] = {(NOTHING,) * len(rules): 0}
        for state in todo:
            row, said = [], []
            for c in range(len(classes)):
                new = tuple([n[s][c] for n, s in zip(nxts, state, strict=True)])
                if new not in ids:
                    ids[new] = len(ids)
                    todo.append(new)
                row.append(ids[new])
                said.append(outs.setdefault(tuple([p[s][c] for p, s in zip(puts, state, strict=True)]), len(outs)))
            nxt.append(row)
            put.append(said)
        end = [outs.setdefault(tuple([int(p[2][s]) for p, s in zip(parts, state, strict=True)]), len(outs)) for state in todo]
        self.next, self.put, self.end = _minimise(np.array(nxt), np.array(put), np.array(end))
        self.outputs = [tuple((r, v) for r, v in enumerate(o) if v) for o in sorted(outs, key=outs.get)]
        self.byte_class = np.empty(256, dtype=np.int64)
        for c, members in enumerate(classes):
            self.byte_class[members] = c
        self.backward = [_backward(r) if r.head else None for r in rules]
        self._rows = None

    def __getstate__(self):
        return self.__dict__ | {"_rows": None}

    def _table(self) -> list[list]:
        if self._rows is None:
            rows = [[None] * 256 for _ in range(len(self.next))]
            wide_next, wide_put = self.next[:, self.byte_class].tolist(), self.put[:, self.byte_class].tolist()
            made: dict[tuple[int, int], _Put] = {}
            for s, row in enumerate(rows):
                for b in range(256):
                    t, o = wide_next[s][b], wide_put[s][b]
                    row[b] = made.setdefault((t, o), _Put(rows[t], self.outputs[o])) if o else rows[t]
                row.append(self.outputs[self.end[s]])
            self._rows = rows
        return self._rows

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        """``(start, rule, end)`` in byte offsets by start, then rule."""
        row, found, size = self._table()[0], [], len(data)
        it = iter(data)
        while True:
            try:
                for b in it:
                    row = row[b]
                break
            except TypeError:
                at = size - length_hint(it) - 2
                found += [(at, r, v) for r, v in row.outputs]
                row = row.row[b]
        if isinstance(row, _Put):
            found += [(size - 1, r, v) for r, v in row.outputs]
            row = row.row
        found += [(size, r, v) for r, v in row[256]]
        spans, last = [], [0] * len(self.rules)
        for end, r, v in found:
            if v == KEPT:
                start = self._start(r, data, end, last[r])
                if end - start >= self.rules[r].total:
                    spans.append((start, r, self._stop(r, data, end)))
            last[r] = end
        return sorted(spans)

    def _stop(self, r: int, data: bytes, end: int) -> int:
        tail = self.rules[r].tail
        more = re.compile(tail.encode()).match(data, end) if tail else None
        return more.end() if more else end

    def _start(self, r: int, data: bytes, end: int, floor: int) -> int:
        if self.backward[r] is None:
            run = _run_bytes(self.rules[r].run)
            at = end
            while at > floor and data[at - 1] in run:
                at -= 1
            return at
        rows, state, at, best = self.backward[r], 0, end, end
        while at > floor:
            state = rows[state][0].get(data[at - 1])
            if state is None:
                break
            at -= 1
            if rows[state][1]:
                best = at
        return best


@lru_cache
def _run_bytes(run: str) -> frozenset:
    nfa = _Nfa()
    nfa.ends = {}
    nfa.add(run, nfa.state(), False)
    return next(m[0] for m in nfa.move if m is not None)


@lru_cache
def automaton(rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> Automaton:
    return Automaton(rules)


def _spans(auto: Automaton, text: str) -> list[tuple[int, str, int]]:
    """Spans in code points by start, then rule: (start, kind, end)."""
    data = text.encode("utf-8", "surrogatepass")
    spans = auto.scan(data)
    if spans and len(data) != len(text):
        heads = np.concatenate([[0], np.cumsum((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80)])
        spans = [(int(heads[s]), r, int(heads[e])) for s, r, e in spans]
    return [(s, auto.rules[r].kind, e) for s, r, e in spans]


def _joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join([f"{k}:{s}:{e}" for s, k, e in spans])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """Find secrets in every whole text.

    Returns doc_id, n_assign, n_access, n_hex, base_sha256 (of the base spans) and
    spans (all of them) as ``kind:start:end`` in code points, end exclusive, comma
    joined by start, then kind as listed. A null text counts as empty and has none;
    null doc_ids and repeated rows are kept; an empty table gives no rows. The
    automaton (a few hundred kB, fixed by the rules) is all that is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(automaton(rules))
    base = [r.kind for r in BASE_RULES]

    def make():
        auto = shared.value

        def work(texts):
            spans = [_spans(auto, t) if t else [] for t in texts]
            own = [[x for x in found if x[1] in base] for found in spans]
            counts = [[sum(k == b for _, k, _ in found) for found in own] for b in base]
            return [*counts, [hashlib.sha256(_joined(found).encode()).hexdigest() for found in own], [_joined(found) for found in spans]]

        return work

    fields = [(f"n_{b}", pa.int64(), "long") for b in base] + [("base_sha256", pa.string(), "string"), ("spans", pa.string(), "string")]
    return map_texts(docs.select("doc_id", "text"), make, fields)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, mark: str = "[secret]") -> DataFrame:
    """The documents, all columns and rows, with every found span (overlaps joined) replaced by ``mark``; null texts stay null."""
    shared = docs.sparkSession.sparkContext.broadcast(automaton(rules))

    def make():
        auto = shared.value

        def clean(text):
            if not text:
                return text
            out, at = [], 0
            for s, _, e in _spans(auto, text):
                if s >= at:
                    out += [text[at:s], mark]
                at = max(at, e)
            return "".join([*out, text[at:]])

        return lambda texts: [[clean(t) for t in texts]]

    rows = docs.select("text", F.struct(*[c for c in docs.columns if c != "text"]).alias("_row"))
    done = map_texts(rows, make, [("_text", pa.string(), "string")])
    return done.select(*[F.col("_text").alias(c) if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns])
