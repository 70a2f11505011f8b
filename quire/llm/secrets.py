"""Secret scan: all rules as one deterministic automaton over bytes.

Rule expressions become one Thompson automaton, subset construction makes it deterministic and
partition refinement minimises it; the result is a flat transition array. A scan sends every
text's bytes once through that array, many text segments side by side. A segment is first entered
in the start state; segments whose true entry state turns out otherwise are run again until all
agree, so the result is that of one pass from the first byte to the last, whatever the length.
Where a rule's run of accepting positions ends, the rule's reversed automaton, walked backwards,
gives the match's start. Matches are leftmost-longest and do not overlap within a rule.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, flat, plus

_ops = re._constants
_SEGMENT = 2048


@dataclass(frozen=True)
class Rule:
    """kind; expression over bytes; the number of the group that must have min_len bytes (0: the match), for base rules.

    The expression must end in a repeated class or a fixed text, so that a match's end is where accepting ends."""

    kind: str
    pattern: str
    group: int = 0
    min_len: int = 0


#: The three base rules of the task.
BASE_RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: Publicly documented credential formats. Lengths are checked on the match: counters in many rules multiply the states.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    # the header and the lines of base64 after it, up to the END line; a backslash where line ends are written out
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:[\r\n\\]+[\x20\t]*[A-Za-z0-9+/=]*)*"),
)
RULES = BASE_RULES + MORE_RULES


class _Nfa:
    """Thompson automaton; edges hold sets of bytes."""

    def __init__(self) -> None:
        self.eps: list[list[int]] = []
        self.edges: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.eps.append([])
        self.edges.append([])
        return len(self.eps) - 1

    def build(self, items, fold: bool, at: int) -> int:
        for op, arg in items:
            if op is _ops.LITERAL:
                at = self.step(at, self.folded({arg}, fold))
            elif op is _ops.NOT_LITERAL:
                at = self.step(at, frozenset(range(256)) - self.folded({arg}, fold))
            elif op is _ops.ANY:
                at = self.step(at, frozenset(range(256)) - {10})
            elif op is _ops.IN:
                at = self.step(at, self.klass(arg, fold))
            elif op is _ops.SUBPATTERN:
                _, on, off, sub = arg
                at = self.build(sub, (fold or bool(on & re.I)) and not off & re.I, at)
            elif op is _ops.BRANCH:
                end = self.state()
                for sub in arg[1]:
                    s = self.state()
                    self.eps[at].append(s)
                    self.eps[self.build(sub, fold, s)].append(end)
                at = end
            elif op is _ops.MAX_REPEAT:
                lo, hi, sub = arg
                for _ in range(lo):
                    at = self.build(sub, fold, at)
                if hi is _ops.MAXREPEAT:
                    loop = self.state()
                    self.eps[at].append(loop)
                    s = self.state()
                    self.eps[loop].append(s)
                    self.eps[self.build(sub, fold, s)].append(loop)
                    at = loop
                else:
                    end = self.state()
                    for _ in range(hi - lo):
                        self.eps[at].append(end)
                        at = self.build(sub, fold, at)
                    self.eps[at].append(end)
                    at = end
            else:
                raise ValueError(f"not supported in a rule: {op}")
        return at

    def step(self, at: int, chars: frozenset) -> int:
        to = self.state()
        self.edges[at].append((chars, to))
        return to

    @staticmethod
    def folded(chars: set, fold: bool) -> frozenset:
        out = {c & 255 for c in chars}
        if fold:
            out |= {c ^ 32 for c in out if 65 <= (c & ~32) <= 90}
        return frozenset(out)

    def klass(self, items, fold: bool) -> frozenset:
        out: set[int] = set()
        negate = False
        for op, arg in items:
            if op is _ops.NEGATE:
                negate = True
            elif op is _ops.LITERAL:
                out.add(arg)
            elif op is _ops.RANGE:
                out |= set(range(arg[0], arg[1] + 1))
            else:
                raise ValueError(f"not supported in a class: {op}")
        got = self.folded(out, fold)
        return frozenset(range(256)) - got if negate else got

    def reverse(self, start: int, end: int) -> "_Nfa":
        back = _Nfa()
        for _ in self.eps:
            back.state()
        for s, tos in enumerate(self.eps):
            for t in tos:
                back.eps[t].append(s)
        for s, edges in enumerate(self.edges):
            for chars, t in edges:
                back.edges[t].append((chars, s))
        return back

    def closure(self, states) -> frozenset:
        out, todo = set(states), list(states)
        while todo:
            for t in self.eps[todo.pop()]:
                if t not in out:
                    out.add(t)
                    todo.append(t)
        return frozenset(out)


@dataclass
class Dfa:
    """Flat transitions step[state << shift | klass[byte]], start state 0, accepted rules per state as bits."""

    step: np.ndarray
    shift: int
    klass: np.ndarray
    accept: np.ndarray


def _determine(nfa: _Nfa, start: int, ends: dict[int, int], anywhere: bool) -> Dfa:
    """ends: accepting state -> rule bit. anywhere: a match may begin at every byte."""
    every = {chars for edges in nfa.edges for chars, _ in edges}
    signature = [tuple(b in chars for chars in every) for b in range(256)]
    kinds = {s: i for i, s in enumerate(dict.fromkeys(signature))}
    klass = np.array([kinds[s] for s in signature], np.uint8)
    member = [int(np.flatnonzero(klass == k)[0]) for k in range(len(kinds))]
    begin = nfa.closure([start])
    ids, order, rows = {begin: 0}, [begin], []
    for states in order:
        row = []
        for b in member:
            to = {t for s in states for chars, t in nfa.edges[s] if b in chars}
            to = nfa.closure(to | {start} if anywhere else to)
            if to not in ids:
                ids[to] = len(order)
                order.append(to)
            row.append(ids[to])
        rows.append(row)
    accept = np.array([sum(1 << r for r in {ends[s] for s in states if s in ends}) for states in order], np.int64)
    table = np.array(rows, np.int64)
    # refinement: states stay together while they accept alike and their successors do
    part = np.unique(accept, return_inverse=True)[1]
    while True:
        new = np.unique(np.column_stack([part, part[table]]), axis=0, return_inverse=True)[1].ravel()
        if new.max() == part.max():
            break
        part = new
    rename = {}
    for p in part:  # the start state becomes 0
        rename.setdefault(int(p), len(rename))
    part = np.array([rename[int(p)] for p in part])
    one = np.unique(part, return_index=True)[1]
    shift = max(1, int(len(kinds) - 1).bit_length())
    step = np.zeros(len(one) << shift, np.int32)
    for k in range(len(kinds)):
        step[(np.arange(len(one)) << shift) + k] = part[table[one, k]]
    return Dfa(step, shift, klass, accept[one])


class Scanner:
    """The combined automaton of some rules, and each rule's reversed automaton."""

    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.rules = rules
        nfa = _Nfa()
        start = nfa.state()
        ends = {}
        self.back: list[Dfa] = []
        for r, rule in enumerate(rules):
            parsed = re._parser.parse(rule.pattern.encode())
            s = nfa.state()
            nfa.eps[start].append(s)
            ends[nfa.build(parsed, False, s)] = r
            own = _Nfa()
            a = own.state()
            z = own.build(parsed, False, a)
            self.back.append(_determine(own.reverse(a, z), z, {a: 0}, False))
        self.dfa = _determine(nfa, start, ends, True)
        self.group = [re.compile(rule.pattern.encode()) if rule.group else None for rule in rules]
        self.any_accept = self.dfa.accept != 0

    def _run(self, codes, start, size, state):
        """Send segments through the automaton; end states and accepting positions (segment, place, rules)."""
        order = np.argsort(-size, kind="stable")
        at, left, st = start[order], size[order], state[order].astype(np.int32)
        step, shift, anyacc = self.dfa.step, self.dfa.shift, self.any_accept
        hits = []
        n = len(order)
        active = n
        for t in range(int(left[0]) if n else 0):
            while active and left[active - 1] <= t:
                active -= 1
            cur = st[:active]
            np.left_shift(cur, shift, out=cur)
            cur |= codes[at[:active] + t]
            np.take(step, cur, out=cur, mode="clip")
            hot = np.flatnonzero(anyacc[cur])
            if len(hot):
                hits.append((order[hot], at[hot] + t, self.dfa.accept[cur[hot]]))
        out = np.empty(n, np.int32)
        out[order] = st
        if hits:
            return out, *(np.concatenate(x) for x in zip(*hits))
        z = np.zeros(0, np.int64)
        return out, z, z, z

    def accepting(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions (of a match's last byte) and rule bits, ascending, over all rows."""
        size = np.diff(off)
        parts = -(-size // _SEGMENT)
        row = np.repeat(np.arange(len(size)), parts)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = off[row] + nth * _SEGMENT
        length = np.minimum(_SEGMENT, off[row + 1] - start)
        codes = self.dfa.klass[data].astype(np.int32)
        entry = np.zeros(len(row), np.int32)
        end, seg, pos, acc = self._run(codes, start, length, entry)
        inner = nth > 0
        while len(row):
            true = np.where(inner, np.concatenate([[0], end[:-1]]), 0).astype(np.int32)
            again = np.flatnonzero(true != entry)
            if not len(again):
                break
            entry[again] = true[again]
            e2, s2, p2, a2 = self._run(codes, start[again], length[again], entry[again])
            end[again] = e2
            old = ~np.isin(seg, again)
            seg, pos, acc = np.concatenate([seg[old], again[s2]]), np.concatenate([pos[old], p2]), np.concatenate([acc[old], a2])
        order = np.argsort(pos, kind="stable")
        return pos[order], acc[order]

    def spans(self, data: np.ndarray, off: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """Row -> its matches (start, rule, end) in bytes from the row's start, by start and rule."""
        pos, acc = self.accepting(data, off)
        out: dict[int, list[tuple[int, int, int]]] = {}
        row = np.searchsorted(off, pos, "right") - 1
        for r in range(len(self.rules)):
            mine = (acc >> r) & 1 == 1
            p, w = pos[mine], row[mine]
            if not len(p):
                continue
            is_end = np.ones(len(p), bool)
            is_end[:-1] = (p[1:] != p[:-1] + 1) | (w[1:] != w[:-1])
            done: dict[int, int] = {}
            for last, i in zip(p[is_end].tolist(), w[is_end].tolist()):
                lo = max(int(off[i]), done.get(i, 0))
                first = self._begin(r, data, lo, last)
                if first < 0:
                    continue
                done[i] = last + 1
                if self._kept(r, data, first, last + 1):
                    out.setdefault(i, []).append((first - int(off[i]), r, last + 1 - int(off[i])))
        for found in out.values():
            found.sort()
        return out

    def _begin(self, r: int, data, lo: int, last: int) -> int:
        """The first byte, not before lo, of a match of rule r that ends with byte `last`; -1 if none."""
        d = self.back[r]
        step, shift, klass, accept = _lists(d)
        st, found, p = 0, -1, last
        dead = _dead(d)
        view = memoryview(data)
        while p >= lo:
            st = step[(st << shift) | klass[view[p]]]
            if st == dead:
                break
            if accept[st]:
                found = p
            p -= 1
        return found

    def _kept(self, r: int, data, s: int, e: int) -> bool:
        rule = self.rules[r]
        if not rule.group:
            return e - s >= rule.min_len
        m = self.group[r].fullmatch(data[s:e].tobytes())
        return m is not None and len(m[rule.group]) >= rule.min_len


def _lists(d: Dfa):
    if not hasattr(d, "plain"):
        d.plain = (d.step.tolist(), d.shift, d.klass.tolist(), (d.accept != 0).tolist())
    return d.plain


def _dead(d: Dfa) -> int:
    """The state that cannot accept any more, or -1."""
    if not hasattr(d, "stuck"):
        d.stuck = -1
        for s in range(len(d.accept)):
            if not d.accept[s] and (d.step[s << d.shift : (s << d.shift) + int(d.klass.max()) + 1] == s).all():
                d.stuck = s
    return d.stuck


@cache
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    """Built once per process."""
    return Scanner(rules)


def _code_points(data: np.ndarray, at: list[int]) -> list[int]:
    """Code points before each byte place of one text."""
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return heads[at].tolist()


def find_secrets(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, out: str = "secrets") -> DataFrame:
    """docs with one more column: array of (kind, start, end), code points, end exclusive, by start, then as rules are listed.

    A null or empty text has an empty array. Every row of the input gives one row. A column of that name is replaced."""
    docs = docs.drop(out)
    schema = plus(docs.schema, f"{out} array<struct<kind:string,start:bigint,end:bigint>>")

    def scan(batches):
        scan_all = scanner(rules)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            data, off = flat(b.column(text))
            found: list[list[dict]] = []
            for i, j in blocks(off):
                part = data[off[i] : off[j]]
                own = off[i : j + 1] - off[i]
                got = scan_all.spans(part, own)
                for k in range(j - i):
                    if k not in got:
                        found.append([])
                        continue
                    at = _code_points(part[own[k] : own[k + 1]], [x for s, _, e in got[k] for x in (s, e)])
                    found.append([{"kind": rules[r].kind, "start": at[2 * n], "end": at[2 * n + 1]} for n, (_, r, _) in enumerate(got[k])])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, kind)], names=[*b.schema.names, out])

    return docs.mapInArrow(scan, schema)


def redact(docs: DataFrame, text: str = "text", n_chars: str = "n_chars", mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The same rows and columns, each found span (overlapping ones together) replaced by a mark; n_chars follows."""
    schema = docs.schema

    def clean(batches):
        scan_all = scanner(rules)
        for b in batches:
            data, off = flat(b.column(text))
            texts = b.column(text).to_pylist()
            changed = False
            for i, j in blocks(off):
                part = data[off[i] : off[j]]
                own = off[i : j + 1] - off[i]
                for k, spans in scan_all.spans(part, own).items():
                    raw, out, at = part[own[k] : own[k + 1]].tobytes(), [], 0
                    joined: list[list[int]] = []
                    for s, _, e in spans:
                        if joined and s <= joined[-1][1]:
                            joined[-1][1] = max(joined[-1][1], e)
                        else:
                            joined.append([s, e])
                    for s, e in joined:
                        out += [raw[at:s], mark.encode()]
                        at = e
                    texts[i + k] = b"".join([*out, raw[at:]]).decode()
                    changed = True
            if changed:
                cols = {f.name: b.column(f.name) for f in b.schema}
                cols[text] = pa.array(texts, b.schema.field(text).type)
                if n_chars in cols:
                    cols[n_chars] = pa.array([None if t is None else len(t) for t in texts], b.schema.field(n_chars).type)
                b = pa.RecordBatch.from_arrays(list(cols.values()), schema=b.schema)
            yield b

    return docs.mapInArrow(clean, schema)


def _joined(spans) -> "F.Column":
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_secrets(docs).select("doc_id", "secrets")
    base = F.filter("secrets", lambda s: s["kind"].isin(*[r.kind for r in BASE_RULES]))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("secrets")).alias("spans"),
    )
