"""Secret scans by one combined deterministic automaton.

The rules' regular expressions become one NFA over bytes; subset construction gives a DFA whose accepting
states carry the set of rules that end there, Moore's refinement minimises it, and byte classes shrink it to
a transition array. A slice of texts is cut into lanes at synchronising bytes (those that send every state to
the start, so no match crosses them), and where those are far apart after a fixed number of bytes, and all lanes
advance together, one byte a step, all rules at once. A lane that was cut between synchronising bytes runs from the
start first and again from the state in which its predecessor ended, if that is another one, until no state changes.
Chains of lanes in which a rule accepted are then matched by the rule's own expression to give exact spans.

Defined results: null text is empty; offsets are code points, end exclusive; rows that repeat are scanned each; a null
doc_id stays null; an empty table gives an empty result; other columns are not read (``redact`` keeps them).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as sre
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import slices, text_bytes

#: The rules. ``scan`` is what the automaton accepts (a counted tail only where the start is common: counters
#: multiply the states), ``match`` gives the spans, ``least`` the characters that ``group`` must have; ``rest`` is what a span
#: goes on with after its match, wherever lanes end: of a private key all to its END line, or without one its lines of code.
RULES = {
    "assign": {"scan": r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{12}", "match": r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", "group": 2, "least": 12},
    "access": {"scan": r"AKIA[A-Z0-9]", "match": r"AKIA[A-Z0-9]+", "group": 0, "least": 18},
    "hex": {"scan": r"[0-9a-f]{16}", "match": r"[0-9a-f]+", "group": 0, "least": 16},
    "forge": {"scan": r"gh[pousr]_[A-Za-z0-9]", "match": r"gh[pousr]_[A-Za-z0-9]+", "group": 0, "least": 40},
    "chat": {"scan": r"xox[abprs]-[A-Za-z0-9-]", "match": r"xox[abprs]-[A-Za-z0-9-]+", "group": 0, "least": 15},
    "pem": {"scan": r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "match": r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "group": 0, "least": 1, "rest": r"(?s:(?:(?!-----BEGIN ).)*?)-----END [A-Z ]*PRIVATE KEY-----|(?:\s+[A-Za-z0-9+/=]{32,})*"},
}
BASE_KINDS = ("assign", "access", "hex")
#: Bytes after which a lane ends at the next synchronising byte.
LANE_BYTES = 1024


@dataclass(frozen=True)
class Automaton:
    """step[state * n_classes + class] is the next state times n_classes; states from ``accepting`` on accept."""

    kinds: tuple[str, ...]
    classes: np.ndarray
    n_classes: int
    step: np.ndarray
    start: int
    accepting: int
    masks: np.ndarray
    sync: np.ndarray


class _Nfa:
    """Thompson construction over bytes: arcs[state] = [(byte set, state)], free[state] = [state]."""

    def __init__(self) -> None:
        self.arcs: list[list[tuple[frozenset, int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.arcs.append([])
        self.free.append([])
        return len(self.arcs) - 1

    def bytes_of(self, items, fold: bool) -> frozenset:
        found: set[int] = set()
        negated = False
        for op, value in items:
            if op is sre.NEGATE:
                negated = True
            elif op is sre.LITERAL:
                found.add(value)
            elif op is sre.RANGE:
                found.update(range(value[0], value[1] + 1))
            else:
                raise ValueError(f"not a byte set: {op}")
        if fold:
            found |= {ord(chr(b).swapcase()) for b in found if b < 128 and chr(b).isalpha()}
        return frozenset(set(range(256)) - found if negated else found)

    def add(self, tree, begin: int, fold: bool) -> int:
        for op, value in tree:
            if op is sre.LITERAL:
                end = self.state()
                self.arcs[begin].append((self.bytes_of([(op, value)], fold), end))
            elif op is sre.IN:
                end = self.state()
                self.arcs[begin].append((self.bytes_of(value, fold), end))
            elif op is sre.SUBPATTERN:
                end = self.add(value[3], begin, fold)
            elif op is sre.BRANCH:
                end = self.state()
                for branch in value[1]:
                    self.free[self.add(branch, begin, fold)].append(end)
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
                least, most, body = value
                end = begin
                for _ in range(least):
                    end = self.add(body, end, fold)
                if most is sre.MAXREPEAT:
                    loop = self.state()
                    self.free[end].append(loop)
                    self.free[self.add(body, loop, fold)].append(loop)
                    end = loop
                else:
                    out = self.state()
                    for _ in range(most - least):
                        self.free[end].append(out)
                        end = self.add(body, end, fold)
                    self.free[end].append(out)
                    end = out
            else:
                raise ValueError(f"not supported in a rule: {op}")
            begin = end
        return begin

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.free[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(x for x in seen if self.arcs[x] or x in self.ends)

    ends: dict[int, int] = {}


def compile_rules(rules: dict[str, str]) -> Automaton:
    """One minimal DFA for all ``rules`` (kind -> regular expression), unanchored."""
    nfa, kinds = _Nfa(), tuple(rules)
    root = nfa.state()
    nfa.ends = {}
    for number, kind in enumerate(kinds):
        tree = _parser.parse(rules[kind].encode("ascii"))
        begin = nfa.state()
        nfa.free[root].append(begin)
        end = nfa.add(tree, begin, bool(tree.state.flags & re.IGNORECASE))
        nfa.ends[end] = 1 << number
    sets = list({s for arcs in nfa.arcs for s, _ in arcs})
    member = np.array([[b in s for s in sets] for b in range(256)])
    _, classes = np.unique(member, axis=0, return_inverse=True)
    classes = classes.reshape(-1).astype(np.uint8)
    n_classes = int(classes.max()) + 1
    sample = [int(np.flatnonzero(classes == c)[0]) for c in range(n_classes)]
    moves = [[frozenset(c for c, b in enumerate(sample) if b in s) for s, _ in arcs] for arcs in nfa.arcs]
    start = nfa.closure({root})
    numbers, order, table = {start: 0}, [start], []
    for subset in order:  # grows while it is read
        reach: list[set[int]] = [set() for _ in range(n_classes)]
        for x in subset:
            for taken, (_, to) in zip(moves[x], nfa.arcs[x]):
                for c in taken:
                    reach[c].add(to)
        row = []
        for targets in reach:
            to = nfa.closure(targets) | start
            if to not in numbers:
                numbers[to] = len(order)
                order.append(to)
            row.append(numbers[to])
        table.append(row)
    step = np.array(table, np.int64)
    masks = np.array([sum({nfa.ends[x] for x in subset if x in nfa.ends}) for subset in order], np.int64)
    block = np.unique(masks, return_inverse=True)[1].reshape(-1)
    while True:  # Moore: states are alike if they accept alike and all moves lead to alike states
        finer = np.unique(np.column_stack([block, block[step]]), axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    n = int(block.max()) + 1
    member_of = np.zeros(n, np.int64)
    member_of[block] = np.arange(len(block))
    small_masks = masks[member_of]
    rank = np.empty(n, np.int64)
    rank[np.argsort(small_masks != 0, kind="stable")] = np.arange(n)
    small = np.empty((n, n_classes), np.int64)
    small[rank] = rank[block[step[member_of]]]
    out_masks = np.empty(n, np.int64)
    out_masks[rank] = small_masks
    first = int(rank[block[0]])
    sync = (small == first).all(axis=0)[classes]
    return Automaton(kinds, classes, n_classes, (small * n_classes).ravel(), first * n_classes, int((out_masks == 0).sum()) * n_classes, out_masks, sync)


def lanes(data: np.ndarray, offsets: np.ndarray, sync: np.ndarray, length: int = LANE_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, text number, whether a lane goes on with the one before): the texts cut at synchronising bytes about every ``length`` bytes, and what is longer than four times that at any byte."""
    cuts = np.flatnonzero(sync[data])
    if len(cuts):
        at = np.searchsorted(cuts, np.arange(length, len(data), length))
        cuts = cuts[np.unique(at[at < len(cuts)])]
    edges = np.unique(np.concatenate([offsets, cuts]))
    starts, sizes = edges[:-1], np.diff(edges)
    pieces = np.where(sizes > 4 * length, -(-sizes // length), 1)
    place = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = np.repeat(starts, pieces) + place * length
    ends = np.append(starts[1:], edges[-1])
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1, place > 0


def run_lanes(dfa: Automaton, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, begin: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(the mask of rules that accept somewhere in each lane, the state that it ends in), from the start or from ``begin``."""
    order = np.argsort(starts - ends, kind="stable")
    at, left = starts[order], (ends - starts)[order]
    classes = dfa.classes
    state = np.full(len(at), dfa.start, np.int64) if begin is None else begin[order]
    masks = np.zeros(len(at), np.int64)
    alive = np.searchsorted(-left, -np.arange(int(left.max(initial=0))), "left")  # lanes longer than each step
    for t, k in enumerate(alive.tolist()):
        now = dfa.step.take(state[:k] + classes.take(data.take(at[:k] + t)))
        state[:k] = now
        hit = now >= dfa.accepting
        if hit.any():
            rows = np.flatnonzero(hit)
            masks[rows] |= dfa.masks[now[rows] // dfa.n_classes]
    back = np.empty(len(at), np.int64)
    back[order] = np.arange(len(at))
    return masks[back], state[back]


def scan_lanes(dfa: Automaton, data: np.ndarray, offsets: np.ndarray, length: int = LANE_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, text number, mask of rules that accept) of the chains of lanes between synchronising bytes."""
    starts, ends, owner, tied = lanes(data, offsets, dfa.sync, length)
    masks, last = run_lanes(dfa, data, starts, ends)
    if tied.any():
        first = np.full(len(starts), dfa.start, np.int64)
        while len(again := np.flatnonzero(tied[1:] & (last[:-1] != first[1:])) + 1):
            first[again] = last[again - 1]
            masks[again], last[again] = run_lanes(dfa, data, starts[again], ends[again], first[again])
        head = np.flatnonzero(~tied)
        masks, ends = np.bitwise_or.reduceat(masks, head), np.append(starts[head[1:]], ends[-1])
        starts, owner = starts[head], owner[head]
    return starts, ends, owner, masks


def matchers_of(rules: dict[str, dict]) -> list[tuple]:
    return [(re.compile(r["match"].encode("ascii")), r["group"], r["least"], re.compile(r["rest"].encode("ascii")) if "rest" in r else None) for r in rules.values()]


def spans_of(dfa: Automaton, matchers: list, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(text number, start, end, kind number), positions in code points, by text and start."""
    starts, ends, owner, masks = scan_lanes(dfa, data, offsets)
    found, whole = [], memoryview(data)
    done = [0] * len(matchers)  # where the kind's last span that went on beyond its match ends
    for lane in np.flatnonzero(masks).tolist():
        piece, text = data[starts[lane] : ends[lane]].tobytes(), int(owner[lane])
        for kind, (pattern, group, least, rest) in enumerate(matchers):
            if masks[lane] >> kind & 1:
                for m in pattern.finditer(piece):
                    begin, end = int(starts[lane]) + m.start(), int(starts[lane]) + m.end()
                    if len(m[group]) < least or begin < done[kind]:
                        continue
                    if rest:
                        end = rest.match(whole, end, int(offsets[text + 1])).end()
                        done[kind] = end
                    found.append((text, begin, end, kind))
    found.sort()
    base, before, text = 0, 0, -1
    for number, start, end, kind in found:  # code points: bytes that don't continue one
        if number != text:
            text, base, before = number, int(offsets[number]), 0
        before += int(((data[base:start] & 0xC0) != 0x80).sum())
        base = start
        yield number, before, before + int(((data[start:end] & 0xC0) != 0x80).sum()), kind


def scan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", rules: dict[str, dict] | None = None) -> DataFrame:
    """One row per document: doc_id, spans array<struct<kind, start, end>> by start, then kind as listed."""
    rules = rules or RULES
    dfa = compile_rules({k: r["scan"] for k, r in rules.items()})

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers = matchers_of(rules)
        for part in slices(source, "text"):
            data, offsets = text_bytes(part.column("text"))
            spans: list[list[dict]] = [[] for _ in range(part.num_rows)]
            for number, start, end, kind in spans_of(dfa, matchers, data, offsets):
                spans[number].append({"kind": dfa.kinds[kind], "start": start, "end": end})
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(spans, kinds_type)], ["doc_id", "spans"])

    kinds_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(batches, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", count_col: str = "n_chars") -> DataFrame:
    """``docs`` with every secret span in the text replaced by ``mark``; ``count_col``, if there is one, counts the changed texts' characters."""
    dfa = compile_rules({k: r["scan"] for k, r in RULES.items()})
    schema, rules = docs.schema, RULES

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers = matchers_of(rules)
        for part in slices(source, text_col):
            where = part.schema.get_field_index(text_col)
            data, offsets = text_bytes(part.column(where))
            found: dict[int, list[tuple[int, int]]] = {}
            for number, start, end, _ in spans_of(dfa, matchers, data, offsets):
                found.setdefault(number, []).append((start, end))
            if found:
                texts = part.column(where).to_pylist()
                for number, spans in found.items():
                    text, pieces, done = texts[number], [], 0
                    for start, end in spans:
                        if start >= done:
                            pieces += [text[done:start], mark]
                        done = max(done, end)
                    texts[number] = "".join([*pieces, text[done:]])
                columns = list(part.columns)
                columns[where] = pa.array(texts, part.schema.field(where).type)
                if (at := part.schema.get_field_index(count_col)) >= 0:
                    columns[at] = pa.array([len(texts[i]) if i in found else n for i, n in enumerate(part.column(at).to_pylist())], part.schema.field(at).type)
                part = pa.RecordBatch.from_arrays(columns, schema=part.schema)
            yield part

    return docs.mapInArrow(batches, schema)


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns from ``scan``'s spans."""
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return scanned.select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def fingerprint(kind_spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in kind_spans).encode()).hexdigest()
