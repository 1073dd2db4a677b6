"""Byte regexes compiled together into minimal deterministic automata: forward over many places at once, backward from ends."""

from __future__ import annotations

from re import _constants as C
from re import _parser

import numpy as np


class _Nfa:
    """Parsed items as states; with back, those of the reversed strings."""

    def __init__(self, back: bool = False):
        self.back = back
        self.eps: list[list[int]] = []
        self.arcs: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.eps.append([])
        self.arcs.append([])
        return len(self.eps) - 1

    def add(self, items, at: int, fold: bool) -> int:
        """Append parsed items after state at; returns the last state."""
        for op, arg in reversed(list(items)) if self.back else items:
            if op in (C.LITERAL, C.NOT_LITERAL, C.IN, C.ANY):
                to = self.state()
                self.arcs[at].append((_bytes(op, arg, fold), to))
                at = to
            elif op is C.SUBPATTERN:
                at = self.add(arg[3], at, (fold or bool(arg[1] & 2)) and not arg[2] & 2)
            elif op is C.BRANCH:
                end = self.state()
                for way in arg[1]:
                    start = self.state()
                    self.eps[at].append(start)
                    self.eps[self.add(way, start, fold)].append(end)
                at = end
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
                low, high, body = arg
                for _ in range(low):
                    at = self.add(body, at, fold)
                if high is C.MAXREPEAT:
                    loop = self.state()
                    self.eps[at].append(loop)
                    self.eps[self.add(body, loop, fold)].append(loop)
                    at = loop
                else:
                    end = self.state()
                    for _ in range(high - low):
                        self.eps[at].append(end)
                        at = self.add(body, at, fold)
                    self.eps[at].append(end)
                    at = end
            else:
                raise ValueError(f"{op} has no place in an automaton")
        return at


def _bytes(op, arg, fold: bool) -> frozenset:
    if op is C.ANY:
        return frozenset(range(256)) - {10}
    own: set[int] = set()
    for kind, x in [(op, arg)] if op is not C.IN else arg:
        if kind in (C.LITERAL, C.NOT_LITERAL):
            own.add(x)
        elif kind is C.RANGE:
            own.update(range(x[0], x[1] + 1))
        elif kind is not C.NEGATE:
            raise ValueError(f"{kind} has no place in a byte class")
    if fold:
        own |= {b ^ 32 for b in own if chr(b).isascii() and chr(b).isalpha()}
    negate = op is C.NOT_LITERAL or (op is C.IN and arg[0][0] is C.NEGATE)
    return frozenset(range(256)) - own if negate else frozenset(own)


def _combined(rules: list[bytes], **how) -> tuple[np.ndarray, np.ndarray]:
    """Transitions of one minimal automaton for all rules, and the bits of the rules that each state accepts; state 0 is the start."""
    table, mask = np.zeros((1, 256), np.int64), np.zeros(1, np.int64)
    for k, rule in enumerate(rules):
        own, accept = _minimal(*_subsets(rule, **how))
        table, mask = _minimal(*_union((table, mask), (own, accept.astype(np.int64) << k)))
    return table, mask


class Automaton:
    """Searches rules (byte regexes) in one pass.

    next[state * 256 + byte] is the following state; state 0 is the start. A state from `first_hit` on says that rules
    match up to here: those in the bits of mask[state]. A reset byte leads every state to the start, so no match
    holds one, and a text can be cut there and its parts scanned side by side.
    """

    def __init__(self, rules: list[bytes]):
        table, mask = _combined(rules, search=True)
        order = np.argsort(mask != 0, kind="stable")
        place = np.empty(len(table), np.int64)
        place[order] = np.arange(len(table))
        table, self.mask = place[table[order]], mask[order]
        self.first_hit = int((mask == 0).sum())
        self.reset = (table == 0).all(0)
        self.next = table.astype(np.int32).ravel()

    def hits(self, data: bytes, lanes: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """Places, ascending, of the bytes that a match of some rule ends with, and the bits of those rules."""
        b = np.frombuffer(data, np.uint8)
        cuts = np.flatnonzero(self.reset[b])
        none = np.zeros(0, np.int64)
        if not len(b):
            return none, none
        starts = np.linspace(0, len(b), lanes, endpoint=False).astype(np.int64)
        starts = cuts[np.minimum(np.searchsorted(cuts, starts), len(cuts) - 1)] if len(cuts) else starts[:1]
        starts = np.unique(np.append(starts, 0))
        length = np.diff(np.append(starts, len(b)))
        order = np.argsort(-length, kind="stable")
        starts, length = starts[order], length[order]
        live = np.searchsorted(-length, -np.arange(length[0]), side="left")
        state, found, bits = np.zeros(len(starts), np.int32), [none], [none]
        for t in range(int(length[0])):
            m = live[t]
            state = self.next[state[:m] * 256 + b[starts[:m] + t]]
            if (now := state >= self.first_hit).any():
                found.append(starts[:m][now] + t)
                bits.append(self.mask[state[now]])
        place = np.concatenate(found)
        order = np.argsort(place)
        return place[order], np.concatenate(bits)[order]


class Backward:
    """Where matches that end at a known byte begin: one automaton of all rules' reversed strings."""

    def __init__(self, rules: list[bytes]):
        table, mask = _combined(rules, back=True)
        rows = np.arange(len(table))[:, None]
        dead = np.flatnonzero((table == rows).all(1) & (mask == 0))
        self.next = np.where(np.isin(table, dead), -1, table).tolist()
        self.mask = mask.tolist()

    def start(self, data: bytes, last: int, rule: int, floor: int) -> int:
        """The first place, from floor on, from which the rule matches up to and with the byte at last; -1 for none."""
        state, best = 0, -1
        for k in range(last, floor - 1, -1):
            state = self.next[state][data[k]]
            if state < 0:
                break
            if self.mask[state] >> rule & 1:
                best = k
        return best


def _union(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of states that can be reached together, with the bits of both."""
    (t1, m1), (t2, m2) = one, two
    n = len(t2)
    ids, todo, rows = {0: 0}, [0], []
    while len(rows) < len(todo):
        now = todo[len(rows)]
        row = []
        for k in (t1[now // n] * n + t2[now % n]).tolist():
            if k not in ids:
                ids[k] = len(ids)
                todo.append(k)
            row.append(ids[k])
        rows.append(row)
    todo = np.array(todo)
    return np.array(rows), m1[todo // n] | m2[todo % n]


def _subsets(rule: bytes, search: bool = False, back: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Subset construction: transitions and acceptance; with search, a match may start anywhere; with back, of reversed strings."""
    nfa = _Nfa(back)
    tree = _parser.parse(rule)
    start = nfa.state()
    end = nfa.add(tree, start, bool(tree.state.flags & 2))
    close: list[frozenset] = []
    for s in range(len(nfa.eps)):
        seen, todo = {s}, [s]
        while todo:
            for n in nfa.eps[todo.pop()]:
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        close.append(frozenset(seen))
    kinds: dict[tuple, list[int]] = {}
    sets = [own for arcs in nfa.arcs for own, _ in arcs]
    for b in range(256):
        kinds.setdefault(tuple(b in s for s in sets), []).append(b)
    classes = list(kinds.values())
    arcs = [[(to, [k for k, c in enumerate(classes) if c[0] in own]) for own, to in a] for a in nfa.arcs]
    first = close[start]
    ids, todo, rows = {first: 0}, [first], []
    while len(rows) < len(todo):
        step = [set(first) if search else set() for _ in classes]
        for s in todo[len(rows)]:
            for to, own in arcs[s]:
                for k in own:
                    step[k] |= close[to]
        row = []
        for x in map(frozenset, step):
            if x not in ids:
                ids[x] = len(ids)
                todo.append(x)
            row.append(ids[x])
        rows.append(row)
    table = np.zeros((len(rows), 256), np.int64)
    for k, c in enumerate(classes):
        table[:, c] = np.array(rows)[:, [k]]
    return table, np.array([end in s for s in todo])


def _minimal(table: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Refine classes of states of one kind until all of a class lead to the same classes; class 0 is the start's."""
    block = np.unique(kind, return_inverse=True)[1].ravel()
    while True:
        _, first, new = np.unique(np.column_stack([block, block[table]]), axis=0, return_index=True, return_inverse=True)
        new = new.ravel()
        if len(first) == block.max() + 1:
            break
        block = new
    swap = np.arange(len(first))
    swap[[0, new[0]]] = swap[[new[0], 0]]
    new = swap[new]
    at = np.array([np.flatnonzero(new == k)[0] for k in range(len(first))])
    return new[table[at]], kind[at]
