"""Rules of a small regular language, compiled together into one minimal deterministic automaton.

Syntax: ASCII literals, escapes, [classes] with ranges, groups, `|`, `?`, `*`, `+`, `{m}`, `{m,}` and `{m,n}`.
The automaton is unanchored: after each byte it tells which rules have a match that ends there. A rule's backward automaton tells where such a match begins.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np


class _Builder:
    """Thompson construction. Positions are numbers; moves are (set of bytes, target)."""

    def __init__(self):
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []  # moves that read nothing

    def node(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def add(self, pattern: str, ignore_case: bool) -> tuple[int, int]:
        self.p, self.i, self.ignore_case = pattern, 0, ignore_case
        begin, end = self._choice()
        if self.i != len(pattern):
            raise ValueError(f"unbalanced pattern: {pattern}")
        return begin, end

    def _peek(self) -> str:
        return self.p[self.i] if self.i < len(self.p) else ""

    def _choice(self) -> tuple[int, int]:
        begin, end = self.node(), self.node()
        while True:
            a, b = self._sequence()
            self.free[begin].append(a)
            self.free[b].append(end)
            if self._peek() != "|":
                return begin, end
            self.i += 1

    def _sequence(self) -> tuple[int, int]:
        begin = last = self.node()
        while self._peek() not in ("", "|", ")"):
            at = self.i
            unit = self._unit()
            least, most, after = self._times()
            for k in range(max(least, most or 0) + (most is None)):
                if k:
                    self.i = at  # read the unit again: each repetition has nodes of its own
                    unit = self._unit()
                    self.i = after
                a, b = unit
                self.free[last].append(a)
                if most is None and k >= least:  # the last copy may repeat
                    self.free[a].append(b)
                    self.free[b].append(a)
                elif k >= least:
                    self.free[a].append(b)
                last = b
            self.i = after
        return begin, last

    def _times(self) -> tuple[int, int | None, int]:
        c = self._peek()
        least, most = 1, 1
        if c and c in "?*+":
            least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            self.i += 1
        elif c == "{":
            close = self.p.index("}", self.i)
            low, comma, high = self.p[self.i + 1 : close].partition(",")
            least, most = int(low), (int(high) if high else None) if comma else int(low)
            self.i = close + 1
        return least, most, self.i

    def _unit(self) -> tuple[int, int]:
        c = self._peek()
        if c == "(":
            self.i += 1
            inner = self._choice()
            if self._peek() != ")":
                raise ValueError(f"unbalanced pattern: {self.p}")
            self.i += 1
            return inner
        if c == "[":
            chars = self._class()
        else:
            if c == "\\":
                self.i += 1
            chars = {ord(self._peek())}
            self.i += 1
        if self.ignore_case:
            chars = {x for c in chars for x in (ord(chr(c).lower()), ord(chr(c).upper()))}
        begin, end = self.node(), self.node()
        self.moves[begin].append((frozenset(chars), end))
        return begin, end

    def _class(self) -> set[int]:
        self.i += 1
        chars: set[int] = set()
        while self._peek() != "]":
            if self._peek() == "\\":
                self.i += 1
            low = high = ord(self._peek())
            self.i += 1
            if self._peek() == "-" and self.p[self.i + 1] != "]":
                high = ord(self.p[self.i + 1])
                self.i += 2
            chars.update(range(low, high + 1))
        self.i += 1
        return chars


@dataclass
class Automaton:
    """classes: the class of each byte; moves: states x classes; found: for each state a bit for each rule that ends there. The first state is 0."""

    classes: np.ndarray
    moves: np.ndarray
    found: np.ndarray

    @classmethod
    def compile(cls, rules: list[tuple[str, bool]]) -> Automaton:
        """rules: (pattern, whether letters stand for either case). Matches may begin anywhere."""
        nfa = _Builder()
        begins, ends = zip(*(nfa.add(*r) for r in rules)) if rules else ((), ())
        return cls(*_minimal(*_subsets(nfa.moves, nfa.free, begins, ends, True)))

    @classmethod
    def backward(cls, pattern: str, ignore_case: bool) -> Automaton:
        """One rule read from its end: it is found in the states that a whole match leads to."""
        nfa = _Builder()
        begin, end = nfa.add(pattern, ignore_case)
        moves: list[list[tuple[frozenset[int], int]]] = [[] for _ in nfa.moves]
        free: list[list[int]] = [[] for _ in nfa.moves]
        for source, own in enumerate(nfa.moves):
            for chars, target in own:
                moves[target].append((chars, source))
            for target in nfa.free[source]:
                free[target].append(source)
        return cls(*_minimal(*_subsets(moves, free, (end,), (begin,), False)))

    @cached_property
    def resets(self) -> np.ndarray:
        """For each byte: from any state it leads back to the first one."""
        return (self.moves == 0).all(0)[self.classes]

    @cached_property
    def _plain(self) -> tuple[list, list, list, int]:
        dead = np.flatnonzero((self.moves == np.arange(len(self.moves))[:, None]).all(1) & (self.found == 0))
        return self.moves.tolist(), self.classes.tolist(), self.found.tolist(), int(dead[0]) if len(dead) else -1

    def start_of(self, data: bytes, low: int, end: int) -> int | None:
        """Of a backward automaton: the first place from low on where a match that stops before `end` begins."""
        moves, classes, found, dead = self._plain
        state, start = 0, None
        for at in range(end - 1, low - 1, -1):
            state = moves[state][classes[data[at]]]
            if state == dead:
                break
            if found[state]:
                start = at
        return start

    def ends(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the places after which matches end, in order; the rules that end there) in the pieces data[begin:end]. One pass over the bytes, all pieces in step."""
        kinds = self.classes[data]
        width = self.moves.shape[1]
        jump = (self.moves * width).ravel()  # states are kept multiplied by the width
        tell = np.repeat(self.found, width)
        order = np.argsort(begin - end, kind="stable")
        at, size = begin[order], (end - begin)[order]
        state = np.zeros(len(at), np.int32)
        places, bits = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        alive, t = len(at), 0
        while alive > 48:
            while alive and size[alive - 1] <= t:
                alive -= 1
            if not alive:
                break
            now = jump[state[:alive] + kinds[at[:alive] + t]]
            state[:alive] = now
            told = tell[now]
            if told.any():
                hit = np.flatnonzero(told)
                places.append(at[hit] + t)
                bits.append(told[hit])
            t += 1
        if alive:  # few long pieces: stepping each alone costs less
            steps, told, where, what = jump.tolist(), tell.tolist(), [], []
            for k in range(alive):
                s, low = int(state[k]), int(at[k]) + t
                for place, c in enumerate(kinds[low : at[k] + size[k]].tobytes(), low):
                    s = steps[s + c]
                    if told[s]:
                        where.append(place)
                        what.append(told[s])
            places.append(np.array(where, np.int64))
            bits.append(np.array(what, np.uint64))
        place, bit = np.concatenate(places), np.concatenate(bits)
        by = np.argsort(place)
        return place[by], bit[by]

    def scan(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The rules found in each piece; begin is in order."""
        hits = np.zeros(len(begin), np.uint64)
        place, bit = self.ends(data, begin, end)
        np.bitwise_or.at(hits, np.searchsorted(begin, place, side="right") - 1, bit)
        return hits


def _subsets(moves: list, free: list, begins: tuple, ends: tuple, anywhere: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(classes, moves, found) by subset construction. anywhere: a match may begin after every byte."""
    sets = list(dict.fromkeys(chars for node in moves for chars, _ in node))
    marks = [tuple(b in s for s in sets) for b in range(256)]
    kinds = list(dict.fromkeys(marks))
    classes = np.array([kinds.index(m) for m in marks], np.uint8)
    reads = [[(target, k) for chars, target in node for k in range(len(kinds)) if kinds[k][sets.index(chars)]] for node in moves]
    reach: dict[int, frozenset[int]] = {}

    def closure(node: int) -> frozenset[int]:
        if node not in reach:
            seen, todo = {node}, [node]
            while todo:
                for x in free[todo.pop()]:
                    if x not in seen:
                        seen.add(x)
                        todo.append(x)
            reach[node] = frozenset(x for x in seen if reads[x] or x in ends)
        return reach[node]

    first = frozenset().union(*(closure(b) for b in begins))
    number, todo, rows = {first: 0}, [first], []
    while todo:
        state = todo.pop(0)
        row: list[set[int]] = [set(first) if anywhere else set() for _ in kinds]
        for node in state:
            for target, k in reads[node]:
                row[k] |= closure(target)
        rows.append([])
        for nodes in map(frozenset, row):
            if nodes not in number:
                number[nodes] = len(number)
                todo.append(nodes)
            rows[-1].append(number[nodes])
    found = np.array([sum(1 << r for r, e in enumerate(ends) if e in state) for state in number], np.uint64)
    return classes, np.array(rows, np.int32).reshape(len(number), len(kinds)), found


def _minimal(classes: np.ndarray, moves: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Split the states by what they find until their moves agree too; one of each kind stays, in the order of the first ones."""
    label = np.unique(found, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([label, label[moves]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == label.max():
            break
        label = finer
    order = np.full(label.max() + 1, -1)
    _, where = np.unique(label, return_index=True)
    for new, old in enumerate(sorted(range(len(where)), key=lambda k: where[k])):
        order[old] = new
    keep = np.sort(where)
    return classes, order[label[moves[keep]]].astype(np.int32), found[keep]
