"""Regular expressions over bytes as one deterministic automaton: subset construction, then minimisation.

Patterns know literals, ``\\xHH`` and escaped punctuation, ``[...]`` and ``[^...]`` with ranges, groups,
``|``, ``?``, ``*``, ``+`` and ``{n}``, ``{n,}``, ``{n,m}``. A negated class takes every other byte, so also
the bytes of characters beyond ASCII, one at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ALL = (1 << 256) - 1


class _Reader:
    """Pattern text to a tree of ``("set", bits)``, ``("cat", parts)``, ``("alt", parts)``, ``("rep", part, least, most)``."""

    def __init__(self, pattern: str, any_case: bool):
        self.text, self.at, self.any_case = pattern, 0, any_case

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        ch = self.text[self.at]
        self.at += 1
        return ch

    def whole(self):
        tree = self.choice()
        if self.at < len(self.text):
            raise ValueError(f"unexpected {self.peek()!r} at {self.at} of {self.text!r}")
        return tree

    def choice(self):
        parts = [self.sequence()]
        while self.peek() == "|":
            self.take()
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def sequence(self):
        parts = []
        while self.peek() and self.peek() not in "|)":
            parts.append(self.repeated(self.atom()))
        return ("cat", parts)

    def repeated(self, part):
        while self.peek() and self.peek() in "?*+{":
            sign = self.take()
            if sign == "{":
                end = self.text.index("}", self.at)
                low, comma, high = self.text[self.at : end].partition(",")
                self.at = end + 1
                part = ("rep", part, int(low), int(high) if high else None if comma else int(low))
            else:
                part = ("rep", part, int(sign == "+"), 1 if sign == "?" else None)
        return part

    def atom(self):
        ch = self.take()
        if ch == "(":
            inner = self.choice()
            if self.peek() != ")":
                raise ValueError(f"group without end in {self.text!r}")
            self.take()
            return inner
        if ch == "[":
            return ("set", self.members())
        return ("set", self.cased(1 << self.code(ch)))

    def code(self, ch: str) -> int:
        if ch == "\\":
            ch = self.take()
            if ch == "x":
                self.at += 2
                return int(self.text[self.at - 2 : self.at], 16)
            if ch.isalnum():
                raise ValueError(f"\\{ch} is not known")
        if ord(ch) > 127:
            raise ValueError("patterns are of ASCII characters")
        return ord(ch)

    def members(self) -> int:
        negated = self.peek() == "^"
        if negated:
            self.take()
        bits = 0
        while self.peek() != "]":
            low = high = self.code(self.take())
            if self.peek() == "-" and self.text[self.at + 1] != "]":
                self.take()
                high = self.code(self.take())
            bits |= ((1 << (high - low + 1)) - 1) << low
        self.take()
        bits = self.cased(bits)
        return ALL & ~bits if negated else bits

    def cased(self, bits: int) -> int:
        if self.any_case:
            for upper in range(65, 91):
                pair = 1 << upper | 1 << (upper + 32)
                if bits & pair:
                    bits |= pair
        return bits


def parse(pattern: str, any_case: bool = False):
    return _Reader(pattern, any_case).whole()


def backwards(tree):
    """The tree of all its strings read from their ends."""
    kind = tree[0]
    if kind == "cat":
        return ("cat", [backwards(p) for p in reversed(tree[1])])
    if kind == "alt":
        return ("alt", [backwards(p) for p in tree[1]])
    return ("rep", backwards(tree[1]), *tree[2:]) if kind == "rep" else tree


class _Steps:
    """Nondeterministic steps: ``free[s]`` without a byte, ``moves[s]`` pairs of a byte set and a state."""

    def __init__(self):
        self.free: list[list[int]] = []
        self.moves: list[list[tuple[int, int]]] = []

    def state(self) -> int:
        self.free.append([])
        self.moves.append([])
        return len(self.free) - 1

    def add(self, tree, start: int) -> int:
        """The state that strings of ``tree`` lead to from ``start``."""
        kind = tree[0]
        if kind == "set":
            end = self.state()
            self.moves[start].append((tree[1], end))
            return end
        if kind == "cat":
            for part in tree[1]:
                start = self.add(part, start)
            return start
        end = self.state()
        if kind == "alt":
            for part in tree[1]:
                begin = self.state()
                self.free[start].append(begin)
                self.free[self.add(part, begin)].append(end)
            return end
        _, part, least, most = tree
        for _ in range(least):
            start = self.add(part, start)
        if most is None:
            loop = self.state()
            self.free[start].append(loop)
            self.free[self.add(part, loop)].append(loop)
            self.free[loop].append(end)
            return end
        for _ in range(most - least):
            self.free[start].append(end)
            start = self.add(part, start)
        self.free[start].append(end)
        return end


@dataclass(frozen=True)
class Automaton:
    """``next[state, kind of byte]`` from state 0, and the bits of the patterns that ``state`` accepts; in
    ``dead`` states nothing can be accepted any more."""

    kinds: np.ndarray  # of the 256 bytes
    next: np.ndarray
    accepts: np.ndarray
    dead: np.ndarray

    def rows(self) -> list[list]:
        """States as lists to step through: the next state of each byte, at 256 what it accepts, at 257 whether dead."""
        rows: list[list] = [[] for _ in self.accepts]
        for row, to, bits, dead in zip(rows, self.next[:, self.kinds].tolist(), self.accepts.tolist(), self.dead.tolist()):
            row.extend([rows[t] for t in to])
            row.extend([bits, dead])
        return rows


def compile_patterns(trees: list, anywhere: bool = False) -> Automaton:
    """One minimal automaton of all trees, whose bit k says that tree k ends here; ``anywhere`` lets a string
    begin at every place."""
    steps = _Steps()
    begin = steps.state()
    ends = {}
    for k, tree in enumerate(trees):
        first = steps.state()
        steps.free[begin].append(first)
        ends[steps.add(tree, first)] = 1 << k
    kinds, representatives = _byte_kinds({bits for moves in steps.moves for bits, _ in moves})

    reach: dict[int, frozenset] = {}

    def closed(states) -> frozenset:
        out = set()
        for s in states:
            if s not in reach:
                seen, todo = {s}, [s]
                while todo:
                    for t in steps.free[todo.pop()]:
                        if t not in seen:
                            seen.add(t)
                            todo.append(t)
                reach[s] = frozenset(seen)
            out |= reach[s]
        return frozenset(s for s in out if steps.moves[s] or s in ends)

    start = closed([begin])
    number, order, table = {start: 0}, [start], []
    for subset in order:
        moves = [m for s in subset for m in steps.moves[s]]
        row = []
        for byte in representatives:
            target = closed([t for bits, t in moves if bits >> byte & 1])
            if anywhere:
                target |= start
            if target not in number:
                number[target] = len(order)
                order.append(target)
            row.append(number[target])
        table.append(row)
    accepts = np.array([sum({ends[s] for s in subset if s in ends}) for subset in order], np.int64)
    return _minimal(kinds, np.array(table, np.int32), accepts)


def _byte_kinds(sets: set[int]) -> tuple[np.ndarray, list[int]]:
    """Bytes that no set tells apart are of one kind: kind of each byte, and one byte of each kind."""
    kinds, known, representatives = np.zeros(256, np.int32), {}, []
    ordered = sorted(sets)
    for byte in range(256):
        key = tuple(bits >> byte & 1 for bits in ordered)
        if key not in known:
            known[key] = len(representatives)
            representatives.append(byte)
        kinds[byte] = known[key]
    return kinds, representatives


def _minimal(kinds: np.ndarray, table: np.ndarray, accepts: np.ndarray) -> Automaton:
    """States are split by what they accept, then by the classes they lead to, until nothing splits."""
    _, label = np.unique(accepts, return_inverse=True)
    count = 0
    while label.max() + 1 != count:
        count = label.max() + 1
        _, label = np.unique(np.column_stack([label, label[table]]), axis=0, return_inverse=True)
        label = label.reshape(-1)
    # the class of the start becomes state 0
    label = np.where(label == label[0], 0, np.where(label == 0, label[0], label))
    first = np.zeros(label.max() + 1, np.int64)
    first[label[::-1]] = np.arange(len(label))[::-1]
    small, bits = label[table[first]].astype(np.int32), accepts[first]
    alive = bits > 0
    while True:
        grown = alive | alive[small].any(axis=1)
        if (grown == alive).all():
            return Automaton(kinds, small, bits, ~alive)
        alive = grown
