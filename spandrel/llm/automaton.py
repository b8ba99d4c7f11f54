"""Regular right-hand sides of grammar rules: patterns over token characters as automata, and least edits to match them.

A pattern may use characters, classes, groups, alternatives, repetition and a look at the one next character. It becomes
a nondeterministic automaton and that, state by state as texts need them, a deterministic one: a text is matched in one
pass, in time linear in its length, whatever the pattern. There is no backtracking.
"""

from __future__ import annotations

from heapq import heappop, heappush

#: Every character a token can become, in a fixed order; END stands for the end of the text in a look-ahead.
ALPHABET = frozenset(map(chr, range(33, 127))) | {"\n"}
END = ""


class _Parser:
    """Pattern -> states with edges: (None, to) free, (set, to) reading, ("?", set, to) free before a character of a set."""

    def __init__(self, pattern: str, alphabet: frozenset[str]):
        self.p, self.at, self.alphabet = pattern, 0, alphabet
        self.free: list[list[int]] = []
        self.reads: list[list[tuple[frozenset, int]]] = []
        self.looks: list[list[tuple[frozenset, int]]] = []
        self.start, self.final = self.alternatives()
        if self.at != len(pattern):
            raise ValueError(f"unread pattern at {self.at}: {pattern[self.at : self.at + 20]!r}")

    def state(self) -> int:
        self.free.append([])
        self.reads.append([])
        self.looks.append([])
        return len(self.free) - 1

    def alternatives(self) -> tuple[int, int]:
        ends = [self.sequence()]
        while self.p[self.at : self.at + 1] == "|":
            self.at += 1
            ends.append(self.sequence())
        if len(ends) == 1:
            return ends[0]
        a, b = self.state(), self.state()
        for x, y in ends:
            self.free[a].append(x)
            self.free[y].append(b)
        return a, b

    def sequence(self) -> tuple[int, int]:
        a = b = self.state()
        while self.at < len(self.p) and self.p[self.at] not in "|)":
            x, y = self.repeated()
            self.free[b].append(x)
            b = y
        return a, b

    def repeated(self) -> tuple[int, int]:
        begin = self.at
        one = self.atom()
        end = self.at
        while self.at < len(self.p) and self.p[self.at] in "*+?{":
            sign = self.p[self.at]
            if sign == "{":
                close = self.p.index("}", self.at)
                lo, _, hi = self.p[self.at + 1 : close].partition(",")
                after = close + 1
                a = b = self.state()
                for k in range(int(hi or lo)):
                    self.at = begin
                    x, y = self.atom()
                    self.free[b].append(x)
                    if k >= int(lo):
                        self.free[b].append(y)
                    b = y
                self.at, one = after, (a, b)
                begin = end = after
                continue
            self.at += 1
            a, b = self.state(), self.state()
            x, y = one
            self.free[a].append(x)
            self.free[y].append(b)
            if sign in "*+":
                self.free[y].append(x)
            if sign in "*?":
                self.free[a].append(b)
            one = (a, b)
        return one

    def atom(self) -> tuple[int, int]:
        p = self.p
        if p.startswith(("(?=", "(?!"), self.at):
            negative = p[self.at + 2] == "!"
            self.at += 3
            inner: set[str] = set()
            while True:  # alternatives of one character each
                if p.startswith(r"\Z", self.at):
                    self.at += 2
                    inner.add(END)
                elif p.startswith("(?:", self.at):
                    self.at += 3
                    continue
                else:
                    inner |= self.one()
                while p[self.at] == ")" and p[self.at + 1 : self.at + 2] in ("|", ")") and p[self.at + 1 : self.at + 2]:
                    self.at += 1
                if p[self.at] == "|":
                    self.at += 1
                    continue
                break
            if p[self.at] != ")":
                raise ValueError("a look-ahead sees one character")
            self.at += 1
            a, b = self.state(), self.state()
            self.looks[a].append((frozenset((self.alphabet | {END}) - inner if negative else inner), b))
            return a, b
        if p.startswith("(?:", self.at):
            self.at += 3
            one = self.alternatives()
            if p[self.at : self.at + 1] != ")":
                raise ValueError("open group")
            self.at += 1
            return one
        a, b = self.state(), self.state()
        self.reads[a].append((frozenset(self.one()), b))
        return a, b

    def one(self) -> set[str]:
        """A character, class or dot at the current place."""
        p = self.p
        ch = p[self.at]
        self.at += 1
        if ch == ".":
            return set(self.alphabet - {"\n"})
        if ch == "\\":
            self.at += 1
            return {{"n": "\n"}.get(p[self.at - 1], p[self.at - 1])}
        if ch != "[":
            if ch in "(*+?{":
                raise ValueError(f"unexpected {ch!r} in {p[max(0, self.at - 20) : self.at + 5]!r}")
            return {ch}
        negative = p[self.at] == "^"
        self.at += negative
        out: list[str] = []
        first = True
        while first or p[self.at] != "]":
            first = False
            ch = p[self.at]
            self.at += 1
            if ch == "\\":
                ch = {"n": "\n"}.get(p[self.at], p[self.at])
                self.at += 1
            elif ch == "-" and out and p[self.at] != "]":
                hi = p[self.at]
                self.at += 1
                out += map(chr, range(ord(out[-1]) + 1, ord(hi) + 1))
                continue
            out.append(ch)
        self.at += 1
        return set(self.alphabet) - set(out) if negative else set(out)


class Automaton:
    """A pattern as a deterministic automaton whose states are made when a text first reaches them."""

    def __init__(self, pattern: str, alphabet: frozenset[str] = ALPHABET):
        self.pattern, self.alphabet = pattern, alphabet
        self.nfa = _Parser(pattern, alphabet)
        self.ids: dict[frozenset, int] = {}
        self.kernels: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        self.ends: list[bool | None] = []
        self.dead = self._id(frozenset())
        self.begin = self._id(frozenset([self.nfa.start]))
        self.reach: dict[int, list[tuple[int, str]]] = {}

    def _id(self, kernel: frozenset) -> int:
        k = self.ids.get(kernel)
        if k is None:
            k = self.ids[kernel] = len(self.kernels)
            self.kernels.append(kernel)
            self.next.append({})
            self.ends.append(None)
        return k

    def _closed(self, state: int, before: str) -> set[int]:
        n = self.nfa
        seen = set(self.kernels[state])
        todo = list(seen)
        while todo:
            s = todo.pop()
            for t in n.free[s]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
            for chars, t in n.looks[s]:
                if t not in seen and before in chars:
                    seen.add(t)
                    todo.append(t)
        return seen

    def step(self, state: int, ch: str) -> int:
        to = self.next[state].get(ch)
        if to is None:
            n = self.nfa
            kernel = frozenset(t for s in self._closed(state, ch) for chars, t in n.reads[s] if ch in chars)
            to = self.next[state][ch] = self._id(kernel)
        return to

    def ended(self, state: int) -> bool:
        e = self.ends[state]
        if e is None:
            e = self.ends[state] = self.nfa.final in self._closed(state, END)
        return e

    def accepts(self, text: str) -> bool:
        s, table = self.begin, self.next
        for ch in text:
            to = table[s].get(ch)
            if to is None:
                to = self.step(s, ch)
            if not to:  # the dead state is 0
                return False
            s = to
        return self.ended(s)

    def prefix(self, text: str) -> int:
        """Characters of the text after which the pattern can still go on: where the first error shows."""
        s = self.begin
        for k, ch in enumerate(text):
            s = self.step(s, ch)
            if s == self.dead:
                return k
        return len(text)

    def successors(self, state: int) -> list[tuple[int, str]]:
        """States one character away, each with the least such character; the dead state isn't one."""
        out = self.reach.get(state)
        if out is None:
            found: dict[int, str] = {}
            for ch in sorted(self.alphabet):
                to = self.step(state, ch)
                if to != self.dead:
                    found.setdefault(to, ch)
            out = self.reach[state] = list(found.items())
        return out
