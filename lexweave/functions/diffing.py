"""Matching blocks and edit steps of two texts, by a suffix automaton of the second one.

The longest common block is taken first (of equal ones that which ends first in the first text, then in the second), then
the longest block left of it and right of it, until nothing is common. Characters that fill more than a hundredth of a
second text of 200 characters or more do not start or carry a block; they only lengthen one at its ends.
"""

from __future__ import annotations

from collections import Counter

# From which length on, and above which share, a character of the second text is frequent.
LONG_TEXT, FREQUENT_SHARE = 200, 100
# Up to this length a search in the text itself is faster than its automaton.
SHORT_TEXT = 1000


class SuffixAutomaton:
    """All substrings of a text; every state knows where its substrings end first."""

    __slots__ = ("steps", "link", "length", "first")

    def __init__(self, text: str, low: int, high: int, frequent: frozenset[str]):
        self.steps: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]
        last = 0
        for at in range(low, high):
            # No block runs over a frequent character: the next one begins anew.
            last = 0 if text[at] in frequent else self._extend(last, text[at], at)

    def _state(self, steps: dict, link: int, length: int, first: int) -> int:
        self.steps.append(steps)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.link) - 1

    def _extend(self, last: int, symbol, at: int) -> int:
        steps, link, length = self.steps, self.link, self.length
        if symbol in steps[last]:  # a stretch that was met before
            q = steps[last][symbol]
            return q if length[q] == length[last] + 1 else self._twin(last, symbol, q)
        new = self._state({}, 0, length[last] + 1, at)
        p = last
        while p >= 0 and symbol not in steps[p]:
            steps[p][symbol] = new
            p = link[p]
        if p < 0:
            return new
        q = steps[p][symbol]
        link[new] = q if length[q] == length[p] + 1 else self._twin(p, symbol, q)
        return new

    def _twin(self, p: int, symbol, q: int) -> int:
        """A state for the shorter substrings of q, those that p's lead to."""
        steps, link = self.steps, self.link
        twin = self._state(dict(steps[q]), link[q], self.length[p] + 1, self.first[q])
        while p >= 0 and steps[p].get(symbol) == q:
            steps[p][symbol] = twin
            p = link[p]
        link[q] = twin
        return twin

    def longest(self, text: str, low: int, high: int, frequent: frozenset[str]) -> tuple[int, int, int]:
        """(start in text, start in the automaton's text, size) of the longest block of text[low:high]; size 0 if none."""
        steps, link, length = self.steps, self.link, self.length
        state = size = 0
        best = (0, 0, 0)
        for i in range(low, high):
            symbol = text[i]
            if symbol in frequent:
                state = size = 0
                continue
            while state and symbol not in steps[state]:
                state = link[state]
                size = length[state]
            if symbol in steps[state]:
                state = steps[state][symbol]
                size += 1
                if size > best[2]:
                    best = (i - size + 1, self.first[state] - size + 1, size)
        return best


def longest_in_short(a: str, b: str, alo: int, ahi: int, blo: int, bhi: int, frequent: frozenset[str]) -> tuple[int, int, int]:
    """What `SuffixAutomaton.longest` gives, by search: a block counts only if it is longer than the best so far."""
    part = b[blo:bhi]
    best, i, end = (0, 0, 0), alo, alo
    while i < ahi:
        if end <= i:  # the stretch without frequent characters that begins here
            while i < ahi and a[i] in frequent:
                i += 1
            end = i
            while end < ahi and a[end] not in frequent:
                end += 1
        size = best[2]
        if i + size >= end:
            i = end
            continue
        while i + size < end and a[i:i + size + 1] in part:
            size += 1
        if size > best[2]:
            best = (i, blo + part.index(a[i:i + size]), size)
        i += 1
    return best


def frequent_characters(text: str) -> frozenset[str]:
    if len(text) < LONG_TEXT:
        return frozenset()
    most = len(text) // FREQUENT_SHARE + 1
    return frozenset(c for c, n in Counter(text).items() if n > most)


def matching_blocks(a: str, b: str) -> list[tuple[int, int, int]]:
    """(i, j, size) of the common blocks in order; touching ones are one block."""
    frequent = frequent_characters(b)
    found, open_ = [], [(0, len(a), 0, len(b))]
    while open_:
        alo, ahi, blo, bhi = open_.pop()
        if alo == ahi or blo == bhi:
            continue
        if bhi - blo <= SHORT_TEXT:
            i, j, size = longest_in_short(a, b, alo, ahi, blo, bhi, frequent)
        else:
            i, j, size = SuffixAutomaton(b, blo, bhi, frequent).longest(a, alo, ahi, frequent)
        if not size:
            i, j = alo, blo
        end_i, end_j = i + size, j + size
        while i > alo and j > blo and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
        while end_i < ahi and end_j < bhi and a[end_i] == b[end_j]:
            end_i, end_j = end_i + 1, end_j + 1
        if end_i > i:
            found.append((i, j, end_i - i))
            open_ += [(alo, i, blo, j), (end_i, ahi, end_j, bhi)]
    blocks: list[tuple[int, int, int]] = []
    for i, j, size in sorted(found):
        if blocks and blocks[-1][0] + blocks[-1][2] == i and blocks[-1][1] + blocks[-1][2] == j:
            blocks[-1] = (*blocks[-1][:2], blocks[-1][2] + size)
        else:
            blocks.append((i, j, size))
    return blocks


def opcodes(a: str, b: str) -> list[tuple[str, int, int, int, int]]:
    """(tag, i1, i2, j1, j2) that turn a into b: equal, replace, delete and insert, in order and without gaps."""
    out, i, j = [], 0, 0
    for bi, bj, size in [*matching_blocks(a, b), (len(a), len(b), 0)]:
        if i < bi or j < bj:
            out.append(("insert" if i == bi else "delete" if j == bj else "replace", i, bi, j, bj))
        if size:
            out.append(("equal", bi, bi + size, bj, bj + size))
        i, j = bi + size, bj + size
    return out
