"""Automata over a lexicon table: the best word path through unspaced text, and all occurrences of known forms.

A trie keeps all its steps in one table, keyed by node and character, so a lexicon of 100,000 entries is a few
plain tables that a worker builds once.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterable, Iterator

_SHIFT = 21  # bits of a code point


class Trie:
    """Entries by their characters; `value[node]` is the number of the entry that ends there, or -1."""

    def __init__(self, entries: Iterable[str]):
        self.steps: dict[int, int] = {}
        self.value = [-1]
        self.count = 0
        for number, entry in enumerate(entries):
            node = 0
            for c in entry:
                key = node << _SHIFT | ord(c)
                step = self.steps.get(key)
                if step is None:
                    step = self.steps[key] = len(self.value)
                    self.value.append(-1)
                node = step
            if node and self.value[node] < 0:
                self.value[node] = number
            self.count = number + 1


class Segmenter:
    """The most likely words of a run: weights over their total are the words' probabilities.

    A character that starts no word of the lexicon stands alone with weight 1. Of equal paths that with the longer next
    word is taken, from the left.
    """

    def __init__(self, words: list[str], weights: list[float]):
        kept = {w: float(n) for w, n in zip(words, weights) if w and n and n > 0}
        total = sum(kept.values()) or 1.0
        self.trie = Trie(kept)
        self.log = [math.log(n / total) for n in kept.values()]
        self.alone = math.log(1 / total)

    def words_at(self, text: str, at: int) -> Iterator[tuple[int, float]]:
        """(end, log probability) of every word of the lexicon that begins at `at`."""
        steps, value, node = self.trie.steps, self.trie.value, 0
        for end in range(at, len(text)):
            node = steps.get(node << _SHIFT | ord(text[end]))
            if node is None:
                return
            if value[node] >= 0:
                yield end + 1, self.log[value[node]]

    def cut(self, text: str) -> list[str]:
        n = len(text)
        best = [0.0] * (n + 1)
        step = [0] * n
        for at in range(n - 1, -1, -1):
            score, end = self.alone + best[at + 1], at + 1
            single = False
            for stop, log in self.words_at(text, at):
                here = log + best[stop]
                # The character's own entry, if there is one, takes the place of its default weight.
                if (stop == at + 1 and not single) or here >= score:
                    score, end = here, stop
                single = True
            best[at], step[at] = score, end
        out, at = [], 0
        while at < n:
            out.append(text[at:step[at]])
            at = step[at]
        return out


class Automaton:
    """Finds every entry of a lexicon in one pass over a text: goto and failure steps, and links to shorter entries."""

    def __init__(self, entries: list[str]):
        self.entries = entries
        self.trie = Trie(entries)
        n = len(self.trie.value)
        self.fail, self.shorter = [0] * n, [0] * n
        below: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for key, node in self.trie.steps.items():
            below[key >> _SHIFT].append((key & (1 << _SHIFT) - 1, node))
        queue = deque([0])
        steps, value = self.trie.steps, self.trie.value
        while queue:
            node = queue.popleft()
            for c, child in below[node]:
                if node:
                    back = self.fail[node]
                    while back and (back << _SHIFT | c) not in steps:
                        back = self.fail[back]
                    self.fail[child] = steps.get(back << _SHIFT | c, 0)
                back = self.fail[child]
                self.shorter[child] = back if value[back] >= 0 else self.shorter[back]
                queue.append(child)

    def matches(self, text: str) -> Iterator[tuple[int, int]]:
        """(entry number, start) of all occurrences, by their ends; overlapping ones of different entries too.

        Occurrences of one entry do not overlap: from the left, each begins at or after the end of the last one.
        """
        steps, value, fail, shorter = self.trie.steps, self.trie.value, self.fail, self.shorter
        free: dict[int, int] = {}
        node = 0
        for at, c in enumerate(map(ord, text)):
            step = steps.get(node << _SHIFT | c)
            while step is None and node:
                node = fail[node]
                step = steps.get(node << _SHIFT | c)
            node = step or 0
            hit = node if value[node] >= 0 else shorter[node]
            while hit:
                number = value[hit]
                start = at + 1 - len(self.entries[number])
                if start >= free.get(number, 0):
                    free[number] = at + 1
                    yield number, start
                hit = shorter[hit]
