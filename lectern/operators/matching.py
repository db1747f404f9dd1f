"""Matching-block ratio: how much of two texts lies in common blocks, longest first.

The longest common block of two texts splits both; what stands before it and
behind it is matched in turn. Of equally long blocks that which begins first in
the left text counts, then that which begins first in the right one. The ratio
is twice the characters in blocks over the characters of both.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


class Automaton:
    """The suffix automaton of a text: a state stands for all its blocks that end at the same places, and knows the first of these."""

    __slots__ = ("moves", "link", "size", "end")

    def __init__(self, text: str):
        self.moves: list[dict[str, int]] = [{}]
        self.link, self.size, self.end = [-1], [0], [-1]
        last = 0
        for at, char in enumerate(text):
            state = self._new({}, self.size[last] + 1, at)
            p = last
            while p >= 0 and char not in self.moves[p]:
                self.moves[p][char] = state
                p = self.link[p]
            if p < 0:
                self.link[state] = 0
            else:
                q = self.moves[p][char]
                if self.size[p] + 1 != self.size[q]:
                    # the shorter blocks of q end here too: they get a state of their own
                    twin = self._new(dict(self.moves[q]), self.size[p] + 1, self.end[q])
                    self.link[twin] = self.link[q]
                    self.link[q] = twin
                    while p >= 0 and self.moves[p].get(char) == q:
                        self.moves[p][char] = twin
                        p = self.link[p]
                    q = twin
                self.link[state] = q
            last = state

    def _new(self, moves: dict[str, int], size: int, end: int) -> int:
        self.moves.append(moves)
        self.link.append(-1)
        self.size.append(size)
        self.end.append(end)
        return len(self.size) - 1

    def longest(self, text: str) -> tuple[int, int, int]:
        """(start here, start in ``text``, length) of the longest common block; in one walk over the text."""
        state = held = best = at_left = at_right = 0
        for at, char in enumerate(text):
            while state and char not in self.moves[state]:
                state = self.link[state]
                held = self.size[state]
            if char in self.moves[state]:
                state, held = self.moves[state][char], held + 1
                start = self.end[state] - held + 1
                if held > best or held == best and start < at_left:
                    best, at_left, at_right = held, start, at - held + 1
        return at_left, at_right, best


def in_blocks(left: str, right: str, whole: Automaton | None = None) -> int:
    """Characters in common blocks; ``whole`` is the left text's automaton, if it is there already."""
    total, open_ = 0, [(left, right, whole)]
    while open_:
        a, b, automaton = open_.pop()
        if not a or not b:
            continue
        i, j, n = (automaton or Automaton(a)).longest(b)
        if n:
            total += n
            open_ += [(a[:i], b[:j], None), (a[i + n :], b[j + n :], None)]
    return total


def bound(left: Counter, right: Counter, size: int) -> float:
    """No ratio is above this: the characters that both texts have, whatever their order."""
    return 2.0 * (left & right).total() / size if size else 0.0


def block_ratio(pairs: DataFrame, left: str, right: str, name: str = "ratio", least: float = 0.0) -> DataFrame:
    """``pairs`` with the ratio of two text columns, 0 where one is null or empty.

    Pairs whose common characters alone are too few for ``least`` go before any block is looked for; so do pairs with a
    lower ratio. Rows with the same left text one after the other share its automaton. Repeated rows are scored each;
    a column ``name`` is replaced.
    """
    names = [c for c in pairs.columns if c != name]
    schema = T.StructType([*(pairs.schema[c] for c in names), T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, automaton, chars = None, None, Counter()
        for batch in batches:
            kept, ratios = [], []
            for row, (a, b) in enumerate(zip(batch[left].to_pylist(), batch[right].to_pylist())):
                a, b = a or "", b or ""
                if a != known:
                    known, automaton, chars = a, Automaton(a), Counter(a)
                size = len(a) + len(b)
                # a bound of doubles is the ratio's own quotient, so it never falls short of it
                if bound(chars, Counter(b), size) < least:
                    continue
                ratio = 2.0 * in_blocks(a, b, automaton) / size if a and b else 0.0
                if ratio >= least:
                    kept.append(row)
                    ratios.append(ratio)
            at = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch[c].take(at) for c in names), pa.array(ratios, pa.float64())], names=[*names, name])

    return pairs.select(*names).mapInArrow(run, schema)
