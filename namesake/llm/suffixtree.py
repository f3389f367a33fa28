"""Suffix trees built online, with constant-time answers about common extensions.

``SuffixTree`` adds one symbol after the other (Ukkonen's method, with suffix
links and one end for all leaves). A tour of the finished tree gives the leaves
in order and, between two neighbours, the depth of the shallowest node the tour
meets; the lowest common ancestor of two leaves is the shallowest node between
them, which a table of minima over powers of two gives in constant time.
"""

from __future__ import annotations

import numpy as np

#: Stands behind every row of symbols and comes before all of them in any order.
END = -1


class SuffixTree:
    """The tree of a row of numbers that are 0 or more."""

    def __init__(self, symbols: list[int]) -> None:
        self.size = len(symbols)
        self.build([*symbols, END])
        leaves, gaps = self.tour()
        self.rank = np.empty(self.size + 1, np.int64)
        self.rank[leaves] = np.arange(self.size + 1)
        self.minima = [np.array(gaps, np.int32)]
        reach = 1
        while 2 * reach <= len(gaps):
            below = self.minima[-1]
            self.minima.append(np.minimum(below[:-reach], below[reach:]))
            reach *= 2

    def build(self, s: list[int]) -> None:
        n = len(s)
        start, end, link = [0], [0], [0]
        kids: list[dict[int, int] | None] = [{}]
        #: Of each leaf the start of its suffix, in the order in which leaves are made.
        suffix: dict[int, int] = {}
        node, edge, length, left = 0, 0, 0, 0
        for i, symbol in enumerate(s):
            left += 1
            waiting = 0
            while left:
                if not length:
                    edge = i
                k = kids[node].get(s[edge])
                if k is None:
                    kids[node][s[edge]] = len(start)
                    here = node
                else:
                    reach = (end[k] if kids[k] is not None else i + 1) - start[k]
                    if length >= reach:
                        edge += reach
                        length -= reach
                        node = k
                        continue
                    at = start[k] + length
                    if s[at] == symbol:
                        length += 1
                        if waiting:
                            link[waiting] = node
                        break
                    here = len(start)
                    kids[node][s[edge]] = here
                    start.append(start[k])
                    end.append(at)
                    link.append(0)
                    kids.append({s[at]: k, symbol: here + 1})
                    start[k] = at
                if waiting:
                    link[waiting] = here
                waiting = here if k is not None else 0
                suffix[len(start)] = i - left + 1
                start.append(i)
                end.append(n)
                link.append(0)
                kids.append(None)
                left -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - left + 1
        self.start, self.end, self.kids, self.suffix = start, end, kids, suffix

    def tour(self, falling: bool = False) -> tuple[list[int], list[int]]:
        """Suffixes in order, and for each the depth of the shallowest node since the one before.

        With ``falling`` symbols are ordered the other way; the end stays first.
        """
        start, end, kids, suffix = self.start, self.end, self.kids, self.suffix
        leaves, gaps, stack, low = [], [], [(0, 0)], -1
        while stack:
            v, depth = stack.pop()
            if low < 0:
                low = depth
            below = kids[v]
            if below is None:
                leaves.append(suffix[v])
                gaps.append(low)
                low = -1
                continue
            depth += end[v] - start[v]
            # The stack turns the order round.
            order = sorted(below, reverse=not falling)
            if falling and order[0] == END:
                order = [*order[1:], END]
            stack.extend([(below[c], depth) for c in order])
        return leaves, gaps

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How long the suffixes at ``a`` and ``b`` agree; the places of a pair differ."""
        x, y = self.rank[a], self.rank[b]
        low, high = np.minimum(x, y) + 1, np.maximum(x, y)
        level = np.frexp(high - low + 1)[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level):
            some = level == k
            table = self.minima[k]
            out[some] = np.minimum(table[low[some]], table[high[some] - (1 << int(k)) + 1])
        return out
