"""Depth-first search of one conditional database.

Every class of prefixes is searched on its own, in the memory of a task: its size was
checked before. The search starts from the best itemsets known so far and raises its own
threshold by what it finds. An item that can be in no result of a node's subtree is
dropped from the rows of all nodes below.
"""

from __future__ import annotations

import heapq

import numpy as np

from quarry.functions.columns import EPSILON, LOG_FLOOR
from quarry.operators.packed import Rows, growth, later, parted


def reaches(value, threshold: float):
    """Whether a bound admits ``threshold``, with room for the rounding of long sums."""
    return value >= threshold - EPSILON - 1e-9 * abs(threshold)


class Search:
    """The itemsets of one class that may be among the best ``k``, and counts of each size."""

    def __init__(self, prefix: tuple[int, ...], best: list[float], k: int, min_prob: float, path: bool, max_size: int, known: bool):
        self.prefix, self.k, self.min_prob, self.path, self.max_size, self.known = prefix, k, min_prob, path, max_size, known
        self.heap = sorted(best)[-k:]
        self.found: list[tuple[tuple[int, ...], float, float, int]] = []
        self.levels: dict[int, list[int]] = {}

    @property
    def threshold(self) -> float:
        return self.heap[0] if len(self.heap) == self.k else 0.0

    def run(self, rows: Rows) -> None:
        sizes = np.bincount(rows.owner, minlength=len(rows.cls))
        starts = np.cumsum(sizes) - sizes
        self.node(self.prefix, rows.base_u, rows.base_lp, rows.owner, starts + sizes, rows.code, rows.u, rows.lp, self.known)

    def node(self, prefix, base_u, base_lp, owner, ends, code, u, lp, known: bool) -> None:
        """The extensions of ``prefix`` by each code of its rows; ``known``: they were counted before."""
        if not len(code):
            return
        names, code = np.unique(code, return_inverse=True)
        m, size = len(names), len(prefix) + 1
        end, p = ends[owner], np.exp(lp)
        full = base_lp[owner] + lp
        kept = full > LOG_FLOOR
        chance = np.where(kept, np.exp(full), 0.0)
        whole = base_u[owner] + u
        rem, rem_p, p_max = later(owner, end, u, p)
        bound = np.bincount(code, growth(whole, chance, rem, rem_p, p_max), m)
        eu, slp, n = sum(np.bincount(code, x, m) for x in parted(whole * chance)), np.bincount(code, np.where(kept, full, 0.0), m), np.bincount(code[kept], minlength=m)
        # what any itemset of the subtree with this item may bring
        most = np.maximum(0, base_u + np.bincount(owner, np.maximum(u, 0), len(base_u)))
        alive = np.bincount(code, most[owner] * chance, m)
        ep = 1 - np.exp(slp)
        for x in np.flatnonzero((n > 0) & (eu >= 0) & (ep >= self.min_prob - EPSILON) & reaches(eu, self.threshold)):
            if not known:
                heapq.heappush(self.heap, float(eu[x]))
                if len(self.heap) > self.k:
                    heapq.heappop(self.heap)
                self.found.append(((*prefix, int(names[x])), float(eu[x]), float(ep[x]), int(n[x])))
        go = (n > 0) & reaches(bound, self.threshold)
        if self.path:
            go &= ep >= self.min_prob - EPSILON
        if not known:
            level = self.levels.setdefault(size, [0, 0, 0, 0])
            for k, x in enumerate(((n > 0).sum(), go.sum(), len(code), (~kept).sum())):
                level[k] += int(x)
        if size >= self.max_size:
            return
        order = np.argsort(code, kind="stable")
        slices = np.searchsorted(code[order], np.arange(m + 1))
        for x in np.argsort(-bound, kind="stable"):
            if not go[x] or not reaches(bound[x], self.threshold):
                continue
            own = order[slices[x] : slices[x + 1]]
            own = own[kept[own] & (own + 1 < end[own])]
            if not len(own):
                continue
            sizes = end[own] - own - 1
            flat = np.repeat(own + 1 - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
            child = np.repeat(np.arange(len(own)), sizes)
            stays = reaches(alive, self.threshold)[code[flat]]
            flat, child = flat[stays], child[stays]
            self.node((*prefix, int(names[x])), whole[own], full[own], child, np.cumsum(np.bincount(child, minlength=len(own))), names[code[flat]], u[flat], lp[flat], False)

    def results(self) -> list[tuple[tuple[int, ...], float, float, int]]:
        return sorted((x for x in self.found if reaches(x[1], self.threshold)), key=lambda x: (-x[1], -x[2]))
