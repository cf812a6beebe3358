"""Cover trees over unit vectors, and the traversal of two trees at once.

A node covers a set of vectors around its centre.  Its children are a greedy net of the set at
half the node's radius, the centre being the first of them, so radii at least halve with each
level.  Two nodes whose centres lie further apart than their radii and the threshold together
hold no close pair and are dropped; what is left at single vectors is compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

#: More than rounding can add to a distance of unit vectors.
SLACK = 1e-7
#: Candidates for centres whose distances are taken at once.
_AT_ONCE = 64


@dataclass
class Node:
    centre: int
    radius: float
    members: np.ndarray
    children: list[Node] = field(default_factory=list)
    _centres: np.ndarray | None = None

    def centres(self) -> np.ndarray:
        if self._centres is None:
            self._centres = np.array([c.centre for c in self.children], np.int64)
            self._radii = np.array([c.radius for c in self.children])
        return self._centres

    def radii(self) -> np.ndarray:
        self.centres()
        return self._radii


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def build(units: np.ndarray) -> Node:
    """The tree over the rows of a matrix of unit vectors."""

    def node(centre: int, members: np.ndarray) -> Node:
        away = _distances(units[members], units[centre])
        made = Node(centre, float(away.max()) if len(members) > 1 else 0.0, members)
        if len(members) == 1:
            return made
        if made.radius <= SLACK:
            made.children = [Node(int(m), 0.0, np.array([m])) for m in members]
            return made
        left = np.r_[centre, members[members != centre]]
        while len(left):
            near = _distances(units[left[:_AT_ONCE]], units[left]) <= made.radius / 2
            free = np.ones(len(left), bool)
            for i in range(len(near)):
                if free[i]:
                    mine = near[i] & free
                    mine[i] = True
                    free &= ~mine
                    first, held = int(left[i]), left[mine]
                    made.children.append(node(first, held) if len(held) > 1 else Node(first, 0.0, held))
            left = left[free]
        return made

    return node(0, np.arange(len(units)))


def close_pairs(a: Node, b: Node, x: np.ndarray, y: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the pairs of two trees with a cosine of at least ``threshold``."""
    reach = float(np.sqrt(max(2 - 2 * threshold, 0))) + SLACK
    open_pairs = [(a, b)]
    while open_pairs:
        p, q = open_pairs.pop()
        ps = p.children if p.children and (p.radius >= q.radius or not q.children) else [p]
        qs = q.children if q.children and (q.radius >= p.radius or not p.children) else [q]
        pc = p.centres() if ps is p.children else np.array([p.centre])
        qc = q.centres() if qs is q.children else np.array([q.centre])
        pr = p.radii() if ps is p.children else np.array([p.radius])
        qr = q.radii() if qs is q.children else np.array([q.radius])
        cosines = x[pc] @ y[qc].T
        near = np.sqrt(np.maximum(2 - 2 * cosines, 0)) <= pr[:, None] + qr[None, :] + reach
        single_p = np.array([not n.children for n in ps])
        single_q = np.array([not n.children for n in qs])
        single = single_p[:, None] & single_q[None, :]
        i, j = np.nonzero(near & single & (cosines >= threshold))
        if len(i):
            yield pc[i], qc[j]
        open_pairs.extend((ps[m], qs[n]) for m, n in zip(*np.nonzero(near & ~single), strict=True))
