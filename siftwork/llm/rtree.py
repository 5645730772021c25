"""R-tree over count vectors: which pairs may overlap enough.

A point holds how many elements of a set fall into each of some hash groups. Two sets share at most the sum over the groups of the smaller
count; for a set and a node of the tree the node's largest counts take the place of the other set's.
"""

from __future__ import annotations

import numpy as np

#: Hash groups: about a quarter of the set's size, within these bounds; powers of two, so that finer counts fold into coarser ones.
LEAST_GROUPS, MOST_GROUPS = 64, 8192
FANOUT = 16


def groups_for(n: int) -> int:
    return min(MOST_GROUPS, max(LEAST_GROUPS, 1 << max(0, n // 4).bit_length()))


def count_vector(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes fall into each group, by their high bits; in bytes where they fit."""
    groups = groups_for(len(hashes))
    shift = np.uint64(64 - groups.bit_length() + 1)
    counts = np.bincount((hashes >> shift).astype(np.int64), minlength=groups)
    return counts.astype("u1" if counts.max() < 256 else "<u4")


def decoded(counts: bytes, n: int) -> np.ndarray:
    """The count vector of a set of n hashes from its bytes."""
    return np.frombuffer(counts, dtype="u1" if len(counts) == groups_for(n) else "<u4")


def fold(counts: np.ndarray, groups: int) -> np.ndarray:
    return counts if len(counts) == groups else counts.reshape(groups, -1).sum(axis=1, dtype=np.int64)


def enough(n: np.ndarray, m: np.ndarray, per_cent: int) -> np.ndarray:
    """Least intersection of sets of n and m elements with 100 * intersection >= per_cent * union."""
    # 100 i >= p (n + m - i)
    return -((-per_cent * (n + m)) // (100 + per_cent))


class RTree:
    """Packed by size, then by the heaviest groups; `counts` has a row for each set, `n` the sizes."""

    def __init__(self, counts: np.ndarray, n: np.ndarray):
        self.counts, self.n = counts.astype(np.int64), n.astype(np.int64)
        self.order = np.lexsort((*(self.counts[:, k] for k in range(min(4, self.counts.shape[1]))), self.n))
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # largest counts, least and largest size of each node
        high, lo, hi = self.counts[self.order], self.n[self.order], self.n[self.order]
        while True:
            cut = np.arange(0, len(lo), FANOUT)
            high, lo, hi = np.maximum.reduceat(high, cut), np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut)
            self.levels.append((high, lo, hi))
            if len(cut) <= 1:
                break

    def candidates(self, counts: np.ndarray, n: int, per_cent: int) -> np.ndarray:
        """Indices of the sets whose bound reaches what a set of these counts and size n needs."""
        nodes = np.arange(len(self.levels[-1][1]))
        for depth in range(len(self.levels) - 1, -1, -1):
            high, lo, hi = self.levels[depth]
            fits = (100 * hi[nodes] >= per_cent * n) & (100 * n >= per_cent * lo[nodes])
            nodes = nodes[fits]
            if not len(nodes):
                return nodes
            bound = np.minimum(high[nodes], counts).sum(axis=1)
            # sizes below n need less than the least size of the node asks for
            nodes = nodes[bound >= enough(np.int64(n), lo[nodes], per_cent)]
            below = len(self.levels[depth - 1][1]) if depth else len(self.order)
            nodes = (nodes[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            nodes = nodes[nodes < below]
        at = self.order[nodes]
        m = self.n[at]
        keep = (100 * m >= per_cent * n) & (100 * n >= per_cent * m)
        at, m = at[keep], m[keep]
        return at[np.minimum(self.counts[at], counts).sum(axis=1) >= enough(np.int64(n), m, per_cent)]


class Index:
    """Sets of any sizes: an R-tree for each number of groups, folded where a set with fewer groups asks."""

    def __init__(self, counts: list[np.ndarray], n: np.ndarray):
        self.counts, self.n = counts, n
        self.trees: dict[tuple[int, int], RTree] = {}
        size = np.array([len(c) for c in counts])
        self.classes = {int(g): np.nonzero(size == g)[0] for g in np.unique(size)}

    def candidates(self, counts: np.ndarray, n: int, per_cent: int) -> np.ndarray:
        """Indices of the sets whose bound reaches what a set of these counts and size n needs."""
        found = []
        for groups, members in self.classes.items():
            g = min(groups, len(counts))
            # Sizes are too far apart where the groups are.
            if 100 * self.n[members].max() < per_cent * n or 100 * n < per_cent * self.n[members].min():
                continue
            if (groups, g) not in self.trees:
                self.trees[groups, g] = RTree(np.array([fold(self.counts[i], g) for i in members.tolist()]), self.n[members])
            found.append(members[self.trees[groups, g].candidates(fold(counts, g), n, per_cent)])
        return np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
