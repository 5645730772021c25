"""Cover trees over the rows of a matrix, and dual traversals of two of them.

Levels are nested and their radii halve: a node's points are covered by children whose centres are points of the node, its own
centre first, each within half the radius of the level above. A node keeps its real covering radius, the largest
distance from its centre to a point below it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

LEAF = 24
#: Room for rounding in comparisons of distances between points of lengths up to 1.
EPS = 1e-6
#: Scores are held as longs; one that doesn't fit is the nearest of these.
HIGHEST = (1 << 63) - 1
LOWEST = -HIGHEST
NOBODY = np.iinfo(np.int64).max
CHUNK = 256


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * (a @ b.T), 0))


def net(x: np.ndarray, points: np.ndarray, radius: float) -> Iterator[tuple[int, np.ndarray]]:
    """Greedy cover: (centre, its points). Each point belongs to the first centre within the radius; points[0] is the first centre."""
    rest = points
    while len(rest):
        head = rest[:CHUNK]
        near = distances(x[head], x[head]) <= radius
        np.fill_diagonal(near, True)
        free, centers = np.ones(len(head), dtype=bool), []
        for i in range(len(head)):
            if free[i]:
                centers.append(i)
                free &= ~near[i]
        own = near[centers].argmax(axis=0)  # the first centre that covers it
        groups = [head[own == k] for k in range(len(centers))]
        tail = rest[CHUNK:]
        if len(tail):
            close = distances(x[head[centers]], x[tail]) <= radius
            covered, first = close.any(axis=0), close.argmax(axis=0)
            hit = np.nonzero(covered)[0]
            order = hit[np.argsort(first[hit], kind="stable")]
            bounds = np.searchsorted(first[order], np.arange(len(centers) + 1))
            groups = [np.concatenate([g, tail[order[a:b]]]) for g, a, b in zip(groups, bounds[:-1], bounds[1:], strict=True)]
            rest = tail[~covered]
        else:
            rest = tail
        for i, g in zip(centers, groups, strict=True):
            # the centre leads, so that it is the first centre of the level below too
            yield int(head[i]), np.concatenate([head[i : i + 1], g[g != head[i]]])


class Tree:
    """Nodes as arrays. Node 0 is the root; a node's children are first..first+count-1; the points below it are order[lo:hi]."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF, fill: float = 0.0):
        """leaf: points that a leaf may hold. fill: a node stays a leaf too if its children would have fewer points on average."""
        self.x = x
        center, radius, first, count, lo, hi = [0], [0.0], [0], [0], [0], [len(x)]
        self.order = np.arange(len(x))
        if len(x):
            radius[0] = float(distances(x[:1], x).max()) + EPS
        k, level = 0, {0: radius[0] / 2}
        while k < len(center):
            n, r = hi[k] - lo[k], level.pop(k, 0.0)
            # down to the first level that tells points of the node apart
            while r and r >= radius[k]:
                r /= 2
            if n > leaf and radius[k] > 3 * EPS and r > 0:
                made = list(net(x, self.order[lo[k] : hi[k]].copy(), r))
                if n < fill * len(made):
                    k += 1
                    continue
                first[k], at = len(center), lo[k]
                for c, below in made:
                    self.order[at : at + len(below)] = below
                    level[len(center)] = r / 2
                    center.append(c)
                    radius.append(float(distances(x[c : c + 1], x[below]).max()) + EPS if len(below) > 1 else 0.0)
                    lo.append(at)
                    at += len(below)
                    hi.append(at)
                    first.append(0)
                    count.append(0)
                count[k] = len(center) - first[k]
            k += 1
        self.center, self.first, self.count, self.lo, self.hi = (np.array(v, dtype=np.int64) for v in (center, first, count, lo, hi))
        self.radius = np.array(radius)

    def points(self, node: int) -> np.ndarray:
        return self.order[self.lo[node] : self.hi[node]]

    def below(self, nodes: np.ndarray) -> np.ndarray:
        """The children of the nodes; a leaf stands for itself."""
        n = np.maximum(self.count[nodes], 1)
        start = np.where(self.count[nodes] > 0, self.first[nodes], nodes)
        return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())

    def gathered(self, nodes: np.ndarray) -> np.ndarray:
        n = self.hi[nodes] - self.lo[nodes]
        return self.order[np.repeat(self.lo[nodes] - np.cumsum(n) + n, n) + np.arange(n.sum())]


def close_leaves(a: Tree, b: Tree, limit: float, step: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The point arrays of every pair of leaves that may hold points at most `limit` apart.

    With a is b each unordered pair of leaves comes once; a leaf with itself comes as the same array twice.
    """
    todo = [(0, 0)] if len(a.x) and len(b.x) else []
    while todo:
        p, q = todo.pop()
        if not a.count[p] and not b.count[q]:
            mine = a.points(p)
            yield mine, mine if a is b and p == q else b.points(q)
            continue
        ps, qs = a.below(np.array([p])), b.below(np.array([q]))
        for s in range(0, len(ps), step):
            part = ps[s : s + step]
            near = distances(a.x[a.center[part]], b.x[b.center[qs]]) <= limit + a.radius[part][:, None] + b.radius[qs][None] + EPS
            if a is b and p == q:
                near &= part[:, None] <= qs[None]
            i, j = np.nonzero(near)
            todo += zip(part[i].tolist(), qs[j].tolist(), strict=True)


class Best:
    """The k highest scores of each of n queries, ties to the smaller id; NOBODY where there are fewer."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), LOWEST)
        self.id = np.full((n, k), NOBODY)

    def worst(self, rows: np.ndarray) -> int:
        return self.score[rows, -1].min()

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        useful = (scores >= self.score[rows, -1][:, None]).any(axis=0)
        if not useful.any():
            return
        both = np.concatenate([self.score[rows], scores[:, useful]], axis=1)
        who = np.concatenate([self.id[rows], np.broadcast_to(ids, scores.shape)[:, useful]], axis=1)
        if both.shape[1] > 4 * self.k:
            # What is below the kth score goes before the sort; ties with it stay.
            kth = np.partition(both, both.shape[1] - self.k, axis=1)[:, both.shape[1] - self.k]
            width = int((both >= kth[:, None]).sum(axis=1).max())
            top = np.argpartition(-both, width - 1, axis=1)[:, :width]
            both, who = np.take_along_axis(both, top, axis=1), np.take_along_axis(who, top, axis=1)
        order = np.lexsort((who, -both), axis=1)[:, : self.k]
        self.score[rows] = np.take_along_axis(both, order, axis=1)
        self.id[rows] = np.take_along_axis(who, order, axis=1)


class Products:
    """Exact inner products of rows floor(scale * a) and floor(scale * b), clipped to longs.

    Lengths tell how far numbers grow on the way: double precision is exact below 2**53, longs are below 2**63; beyond that Python's integers
    count, pair by pair.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, scale: int):
        self.raw, self.scale = (a, b), scale
        with np.errstate(over="ignore"):
            self.whole = tuple(np.floor(x * scale) for x in (a, b))
            self.norm = tuple(np.sqrt((x * x).sum(axis=1)) for x in self.whole)

    def _integers(self, side: int, rows: np.ndarray) -> np.ndarray:
        out = np.empty((len(rows), self.raw[side].shape[1]), dtype=object)
        for r, i in enumerate(rows.tolist()):
            # Doubles from 2**53 on are whole numbers.
            out[r] = [int(x) * self.scale if abs(x) > 2**53 else int(np.floor(x * self.scale)) for x in self.raw[side][i].tolist()]
        return out

    def of(self, rows: np.ndarray, points: np.ndarray) -> np.ndarray:
        out = np.empty((len(rows), len(points)), dtype=np.int64)
        for long in (False, True):
            r = np.nonzero((self.norm[0][rows] >= 1 << 26) == long)[0]
            if not len(r):
                continue
            size = np.maximum(self.norm[0][rows[r]].max(), 1.0) * np.maximum(self.norm[1][points], 1.0)
            tier = np.where(size < 2.0**52, 0, np.where(size < 2.0**62, 1, 2))
            for t in np.unique(tier).tolist():
                p = np.nonzero(tier == t)[0]
                a, b = rows[r], points[p]
                if t == 0:
                    got = np.rint(self.whole[0][a] @ self.whole[1][b].T).astype(np.int64)
                elif t == 1:
                    got = self.whole[0][a].astype(np.int64) @ self.whole[1][b].astype(np.int64).T
                else:
                    got = np.clip(self._integers(0, a) @ self._integers(1, b).T, LOWEST, HIGHEST).astype(np.int64)
                out[np.ix_(r, p)] = got
        return out


#: Longer rows take no part in the trees: squares of lengths have to be finite. They are compared one by one.
ENDLESS = 2.0**400


def search(a: np.ndarray, own: np.ndarray, b: np.ndarray, ids: np.ndarray, best: Best, scale: int = 1, step: int = 1024) -> None:
    """Updates `best` with the rows of b of the highest inner products for each row of a, the row's own id excepted.

    For a query node of centre c and radius r and a data node of centre e and radius s no inner product exceeds
    c.e + r|e| + s|c| + rs; the pair is pruned if that is below the worst kth score of the node's queries. Bounds are those of the rows
    over the longest one's length, with room for rounding; scores are exact.
    """
    if not len(a) or not len(b):
        return
    exact = Products(a, b, scale)
    tame = tuple(n < ENDLESS for n in exact.norm)

    def compare(rows: np.ndarray, points: np.ndarray) -> None:
        for s in range(0, len(points), step):
            p = points[s : s + step]
            scores = exact.of(rows, p)
            mine = own[rows][:, None] == ids[p][None]
            scores[mine] = LOWEST
            best.add(rows, scores, np.where(mine, NOBODY, ids[p][None]))

    every = np.arange(len(b))
    for s in np.nonzero(~tame[0])[0].tolist():
        compare(np.array([s]), every)
    for s in range(0, len(a), step):
        rows = np.arange(s, min(s + step, len(a)))
        rows = rows[tame[0][rows]]
        if len(rows) and not tame[1].all():
            compare(rows, np.nonzero(~tame[1])[0])
    which = tuple(np.nonzero(t)[0] for t in tame)
    if not len(which[0]) or not len(which[1]):
        return
    unit = max(1.0, float(exact.norm[0][which[0]].max()), float(exact.norm[1][which[1]].max()))
    queries = Tree(exact.whole[0][which[0]] / unit, leaf=64, fill=4)
    data = Tree(exact.whole[1][which[1]] / unit)
    norm = np.sqrt((data.x * data.x).sum(axis=1))

    def alive(group: int, rows: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        c, r = queries.x[queries.center[group]], queries.radius[group]
        at = data.center[nodes]
        bound = data.x[at] @ c + r * norm[at] + data.radius[nodes] * (np.sqrt(c @ c) + r)
        order = np.argsort(-bound, kind="stable")
        worst = best.worst(which[0][rows])
        # LOWEST stands for fewer than k, and for all scores that are lower.
        return nodes[order[bound[order] + EPS >= (float(worst) / unit / unit if worst > LOWEST else -np.inf)]]

    todo = [(0, np.array([0]))]
    while todo:
        group, nodes = todo.pop()
        rows = queries.points(group)
        nodes = alive(group, rows, nodes)
        if queries.count[group]:
            # Data nodes go down one level with the query node: both trees are walked together.
            nodes = data.below(nodes)
            todo += [(g, nodes) for g in range(queries.first[group], queries.first[group] + queries.count[group])]
            continue
        while len(nodes) and data.count[nodes].any():
            nodes = alive(group, rows, data.below(nodes))
        while len(nodes):
            taken = int(np.searchsorted(np.cumsum(data.hi[nodes] - data.lo[nodes]), step)) + 1
            compare(which[0][rows], which[1][data.gathered(nodes[:taken])])
            nodes = nodes[taken:]
            nodes = alive(group, rows, nodes) if len(nodes) else nodes
