"""Minimum cut of small graphs: which nodes stay with the source."""

from __future__ import annotations

from collections import deque


def source_side(net: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Nodes on the source side of a minimum cut.

    net[i] > 0 is a capacity source -> i, net[i] < 0 one of -net[i] from i -> sink; edges (i, j, c) have capacity c either way.
    Augments along shortest paths from nodes with excess to nodes with demand, level by level; a node is on the source
    side if excess still reaches it.
    """
    n = len(net)
    if min(net, default=0) >= 0 or max(net) <= 0:
        return [max(net, default=0) > 0] * n
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(n)]
    for i, j, c in edges:
        if c > 0 and i != j:
            out[i].append(len(to))
            out[j].append(len(to) + 1)
            to += (j, i)
            cap += (c, c)
    excess = [max(x, 0.0) for x in net]
    demand = [max(-x, 0.0) for x in net]
    tiny = 1e-9
    while True:
        level = [-1] * n
        queue = deque()
        for i in range(n):
            if excess[i] > tiny:
                level[i] = 0
                queue.append(i)
        reached = False
        while queue:
            i = queue.popleft()
            if demand[i] > tiny:
                reached = True
            for e in out[i]:
                j = to[e]
                if level[j] < 0 and cap[e] > tiny:
                    level[j] = level[i] + 1
                    queue.append(j)
        if not reached:
            return [x >= 0 for x in level]
        at = [0] * n
        for s in range(n):
            # Walks forward along the levels; dead ends are never entered again.
            while excess[s] > tiny:
                path, i = [], s
                while demand[i] <= tiny:
                    while at[i] < len(out[i]):
                        e = out[i][at[i]]
                        if cap[e] > tiny and level[to[e]] == level[i] + 1:
                            break
                        at[i] += 1
                    if at[i] < len(out[i]):
                        path.append(e)
                        i = to[e]
                    elif path:
                        i = to[path.pop() ^ 1]
                        at[i] += 1
                    else:
                        break
                if demand[i] <= tiny:
                    break
                flow = min([excess[s], demand[i], *(cap[e] for e in path)])
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                excess[s] -= flow
                demand[i] -= flow
