"""A two-label minimum cut: terminal costs and smoothness edges, solved exactly."""

from __future__ import annotations

from collections import deque

EMPTY = 1e-9


def settle(odds: list[float], edges: list[dict[int, float]]) -> tuple[list[int | None], list[float]]:
    """Labels that every minimum cut can take, found without flow.

    A node whose own odds outweigh all its edges to open nodes takes its own label; its neighbours
    then feel it as a terminal cost. Returns the labels (None where still open) and the odds left.
    """
    label: list[int | None] = [None] * len(odds)
    odds, queue = list(odds), deque(range(len(odds)))
    while queue:
        u = queue.popleft()
        if label[u] is not None:
            continue
        pull = sum(c for v, c in edges[u].items() if label[v] is None)
        if odds[u] >= pull or -odds[u] > pull:
            label[u] = int(odds[u] >= pull)
            for v, c in edges[u].items():
                if label[v] is None:
                    odds[v] += c if label[u] else -c
                    queue.append(v)
    return label, odds


def _islands(rest: list[int], label: list[int | None], edges: list[dict[int, float]]) -> list[list[int]]:
    """The open nodes, by what edges between open nodes connect."""
    seen, out = set(), []
    for u in rest:
        if u not in seen:
            seen.add(u)
            island = [u]
            for x in island:  # grows while it is walked
                for v in edges[x]:
                    if label[v] is None and v not in seen:
                        seen.add(v)
                        island.append(v)
            out.append(island)
    return out


class Network:
    """A flow network of residual arcs; arc k and arc k ^ 1 are each other's reverse."""

    def __init__(self, n: int) -> None:
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[float] = []

    def add(self, u: int, v: int, there: float, back: float) -> None:
        self.out[u].append(len(self.to))
        self.out[v].append(len(self.to) + 1)
        self.to += [v, u]
        self.room += [there, back]

    def levels(self, source: int) -> list[int]:
        level, queue = [-1] * len(self.out), deque([source])
        level[source] = 0
        while queue:
            u = queue.popleft()
            for k in self.out[u]:
                if self.room[k] > EMPTY and level[self.to[k]] < 0:
                    level[self.to[k]] = level[u] + 1
                    queue.append(self.to[k])
        return level

    def max_flow(self, source: int, sink: int) -> list[int]:
        """Push the maximum flow by Dinic's blocking flows; returns the last levels, -1 on the sink's side."""
        while (level := self.levels(source))[sink] >= 0:
            tried, path, u = [0] * len(self.out), [], source
            while True:
                if u == sink:
                    flow = min(self.room[k] for k in path)
                    for k in path:
                        self.room[k] -= flow
                        self.room[k ^ 1] += flow
                    full = next(i for i, k in enumerate(path) if self.room[k] <= EMPTY)
                    u = self.to[path[full] ^ 1]  # go on from before the first full arc
                    del path[full:]
                elif tried[u] < len(self.out[u]):
                    k = self.out[u][tried[u]]
                    if self.room[k] > EMPTY and level[self.to[k]] == level[u] + 1:
                        path.append(k)
                        u = self.to[k]
                    else:
                        tried[u] += 1
                elif path:
                    k = path.pop()
                    u = self.to[k ^ 1]
                    tried[u] += 1
                else:
                    break
        return level


def min_cut(odds: list[float], edges: list[dict[int, float]]) -> list[int]:
    """Labels 0 or 1 that minimise the sum of |odds| of nodes labelled against their sign and of the
    capacities of edges between different labels. edges[u][v] == edges[v][u] are capacities."""
    label, odds = settle(odds, edges)
    for island in _islands([u for u in range(len(odds)) if label[u] is None], label, edges):
        at = {u: k for k, u in enumerate(island)}
        source, sink = len(at), len(at) + 1
        network = Network(len(at) + 2)
        for u, k in at.items():
            if odds[u] > 0:
                network.add(source, k, odds[u], 0.0)
            else:
                network.add(k, sink, -odds[u], 0.0)
            for v, c in edges[u].items():
                if v in at and u < v:
                    network.add(k, at[v], c, c)
        level = network.max_flow(source, sink)
        for u, k in at.items():
            label[u] = int(level[k] >= 0)
    return [int(x) for x in label]
