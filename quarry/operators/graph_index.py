"""Hierarchical navigable small-world graph over one block of vectors, in numpy.

Distances follow one contract, smaller is closer, and candidates are ordered by (distance, id).  Insertion order defines
the graph, so a graph is built by one task from one block; a larger collection has one graph a shard.
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

MAX_LEVEL, MAX_M = 32, 512


@dataclass(frozen=True)
class GraphParams:
    """Degree m above layer 0 and max_degree0 on it, beam of construction, seed of the levels, and the selection policy."""

    m: int = 16
    max_degree0: int = 0  # 0: twice m
    ef_construction: int = 200
    seed: int = 0
    heuristic: bool = True
    keep_pruned: bool = True

    def __post_init__(self):
        if not 1 <= self.m <= MAX_M:
            raise ValueError(f"m must be in 1..{MAX_M}, not {self.m}")
        if self.max_degree0 == 0:
            object.__setattr__(self, "max_degree0", 2 * self.m)
        if self.max_degree0 < self.m:
            raise ValueError(f"max_degree0 {self.max_degree0} is below m {self.m}")
        if self.ef_construction < 1:
            raise ValueError("ef_construction must be at least 1")

    def max_degree(self, layer: int) -> int:
        return self.max_degree0 if layer == 0 else self.m

    def level_of(self, key: int) -> int:
        """Geometric level of a key: P(level >= l) = m**-l.  A pure function, so replay and restart agree."""
        if self.m == 1:
            return 0
        digest = hashlib.md5(f"{self.seed}:{key}".encode()).hexdigest()[:13]
        u = (int(digest, 16) + 1) / 16**13
        return min(int(-math.log(u) / math.log(self.m)), MAX_LEVEL)


def select_neighbors(near: list[tuple[float, int]], m: int, between: Callable[[int, list[int]], np.ndarray], heuristic: bool = True, keep_pruned: bool = True) -> list[int]:
    """At most m of the candidates: each in order of distance, if no chosen one is strictly closer to it than the query.

    What this leaves out fills free places, nearest first, if keep_pruned.  Without the heuristic: the m nearest.
    ``between(c, chosen)`` gives the distances from candidate c to the chosen ones.
    """
    near = sorted(set(near))
    if not heuristic:
        return [c for _, c in near[:m]]
    chosen: list[int] = []
    pruned: list[int] = []
    for dist, c in near:
        if len(chosen) == m:
            break
        if chosen and bool((between(c, chosen) < dist).any()):
            pruned.append(c)
        else:
            chosen.append(c)
    return chosen + pruned[: m - len(chosen)] if keep_pruned else chosen


@dataclass
class Graph:
    """vectors: unit vectors for cosine.  metric: l2 (squared), cosine (1 - dot) or dot (-dot)."""

    vectors: np.ndarray
    params: GraphParams = field(default_factory=GraphParams)
    metric: str = "l2"
    levels: list[int] = field(default_factory=list)
    layers: list[dict[int, list[int]]] = field(default_factory=list)
    entry: int | None = None
    computed: int = 0
    _reached: dict[int, np.ndarray] = field(default_factory=dict, repr=False)  # see whole()

    @classmethod
    def from_parts(cls, vectors: np.ndarray, params: GraphParams, metric: str, levels: list[int], edges: list[tuple[int, int, int, int]], entry: int | None) -> Graph:
        """A graph from its tables: levels by node, edges (layer, source, position, target) in order of position.

        Raises on parts that don't belong together: a level for each vector, a known entry on the top layer, edges between
        nodes that stand on their layer, no more of them than the layer allows."""
        n = len(vectors)
        if len(levels) != n:
            raise ValueError(f"{len(levels)} levels for {n} vectors")
        if (entry is None) != (n == 0) or entry is not None and not 0 <= entry < n:
            raise ValueError(f"entry {entry} of {n} nodes")
        if n and levels[entry] != max(levels):
            raise ValueError(f"entry {entry} stands on layer {levels[entry]}, not on the top {max(levels)}")
        graph = cls(vectors, params, metric, list(levels), [{} for _ in range(max(levels, default=-1) + 1)], entry)
        for node, level in enumerate(levels):
            if not 0 <= level <= MAX_LEVEL:
                raise ValueError(f"node {node} has level {level}")
            for layer in range(level + 1):
                graph.layers[layer][node] = []
        for layer, source, position, target in edges:
            if not 0 <= layer < len(graph.layers) or source not in graph.layers[layer] or target not in graph.layers[layer]:
                raise ValueError(f"edge {source} to {target} leaves layer {layer}")
            row = graph.layers[layer][source]
            if position != len(row) or len(row) >= params.max_degree(layer):
                raise ValueError(f"node {source} has no place {position} on layer {layer}")
            row.append(target)
        return graph

    def distances(self, query: np.ndarray, ids: list[int] | np.ndarray) -> np.ndarray:
        rows = self.vectors[ids]
        self.computed += len(rows)
        if self.metric == "l2":
            gap = rows - query
            return np.einsum("ij,ij->i", gap, gap)
        dot = rows @ query
        return 1 - dot if self.metric == "cosine" else -dot

    def build(self, keys: list[int] | None = None) -> Graph:
        """Insert all vectors in order; keys (default: positions) draw the levels."""
        for i in range(len(self.vectors)):
            self.insert(i, self.params.level_of(i if keys is None else keys[i]))
        return self

    def _select(self, near: list[tuple[float, int]], m: int) -> list[int]:
        """select_neighbors() with the distances among all candidates at hand: those of a new choice to all others are
        taken in one step."""
        near = sorted(near)
        if not self.params.heuristic or len(near) <= 1:
            return [c for _, c in near[:m]]
        ids = [c for _, c in near]
        dist = [d for d, _ in near]
        rows = self.vectors[ids]
        self.computed += len(ids) * (len(ids) - 1) // 2
        among = rows @ rows.T
        if self.metric == "l2":
            own = among.diagonal()
            among = own[:, None] + own[None, :] - 2 * among
        else:
            among = 1 - among if self.metric == "cosine" else -among
        closest = np.full(len(ids), np.inf)
        chosen: list[int] = []
        pruned: list[int] = []
        for k, c in enumerate(ids):
            if len(chosen) == m:
                break
            if closest[k] < dist[k]:
                pruned.append(c)
            else:
                chosen.append(c)
                np.minimum(closest, among[k], out=closest)
        return chosen + pruned[: m - len(chosen)] if self.params.keep_pruned else chosen

    def insert(self, node: int, level: int) -> None:
        self.levels.append(level)
        self._reached.clear()
        top = len(self.layers) - 1
        while len(self.layers) <= level:
            self.layers.append({})
        for layer in range(level + 1):
            self.layers[layer][node] = []
        if self.entry is None:
            self.entry = node
            return
        query = self.vectors[node]
        start = [(float(self.distances(query, [self.entry])[0]), self.entry)]
        for layer in range(top, level, -1):
            start = self.search_layer(query, start, 1, layer)
        for layer in range(min(level, top), -1, -1):
            start = self.search_layer(query, start, self.params.ef_construction, layer)
            chosen = self._select(start, self.params.m)
            links = self.layers[layer]
            links[node] = list(chosen)
            cap = self.params.max_degree(layer)
            for c in chosen:
                if len(links[c]) < cap:
                    links[c].append(node)
                else:
                    some = [*links[c], node]
                    dist = self.distances(self.vectors[c], some)
                    links[c] = self._select(list(zip(dist.tolist(), some)), cap)
        if level > top:
            self.entry = node

    def search_layer(self, query: np.ndarray, start: list[tuple[float, int]], ef: int, layer: int, passing: np.ndarray | None = None) -> list[tuple[float, int]]:
        """The ef nearest found by a beam from start, sorted.  It stops when the nearest candidate is strictly farther than
        the worst result and the results are full.  With ``passing`` (by node) the beam walks over all nodes, but only those
        that pass become results."""
        links = self.layers[layer]
        seen = {c for _, c in start}
        todo = list(start)
        heapq.heapify(todo)
        best = [(-d, -c) for d, c in start if passing is None or passing[c]]
        heapq.heapify(best)
        while len(best) > ef:
            heapq.heappop(best)
        while todo:
            dist, c = heapq.heappop(todo)
            if len(best) >= ef and dist > -best[0][0]:
                break
            fresh = [x for x in links[c] if x not in seen]
            if not fresh:
                continue
            seen.update(fresh)
            for d, x in zip(self.distances(query, fresh).tolist(), fresh):
                if len(best) >= ef and (d, x) >= (-best[0][0], -best[0][1]):
                    continue
                heapq.heappush(todo, (d, x))
                if passing is not None and not passing[x]:
                    continue
                if len(best) < ef:
                    heapq.heappush(best, (-d, -x))
                else:
                    heapq.heapreplace(best, (-d, -x))
        return sorted((-d, -c) for d, c in best)

    def search(self, query: np.ndarray, k: int, ef: int, passing: np.ndarray | None = None, slack: float = 0.0) -> list[tuple[float, int]]:
        """The k nearest found with a beam of max(ef, k), among those that pass; an empty graph or k = 0 gives nothing.
        What the beam holds at most ``slack`` farther than the last of them is added, for callers that round."""
        if self.entry is None or k <= 0:
            return []
        start = [(float(self.distances(query, [self.entry])[0]), self.entry)]
        for layer in range(len(self.layers) - 1, 0, -1):
            start = self.search_layer(query, start, 1, layer)
        if max(ef, k) >= len(self.layers[0]):
            return self.whole(query, start[0], k, passing, slack)
        found = self.search_layer(query, start, max(ef, k), 0, passing)
        return found[: bisect.bisect_right(found, (found[k - 1][0] + slack, len(self.layers[0])))] if slack and len(found) > k else found[:k]

    def whole(self, query: np.ndarray, start: tuple[float, int], k: int, passing: np.ndarray | None = None, slack: float = 0.0) -> list[tuple[float, int]]:
        """As search_layer on layer 0 with a beam as wide as the graph, cut as search cuts.  Such a beam never stops early, so
        it walks to whatever edges lead to, in any order; where they lead no further it starts again at the first node left."""
        nodes = self._walk(start[1])
        if passing is not None:
            nodes = nodes[passing[nodes]]
        dist = self.distances(query, nodes)
        self.computed += len(self.layers[0]) - 1 - len(nodes)  # the walk is on all nodes, the start's distance is known
        if 0 < k < len(nodes):
            some = np.flatnonzero(dist <= np.partition(dist, k - 1)[k - 1] + slack)
            nodes, dist = nodes[some], dist[some]
        order = np.lexsort((nodes, dist))
        found = list(zip(dist[order].tolist(), nodes[order].tolist()))
        return found if slack else found[:k]

    def _walk(self, start: int) -> np.ndarray:
        """All nodes of layer 0 in the order of a walk along its edges from start."""
        if start not in self._reached:
            n = len(self.layers[0])
            if -1 not in self._reached:
                links = np.full((n, max(1, max(map(len, self.layers[0].values()), default=1))), -1, np.int64)
                for node, row in self.layers[0].items():
                    links[node, : len(row)] = row
                self._reached[-1] = links
            links, seen, steps, fresh = self._reached[-1], np.zeros(n + 1, bool), [], np.array([start])
            seen[n] = True  # where -1 points
            while len(fresh):
                seen[fresh] = True
                steps.append(fresh)
                ahead = links[fresh].ravel()
                fresh = np.unique(ahead[~seen[ahead]])
                if not len(fresh):
                    fresh = np.flatnonzero(~seen)[:1]
            self._reached[start] = np.concatenate(steps)
        return self._reached[start]

    def edges(self) -> list[tuple[int, int, int, int]]:
        """(layer, source, position, target)."""
        return [(layer, s, p, t) for layer, links in enumerate(self.layers) for s, row in links.items() for p, t in enumerate(row)]
