"""Algorithms over one graph in arrays, for the parts that do not split by row."""

from __future__ import annotations

import heapq
import itertools
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np

from .common import Csr


def levels(g: Csr, sources: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Up to 64 sources at once, each a bit: of every step 0, 1, ... the nodes' bits of the sources that first reach them."""
    filled = np.flatnonzero(np.diff(g.first))
    starts = g.first[filled]
    seen = np.zeros(g.n, np.uint64)
    seen[sources] = np.uint64(1) << np.arange(len(sources), dtype=np.uint64)
    new, d = seen.copy(), 0
    while new.any():
        yield d, new
        got = np.zeros(g.n, np.uint64)
        if len(filled):
            got[filled] = np.bitwise_or.reduceat(new[g.to], starts)
        new = got & ~seen
        seen |= new
        d += 1


def reach(g: Csr, sources: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By node of an undirected graph: how many of ``sources`` it joins, the sum and the greatest of their steps."""
    reached, total, farthest = (np.zeros(g.n, np.int64) for _ in range(3))
    for i in range(0, len(sources), 64):
        for d, new in levels(g, sources[i : i + 64]):
            count = np.bitwise_count(new)
            reached += count
            total += d * count.astype(np.int64)
            farthest[(count > 0) & (farthest < d)] = d
    return reached, total, farthest


def hops(g: Csr, sources: np.ndarray) -> np.ndarray:
    """Steps from up to 64 nodes (rows) along stored edges taken from their ends, that is of an undirected graph; -1 where nothing leads."""
    out = np.full((g.n, len(sources)), -1, np.int32)
    for d, new in levels(g, sources):
        at = np.flatnonzero(new)
        bits = np.unpackbits(new[at].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, column = np.nonzero(bits)
        out[at[row], column] = d
    return np.ascontiguousarray(out.T)


def dijkstra(g: Csr, s: int, lists: tuple[list, list, list] | None = None) -> np.ndarray:
    """``lists``: the graph's ``first``, ``to`` and ``weight`` as lists, if many sources share them."""
    first, to, weight = lists or (g.first.tolist(), g.to.tolist(), g.weight.tolist())
    out = [np.inf] * g.n
    out[s] = 0.0
    heap = [(0.0, s)]
    while heap:
        d, v = heapq.heappop(heap)
        if d > out[v]:
            continue
        for k in range(first[v], first[v + 1]):
            new = d + weight[k]
            w = to[k]
            if new < out[w]:
                out[w] = new
                heapq.heappush(heap, (new, w))
    return np.array(out)


def weighted_dependencies(g: Csr, s: int, lists: tuple[list, list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """How much cheapest paths from ``s`` depend on each node and on each stored edge (parallel edges count as ways)."""
    dist = dijkstra(g, s, lists)
    order = [int(v) for v in np.argsort(dist, kind="stable") if np.isfinite(dist[v])]
    sigma = np.zeros(g.n)
    sigma[s] = 1.0
    on_path: dict[int, list[int]] = {}
    for v in order:
        keep = []
        for k in range(g.first[v], g.first[v + 1]):
            w = g.to[k]
            if w != v and abs(dist[v] + g.weight[k] - dist[w]) <= 1e-12 * max(1.0, dist[w]):
                sigma[w] += sigma[v]
                keep.append(k)
        on_path[v] = keep
    node, edge = np.zeros(g.n), np.zeros(len(g.to))
    for v in reversed(order):
        for k in on_path[v]:
            share = sigma[v] / sigma[g.to[k]] * (1 + node[g.to[k]])
            edge[k] += share
            node[v] += share
    node[s] = 0.0
    return node, edge


def _forward(g: Csr, part: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """Levels of a search from each of ``part``, as (from, to, stored edge) of (source, node) pairs, the pairs' numbers of ways and steps (-1 where nothing leads)."""
    degree = np.diff(g.first)
    new = np.arange(len(part)) * g.n + part
    steps_to = np.full(len(part) * g.n, -1, np.int32)
    sigma, mark = np.zeros(len(steps_to)), np.zeros(len(steps_to), np.int32)
    steps_to[new], sigma[new] = 0, 1.0
    steps = []
    while len(new):
        v = new % g.n
        n = degree[v]
        at = np.arange(n.sum()) + np.repeat(g.first[v] - (np.cumsum(n) - n), n)
        to = g.to[at] + np.repeat(new - v, n)
        keep = np.flatnonzero(steps_to[to] < 0)
        to, at, came = to[keep], at[keep], np.repeat(new, n)[keep]
        np.add.at(sigma, to, sigma[came] * g.weight[at])
        order = np.arange(len(to), dtype=np.int32)
        mark[to] = order
        new = to[mark[to] == order]
        steps.append((came, to, at))
        steps_to[new] = len(steps)
    return steps, sigma, steps_to


def _back(g: Csr, part: np.ndarray, steps: list, sigma: np.ndarray, wanted: np.ndarray | None, edge: np.ndarray) -> np.ndarray:
    """By node, how much ways from ``part`` depend on it, each pair counting as often as ``wanted`` says, or once; sums of edges go to ``edge`` if it has any."""
    later = np.zeros(len(sigma))
    for came, to, at in reversed(steps):
        share = sigma[came] * g.weight[at] / sigma[to] * ((1 if wanted is None else wanted[to]) + later[to])
        np.add.at(later, came, share)
        if len(edge):
            np.add.at(edge, at, share)
    later[np.arange(len(part)) * g.n + part] = 0.0
    return later.reshape(len(part), g.n).sum(axis=0)


def _batch(g: Csr) -> int:
    return max(1, min(32, 6_000_000 // (g.n + len(g.to) + 1)))


def dependencies(g: Csr, sources: np.ndarray, of_edges: bool) -> np.ndarray:
    """How much shortest paths from ``sources`` depend on each node, or on each stored edge; ``g.weight`` says how many ways an edge stands for.

    A batch of sources goes forward by levels, each (source, node) pair once, then back.
    """
    node, edge = np.zeros(g.n), np.zeros(len(g.to) if of_edges else 0)
    for i in range(0, len(sources), size := _batch(g)):
        part = sources[i : i + size].astype(np.int64)
        steps, sigma, _ = _forward(g, part)
        node += _back(g, part, steps, sigma, None, edge)
    return edge if of_edges else node


def chains(g: Csr) -> list[np.ndarray]:
    """Of a simple graph, ways from one node to another over three or more nodes between them that have two neighbours each; the ends have more or fewer."""
    inner = np.diff(g.first) == 2
    src = np.repeat(np.arange(g.n), np.diff(g.first))
    first, to, between = g.first.tolist(), g.to.tolist(), inner.tolist()
    out, done = [], [False] * g.n
    starts = np.flatnonzero(~inner[src] & inner[g.to])
    for a, v in zip(src[starts].tolist(), g.to[starts].tolist()):
        if done[v]:
            continue
        way = [a, v]
        while between[v]:
            done[v] = True
            k = first[v]
            v = to[k] if to[k] != way[-2] else to[k + 1]
            way.append(v)
        if len(way) > 4 and v != a:
            out.append(np.array(way))
    return out


def sources_by_chains(g: Csr) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """``chains``; of each whether its first and last node are to be its sources too, so that each end is one once; and the nodes on no chain."""
    ways = chains(g)
    ends = np.array([[w[0], w[-1]] for w in ways], np.int64).reshape(-1, 2)
    own = np.zeros(ends.shape, bool)
    own.flat[np.unique(ends, return_index=True)[1]] = True
    return ways, own, np.setdiff1d(np.arange(g.n), np.concatenate([ends.ravel(), *[w[1:-1] for w in ways]]))


def chain_dependencies(g: Csr, ways: list[np.ndarray], own: np.ndarray, of_edges: bool) -> np.ndarray:
    """``dependencies`` from all nodes between the ends of ``ways`` (``chains`` of a simple graph), and from the ends that ``own`` says, by searches from the ends alone.

    A node at place i of a way of length n reaches what lies outside by the end that is nearer by then; where
    both are, by the share of each end's ways. So the back sweep from an end counts a node as often as
    there are places that reach it by this end. Two places of one way meet along it or around by both ends,
    as their gap and the ends' distance say. Loads along a way are sums over its places.
    """
    node, edge = np.zeros(g.n), np.zeros(len(g.to) if of_edges else 0)
    key = np.repeat(np.arange(g.n), np.diff(g.first)) * g.n + g.to
    for i in range(0, len(ways), size := max(1, _batch(g) // 2)):
        batch = ways[i : i + size]
        part = np.array([[w[0], w[-1]] for w in batch], np.int64).ravel()
        steps, sigma, steps_to = _forward(g, part)
        wanted = np.zeros((len(part), g.n))
        by, far = sigma.reshape(len(part), g.n), steps_to.reshape(len(part), g.n)
        for j, way in enumerate(batch):
            n, inside = len(way) - 1, way[1:-1]
            outside = far[2 * j] >= 0
            outside[inside] = False
            t = np.flatnonzero(outside)
            even = n + far[2 * j + 1, t].astype(np.int64) - far[2 * j, t]  # twice the place from which both ends are as near
            here = np.clip((even + 1) // 2 - 1, 0, n - 1)
            tied = (even % 2 == 0) & (even > 0) & (even < 2 * n)
            share = np.where(tied, by[2 * j, t] / (by[2 * j, t] + by[2 * j + 1, t]), 0.0)
            to_first = here + share
            to_last = n - 1 - to_first
            # what each place 1 .. n - 1 sends to the first end, and to the last
            twice = 2 * np.arange(1, n)
            over = len(t) - np.cumsum(np.bincount(even, minlength=2 * n + 1))
            send = over[twice] + np.bincount(even, weights=share, minlength=2 * n + 1)[twice]
            send = np.stack([send, len(t) - send])
            # pairs of places with gap k: the share that meets along the way, and around
            gap, d = 2 * np.arange(n - 1), n + int(far[2 * j, way[-1]])
            along = np.where(gap < d, 1.0, np.where(gap == d, 1 / (1 + by[2 * j, way[-1]]), 0.0))
            along[0] = 0.0
            around = 1.0 - along
            around[0] = 0.0
            rounds = float((around * (n - 1 - np.arange(n - 1))).sum())
            met, missed = np.cumsum(along), np.cumsum(around)  # from place i to those after it: [n - 1 - i]; to those before it: [i - 1]
            # loads of the edges from place m to m + 1, m = 0 .. n - 1, by direction, and of the places between
            down, up, pair = np.zeros(n), np.zeros(n), np.zeros(n)
            down[:-1] = np.cumsum(send[0][::-1])[::-1]
            up[1:] = np.cumsum(send[1])
            pair[1:] = np.cumsum(met[::-1] - met) + np.cumsum(missed)
            pair[:-1] += np.cumsum(missed)[::-1]
            if of_edges:
                np.add.at(edge, np.searchsorted(key, way[1:] * g.n + way[:-1]), down + pair)
                np.add.at(edge, np.searchsorted(key, way[:-1] * g.n + way[1:]), up + pair)
            # a place takes what comes by the edge before it or after it from elsewhere
            node[inside] += down[1:] + up[:-1] + pair[1:] + pair[:-1] - (met + missed) - (met + missed)[::-1]
            node[way[0]] += to_first.sum() - to_first[np.searchsorted(t, way[0])] + 2 * rounds
            node[way[-1]] += to_last.sum() - to_last[np.searchsorted(t, way[-1])] + 2 * rounds
            wanted[2 * j, t], wanted[2 * j + 1, t] = to_first, to_last
            wanted[2 * j, way[-1]] += rounds
            wanted[2 * j + 1, way[0]] += rounds
        wanted += own[i : i + size].reshape(-1, 1)
        node += _back(g, part, steps, sigma, wanted.ravel(), edge)
    return edge if of_edges else node


def low_links(g: Csr) -> tuple[set[int], set[int], set[int]]:
    """Relationship ids of bridges, places of articulation points, and relationship ids of a subgraph with the same blocks, of an undirected multigraph (edges stored from both ends).

    The subgraph has the search tree's edges and of each node the edge that leads furthest up: at most two
    a node, and the same low links.
    """
    first, to, rels = g.first.tolist(), g.to.tolist(), g.rel.tolist()
    number, low = [-1] * g.n, [0] * g.n
    up_to, up_by = [g.n] * g.n, [-1] * g.n
    bridges: set[int] = set()
    points: set[int] = set()
    kept: set[int] = set()
    clock, at = 0, first[:-1]
    for root in range(g.n):
        if number[root] >= 0:
            continue
        number[root] = low[root] = clock
        clock += 1
        children = 0
        stack = [(root, -1)]
        while stack:
            v, entered_by = stack[-1]
            k = at[v]
            if k < first[v + 1]:
                at[v] = k + 1
                w, rel = to[k], rels[k]
                if rel == entered_by or w == v:
                    continue
                if number[w] >= 0:
                    if number[w] < up_to[v] and number[w] < number[v]:
                        up_to[v], up_by[v] = number[w], rel
                    low[v] = min(low[v], number[w])
                    continue
                number[w] = low[w] = clock
                clock += 1
                children += v == root
                kept.add(rel)
                stack.append((w, rel))
            else:
                stack.pop()
                if up_to[v] < g.n:
                    kept.add(up_by[v])
                if not stack:
                    continue
                up = stack[-1][0]
                low[up] = min(low[up], low[v])
                if low[v] > number[up]:
                    bridges.add(entered_by)
                if up != root and low[v] >= number[up]:
                    points.add(up)
        if children > 1:
            points.add(root)
    return bridges, points, kept


def spanning(n: int, src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least place that each of ``n`` places reaches, and which edges make a forest that reaches as far.

    In each round a root joins the least one that an edge leads to, if that is less than it.
    """
    root, kept, at = np.arange(n), [], np.arange(len(src))
    while True:
        a, b = root[src[at]], root[dst[at]]
        low, high = np.minimum(a, b), np.maximum(a, b)
        apart = low != high
        at, low, high = at[apart], low[apart], high[apart]
        if not len(at):
            return root, np.sort(np.concatenate(kept)) if kept else at
        np.minimum.at(root, high, low)
        joins = root[high] == low
        by = np.full(n, -1)
        by[high[joins]] = at[joins]
        kept.append(by[by >= 0])
        while (further := root[root]).tobytes() != root.tobytes():
            root = further


class Flow:
    """Greatest flows by shortest augmenting paths; capacities of parallel edges add up."""

    def __init__(self, n: int, edges: list[tuple[int, int, float]]):
        self.n = n
        self.capacity: list[dict[int, float]] = [{} for _ in range(n)]
        for a, b, c in edges:
            if a != b:
                self.capacity[a][b] = self.capacity[a].get(b, 0.0) + c
        self.rest = [dict(c) for c in self.capacity]
        for a in range(n):
            for b in self.capacity[a]:
                self.rest[b].setdefault(a, 0.0)

    def _path(self, s: int, t: int) -> dict[int, int] | None:
        came = {s: s}
        todo = deque([s])
        while todo:
            v = todo.popleft()
            for w in sorted(self.rest[v]):
                if w not in came and self.rest[v][w] > 1e-12:
                    came[w] = v
                    if w == t:
                        return came
                    todo.append(w)
        return None

    def run(self, s: int, t: int) -> float:
        total = 0.0
        if s == t:
            return 0.0
        while came := self._path(s, t):
            steps, v = [], t
            while v != s:
                steps.append((came[v], v))
                v = came[v]
            least = min(self.rest[a][b] for a, b in steps)
            for a, b in steps:
                self.rest[a][b] -= least
                self.rest[b][a] += least
            total += least
        return total

    def flows(self) -> list[tuple[int, int, float]]:
        """Net flow of each pair that has any."""
        return [(a, b, c - self.rest[a][b]) for a in range(self.n) for b, c in sorted(self.capacity[a].items()) if c - self.rest[a][b] > 1e-12]

    def source_side(self, s: int) -> set[int]:
        seen, todo = {s}, [s]
        while todo:
            v = todo.pop()
            for w, r in self.rest[v].items():
                if w not in seen and r > 1e-12:
                    seen.add(w)
                    todo.append(w)
        return seen


def edge_connectivity(n: int, pairs: list[tuple[int, int]]) -> int:
    """Fewest edges whose loss splits a connected simple graph.

    Nodes are taken by how many edges lead to those before. What this order shows to be joined as well
    as the least cut known becomes one node, and so on until one is left; a node's degree is a cut.
    """
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for a, b in pairs:
        near[a][b] = near[b][a] = 1
    best = min(sum(x.values()) for x in near)
    while n > 1 and best:
        root, tied, done = list(range(n)), [0] * n, [False] * n

        def find(v: int) -> int:
            while root[v] != v:
                root[v] = v = root[root[v]]
            return v

        heap = [(0, 0)]
        while heap:
            _, v = heapq.heappop(heap)
            if done[v]:
                continue
            done[v] = True
            for w, x in near[v].items():
                if not done[w]:
                    tied[w] += x
                    if tied[w] >= best:
                        root[find(v)] = find(w)
                    heapq.heappush(heap, (-tied[w], w))
        names: dict[int, int] = {}
        place = [names.setdefault(find(v), len(names)) for v in range(n)]
        n, merged = len(names), [{} for _ in names]
        for v, x in enumerate(near):
            for w, k in x.items():
                if place[v] != place[w]:
                    merged[place[v]][place[w]] = merged[place[v]].get(place[w], 0) + k
        near = merged
        if n > 1:
            best = min(best, *(sum(x.values()) for x in near))
    return best


def node_connectivity(n: int, pairs: list[tuple[int, int]]) -> int:
    """Fewest nodes whose loss splits a connected simple graph, or n - 1 if none do.

    With nodes in an order, let k be the least cut known. The first k must have k disjoint ways between
    each two that are no neighbours; each later node must have k such ways to a new node that is joined to
    all before it. If some k - 1 nodes split the graph, the first node beyond them fails (Even 1975).
    """
    near: list[set[int]] = [set() for _ in range(n)]
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    k = min(len(x) for x in near)
    order, place, tied, heap = [], [-1] * n, [0] * n, [(0, min(range(n), key=lambda v: (len(near[v]), v)))]
    while heap:
        _, v = heapq.heappop(heap)
        if place[v] < 0:
            place[v] = len(order)
            order.append(v)
            for w in near[v]:
                if place[w] < 0:
                    tied[w] += 1
                    heapq.heappush(heap, (-tied[w], w))
    # a node is an arc of capacity 1 from its entry 2v to its exit 2v + 1; arc i goes back as i ^ 1
    to: list[int] = []
    room: list[int] = []
    arcs: list[list[int]] = [[] for _ in range(2 * n)]
    for a, b in [(2 * v, 2 * v + 1) for v in range(n)] + [(2 * a + 1, 2 * b) for a, b in pairs] + [(2 * b + 1, 2 * a) for a, b in pairs]:
        arcs[a].append(len(to))
        arcs[b].append(len(to) + 1)
        to += [b, a]
        room += [1, 0]

    def ways(end: int, starts: Callable[[int], bool], once: bool, most: int) -> int:
        """Disjoint ways from nodes that ``starts`` names, each at most once or not, to the entry ``end``, up to ``most``."""
        found, changed, used = 0, [], set()
        while found < most:
            came, todo, at = {end: -1}, deque([end]), -1
            while todo and at < 0:
                x = todo.popleft()
                for i in arcs[x]:
                    y = to[i]
                    if room[i ^ 1] and y not in came:
                        came[y] = i ^ 1
                        if starts(y) and y not in used:
                            at = y
                            break
                        todo.append(y)
            if at < 0:
                break
            if once:
                used.add(at)
            while at != end:
                i = came[at]
                room[i] -= 1
                room[i ^ 1] += 1
                changed.append(i)
                at = to[i]
            found += 1
        for i in reversed(changed):
            room[i] += 1
            room[i ^ 1] -= 1
        return found

    for j in range(1, n):
        v = order[j]
        if j < k:
            for u in order[:j]:
                if u not in near[v]:
                    k = min(k, ways(2 * v, lambda y, u=u: y == 2 * u + 1, False, k))
        elif sum(place[w] < j for w in near[v]) < k:
            k = min(k, ways(2 * v, lambda y, j=j: y % 2 == 0 and place[y // 2] < j, True, k))
    return k


def least_eigenpairs(g: Csr, k: int, tolerance: float = 1e-12) -> tuple[np.ndarray, np.ndarray]:
    """The k least eigenvalues and vectors of the Laplacian of an undirected graph in which every node has a neighbour.

    Components give the zeros. The others come from spaces that grow by solving with the Laplacian
    (conjugate gradients), until the residuals are below ``tolerance`` times its bound.
    """
    degree = np.add.reduceat(g.weight, g.first[:-1])

    def times(x: np.ndarray) -> np.ndarray:
        return degree * x - np.add.reduceat(g.weight * x[g.to], g.first[:-1])

    root = np.arange(g.n)
    while True:
        least = np.minimum(root, np.minimum.reduceat(root[g.to], g.first[:-1]))
        least = np.minimum(least, least[least])
        if (least == root).all():
            break
        root = least
    parts = np.unique(root)
    zeros = np.linalg.qr(np.column_stack([np.ones(g.n), *(root == p for p in parts[1 : max(1, min(k, len(parts)))])]).astype(float))[0]
    if len(parts) >= k:
        return np.zeros(k), zeros[:, :k]

    def outside(x: np.ndarray, *bases: np.ndarray) -> np.ndarray:
        for b in (*bases, *bases):
            x = x - b @ (b.T @ x)
        return x

    def solve(b: np.ndarray) -> np.ndarray:
        x, r = np.zeros(g.n), b.copy()
        z = outside(r / degree, zeros)
        p, rz, goal = z, r @ z, 1e-13 * np.linalg.norm(b)
        for _ in range(20 * g.n):
            q = times(p)
            step = rz / (p @ q)
            x += step * p
            r -= step * q
            if np.linalg.norm(r) <= goal:
                break
            z = outside(r / degree, zeros)
            rz, before = r @ z, rz
            p = z + rz / before * p
        return outside(x, zeros)

    want, bound = k - len(parts), 2 * degree.max()
    last = np.linalg.qr(outside(np.random.default_rng(0).standard_normal((g.n, want)), zeros))[0]
    basis, image = last, np.column_stack([times(x) for x in last.T])
    while True:
        values, inner = np.linalg.eigh(basis.T @ image)
        values, inner = values[:want], inner[:, :want]
        vectors = basis @ inner
        off = np.linalg.norm(image @ inner - vectors * values, axis=0).max()
        if off <= tolerance * bound or basis.shape[1] + want > min(g.n - len(parts), 60 * want):
            break
        last = np.linalg.qr(outside(np.column_stack([solve(x) for x in last.T]), zeros, basis))[0]
        basis, image = np.column_stack([basis, last]), np.column_stack([image, *(times(x) for x in last.T)])
    if off > 1e-8 * bound:
        raise ArithmeticError(f"eigenvectors not found to {off}")
    return np.concatenate([np.zeros(len(parts)), values]), np.column_stack([zeros, vectors])


def best_path(g: Csr, s: int, t: int, closed_nodes: set[int], closed_edges: set[tuple[int, int]]) -> tuple[float, list[int]] | None:
    """Cheapest path, of equal ones the least by its nodes."""
    heap: list[tuple[float, tuple[int, ...]]] = [(0.0, (s,))]
    done: set[int] = set()
    while heap:
        d, path = heapq.heappop(heap)
        v = path[-1]
        if v == t:
            return d, list(path)
        if v in done:
            continue
        done.add(v)
        for k in range(g.first[v], g.first[v + 1]):
            w = int(g.to[k])
            if w not in done and w not in closed_nodes and (v, w) not in closed_edges:
                heapq.heappush(heap, (d + g.weight[k], (*path, w)))
    return None


def k_paths(g: Csr, s: int, t: int, k: int) -> list[tuple[float, list[int]]]:
    """The k cheapest loopless paths, each found as a deviation from one before."""
    first = best_path(g, s, t, set(), set())
    if first is None or s == t:
        return []
    cheapest: dict[tuple[int, int], float] = {}
    for v in range(g.n):
        for e in range(g.first[v], g.first[v + 1]):
            key = (v, int(g.to[e]))
            cheapest[key] = min(g.weight[e], cheapest.get(key, np.inf))
    found, waiting = [first], []
    known = {tuple(first[1])}
    while len(found) < k:
        _, last = found[-1]
        for i in range(len(last) - 1):
            head = last[: i + 1]
            closed = {(p[i], p[i + 1]) for _, p in found if p[: i + 1] == head and len(p) > i + 1}
            tail = best_path(g, last[i], t, set(head[:-1]), closed)
            if tail is None:
                continue
            path = head[:-1] + tail[1]
            if tuple(path) not in known:
                known.add(tuple(path))
                cost = sum(cheapest[a, b] for a, b in zip(head, head[1:])) + tail[0]
                heapq.heappush(waiting, (cost, path))
        if not waiting:
            break
        found.append(heapq.heappop(waiting))
    return found


def modularity_merge(n: int, edges: list[tuple[int, int, float]]) -> list[int]:
    """Community of each node: the pair of neighbouring communities whose union gains most merges, while any gains."""
    total = sum(w for _, _, w in edges)
    if not total:
        return list(range(n))
    share: dict[int, dict[int, float]] = {i: {} for i in range(n)}
    degree = [0.0] * n
    for a, b, w in edges:
        degree[a] += w / (2 * total)
        degree[b] += w / (2 * total)
        if a != b:
            share[a][b] = share[a].get(b, 0.0) + w / (2 * total)
            share[b][a] = share[b].get(a, 0.0) + w / (2 * total)
    # the union takes the lesser name and the row of the one with more neighbours
    row, name, joined_to = {i: i for i in range(n)}, list(range(n)), list(range(n))
    heap, most = [], 0
    while row:
        if len(heap) >= most:  # mostly unions that are outdated: only those that may be made stay
            heap = [(-2 * (w - degree[x] * degree[y]), name[x], name[y]) for x in share for y, w in share[x].items() if name[x] < name[y]]
            heapq.heapify(heap)
            most = 3 * len(heap) + 1000
        if not heap:
            break
        gain, a, b = heapq.heappop(heap)
        if a not in row or b not in row:
            continue
        x, y = row[a], row[b]
        if y not in share[x] or abs(-gain - 2 * (share[x][y] - degree[x] * degree[y])) > 1e-15:
            continue
        if -gain <= 1e-15:
            break
        if len(share[x]) < len(share[y]):
            x, y = y, x
        for c, w in share.pop(y).items():
            share[c].pop(y)
            if c != x:
                share[x][c] = share[c][x] = share[x].get(c, 0.0) + w
        degree[x] += degree[y]
        del row[b]
        row[a], name[x], joined_to[b] = x, a, a
        for c, w in share[x].items():
            heapq.heappush(heap, (-2 * (w - degree[x] * degree[c]), min(a, name[c]), max(a, name[c])))
    for v in range(n):  # names only fall, so that of the lesser is known
        joined_to[v] = joined_to[joined_to[v]]
    return joined_to


def local_moves(n: int, edges: list[tuple[int, int, float]], total: float | None = None) -> list[int]:
    """Community of each node: nodes move to the neighbouring community that gains most, then communities become nodes, until nothing moves.

    ``total``: the weight of the whole graph, of which these are some components.
    """
    whole = total
    member = list(range(n))
    while True:
        near: list[dict[int, float]] = [{} for _ in range(n)]
        degree = [0.0] * n
        total = 0.0
        for a, b, w in edges:
            total += w
            degree[a] += w
            degree[b] += w
            if a != b:
                near[a][b] = near[a].get(b, 0.0) + w
                near[b][a] = near[b].get(a, 0.0) + w
        total = total if whole is None else whole
        if not total:
            return member
        group, weight = list(range(n)), list(degree)
        moved_any = moved = True
        moved_any = False
        while moved:
            moved = False
            for v in range(n):
                links: dict[int, float] = {}
                for w, x in near[v].items():
                    links[group[w]] = links.get(group[w], 0.0) + x
                own = group[v]
                weight[own] -= degree[v]
                stay = links.get(own, 0.0) - weight[own] * degree[v] / (2 * total)
                best = max(((x - weight[c] * degree[v] / (2 * total), -c) for c, x in links.items()), default=(stay, -own))
                if best[0] > stay + 1e-12 and -best[1] != own:
                    group[v] = -best[1]
                    moved = moved_any = True
                weight[group[v]] += degree[v]
        if not moved_any:
            return member
        names = {c: i for i, c in enumerate(dict.fromkeys(group))}
        group = [names[c] for c in group]
        member = [group[m] for m in member]
        joined: dict[tuple[int, int], float] = {}
        for a, b, w in edges:
            key = (min(group[a], group[b]), max(group[a], group[b]))
            joined[key] = joined.get(key, 0.0) + w
        edges = [(a, b, w) for (a, b), w in joined.items()]
        n = len(names)


def _hashed(ids: np.ndarray, turn: int) -> np.ndarray:
    """Spark's ``xxhash64`` of a long and an int."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turned(x: np.ndarray, by: int) -> np.ndarray:
        return (x << np.uint64(by)) | (x >> np.uint64(64 - by))

    def mixed(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        return h ^ (h >> np.uint64(32))

    first = np.full(len(ids), 42 + 8, np.uint64) + p5
    first = mixed(turned(first ^ (turned(ids.astype(np.uint64) * p2, 31) * p1), 27) * p1 + p4)
    return mixed(turned((first + p5 + np.uint64(4)) ^ (np.full(1, turn, np.uint64) * p1), 23) * p2 + p3).view(np.int64)


def shared_labels(g: Csr, rounds: int | None) -> np.ndarray:
    """Label (a place) of each node after rounds in which nodes take the label most of their neighbours have, as ``community.label_propagation_communities`` says."""
    src = np.repeat(np.arange(g.n), np.diff(g.first))
    label, new = np.arange(g.n), np.arange(g.n)
    ask = np.ones(g.n, bool)  # votes change where a neighbour or the node itself has moved
    for turn in itertools.count() if rounds is None else range(rounds):
        at = np.flatnonzero(ask[src])
        votes, count = np.unique(src[at] * g.n + label[g.to[at]], return_counts=True)
        voter, named = votes // g.n, votes % g.n
        starts = np.flatnonzero(np.r_[True, voter[1:] != voter[:-1]]) if len(voter) else np.zeros(0, int)
        if len(starts):
            new[voter[starts]] = np.maximum.reduceat((2 * count + (named == label[voter])) * g.n + named, starts) % g.n
        wants = new != label
        if not wants.any():
            break
        rank = np.empty(g.n, np.int64)
        rank[np.lexsort((g.nodes, _hashed(g.nodes, turn)))] = np.arange(g.n)
        waits = src[wants[src] & wants[g.to] & (rank[g.to] < rank[src])]
        wants[waits] = False
        label[wants] = new[wants]
        ask = wants.copy()
        ask[src[wants[g.to]]] = True
    return label
