"""Kernels for graphs of many nodes, against plain searches."""

import itertools
import random
import time
from collections import deque

import numpy as np
import pytest
from pyspark.sql import DataFrame

from propgraph.operators import centrality, community, flow, kernels, matrix, metrics, structure, traverse
from propgraph.operators.common import Csr

from . import toys


def chains(rng, users, copies, extra):
    """Chains of ``copies`` nodes each, joined at random: long ways, many nodes of two neighbours."""
    links = {(u * copies + i, u * copies + i + 1) for u in range(users) for i in range(copies - 1)}
    links |= {(u * copies + copies - 1, rng.randrange(users) * copies) for u in range(users) for _ in range(extra)}
    return sorted({(min(a, b), max(a, b)) for a, b in links if a != b})


def plain_hops(links, n):
    near = [[] for _ in range(n)]
    for a, b in links:
        near[a].append(b)
        near[b].append(a)
    out = np.full((n, n), -1)
    for s in range(n):
        out[s, s], todo = 0, deque([s])
        while todo:
            v = todo.popleft()
            for w in near[v]:
                if out[s, w] < 0:
                    out[s, w] = out[s, v] + 1
                    todo.append(w)
    return out


def csr(links, n):
    a, b = map(np.array, zip(*links))
    return Csr(np.arange(n), np.concatenate([a, b]), np.concatenate([b, a]))


def test_bits_of_many_sources_spread_as_single_searches_do():
    links, n = chains(random.Random(1), 15, 10, 1), 153
    want = plain_hops(links, n)
    g = csr(links, n)
    assert (np.concatenate([kernels.hops(g, np.arange(i, min(n, i + 64))) for i in range(0, n, 64)]) == want).all()
    reached, total, farthest = kernels.reach(g, np.arange(n))
    assert (reached == (want >= 0).sum(axis=0)).all() and (total == np.maximum(want, 0).sum(axis=0)).all() and (farthest == want.max(axis=0)).all()


def test_distance_sums_take_no_row_for_each_pair_and_no_objects_on_the_driver(spark, monkeypatch):
    links = chains(random.Random(2), 12, 8, 2)
    g = toys.graph(spark, [(i, a, b) for i, (a, b) in enumerate(links)])
    nodes = sorted({x for p in links for x in p})
    want = plain_hops(links, nodes[-1] + 1)[np.ix_(nodes, nodes)]
    monkeypatch.setattr(traverse, "distances", lambda *a: pytest.fail("pairs as rows"))
    monkeypatch.setattr(type(spark.range(1)), "toPandas", lambda self: pytest.fail("rows as objects"))
    assert isinstance(spark.range(1), DataFrame)
    assert (want >= 0).all()
    assert metrics.average_shortest_path_length(g) == pytest.approx(want.sum() / (len(nodes) * (len(nodes) - 1)))
    assert metrics.wiener_index(g) == want.sum() / 2
    assert metrics.graph_diameter(g) == want.max() and metrics.radius(g) == want.max(axis=1).min()
    assert {r[0]: r[1] for r in metrics.eccentricity(g).collect()} == dict(zip(nodes, want.max(axis=1)))
    assert {r[0] for r in metrics.center(g).collect()} == {v for v, e in zip(nodes, want.max(axis=1)) if e == want.max(axis=1).min()}
    assert {r[0]: pytest.approx(r[1]) for r in centrality.closeness_centrality(g).collect()} == {v: (len(nodes) - 1) / s for v, s in zip(nodes, want.sum(axis=1).tolist())}


def merged_plainly(n, links):
    """Greedy merging with a label for each node changed at every union, as it was."""
    group, m = list(range(n)), len(links)
    while True:
        degree, between = [0] * n, {}
        for a, b in links:
            x, y = sorted((group[a], group[b]))
            degree[x] += 1
            degree[y] += 1
            if x != y:
                between[x, y] = between.get((x, y), 0) + 1
        best = min(((-(2 * m * w - degree[x] * degree[y]), x, y) for (x, y), w in between.items()), default=(0, 0, 0))
        if best[0] >= 0:
            return group
        group = [best[1] if c == best[2] else c for c in group]


def test_merging_communities_is_quick_and_the_same():
    for seed in range(5):
        links = chains(random.Random(seed), 8, 4, 2)
        assert kernels.modularity_merge(32, [(a, b, 1.0) for a, b in links]) == merged_plainly(32, links)
    links = chains(random.Random(9), 1000, 40, 2)  # relabelling all 40,000 nodes at each union took over a minute
    began = time.process_time()
    kernels.modularity_merge(40_000, [(a, b, 1.0) for a, b in links])
    assert time.process_time() - began < 30


def split(n, links, gone):
    near = {v: set() for v in range(n) if v not in gone}
    for a, b in links:
        if a in near and b in near:
            near[a].add(b)
            near[b].add(a)
    seen, todo = set(), [min(near)]
    while todo:
        v = todo.pop()
        if v not in seen:
            seen.add(v)
            todo += near[v]
    return len(seen) < len(near)


def test_connectivity_against_every_cut():
    rng = random.Random(4)
    for _ in range(40):
        n = rng.randint(3, 8)
        links = [p for p in itertools.combinations(range(n), 2) if rng.random() < rng.choice([0.5, 0.8])]
        if not links or split(n, links, ()):
            continue
        nodes = next((k for k in range(1, n - 1) for gone in itertools.combinations(range(n), k) if split(n, links, gone)), n - 1)
        cuts = min(sum((a in side) != (b in side) for a, b in links) for k in range(1, n) for side in map(set, itertools.combinations(range(n), k)))
        assert (kernels.edge_connectivity(n, links), kernels.node_connectivity(n, links)) == (cuts, nodes)


def test_connectivity_of_many_nodes(spark):
    n = 3000  # a ring: a search for each node took minutes
    g = toys.graph(spark, [(i, i, (i + 1) % n) for i in range(n)])
    began = time.time()
    assert (flow.edge_connectivity(g), flow.node_connectivity(g)) == (2, 2)
    assert time.time() - began < 60


def test_spectra_beyond_the_dense_bound(spark, monkeypatch):
    links = chains(random.Random(6), 20, 6, 2)
    g = toys.graph(spark, [(i, a, b) for i, (a, b) in enumerate(links + links[:30])])
    value, vector, halves = matrix.fiedler_value(g), toys.values(matrix.fiedler_vector(g)), toys.values(matrix.spectral_partition(g))
    monkeypatch.setattr(matrix, "DENSE", 10)
    assert value > 0 and matrix.fiedler_value(g) == pytest.approx(value, abs=1e-10)
    assert toys.values(matrix.fiedler_vector(g)) == pytest.approx(vector, abs=1e-7)
    assert toys.values(matrix.spectral_partition(g)) == halves
    assert set(toys.values(matrix.spectral_partition(g, n_clusters=4))) == set(halves)
    two = toys.graph(spark, [(i, a, b) for i, (a, b) in enumerate(links + [(a + 1000, b + 1000) for a, b in links])])
    assert matrix.fiedler_value(two) == 0.0
    cluster = toys.values(matrix.spectral_partition(two))
    assert all(cluster[a] == cluster[b] for a, b in links)
    assert metrics.network_robustness(g)["fiedler_value"] == pytest.approx(value, abs=1e-10)


def test_dependencies_of_batches_and_by_level_agree(spark, monkeypatch):
    links = chains(random.Random(7), 9, 4, 2)
    g = toys.graph(spark, [(i, a, b) for i, (a, b) in enumerate(links + links[:10])])
    nodes = toys.values(centrality.betweenness_centrality(g, bound=0))
    edges = {(r[0], r[1]): r[2] for r in centrality.edge_betweenness_centrality(g, bound=0).collect()}
    monkeypatch.setattr(type(spark.range(1)), "toPandas", lambda self: pytest.fail("rows as objects"))
    assert toys.values(centrality.betweenness_centrality(g)) == pytest.approx(nodes)
    assert {(r[0], r[1]): r[2] for r in centrality.edge_betweenness_centrality(g).collect()} == pytest.approx(edges)
    assert toys.values(centrality.betweenness_centrality(g, multigraph=False)) == pytest.approx(toys.values(centrality.betweenness_centrality(g, multigraph=False, bound=0)))


def test_cuts_of_a_thinned_graph(spark):
    rng = random.Random(8)
    for bulk in (40, 160):
        pairs = [(rng.randrange(30), rng.randrange(30, 60)) for _ in range(bulk)] + [(60, 61), (61, 0), (62, 63), (63, 64), (64, 62), (65, 64), (66, 67), (66, 67)]
        g = toys.graph(spark, [(i, a, b) for i, (a, b) in enumerate(pairs)])
        whole = set(map(tuple, structure._cuts(g, None).collect()))
        assert whole and set(map(tuple, structure._cuts(g, None, share=20).collect())) == whole
        e = structure.edges(g).select("src", "dst", "rel_id")
    assert structure.thinned(e, 100).count() < len(pairs) and structure.thinned(e) is e


def test_communities_by_component_are_those_of_the_whole(spark, monkeypatch):
    parts = [[(a + 100 * i, b + 100 * i) for a, b in chains(random.Random(i), 6, 4, 2 + i)] for i in range(3)]
    links = sorted(p for part in parts for p in part)
    g = toys.graph(spark, [(i, a, b) for i, (a, b) in enumerate(links)], nodes=[999])
    nodes = sorted({x for p in links for x in p})
    place = {v: i for i, v in enumerate(nodes)}
    group = kernels.local_moves(len(nodes), [(place[a], place[b], 1.0) for a, b in links])
    seen = []
    monkeypatch.setattr(community, "one_group", lambda *a: pytest.fail("all edges in one task"))
    found = toys.values(community.community_detection(g, "LINE"))
    names = {c: i for i, c in enumerate(dict.fromkeys(group))}
    assert found == {v: names[c] for v, c in zip(nodes, group)}
    for rounds in (2, None):
        by_task = toys.values(community.label_propagation_communities(g, rounds=rounds))
        assert by_task == toys.values(community.label_propagation_communities(g, rounds=rounds, bound=1))
        seen.append(by_task)
    assert seen[0] != seen[1] and 999 in seen[0]


def test_all_pairs_bring_no_objects_to_the_driver(spark, monkeypatch):
    links = chains(random.Random(10), 20, 5, 2)  # more nodes than one batch of sources
    g = toys.graph(spark, [(i, a, b, 0.5) for i, (a, b) in enumerate(links)], props="x double")
    nodes = sorted({x for p in links for x in p})
    want = {(a, b): float(d) for a, row in enumerate(plain_hops(links, nodes[-1] + 1)) for b, d in enumerate(row) if d >= 0 and a in nodes and b in nodes}
    monkeypatch.setattr(type(spark.range(1)), "toPandas", lambda self: pytest.fail("rows as objects"))
    assert {(r[0], r[1]): r[2] for r in traverse.all_pairs_hops(g).collect()} == want
    assert {(r[0], r[1]): 2 * r[2] for r in matrix.electrical_distance(g, None, "x").collect()} == want


def test_chains_take_searches_from_their_ends_only():
    for seed in range(40):
        rng = random.Random(seed)
        users, copies = rng.randint(1, 8), rng.randint(2, 14)
        n = users * copies
        links = chains(rng, users, copies, rng.randint(1, 3)) + [(n, n + 1), (n + 1, n + 2), (n + 2, n + 3), (n, n + 3)]  # and a ring
        if seed % 2:
            links = sorted({*links, *(tuple(sorted(rng.sample(range(n), 2))) for _ in range(2))})
        g = csr(links, n + 4)
        ways, own, left = kernels.sources_by_chains(g)
        assert len(ways) + len(left) <= n + 4
        for of_edges in (False, True):
            found = kernels.chain_dependencies(g, ways, own, of_edges) + kernels.dependencies(g, left, of_edges)
            assert found == pytest.approx(kernels.dependencies(g, np.arange(n + 4), of_edges))
    g = csr(chains(random.Random(11), 40, 60, 12), 2400)
    ways, own, left = kernels.sources_by_chains(g)
    assert len(ways) == 40 and not len(left)  # 2,400 sources before


def test_edge_betweenness_of_chains_sums_up_to_all_distances(spark):
    links = chains(random.Random(12), 12, 20, 3)
    g = toys.graph(spark, [(i, a, b) for i, (a, b) in enumerate(links)])
    n = 240
    assert sum(r[2] for r in centrality.edge_betweenness_centrality(g).collect()) * n * (n - 1) == pytest.approx(plain_hops(links, n).sum())
    between, total = kernels.dependencies(csr(links, n), np.arange(n), False) / ((n - 1) * (n - 2)), plain_hops(links, n).sum(axis=0)
    best = sorted((-((n - 1) / total[v] + between[v]) / 2, v) for v in range(n))[:5]
    assert [(r[0], pytest.approx(r[1])) for r in centrality.bess_siting_ranking(g, None, None, 5).collect()] == [(v, -x) for x, v in best]


def test_merging_communities_keeps_no_outdated_unions(monkeypatch):
    links, most = chains(random.Random(13), 100, 20, 12), [0]
    push = kernels.heapq.heappush
    monkeypatch.setattr(kernels.heapq, "heappush", lambda heap, x: (push(heap, x), most.__setitem__(0, max(most[0], len(heap)))))
    kernels.modularity_merge(2000, [(a, b, 1.0) for a, b in links])
    assert 0 < most[0] <= 3 * len(links) + 1100  # 30,009 before


def test_forests_join_what_the_edges_join(spark):
    for seed in range(30):
        rng = random.Random(seed)
        n = rng.randint(2, 60)
        a, b = (np.array([rng.randrange(n) for _ in range(rng.randint(1, 70))]) for _ in range(2))
        a, b = a[: min(len(a), len(b))], b[: min(len(a), len(b))]
        root, kept = kernels.spanning(n, a, b)
        want = plain_hops(list(zip(a.tolist(), b.tolist())), n) >= 0
        assert (root == want.argmax(axis=1)).all() and len(kept) == n - len(set(root.tolist()))
        assert (kernels.spanning(n, a[kept], b[kept])[0] == root).all()
    e = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b)] * 3, "src long, dst long")
    assert structure.thinned(e, 5, structure.forest).count() < len(a)
    parts = [{r[0]: r[1] for r in community._component_of(e, bound).collect()} for bound in (1000, 0)]
    assert all({v: r for v, r in p.items() if v in set(a[a != b]) | set(b[a != b])} == {v: root[v] for v in range(n) if v in set(a[a != b]) | set(b[a != b])} for p in parts)


@pytest.mark.parametrize("find", [community.community_detection, community.label_propagation_communities])
def test_communities_are_found_once_and_numbered(spark, monkeypatch, find):
    links = chains(random.Random(14), 6, 4, 3)
    g = toys.graph(spark, [(i, a, b) for i, (a, b) in enumerate([*links, (500, 500)])], nodes=[999])
    plans, number = [], community.numbered
    monkeypatch.setattr(community, "numbered", lambda found: (plans.append(found._jdf.queryExecution().toString()), number(found))[1])
    every = {x for p in links for x in p}
    assert set(toys.values(find(g, "LINE"))) == every | {500} and set(toys.values(find(g))) == every | {500, 999}
    assert len(plans) == 2 and not any("FlatMapGroups" in p for p in plans)  # numbering reads them three times
