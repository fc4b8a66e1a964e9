"""Graph algorithms on small graphs with known values, and on random ones against brute force."""

import itertools
import math
import random

import numpy as np
import pytest

from propgraph.operators import centrality, community, flow, kernels, matrix, metrics, structure, traverse
from propgraph.operators.common import Csr

from . import toys


@pytest.fixture(scope="module")
def ring(spark):
    return toys.ring(spark)


@pytest.fixture(scope="module")
def barbell(spark):
    return toys.barbell(spark)


@pytest.fixture(scope="module")
def directed(spark):
    return toys.directed(spark)


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_ring(ring):
    assert traverse.is_connected(ring) and ids(structure.find_bridges(ring)) == [] == ids(structure.find_articulation_points(ring))
    assert toys.values(structure.degree(ring)) == {1: 2, 2: 2, 3: 2, 4: 2}
    rows = {r["node_id"]: r for r in traverse.dijkstra(ring, 1, weight_key="x_pu").collect()}
    assert [round(rows[i]["dist"], 9) for i in (1, 2, 3, 4)] == [0, 0.1, 0.18, 0.2]
    assert (rows[1]["prev_node_id"], rows[3]["prev_node_id"], rows[3]["prev_rel_id"]) == (-1, 2, 2)
    assert metrics.graph_diameter(ring) == 2 and matrix.fiedler_value(ring) == pytest.approx(2.0)
    assert flow.max_flow(ring, 1, 4, capacity_key="rate_mva") == 250 and flow.max_flow(ring, 1, 1) == 0
    value, sides = flow.min_cut(ring, 1, 4)
    assert value == 250 and toys.values(sides)[1] == "S" and toys.values(sides)[4] == "T"
    assert sum(r["flow"] for r in flow.flow_edges(ring, 1, 4).collect() if r["dst"] == 4) == 250
    paths = flow.k_shortest_paths(ring, 1, 4, 3, weight_key="x_pu").orderBy("rank").collect()
    assert [(p["nodes"], round(p["cost"], 9)) for p in paths] == [([1, 4], 0.2), ([1, 2, 3, 4], 0.23)] and paths[1]["rels"] == [1, 2, 3]
    assert not structure.n1_is_critical(ring, 1)
    with pytest.raises(ValueError):
        traverse.dijkstra(ring, 99)


def test_barbell(barbell):
    assert ids(structure.find_bridges(barbell)) == [4] and ids(structure.find_articulation_points(barbell)) == [3, 4]
    assert structure.n1_is_critical(barbell, 4) and not structure.n1_is_critical(barbell, 1)
    assert toys.values(centrality.betweenness_centrality(barbell)) == pytest.approx({1: 0, 2: 0, 3: 0.6, 4: 0.6, 5: 0, 6: 0})
    assert toys.values(centrality.betweenness_centrality(barbell, bound=0)) == pytest.approx({1: 0, 2: 0, 3: 0.6, 4: 0.6, 5: 0, 6: 0})
    assert toys.values(centrality.betweenness_centrality(barbell, normalized=False))[3] == pytest.approx(6.0)
    for bound in (10**6, 0):
        e = {(r["src"], r["dst"]): r["betweenness"] for r in centrality.edge_betweenness_centrality(barbell, bound=bound).collect()}
        assert e[3, 4] == pytest.approx(0.6) and e[1, 3] == pytest.approx(0.266667, abs=1e-6) and e[1, 2] == pytest.approx(0.066667, abs=1e-6)
        c = toys.values(centrality.closeness_centrality(barbell, bound=bound))
        assert [round(c[i], 6) for i in range(1, 7)] == [0.5, 0.5, 0.714286, 0.714286, 0.5, 0.5]
    assert toys.values(metrics.eccentricity(barbell)) == {1: 3, 2: 3, 3: 2, 4: 2, 5: 3, 6: 3}
    assert metrics.radius(barbell) == 2 and ids(metrics.center(barbell)) == [3, 4] and ids(metrics.periphery(barbell)) == [1, 2, 5, 6]
    assert metrics.wiener_index(barbell) == 27 and metrics.average_shortest_path_length(barbell) == pytest.approx(27 / 15)
    assert metrics.assortativity(barbell) == pytest.approx(-1 / 6) and metrics.density(barbell) == pytest.approx(7 / 15)
    assert toys.values(structure.clustering_local(barbell)) == pytest.approx({1: 1, 2: 1, 3: 1 / 3, 4: 1 / 3, 5: 1, 6: 1})
    assert structure.clustering_global(barbell) == pytest.approx(0.6)
    halves = toys.values(matrix.spectral_partition(barbell))
    assert len({halves[i] for i in (1, 2, 3)}) == 1 and len({halves[i] for i in (4, 5, 6)}) == 1 and halves[1] != halves[6]
    assert len(set(toys.values(matrix.spectral_partition(barbell, n_clusters=3)).values())) == 3
    _, eigenvalues, _ = matrix._eigen(barbell, None)
    assert np.allclose(eigenvalues, [0, 0.438447, 3, 3, 3, 4.561553], atol=1e-6)
    for found in (community.community_detection(barbell), community.greedy_modularity_communities(barbell)):
        assert toys.values(found) == {1: 0, 2: 0, 3: 0, 4: 1, 5: 1, 6: 1}
    assert community.modularity(barbell, community.community_detection(barbell)) == pytest.approx(6 / 7 - 0.5)
    lpa = toys.values(community.label_propagation_communities(barbell))
    assert len({lpa[i] for i in (1, 2, 3)}) == 1 and len({lpa[i] for i in (4, 5, 6)}) == 1
    assert flow.edge_connectivity(barbell) == 1 == flow.node_connectivity(barbell)
    phi = toys.values(metrics.rich_club_coefficient(barbell))
    assert phi == pytest.approx({0: 7 / 15, 1: 7 / 15, 2: 1.0})
    r = metrics.network_robustness(barbell)
    assert (r["n_bridges"], r["n_articulation_points"], r["diameter"], r["is_connected"]) == (1, 2, 3.0, True)
    s = metrics.summary(barbell)
    assert (s["n_nodes"], s["n_edges"], s["max_degree"], s["n_components"]) == (6, 7, 3, 1)
    assert centrality.congestion_risk(barbell).first()["rel_id"] == 4
    assert centrality.vulnerability_index(barbell).first()["vulnerability"] == 0.6
    assert [r[0] for r in centrality.bess_siting_ranking(barbell, None, n=2).collect()] == [3, 4]
    assert toys.values(centrality.degree_centrality(barbell))[3] == pytest.approx(0.6)
    total = {}
    for r in matrix.laplacian_matrix(barbell).collect():
        total[r["i_id"]] = total.get(r["i_id"], 0) + r["value"]
    assert all(abs(v) < 1e-12 for v in total.values())


def test_directed(directed):
    assert toys.values(traverse.strongly_connected_components(directed)) == {1: 0, 2: 0, 3: 0, 4: 1, 5: 1, 6: 2}
    assert toys.values(traverse.connected_components(directed)) == {1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 1}
    assert toys.values(traverse.component_sizes(directed)) == {5: 1, 1: 1} and not traverse.is_connected(directed)
    rank = toys.values(centrality.pagerank(directed))
    assert [round(rank[i], 6) for i in range(1, 7)] == pytest.approx([0.075081, 0.092945, 0.108130, 0.359779, 0.334938, 0.029126], abs=2e-6)
    assert sum(rank.values()) == pytest.approx(1)
    assert traverse.shortest_path(directed, 1, 5) == [{"node_id": 1, "rel_id": -1}, {"node_id": 2, "rel_id": 1}, {"node_id": 3, "rel_id": 2}, {"node_id": 4, "rel_id": 4}, {"node_id": 5, "rel_id": 5}]
    assert traverse.shortest_path(directed, 4, 1) is None and traverse.shortest_path(directed, 1, 1) is None
    assert metrics.graph_diameter(directed) == math.inf
    assert flow.edge_connectivity(directed) == 0 and structure.n1_is_critical(directed, 1)


def test_parallel_edges_and_loops(spark):
    g = toys.graph(spark, [(1, 1, 2, "0.5"), (2, 1, 2, "0"), (3, 2, 2, "x"), (4, 2, 3, "2")], props="w string")
    assert ids(structure.find_bridges(g)) == [4] and toys.values(structure.degree(g)) == {1: 2, 2: 5, 3: 1}
    assert toys.values(traverse.dijkstra(g, 1, weight_key="w").select("node_id", "dist")) == {1: 0.0, 2: 0.5, 3: 2.5}
    assert flow.max_flow(g, 1, 2, capacity_key="w") == 1.5
    assert {(r["i_id"], r["j_id"]): r["value"] for r in matrix.adjacency_matrix(g).collect()} == {(1, 2): 2, (2, 1): 2, (2, 2): 1, (2, 3): 1, (3, 2): 1}
    assert toys.values(structure.clustering_local(g)) == {1: None, 2: 0.0, 3: None}
    empty = g.replaced(rels={"LINE": g.rels["LINE"].limit(0)})
    assert not traverse.is_connected(empty.replaced(nodes={})) and toys.values(structure.degree(empty)) == {1: 0, 2: 0, 3: 0}
    assert toys.values(community.community_detection(empty)) == {1: 0, 2: 1, 3: 2}
    negative = toys.graph(spark, [(1, 1, 2, -1.0)], props="w double")
    with pytest.raises(ValueError):
        traverse.dijkstra(negative, 1, weight_key="w")


@pytest.mark.parametrize("seed", [1])
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    n = 9
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(12)]
    g = toys.graph(spark, [(i + 1, a, b, float(rng.randint(1, 5))) for i, (a, b) in enumerate(pairs)], nodes=range(n), props="w double")
    near = {i: set() for i in range(n)}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)

    def pieces(skip_edge=None, skip_node=None):
        left, count = set(range(n)) - {skip_node}, 0
        while left:
            count += 1
            todo = [left.pop()]
            while todo:
                v = todo.pop()
                for i, (a, b) in enumerate(pairs):
                    if i != skip_edge and v in (a, b):
                        w = b if v == a else a
                        if w in left:
                            left.discard(w)
                            todo.append(w)
        return count

    whole = pieces()
    assert traverse.connected_components(g).select("component").distinct().count() == whole
    assert ids(structure.find_bridges(g)) == [i + 1 for i in range(len(pairs)) if pieces(skip_edge=i) > whole]
    assert ids(structure.find_articulation_points(g)) == [v for v in range(n) if pieces(skip_node=v) > whole - (not near[v] - {v})]
    simple = sorted({(min(p), max(p)) for p in pairs if p[0] != p[1]})
    t = sum((a, b) in simple and (b, c) in simple and (a, c) in simple for a, b, c in itertools.combinations(range(n), 3))
    assert structure.triangles(g).count() == t
    d = np.where(np.eye(n, dtype=bool), 0.0, np.inf)
    for a, b in simple:
        d[a, b] = d[b, a] = 1
    hop = d.copy()
    for k in range(n):
        hop = np.minimum(hop, hop[:, k : k + 1] + hop[k])
    for bound in (10**6, 0):
        got = {(r["src"], r["dst"]): r["dist"] for r in traverse.all_pairs_hops(g, bound=bound).collect()}
        assert got == {(i, j): hop[i, j] for i in range(n) for j in range(n) if np.isfinite(hop[i, j])}
    b1 = toys.values(centrality.betweenness_centrality(g))
    assert b1 == pytest.approx(toys.values(centrality.betweenness_centrality(g, bound=0)))
    reach = np.isfinite(np.where(np.eye(n, dtype=bool), 0.0, np.inf))
    for a, b in pairs:
        reach[a, b] = True
    for k in range(n):
        reach |= reach[:, k : k + 1] & reach[k]
    scc = toys.values(traverse.strongly_connected_components(g))
    assert all((scc[i] == scc[j]) == bool(reach[i, j] and reach[j, i]) for i in range(n) for j in range(n))
    s, t2 = 0, n - 1
    cuts = [sum(w for (a, b), w in zip(pairs, [r["w"] for r in g.rels["LINE"].orderBy("id").collect()]) if a in side and b not in side) for k in range(n) for side in map(set, itertools.combinations(range(n), k)) if s in side and t2 not in side]
    assert flow.max_flow(g, s, t2, capacity_key="w") == pytest.approx(min(cuts))


def test_k_paths_against_all_paths():
    rng = random.Random(3)
    for _ in range(20):
        e = [(rng.randrange(6), rng.randrange(6), float(rng.randint(1, 9))) for _ in range(14)]
        a, b, w = map(np.array, zip(*e))
        g = Csr(np.arange(6), a, b, w)
        cost = {}
        for x, y, z in e:
            cost[x, y] = min(z, cost.get((x, y), np.inf))
        every = sorted(sum(cost[p] for p in zip(path, path[1:])) for r in range(5) for mid in itertools.permutations([1, 2, 3, 4], r) for path in [(0, *mid, 5)] if all(p in cost for p in zip(path, path[1:])))
        assert [c for c, _ in kernels.k_paths(g, 0, 5, 6)] == pytest.approx(every[:6])
