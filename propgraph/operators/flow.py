"""Flows, cuts, loopless paths and connectivity.

These build on one another step by step, so they run in one task: first the graph is pruned to what
lies between source and target, by joins, and a bound guards what is left.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from . import kernels
from .common import Csr, both_ways, cut, directed_simple, edges, one_group, simple, vertices
from .traverse import _known, is_connected


def reach(e: DataFrame, start: int, forward: bool = True) -> DataFrame:
    """``node_id``: nodes that ``start`` reaches (or that reach it)."""
    a, b = ("src", "dst") if forward else ("dst", "src")
    done = last = cut(e.sparkSession.createDataFrame([(start,)], "node_id long"))
    while True:
        new = e.join(last, F.col(a) == F.col("node_id")).select(F.col(b).alias("n")).distinct()
        last = cut(new.join(done, F.col("n") == F.col("node_id"), "left_anti").select(F.col("n").alias("node_id")))
        if last.isEmpty():
            return done
        done = cut(done.unionByName(last))


def between(e: DataFrame, s: int, t: int) -> DataFrame:
    """The edges on some way from s to t."""
    near, far = reach(e, s), reach(e, t, False)
    return e.join(near, F.col("src") == F.col("node_id"), "left_semi").join(far, F.col("dst") == F.col("node_id"), "left_semi")


def _flow(pdf: pd.DataFrame, s: int, t: int) -> tuple[kernels.Flow, np.ndarray, int, float]:
    ids = np.unique(np.concatenate([pdf["src"].to_numpy(np.int64), pdf["dst"].to_numpy(np.int64), [s, t]]))
    a, b = np.searchsorted(ids, pdf["src"].to_numpy(np.int64)), np.searchsorted(ids, pdf["dst"].to_numpy(np.int64))
    net = kernels.Flow(len(ids), list(zip(a.tolist(), b.tolist(), pdf["weight"].tolist())))
    source = int(np.searchsorted(ids, s))
    value = net.run(source, int(np.searchsorted(ids, t)))
    return net, ids, source, value


def max_flow(graph: PropertyGraph, src: int, dst: int, rel_type: str | None = None, capacity_key: str | None = None) -> float:
    """Greatest flow along directed relationships; parallel capacities add, those not positive count 1."""
    _known(graph, rel_type, src, dst)
    if src == dst:
        return 0.0
    e = between(edges(graph, rel_type, capacity_key, positive=True), src, dst)
    return float(one_group(e, lambda pdf: pd.DataFrame({"value": [_flow(pdf, src, dst)[3]]}), "value double").first()[0])


def flow_edges(graph: PropertyGraph, src: int, dst: int, rel_type: str | None = None, capacity_key: str | None = "rate_mva") -> DataFrame:
    """``src, dst, flow`` of one greatest flow in the simple directed graph."""
    _known(graph, rel_type, src, dst)
    e = between(directed_simple(edges(graph, rel_type, capacity_key, positive=True)), src, dst)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        net, ids, _, _ = _flow(pdf, src, dst)
        rows = [(int(ids[a]), int(ids[b]), f) for a, b, f in net.flows()]
        return pd.DataFrame(rows, columns=["src", "dst", "flow"]).astype({"src": "int64", "dst": "int64", "flow": float})

    return one_group(e, run, "src long, dst long, flow double")


def min_cut(graph: PropertyGraph, src: int, dst: int, rel_type: str | None = None, capacity_key: str | None = "rate_mva") -> tuple[float, DataFrame]:
    """The cut's value, and ``node_id, side`` (S or T) of every node."""
    _known(graph, rel_type, src, dst)
    e = directed_simple(edges(graph, rel_type, capacity_key, positive=True))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        net, ids, source, value = _flow(pdf, src, dst)
        side = sorted(net.source_side(source))
        return pd.DataFrame({"node_id": ids[side], "value": value}).astype({"node_id": "int64", "value": float})

    found = cut(one_group(e, run, "node_id long, value double"))
    sides = vertices(graph, rel_type).join(found.select("node_id", F.lit("S").alias("side")), "node_id", "left")
    return float(found.first()["value"]), sides.select("node_id", F.coalesce("side", F.lit("T")).alias("side"))


def k_shortest_paths(graph: PropertyGraph, src: int, dst: int, k: int = 3, rel_type: str | None = None, weight_key: str | None = None, directed: bool = True) -> DataFrame:
    """``rank, nodes, rels, cost`` of the k cheapest loopless paths; weights that are not positive count 1."""
    _known(graph, rel_type, src, dst)
    e = edges(graph, rel_type, weight_key, positive=True)
    e = e if directed else both_ways(simple(e))
    e = between(e, src, dst)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf["src"].to_numpy(np.int64), pdf["dst"].to_numpy(np.int64)
        g = Csr(np.concatenate([a, b, [src, dst]]), a, b, pdf["weight"].to_numpy(float), pdf["rel_id"].to_numpy(np.int64))
        cheapest = {}
        for x, y, w, r in sorted(zip(a.tolist(), b.tolist(), pdf["weight"].tolist(), pdf["rel_id"].tolist())):
            cheapest[x, y] = min((w, r), cheapest.get((x, y), (np.inf, -1)))
        rows = []
        for rank, (cost, path) in enumerate(kernels.k_paths(g, g.place(src), g.place(dst), k), 1):
            nodes = [int(g.nodes[p]) for p in path]
            rows.append((rank, nodes, [cheapest[x][1] for x in zip(nodes, nodes[1:])], cost))
        return pd.DataFrame(rows, columns=["rank", "nodes", "rels", "cost"])

    return one_group(e, run, "rank int, nodes array<bigint>, rels array<bigint>, cost double")


def edge_connectivity(graph: PropertyGraph, rel_type: str | None = None) -> int:
    """Fewest edges of the simple undirected graph whose loss splits it; 0 if it is split or trivial."""
    return _connectivity(graph, rel_type, False)


def node_connectivity(graph: PropertyGraph, rel_type: str | None = None) -> int:
    return _connectivity(graph, rel_type, True)


def _connectivity(graph: PropertyGraph, rel_type: str | None, of_nodes: bool) -> int:
    if not is_connected(graph, rel_type):
        return 0
    e = simple(edges(graph, rel_type))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.concatenate([pdf["src"].to_numpy(np.int64), pdf["dst"].to_numpy(np.int64)]))
        pairs = list(zip(np.searchsorted(ids, pdf["src"]).tolist(), np.searchsorted(ids, pdf["dst"]).tolist()))
        kernel = kernels.node_connectivity if of_nodes else kernels.edge_connectivity
        return pd.DataFrame({"k": [kernel(len(ids), pairs) if len(ids) > 1 else 0]})

    rows = one_group(e, run, "k long").collect()
    return int(rows[0][0]) if rows else 0
