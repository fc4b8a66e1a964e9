"""Centralities: degree, PageRank, betweenness of nodes and edges, closeness, and rankings on them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import PropertyGraph, col
from . import kernels
from .common import KERNEL_EDGES, Csr, both_ways, collected, cut, directed_simple, edges, number, over_sources, simple, small, vertices
from .structure import simple_degree
from .traverse import all_pairs_reach


def degree_centrality(graph: PropertyGraph, rel_type: str | None = None) -> DataFrame:
    """``node_id, centrality``: neighbours over the most possible."""
    n = vertices(graph, rel_type).count()
    d = simple_degree(graph, rel_type)
    return d.select("node_id", (F.col("degree") / F.lit(float(max(n - 1, 1))) if n > 1 else F.lit(1.0)).alias("centrality"))


def pagerank(graph: PropertyGraph, rel_type: str | None = None, damping: float = 0.85, max_iter: int = 100, tol: float = 1e-6, weight_key: str | None = None, rounds: int | None = None) -> DataFrame:
    """``node_id, rank``. Parallel relationships count as often as they are; dead ends give to all alike.

    With ``weight_key`` the graph is simple and shares follow weights. ``rounds`` fixes the number of
    rounds. Out-of-range parameters fall back to their defaults.
    """
    damping = damping if 0 < damping < 1 else 0.85
    max_iter = max_iter if max_iter > 0 else 100
    tol = tol if tol > 0 else 1e-6
    e = edges(graph, rel_type, weight_key)
    e = directed_simple(e) if weight_key else e
    out = e.groupBy("src").agg(F.sum("weight").alias("total"))
    shares = cut(e.groupBy("src", "dst").agg(F.sum("weight").alias("w")).join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("share")))
    nodes = vertices(graph, rel_type).join(out.select(F.col("src").alias("node_id"), F.lit(False).alias("dead")), "node_id", "left")
    nodes = nodes.select("node_id", F.coalesce("dead", F.lit(True)).alias("dead"))
    n = nodes.count()
    if not n:
        return nodes.select("node_id", F.lit(0.0).alias("rank"))
    state = cut(nodes.withColumn("rank", F.lit(1.0 / n)))
    lost = nodes.filter("dead").count() / n
    for _ in range(rounds or max_iter):
        got = shares.join(state, F.col("src") == F.col("node_id")).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        new = F.lit((1 - damping) / n + damping * lost / n) + damping * F.coalesce("got", F.lit(0.0))
        after = cut(state.join(got, F.col("node_id") == F.col("dst"), "left").select("node_id", "dead", new.alias("rank"), F.abs(new - F.col("rank")).alias("step")))
        moved, lost = after.agg(F.sum("step"), F.coalesce(F.sum(F.when(F.col("dead"), F.col("rank"))), F.lit(0.0))).first()
        state = after.drop("step")
        if rounds is None and moved < tol:
            break
    return state.select("node_id", "rank")


def _dependencies(nodes: DataFrame, e: DataFrame, weighted: bool, of_edges: bool, bound: int) -> DataFrame:
    """Sums of dependencies over all sources: ``node_id, value``, or ``src, dst, value`` for stored directions.

    Without weights and parallel edges, nodes on long chains are no sources of their own: their ends' searches serve them all.
    """
    if not (small(e, bound) and small(nodes, bound)):
        if weighted:
            from .common import TooLarge

            raise TooLarge("weighted betweenness of a graph over the kernel's bound")
        return _dependencies_by_level(nodes, e, of_edges)
    e = e if weighted else e.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))  # parallel edges are ways
    g = collected(nodes, e, bound)
    keys = ["src", "dst"] if of_edges else ["node_id"]
    schema = ", ".join(f"{k} long" for k in keys) + ", value double"
    ways, own, left = kernels.sources_by_chains(g) if not weighted and (g.weight == 1).all() else ([], np.zeros((0, 2), bool), np.arange(g.n))

    def kernel(g: Csr, sources: np.ndarray) -> Iterator[dict[str, np.ndarray]]:
        if weighted:
            lists, value = (g.first.tolist(), g.to.tolist(), g.weight.tolist()), np.zeros(len(g.to) if of_edges else g.n)
            for s in sources:
                value += kernels.weighted_dependencies(g, int(s), lists)[of_edges]
        else:
            at = sources[sources < len(ways)]
            value = kernels.chain_dependencies(g, [ways[i] for i in at], own[at], of_edges)
            value += kernels.dependencies(g, left[sources[sources >= len(ways)] - len(ways)], of_edges)
        if of_edges:
            yield {"src": np.repeat(g.nodes, np.diff(g.first)), "dst": g.nodes[g.to], "value": value}
        else:
            yield {"node_id": g.nodes, "value": value}

    parts = over_sources(nodes.sparkSession, g, kernel, schema, len(ways) + len(left))
    return parts.groupBy(*keys).agg(F.sum("value").alias("value"))


def _dependencies_by_level(nodes: DataFrame, e: DataFrame, of_edges: bool) -> DataFrame:
    """The same for any size: levels of all sources go forward together, counting ways, then back, summing dependencies."""
    step = cut(e.filter("src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("ways")))
    level = cut(nodes.select(F.col("node_id").alias("s"), F.col("node_id").alias("v"), F.lit(1.0).alias("sigma")))
    levels, seen = [level], level.select("s", "v")
    while True:
        sent = level.join(step, F.col("v") == F.col("src")).groupBy("s", F.col("dst").alias("w")).agg(F.sum(F.col("sigma") * F.col("ways")).alias("sigma"))
        level = cut(sent.withColumnRenamed("w", "v").join(seen, ["s", "v"], "left_anti"))
        if level.isEmpty():
            break
        levels.append(level)
        seen = seen.unionByName(level.select("s", "v"))
    after = levels[-1].select("s", "v", "sigma", F.lit(0.0).alias("d"))
    parts = []
    for upper in levels[-2::-1]:
        lower = after.select(F.col("s").alias("s2"), F.col("v").alias("w"), F.col("sigma").alias("sw"), F.col("d").alias("dw"))
        flow = upper.join(step, F.col("v") == F.col("src")).join(lower, (F.col("s") == F.col("s2")) & (F.col("dst") == F.col("w")))
        flow = flow.select("s", "v", "w", (F.col("sigma") * F.col("ways") / F.col("sw") * (1 + F.col("dw"))).alias("x"))
        if of_edges:
            parts.append(flow.groupBy(F.col("v").alias("src"), F.col("w").alias("dst")).agg(F.sum("x").alias("value")))
        summed = flow.groupBy("s", "v").agg(F.sum("x").alias("x"))
        after = cut(upper.join(summed, ["s", "v"], "left").select("s", "v", "sigma", F.coalesce("x", F.lit(0.0)).alias("d")))
        if not of_edges:
            parts.append(after.filter("s <> v").groupBy(F.col("v").alias("node_id")).agg(F.sum("d").alias("value")))
    keys = ["src", "dst"] if of_edges else ["node_id"]
    if not parts:
        return (e.select("src", "dst") if of_edges else nodes.select("node_id")).limit(0).withColumn("value", F.lit(0.0))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*keys).agg(F.sum("value").alias("value"))


def betweenness_centrality(graph: PropertyGraph, rel_type: str | None = None, normalized: bool = True, weight_key: str | None = None, multigraph: bool | None = None, bound: int = KERNEL_EDGES) -> DataFrame:
    """``node_id, betweenness`` of the undirected graph.

    Without weights parallel relationships are ways of their own; ``multigraph=False`` and weighted
    graphs are simple. Normalised by (n - 1)(n - 2); else each pair counts once.
    """
    e = edges(graph, rel_type, weight_key).filter("src <> dst")
    e = simple(e) if weight_key or multigraph is False else e
    nodes = vertices(graph, rel_type)
    n = nodes.count()
    sums = _dependencies(nodes, both_ways(e), weight_key is not None, False, bound)
    scale = (1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0) if normalized else 0.5
    return nodes.join(sums, "node_id", "left").select("node_id", (F.coalesce("value", F.lit(0.0)) * scale).alias("betweenness"))


def edge_betweenness_centrality(graph: PropertyGraph, rel_type: str | None = None, bound: int = KERNEL_EDGES) -> DataFrame:
    """``src, dst, betweenness`` of the simple undirected graph, src < dst, normalised by n (n - 1)."""
    e = simple(edges(graph, rel_type))
    nodes = vertices(graph, rel_type)
    n = nodes.count()
    sums = _dependencies(nodes, both_ways(e), False, True, bound)
    sums = sums.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("value").alias("value"))
    scale = 1.0 / (n * (n - 1)) if n > 1 else 1.0
    return e.select("src", "dst").join(sums, ["src", "dst"], "left").select("src", "dst", (F.coalesce("value", F.lit(0.0)) * scale).alias("betweenness"))


def closeness_centrality(graph: PropertyGraph, rel_type: str | None = None, weight_key: str | None = None, bound: int = KERNEL_EDGES) -> DataFrame:
    """``node_id, closeness``, scaled by the share of nodes that are reached."""
    nodes = vertices(graph, rel_type)
    n = nodes.count()
    sums = all_pairs_reach(graph, rel_type, weight_key, bound).select("node_id", F.col("reached").alias("r"), "total")
    value = F.when(F.col("total") > 0, (F.col("r") - 1) / F.lit(float(max(n - 1, 1))) * ((F.col("r") - 1) / F.col("total"))).otherwise(0.0)
    return nodes.join(sums, "node_id", "left").select("node_id", F.coalesce(value, F.lit(0.0)).alias("closeness"))


def bess_siting_ranking(graph: PropertyGraph, rel_type: str | None = "LINE", weight_key: str | None = "x_pu", n: int = 10) -> DataFrame:
    """``node_id, score``: the n best by half closeness, half betweenness."""
    known = graph.rel_props([rel_type] if rel_type else [])
    key = weight_key if weight_key in known else None
    both = closeness_centrality(graph, rel_type, key).join(betweenness_centrality(graph, rel_type, True, key, multigraph=False), "node_id")
    return both.select("node_id", (0.5 * F.col("closeness") + 0.5 * F.col("betweenness")).alias("score")).orderBy(F.desc("score"), "node_id").limit(n)


bess_placement_ranking = bess_siting_ranking


def congestion_risk(graph: PropertyGraph, rel_type: str | None = None) -> DataFrame:
    """``rel_id, src, dst, betweenness``: each relationship with its pair's edge betweenness, greatest first."""
    b = edge_betweenness_centrality(graph, rel_type).withColumnRenamed("src", "u").withColumnRenamed("dst", "v")
    e = edges(graph, rel_type).join(b, (F.least("src", "dst") == F.col("u")) & (F.greatest("src", "dst") == F.col("v")))
    return e.select("rel_id", "src", "dst", "betweenness").orderBy(F.desc("betweenness"), "rel_id")


def vulnerability_index(graph: PropertyGraph, rel_type: str | None = None, rating_keys: tuple[str, ...] = ("rate_A_MVA", "rate_mva")) -> DataFrame:
    """``rel_id, src, dst, vulnerability``: edge betweenness over rating, rounded to 6 places, greatest first."""
    types = [rel_type] if rel_type else []
    known = graph.rel_props(types)
    keys = [k for k in rating_keys if k in known]
    rating = F.lit(1.0)
    if keys:
        first = F.coalesce(*[col(k).try_cast("double") if known[k].simpleString() == "string" else col(k).cast("double") for k in keys])
        rating = number(first, known[keys[0]] if known[keys[0]].simpleString() != "string" else graph.spark.range(1).schema[0].dataType)
    view = graph.rel_view(types, keys).select(F.col("id").alias("rel_id"), rating.alias("rating"))
    rows = congestion_risk(graph, rel_type).join(view, "rel_id")
    return rows.select("rel_id", "src", "dst", F.round(F.col("betweenness") / F.col("rating"), 6).alias("vulnerability")).orderBy(F.desc("vulnerability"), "rel_id")
