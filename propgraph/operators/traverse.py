"""Reachability: components, breadth-first and weighted shortest paths, all pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from . import kernels
from .common import KERNEL_EDGES, Csr, both_ways, collected, cut, edges, over_sources, placed, simple, small, vertices
from .components import components

PATH = "array<struct<node_id: bigint, rel_id: bigint>>"


def numbered(found: DataFrame, node: str = "node_id", root: str = "root") -> DataFrame:
    """``node_id, component``: components numbered from 0 by their least node."""
    order = placed(found.select(root).distinct(), F.col(root)).withColumnRenamed("place", "component")
    return found.join(order, root).select(F.col(node).alias("node_id"), "component")


def roots(graph: PropertyGraph, rel_type: str | None = None) -> DataFrame:
    """``node_id, root``: the least node of each node's weak component."""
    found = components(edges(graph, rel_type), "src", "dst")
    return vertices(graph, rel_type).join(found, F.col("node_id") == F.col("node"), "left").select("node_id", F.coalesce("root", "node_id").alias("root"))


def connected_components(graph: PropertyGraph, rel_type: str | None = None) -> DataFrame:
    """``node_id, component`` of weak components."""
    return numbered(roots(graph, rel_type))


def component_sizes(graph: PropertyGraph, rel_type: str | None = None) -> DataFrame:
    """``size, components``: how many components have each size."""
    sizes = roots(graph, rel_type).groupBy("root").agg(F.count("*").alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("components"))


def is_connected(graph: PropertyGraph, rel_type: str | None = None) -> bool:
    return roots(graph, rel_type).select("root").distinct().limit(2).count() == 1


def strongly_connected_components(graph: PropertyGraph, rel_type: str | None = None) -> DataFrame:
    """``node_id, component``: numbered by least node.

    Colouring: the least node that reaches each node spreads forward; what reaches that node
    backward within its colour is its component, and leaves. Nodes without edges in or out leave
    first, each its own component.
    """
    left = cut(edges(graph, rel_type).select("src", "dst").filter("src <> dst").distinct())
    found = []
    todo = cut(vertices(graph, rel_type))
    while True:
        # nodes on no cycle have no edge in or none out
        while True:
            trim = todo.join(left.select(F.col("src").alias("node_id")).distinct(), "node_id", "left_semi").join(left.select(F.col("dst").alias("node_id")).distinct(), "node_id", "left_semi")
            trim = cut(trim)
            gone = todo.join(trim, "node_id", "left_anti")
            if gone.isEmpty():
                break
            found.append(gone.select("node_id", F.col("node_id").alias("root")))
            todo = trim
            left = cut(left.join(todo, F.col("src") == F.col("node_id"), "left_semi").join(todo, F.col("dst") == F.col("node_id"), "left_semi"))
        if todo.isEmpty():
            break
        colour = _spread(todo.select("node_id", F.col("node_id").alias("colour")), left)
        same = left.join(colour.withColumnRenamed("node_id", "src").withColumnRenamed("colour", "c1"), "src").join(colour.withColumnRenamed("node_id", "dst").withColumnRenamed("colour", "c2"), "dst").filter("c1 = c2")
        same = cut(same.select("src", "dst"))
        reached = frontier = cut(colour.filter("node_id = colour"))
        while True:
            back = same.join(frontier, F.col("dst") == F.col("node_id")).select(F.col("src").alias("node_id"), "colour").distinct()
            frontier = cut(back.join(reached, ["node_id"], "left_anti"))
            if frontier.isEmpty():
                break
            reached = cut(reached.unionByName(frontier))
        found.append(reached.select("node_id", F.col("colour").alias("root")))
        todo = cut(todo.join(reached, "node_id", "left_anti"))
        left = cut(same.join(todo, F.col("src") == F.col("node_id"), "left_semi").join(todo, F.col("dst") == F.col("node_id"), "left_semi"))
    out = found[0] if found else todo.select("node_id", F.col("node_id").alias("root"))
    for part in found[1:]:
        out = out.unionByName(part)
    return numbered(out)


def _spread(colour: DataFrame, e: DataFrame) -> DataFrame:
    """Least colours carried along edges until nothing changes."""
    colour = cut(colour)
    changed = colour
    while True:
        sent = e.join(changed, F.col("src") == F.col("node_id")).groupBy("dst").agg(F.min("colour").alias("new"))
        after = colour.join(sent, F.col("node_id") == F.col("dst"), "left")
        after = cut(after.select("node_id", F.least("colour", F.coalesce("new", "colour")).alias("colour"), F.coalesce(F.col("new") < F.col("colour"), F.lit(False)).alias("moved")))
        changed = after.filter("moved").select("node_id", "colour")
        colour = after.select("node_id", "colour")
        if changed.isEmpty():
            return colour


def _known(graph: PropertyGraph, rel_type: str | None, *nodes: int) -> None:
    found = {r[0] for r in vertices(graph, rel_type).filter(F.col("node_id").isin(*nodes)).collect()}
    if missing := set(nodes) - found:
        raise ValueError(f"no node {sorted(missing)}")


def dijkstra(graph: PropertyGraph, src: int, rel_type: str | None = None, weight_key: str | None = None) -> DataFrame:
    """``node_id, prev_node_id, prev_rel_id, dist`` from ``src`` along directed edges; -1 where nothing leads.

    Rounds of relaxation: only nodes that came nearer in the last round send. Of equal distances the
    least (previous node, relationship) is named.
    """
    _known(graph, rel_type, src)
    e = edges(graph, rel_type, weight_key)
    if e.filter("weight < 0").limit(1).count():
        raise ValueError("negative weights")
    spark = graph.spark
    state = cut(spark.createDataFrame([(src, 0.0, -1, -1)], "node_id long, dist double, prev long, rel long"))
    moved = state.select("node_id", "dist")
    while not moved.isEmpty():
        sent = e.join(moved, F.col("src") == F.col("node_id")).filter(F.col("dst") != src)
        best = sent.groupBy("dst").agg(F.min(F.struct((F.col("dist") + F.col("weight")).alias("dist"), F.col("src").alias("prev"), F.col("rel_id").alias("rel"))).alias("b"))
        best = best.select("dst", F.col("b.dist").alias("d"), F.col("b.prev").alias("p"), F.col("b.rel").alias("r"))
        joined = state.join(best, F.col("node_id") == F.col("dst"), "full")
        better = F.col("d").isNotNull() & (F.col("dist").isNull() | (F.struct("d", "p", "r") < F.struct("dist", "prev", "rel")))
        nearer = F.col("d").isNotNull() & (F.col("dist").isNull() | (F.col("d") < F.col("dist")))
        state = cut(
            joined.select(
                F.coalesce("node_id", "dst").alias("node_id"),
                F.when(better, F.col("d")).otherwise(F.col("dist")).alias("dist"),
                F.when(better, F.col("p")).otherwise(F.col("prev")).alias("prev"),
                F.when(better, F.col("r")).otherwise(F.col("rel")).alias("rel"),
                nearer.alias("moved"),
            )
        )
        moved = state.filter("moved").select("node_id", "dist")
        state = state.drop("moved")
    rows = vertices(graph, rel_type).join(state, "node_id", "left")
    minus = F.lit(-1).cast("long")
    return rows.select("node_id", F.coalesce("prev", minus).alias("prev_node_id"), F.coalesce("rel", minus).alias("prev_rel_id"), F.coalesce("dist", F.lit(-1.0)).alias("dist"))


def bfs_levels(graph: PropertyGraph, src: int, rel_type: str | None = None, max_hops: int | None = None) -> DataFrame:
    """``node_id, level, path``: nodes that directed edges lead to, with one shortest path each."""
    e = edges(graph, rel_type)
    done = cut(graph.spark.createDataFrame([(src, 0, [(src, -1)])], f"node_id long, level int, path {PATH}"))
    last, level = done, 0
    while max_hops is None or level < max_hops:
        level += 1
        step = e.join(last, F.col("src") == F.col("node_id")).select("dst", "src", "rel_id", "path")
        new = step.join(done.select(F.col("node_id").alias("dst")), "dst", "left_anti")
        new = new.groupBy("dst").agg(F.min_by("path", F.struct("src", "rel_id")).alias("path"), F.min(F.struct("src", "rel_id")).alias("via"))
        last = cut(new.select(F.col("dst").alias("node_id"), F.lit(level).alias("level"), F.concat("path", F.array(F.struct(F.col("dst").alias("node_id"), F.col("via.rel_id").alias("rel_id")))).alias("path")))
        if last.isEmpty():
            break
        done = done.unionByName(last)
    return done


def shortest_path(graph: PropertyGraph, src: int, dst: int, rel_type: str | None = None) -> list[dict] | None:
    """Steps ``{node_id, rel_id}`` from ``src`` to ``dst`` by fewest directed edges; None if nothing leads or both are one."""
    if src == dst:
        return None
    rows = bfs_levels(graph, src, rel_type).filter(F.col("node_id") == dst).select("path").collect()
    return [s.asDict() for s in rows[0]["path"]] if rows else None


def all_pairs_hops(graph: PropertyGraph, rel_type: str | None = None, weight_key: str | None = None, bound: int | None = None) -> DataFrame:
    """``src, dst, dist`` of all pairs that undirected edges join, each node to itself at 0.

    With a graph that fits a worker, one pass over the sources with the graph shared; else rounds of
    relaxation over all pairs.
    """
    e = simple(edges(graph, rel_type, weight_key))
    nodes = vertices(graph, rel_type)
    return distances(nodes, both_ways(e), weight_key is not None, bound)


def distances(nodes: DataFrame, e: DataFrame, weighted: bool, bound: int | None = None) -> DataFrame:
    bound = KERNEL_EDGES if bound is None else bound
    if small(e, bound) and small(nodes, bound):

        def kernel(g: Csr, sources: np.ndarray) -> Iterator[dict[str, np.ndarray]]:
            lists = (g.first.tolist(), g.to.tolist(), g.weight.tolist()) if weighted else None
            for i in range(0, len(sources), size := max(1, min(64, 20_000_000 // max(1, g.n)))):
                part = sources[i : i + size]
                for s, d in zip(part, (kernels.dijkstra(g, int(s), lists) for s in part) if weighted else kernels.hops(g, part)):
                    at = np.flatnonzero(np.isfinite(d) if weighted else d >= 0)
                    yield {"src": np.full(len(at), g.nodes[s]), "dst": g.nodes[at], "dist": d[at].astype(float)}

        return over_sources(nodes.sparkSession, collected(nodes, e, bound), kernel, "src long, dst long, dist double")
    state = cut(nodes.select(F.col("node_id").alias("src"), F.col("node_id").alias("dst"), F.lit(0.0).alias("dist")))
    moved = state
    step = e.select(F.col("src").alias("at"), F.col("dst").alias("next"), "weight" if weighted else F.lit(1.0).alias("weight"))
    while not moved.isEmpty():
        sent = moved.join(step, F.col("dst") == F.col("at")).groupBy("src", "next").agg(F.min(F.col("dist") + F.col("weight")).alias("new"))
        joined = state.join(sent.select("src", F.col("next").alias("dst"), "new"), ["src", "dst"], "full")
        better = F.col("new").isNotNull() & (F.col("dist").isNull() | (F.col("new") < F.col("dist")))
        after = cut(joined.select("src", "dst", F.when(better, F.col("new")).otherwise(F.col("dist")).alias("dist"), better.alias("moved")))
        moved, state = after.filter("moved").drop("moved"), after.drop("moved")
    return state


def reach(nodes: DataFrame, e: DataFrame, weighted: bool = False, bound: int | None = None) -> DataFrame:
    """``node_id, reached, total, farthest``: how many nodes each reaches, itself included, the sum of its distances and the greatest.

    Without weights, in a graph that fits a worker, bits of 64 sources spread at once and no pair becomes
    a row; else the rows of ``distances`` are summed up.
    """
    bound = KERNEL_EDGES if bound is None else bound
    if weighted or not (small(e, bound) and small(nodes, bound)):
        return distances(nodes, e, weighted, bound).groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("reached"), F.sum("dist").alias("total"), F.max("dist").alias("farthest"))

    def kernel(g: Csr, sources: np.ndarray) -> Iterator[dict[str, np.ndarray]]:
        reached, total, farthest = kernels.reach(g, sources)
        at = np.flatnonzero(reached)
        yield {"node_id": g.nodes[at], "reached": reached[at], "total": total[at], "farthest": farthest[at]}

    parts = over_sources(nodes.sparkSession, collected(nodes, e, bound), kernel, "node_id long, reached long, total long, farthest long")
    return parts.groupBy("node_id").agg(F.sum("reached").alias("reached"), F.sum("total").cast("double").alias("total"), F.max("farthest").cast("double").alias("farthest"))


def all_pairs_reach(graph: PropertyGraph, rel_type: str | None = None, weight_key: str | None = None, bound: int | None = None) -> DataFrame:
    """``reach`` over the simple undirected graph."""
    return reach(vertices(graph, rel_type), both_ways(simple(edges(graph, rel_type, weight_key))), weight_key is not None, bound)
