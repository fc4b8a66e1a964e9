"""Communities. All are numbered from 0: greedy ones by size, then least node; others by least node."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from . import kernels
from .common import KERNEL_EDGES, Csr, TooLarge, both_ways, cut, edges, one_group, placed, simple, small, vertices
from .components import components
from .structure import forest, thinned
from .traverse import numbered


def _by_kernel(graph: PropertyGraph, rel_type: str | None, weight_key: str | None, kernel: Callable) -> DataFrame:
    """``node_id, root``: communities from a kernel over the simple graph; nodes without edges are their own."""
    e = simple(edges(graph, rel_type, weight_key))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf["src"].to_numpy(np.int64), pdf["dst"].to_numpy(np.int64)
        ids = np.unique(np.concatenate([a, b]))
        order = np.lexsort((b, a))
        group = kernel(len(ids), list(zip(np.searchsorted(ids, a[order]).tolist(), np.searchsorted(ids, b[order]).tolist(), pdf["weight"].to_numpy(float)[order].tolist())))
        least: dict[int, int] = {}
        for i, c in enumerate(group):
            least.setdefault(c, int(ids[i]))
        return pd.DataFrame({"n": ids, "root": [least[c] for c in group]}).astype({"n": "int64", "root": "int64"})

    found = one_group(e, run, "n long, root long")
    return vertices(graph, rel_type).join(found, F.col("node_id") == F.col("n"), "left").select("node_id", F.coalesce("root", "node_id").alias("root"))


def _component_of(e: DataFrame, bound: int) -> DataFrame:
    """``node, root`` as ``components`` gives them, from a forest in each task's edges; of up to ``bound`` edges left in one task."""
    left = cut(thinned(e.select("src", "dst"), keep=forest))
    if not small(left, bound):
        return components(left, "src", "dst")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches), schema=pa.schema([("src", pa.int64()), ("dst", pa.int64())]))
        nodes, at = np.unique(np.concatenate([rows["src"].to_numpy(), rows["dst"].to_numpy()]), return_inverse=True)
        root = kernels.spanning(len(nodes), at[: rows.num_rows], at[rows.num_rows :])[0]
        yield from pa.table({"node": nodes, "root": nodes[root]}).to_batches(100_000)

    return left.repartition(1).mapInArrow(run, "node long, root long")


def _by_component(graph: PropertyGraph, rel_type: str | None, e: DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame], bound: int) -> DataFrame | None:
    """``node_id, root`` from ``run`` over the simple edges ``e``, which are read more than once, of each component, ``n, root``; None if one has over ``bound`` edges.

    Components are dealt to a number of tasks of their own: small rows of much work would else share a task.
    """
    found = cut(_component_of(e, bound)).select(F.col("node").alias("src"), F.col("root").alias("part"))
    sizes = e.groupBy("src").agg(F.count("*").alias("m")).join(found, "src").groupBy("part").agg(F.sum("m").alias("m"))
    if not sizes.filter(F.col("m") > bound).isEmpty():
        return None
    tasks = 16 * e.sparkSession.sparkContext.defaultParallelism
    rows = e.join(found, "src").repartition(tasks, "part").groupBy("part").applyInPandas(run, "n long, root long")
    rows = cut(rows.withColumnRenamed("n", "node_id"))  # numbering reads them three times
    alone = vertices(graph) if rel_type is None else edges(graph, rel_type).filter("src = dst").select(F.col("src").alias("node_id")).distinct()
    return rows.unionByName(alone.join(rows, "node_id", "left_anti").select("node_id", F.col("node_id").alias("root")))


def _least(ids: np.ndarray, group: np.ndarray) -> pd.DataFrame:
    """``n, root``: of each node the least of its group."""
    _, first, at = np.unique(group, return_index=True, return_inverse=True)
    return pd.DataFrame({"n": ids, "root": ids[first][at]}).astype({"n": "int64", "root": "int64"})


def community_detection(graph: PropertyGraph, rel_type: str | None = None, weight_key: str | None = None, bound: int = KERNEL_EDGES) -> DataFrame:
    """``node_id, component``: communities by local moves; ties go to the lesser community, so runs agree.

    Components only share the graph's whole weight, so each is a task's work.
    """
    e = cut(simple(edges(graph, rel_type, weight_key)).select("src", "dst", "weight"))
    total = e.agg(F.sum("weight")).first()[0] or 0.0

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf["src"].to_numpy(np.int64), pdf["dst"].to_numpy(np.int64)
        ids = np.unique(np.concatenate([a, b]))
        order = np.lexsort((b, a))
        links = list(zip(np.searchsorted(ids, a[order]).tolist(), np.searchsorted(ids, b[order]).tolist(), pdf["weight"].to_numpy(float)[order].tolist()))
        return _least(ids, np.array(kernels.local_moves(len(ids), links, total)))

    found = _by_component(graph, rel_type, e, run, bound)
    if found is None:
        raise TooLarge(f"a component of over {bound} edges")
    return numbered(found)


def greedy_modularity_communities(graph: PropertyGraph, rel_type: str | None = None) -> DataFrame:
    """``node_id, component`` by greedy merging, the largest first."""
    found = cut(_by_kernel(graph, rel_type, None, kernels.modularity_merge))
    sizes = found.groupBy("root").agg(F.count("*").alias("size"))
    order = placed(sizes, F.desc("size"), F.col("root")).select("root", F.col("place").alias("component"))
    return found.join(order, "root").select("node_id", "component")


def modularity(graph: PropertyGraph, communities: DataFrame, rel_type: str | None = None) -> float:
    """Modularity of ``node_id, component`` over the simple graph."""
    e = simple(edges(graph, rel_type))
    c = communities.select(F.col("node_id").alias("n"), F.col("component").alias("c"))
    m = e.count()
    if not m:
        return 0.0
    inside = e.join(c.select(F.col("n").alias("src"), F.col("c").alias("c1")), "src").join(c.select(F.col("n").alias("dst"), F.col("c").alias("c2")), "dst").filter("c1 = c2").count()
    degree = both_ways(e).join(c.select(F.col("n").alias("src"), "c"), "src").groupBy("c").agg((F.count("*") / (2 * m)).alias("a"))
    return inside / m - float(degree.agg(F.sum(F.col("a") * F.col("a"))).first()[0])


def label_propagation_communities(graph: PropertyGraph, rel_type: str | None = None, rounds: int | None = None, bound: int = KERNEL_EDGES) -> DataFrame:
    """``node_id, component``: nodes take the label most of their neighbours have, of equal ones their own if it is among them, else the greatest.

    Of neighbours that want to move in one round only the one of least hash of id and round does, so
    every move makes more edges join equal labels, and it ends: when no node wants another label, or after
    ``rounds`` rounds if that is given. A component is a task's work; if one has over ``bound`` edges, rounds
    are joins over the whole graph, with the same labels.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf["src"].to_numpy(np.int64), pdf["dst"].to_numpy(np.int64)
        g = Csr(np.concatenate([a, b]), np.concatenate([a, b]), np.concatenate([b, a]))
        return _least(g.nodes, kernels.shared_labels(g, rounds))

    once = cut(simple(edges(graph, rel_type)).select("src", "dst"))
    if (found := _by_component(graph, rel_type, once, run, bound)) is not None:
        return numbered(found)
    e = cut(both_ways(once))
    state = cut(vertices(graph, rel_type).select("node_id", F.col("node_id").alias("label")))
    for turn in itertools.count() if rounds is None else range(rounds):
        votes = e.join(state, F.col("dst") == F.col("node_id")).groupBy("src", "label").agg(F.count("*").alias("n"))
        own = state.select(F.col("node_id").alias("src"), F.col("label").alias("own"))
        best = votes.join(own, "src").groupBy("src").agg(F.max(F.struct("n", (F.col("label") == F.col("own")).alias("same"), "label")).alias("b")).select("src", F.col("b.label").alias("new"))
        rank = F.struct(F.xxhash64("node_id", F.lit(turn)), "node_id")
        wants = cut(state.join(best, F.col("node_id") == F.col("src")).filter("new <> label").select("node_id", "new", rank.alias("rank")))
        if wants.isEmpty():
            break
        x, y = (wants.select(F.col("node_id").alias(side), F.col("rank").alias(f"rank_{side}")) for side in ("src", "dst"))
        waits = e.join(x, "src").join(y, "dst").filter("rank_dst < rank_src").select(F.col("src").alias("node_id")).distinct()
        moves = wants.join(waits, "node_id", "left_anti").select("node_id", "new")
        state = cut(state.join(moves, "node_id", "left").select("node_id", F.coalesce("new", "label").alias("label")))
    roots = state.groupBy("label").agg(F.min("node_id").alias("root"))
    return numbered(state.join(roots, "label").select("node_id", "root"))
