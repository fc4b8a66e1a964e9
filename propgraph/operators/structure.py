"""Degrees, triangles, bridges and what depends on them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from . import kernels
from .common import KERNEL_EDGES, Csr, TooLarge, both_ways, cut, edges, simple, vertices
from .components import components
from .traverse import is_connected

#: Edges above which cuts are looked for in a thinner graph, and about as many as a task thins at once.
SHARE = 500_000


def degree(graph: PropertyGraph, rel_type: str | None = None) -> DataFrame:
    """``node_id, degree``: ends of relationships at each node; a loop has two."""
    e = edges(graph, rel_type)
    ends = e.select(F.col("src").alias("node_id")).unionByName(e.select(F.col("dst").alias("node_id")))
    counts = ends.groupBy("node_id").agg(F.count("*").alias("degree"))
    if rel_type is not None:
        return counts
    return vertices(graph).join(counts, "node_id", "left").select("node_id", F.coalesce("degree", F.lit(0)).alias("degree"))


def simple_degree(graph: PropertyGraph, rel_type: str | None = None) -> DataFrame:
    """``node_id, degree`` in the simple undirected graph; a loop counts two."""
    e = edges(graph, rel_type)
    pairs = e.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()
    ends = pairs.select(F.col("u").alias("node_id")).unionByName(pairs.select(F.col("v").alias("node_id")))
    counts = ends.groupBy("node_id").agg(F.count("*").alias("degree"))
    return vertices(graph, rel_type).join(counts, "node_id", "left").select("node_id", F.coalesce("degree", F.lit(0)).alias("degree"))


def triangles(graph: PropertyGraph, rel_type: str | None = None) -> DataFrame:
    """``a, b, c`` of each triangle once, ids ascending by (degree, id).

    Edges point from lesser to greater degree, so a hub's neighbours are paired by those with few
    edges and the join stays near the number of edges to the power 3/2.
    """
    e = simple(edges(graph, rel_type)).select("src", "dst")
    ends = e.select(F.col("src").alias("n")).unionByName(e.select(F.col("dst").alias("n"))).groupBy("n").agg(F.count("*").alias("d"))
    ranked = e.join(ends.select(F.col("n").alias("src"), F.col("d").alias("ds")), "src").join(ends.select(F.col("n").alias("dst"), F.col("d").alias("dd")), "dst")
    lesser = F.least(F.struct(F.col("ds").alias("d"), F.col("src").alias("n")), F.struct(F.col("dd").alias("d"), F.col("dst").alias("n")))
    greater = F.greatest(F.struct(F.col("ds").alias("d"), F.col("src").alias("n")), F.struct(F.col("dd").alias("d"), F.col("dst").alias("n")))
    rows = ranked.select(lesser.alias("l"), greater.alias("g")).select(F.col("l.n").alias("x"), F.col("g.n").alias("y"), F.col("g.d").alias("dy"))
    first, second = rows.select(F.col("x").alias("a"), F.col("y").alias("b"), F.col("dy").alias("db")), rows.select(F.col("x").alias("a"), F.col("y").alias("c"), F.col("dy").alias("dc"))
    wedges = first.join(second, "a").filter(F.struct("db", "b") < F.struct("dc", "c"))
    return wedges.join(rows.select(F.col("x").alias("b"), F.col("y").alias("c")), ["b", "c"], "left_semi").select("a", "b", "c")


def triangle_counts(graph: PropertyGraph, rel_type: str | None = None) -> DataFrame:
    """``node_id, triangles``."""
    t = triangles(graph, rel_type)
    each = t.select(F.explode(F.array("a", "b", "c")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("triangles"))
    return vertices(graph, rel_type).join(each, "node_id", "left").select("node_id", F.coalesce("triangles", F.lit(0)).alias("triangles"))


def _wedges(graph: PropertyGraph, rel_type: str | None) -> DataFrame:
    e = both_ways(simple(edges(graph, rel_type)))
    d = e.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("d"))
    t = triangle_counts(graph, rel_type).join(d, "node_id", "left")
    return t.select("node_id", "triangles", (F.coalesce("d", F.lit(0)) * (F.coalesce("d", F.lit(0)) - 1) / 2).alias("triples"))


def clustering_local(graph: PropertyGraph, rel_type: str | None = None) -> DataFrame:
    """``node_id, clustering`` in the simple graph; null under two neighbours."""
    return _wedges(graph, rel_type).select("node_id", F.when(F.col("triples") > 0, F.col("triangles") / F.col("triples")).alias("clustering"))


def clustering_global(graph: PropertyGraph, rel_type: str | None = None) -> float:
    """Closed wedges over all wedges; 0 without wedges."""
    r = _wedges(graph, rel_type).agg(F.sum("triangles"), F.sum("triples")).first()
    return float(r[0]) / float(r[1]) if r[1] else 0.0


def _blocks(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Which edges make a subgraph with the same blocks."""
    at = np.arange(len(src))
    kept = kernels.low_links(Csr(np.concatenate([src, dst]), np.concatenate([src, dst]), np.concatenate([dst, src]), rel=np.concatenate([at, at])))[2]
    return np.sort(np.fromiter(kept, np.int64, len(kept)))


def forest(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Which edges make a subgraph with the same components."""
    nodes, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    return kernels.spanning(len(nodes), at[: len(src)], at[len(src) :])[1]


def thinned(e: DataFrame, share: int = SHARE, keep: Callable[[np.ndarray, np.ndarray], np.ndarray] = _blocks) -> DataFrame:
    """Edges (with ``src, dst``) of a subgraph with the same components, bridges and articulation points; all of them up to ``share``.

    Each task puts a subgraph with the same blocks (``keep``) in place of its part of the edges. Without any node the
    part joins the same nodes as before, so what the whole graph's cuts are does not change, however edges
    are dealt. A round that leaves few fewer edges is followed by one of larger parts. With ``forest`` only the components stay the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(batches)
        if found:
            rows = pa.Table.from_batches(found).combine_chunks()
            yield from rows.take(keep(rows["src"].to_numpy(), rows["dst"].to_numpy())).to_batches(100_000)

    m = e.count()
    while m > share:
        fewer = cut(e.repartitionByRange(-(-m // share), "dst", "src").mapInArrow(run, e.schema))
        before, m, e = m, fewer.count(), fewer
        if m > 0.8 * before:
            share *= 4
        if share > KERNEL_EDGES:
            break
    return e


def _cuts(graph: PropertyGraph, rel_type: str | None, share: int = SHARE) -> DataFrame:
    """``kind, id``: bridges (relationship ids) and articulation points (node ids), component by component.

    A component's edges meet in one task, after thinning them and a check that none has over ``KERNEL_EDGES`` left.
    """
    e = thinned(edges(graph, rel_type).filter("src <> dst").select("src", "dst", "rel_id"), share)
    tagged = cut(both_ways(e).join(components(e, "src", "dst").withColumnRenamed("node", "src"), "src"))
    if not tagged.groupBy("root").count().filter(F.col("count") > 2 * KERNEL_EDGES).isEmpty():
        raise TooLarge(f"a component of over {KERNEL_EDGES} edges")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        src, dst = pdf["src"].to_numpy(np.int64), pdf["dst"].to_numpy(np.int64)
        g = Csr(src, src, dst, rel=pdf["rel_id"].to_numpy(np.int64))
        bridges, points, _ = kernels.low_links(g)
        rows = [("bridge", b) for b in sorted(bridges)] + [("point", int(g.nodes[p])) for p in sorted(points)]
        return pd.DataFrame(rows, columns=["kind", "id"]).astype({"kind": "object", "id": "int64"})

    return tagged.groupBy("root").applyInPandas(run, "kind string, id long")


def find_bridges(graph: PropertyGraph, rel_type: str | None = None) -> DataFrame:
    """``rel_id`` of relationships whose loss splits their component; parallel ones are none."""
    return _cuts(graph, rel_type).filter("kind = 'bridge'").select(F.col("id").alias("rel_id"))


def find_articulation_points(graph: PropertyGraph, rel_type: str | None = None) -> DataFrame:
    return _cuts(graph, rel_type).filter("kind = 'point'").select(F.col("id").alias("node_id"))


def n1_is_critical(graph: PropertyGraph, rel_id: int) -> bool:
    """Whether the graph of all types is in more than one piece without this relationship."""
    if not graph.rel_view((), ()).filter(F.col("id") == rel_id).limit(1).count():
        raise ValueError(f"no relationship {rel_id}")
    if not is_connected(graph):
        return True
    return find_bridges(graph).filter(F.col("rel_id") == rel_id).limit(1).count() > 0


def n1_table(graph: PropertyGraph) -> DataFrame:
    """``rel_id, critical`` of every relationship."""
    e = edges(graph).select("rel_id")
    if not is_connected(graph):
        return e.withColumn("critical", F.lit(True))
    hit = find_bridges(graph).withColumn("hit", F.lit(True))
    return e.join(hit, "rel_id", "left").select("rel_id", F.coalesce("hit", F.lit(False)).alias("critical"))
