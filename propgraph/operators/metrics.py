"""Whole-graph metrics on distances, degrees and pieces."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from .common import both_ways, cut, edges, simple, vertices
from .matrix import fiedler_value
from .structure import clustering_global, degree, find_articulation_points, find_bridges
from .traverse import all_pairs_reach, is_connected, reach, roots


def graph_diameter(graph: PropertyGraph, rel_type: str | None = None, weight_key: str | None = None) -> float:
    """The greatest distance; infinite if some pair is not joined, 0 without nodes."""
    n = vertices(graph, rel_type).count()
    r = all_pairs_reach(graph, rel_type, weight_key).agg(F.sum("reached"), F.max("farthest")).first()
    if not n:
        return 0.0
    return float(r[1]) if r[0] == n * n else math.inf


def _largest(graph: PropertyGraph, rel_type: str | None) -> DataFrame:
    """``node_id`` of the largest component, of equal ones that of the least node."""
    found = cut(roots(graph, rel_type))
    first = found.groupBy("root").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "root").limit(1)
    return found.join(F.broadcast(first.select("root")), "root").select("node_id")  # one row


def _inner_reach(graph: PropertyGraph, rel_type: str | None) -> DataFrame:
    nodes = cut(_largest(graph, rel_type))
    e = simple(edges(graph, rel_type)).join(nodes, F.col("src") == F.col("node_id"), "left_semi")
    return reach(nodes, both_ways(e))


def average_shortest_path_length(graph: PropertyGraph, rel_type: str | None = None) -> float:
    """Mean distance of different nodes, in the largest component."""
    r = _inner_reach(graph, rel_type).agg(F.sum("total"), F.sum(F.col("reached") - 1)).first()
    return float(r[0]) / float(r[1]) if r[1] else 0.0


def eccentricity(graph: PropertyGraph, rel_type: str | None = None) -> DataFrame:
    """``node_id, eccentricity`` in the largest component."""
    return _inner_reach(graph, rel_type).select("node_id", F.col("farthest").cast("long").alias("eccentricity"))


def radius(graph: PropertyGraph, rel_type: str | None = None) -> int:
    return int(eccentricity(graph, rel_type).agg(F.min("eccentricity")).first()[0] or 0)


def _at(graph: PropertyGraph, rel_type: str | None, pick) -> DataFrame:
    e = cut(eccentricity(graph, rel_type))
    best = e.agg(pick("eccentricity").alias("best"))
    return e.join(F.broadcast(best), F.col("eccentricity") == F.col("best")).select("node_id")  # one row


def center(graph: PropertyGraph, rel_type: str | None = None) -> DataFrame:
    return _at(graph, rel_type, F.min)


def periphery(graph: PropertyGraph, rel_type: str | None = None) -> DataFrame:
    return _at(graph, rel_type, F.max)


def density(graph: PropertyGraph, rel_type: str | None = None) -> float:
    """Edges of the simple graph (loops too) over the most possible; 0 under two nodes."""
    n = vertices(graph, rel_type).count()
    m = edges(graph, rel_type).select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct().count()
    return 2.0 * m / (n * (n - 1)) if n > 1 else 0.0


def assortativity(graph: PropertyGraph, rel_type: str | None = None) -> float:
    """Correlation of the degrees at both ends of simple edges; NaN where it is not defined."""
    e = both_ways(simple(edges(graph, rel_type))).select("src", "dst")
    d = e.groupBy("src").agg(F.count("*").alias("d"))
    rows = e.join(d, "src").join(d.select(F.col("src").alias("dst"), F.col("d").alias("d2")), "dst")
    value = rows.agg(F.corr(F.col("d").cast("double"), F.col("d2").cast("double"))).first()[0]
    return float(value) if value is not None else math.nan


def rich_club_coefficient(graph: PropertyGraph, rel_type: str | None = None) -> DataFrame:
    """``k, phi``: density among nodes of more than k neighbours, for k from 0 while two edge ends exceed it."""
    e = simple(edges(graph, rel_type)).select("src", "dst")
    both = both_ways(e)
    d = both.groupBy("src").agg(F.count("*").alias("d"))
    all_nodes = vertices(graph, rel_type).join(d, F.col("node_id") == F.col("src"), "left").select(F.coalesce("d", F.lit(0)).alias("d"))
    per_degree = all_nodes.groupBy("d").agg(F.count("*").alias("n"))
    least = e.join(d, "src").join(d.select(F.col("src").alias("dst"), F.col("d").alias("d2")), "dst").groupBy(F.least("d", "d2").alias("d")).agg(F.count("*").alias("m"))
    ks = all_nodes.agg(F.max("d").alias("top")).filter("top > 0").select(F.explode(F.sequence(F.lit(0), F.col("top").cast("int") - 1)).alias("k"))
    # degrees and k are both few: one row for each different value
    n = ks.join(per_degree, F.col("d") > F.col("k")).groupBy("k").agg(F.sum("n").alias("n"))
    m = ks.join(least, F.col("d") > F.col("k")).groupBy("k").agg(F.sum("m").alias("m"))
    rows = n.filter("n > 1").join(m, "k", "left")
    return rows.select(F.col("k").cast("long").alias("k"), (2.0 * F.coalesce("m", F.lit(0)) / (F.col("n") * (F.col("n") - 1))).alias("phi"))


def wiener_index(graph: PropertyGraph, rel_type: str | None = None, weight_key: str | None = None) -> float:
    """Sum of the distances of joined pairs."""
    return float(all_pairs_reach(graph, rel_type, weight_key).agg(F.sum("total")).first()[0] or 0.0) / 2


def network_robustness(graph: PropertyGraph, rel_type: str | None = None) -> dict:
    return {
        "fiedler_value": fiedler_value(graph, rel_type),
        "diameter": graph_diameter(graph, rel_type),
        "n_bridges": find_bridges(graph, rel_type).count(),
        "n_articulation_points": find_articulation_points(graph, rel_type).count(),
        "is_connected": is_connected(graph, rel_type),
    }


def summary(graph: PropertyGraph, rel_type: str | None = None) -> dict:
    d = degree(graph, rel_type).agg(F.count("*"), F.sum("degree"), F.avg("degree"), F.max("degree")).first()
    return {
        "n_nodes": d[0],
        "n_edges": int(d[1] or 0) // 2,
        "average_degree": float(d[2] or 0.0),
        "max_degree": int(d[3] or 0),
        "density": density(graph, rel_type),
        "is_connected": is_connected(graph, rel_type),
        "n_components": roots(graph, rel_type).select("root").distinct().count(),
        "n_bridges": find_bridges(graph, rel_type).count(),
        "n_articulation_points": find_articulation_points(graph, rel_type).count(),
        "clustering": clustering_global(graph, rel_type),
        "assortativity": assortativity(graph, rel_type),
    }
