"""Matrices of a graph in coordinate form, and what their spectra tell."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from . import kernels
from .common import both_ways, collected, edges, placed, vertices

#: Nodes of a dense eigenproblem on the driver (a matrix of 4,000^2 doubles is 128 MB); larger ones take only the least eigenvalues, from a sparse form.
DENSE = 4000


def node_index(graph: PropertyGraph, rel_type: str | None = None) -> DataFrame:
    """``node_id, i``: places by ascending id."""
    return placed(vertices(graph, rel_type), F.col("node_id")).withColumnRenamed("place", "i")


def adjacency_matrix(graph: PropertyGraph, rel_type: str | None = None, undirected: bool = True) -> DataFrame:
    """``i_id, j_id, value``: how many relationships join two nodes; a loop once."""
    e = edges(graph, rel_type)
    e = both_ways(e) if undirected else e
    return e.groupBy(F.col("src").alias("i_id"), F.col("dst").alias("j_id")).agg(F.count("*").cast("double").alias("value"))


def incidence_matrix(graph: PropertyGraph, rel_type: str | None = None) -> DataFrame:
    """``node_id, rel_id, value``: +1 at the source, -1 at the target, summed where both are one."""
    e = edges(graph, rel_type)
    rows = e.select(F.col("src").alias("node_id"), "rel_id", F.lit(1.0).alias("value")).unionByName(e.select(F.col("dst").alias("node_id"), "rel_id", F.lit(-1.0).alias("value")))
    return rows.groupBy("node_id", "rel_id").agg(F.sum("value").alias("value"))


def laplacian_matrix(graph: PropertyGraph, rel_type: str | None = None) -> DataFrame:
    """Row sums on the diagonal less the adjacency; zero entries are left out."""
    a = adjacency_matrix(graph, rel_type)
    diagonal = a.groupBy("i_id").agg(F.sum("value").alias("value")).select("i_id", F.col("i_id").alias("j_id"), "value")
    both = diagonal.unionByName(a.select("i_id", "j_id", (-F.col("value")).alias("value")))
    return both.groupBy("i_id", "j_id").agg(F.sum("value").alias("value")).filter("value <> 0")


def weighted_laplacian_matrix(graph: PropertyGraph, rel_type: str | None = None, weight_key: str = "x_pu") -> DataFrame:
    """The same with admittances 1 / weight."""
    e = edges(graph, rel_type, weight_key).filter("src <> dst").withColumn("y", 1 / F.col("weight"))
    off = both_ways(e).select(F.col("src").alias("i_id"), F.col("dst").alias("j_id"), (-F.col("y")).alias("value"))
    diagonal = both_ways(e).select(F.col("src").alias("i_id"), F.col("src").alias("j_id"), F.col("y").alias("value"))
    return off.unionByName(diagonal).groupBy("i_id", "j_id").agg(F.sum("value").alias("value"))


def ybus_matrix(graph: PropertyGraph, rel_type: str = "LINE", weight_key: str = "x_pu") -> DataFrame:
    return weighted_laplacian_matrix(graph, rel_type, weight_key)


def electrical_distance(graph: PropertyGraph, rel_type: str | None = None, weight_key: str = "X_pu") -> DataFrame:
    """``src, dst, dist`` over undirected edges, the least of parallel ones; unreachable pairs are absent."""
    from .traverse import distances

    e = edges(graph, rel_type, weight_key).filter("src <> dst")
    e = e.groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.min("weight").alias("weight"), F.min("rel_id").alias("rel_id"))
    return distances(vertices(graph, rel_type), both_ways(e.select(F.col("u").alias("src"), F.col("v").alias("dst"), "rel_id", "weight")), True)


def _eigen(graph: PropertyGraph, rel_type: str | None, k: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of nodes with neighbours, and at least the k least of the Laplacian's eigenvalues and vectors over them."""
    e = both_ways(edges(graph, rel_type).filter("src <> dst")).groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    g = collected(e.select(F.col("src").alias("node_id")).distinct(), e)
    if g.n > DENSE:
        return g.nodes, *kernels.least_eigenpairs(g, k)
    a = np.zeros((g.n, g.n))
    a[np.repeat(np.arange(g.n), np.diff(g.first)), g.to] = g.weight
    values, vectors = np.linalg.eigh(np.diag(a.sum(axis=1)) - a) if g.n else (np.zeros(0), np.zeros((0, 0)))
    return g.nodes, values, vectors


def fiedler_value(graph: PropertyGraph, rel_type: str | None = None) -> float:
    """The Laplacian's second least eigenvalue over nodes with neighbours; 0 under two of them."""
    _, values, _ = _eigen(graph, rel_type)
    return max(0.0, float(values[1])) if len(values) > 1 else 0.0


def fiedler_vector(graph: PropertyGraph, rel_type: str | None = None) -> DataFrame:
    """``node_id, value``; the sign makes the largest component positive."""
    ids, values, vectors = _eigen(graph, rel_type)
    v = vectors[:, 1] if len(values) > 1 else np.zeros(len(ids))
    if len(v) and v[np.abs(v).argmax()] < 0:
        v = -v
    return graph.spark.createDataFrame([(int(i), float(x)) for i, x in zip(ids, v)], "node_id long, value double")


def spectral_partition(graph: PropertyGraph, rel_type: str | None = None, n_clusters: int = 2) -> DataFrame:
    """``node_id, cluster``: halves at the Fiedler vector's median, or k-means over k eigenvectors."""
    ids, values, vectors = _eigen(graph, rel_type, n_clusters)
    spark = graph.spark
    if not len(ids):
        return spark.createDataFrame([], "node_id long, cluster int")
    if n_clusters == 2:
        v = vectors[:, 1] if len(values) > 1 else np.zeros(len(ids))
        if v[np.abs(v).argmax()] < 0:
            v = -v
        label = (v >= np.median(v)).astype(int)
    else:
        label = _kmeans(vectors[:, : min(n_clusters, len(values))], n_clusters)
    return spark.createDataFrame([(int(i), int(c)) for i, c in zip(ids, label)], "node_id long, cluster int")


def _kmeans(x: np.ndarray, k: int, rounds: int = 100) -> np.ndarray:
    """Centres start far apart, so no random choice is made."""
    centres = [x[0]]
    while len(centres) < min(k, len(x)):
        d = np.min([((x - c) ** 2).sum(axis=1) for c in centres], axis=0)
        centres.append(x[d.argmax()])
    centres = np.array(centres)
    label = np.zeros(len(x), int)
    for _ in range(rounds):
        new = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        if (new == label).all() and _:
            break
        label = new
        centres = np.array([x[label == c].mean(axis=0) if (label == c).any() else centres[c] for c in range(len(centres))])
    return label


