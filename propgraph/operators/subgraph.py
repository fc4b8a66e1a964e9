"""Induced subgraphs of bounded size, for views of a graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..graph import PropertyGraph, col
from .structure import degree

#: Nodes that a view shows.
SHOWN = 500


def _induced(graph: PropertyGraph, chosen: DataFrame, rel_type: str | None) -> tuple[DataFrame, DataFrame]:
    """Nodes and relationships among ``chosen`` (column ``id``)."""
    nodes = graph.node_view().join(chosen, "id", "left_semi")
    rels = graph.rel_view([rel_type] if rel_type else [])
    rels = rels.join(chosen.select(F.col("id").alias("src")), "src", "left_semi").join(chosen.select(F.col("id").alias("dst")), "dst", "left_semi")
    return nodes, rels


def _best(graph: PropertyGraph, ids: DataFrame | None, limit: int, rel_type: str | None) -> DataFrame:
    d = degree(graph, rel_type)
    if ids is not None:
        d = d.join(ids.select(F.col("id").alias("node_id")), "node_id", "right").select("node_id", F.coalesce("degree", F.lit(0)).alias("degree"))
    return d.orderBy(F.desc("degree"), "node_id").limit(limit).select(F.col("node_id").alias("id"))


def top_degree(graph: PropertyGraph, limit: int = SHOWN, rel_type: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The induced subgraph of the nodes of greatest degree."""
    return _induced(graph, _best(graph, None, limit, rel_type), rel_type)


def of_query(graph: PropertyGraph, text: str, limit: int = SHOWN, rel_type: str | None = None, params: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """The induced subgraph of what a query's whole numbers name: nodes, else relationships with both ends."""
    rows = graph.query(text, params)
    numbers = [f.name for f in rows.schema if isinstance(f.dataType, T.IntegralType)]
    if not numbers:
        values = graph.spark.createDataFrame([], "x long")
    else:
        values = reduce(lambda a, b: a.unionByName(b), [rows.select(col(n).cast("long").alias("x")) for n in numbers]).distinct()
    known = graph.node_view((), ()).select("id")
    nodes = values.join(known, F.col("x") == F.col("id"), "left_semi").select(F.col("x").alias("id"))
    rest = values.join(known, F.col("x") == F.col("id"), "left_anti")
    ends = graph.rel_view([rel_type] if rel_type else [], ()).join(rest, F.col("id") == F.col("x"), "left_semi")
    ends = ends.select(F.col("src").alias("id")).unionByName(ends.select(F.col("dst").alias("id")))
    return _induced(graph, _best(graph, nodes.unionByName(ends).distinct(), limit, rel_type), rel_type)
