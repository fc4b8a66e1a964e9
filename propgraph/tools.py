"""One function for each thing a client of the engine may ask, over an open graph.

Tables come back as DataFrames, single facts as Python values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import PropertyGraph
from .operators import centrality, community, crud, flow, matrix, metrics, structure, subgraph, traverse
from .plans.lexer import CypherError
from .plans.writer import is_read_only
from .power.lodf import Lodf
from .power.ptdf import Ptdf, read_pairs, read_ptdf

#: Bands of the Fiedler value and of the number of bridges, least bound first.
FIEDLER_BANDS = ((2.0, "very robust"), (0.5, "robust"), (0.1, "moderate"), (0.0, "fragile"))
BRIDGE_RISK = ((5, "critical"), (2, "high"), (0, "moderate"))


class Tools:
    def __init__(self, spark: SparkSession, graph: PropertyGraph | None = None):
        self.spark, self.graph = spark, graph
        self.ptdf: Ptdf | None = None
        self.lodf: Lodf | None = None

    # store
    def open_database(self, path: str, version: int | None = None) -> PropertyGraph:
        self.graph = PropertyGraph.load(self.spark, path, version)
        return self.graph

    def database_info(self) -> dict:
        return {"nodes": self.graph.node_view((), ()).count(), "relationships": self.graph.rel_view((), ()).count(), "labels": self.graph.labels(), "types": self.graph.types(), "version": self.graph.version}

    def cypher(self, text: str, params: dict | None = None) -> DataFrame:
        """A query that may not write."""
        if not is_read_only(text):
            raise CypherError("this tool only reads")
        return self.graph.query(text, params)

    def list_labels(self) -> DataFrame:
        return self.graph.node_view((), ()).select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")

    def list_relationship_types(self) -> DataFrame:
        return self.graph.rel_view((), ()).groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type")

    def node(self, node_id: int) -> dict | None:
        return crud.get_node(self.graph, node_id)

    def relationship(self, rel_id: int) -> dict | None:
        return crud.get_rel(self.graph, rel_id)

    # topology
    def is_connected(self, rel_type: str | None = None) -> bool:
        return traverse.is_connected(self.graph, rel_type)

    def connected_components(self, rel_type: str | None = None) -> DataFrame:
        return traverse.component_sizes(self.graph, rel_type).orderBy(F.desc("size"))

    def strongly_connected_components(self, rel_type: str | None = None) -> DataFrame:
        return traverse.strongly_connected_components(self.graph, rel_type).groupBy("component").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("components")).orderBy(F.desc("size"))

    def bridges(self, rel_type: str | None = None) -> DataFrame:
        found = structure.find_bridges(self.graph, rel_type)
        return self.graph.rel_view([rel_type] if rel_type else [], ()).join(found, F.col("id") == F.col("rel_id"), "left_semi").select("id", "src", "dst", "type")

    def articulation_points(self, rel_type: str | None = None) -> DataFrame:
        return self.graph.node_view().join(structure.find_articulation_points(self.graph, rel_type).withColumnRenamed("node_id", "id"), "id", "left_semi")

    def n1_is_critical(self, rel_id: int) -> bool:
        return structure.n1_is_critical(self.graph, rel_id)

    # centrality
    def _top(self, df: DataFrame, value: str, n: int) -> DataFrame:
        return df.orderBy(F.col(value).desc_nulls_last(), "node_id").limit(n)

    def degree_centrality(self, rel_type: str | None = None, n: int = 10) -> DataFrame:
        return self._top(centrality.degree_centrality(self.graph, rel_type), "centrality", n)

    def betweenness(self, rel_type: str | None = None, n: int = 10) -> DataFrame:
        return self._top(centrality.betweenness_centrality(self.graph, rel_type), "betweenness", n)

    def pagerank(self, rel_type: str | None = None, n: int = 10, damping: float = 0.85) -> DataFrame:
        return self._top(centrality.pagerank(self.graph, rel_type, damping), "rank", n)

    def closeness(self, rel_type: str | None = None, n: int = 10) -> DataFrame:
        return self._top(centrality.closeness_centrality(self.graph, rel_type), "closeness", n)

    def clustering(self, rel_type: str | None = None, n: int = 10) -> tuple[DataFrame, float]:
        return self._top(structure.clustering_local(self.graph, rel_type), "clustering", n), structure.clustering_global(self.graph, rel_type)

    # paths and flows
    def shortest_path(self, src: int, dst: int, rel_type: str | None = None) -> list[dict] | None:
        return traverse.shortest_path(self.graph, src, dst, rel_type)

    def dijkstra_from(self, src: int, rel_type: str | None = None, weight_key: str | None = None) -> DataFrame:
        return traverse.dijkstra(self.graph, src, rel_type, weight_key).filter("dist >= 0").orderBy("dist", "node_id")

    def k_shortest_paths(self, src: int, dst: int, k: int = 3, rel_type: str | None = None, weight_key: str | None = None) -> DataFrame:
        return flow.k_shortest_paths(self.graph, src, dst, k, rel_type, weight_key)

    def max_flow(self, src: int, dst: int, rel_type: str | None = None, capacity_key: str | None = None) -> float:
        return flow.max_flow(self.graph, src, dst, rel_type, capacity_key)

    # communities
    def louvain(self, rel_type: str | None = None, weight_key: str | None = None) -> DataFrame:
        return community.community_detection(self.graph, rel_type, weight_key)

    def label_propagation(self, rel_type: str | None = None) -> DataFrame:
        return community.label_propagation_communities(self.graph, rel_type)

    def spectral_partition(self, rel_type: str | None = None, n_clusters: int = 2) -> DataFrame:
        return matrix.spectral_partition(self.graph, rel_type, n_clusters)

    # metrics
    def graph_summary(self, rel_type: str | None = None) -> dict:
        return metrics.summary(self.graph, rel_type)

    def fiedler_value(self, rel_type: str | None = None) -> dict:
        value = matrix.fiedler_value(self.graph, rel_type)
        return {"fiedler_value": value, "band": next(name for least, name in FIEDLER_BANDS if value >= least)}

    def density(self, rel_type: str | None = None) -> float:
        return metrics.density(self.graph, rel_type)

    def assortativity(self, rel_type: str | None = None) -> float:
        return metrics.assortativity(self.graph, rel_type)

    def robustness(self, rel_type: str | None = None) -> dict:
        return metrics.network_robustness(self.graph, rel_type)

    # power
    def bess_ranking(self, rel_type: str | None = "LINE", weight_key: str | None = "x_pu", n: int = 10) -> DataFrame:
        return centrality.bess_siting_ranking(self.graph, rel_type, weight_key, n)

    def congestion_risk(self, rel_type: str | None = None, n: int = 10) -> DataFrame:
        return centrality.congestion_risk(self.graph, rel_type).limit(n)

    def vulnerability(self, rel_type: str | None = None, n: int = 10) -> DataFrame:
        return centrality.vulnerability_index(self.graph, rel_type).limit(n)

    def full_n1(self, rel_type: str | None = None) -> dict:
        n = structure.find_bridges(self.graph, rel_type).count()
        return {"bridges": n, "articulation_points": structure.find_articulation_points(self.graph, rel_type).count(), "connected": self.is_connected(rel_type), "risk": next((name for least, name in BRIDGE_RISK if n > least), "low")}

    def load_ptdf(self, ptdf_csv: str, base_flows_csv: str | None = None, ratings_csv: str | None = None, rel_type: str = "LINEA") -> DataFrame:
        self.ptdf = Ptdf(self.graph, read_ptdf(self.spark, ptdf_csv), rel_type)
        if base_flows_csv:
            ratings = read_pairs(self.spark, ratings_csv, "rating") if ratings_csv else None
            self.lodf = Lodf(self.ptdf, read_pairs(self.spark, base_flows_csv, "flow"), ratings)
        return self.ptdf.summary()

    def ptdf_branch(self, label: str) -> DataFrame:
        return self.ptdf.branch_row(label)

    def injection_impact(self, bus: int, top_n: int = 20) -> DataFrame:
        return self.ptdf.bus_impact(bus, top_n)

    def flows_after(self, label: str) -> DataFrame | None:
        return self.lodf.flows_after(label)

    def critical_contingencies(self, top_n: int = 20) -> DataFrame:
        return self.lodf.ranking(top_n)

    def ptdf_cell(self, label: str, bus: int) -> float:
        return self.ptdf.cell(label, bus)

    def n1_verdict(self, label: str) -> dict:
        return self.lodf.verdict(label)

    # views
    def load_graph(self, limit: int = subgraph.SHOWN) -> tuple[DataFrame, DataFrame]:
        return subgraph.top_degree(self.graph, limit)

    def run_query(self, text: str, limit: int = subgraph.SHOWN) -> tuple[DataFrame, DataFrame]:
        return subgraph.of_query(self.graph, text, limit)

    def call(self, name: str, **arguments):
        """Any of the above by name."""
        if name.startswith("_") or name == "call" or not callable(getattr(self, name, None)):
            raise ValueError(f"no tool {name}")
        return getattr(self, name)(**arguments)
