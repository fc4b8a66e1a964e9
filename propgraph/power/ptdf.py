"""Distribution factors as a long table ``branch, bus, ptdf``, and questions to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import PropertyGraph, col
from ..operators.structure import find_bridges

TINY = 1e-6


def read_ptdf(spark: SparkSession, path: str) -> DataFrame:
    """A CSV whose first column names branches and whose other headers are bus numbers."""
    wide = spark.read.csv(path, header=True)
    first, buses = wide.columns[0], wide.columns[1:]
    long = wide.unpivot([col(first)], [col(b) for b in buses], "bus", "ptdf")
    return long.select(F.trim(col(first)).alias("branch"), F.trim("bus").try_cast("double").cast("int").alias("bus"), F.col("ptdf").try_cast("double").alias("ptdf"))


def read_pairs(spark: SparkSession, path: str, value: str) -> DataFrame:
    """``label`` and ``value`` from a CSV of two columns, whatever their headers say."""
    t = spark.read.csv(path, header=True)
    return t.select(F.trim(col(t.columns[0])).alias("label"), col(t.columns[1]).try_cast("double").alias(value))


class Ptdf:
    """Sensitivities of branch flows to injections, tied to a graph's relationships by label."""

    def __init__(self, graph: PropertyGraph | None, table: DataFrame, rel_type: str | list[str] = "LINEA"):
        self.graph, self.rel_type = graph, [rel_type] if isinstance(rel_type, str) else list(rel_type)
        self.table = table.select(F.col("branch").cast("string").alias("branch"), F.col("bus").cast("int").alias("bus"), F.coalesce(F.col("ptdf").cast("double"), F.lit(0.0)).alias("ptdf"))
        self.labels = self.table.select("branch").distinct()

    # labels
    def label_map(self) -> DataFrame:
        """``branch, rel_id``: by the property label or etiqueta, else by the numbers of both ends; of parallel ones the last relationship."""
        known = self.graph.rel_props(self.rel_type)
        own = [k for k in ("label", "etiqueta") if k in known]
        rels = self.graph.rel_view(self.rel_type, own)
        numbers = self.graph.node_view((), ["numero"]) if "numero" in self.graph.node_props() else self.graph.node_view((), ()).withColumn("numero", F.col("id"))
        a = numbers.select(F.col("id").alias("src"), F.col("numero").alias("na"))
        b = numbers.select(F.col("id").alias("dst"), F.col("numero").alias("nb"))
        ends = F.concat_ws("-", F.col("na").cast("string"), F.col("nb").cast("string"))
        named = [F.struct(F.lit(0).alias("way"), col(k).cast("string").alias("branch")) for k in own]
        made = [F.struct(F.lit(1).alias("way"), F.concat(F.lit(kind + " "), ends).alias("branch")) for kind in ("L", "T2D", "T3D-arm")]
        tries = rels.join(a, "src", "left").join(b, "dst", "left").select("id", F.explode(F.array(*named, *made)).alias("t")).select("id", "t.way", "t.branch").filter("branch IS NOT NULL")
        best = Window.partitionBy("branch").orderBy("way", F.desc("id"))
        hits = tries.join(self.labels, "branch", "left_semi").withColumn("k", F.row_number().over(best)).filter("k = 1")
        return hits.select("branch", F.col("id").alias("rel_id"))

    def endpoints(self) -> DataFrame:
        """``branch, from_bus, to_bus``: numbers of the relationship's ends, else read from the label."""
        parsed = self.labels.select("branch", F.regexp_extract("branch", r"(\d+)\s*-\s*(\d+)\s*$", 1).try_cast("int").alias("pa"), F.regexp_extract("branch", r"(\d+)\s*-\s*(\d+)\s*$", 2).try_cast("int").alias("pb"))
        if self.graph is None:
            return parsed.select("branch", F.col("pa").alias("from_bus"), F.col("pb").alias("to_bus"))
        rels = self.graph.rel_view(self.rel_type, [])
        numbers = self.graph.node_view((), ["numero"]) if "numero" in self.graph.node_props() else self.graph.node_view((), ()).withColumn("numero", F.col("id"))
        ends = rels.join(numbers.select(F.col("id").alias("src"), F.col("numero").alias("na")), "src").join(numbers.select(F.col("id").alias("dst"), F.col("numero").alias("nb")), "dst")
        tied = self.label_map().join(ends.select(F.col("id").alias("rel_id"), "na", "nb"), "rel_id")
        rows = parsed.join(tied, "branch", "left")
        return rows.select("branch", F.coalesce(F.col("na").cast("int"), "pa").alias("from_bus"), F.coalesce(F.col("nb").cast("int"), "pb").alias("to_bus"))

    def bridge_labels(self) -> DataFrame:
        """``branch`` of relationships whose loss splits the network."""
        if self.graph is None:
            return self.labels.limit(0)
        return self.label_map().join(find_bridges(self.graph, self.rel_type), "rel_id", "left_semi").select("branch")

    # questions
    def branch_row(self, branch: str) -> DataFrame:
        return self.table.filter(F.col("branch") == branch).select("bus", "ptdf")

    def bus_impact(self, bus: int, top_n: int = 20) -> DataFrame:
        """``branch, ptdf`` of the branches that an injection at a bus moves most."""
        return self.table.filter(F.col("bus") == bus).select("branch", "ptdf").orderBy(F.desc(F.abs("ptdf")), "branch").limit(top_n)

    def cell(self, branch: str, bus: int) -> float:
        r = self.table.filter((F.col("branch") == branch) & (F.col("bus") == bus)).select("ptdf").first()
        return float(r[0]) if r else 0.0

    def most_sensitive(self, top_n: int = 10) -> DataFrame:
        """``branch, max_ptdf, bus``: the greatest magnitude of a branch and where it is."""
        best = self.table.groupBy("branch").agg(F.max(F.struct(F.abs("ptdf").alias("m"), (-F.col("bus")).alias("b"))).alias("x"))
        return best.select("branch", F.col("x.m").alias("max_ptdf"), (-F.col("x.b")).alias("bus")).orderBy(F.desc("max_ptdf"), "branch").limit(top_n)

    def summary(self) -> DataFrame:
        """One row: sizes, magnitudes, and how many branches are tied to the graph and how many of those are bridges (null without one)."""
        m = F.abs("ptdf")
        tied = self.label_map().count() if self.graph is not None else None
        split = self.bridge_labels().count() if self.graph is not None else None
        mapped = [F.lit(tied).cast("long").alias("n_mapped_to_graph"), F.lit(split).cast("long").alias("n_bridges")]
        return self.table.agg(F.countDistinct("branch").alias("n_branches"), F.countDistinct("bus").alias("n_buses"), F.max(m).alias("max_abs"), F.avg(m).alias("mean_abs"), (100 * F.avg(F.when(m < TINY, 1.0).otherwise(0.0))).alias("sparsity_pct"), *mapped)

    def top_k(self, k: int = 20) -> DataFrame:
        """``branch, ptdf_topk``: the k buses of greatest magnitude over 1e-6, values rounded to 6 places."""
        order = Window.partitionBy("branch").orderBy(F.desc(F.abs("ptdf")), "bus")
        rows = self.table.filter(F.abs("ptdf") > TINY).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        return rows.groupBy("branch").agg(F.array_sort(F.collect_list(F.struct("rank", "bus", F.round("ptdf", 6).alias("ptdf")))).alias("ptdf_topk"))

    def persist(self, k: int = 20) -> PropertyGraph:
        """The graph with ``ptdf_topk`` (JSON text) on its relationships."""
        found = self.top_k(k).join(self.label_map(), "branch").select("rel_id", F.to_json("ptdf_topk").alias("ptdf_topk"))
        return with_rel_values(self.graph, self.rel_type, found)


def with_rel_values(graph: PropertyGraph, types: list[str], values: DataFrame) -> PropertyGraph:
    """The graph with further properties on relationships, from a table keyed by ``rel_id``."""
    rels = dict(graph.rels)
    for t in types:
        if t in rels:
            kept = rels[t].drop(*[c for c in values.columns if c != "rel_id"])
            rels[t] = kept.join(values.withColumnRenamed("rel_id", "id"), "id", "left").select("id", "src", "dst", *[c for c in kept.columns if c not in ("id", "src", "dst")], *[c for c in values.columns if c != "rel_id"])
    return graph.replaced(rels=rels)
