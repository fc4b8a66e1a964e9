"""A network's tables as a property graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from ..operators.common import cut, placed

# Properties that the graph keeps.
BUS = "numero nombre V_base_kV tipo area zona zoname V_mag_pu V_ang_deg V_max_pu V_min_pu".split()
LINE = "circuito R_pu X_pu B_pu rate_A_MVA rate_B_MVA rate_C_MVA status longitud_km".split()
SPREAD = 10**9


def _numbered(df: DataFrame, name: str, code: int, *keys: str) -> DataFrame:
    """``df`` with ids in order of the keys, from 1 above the code's range."""
    return placed(df, *map(F.col, keys)).withColumn(name, F.lit(code * SPREAD + 1) + F.col("place")).drop("place")


def load_network(spark, tables: dict[str, DataFrame]) -> tuple[PropertyGraph, dict[str, int]]:
    """The graph, and how many rows each table lost because a bus of theirs is unknown."""
    lost: dict[str, int] = {}
    tables = {name: cut(t) for name, t in tables.items()}  # files are parsed once, whatever the graph is asked
    buses = tables["buses"].dropDuplicates(["numero"])
    bus = buses.select(F.col("numero").cast("long").alias("id"), *[c for c in BUS if c in buses.columns])
    g = PropertyGraph(spark).with_nodes(["Bus"], bus)
    known = bus.select(F.col("numero").alias("known"))

    def checked(name: str, *keys: str) -> DataFrame | None:
        if name not in tables:
            return None
        t = good = tables[name].drop("file")
        for k in keys:
            good = good.join(known, F.col(k) == F.col("known"), "left_semi")
        lost[name] = t.count() - good.count()
        return good

    lines = checked("lineas", "from_bus_numero", "to_bus_numero")
    if lines is not None:
        lines = lines.withColumnRenamed("_CKT", "circuito")
        keep = [c for c in LINE if c in lines.columns]
        g = g.with_rels("LINEA", _numbered(lines, "id", 1, "from_bus_numero", "to_bus_numero", "circuito").select("id", F.col("from_bus_numero").cast("long").alias("src"), F.col("to_bus_numero").cast("long").alias("dst"), *keep), ["Bus"], ["Bus"])
    xf = checked("transformadores", "from_bus_index", "to_bus_index")
    if xf is not None:
        two = xf.filter("tertiary_bus_index = 0")
        g = g.with_rels(
            "TRANSFORMADOR_2W",
            _numbered(two, "id", 2, "from_bus_index", "to_bus_index", "ckt_id").select("id", F.col("from_bus_index").cast("long").alias("src"), F.col("to_bus_index").cast("long").alias("dst"), F.col("ckt_id").alias("ckt"), "R1_2_pu", "X1_2_pu", "WINDV1", "ANG1", "STAT"),
            ["Bus"],
            ["Bus"],
        )
        three = xf.filter("tertiary_bus_index <> 0").join(known, F.col("tertiary_bus_index") == F.col("known"), "left_semi")
        lost["transformadores"] += xf.filter("tertiary_bus_index <> 0").count() - three.count()
        three = _numbered(three, "vid", 3, "from_bus_index", "to_bus_index", "tertiary_bus_index", "ckt_id")
        name = F.concat_ws("_", F.lit("XF3W"), "from_bus_index", "to_bus_index", "tertiary_bus_index").alias("name")
        g = g.with_nodes(["VirtualNode"], three.select(F.col("vid").alias("id"), name, F.col("ckt_id").alias("ckt"), "R1_2_pu", "X1_2_pu", "R2_3_pu", "X2_3_pu", "R3_1_pu", "X3_1_pu", "STAT"))
        arms = three.select("vid", F.posexplode(F.array("from_bus_index", "to_bus_index", "tertiary_bus_index")).alias("arm", "bus"))
        g = g.with_rels("CONEXION_XF", arms.select((F.col("vid") * 10 + F.col("arm")).alias("id"), F.col("bus").cast("long").alias("src"), F.col("vid").alias("dst")), ["Bus"], ["VirtualNode"])
    for code, (table, label, kind) in enumerate((("generadores", "Generator", "GENERACION"), ("cargas", "Load", "CONSUMO"), ("shunts", "Shunt", "SHUNT")), 4):
        leaf = checked(table, "bus_numero")
        if leaf is not None:
            leaf = _numbered(leaf.withColumnRenamed("id", "ident"), "id", code, "bus_numero", "ident")
            g = g.with_nodes([label], leaf)
            g = g.with_rels(kind, leaf.select((F.col("id") * 10).alias("id"), F.col("bus_numero").cast("long").alias("src"), F.col("id").alias("dst")), ["Bus"], [label])
    return g, lost


def load_summary(graph: PropertyGraph) -> DataFrame:
    """``kind, name, n``: nodes by label and relationships by type."""
    labels = graph.node_view((), ()).select(F.explode("labels").alias("name")).groupBy("name").agg(F.count("*").alias("n")).withColumn("kind", F.lit("label"))
    types = graph.rel_view((), ()).groupBy(F.col("type").alias("name")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("type"))
    return labels.unionByName(types).select("kind", "name", "n")


def bus_by_number(graph: PropertyGraph, number: int) -> DataFrame:
    return graph.node_view(["Bus"]).filter(F.col("numero") == number)


def neighbours(graph: PropertyGraph, number: int, rel_type: str | None = None) -> DataFrame:
    """Nodes that relationships lead to from a bus, with the relationship's id and type."""
    start = bus_by_number(graph, number).select(F.col("id").alias("src"))
    rels = graph.rel_view([rel_type] if rel_type else [], []).join(start, "src", "left_semi").select(F.col("id").alias("rel_id"), "type", "dst")
    return rels.join(graph.node_view(), F.col("dst") == F.col("id")).drop("dst")
