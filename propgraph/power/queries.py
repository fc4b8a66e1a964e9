"""Driver queries over a three-bus network given as literals, and over one derived from the tables.

The derived network has a bus for each nation, a zone for each region, a generator for each supplier
and a load for each nation's customers. Nations of a region form a ring, those of the last region a
chain, whose lines are bridges. It is written as a case file and as CSV and read back.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from ..operators.common import shared_folder
from ..sources.raw import read_raw
from . import loader
from .lodf import Lodf
from .ptdf import Ptdf, read_pairs, read_ptdf

#: Branch, ends, reactance, rating, flow.
BRANCHES = [("L 1-2", 1, 2, 0.10, 200.0, 89.473684), ("L 2-3", 2, 3, 0.08, 150.0, 39.473684), ("L 1-3", 1, 3, 0.20, 110.0, 60.526316)]
FACTORS = [("L 1-2", 1, 0.526316), ("L 1-2", 2, -0.210526), ("L 1-2", 3, 0.0), ("L 2-3", 1, 0.526316), ("L 2-3", 2, 0.789474), ("L 2-3", 3, 0.0), ("L 1-3", 1, 0.473684), ("L 1-3", 2, 0.210526), ("L 1-3", 3, 0.0)]


def network(spark: SparkSession) -> PropertyGraph:
    g = PropertyGraph(spark).with_nodes(["Bus"], spark.createDataFrame([(i, i) for i in (1, 2, 3)], "id long, numero int"))
    rows = [(i, b[1], b[2], b[0], b[3]) for i, b in enumerate(BRANCHES, 1)]
    return g.with_rels("LINEA", spark.createDataFrame(rows, "id long, src long, dst long, label string, X_pu double"), ["Bus"], ["Bus"])


def ptdf(spark: SparkSession) -> Ptdf:
    return Ptdf(network(spark), spark.createDataFrame(FACTORS, "branch string, bus int, ptdf double"))


def lodf(spark: SparkSession, most: int = 2) -> Lodf:
    flows = spark.createDataFrame([(b[0], b[5]) for b in BRANCHES], "label string, flow double")
    ratings = spark.createDataFrame([(b[0], b[4]) for b in BRANCHES], "label string, rating double")
    return Lodf(ptdf(spark), flows, ratings, most_overloads=most)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 4) for n in names})


_P = "p(branch, bus, ptdf) AS (VALUES " + ", ".join(f"('{a}', {b}, {c}::DOUBLE)" for a, b, c in FACTORS) + ")"
_B = "br(branch, f, t, rating, flow) AS (VALUES " + ", ".join(f"('{b[0]}', {b[1]}, {b[2]}, {b[4]}::DOUBLE, {b[5]}::DOUBLE)" for b in BRANCHES) + ")"
_M = (
    f"WITH {_P}, {_B}, bsf AS (SELECT l.branch AS affected, k.branch AS outage, coalesce(x.ptdf, 0) - coalesce(y.ptdf, 0) AS b FROM br l CROSS JOIN br k LEFT JOIN p x ON x.branch = l.branch AND x.bus = k.f LEFT JOIN p y ON y.branch = l.branch AND y.bus = k.t), "
    "m AS (SELECT a.affected, a.outage, a.b / (1 - d.b) AS lodf FROM bsf a JOIN bsf d ON d.affected = d.outage AND d.outage = a.outage), "
    "post AS (SELECT m.outage, m.affected, CASE WHEN m.affected = m.outage THEN 0 ELSE l.flow + m.lodf * k.flow END AS flow, l.rating FROM m JOIN br l ON l.branch = m.affected JOIN br k ON k.branch = m.outage), "
    "c AS (SELECT outage, round(100 * max(abs(flow) / rating), 2) AS max_loading_pct, count(*) FILTER (WHERE abs(flow) / rating > 1)::BIGINT AS n_overloads FROM post GROUP BY 1), "
    "v AS (SELECT *, CASE WHEN n_overloads > 2 THEN 'critico' WHEN n_overloads >= 1 OR max_loading_pct > 90 THEN 'advertencia' ELSE 'seguro' END AS verdict FROM c)"
)

QUERIES = {
    "ptdf_row": lambda spark, sf: ptdf(spark).branch_row("L 1-2"),
    "ptdf_bus_impact": lambda spark, sf: ptdf(spark).bus_impact(2, 2),
    "ptdf_topk": lambda spark, sf: ptdf(spark).top_k(2).select("branch", F.explode("ptdf_topk").alias("t")).select("branch", F.col("t.rank").cast("long").alias("rank"), "t.bus", "t.ptdf"),
    "ptdf_most_sensitive": lambda spark, sf: ptdf(spark).most_sensitive(3),
    "ptdf_summary": lambda spark, sf: _rounded(ptdf(spark).summary(), "max_abs", "mean_abs", "sparsity_pct"),
    "lodf_matrix": lambda spark, sf: _rounded(lodf(spark).matrix, "lodf"),
    "post_contingency_flows": lambda spark, sf: lodf(spark).after().select("outage", "affected", F.round("flow", 3).alias("flow")),
    "contingency_ranking": lambda spark, sf: lodf(spark).ranking(3).select(F.col("rank").cast("long").alias("rank"), "outage", "max_loading_pct", "n_overloads", "verdict"),
    "n1_verdicts": lambda spark, sf: lodf(spark).verdicts().select("branch", "verdict", "max_loading_pct", "n_overloads"),
}
SQL = {
    "ptdf_row": f"WITH {_P} SELECT bus, ptdf FROM p WHERE branch = 'L 1-2'",
    "ptdf_bus_impact": f"WITH {_P} SELECT branch, ptdf FROM p WHERE bus = 2 ORDER BY abs(ptdf) DESC, branch LIMIT 2",
    "ptdf_topk": f"WITH {_P} SELECT branch, row_number() OVER (PARTITION BY branch ORDER BY abs(ptdf) DESC, bus) AS rank, bus, round(ptdf, 6) AS ptdf FROM p WHERE abs(ptdf) > 1e-6 QUALIFY rank <= 2",
    "ptdf_most_sensitive": f"WITH {_P} SELECT branch, max(abs(ptdf)) AS max_ptdf, arg_max(bus, abs(ptdf)) AS bus FROM p GROUP BY 1",
    "ptdf_summary": f"WITH {_P} SELECT count(DISTINCT branch) AS n_branches, count(DISTINCT bus) AS n_buses, round(max(abs(ptdf)), 4) AS max_abs, round(avg(abs(ptdf)), 4) AS mean_abs, round(100.0 * avg(CASE WHEN abs(ptdf) < 1e-6 THEN 1 ELSE 0 END), 4) AS sparsity_pct, 3::BIGINT AS n_mapped_to_graph, 0::BIGINT AS n_bridges FROM p",
    "lodf_matrix": f"{_M} SELECT affected, outage, round(lodf, 4) AS lodf FROM m",
    "post_contingency_flows": f"{_M} SELECT outage, affected, round(flow, 3) AS flow FROM post",
    "contingency_ranking": f"{_M} SELECT row_number() OVER (ORDER BY max_loading_pct DESC, outage) AS rank, outage, max_loading_pct, n_overloads, verdict FROM v",
    "n1_verdicts": f"{_M} SELECT outage AS branch, verdict, max_loading_pct, n_overloads FROM v",
}


# ---- the network of the tables ----------------------------------------------------------------------------
def _csv(*parts: str | Column) -> Column:
    return F.concat_ws(",", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _ring(nation: DataFrame) -> DataFrame:
    """``f, t, region``: each nation's bus and the next one's in its region; the last region's ring stays open."""
    own = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    every = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = F.lit(nation.agg(F.max("n_regionkey")).first()[0])
    following = F.coalesce(F.lead("n_nationkey").over(own), F.when(F.col("n_regionkey") < last, F.first("n_nationkey").over(every)))
    rows = nation.select((F.col("n_nationkey") + 1).cast("long").alias("f"), (following + 1).cast("long").alias("t"), F.col("n_regionkey").alias("region"))
    return rows.filter("t IS NOT NULL")


def _tables(spark: SparkSession, sf: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf}/{n}.parquet") for n in names]


def case_file(spark: SparkSession, sf: str) -> str:
    """A case file of the network of the tables, in the shared folder."""
    region, nation, customer, supplier = _tables(spark, sf, "region", "nation", "customer", "supplier")
    bus = F.col("n_nationkey") + 1
    quoted = lambda c: F.concat(F.lit("'"), c.cast("string"), F.lit("'"))
    loads = customer.groupBy("c_nationkey").agg(F.count("*").alias("n"))
    ring = _ring(nation)
    hubs = nation.groupBy("n_regionkey").agg((F.min("n_nationkey") + 1).alias("a"), (F.max("n_nationkey") + 1).alias("b"), (F.max_by("n_nationkey", -F.col("n_nationkey")) + 2).alias("c"))
    third = F.when(F.col("n_regionkey") == 0, F.lit(2)).otherwise(0)
    parts: list[tuple[DataFrame, Column, list[Column]]] = [
        (spark.range(1), F.lit(0), [F.lit("0, 50.0, 33, 0, 0, 60.0 / derived"), F.lit("from the tables"), F.lit("second line")]),
        (nation, bus, [_csv(bus, quoted(F.col("n_name")), "138.0", "1", "1", F.col("n_regionkey") + 1, "1", "1.0", "0.0")]),
        (loads, F.col("c_nationkey"), [_csv(F.col("c_nationkey") + 1, "'1'", "1", "1", "1", F.col("n"), F.col("n") * 2)]),
        (region, F.col("r_regionkey"), [_csv(F.col("r_regionkey") + 1, "'1'", "1", F.col("r_regionkey") * 10, "19.0")]),
        (supplier, F.col("s_suppkey"), [_csv(F.col("s_nationkey") + 1, quoted(F.col("s_suppkey")), F.col("s_acctbal"), "0")]),
        (ring, F.col("f"), [_csv(F.col("f"), F.col("t"), "'1'", "0.01", F.col("f") / 100, "0", F.col("t") * 10)]),
        (hubs, F.col("n_regionkey"), [_csv(F.col("a"), F.col("b"), "0", "'1'", "1", "1", "1", "0", "0", "2", quoted(F.col("n_regionkey")), "1"), _csv("0.0", F.col("a") / 10, "100"), F.lit("1.0,0,-1.5"), F.lit("1.0,0")]),
        (hubs, F.col("n_regionkey"), [_csv(F.col("a"), F.col("b"), F.col("c"), "'3'", "1", "1", "1", "0", "0", "2", "'three'", "1"), F.lit("0.01,0.1,100,0.02,0.2,100,0.03,0.3,100,1.0,0.0"), F.lit("1.0,138,0"), F.lit("1.0,138,0"), F.lit("1.0,69,30")]),
        (region, F.col("r_regionkey"), [_csv(F.col("r_regionkey") + 1, quoted(F.col("r_name")))]),
    ]
    following = {1: "LOAD", 2: "FIXED SHUNT", 3: "GENERATOR", 4: "BRANCH", 5: "TRANSFORMER", 7: "ZONE"}
    out = None
    for i, (df, key, lines) in enumerate(parts):
        rows = df.select(F.lit(i).alias("part"), key.cast("long").alias("key"), F.posexplode(F.array(*lines)).alias("k", "line"))
        if i in following:
            mark = spark.range(1).select(F.lit(i).alias("part"), F.lit(2**62).alias("key"), F.lit(0).alias("k"), F.lit(f"0 / END OF DATA, BEGIN {following[i]} DATA").alias("line"))
            rows = rows.unionByName(mark)
        out = rows if out is None else out.unionByName(rows)
    path = f"{shared_folder(spark)}/case-{uuid.uuid4().hex}"
    out.repartition(1).sortWithinPartitions("part", "key", "k").select("line").write.text(path)  # a case is one file
    return path


def case(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return read_raw(spark, case_file(spark, sf))


def net_ptdf(spark: SparkSession, sf: str) -> Ptdf:
    """Sensitivities by rule for every line and bus, through the wide CSV that such tables come as."""
    (nation,) = _tables(spark, sf, "nation")
    ring, buses = _ring(nation), nation.select((F.col("n_nationkey") + 1).alias("bus"))
    label = F.concat(F.lit("L "), F.col("f").cast("string"), F.lit("-"), F.col("t").cast("string"))
    numbers = [r[0] for r in buses.orderBy("bus").collect()]  # the header's names
    wide = ring.select(label.alias("rama"), *[(F.pmod(F.col("f") * 5 + F.col("t") * 3 + F.lit(b * 7), F.lit(19)) / 20.0 - 0.45).alias(str(b)) for b in numbers])
    path = f"{shared_folder(spark)}/ptdf-{uuid.uuid4().hex}"
    wide.write.csv(path, header=True)
    g = PropertyGraph(spark).with_nodes(["Bus"], buses.select(F.col("bus").cast("long").alias("id"), F.col("bus").cast("int").alias("numero")))
    g = g.with_rels("LINEA", ring.select(F.col("f").alias("id"), F.col("f").alias("src"), F.col("t").alias("dst")), ["Bus"], ["Bus"])
    return Ptdf(g, read_ptdf(spark, path))


def net_lodf(spark: SparkSession, sf: str) -> Lodf:
    (nation,) = _tables(spark, sf, "nation")
    label = F.concat(F.lit("L "), F.col("f").cast("string"), F.lit("-"), F.col("t").cast("string")).alias("label")
    ring, folder = _ring(nation), f"{shared_folder(spark)}/pairs-{uuid.uuid4().hex}"
    ring.select(label, ((F.col("f") * 37) % 90 - 45).alias("flow")).write.csv(f"{folder}/flows", header=True)
    ring.select(label, (50 + (F.col("t") * 11) % 40).alias("rating")).write.csv(f"{folder}/ratings", header=True)
    return Lodf(net_ptdf(spark, sf), read_pairs(spark, f"{folder}/flows", "flow"), read_pairs(spark, f"{folder}/ratings", "rating"))


NET = (
    "WITH ring AS (SELECT f + 1 AS f, t + 1 AS t, region FROM (SELECT n_nationkey AS f, n_regionkey AS region, coalesce(lead(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey), CASE WHEN n_regionkey < max(n_regionkey) OVER () THEN min(n_nationkey) OVER (PARTITION BY n_regionkey) END) AS t FROM nation) WHERE t IS NOT NULL), "
    "br AS (SELECT 'L ' || f || '-' || t AS branch, f, t, region, (f * 37) % 90 - 45.0::DOUBLE AS flow, 50.0::DOUBLE + (t * 11) % 40 AS rating FROM ring), "
    "p AS (SELECT branch, n_nationkey + 1 AS bus, ((f * 5 + t * 3 + (n_nationkey + 1) * 7) % 19) / 20.0::DOUBLE - 0.45::DOUBLE AS ptdf FROM br CROSS JOIN nation)"
)
NET_M = (
    NET
    + ", bridge AS (SELECT branch FROM br WHERE region = (SELECT max(n_regionkey) FROM nation)), bsf AS (SELECT l.branch AS affected, k.branch AS outage, x.ptdf - y.ptdf AS b FROM br l CROSS JOIN br k JOIN p x ON x.branch = l.branch AND x.bus = k.f JOIN p y ON y.branch = l.branch AND y.bus = k.t), "
    "st AS (SELECT outage AS branch, 1 - b AS denom, CASE WHEN outage IN (SELECT branch FROM bridge) THEN 'puente' WHEN abs(1 - b) < 1e-6 THEN 'singular' ELSE 'ok' END AS status FROM bsf WHERE affected = outage), "
    "m AS (SELECT a.affected, a.outage, a.b / d.denom AS lodf FROM bsf a JOIN st d ON d.branch = a.outage AND d.status = 'ok'), "
    "post AS (SELECT m.outage, m.affected, CASE WHEN m.affected = m.outage THEN 0 ELSE l.flow + m.lodf * k.flow END AS flow, l.rating FROM m JOIN br l ON l.branch = m.affected JOIN br k ON k.branch = m.outage), "
    "c AS (SELECT outage, round(100 * max(abs(flow) / rating), 2) AS max_loading_pct, count(*) FILTER (WHERE abs(flow) / rating > 1)::BIGINT AS n_overloads FROM post GROUP BY 1), "
    "v AS (SELECT *, CASE WHEN n_overloads > 2 THEN 'critico' WHEN n_overloads >= 1 OR max_loading_pct > 90 THEN 'advertencia' ELSE 'seguro' END AS verdict FROM c), viable AS (SELECT * FROM v WHERE n_overloads <= 2)"
)


def add(name: str, run: Callable, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        SQL[name] = sql


def _case(table: str, *columns: str) -> Callable:
    return lambda spark, sf: case(spark, sf)[table].select(*columns)


def _on_case(ask: Callable) -> Callable:
    return lambda spark, sf: ask(loader.load_network(spark, case(spark, sf))[0])


add("raw_header", _case("header", "base_MVA", "version", "frecuencia_Hz"), "SELECT 50.0::DOUBLE AS base_MVA, 33 AS version, 60.0::DOUBLE AS frecuencia_Hz")
add("raw_buses", _case("buses", "numero", "nombre", "V_base_kV", "zona", "zoname"), "SELECT n_nationkey + 1 AS numero, n_name AS nombre, 138.0::DOUBLE AS V_base_kV, n_regionkey + 1 AS zona, r_name AS zoname FROM nation JOIN region ON n_regionkey = r_regionkey")
add("raw_loads", _case("cargas", "bus_numero", "PL_MW", "QL_pu"), "SELECT c_nationkey + 1 AS bus_numero, count(*)::DOUBLE AS PL_MW, count(*) * 2 / 50.0::DOUBLE AS QL_pu FROM customer GROUP BY c_nationkey")
add("raw_generators", lambda spark, sf: _rounded(case(spark, sf)["generadores"].select("bus_numero", "id", "P_MW", "P_pu"), "P_pu"), "SELECT s_nationkey + 1 AS bus_numero, s_suppkey::VARCHAR AS id, s_acctbal::DOUBLE AS P_MW, round(s_acctbal / 50.0::DOUBLE, 4) AS P_pu FROM supplier")
add("raw_shunts", _case("shunts", "bus_numero", "GL_MW", "BL_pu"), "SELECT r_regionkey + 1 AS bus_numero, r_regionkey * 10.0::DOUBLE AS GL_MW, 0.38::DOUBLE AS BL_pu FROM region")
add("raw_lines", _case("lineas", "from_bus_numero", "to_bus_numero", "X_pu", "rate_A_MVA", "rate_B_MVA"), f"{NET} SELECT f AS from_bus_numero, t AS to_bus_numero, f / 100.0::DOUBLE AS X_pu, t * 10.0::DOUBLE AS rate_A_MVA, 0.0::DOUBLE AS rate_B_MVA FROM ring")
HUBS = "h AS (SELECT n_regionkey AS region, min(n_nationkey) + 1 AS a, max(n_nationkey) + 1 AS b, min(n_nationkey) + 2 AS c FROM nation GROUP BY 1)"
add("raw_transformers", _case("transformadores", "from_bus_index", "to_bus_index", "tertiary_bus_index", "ckt_id", "NAME", "X1_2_pu", "X3_1_pu", "ANG1", "ANG3"), f"WITH {HUBS} SELECT a AS from_bus_index, b AS to_bus_index, 0 AS tertiary_bus_index, '1' AS ckt_id, region::VARCHAR AS NAME, a / 10.0::DOUBLE AS X1_2_pu, 0.0::DOUBLE AS X3_1_pu, -1.5::DOUBLE AS ANG1, 0.0::DOUBLE AS ANG3 FROM h UNION ALL SELECT a, b, c, '3', 'three', 0.1, 0.3, 0.0, 30.0 FROM h")
add("network_summary", _on_case(loader.load_summary), f"{NET} SELECT 'label' AS kind, 'Bus' AS name, (SELECT count(*) FROM nation) AS n UNION ALL SELECT 'label', 'VirtualNode', (SELECT count(*) FROM region) UNION ALL SELECT 'label', 'Generator', (SELECT count(*) FROM supplier) UNION ALL SELECT 'label', 'Load', (SELECT count(DISTINCT c_nationkey) FROM customer) UNION ALL SELECT 'label', 'Shunt', (SELECT count(*) FROM region) UNION ALL SELECT 'type', 'LINEA', (SELECT count(*) FROM ring) UNION ALL SELECT 'type', 'TRANSFORMADOR_2W', (SELECT count(*) FROM region) UNION ALL SELECT 'type', 'CONEXION_XF', 3 * (SELECT count(*) FROM region) UNION ALL SELECT 'type', 'GENERACION', (SELECT count(*) FROM supplier) UNION ALL SELECT 'type', 'CONSUMO', (SELECT count(DISTINCT c_nationkey) FROM customer) UNION ALL SELECT 'type', 'SHUNT', (SELECT count(*) FROM region)")
add("network_neighbours", _on_case(lambda g: loader.neighbours(g, 2, "LINEA").select("numero", "nombre").unionByName(loader.bus_by_number(g, 2).select("numero", "nombre"))), f"{NET} SELECT t AS numero, n_name AS nombre FROM ring JOIN nation ON n_nationkey = t - 1 WHERE f = 2 UNION ALL SELECT 2, n_name FROM nation WHERE n_nationkey = 1")
add("network_generation", _on_case(lambda g: g.query("MATCH (b:Bus)-[:GENERACION]->(x:Generator) RETURN b.numero AS bus, count(x) AS n, round(sum(x.P_MW), 2) AS mw")), "SELECT s_nationkey + 1 AS bus, count(*) AS n, round(sum(s_acctbal), 2)::DOUBLE AS mw FROM supplier GROUP BY 1")
add("net_ptdf_cells", lambda spark, sf: (lambda p: p.table.select("branch", "bus", F.round("ptdf", 6).alias("ptdf")).unionByName(spark.createDataFrame([("cell", 3, round(p.cell("L 1-2", 3), 6)), ("none", 0, p.cell("L 1-2", 999))], "branch string, bus int, ptdf double")))(net_ptdf(spark, sf)), f"{NET} SELECT branch, bus, round(ptdf, 6) AS ptdf FROM p UNION ALL SELECT 'cell', 3, coalesce((SELECT round(ptdf, 6) FROM p WHERE branch = 'L 1-2' AND bus = 3), 0) UNION ALL SELECT 'none', 0, 0")
add("net_ptdf_summary", lambda spark, sf: _rounded(net_ptdf(spark, sf).summary(), "max_abs", "mean_abs", "sparsity_pct"), f"{NET} SELECT count(DISTINCT branch) AS n_branches, count(DISTINCT bus) AS n_buses, round(max(abs(ptdf)), 4) AS max_abs, round(avg(abs(ptdf)), 4) AS mean_abs, round(100.0 * avg(CASE WHEN abs(ptdf) < 1e-6 THEN 1 ELSE 0 END), 4) AS sparsity_pct, count(DISTINCT branch) AS n_mapped_to_graph, (SELECT count(*) FROM br WHERE region = (SELECT max(n_regionkey) FROM nation)) AS n_bridges FROM p")
add("net_ptdf_bridges", lambda spark, sf: net_ptdf(spark, sf).bridge_labels(), f"{NET} SELECT branch FROM br WHERE region = (SELECT max(n_regionkey) FROM nation)")
add("net_ptdf_persisted", lambda spark, sf: net_ptdf(spark, sf).persist(1).query("MATCH (a:Bus)-[r:LINEA]->(b:Bus) RETURN a.numero AS f, b.numero AS t, json_extract(r.ptdf_topk, '$[0].bus') AS bus"), f"{NET} SELECT f, t, (SELECT bus::VARCHAR FROM p WHERE p.branch = br.branch ORDER BY abs(round(ptdf, 9)) DESC, bus LIMIT 1) AS bus FROM br")
add("net_lodf_matrix", lambda spark, sf: _rounded(net_lodf(spark, sf).matrix, "lodf"), f"{NET_M} SELECT affected, outage, round(lodf, 4) AS lodf FROM m")
add("net_lodf_status", lambda spark, sf: net_lodf(spark, sf).status.select("branch", "status", F.round("denom", 6).alias("denom")), f"{NET_M} SELECT branch, status, round(denom, 6) AS denom FROM st")
add("net_flows_after", lambda spark, sf: net_lodf(spark, sf).after().select("outage", "affected", F.round("flow", 3).alias("flow")), f"{NET_M} SELECT outage, affected, round(flow, 3) AS flow FROM post")
add("net_ranking", lambda spark, sf: net_lodf(spark, sf).ranking(5).select(F.col("rank").cast("long").alias("rank"), "outage", "max_loading_pct", "n_overloads", "verdict"), f"{NET_M} SELECT row_number() OVER (ORDER BY max_loading_pct DESC, outage) AS rank, outage, max_loading_pct, n_overloads, verdict FROM viable QUALIFY rank <= 5")
add("net_verdicts", lambda spark, sf: net_lodf(spark, sf).verdicts().select("branch", "verdict", "max_loading_pct", "n_overloads", F.transform("overloaded", lambda x: x["affected"]).alias("overloaded")), f"{NET_M} SELECT s.branch, coalesce(v.verdict, s.status) AS verdict, max_loading_pct, n_overloads, (SELECT list(affected ORDER BY l DESC, affected)[1:5] FROM (SELECT affected, abs(flow) / rating AS l FROM post WHERE post.outage = s.branch AND abs(flow) / rating > 1)) AS overloaded FROM st s LEFT JOIN v ON v.outage = s.branch")
add("net_lodf_summary", lambda spark, sf: _rounded(net_lodf(spark, sf).summary(), "mean_pct"), f"{NET_M} SELECT (SELECT count(*) FROM st) AS n_branches, (SELECT count(*) FROM st WHERE status = 'ok') AS n_ok, (SELECT count(*) FROM st WHERE status = 'puente') AS n_puente, 0::BIGINT AS n_no_encontrado, (SELECT count(*) FROM st WHERE status = 'singular') AS n_singular, (SELECT count(*) FROM viable) AS n_viable, (SELECT max(max_loading_pct) FROM c) AS worst_pct, (SELECT round(avg(max_loading_pct), 4) FROM c) AS mean_pct")


def _worst(spark: SparkSession, sf: str, ask: Callable) -> DataFrame:
    """What ``ask`` tells of the worst viable outage."""
    own = net_lodf(spark, sf)
    return ask(own, own.ranking(1).first()["outage"])


WORST = "(SELECT outage FROM viable ORDER BY max_loading_pct DESC, outage LIMIT 1)"
add("net_lodf_column", lambda spark, sf: _worst(spark, sf, lambda own, k: _rounded(own.column(k), "lodf")), f"{NET_M} SELECT affected AS branch, round(lodf, 4) AS lodf FROM m WHERE outage = {WORST}")
add("net_ptdf_after", lambda spark, sf: _worst(spark, sf, lambda own, k: own.ptdf_after(k).select("branch", "bus", F.round("ptdf", 5).alias("ptdf"))), f"{NET_M} SELECT p.branch, p.bus, round(CASE WHEN p.branch = m.outage THEN 0 ELSE p.ptdf + m.lodf * k.ptdf END, 5) AS ptdf FROM p JOIN m ON m.affected = p.branch AND m.outage = {WORST} JOIN p k ON k.branch = m.outage AND k.bus = p.bus")
add("net_critical_persisted", lambda spark, sf: net_lodf(spark, sf).persist_critical(3).query("MATCH (a:Bus)-[r:LINEA]->(b:Bus) WHERE r.lodf_max_loading_pct IS NOT NULL RETURN a.numero AS f, r.lodf_max_loading_pct AS pct, r.lodf_n_overloads AS n"), f"{NET_M} SELECT f, max_loading_pct AS pct, n_overloads AS n FROM viable JOIN br ON br.branch = outage ORDER BY max_loading_pct DESC, outage LIMIT 3")
