"""Case files, sensitivities, outages, tools, streams and the commerce graph."""

import pytest

from propgraph.operators import traverse
from propgraph.power import loader, queries
from propgraph.power.lodf import contingency_screening
from propgraph.power.ptdf import Ptdf, read_pairs, read_ptdf
from propgraph.sources import raw
from propgraph.sources.commerce import commerce_graph
from propgraph.streaming import edges as stream
from propgraph.tools import Tools

CASE = """0, 100.00, 33, 0, 1, 60.00 / made up
first title, with 'quotes'
second title
1,'ONE, A', 138.0,3, 1, 7, 1,1.06, 0.0,1.1,0.9,1.1,0.9
2,'TWO', 138.0,1, 1, 7, 1,1.04,-4.9 / a comment
3,'THREE', 69.0,1, 1, 8, 1,1.01,-12
0 / END OF BUS DATA, BEGIN LOAD DATA
2,'1 ',1,1,7, 21.7, 12.7,0,0,0,0,1,1,0
9,'1 ',1,1,7, 5.0, 1.0,0,0,0,0,1,1,0
0 / END OF LOAD DATA, BEGIN FIXED SHUNT DATA
3,'1',1, 2.0, 19.0
0 / END OF FIXED SHUNT DATA, BEGIN GENERATOR DATA
1,'1 ',232.4,-16.9,10.0,0.0,1.06,0,615.0,0,1,0,0,1,1,100,332.4,0.0
0 / END OF GENERATOR DATA, BEGIN BRANCH DATA
1,2,'1 ',0.01938,0.05917,0.0528,100,90,80,0,0,0,0,1,1,12.5,1,1
1,2,'2 ',0.02,0.06,0.05,,x,80,0,0,0,0,1,1,12.5,1,1
2,9,'1 ',0.02,0.06,0.05,1,1,1,0,0,0,0,1,1,0,1,1
0 / END OF BRANCH DATA, BEGIN TRANSFORMER DATA
2,3,0,'1 ',1,1,1,0,0,2,'T two',1,1,1
0.0,0.20912,100
0.978,0,-1.5,0,0,0,0,0,1.1,0.9
1.0,0
1,2,3,'1 ',1,1,1,0,0,2,'T three',1,1,1
0.01,0.1,100,0.02,0.2,100,0.03,0.3,100,1.0,0.0
1.0,138,0,0,0,0,0,0,1.1,0.9
1.0,138,0
1.0,69,30
2,3,0,'2 ',1,1,1,0,0,2,'last',0,1,1
0.0,0.5,100
1.0,0,2.5
1.0,0
0 / END OF TRANSFORMER DATA, BEGIN AREA DATA
0 / END OF AREA DATA, BEGIN ZONE DATA
7,'WEST'
0 / END OF ZONE DATA, BEGIN OWNER DATA
0 / END OF OWNER DATA
Q
"""


@pytest.fixture(scope="module")
def case(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("raw") / "case.raw"
    path.write_text(CASE)
    return raw.read_raw(spark, str(path))


def test_case_file(case):
    h = case["header"].first()
    assert (h["base_MVA"], h["version"], h["frecuencia_Hz"]) == (100.0, 33, 60.0)
    buses = {r["numero"]: r for r in case["buses"].collect()}
    assert buses[1]["nombre"] == "ONE, A" and buses[1]["zoname"] == "WEST" and buses[3]["zoname"] is None and buses[2]["V_ang_deg"] == -4.9 and buses[2]["V_max_pu"] == 0.0
    assert sorted((r["bus_numero"], r["PL_pu"]) for r in case["cargas"].collect()) == [(2, 0.217), (9, 0.05)]
    assert case["shunts"].first()["GL_pu"] == 0.02 and case["generadores"].first()["P_max_MW"] == 332.4
    lines = {(r["from_bus_numero"], r["_CKT"]): r for r in case["lineas"].collect()}
    assert lines[1, "1"]["rate_A_MVA"] == 100 and lines[1, "2"]["rate_A_MVA"] == 0 == lines[1, "2"]["rate_B_MVA"] and lines[1, "1"]["longitud_km"] == 12.5
    xf = {r["NAME"]: r for r in case["transformadores"].collect()}
    assert xf["T two"]["X1_2_pu"] == 0.20912 and xf["T two"]["ANG1"] == -1.5 and xf["T three"]["tertiary_bus_index"] == 3 and xf["T three"]["ANG3"] == 30 and xf["last"]["STAT"] == 0 and xf["last"]["ANG1"] == 2.5


def test_network_graph(spark, case):
    g, lost = loader.load_network(spark, case)
    assert lost == {"lineas": 1, "transformadores": 0, "generadores": 0, "cargas": 1, "shunts": 0}
    n = {(r["kind"], r["name"]): r["n"] for r in loader.load_summary(g).collect()}
    assert n["label", "Bus"] == 3 and n["type", "LINEA"] == 2 and n["type", "CONEXION_XF"] == 3 and n["type", "TRANSFORMADOR_2W"] == 2 and n["label", "VirtualNode"] == 1
    assert traverse.is_connected(g) and [tuple(r) for r in g.query("MATCH (b:Bus)-[:CONSUMO]->(l:Load) RETURN b.numero AS b, l.PL_MW AS p").collect()] == [(2, 21.7)]
    assert loader.neighbours(g, 1, "LINEA").count() == 2 and loader.bus_by_number(g, 3).first()["nombre"] == "THREE"


def test_outages(spark):
    lodf = queries.lodf(spark)
    got = {(r["affected"], r["outage"]): round(r["lodf"], 3) for r in lodf.matrix.collect()}
    assert [got[b, "L 1-2"] for b in ("L 1-2", "L 2-3", "L 1-3")] == pytest.approx([2.8, -1, 1], abs=2e-3)
    assert [got[b, "L 2-3"] for b in ("L 1-2", "L 2-3", "L 1-3")] == pytest.approx([-1, 3.75, 1], abs=2e-3)
    after = {(r["outage"], r["affected"]): r["flow"] for r in lodf.after().collect()}
    assert [after["L 1-2", b] for b in ("L 1-2", "L 2-3", "L 1-3")] == pytest.approx([0, -50, 150], abs=1e-2)
    v = {r["branch"]: r for r in lodf.verdicts().collect()}
    assert (v["L 1-2"]["verdict"], v["L 2-3"]["verdict"], v["L 1-3"]["verdict"]) == ("advertencia", "advertencia", "seguro")
    assert v["L 1-2"]["max_loading_pct"] == pytest.approx(136.36, abs=0.02) and v["L 1-2"]["overloaded"][0]["affected"] == "L 1-3"
    assert lodf.verdict("L 1-3")["verdict"] == "seguro" and lodf.verdict("nope")["verdict"] == "no_encontrado"
    assert [r["outage"] for r in contingency_screening(lodf).collect()] == ["L 1-2", "L 2-3", "L 1-3"]
    assert lodf.flows_after("nope") is None and lodf.column("L 1-2").count() == 3
    new = {(r["branch"], r["bus"]): r["ptdf"] for r in lodf.ptdf_after("L 1-2").collect()}
    assert new["L 1-2", 1] == 0 and new["L 1-3", 1] == pytest.approx(1.0, abs=1e-4)
    assert lodf.worst_case_outage("L 1-3")["outage"] == "L 1-2" and lodf.summary().first()["n_ok"] == 3
    stored = lodf.persist_critical().rels["LINEA"].orderBy("id").collect()
    assert stored[0]["lodf_n_overloads"] == 1 and "L 1-3" in stored[0]["lodf_top_impacted"]
    assert '"bus":2' in lodf.ptdf.persist(2).rels["LINEA"].filter("id = 2").first()["ptdf_topk"]


def test_bridge_and_unknown_branches(spark):
    g = queries.network(spark)
    g = g.replaced(rels={"LINEA": g.rels["LINEA"].filter("id < 3")})
    table = Ptdf(g, spark.createDataFrame([("L 1-2", 1, 1.0), ("L 2-3", 2, 0.5), ("mystery", 1, 0.1)], "branch string, bus int, ptdf double"))
    from propgraph.power.lodf import Lodf

    status = {r["branch"]: r["status"] for r in Lodf(table, spark.createDataFrame([("L 1-2", 1.0)], "label string, flow double")).status.collect()}
    assert status == {"L 1-2": "puente", "L 2-3": "puente", "mystery": "no_encontrado"}


def test_csv_and_tools(spark, tmp_path):
    (tmp_path / "p.csv").write_text("rama,1,2,3\n" + "\n".join(f"{b},{x},{y},{z}" for b, x, y, z in (("L 1-2", 0.526316, -0.210526, 0), ("L 2-3", 0.526316, 0.789474, 0), ("L 1-3", 0.473684, 0.210526, 0))))
    (tmp_path / "f.csv").write_text("a,b\nL 1-2,89.473684\nL 2-3,39.473684\nL 1-3,60.526316\n")
    (tmp_path / "r.csv").write_text("x,y\nL 1-2,200\nL 2-3,150\nL 1-3,110\n")
    assert read_ptdf(spark, str(tmp_path / "p.csv")).count() == 9 and read_pairs(spark, str(tmp_path / "r.csv"), "rating").count() == 3
    t = Tools(spark, queries.network(spark))
    assert t.call("load_ptdf", ptdf_csv=str(tmp_path / "p.csv"), base_flows_csv=str(tmp_path / "f.csv"), ratings_csv=str(tmp_path / "r.csv")).first()["n_branches"] == 3
    assert t.n1_verdict("L 1-2")["verdict"] == "advertencia" and t.ptdf_cell("L 1-2", 1) == 0.526316 and t.ptdf_cell("x", 1) == 0.0
    assert t.full_n1() == {"bridges": 0, "articulation_points": 0, "connected": True, "risk": "low"}
    assert t.fiedler_value()["fiedler_value"] == pytest.approx(3.0) and t.database_info()["nodes"] == 3
    assert [tuple(r) for r in t.list_labels().collect()] == [("Bus", 3)] and t.cypher("MATCH (n) RETURN n.numero AS n").count() == 3
    with pytest.raises(ValueError):
        t.cypher("MATCH (n) DELETE n")
    with pytest.raises(ValueError):
        t.call("_top")
    nodes, rels = t.load_graph(2)
    assert nodes.count() == 2 and rels.count() == 1
    g = t.graph
    g.save(str(tmp_path / "g"))
    assert t.open_database(str(tmp_path / "g")).types() == ["LINEA"]


def test_stream_of_edges(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([(1, 1, 2, 1, False), (2, 2, 3, 1, False)], "id long, src long, dst long, ts long, deleted boolean").coalesce(1).write.parquet(str(source))
    read = lambda: spark.readStream.schema("id long, src long, dst long, ts long, deleted boolean").parquet(str(source))
    stream.upsert_stream(read(), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    spark.createDataFrame([(1, 1, 5, 2, False), (2, 2, 3, 2, True), (3, 3, 4, 2, False), (1, 1, 9, 0, False)], "id long, src long, dst long, ts long, deleted boolean").coalesce(1).write.mode("append").parquet(str(source))
    stream.upsert_stream(read(), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    assert sorted((r["id"], r["dst"]) for r in stream.current(spark, str(tmp_path / "t"), 1).collect()) == [(1, 5), (3, 4)]


def test_commerce_graph_shapes(spark):
    g = commerce_graph(spark, "/root/testdata/sf0.001")
    assert g.rels["FOLLOWS"].count() == 201 and g.rels["MAIN_SUPPLIER"].count() == g.rels["SUPPLIES"].select("dst").distinct().count()
    plan = g.query("MATCH (c:Customer)-[:LOCATED_IN]->(n:Nation) WHERE c.acctbal > 1000 RETURN count(*) AS n")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(c_acctbal), GreaterThan(c_acctbal,1000.0)" in plan and "c_mktsegment" not in plan
