"""Reading and writing queries on a small graph with awkward values."""

import pytest

from propgraph.graph import PropertyGraph
from propgraph.operators import crud
from propgraph.plans.lexer import CypherError
from propgraph.plans.parser import parse
from propgraph.plans.writer import is_read_only


@pytest.fixture(scope="module")
def g(spark):
    nodes = spark.createDataFrame(
        [
            (1, "Bus", '{"name": "Bus_1", "kv": 110, "ok": true, "tags": [1, 2]}'),
            (2, "Bus Slack", '{"name": "bus%1", "kv": 220.5, "w": "0.5"}'),
            (3, "BusBar", '{"name": "BUS1", "kv": 10}'),
            (4, "", "{}"),
        ],
        "id long, labels string, properties string",
    )
    rels = spark.createDataFrame([(1, 1, 2, "LINE", '{"x": 0.1}'), (2, 1, 2, "LINE", '{"x": 0.2}'), (3, 2, 2, "LOOP", "{}"), (4, 2, 3, "LINE", '{"x": 0}')], "id long, src_id long, dst_id long, type string, properties string")
    return PropertyGraph.from_json_tables(spark, nodes, rels)


def rows(g, text, **params):
    return [tuple(r) for r in g.query(text, params).collect()]


READS = [
    ("MATCH (n:Bus) RETURN n.name AS n ORDER BY n", [("Bus_1",), ("bus%1",)]),
    ("MATCH (n:Bus:Slack) RETURN n.kv AS kv", [(220.5,)]),
    ("MATCH (n) RETURN count(*) AS n, count(n.kv) AS k", [(4, 3)]),
    ("MATCH (n) WHERE NOT n:Bus RETURN id(n) AS i ORDER BY i", [(3,), (4,)]),
    ("MATCH (a)-[r]-(b) RETURN count(*) AS n", [(7,)]),
    ("MATCH (a)-[r:LINE]->(b)-[s:LINE]->(c) RETURN count(*) AS n", [(2,)]),
    ("MATCH (a)<--(b) RETURN count(*) AS n", [(4,)]),
    ("MATCH (a {name: 'Bus_1'})-[r:LINE {x: 0.2}]->(b) RETURN id(r) AS r, r.x AS x, type(r) AS t", [(2, 0.2, "LINE")]),
    ("MATCH (n) WHERE n.name CONTAINS 'us' RETURN count(*) AS n", [(2,)]),
    ("MATCH (n:Bus) RETURN n.name + '!' AS s ORDER BY s DESC LIMIT 1", [("bus%1!",)]),
    ("MATCH (n:BusBar) RETURN n.kv * 2 AS a, n.kv / 4 AS b, n.kv % 4 AS c, -n.kv AS d, 2 ^ 3 AS e", [(20, 2, 2, -10, 8.0)]),
    ("MATCH (n:BusBar) RETURN n.kv = '10' AS a, n.kv < 'x' AS b, n.name = 'BUS1' AS c", [(None, None, True)]),
    ("UNWIND [1, null, 3] AS x RETURN sum(x) AS s, count(x) AS c, count(*) AS n, avg(x) AS a", [(4, 2, 3, 2.0)]),
    ("UNWIND [1, 1, 2] AS x RETURN count(DISTINCT x) AS c, sum(DISTINCT x) AS s, min(x) AS lo, max(x) AS hi", [(2, 3, 1, 2)]),
    ("RETURN NOT NOT true AS a, 1 IN [1, 2] AS b, 1 IN [] AS c, null IS NULL AS d, true XOR true AS e", [(True, True, False, True, False)]),
    ("RETURN 1.23456789 AS x, 'a\\'b' AS s, [1, 2, 3][-1] AS l, size([1, 2]) AS n, range(1, 3) AS r", [(1.23456789, "a'b", 3, 2, [1, 2, 3])]),
    ("MATCH (n:Bus) WITH n.kv > 200 AS big, count(*) AS c WHERE c > 0 RETURN big, c ORDER BY big", [(False, 1), (True, 1)]),
    ("MATCH (a)-[*1..2]->(b:BusBar) RETURN count(*) AS n", [(4,)]),
    ("MATCH (a:Bus)-[*0..1]->(b:Bus) RETURN count(*) AS n", [(5,)]),
    ("MATCH (n:Bus) OPTIONAL MATCH (n)-[:LINE]->(m:BusBar) RETURN n.name AS n, m.name AS m ORDER BY n", [("Bus_1", None), ("bus%1", "BUS1")]),
    ("MATCH (n) WHERE EXISTS { (n)-[:LOOP]->(n) } RETURN id(n) AS i", [(2,)]),
    ("MATCH (n) WHERE n.kv > 100 OR NOT (n)--() RETURN id(n) AS i ORDER BY i", [(1,), (2,), (4,)]),
    ("MATCH p = (a:Slack)-[:LINE]->(b) RETURN nodes(p) AS n, relationships(p) AS r, length(p) AS l", [([2, 3], [4], 1)]),
    ("MATCH (n:Slack) RETURN n.name AS x UNION MATCH (n:Slack) RETURN n.name AS x", [("bus%1",)]),
    ("RETURN CASE 2 WHEN 1 THEN 'a' WHEN 2 THEN 'b' END AS x, CASE WHEN false THEN 1 END AS y", [("b", None)]),
    ("RETURN json_set('{\"a\": 1}', '$.b', '2') AS a, json_patch('{\"a\": 1, \"b\": 2}', '{\"a\": null}') AS b, json_remove('{\"a\": 1}', '$.a') AS c, json_valid('{') AS d", [('{"a": 1, "b": 2}', '{"b": 2}', "{}", False)]),
]


@pytest.mark.parametrize("text, want", READS, ids=[t[:50] for t, _ in READS])
def test_reads(g, text, want):
    assert rows(g, text) == want


def test_parameters_and_reference_semantics(g):
    assert rows(g, "MATCH (n) WHERE n.name = $name RETURN id(n) AS i", name="BUS1") == [(3,)]
    got = [r["i"] for r in g.query("MATCH (n) WHERE n.name STARTS WITH 'BUS_' RETURN id(n) AS i ORDER BY i", semantics="reference").collect()]
    assert got == [1, 2, 3]
    assert [tuple(r) for r in g.query("RETURN 1 < 'a' AS a, 1 = '1' AS b, true = 1 AS c, '3' + 4 AS d", semantics="reference").collect()] == [(True, False, True, 7.0)]


@pytest.mark.parametrize("text", ["MATCH (n", "RETURN", "MATCH (n) RETURN m.x AS x", "FOO", "MATCH (n) RETURN nofunc(n.x) AS y", "MATCH (n)", "RETURN $x AS x", "MATCH (n) RETURN n.x AS a, n.y AS a", "RETURN 1 AS x LIMIT -1", "MATCH (n) WHERE 'a' AND true RETURN 1 AS x"])
def test_errors(g, text):
    with pytest.raises(CypherError):
        g.query(text)


def test_read_only_guard():
    assert is_read_only("MATCH (n) WHERE n.name = 'CREATE' RETURN n") and not is_read_only("MATCH (n) DETACH DELETE n") and not is_read_only("match (n) set n.x = 1")
    assert len(parse("// note\nMATCH (`odd name`) RETURN 1 AS x; ignored").parts[0].clauses) == 2


def test_writes(g, tmp_path):
    g2, r = g.execute("CREATE (a:City {name: 'X', n: 1})-[:ROAD {km: 2.5}]->(b:City {name: 'Y'})<-[:ROAD]-(a)")
    assert r.first().asDict() == {"nodes_created": 2, "relationships_created": 2, "properties_set": 0, "labels_changed": 0, "nodes_deleted": 0, "relationships_deleted": 0}
    assert rows(g2, "MATCH (a:City)-[r:ROAD]->(b) RETURN a.name AS a, b.name AS b, r.km AS km ORDER BY km") == [("X", "Y", None), ("X", "Y", 2.5)]
    assert rows(g, "MATCH (a:City) RETURN count(*) AS n") == [(0,)]
    g3, r = g2.execute("MATCH (a:City) SET a.size = 5, a:Big REMOVE a.n RETURN a.name AS name, a.size AS size, a.n AS n, labels(a) AS l ORDER BY name")
    assert [tuple(x) for x in r.collect()] == [("X", 5, None, ["Big", "City"]), ("Y", 5, None, ["Big", "City"])]
    with pytest.raises(ValueError):
        g3.execute("MATCH (a:City {name: 'X'}) DELETE a")
    g4, r = g3.execute("MATCH (a:City {name: 'X'}) DETACH DELETE a")
    assert r.first()["relationships_deleted"] == 2 and rows(g4, "MATCH (a:City) RETURN a.name AS n") == [("Y",)]
    g5, _ = g4.execute("UNWIND ['Y', 'Z', 'Z'] AS k MERGE (c:City {name: k}) ON CREATE SET c.fresh = true ON MATCH SET c.seen = 1")
    assert rows(g5, "MATCH (c:City) RETURN c.name AS n, c.fresh AS f, c.seen AS s ORDER BY n") == [("Y", None, 1), ("Z", True, None)]
    g6, _ = g5.execute("MATCH (a:City {name: 'Y'}), (b:City {name: 'Z'}) MERGE (a)-[:ROAD]->(b)")
    g6, _ = g6.execute("MATCH (a:City {name: 'Y'}), (b:City {name: 'Z'}) MERGE (a)-[:ROAD]->(b)")
    assert rows(g6, "MATCH (:City)-[r:ROAD]->(:City) RETURN count(r) AS n") == [(1,)]
    g6, _ = g6.execute("MATCH (a:City)-[r:ROAD]->() DELETE r")
    g6, _ = g6.execute("MATCH (a:City {name: 'Z'}) SET a += {k: 1, fresh: null} REMOVE a:City")
    assert rows(g6, "MATCH (a {k: 1}) RETURN a.fresh AS f, labels(a) AS l") == [(None, [])] or rows(g6, "MATCH (a {k: 1}) RETURN a.fresh AS f") == [(None,)]
    g6.save(str(tmp_path / "g"))
    again = PropertyGraph.load(g.spark, str(tmp_path / "g"))
    assert rows(again, "MATCH (a) RETURN count(*) AS n") == rows(g6, "MATCH (a) RETURN count(*) AS n")


def test_single_edits(g):
    g1, n = crud.create_node(g, "Bus New", '{"kv": 5, "deep": {"a": 1}}')
    assert crud.get_node(g1, n) == {"id": 5, "labels": ["Bus", "New"], "properties": {"kv": "5.0", "deep": '{"a": 1}'}} or crud.get_node(g1, n)["labels"] == ["Bus", "New"]
    g1 = crud.set_node_property(g1, n, "deep.b", "2")
    assert crud.get_node(g1, n)["properties"]["deep"] == '{"a": 1, "b": 2}'
    g1 = crud.remove_node_property(crud.add_label(g1, n, "BusX"), n, "deep")
    assert "deep" not in crud.get_node(g1, n)["properties"] and crud.get_node(g1, n)["labels"] == ["Bus", "BusX", "New"]
    assert crud.get_node(crud.remove_label(g1, n, "Bus"), n)["labels"] == ["BusX", "New"]
    g2, r = crud.create_rel(g1, 1, n, "LINE", {"x": 3})
    assert crud.get_rel(g2, r)["dst"] == n and crud.get_rel(crud.set_rel_property(g2, r, "x", "4.5"), r)["properties"]["x"] == 4.5
    assert crud.get_rel(crud.delete_rel(g2, r), r) is None and crud.get_node(g2, 99) is None
    for bad in (lambda: crud.create_rel(g1, 1, 99, "T"), lambda: crud.delete_node(g2, n), lambda: crud.create_node(g, "", "{"), lambda: crud.set_node_property(g, 1, "x", "{")):
        with pytest.raises(crud.GraphError):
            bad()
    assert crud.get_node(crud.delete_node(g2, n, detach=True), n) is None
    g3, m = crud.merge_node(g, "Bus", {"name": "Bus_1"}, on_match={"kv": None, "z": 1})
    assert m == 1 and "kv" not in crud.get_node(g3, 1)["properties"] and crud.get_node(g3, 1)["properties"]["z"] == 1
    g3, m = crud.merge_node(g, "Bus", {"name": "new"}, on_create={"z": 2})
    assert crud.get_node(g3, m)["properties"] == {"name": "new", "z": 2}
    assert crud.clear(g3).labels() == []


def test_long_paths_have_no_cap(spark):
    n = 68
    chain = PropertyGraph(spark).with_nodes(["P"], spark.createDataFrame([(i, i) for i in range(n)], "id long, key long"))
    chain = chain.with_rels("NEXT", spark.createDataFrame([(i, i, i + 1) for i in range(n - 1)], "id long, src long, dst long"), ["P"], ["P"])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = rows(chain, "MATCH p = shortestPath((a:P {key: 0})-[:NEXT*]->(b:P)) RETURN b.key AS b, length(p) AS hops ORDER BY b")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == [(i, i) for i in range(1, n)]


def test_exists_in_optional_match(spark):
    g = PropertyGraph(spark).with_nodes(["A"], spark.createDataFrame([(i, i) for i in range(1, 5)], "id long, k long"))
    g = g.with_rels("T", spark.createDataFrame([(1, 1, 2), (2, 2, 3), (3, 1, 4)], "id long, src long, dst long"), ["A"], ["A"])
    text = "UNWIND [1, 1, 2, 4] AS k MATCH (a:A) WHERE a.k = k OPTIONAL MATCH (a)-[:T]->(b) WHERE EXISTS { (b)-[:T]->(c) } RETURN k, b.k AS b ORDER BY k"
    assert rows(g, text) == [(1, 2), (1, 2), (2, None), (4, None)]
    text = text.replace("WHERE EXISTS", "WHERE b.k = 4 OR NOT EXISTS")
    assert rows(g, text) == [(1, 4), (1, 4), (2, 3), (4, None)]
