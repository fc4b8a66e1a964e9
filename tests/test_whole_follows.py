"""The view of a query over all of FOLLOWS, on the given tables."""

from collections import Counter

from propgraph import queries

SF = "/root/testdata/sf0.01"


def test_view_takes_the_greatest_degrees(spark):
    e = queries.commerce_graph(spark, SF).rels["FOLLOWS"].select("src", "dst").collect()
    degree = Counter(n for r in e for n in r)
    want = sorted(degree, key=lambda n: (-degree[n], n))[:500]
    got = [r["id"] for r in queries.queries()["query_subgraph_all"](spark, SF).collect()]
    assert sorted(got) == sorted(want)
