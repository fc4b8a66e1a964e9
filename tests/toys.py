"""Small graphs whose values are known."""

from propgraph.graph import PropertyGraph


def graph(spark, edges, nodes=(), kind="LINE", label="Bus", props="", node_props="name string"):
    """``edges``: (id, src, dst, *props); ``nodes``: more ids."""
    ids = sorted({x for e in edges for x in e[1:3]} | set(nodes))
    g = PropertyGraph(spark)
    g = g.with_nodes([label], spark.createDataFrame([(i, f"b{i}") for i in ids], f"id long, {node_props}"))
    schema = "id long, src long, dst long" + (f", {props}" if props else "")
    return g.with_rels(kind, spark.createDataFrame(edges, schema), [label], [label])


def ring(spark):
    return graph(spark, [(1, 1, 2, 0.10, 200.0), (2, 2, 3, 0.08, 200.0), (3, 3, 4, 0.05, 150.0), (4, 1, 4, 0.20, 100.0)], props="x_pu double, rate_mva double")


def barbell(spark):
    return graph(spark, [(1, 1, 2), (2, 2, 3), (3, 1, 3), (4, 3, 4), (5, 4, 5), (6, 5, 6), (7, 4, 6)])


def directed(spark):
    return graph(spark, [(1, 1, 2), (2, 2, 3), (3, 3, 1), (4, 3, 4), (5, 4, 5), (6, 5, 4)], nodes=[6])


def values(df, key="node_id"):
    return {r[0]: r[1] for r in df.collect()}
