"""Vectors of a minority length link within their length."""

from propgraph.llm import embed_dedup


def test_each_width_within_itself(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [1.0, 0.0, 0.0]), (5, [1.0, 0.0, 0.0]), (6, [1.0, 0.1, 0.0]), (7, [0.0]), (8, None)]
    frame = spark.createDataFrame(rows + [(9, [0.0, -1.0])], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.near_duplicates(frame).collect()}
    want = {1: (1, 1, True), 2: (1, 1, False), 4: (2, 4, True), 5: (2, 4, False), 6: (2, 4, False)}
    assert got == want | {i: (0, i, True) for i in (3, 7, 8, 9)}
