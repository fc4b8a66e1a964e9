"""Of each group of near copies exactly one row stays, whatever the ids."""

from propgraph.llm import simhash


def test_shared_and_null_ids(spark):
    a, b, c = ("red cars drive along the road to town", "nine blue whales sing under cold arctic ice", "a recipe for bread with salt and rye flour")
    rows = [(1, a), (1, b), (2, b), (None, c), (None, c), (None, a), (None, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["text"]) for r in simhash.deduplicate(docs).collect()), key=str)
    assert got == sorted([(1, a), (1, b), (None, c), (3, "")], key=str)
    assert simhash.deduplicate(docs).columns == docs.columns
