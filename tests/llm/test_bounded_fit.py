"""What the toxicity fit takes to the driver."""

from pyspark.sql import DataFrame

from propgraph.llm import toxicity


def test_repeated_ids_do_not_pass_the_bound(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 10, f"text {i}") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, toxic int")
    taken = []
    plain = type(docs).toPandas
    monkeypatch.setattr(type(docs), "toPandas", lambda self: taken.append(plain(self)) or taken[-1])
    monkeypatch.setattr(toxicity, "train", lambda texts, y: (texts, y))
    texts, y = toxicity.fit(docs, labels, most=7)
    assert isinstance(docs, DataFrame) and [len(t) for t in taken] == [7] == [len(texts)] and len(y) == 7
    assert toxicity.fit(docs, labels, most=7) == (texts, y)


def test_fit_takes_eight_thousand_labels():
    assert toxicity.SAMPLE == 8000
