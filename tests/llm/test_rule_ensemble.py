"""Statistics, rules as columns against rules in numpy, and held-out accuracy."""

import zlib

import numpy as np

from propgraph.llm import rule_ensemble

from . import helpers
from .test_toxicity import auc

SF = "/root/testdata/sf0.1"


def test_columns_score_as_numpy_and_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = rule_ensemble.fit(docs, labels, most=2500)
    assert 0 < len(model.rules) <= 250
    rows = rule_ensemble.statistics(docs).join(rule_ensemble.score(docs, model), "doc_id").join(labels, "doc_id").toPandas()
    x = rows[list(rule_ensemble.STATISTICS)].to_numpy(float)
    assert np.allclose(model(x), rows["score"])
    own = np.array([zlib.crc32(str(d).encode()) % 4 == 2 for d in rows["doc_id"]])
    assert auc(rows["score"].to_numpy()[own], rows["quality"].to_numpy()[own]) > 0.98


def test_lasso_is_sparse_and_optimal():
    rng = np.random.default_rng(1)
    m = (rng.random((800, 12)) < 0.5).astype(float)
    y = (rng.random(800) < 1 / (1 + np.exp(2 - 4 * m[:, 3]))).astype(float)
    w, b = rule_ensemble.lasso(m, y, penalty=0.02, rounds=3000)
    p = 1 / (1 + np.exp(-(m @ w + b)))
    g = m.T @ (p - y) / len(y)
    assert abs((p - y).mean()) < 1e-5 and w[3] > 1 and (w == 0).sum() >= 6
    assert np.all(np.abs(g[w == 0]) <= 0.02 + 1e-5) and np.allclose(g[w != 0], -0.02 * np.sign(w[w != 0]), atol=1e-5)


def test_statistics_by_hand(spark):
    r = rule_ensemble.statistics(spark.createDataFrame([(1, "The the the X1!\n\nthe end\nthe end")], "doc_id long, text string")).first()
    assert r["n_words"] == 8 and r["mean_word_chars"] == 24 / 8 and r["adjacent_ratio"] == 1 / 8 and r["dup_line_ratio"] == 1 / 3
    assert r["distinct_ratio"] == 4 / 8 and r["upper_ratio"] == 2 / 24 and r["digit_ratio"] == 1 / 24 and r["mark_ratio"] == 1 / 8


def test_awkward_rows_and_no_labels(spark):
    table = helpers.awkward(spark)
    labels = spark.createDataFrame([(1, 1, 1), (4, 0, 1), (5, 0, 1), (9, 0, 1), (None, 1, 1), (7, None, 1)], "doc_id long, quality int, text int")
    for own in (labels, labels.limit(0)):
        model = rule_ensemble.fit(table, own)
        rows = rule_ensemble.score(table, model).collect()
        assert len(rows) == table.count() and all(0 <= r["score"] <= 1 for r in rows)
        assert rule_ensemble.score(helpers.empty(spark), model).count() == 0
