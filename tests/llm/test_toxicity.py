"""The network's gradients, windows and held-out accuracy."""

import re
import zlib

import numpy as np

from propgraph.llm import toxicity

from . import helpers

SF = "/root/testdata/sf0.1"


def auc(score, y):
    rank = np.empty(len(score))
    rank[np.argsort(score, kind="stable")] = np.arange(len(score))
    pos = (y == 1).sum()
    return (rank[y == 1].sum() - pos * (pos - 1) / 2) / (pos * (len(y) - pos))


def test_windows_cover_and_overlap():
    for n in (0, 1, 31, 32, 33, 56, 57, 500):
        spans = toxicity.windows_of(n)
        assert {i for a, b in spans for i in range(a, b)} == set(range(n))
        assert all(b2 > b1 and a2 < b1 for (_, b1), (a2, b2) in zip(spans, spans[1:]))


def test_gradients_match_differences():
    net = toxicity.Net.fresh(0.3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    g = rng.normal(size=(2, 6, 3 * toxicity.HIDDEN))
    g[:, -1] = 0
    at = rng.integers(0, 6, size=(5, 3))
    at[3:, 0] = 5
    at[0] = 1
    d = rng.normal(size=3)
    logit, saved = net.forward(g, at, keep=True)
    grad, d_g = net.backward(g, at, d, saved)
    for k in ("u", "a", "v", "o", "c"):
        flat = net.p[k].reshape(-1)
        for i in range(0, len(flat), max(1, len(flat) // 5)):
            flat[i] += 1e-3
            up = net.forward(g, at) @ d
            flat[i] -= 2e-3
            down = net.forward(g, at) @ d
            flat[i] += 1e-3
            assert abs((up - down) / 2e-3 - grad[k].reshape(-1)[i]) < 2e-3
    for i in ((0, 1, 2), (1, 2, 20), (0, 3, 10)):
        g[i] += 1e-3
        up = net.forward(g, at) @ d
        g[i] -= 2e-3
        down = net.forward(g, at) @ d
        g[i] += 1e-3
        assert abs((up - down) / 2e-3 - d_g[i]) < 2e-3


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    net = toxicity.fit(docs, labels, most=2500)
    rows = toxicity.score(docs.join(labels.select("doc_id"), "doc_id"), net).toPandas().merge(labels.toPandas(), on="doc_id")
    own = rows[[zlib.crc32(str(d).encode()) % 5 == 0 for d in rows["doc_id"]]]
    assert auc(own["score"].to_numpy(), own["toxic"].to_numpy()) > 0.9
    assert ((own["score"] >= 0.5) & (own["toxic"] == 0)).mean() < 0.02


def test_awkward_rows_and_no_labels(spark):
    table = helpers.awkward(spark)
    labels = spark.createDataFrame([(1, 1, 1), (4, 0, 1), (5, 0, 1), (9, 0, 1), (None, 1, 1), (7, None, 1)], "doc_id long, toxic int, text int")
    net = toxicity.fit(table, labels)
    rows = toxicity.score(table, net).collect()
    assert len(rows) == table.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score(helpers.empty(spark), net).count() == 0
    assert toxicity.reject(table, net).columns == table.columns
    none = toxicity.fit(table, labels.limit(0))
    assert {r["score"] for r in toxicity.score(table, none).collect()} == {0.0}
    assert toxicity.reject(table, none).count() == table.count()


def by_hand(net, text):
    """The score of a text by plain loops over its words, in double precision."""
    p = {k: v.astype(float) for k, v in net.p.items()}
    h = toxicity.HIDDEN
    words = re.findall(r"\w+", text.lower())

    def vector(word):
        code, buckets = f"<{word}>".encode(), []
        for n in toxicity.GRAMS:
            for i in range(len(code) - n + 1):
                mixed = n
                for byte in code[i : i + n]:
                    mixed = (mixed * 0x01000193 + byte) % 2**32
                buckets.append(mixed * 2654435761 % 2**32 >> 32 - toxicity.CHAR_BITS)
        return np.concatenate([p["word"][toxicity.grams_of([word])[0][0]], np.mean([p["char"][g] for g in buckets], axis=0)])

    def gru(xs, side):
        w, b, u = p["w"][:, side * 3 * h : (side + 1) * 3 * h], p["b"][side * 3 * h : (side + 1) * 3 * h], p["u"][side]
        state, out = np.zeros(h), []
        for x in xs:
            g, m = x @ w + b, state @ u
            z, r = 1 / (1 + np.exp(-g[:h] - m[:h])), 1 / (1 + np.exp(-g[h : 2 * h] - m[h : 2 * h]))
            state = (1 - z) * np.tanh(g[2 * h :] + r * m[2 * h :]) + z * state
            out.append(state)
        return out

    best = -np.inf
    for a in range(0, max(1, len(words)), toxicity.STRIDE):
        xs = [vector(w) for w in words[a : a + toxicity.SPAN]]
        states = [np.concatenate(x) for x in zip(gru(xs, 0), gru(xs[::-1], 1)[::-1])]
        weight = np.exp([np.tanh(s @ p["a"]) @ p["v"] for s in states])
        best = max(best, sum(w * s for w, s in zip(weight / weight.sum(), states)) @ p["o"] + p["c"][0])
        if a + toxicity.SPAN >= len(words):
            break
    return 1 / (1 + np.exp(-best))


def test_scores_by_hand(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = toxicity.fit(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), most=300)
    texts = [r["text"] for r in docs.filter("doc_id % 97 = 3").collect()] + ["one", "Ünïcode ñandú 漢字 x", "a b " * 40]
    got = toxicity.scores(net, texts)
    for text, s in zip(texts, got):
        assert abs(by_hand(net, text) - s) < 1e-4


def test_sample_holds_whole_texts_within_its_bound(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "w " * (500 if i == 3 else 10)) for i in range(40)] * 2, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "train", lambda texts, y: (texts, y))
    texts, y = toxicity.fit(docs, labels)
    free = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5]
    assert len(texts) == len(free) == len(y) and sorted(map(len, texts))[-1] == (1000 if 3 in free else 20)
    less, _ = toxicity.fit(docs, labels, characters=200)
    assert 0 < len(less) <= 10 and sum(map(len, less)) <= 200 and {len(t) for t in less} == {20}
