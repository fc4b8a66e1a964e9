"""The pipeline's stages against plain versions of them."""

import hashlib
from collections import Counter

import pytest

import corpus_pipeline
from propgraph.llm import bpe, pii, toxicity
from propgraph.llm.queries import RANKS, tokenizer_path

from .test_near_duplicates import fingerprint, joined
from .test_plain_operators import water

SF = "/root/testdata/sf0.001"


def order_class(n):
    return n if n < 16 else 8 * n.bit_length() + n // 2 ** (n.bit_length() - 4) - 8


def offset(source):
    text = "1:" + ("n" if source is None else "s" + source)
    return int(hashlib.md5(text.encode()).hexdigest()[:12], 16) / 2**48


def plain(docs, labels, net):
    docs = [d for d, s in zip(docs, toxicity.scores(net, [d["text"] for d in docs])) if s < 0.5]
    prints = [fingerprint(d["text"]) for d in docs]
    near = [(i, j) for i in range(len(docs)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    top = joined(range(len(docs)), near)
    least = {}
    for i, d in enumerate(docs):
        least[top[i]] = min(d["doc_id"], least.get(top[i], d["doc_id"]))
    docs = [d for i, d in enumerate(docs) if least[top[i]] == d["doc_id"]]
    rewrite = pii.Rewriter(pii.KEY)
    docs = [d | {"text": rewrite(d["text"])[0] if d["text"] else d["text"]} for d in docs]
    size = {d["doc_id"]: len((d["text"] or "").split()) for d in docs}
    total = Counter()
    for d in docs:
        total[d["source"]] += size[d["doc_id"]]
    target = water(dict(total), {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(total))}, 1.5 * sum(total.values()))
    out = Counter()
    for s in total:
        own = [d for d in docs if d["source"] == s]
        own.sort(key=lambda d: (-order_class(size[d["doc_id"]]), hashlib.md5(str(d["doc_id"]).encode()).hexdigest()))
        rate, u = target[s] / total[s] if total[s] else 0.0, offset(s)
        for k, d in enumerate(own):
            n = int((k + 1) * rate + u) - int(k * rate + u)
            if n:
                out[d["doc_id"], d["text"]] += n
    return out


def test_pipeline(spark):
    docs = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    net = toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), labels)
    want = plain(docs, labels, net)
    rows = corpus_pipeline.run(spark, SF)
    assert all(r["round_trip"] for r in rows.select("round_trip").distinct().collect())
    text = {(r["doc_id"], r["text"]) for r in bpe.decode(rows, tokenizer_path(RANKS)).collect()}
    got = Counter(r["doc_id"] for r in rows.select("doc_id").collect())
    assert got == Counter({d: n for (d, _), n in want.items()})
    assert text == {(d, t or "") for d, t in want}


def test_stages_keep_columns_and_stand_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, table, SF).columns == docs.columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0
    with pytest.raises(Exception):
        corpus_pipeline.run(spark, "/nowhere")
