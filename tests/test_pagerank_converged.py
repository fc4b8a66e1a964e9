"""PageRank run to its tolerance, against many more rounds in plain arrays."""

import numpy as np
import pytest

from propgraph import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["pagerank_converged", "pagerank_weighted_converged"])
def test_ranks_are_within_tolerance(spark, name):
    rows = queries.commerce_graph(spark, SF).rels["FOLLOWS"].select("id", "src", "dst", "weight").collect()
    nodes = sorted({n for r in rows for n in (r["src"], r["dst"])})
    at, n = {v: i for i, v in enumerate(nodes)}, len(nodes)
    k = np.zeros((n, n))
    for r in sorted(rows, key=lambda r: r["id"]):
        if "weighted" in name:
            k[at[r["src"]], at[r["dst"]]] = r["weight"] or 1.0
        else:
            k[at[r["src"]], at[r["dst"]]] += 1
    out = k.sum(axis=1)
    share = np.divide(k, out[:, None], out=np.zeros_like(k), where=out[:, None] > 0)
    x = np.full(n, 1 / n)
    for _ in range(500):
        x = 0.15 / n + 0.85 * (x[out == 0].sum() / n + x @ share)
    got = {r["node_id"]: r["rank"] for r in queries.queries()[name](spark, SF).collect()}
    assert set(got) == set(nodes)
    assert sum(abs(got[v] - x[at[v]]) for v in nodes) < 1e-6 * 0.85 / 0.15
