"""Near-duplicate operators and components against brute force."""

import random
import re

import numpy as np
import pytest

from propgraph.llm import embed_dedup, simhash
from propgraph.operators import components

from . import helpers

SF = "/root/testdata/sf0.001"


def joined(nodes, pairs):
    """Least node that each reaches."""
    top = {n: n for n in nodes}

    def find(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(60)] + [(100 + rng.randrange(80), 100 + rng.randrange(80)) for _ in range(50)] + [(500, 500 + i) for i in range(1, 40)]
    nodes = {n for p in pairs for n in p if p[0] != p[1]}
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == joined(nodes, [p for p in pairs if p[0] != p[1]])
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def fingerprint(text):
    import xxhash

    words = helpers.WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_tables(spark):
    for table in (helpers.awkward(spark), spark.read.parquet(f"{SF}/documents.parquet")):
        docs = [(r["doc_id"], fingerprint(r["text"])) for r in table.collect()]
        nodes = range(len(docs))
        top = joined(nodes, [(i, j) for i in nodes for j in range(i) if (docs[i][1] ^ docs[j][1]).bit_count() <= 4])
        least = {}
        for i, (d, _) in enumerate(docs):
            if d is not None:
                least[top[i]] = min(d, least.get(top[i], d))
        want = sorted((str(d), f, str(least.get(top[i]))) for i, (d, f) in enumerate(docs))
        got = sorted((str(r["doc_id"]), r["fp"] % (1 << 64), str(r["component_id"])) for r in simhash.near_duplicates(table).collect())
        assert got == want
    assert simhash.near_duplicates(helpers.empty(spark)).count() == 0
    kept = [r["doc_id"] for r in simhash.deduplicate(helpers.awkward(spark)).select("doc_id").collect()]
    assert sorted(map(str, kept)) == ["1", "2", "4", "5", "7", "9", "None"]
    assert simhash.deduplicate(helpers.awkward(spark)).columns == helpers.awkward(spark).columns


def planted(n, rng):
    """Fingerprints with chains, dense groups and strangers; some share a band without being near."""
    out = {rng.getrandbits(64) for _ in range(n)}
    centre = rng.getrandbits(64)
    for _ in range(n):
        out.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))))
    at = rng.getrandbits(64)
    for _ in range(30):
        at ^= sum(1 << b for b in rng.sample(range(64), 4))
        out.add(at)
    low = rng.getrandbits(13)
    out |= {rng.getrandbits(51) << 13 | low for _ in range(n)}
    return [f - (1 << 64) if f >> 63 else f for f in out]


@pytest.mark.parametrize("most", [64, 1])
def test_simhash_links_lose_nothing(spark, most):
    prints = planted(260, random.Random(7))
    frame = spark.createDataFrame([(f,) for f in prints], "fp long")
    found = simhash.links(frame, len(prints) if most == 64 else 10**6, most=most).collect()
    assert all(((r["a"] ^ r["b"]) % (1 << 64)).bit_count() <= 64 for r in found)
    got = joined(prints, [(r["a"], r["b"]) for r in found])
    x = np.array(prints, np.int64)
    i, j = np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= 4)
    assert got == joined(prints, [(prints[a], prints[b]) for a, b in zip(i, j)])


def brute_vectors(rows):
    sound = [(n, v, e) for n, (v, e) in enumerate(rows) if e and all(x is not None and np.isfinite(x) for x in e) and any(e) and len(e) == 8]
    m = np.array([e for _, _, e in sound], float)
    m = m / np.abs(m).max(axis=1)[:, None]
    m /= np.linalg.norm(m, axis=1)[:, None]
    near = m @ m.T >= 0.9 - 1e-12
    np.fill_diagonal(near, False)
    top = joined(range(len(sound)), list(zip(*np.nonzero(near))))
    least = {}
    for i, (_, v, _) in enumerate(sound):
        least[top[i]] = min(v, least.get(top[i], v))
    out = {n: (v, 0, v) for n, (v, _) in enumerate(rows)}
    for i, (n, v, _) in enumerate(sound):
        out[n] = (v, int(near[i].sum()), least[top[i]])
    return sorted(out.values())


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    rows = []
    for g in range(40):
        centre = rng.normal(size=8)
        for _ in range(int(rng.integers(1, 9))):
            rows.append((centre + rng.normal(size=8) * rng.choice([0, 0.1, 0.3])).tolist())
    rows += [rows[0]] * 7 + [[x * 1e-200 for x in rows[1]], [x * 1e200 for x in rows[1]]]
    rows += [None, [0.0] * 8, [1.0, None] + [0.0] * 6, [float("nan")] + [1.0] * 7, [float("inf")] + [1.0] * 7, [1.0] * 3, []]
    rows = list(enumerate(rows))
    frame = spark.createDataFrame([(v, e, 1, 1) for v, e in rows], "vec_id long, embedding array<double>, label int, key int")
    for tile in (4096, 17):
        got = embed_dedup.near_duplicates(frame, tile=tile).collect()
        assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == brute_vectors(rows)
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert embed_dedup.near_duplicates(frame.limit(0)).count() == 0


def test_quantisation_bound_holds():
    rng = np.random.default_rng(5)
    m = rng.normal(size=(300, 64)) ** 3
    m /= np.linalg.norm(m, axis=1)[:, None]
    codes, scale, error = embed_dedup.quantise(m)
    product = embed_dedup.code_product(codes, codes) * scale[:, None] * scale[None, :]
    bound = error[:, None] + error[None, :] + error[:, None] * error[None, :]
    assert (np.abs(product - m @ m.T) <= bound).all()
