"""Kernels over texts hold a bounded share of what they are given."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from propgraph.llm import common, simhash


def plain(hashes):
    """Fingerprint of one text, bit by bit."""
    bits = sum((2 * sum(h >> k & 1 for h in hashes) > len(hashes)) << k for k in range(64))
    return bits - (1 << 64) if bits >> 63 else bits


def test_bits_are_counted_in_parts(monkeypatch):
    rng = random.Random(5)
    texts = [[rng.getrandbits(64) for _ in range(n)] for n in (0, 1, 7, 8, 16, 3, 0, 0, 40, 1, 8)]
    for part in (1, 3, 8, 1000):
        monkeypatch.setattr(simhash, "PART", part)
        assert simhash.fingerprint_batch(texts).tolist() == [plain(t) for t in texts]
    assert simhash.fingerprint_batch([[], []]).tolist() == [0, 0]


def test_long_text_stays_small():
    hashes = np.random.default_rng(1).integers(0, 1 << 63, 300_000).tolist()
    tracemalloc.start()
    simhash.fingerprint_batch([hashes])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6  # all bits as longs are 154 MB


def test_kernels_get_small_parts():
    texts = ["x" * n for n in (0, 5, 9_000_000, 1, 2)] + ["y" * 1000] * 9000
    batch = pa.RecordBatch.from_pydict({"i": list(range(len(texts))), "t": texts})
    seen = []

    def kernel(batches):
        for b in batches:
            seen.append((b.num_rows, b.nbytes))
            yield b

    out = pa.Table.from_batches(common.lean(kernel)(iter([batch, batch.slice(0, 0)])))
    assert out.equals(pa.Table.from_batches([batch]))
    assert all(rows <= 1 or size <= common.PIECE for rows, size in seen) and len(seen) < 20
