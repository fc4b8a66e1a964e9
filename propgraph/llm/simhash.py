"""SimHash near-duplicates: fingerprints of word shingles, found through pivot distance tables.

Each distinct fingerprint carries its Hamming distances to 16 reference fingerprints. Two
fingerprints that differ in r bits have distances to any reference that differ by r at most, so a
pair whose tables differ by more than the radius in some coordinate is discarded unseen; survivors
are verified.

Tables alone leave every pair to be looked at: a distance to a 64-bit reference has a standard
deviation of 4, so one coordinate at radius 4 discards only 43 % of unrelated pairs, and cells of
several coordinates with the neighbours they need hold more rows than they save. So pairs meet in
bands first: the 64 bits are cut into segments, and fingerprints within the radius agree in all but
``radius`` segments. Each set of agreeing segments is a band, which loses no pair. The number of
segments grows with the number of fingerprints, so bands stay short. Within a band a search from
fingerprint to fingerprint drops what it has reached, so thousands of copies cost little more than
their number, and links leave a band as a star.

Empty and null texts have fingerprint zero, linked like any other. A null id takes part in links but
names no component unless its component has no other. Repeated rows share a fingerprint. An empty
table gives no rows. Whole texts are read: a very long one is hashed shingle by shingle and its bits
are counted ``PART`` shingles at a time. Only the id and text columns are looked at, so names of
others do not matter; ``deduplicate`` returns all columns as they were.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import FEW, components
from .common import cut, lean, lookup

SHINGLE = 4
RADIUS = 4
SEED = 42
PIVOTS = 16
#: Fingerprints that a band should hold on average, at most.
BAND = 64
#: Shingles hashed at once, and those whose bits are spread out at once.
BATCH = 200_000
PART = 8192


def pivots(n: int = PIVOTS) -> list[int]:
    """Reference fingerprints: seeded random, so that distances to them are nearly independent."""
    rng = random.Random(20)
    return [rng.getrandbits(64) for _ in range(n)]


def shingle_hashes(text: str | None, size: int) -> list[int]:
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: lower() takes A-Z only, split() the six ASCII spaces
    if not words:
        return []
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return [digest(joined, SEED)]
    ends = np.cumsum([len(w) + 1 for w in words])
    begins = np.concatenate([[0], ends[:-size]])
    return [digest(joined[a:b], SEED) for a, b in zip(begins.tolist(), (ends[size - 1 :] - 1).tolist())]


def fingerprint_batch(hashes: list[list[int]]) -> np.ndarray:
    """Signed 64-bit fingerprints: a bit is 1 if set in over half of a text's hashes."""
    out = np.zeros(len(hashes), np.uint64)
    lengths = np.array([len(h) for h in hashes], np.int64)
    full = np.flatnonzero(lengths)
    if len(full):
        flat = np.fromiter((x for h in hashes for x in h), np.uint64, int(lengths.sum()))
        own = lengths[full]
        counts, ends = np.zeros((len(full), 64), np.int64), np.cumsum(own)
        for a in range(0, len(flat), PART):
            bits = np.unpackbits(flat[a : a + PART].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            first, last = np.searchsorted(ends, [a, a + len(bits) - 1], "right")
            begins = np.maximum(ends[first : last + 1] - own[first : last + 1] - a, 0)
            counts[first : last + 1] += np.add.reduceat(bits, begins, axis=0, dtype=np.int64)
        out[full] = np.packbits(2 * counts > own[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out.view(np.int64)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` of every whole text."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, own, n, prints = 0, [], 0, []
            for t in batch.column(1):
                own.append(shingle_hashes(t.as_py(), size))
                n += len(own[-1])
                if n > BATCH:
                    prints.append(fingerprint_batch(own))
                    own, n = [], 0
            prints.append(fingerprint_batch(own))
            done = np.concatenate(prints)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(done)], ["doc_id", "fp"])

    return docs.select(doc_id, text).mapInArrow(lean(run), f"doc_id {kind}, fp long")


def segments(n: int, radius: int = RADIUS, most: int = BAND) -> list[int]:
    """Bit borders of the fewest segments whose bands hold ``most`` of ``n`` fingerprints on average."""
    for k in range(radius + 1, radius + 5):
        bits = (k - radius) * 64 // k
        if n <= most << bits:
            break
    return [64 * i // k for i in range(k + 1)]


def bands(fp: Column, borders: list[int], radius: int) -> Column:
    """Keys of the bands of a fingerprint: its bits in each choice of segments, beside the choice's number."""
    k = len(borders) - 1
    keys = []
    for number, chosen in enumerate(combinations(range(k), k - radius)):
        mask = sum(((1 << (borders[s + 1] - borders[s])) - 1) << borders[s] for s in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(number).cast("short").alias("t"), fp.bitwiseAND(F.lit(signed)).alias("key")))
    return F.array(*keys)


def pivot_table(fp: Column, references: list[int]) -> list[Column]:
    """Distances to the references, eight to a long."""
    out = []
    for at in range(0, len(references), 8):
        packed = F.lit(0).cast("long")
        for i, p in enumerate(references[at : at + 8]):
            d = F.bit_count(fp.bitwiseXOR(F.lit(p - (1 << 64) if p >> 63 else p))).cast("long")
            packed = packed.bitwiseOR(F.shiftleft(d, 8 * i))
        out.append(packed.alias(f"d{at // 8}"))
    return out


def band_links(fp: np.ndarray, table: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Star links of one band. ``table`` holds a row of pivot distances for each fingerprint."""
    m = len(fp)
    links: list[tuple[int, int]] = []
    if m < 2:
        return links
    table = table.astype(np.int16)
    if m <= 96:
        near = (np.abs(table[:, None, :] - table[None, :, :]).max(axis=2) <= radius) & np.tri(m, k=-1, dtype=bool)
        i, j = np.nonzero(near)
        good = np.bitwise_count(fp[i] ^ fp[j]) <= radius
        return list(zip(fp[i[good]].tolist(), fp[j[good]].tolist()))
    open_ = np.arange(m)
    while len(open_):
        root, open_ = int(open_[0]), open_[1:]
        todo = [root]
        while todo and len(open_):
            x = todo.pop()
            left = np.arange(len(open_))
            for column in range(table.shape[1]):
                left = left[np.abs(table[open_[left], column] - table[x, column]) <= radius]
                if not len(left):
                    break
            left = left[np.bitwise_count(fp[open_[left]] ^ fp[x]) <= radius]
            if len(left):
                got = open_[left]
                links += [(int(fp[g]), int(fp[root])) for g in got]
                todo += got.tolist()
                open_ = np.delete(open_, left)
    return links


def _band_kernel(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links_of(parts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
            return band_links(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), radius)

        held: list[tuple[np.ndarray, np.ndarray]] = []
        last = None
        out: list[tuple[int, int]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            t, key, fp, *packed = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            table = np.stack(packed, axis=1).astype(np.int64).view(np.uint8).reshape(len(fp), -1)
            change = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
            edges = [0, *change.tolist(), len(fp)]
            for a, b in zip(edges, edges[1:]):
                now = (int(t[a]), int(key[a]))
                if now != last and held:
                    out += links_of(held)
                    held = []
                last = now
                held.append((fp[a:b].copy(), table[a:b].copy()))
            if len(out) > 50_000:
                yield _pairs(out)
                out = []
        if held:
            out += links_of(held)
        yield _pairs(out)

    return run


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = (np.array(x, np.int64) for x in zip(*links)) if links else (np.zeros(0, np.int64),) * 2
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def links(distinct: DataFrame, n: int, radius: int = RADIUS, most: int = BAND) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints (column ``fp``) that connect all within the radius."""
    fp = F.col("fp")
    rows = distinct.select("fp", *pivot_table(fp, pivots()), F.explode(bands(fp, segments(n, radius, most), radius)).alias("band"))
    rows = rows.select("band.t", "band.key", "fp", "d0", "d1")
    return rows.repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(_band_kernel(radius), "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, radius: int = RADIUS, few: int = 0) -> DataFrame:
    """``doc_id, fp, component_id`` of every document; the component is named by its least id.

    A node is a fingerprint together with the least id that has it, ordered by that id, so the root of a
    component carries the component's name. Fingerprints that many documents share meet them by a
    broadcast (``lookup``). ``few``: links of which one node may gather all in one task, for smaller
    plans; the rows are the same.
    """
    prints = cut(fingerprints(docs, doc_id, text, size))
    node = F.struct(F.col("least").isNull().alias("none"), "least", "fp")
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).select("fp", "n", node.alias("node")))
    found = distinct.agg(F.count("*"), F.sum("n")).first()
    near = links(distinct, found[0], radius)
    for side in ("a", "b"):
        near = near.join(distinct.select(F.col("fp").alias(side), F.col("node").alias(f"node_{side}")), side)
    roots = components(near, "node_a", "node_b", few=few).select(F.col("node.fp").alias("print"), F.col("root.least").alias("top"), F.lit(True).alias("linked"))
    by_print = distinct.join(roots, F.col("fp") == F.col("print"), "left")
    by_print = by_print.select(F.col("fp").alias("print"), "n", F.when(F.col("linked"), F.col("top")).otherwise(F.col("node.least")).alias("component_id"))
    return lookup(prints, "fp", by_print, "print", "n", found[1] or 0).select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that stay: of each component one, the least by id (null ids last), then by digest of the text.

    Exactly repeated rows are told apart by nothing; of those that stay the first met does. Whole rows
    move once: the join and the choice among repeated rows share one key.
    """
    digest = F.unhex(F.md5(F.col(text)))
    key = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), digest.alias("digest"))
    found = near_duplicates(docs.select(key.alias("doc_id"), F.col(text).alias("text")), "doc_id", "text", size, radius, FEW)
    stay = found.filter("doc_id <=> component_id").select(F.col("doc_id").alias("__stay")).distinct()
    rows = docs.withColumn("__key", key)  # a struct is never null, and equals another where both hold the same nulls
    return rows.join(stay, F.col("__key") == F.col("__stay"), "left_semi").dropDuplicates(["__key"]).drop("__key")
