"""Near-duplicate embeddings by tiles of int8 products with rigorous error bounds.

Vectors are scaled to length one and rounded to 8 bits with a scale of their own. The product of two
codes misses the cosine by at most e_a + e_b + e_a * e_b, where e is the length of a vector's
rounding error, measured for that vector. A pair whose product plus that bound stays below the
threshold is ruled out; only the others are computed again in double precision. Products of 8-bit
codes are summed exactly in single precision, where they stay under 2^24 for up to 1,040 dimensions
(wider vectors are multiplied in slices).

Equal vectors are one class with a count, so copies meet once. Classes are dealt into tiles of
bounded size by hash; a tile travels to each of the others it is compared with. Tiles carry the cone
(centre and largest angle) of their vectors, and two whose cones are further apart than the
threshold's angle are not multiplied. A tile pair gives each class's count of links and a star per
group, so dense groups leave it as few rows as they have members.

All-pairs tiles take work that grows with the square of the distinct vectors; the bounds make each
pair cheap, not their number small. Vectors of different lengths never link; each length is compared
within itself. Vectors that are null, zero, or hold null or non-finite components link with nothing:
they have no links and stay. An empty table gives no rows; repeated ids are rows of their own, and a
null id takes part in links but names no component unless its component has no other. Only the id and
embedding columns are looked at, so names of others do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .common import cut, lookup

THRESHOLD = 0.9
TILE = 16_384
#: Doubles that a tile may hold, whatever the width of its vectors.
TILE_VALUES = 1 << 20
#: Rows multiplied at once within a tile pair.
STRIP = 512


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, scales and bounds on the length of the rounding error (with room for double rounding)."""
    scale = np.abs(unit).max(axis=1) / 127.0
    codes = np.rint(unit / scale[:, None])
    error = np.linalg.norm(unit - codes * scale[:, None], axis=1) + 1e-12
    return codes.astype(np.int8), scale, error


def code_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of 8-bit codes."""
    out = a[:, :1024].astype(np.float32) @ b[:, :1024].astype(np.float32).T
    for at in range(1024, a.shape[1], 1024):
        out = out.astype(np.float64) + a[:, at : at + 1024].astype(np.float32) @ b[:, at : at + 1024].astype(np.float32).T
    return out


class Tile:
    """Vectors of one tile with what pairs of tiles need."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, vectors: np.ndarray):
        self.keys, self.counts = keys, counts
        vectors = vectors / np.abs(vectors).max(axis=1)[:, None]  # first, so that no square over- or underflows
        self.unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
        self.codes, self.scale, self.error = quantise(self.unit)
        centre = self.unit.mean(axis=0)
        length = np.linalg.norm(centre)
        self.centre = centre / length if length > 1e-6 else None
        self.angle = float(np.arccos(np.clip(self.unit @ self.centre, -1, 1)).max()) if self.centre is not None else np.pi


def apart(a: Tile, b: Tile, threshold: float) -> bool:
    """Whether the tiles' cones rule out every pair between them."""
    if a.centre is None or b.centre is None:
        return False
    between = float(np.arccos(np.clip(a.centre @ b.centre, -1, 1)))
    return between - a.angle - b.angle > np.arccos(threshold) + 1e-9


def tile_pairs(a: Tile, b: Tile, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of linked pairs, strip by strip; within one tile each pair once."""
    if apart(a, b, threshold):
        return
    same = a is b
    for at in range(0, len(a.keys), STRIP):
        end = min(at + STRIP, len(a.keys))
        first = at if same else 0
        rough = code_product(a.codes[at:end], b.codes[first:])
        # product * s_a * s_b + e_a + e_b + e_a * e_b >= threshold, solved for the product
        s, e = a.scale[at:end], a.error[at:end]
        bar = np.multiply.outer(((threshold - e) / s).astype(np.float32), (1 / b.scale[first:]).astype(np.float32))
        bar -= np.multiply.outer(((1 + e) / s).astype(np.float32), (b.error / b.scale)[first:].astype(np.float32))
        bar -= np.float32(1 + 1e-6 * float(np.abs(bar).max(initial=0)))  # far above single precision's rounding
        i, j = np.nonzero(rough >= bar)
        i, j = i + at, j + first
        if same:
            keep = i < j
            i, j = i[keep], j[keep]
        for k in range(0, len(i), 1 << 17):
            x, y = i[k : k + (1 << 17)], j[k : k + (1 << 17)]
            good = np.einsum("ij,ij->i", a.unit[x], b.unit[y]) >= threshold
            if good.any():
                yield x[good], y[good]


def _compare(threshold: float):
    def run(key: tuple, batch: pa.Table) -> pa.Table:
        _, p, q = (k.as_py() for k in key)
        side = batch.column("tile").to_numpy()
        tiles = {}
        for t in {p, q}:
            own = batch.filter(pa.array(side == t))
            flat = own.column("data").combine_chunks()
            flat = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            tiles[t] = Tile(own.column("key").to_numpy(), own.column("n").to_numpy(), flat.reshape(own.num_rows, -1)) if own.num_rows else None
        a, b = tiles[p], tiles[q]
        links: dict[int, int] = {}
        stars: list[tuple[int, int]] = []
        if a is not None and b is not None:
            size = len(a.keys)
            names = a.keys if a is b else np.concatenate([a.keys, b.keys])
            group = np.arange(len(names))
            count = np.zeros(len(names), np.int64)

            def top(x: int) -> int:
                while group[x] != x:
                    group[x] = group[group[x]]
                    x = int(group[x])
                return x

            for i, j in tile_pairs(a, b, threshold):
                np.add.at(count, i, b.counts[j])
                j_at = j if a is b else j + size
                np.add.at(count, j_at, a.counts[i])
                fresh = group[i] != group[j_at]  # most pairs of a dense group are joined already
                for x, y in zip(i[fresh].tolist(), j_at[fresh].tolist()):
                    x, y = top(x), top(y)
                    if x != y:
                        group[max(x, y)] = min(x, y)
                for _ in range(2):
                    group = group[group]
            links = {int(names[k]): int(count[k]) for k in np.flatnonzero(count)}
            stars = [(int(names[k]), int(names[top(k)])) for k in np.flatnonzero(count)]
        return pa.table({"key": pa.array([s[0] for s in stars], pa.int64()), "root": pa.array([s[1] for s in stars], pa.int64()), "links": pa.array([links[s[0]] for s in stars], pa.int64())})

    return run


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every vector."""
    e = F.col(embedding)
    sound = e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.when(sound, e).alias("e"))
    rows = cut(rows.withColumnRenamed("e", "vector"))
    classes = rows.filter("vector IS NOT NULL").groupBy("vector").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    classes = cut(classes.withColumn("key", F.monotonically_increasing_id()))
    n, total, width = classes.agg(F.count("*"), F.sum("n"), F.max(F.size("vector"))).first()
    most = min(tile, max(256, TILE_VALUES // max(1, width or 0)))
    tiles = max(1, -(-n // max(min(1024, most), min(most, n // 16))))  # some tiles in any case, so that pairs of them spread
    other = F.sequence(F.lit(0), F.lit(tiles - 1))
    dealt = classes.select("key", "n", F.col("vector").alias("data"), F.size("vector").alias("d"), F.pmod(F.xxhash64("key"), F.lit(tiles)).cast("int").alias("tile"))
    dealt = dealt.withColumn("with", F.explode(other)).select("key", "n", "data", "d", "tile", F.least("tile", "with").alias("p"), F.greatest("tile", "with").alias("q"))
    found = cut(dealt.groupBy("d", "p", "q").applyInArrow(_compare(threshold), "key long, root long, links long"))
    counts = found.groupBy("key").agg(F.sum("links").alias("links"))
    # a node is a class with its least id, ordered by that, so a component's root carries its name
    node = classes.select("key", F.struct(F.col("least").isNull().alias("none"), "least", "key").alias("node"))
    near = found.filter("key <> root").select("key", "root")
    for side in ("key", "root"):
        near = near.join(node.select(F.col("key").alias(side), F.col("node").alias(f"node_{side}")), side)
    roots = components(near, "node_key", "node_root", few=0).select(F.col("node.key").alias("key"), F.col("root.least").alias("top"), F.lit(True).alias("linked"))
    named = classes.join(roots, "key", "left").join(counts, "key", "left")
    name = F.when(F.col("linked"), F.col("top")).otherwise(F.col("least"))
    named = named.select(F.col("vector").alias("v"), "n", name.alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    linked = lookup(rows.filter("vector IS NOT NULL"), "vector", named, "v", "n", total or 0).select("vec_id", "n_links", "component_id")
    alone = rows.filter("vector IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
