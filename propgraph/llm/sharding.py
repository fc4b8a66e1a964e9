"""Sharding over fixed virtual slots.

Records hash into a fixed number of slots. Bytes and rows are summed per slot, and a versioned map
says which shard holds each slot. Rebalancing edits the map and never rehashes a record: a new
version moves as few slots as evenness allows. What reaches the driver is one row per slot, a number
that does not grow with the data.

Null or empty text has 0 bytes and the checksum of empty text. A null id hashes like any other
value. Records hash by id and text together, so equal texts of different ids lie in different slots
and may lie in different shards; rows that repeat exactly share a slot unless one record has more rows
than a slot has on average, which are then dealt over all slots. A very long text is one record of its
size. Columns besides id and text are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut

SLOTS = 4096
#: Bytes that a record takes besides its text.
HEADER = 8


@dataclass(frozen=True)
class SlotMap:
    """Shard of each slot. ``moved`` lists what the last edit changed."""

    version: int
    shards: int
    shard_of: tuple[int, ...]
    moved: tuple[int, ...] = field(default=())

    @staticmethod
    def fill(sizes: list[int], shards: int) -> SlotMap:
        """Version 1: the largest slot goes to the least loaded shard, again and again."""
        heap = [(0, 0, s) for s in range(shards)]
        owner = [0] * len(sizes)
        for slot in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            load, held, shard = heapq.heappop(heap)
            owner[slot] = shard
            heapq.heappush(heap, (load + sizes[slot], held + 1, shard))
        return SlotMap(1, shards, tuple(owner))

    def rebalance(self, sizes: list[int], shards: int | None = None, tolerance: float = 0.01) -> SlotMap:
        """The next version: slots leave overfull shards, largest that fits first, until all are within ``tolerance`` of the mean."""
        shards = shards or self.shards
        owner = list(self.shard_of)
        load, own = [0] * shards, [[] for _ in range(shards)]
        homeless = []
        for slot, shard in enumerate(owner):
            if shard < shards:
                load[shard] += sizes[slot]
                own[shard].append(slot)
            else:
                homeless.append(slot)
        mean = sum(sizes) / shards
        moved = []
        for shard in range(shards):
            own[shard].sort(key=lambda i: (-sizes[i], i))
            for slot in list(own[shard]):
                if load[shard] <= mean * (1 + tolerance):
                    break
                if sizes[slot] and load[shard] - sizes[slot] >= mean * (1 - tolerance):
                    load[shard] -= sizes[slot]
                    homeless.append(slot)
        heap = [(x, s) for s, x in enumerate(load)]
        heapq.heapify(heap)
        for slot in sorted(homeless, key=lambda i: (-sizes[i], i)):
            x, shard = heap[0]
            if owner[slot] < shards and x >= mean * (1 - tolerance):
                continue  # no shard is short: the slot stays where it was
            heapq.heapreplace(heap, (x + sizes[slot], shard))
            if owner[slot] != shard:
                owner[slot] = shard
                moved.append(slot)
        return replace(self, version=self.version + 1, shards=shards, shard_of=tuple(owner), moved=tuple(sorted(moved)))

    def save(self, spark: SparkSession, path: str) -> None:
        """Add this version to the map's table. Versions are never written over."""
        rows = [(slot, shard, self.shards) for slot, shard in enumerate(self.shard_of)]
        frame = spark.createDataFrame(rows, "slot int, shard int, shards int").coalesce(1)
        frame.write.mode("errorifexists").parquet(f"{path}/version={self.version}")

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        table = spark.read.option("basePath", path).schema("slot int, shard int, shards int, version int").parquet(path)
        version = version or table.agg(F.max("version")).first()[0]
        rows = table.filter(F.col("version") == version).orderBy("slot").collect()
        return SlotMap(version, rows[0]["shards"], tuple(r["shard"] for r in rows))


def stored(spark: SparkSession, path: str, sizes: list[int], shards: int) -> SlotMap:
    """The map at ``path`` for these sizes: made there, or the latest version edited; read back as the table has it."""
    try:
        held = SlotMap.load(spark, path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        held = None
    new = held.rebalance(sizes, shards) if held else SlotMap.fill(sizes, shards)
    if held is None or new.moved or new.shards != held.shards:
        new.save(spark, path)
    return SlotMap.load(spark, path)


def dealt(rows: DataFrame, slots: int) -> DataFrame:
    """``rows`` with records that repeat more often than a slot has rows on average dealt over all slots.

    Fewer records than slots can repeat so often; only slots that are far over the average are searched.
    """
    counts = slot_sizes(rows, slots)[1]
    mean = max(1, sum(counts) // slots)
    full = [i for i, n in enumerate(counts) if n > 4 * mean]
    if not full:
        return rows
    key = ["doc_id", "text_crc32", "size"]
    often = rows.filter(F.col("virtual_slot").isin(full)).groupBy(*key).count().filter(F.col("count") > mean)
    own = F.struct(*key)
    often = F.broadcast(often.select(own.alias("often")))  # fewer rows than slots
    spread = F.pmod(F.xxhash64(*key, F.monotonically_increasing_id()), F.lit(slots)).cast("int")
    rows = rows.withColumn("spread", spread).join(often, own == F.col("often"), "left")  # two structs compare equal where both fields are null
    return cut(rows.select(*key, F.when(F.col("often").isNotNull(), F.col("spread")).otherwise(F.col("virtual_slot")).alias("virtual_slot")))


def records(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """Id, size, checksum and virtual slot of each record."""
    body = F.coalesce(F.col(text), F.lit(""))
    crc = F.crc32(body)
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(body).cast("long") + HEADER).alias("size"),
        crc.alias("text_crc32"),
    ).withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int"))


def slot_sizes(rows: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of every slot; one row a slot reaches the driver."""
    size, count = [0] * slots, [0] * slots
    for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():
        size[r["virtual_slot"]], count[r["virtual_slot"]] = int(r["b"]), int(r["n"])
    return size, count


def shard(docs: DataFrame, shards: int = 24, slot_map: SlotMap | None = None, doc_id: str = "doc_id", text: str = "text", slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Put every record into a shard, and number the records of each shard from 0.

    Returns ``doc_id, size, text_crc32, virtual_slot, shard, slot, map_version``. With ``map_path`` the
    map stored there is used, edited to a next version if these sizes ask for it, or made; else
    ``slot_map``, or one made for even bytes. Numbering runs within virtual slots side by side; the
    slots' offsets come from their counts.
    """
    rows = dealt(cut(records(docs, doc_id, text, slots)), slots)
    sizes, counts = slot_sizes(rows, slots)
    if map_path:
        slot_map = stored(docs.sparkSession, map_path, sizes, shards)
    slot_map = slot_map or SlotMap.fill(sizes, shards)
    used, table = [0] * slot_map.shards, []
    for slot, owner in enumerate(slot_map.shard_of):
        table.append((slot, owner, used[owner]))
        used[owner] += counts[slot]
    owners = docs.sparkSession.createDataFrame(table, "virtual_slot int, shard int, first long")
    order = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("place", F.row_number().over(order) - 1)
        .join(F.broadcast(owners), "virtual_slot")  # one row a slot
        .select("doc_id", "size", "text_crc32", "virtual_slot", "shard", (F.col("first") + F.col("place")).alias("slot"), F.lit(slot_map.version).alias("map_version"))
    )
