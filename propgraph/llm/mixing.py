"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, target / source size, at most 2.
Along a fixed order of the source's documents these expectations are summed; one random offset per
source is added; a document is emitted once for each integer that its stretch crosses. So a document
has floor or ceiling of its expectation, and counts are exact up to one per source.

The order runs over size classes, then the md5 of the id. A document's place in it is the place
within its cell (source, size class, first two hex digits of the md5) plus the counts of the cells
before: no task holds a source, and what is summed along a source is one row per cell, a number
bounded by the classes, not by the documents.

Null text has size 0; null is a source of its own, last in order; a null id sorts first and hashes
as empty text. Repeated rows are rows of their own. Rows of one id and size follow a hash of the text
where the text is carried; rows that agree in that, too, are alike. Very long texts are counted whole;
they count as one document of their size. Columns of the input keep their names, whatever they are.
An empty table gives no rows.

With two hexadecimal digits a source of 2e10 documents has about a million in a cell. Rows of one id
share a cell for each size class, which is the one thing that is not split further.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, n_words

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0


def size_class(size: Column) -> Column:
    """Eight classes for each power of two, by integer arithmetic."""
    bits = F.length(F.bin(size))
    return F.when(size < 16, size).otherwise(bits * 8 + F.floor(size / F.pow(F.lit(2.0), bits - 4)) - 8).cast("int")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Target of each source, from one row (source, source_size) per source.

    Shares by weight stop at ``most`` times the source's size. Sources stop in order of cap / weight,
    so the level at which the rest stands follows from prefix sums along that order.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    level = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(named) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    t = t.withColumn("ratio", F.col("cap") / F.col("weight"))
    t = t.withColumn("total", F.sum("source_size").over(everything) * share).withColumn("weights", F.sum("weight").over(everything))
    t = t.withColumn("stand", (F.col("total") - F.coalesce(F.sum("cap").over(level), F.lit(0.0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(level), F.lit(0.0))))
    t = t.withColumn("stand", F.min(F.when(F.col("stand") <= F.col("ratio"), F.struct("ratio", "stand"))).over(everything)["stand"])
    return t.select("source", "source_size", F.least("cap", F.coalesce(F.col("stand") * F.col("weight"), F.col("cap"))).alias("target"))


def offset(source: Column, seed: int) -> Column:
    """The one random offset of a source, in [0, 1): 48 bits of a keyed md5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), _named(source)))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(1 << 48)


def _named(source: Column) -> Column:
    """A source as text that is never null, so that plain equality joins and windows share one exchange."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def place(docs: DataFrame, doc_id: str, text: str, source: str, carry: list[str], weights: tuple[int, ...], share: float, seed: int) -> DataFrame:
    """Columns ``carry`` of all documents, with ``size, source_size, target, copies``."""
    digest = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    tie = F.xxhash64(text) if text in carry else F.lit(0)
    body = docs.select(*[F.col(c).alias(f"in_{c}") for c in carry], F.col(source).alias("source"), n_words(F.col(text)).alias("size"), F.col(doc_id).alias("id"), digest.alias("digest"), tie.alias("tie"))
    body = body.withColumn("kind", size_class(F.col("size"))).withColumn("salt", F.substring("digest", 1, 2)).withColumn("key", _named(F.col("source")))
    if text not in carry:
        body = cut(body)  # thin rows: words are counted once
    cell = ["key", "kind", "salt"]
    counts = cut(body.groupBy("source", *cell).agg(F.count("*").alias("n"), F.sum("size").alias("words")))
    goals = targets(counts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share).withColumn("key", _named(F.col("source"))).drop("source")
    along = Window.partitionBy("key").orderBy(F.col("kind").desc(), "salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = counts.withColumn("before", F.coalesce(F.sum("n").over(along), F.lit(0))).join(goals, "key").select(*cell, "before", "source_size", "target")
    rank = F.row_number().over(Window.partitionBy(*cell).orderBy("digest", "id", "size", "tie"))
    rows = body.withColumn("rank", rank).join(cells, cell)
    at = F.col("before") + F.col("rank")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    u = offset(F.col("source"), seed)
    copies = (F.floor(at * rate + u) - F.floor((at - 1) * rate + u)).cast("int")
    return rows.select(*[F.col(f"in_{c}").alias(c) for c in carry], F.col("size").alias("__size"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), copies.alias("__copies"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, seed: int = 1) -> DataFrame:
    """What the mix takes of each document: ``doc_id, size, source_size, target, copies, taken``."""
    rows = place(docs, doc_id, text, source, [doc_id], weights, share, seed)
    return rows.select(
        F.col(doc_id).alias("doc_id"),
        F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        F.col("__copies").alias("copies"),
        (F.col("__copies") * F.col("__size")).alias("taken"),
    )


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, seed: int = 1) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken."""
    rows = place(docs, doc_id, text, source, docs.columns, weights, share, seed)
    return rows.filter("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)
