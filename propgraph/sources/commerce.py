"""Property graphs over the star schema and event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import PropertyGraph

#: A node's id is its kind's code times this, plus its key.
SPREAD = 10**12
REGION, NATION, CUSTOMER, SUPPLIER, PART, ORDER, USER = range(1, 8)


def node_id(code: int, key: str | Column) -> Column:
    return (F.lit(code * SPREAD) + F.col(key) if isinstance(key, str) else F.lit(code * SPREAD) + key).cast("long")


def rel_id(code: int, key: Column, second: Column | None = None) -> Column:
    """Types with one key number from code * 10^15, pairs of keys from code * 10^18."""
    if second is None:
        return (F.lit(code * 10**15) + key).cast("long")
    return (F.lit(code * 10**18) + key.cast("long") * 10**8 + second).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def purchases_in_turn(events: DataFrame) -> DataFrame:
    """``src, dst, event_id, weight`` of each purchase and the one before it by (ts, event_id).

    The step back stays within a day, but for a day's first purchase, whose forerunner is the last of
    the day before that has one: only one row a day is ordered as a whole.
    """
    own = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts", "value", F.to_date("ts").alias("day"))
    daily = own.groupBy("day").agg(F.max_by("user_id", F.struct("ts", "event_id")).alias("last"))
    earlier = daily.select("day", F.lag("last").over(Window.orderBy("day")).alias("carried"))
    before = F.lag("user_id").over(Window.partitionBy("day").orderBy("ts", "event_id"))
    rows = own.withColumn("before", before).join(earlier, "day").withColumn("src", F.coalesce("before", "carried"))
    return rows.filter("src IS NOT NULL").select("src", F.col("user_id").alias("dst"), "event_id", F.col("value").cast("double").alias("weight"))


def commerce_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Regions, nations, customers, suppliers, parts, orders and users with what joins them."""

    def t(name: str) -> DataFrame:
        return table(spark, sf_dir, name)

    region, nation, customer, supplier, part, orders, lines, events = map(t, "region nation customer supplier part orders lineitem events".split())
    g = PropertyGraph(spark)
    g = g.with_nodes(["Region"], region.select(node_id(REGION, "r_regionkey").alias("id"), F.col("r_regionkey").cast("long").alias("key"), F.col("r_name").alias("name")))
    g = g.with_nodes(["Nation"], nation.select(node_id(NATION, "n_nationkey").alias("id"), F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name")))
    g = g.with_nodes(
        ["Customer"],
        customer.select(node_id(CUSTOMER, "c_custkey").alias("id"), F.col("c_custkey").cast("long").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").cast("double").alias("acctbal"), F.col("c_mktsegment").alias("segment")),
    )
    g = g.with_nodes(["Supplier"], supplier.select(node_id(SUPPLIER, "s_suppkey").alias("id"), F.col("s_suppkey").cast("long").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").cast("double").alias("acctbal")))
    g = g.with_nodes(
        ["Part"],
        part.select(node_id(PART, "p_partkey").alias("id"), F.col("p_partkey").cast("long").alias("key"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("ptype"), F.col("p_size").cast("int").alias("size"), F.col("p_retailprice").cast("double").alias("price")),
    )
    g = g.with_nodes(
        ["Order"],
        orders.select(
            node_id(ORDER, "o_orderkey").alias("id"), F.col("o_orderkey").cast("long").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").cast("double").alias("total"), F.col("o_orderdate").cast("timestamp").alias("odate"), F.col("o_orderpriority").alias("priority")
        ),
    )
    g = g.with_nodes(["User"], events.select(node_id(USER, "user_id").alias("id"), F.col("user_id").cast("long").alias("key")).distinct())
    g = g.with_rels("IN_REGION", nation.select(rel_id(1, F.col("n_nationkey")).alias("id"), node_id(NATION, "n_nationkey").alias("src"), node_id(REGION, "n_regionkey").alias("dst")), ["Nation"], ["Region"])
    g = g.with_rels("LOCATED_IN", customer.select(rel_id(2, node_id(CUSTOMER, "c_custkey")).alias("id"), node_id(CUSTOMER, "c_custkey").alias("src"), node_id(NATION, "c_nationkey").alias("dst")), ["Customer"], ["Nation"])
    g = g.with_rels("LOCATED_IN", supplier.select(rel_id(2, node_id(SUPPLIER, "s_suppkey")).alias("id"), node_id(SUPPLIER, "s_suppkey").alias("src"), node_id(NATION, "s_nationkey").alias("dst")), ["Supplier"], ["Nation"])
    g = g.with_rels("PLACED", orders.select(rel_id(3, F.col("o_orderkey")).alias("id"), node_id(CUSTOMER, "o_custkey").alias("src"), node_id(ORDER, "o_orderkey").alias("dst")), ["Customer"], ["Order"])
    contains = lines.groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").cast("double").alias("qty"), F.count("*").alias("lines"))
    g = g.with_rels("CONTAINS", contains.select(rel_id(4, F.col("l_orderkey"), F.col("l_partkey")).alias("id"), node_id(ORDER, "l_orderkey").alias("src"), node_id(PART, "l_partkey").alias("dst"), "qty", "lines"), ["Order"], ["Part"])
    g = g.with_rels("SUPPLIES", _pairs(lines, 5), ["Supplier"], ["Part"])
    sold = lines.groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("sold"))
    main = sold.groupBy("l_partkey").agg(F.max(F.struct("sold", (-F.col("l_suppkey")).alias("s"))).alias("m")).select("l_partkey", (-F.col("m.s")).alias("l_suppkey"))
    g = g.with_rels("MAIN_SUPPLIER", main.select(rel_id(6, F.col("l_partkey")).alias("id"), node_id(PART, "l_partkey").alias("src"), node_id(SUPPLIER, "l_suppkey").alias("dst")), ["Part"], ["Supplier"])
    main = sold.groupBy("l_suppkey").agg(F.max(F.struct("sold", (-F.col("l_partkey")).alias("p"))).alias("m")).select("l_suppkey", (-F.col("m.p")).alias("l_partkey"))
    g = g.with_rels("MAIN_PART", main.select(rel_id(8, F.col("l_suppkey")).alias("id"), node_id(SUPPLIER, "l_suppkey").alias("src"), node_id(PART, "l_partkey").alias("dst")), ["Supplier"], ["Part"])
    follows = purchases_in_turn(events)
    return g.with_rels("FOLLOWS", follows.select((F.lit(7 * 10**18) + F.col("event_id")).cast("long").alias("id"), node_id(USER, "src").alias("src"), node_id(USER, "dst").alias("dst"), "weight"), ["User"], ["User"])


def _pairs(lines: DataFrame, code: int) -> DataFrame:
    pairs = lines.select("l_suppkey", "l_partkey").distinct()
    return pairs.select(rel_id(code, F.col("l_suppkey"), F.col("l_partkey")).alias("id"), node_id(SUPPLIER, "l_suppkey").alias("src"), node_id(PART, "l_partkey").alias("dst"))
