"""Edges that arrive as a stream, kept as a table of the latest state of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest(changes: DataFrame, order: str = "ts") -> DataFrame:
    """The last change of each relationship id, deletions (column ``deleted``) left out."""
    last = Window.partitionBy("id").orderBy(F.desc(order))
    rows = changes.withColumn("·k", F.row_number().over(last)).filter("`·k` = 1").drop("·k")
    return rows.filter(~F.coalesce("deleted", F.lit(False))) if "deleted" in changes.columns else rows


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, order: str = "ts") -> StreamingQuery:
    """Each micro-batch writes the next version ``version=N`` of the edge table; a repeated batch writes the same one again.

    ``stream`` has ``id, src, dst``, the order column and perhaps ``deleted`` and properties.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        if number:
            df = spark.read.parquet(f"{path}/version={number - 1}").unionByName(df, allowMissingColumns=True)
        last = Window.partitionBy("id").orderBy(F.desc(order))
        df.withColumn("·k", F.row_number().over(last)).filter("`·k` = 1").drop("·k").write.mode("overwrite").parquet(f"{path}/version={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str, version: int, order: str = "ts") -> DataFrame:
    return latest(spark.read.parquet(f"{path}/version={version}"), order)
