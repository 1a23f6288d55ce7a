"""Versions that arrive as a stream, each compared with the one before it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from docdelta.plans.pipeline import Engine


def successive(texts: DataFrame) -> DataFrame:
    """(pair_id, side, text) from (document, version, text): every version but the first with the one before it."""
    order = Window.partitionBy("document").orderBy("version")
    rows = texts.withColumn("before", F.lag(F.struct("version", "text")).over(order)).where("before is not null")
    pair = F.concat_ws("|", "document", F.col("before.version").cast("string"), F.col("version").cast("string"))
    sides = F.array(F.struct(F.lit("v1").alias("side"), F.col("before.text").alias("text")), F.struct(F.lit("v2").alias("side"), F.col("text").alias("text")))
    return rows.select(pair.alias("pair_id"), F.explode(sides).alias("s")).select("pair_id", "s.side", "s.text")


def compare_stream(stream: DataFrame, history: str, checkpoint: str, handle: Callable[[DataFrame, int], None], available_now: bool = False) -> StreamingQuery:
    """Compare each arriving (document, version, text) with the latest earlier version of its document.

    ``history`` is a folder of Parquet that keeps what has arrived, a part for
    each batch, so a batch that runs again replaces its own part; ``handle``
    gets the changes of a batch and its number.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        rows.write.mode("overwrite").parquet(f"{history}/batch={number}")
        seen = spark.read.schema(rows.schema).option("basePath", history).parquet(f"{history}/batch=*")
        seen = seen.withColumn("batch", F.regexp_extract(F.col("_metadata.file_path"), r"batch=(\d+)", 1).cast("long")).where(F.col("batch") <= number)
        now = seen.where(F.col("batch") == number)
        latest = seen.where(F.col("batch") < number).join(now.select("document").distinct(), "document", "left_semi")
        latest = latest.withColumn("r", F.row_number().over(Window.partitionBy("document").orderBy(F.desc("version")))).where("r = 1").drop("r")
        changes = Engine(spark).compare_texts(successive(now.drop("batch").unionByName(latest.drop("batch")))).changes
        handle(changes, number)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
