"""Tumbling bars as a stream: watermark, update mode, one upsert for each batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.panels import bars


def stream_bars(spark: SparkSession, path: str, schema, out: str, checkpoint: str, minutes: int = 360) -> None:
    """Run what is there through the stream; every batch writes its changed bars to a folder of its own, so a repeated batch overwrites itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    source = spark.readStream.schema(schema).parquet(path).withWatermark("ts", "1 hour")
    query = bars(source, minutes).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def latest(spark: SparkSession, out: str) -> DataFrame:
    """The bars as the last batch that touched them left them."""
    rows = spark.read.option("basePath", out).parquet(f"{out}/epoch=*")
    last = F.max_by(F.struct("price", "volume", "n"), "epoch").alias("x")
    return rows.groupBy("asset", "bar").agg(last).select("asset", "bar", "x.*")
