"""Results as a stream: first row per key, running reports, batch equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tallyrail.operators.cache import exists


def read_stream(spark: SparkSession, path: str, schema: StructType, form: str = "parquet", files: int = 100) -> DataFrame:
    """Result files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(form).load(path)


def first_per_key(stream: DataFrame, key: list[str], time: str, late: str) -> DataFrame:
    """One row per key within the watermark: a resumed run may write a row again."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def windowed_rates(stream: DataFrame, time: str, size: str, late: str, by: list[str], passed: Column) -> DataFrame:
    """Totals and passes per window and group; a window is final when the watermark has passed it."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size).alias("window"), *by).agg(F.count("*").alias("total"), F.count_if(passed).alias("passed"))


def upsert_totals(stream: DataFrame, by: list[str], passed: Column, table: str, checkpoint: str) -> StreamingQuery:
    """Keep running totals in the Parquet folder ``table``, a version per batch; a repeated batch writes the same version."""
    spark = stream.sparkSession

    def fold(batch: DataFrame, epoch: int) -> None:
        new = batch.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(passed).alias("passed"))
        before = f"{table}/v={epoch - 1}"
        if epoch:
            if not exists(spark, before):
                raise ValueError(f"{before} is missing: totals cannot go on from batch {epoch}")
            new = spark.read.parquet(before).unionByName(new).groupBy(*by).agg(F.sum("total").alias("total"), F.sum("passed").alias("passed"))
        new.write.mode("overwrite").parquet(f"{table}/v={epoch}")

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, table: str) -> DataFrame:
    """The totals after the last batch."""
    versions = spark.read.parquet(table)
    return versions.where(F.col("v") == versions.agg(F.max("v")).first()[0]).drop("v")
