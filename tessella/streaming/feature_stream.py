"""Feature totals over arriving measurement files; equal to the batch summary of the same files."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.sources.tables import scratch_folder


def stream_measurements(spark: SparkSession, folder: str, schema: T.StructType, names: Mapping[str, Column], glob: str = "*.parquet") -> DataFrame:
    """Streaming (feature_index, value) rows of the Parquet files that appear in ``folder``."""
    source = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)
    return source.select(names["feature_index"].alias("feature_index"), names["value"].cast("float").alias("value"))


def feature_totals(measurements: DataFrame) -> DataFrame:
    """Mergeable per-feature totals; works on batch and streaming input alike."""
    return measurements.groupBy("feature_index").agg(
        F.sum(F.col("value").cast("double")).alias("total"), F.count(F.lit(1)).alias("positive_cells"),
        F.count_if(F.col("value") > 0).alias("positive_value_cells"),
    )


def _batches(spark: SparkSession, target: str, suffix: str = "/_SUCCESS") -> list[int]:
    """Numbers of the batches below ``target`` that were written to the end, ascending."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path
    found = path(target).getFileSystem(context._jsc.hadoopConfiguration()).globStatus(path(f"{target}/batch=*{suffix}"))
    return sorted(int(f.getPath().toString().rsplit("batch=", 1)[1].split("/")[0]) for f in found or [])


def read_totals(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame:
    """The result of the last complete batch; empty before the first."""
    done = _batches(spark, target)
    return spark.read.schema(schema).parquet(f"{target}/batch={done[-1]}") if done else spark.createDataFrame([], schema)


def run_available(totals: DataFrame, target: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Process everything available now, then read the result back.

    Each batch writes a folder of its own, named by its number, and the one before stays until the next: a
    reader always finds a complete table, and a batch that is run again after a failure replaces only itself.
    """
    spark = totals.sparkSession
    base = scratch_folder(spark)
    target = target or f"{base}/result"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")
        context = spark.sparkContext
        for old in [b for b in _batches(spark, target, "") if b < number][:-1]:
            path = context._jvm.org.apache.hadoop.fs.Path(f"{target}/batch={old}")
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)

    query = (
        totals.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint or f"{base}/state")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return read_totals(spark, target, totals.schema)
