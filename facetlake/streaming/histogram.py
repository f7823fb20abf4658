"""Histograms that are kept while blocks of rows arrive."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.histogram import Axis, bins
from ..operators.lineage import checkpointed


def counts(stream: DataFrame, axes: list[Axis]) -> DataFrame:
    """The streaming aggregate; use complete or update mode."""
    return stream.groupBy(bins(axes).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def run_available(spark: SparkSession, path: str, table: str, axes: list[Axis]) -> DataFrame:
    """Stream all files that are there into a memory table and return it."""
    schema = spark.read.parquet(f"{path}/{table}.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(path)
    name = "hist_" + uuid.uuid4().hex
    query = counts(stream, axes).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return checkpointed(spark.table(name))
