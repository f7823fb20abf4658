"""Cutting lineage with written tables in the folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a session without one gets a temporary folder only if its master is local."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not where:
        known = sc._jsc.sc().getCheckpointDir()
        if known.isDefined():
            where = known.get()
        elif sc.master.startswith("local[") or sc.master == "local":
            where = "file://" + tempfile.mkdtemp(prefix="facetlake-")
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/") if "://" in where else "file://" + where.rstrip("/")


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written as Parquet and read back, and its folder, for rounds that delete what they leave behind."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/facetlake-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read back, with its real size: plans that follow start from there."""
    return written(df)[0]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark knows."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
