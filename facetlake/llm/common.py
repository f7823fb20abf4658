"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: ``spark.checkpoint.dir``.

    A session without one gets a temporary folder only if its master is local; on a cluster that is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            where = known.get()
        elif spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            where = "file://" + tempfile.mkdtemp(prefix="facetlake-")
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/") if "://" in where else "file://" + where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def as_table(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: lineage ends here and lost executors cost nothing."""
    return written(spark, df, new_path(spark, name))


def written(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables of one job in the shared folder, deleted when what was made from them has been written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, name)
        self.paths.append(path)
        return written(self.spark, df, path)

    def drop(self, but: int = 0) -> None:
        """Delete all tables but the last ``but``."""
        cut = len(self.paths) - but
        for path in self.paths[:cut]:
            remove(self.spark, path)
        self.paths = self.paths[cut:]

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop()


#: What Python workers remember from task to task, one dictionary per operator.
_memories: list[dict] = []


def memory() -> dict:
    _memories.append({})
    return _memories[-1]


def turn_to(mine: dict) -> dict:
    """``mine``; a worker that goes from one operator's tasks to another's forgets what the first one remembered."""
    for other in _memories:
        if other is not mine:
            other.clear()
    return mine


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
