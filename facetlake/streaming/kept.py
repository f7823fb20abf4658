"""Histograms kept up under change: stored counts take signed deltas from arriving blocks and from changed brushes.

The store is a folder of written count tables, one per change; the newest one counts.  A change is named (a batch of a
stream by its number) and taken once: a batch that comes again after a failure finds its name and does nothing.  Its table
is written aside and renamed, so a change is there as a whole or not at all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.histogram import Axis, bins


@dataclass
class KeptHistogram:
    spark: SparkSession
    path: str
    axes: list[Axis]
    #: tables before the newest one that stay, for readers that still use them
    keep: int = 2

    def _fs(self):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def versions(self) -> list[str]:
        """Names of the changes taken, oldest first: a number, a dash and the change's name."""
        fs = self._fs()
        if not fs.exists(self._at(".")):
            return []
        return sorted(n for s in fs.listStatus(self._at(".")) if (n := s.getPath().getName())[:9].isdigit())

    def taken(self) -> set[str]:
        fs, log = self._fs(), self._at("taken")
        names = {v[10:] for v in self.versions()}
        return names | ({s.getPath().getName() for s in fs.listStatus(log)} if fs.exists(log) else set())

    def counts(self) -> DataFrame:
        """bin, n; empty bins are left out."""
        found = self.versions()
        if not found:
            return self.spark.createDataFrame([], "bin long, n long")
        return self.spark.read.schema("bin long, n long").parquet(f"{self.path}/{found[-1]}")

    def deltas(self, rows: DataFrame, sign: Column) -> DataFrame:
        """Change of each bin's count: the sum of ``sign`` over rows."""
        return rows.groupBy(bins(self.axes).cast("long").alias("bin")).agg(F.sum(sign).cast("long").alias("n")).where("bin is not null and n <> 0")

    def merge(self, name: str, deltas: DataFrame) -> bool:
        """Take a change once; False if it had been taken before."""
        if name in self.taken():
            return False
        found = self.versions()
        number = int(found[-1][:9]) + 1 if found else 0
        merged = self.counts().unionAll(deltas).groupBy("bin").agg(F.sum("n").alias("n")).where("n <> 0")
        fs = self._fs()
        aside = f"aside-{number:09d}"
        merged.write.mode("overwrite").parquet(f"{self.path}/{aside}")
        if not fs.rename(self._at(aside), self._at(f"{number:09d}-{name}")):
            raise OSError(f"{self.path}/{aside} cannot be renamed")
        for old in found[: max(0, len(found) - self.keep)]:  # its name stays in the log, its table goes
            fs.mkdirs(self._at(f"taken/{old[10:]}"))
            fs.delete(self._at(old), True)
        return True

    def follow(self, stream: DataFrame, checkpoint: str, brush: Column | None = None):
        """Start a query that takes each block of the stream that there is; wait for it with awaitTermination()."""

        def take(block: DataFrame, number: int) -> None:
            rows = block if brush is None else block.where(brush)
            self.merge(f"batch{number}", self.deltas(rows, F.lit(1)))

        return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def rebrush(self, name: str, rows: DataFrame, old: Column, new: Column) -> bool:
        """Take a changed brush: only rows that went in or out are counted, and only these leave the scan."""
        was, now = F.coalesce(old, F.lit(False)), F.coalesce(new, F.lit(False))
        moved = rows.where((now & ~was) | (was & ~now))
        return self.merge(name, self.deltas(moved, F.when(now, 1).otherwise(-1)))

    def drop(self) -> None:
        self._fs().delete(self._at("."), True)
