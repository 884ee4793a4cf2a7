"""Tables as parquet folders: append, idempotent partition reload, overwrite by swap, upsert, compaction."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lamina.operators.conforming import upsert


class TableStore:
    """Thin and replaceable: any format with the same six verbs can stand in."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(self, name: str) -> bool:
        fs, p = self._fs(self._path(name))
        return fs.exists(p)

    def names(self) -> list[str]:
        fs, p = self._fs(self.root)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []

    def read(self, name: str) -> DataFrame:
        """The table with all columns any of its files has."""
        return self.spark.read.option("mergeSchema", True).parquet(self._path(name))

    def append(self, name: str, df: DataFrame, partition: str | None = None) -> None:
        w = df.write.mode("append")
        (w.partitionBy(partition) if partition else w).parquet(self._path(name))

    def reload_partitions(self, name: str, df: DataFrame, partition: str) -> None:
        """Replace exactly the partitions that ``df`` holds: running a day twice gives that day once."""
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(self._path(name))

    def overwrite(self, name: str, df: DataFrame) -> None:
        """Write aside, then swap, so that ``df`` may read the table it replaces."""
        aside = f"{self._path(name)}__{uuid.uuid4().hex}"
        df.write.parquet(aside)
        fs, old = self._fs(self._path(name))
        if fs.exists(old):
            fs.delete(old, True)
        fs.rename(self._fs(aside)[1], old)

    def upsert(self, name: str, changes: DataFrame, keys: list[str]) -> None:
        self.overwrite(name, upsert(self.read(name), changes, keys) if self.exists(name) else changes)

    def drop(self, name: str) -> None:
        fs, p = self._fs(self._path(name))
        fs.delete(p, True)

    def compact(self, name: str, files: int) -> None:
        """Fewer, larger files."""
        self.overwrite(name, self.read(name).repartition(files))
