"""Small tables that a stream rewrites with every micro-batch, one folder per generation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Generations:
    """Tables below ``path``, each as ``name/epoch=n``; any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _folder(self, name: str, epoch: int | str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" + (f"/epoch={epoch}" if epoch != "" else ""))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def write(self, df: DataFrame, name: str, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/epoch={epoch}")

    def read(self, name: str, epoch: int | None, schema: str) -> DataFrame:
        """A generation; empty where there is none."""
        path, files = self._folder(name, epoch if epoch is not None else -1)
        if not files.exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}/epoch={epoch}")

    def newest(self, name: str) -> int | None:
        """The last generation that was finished."""
        path, files = self._folder(name, "")
        if not files.exists(path):
            return None
        found = [int(f.getPath().getName().split("=")[1]) for f in files.listStatus(path) if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
        return max(found, default=None)

    def all(self, name: str, schema: str) -> DataFrame:
        path, files = self._folder(name, "")
        if not files.exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}/epoch=*")

    def drop(self, name: str, epoch: int) -> None:
        path, files = self._folder(name, epoch)
        if epoch >= 0:
            files.delete(path, True)
