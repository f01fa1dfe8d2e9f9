"""What a stream in update mode leaves behind: one row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as st


class KeyedSink:
    """Rows of an update-mode stream under one folder; readers see the newest row of every key.

    A batch writes `batches/batch=<number>` and overwrites what it wrote for the same number before, so a replay
    changes nothing. Rows are merged by key and batch number. `compact` writes the merged rows as
    `base/n=<number>` and deletes the batches in it; a base counts only once it is whole.
    """

    def __init__(self, spark: SparkSession, path: str, schema: st.StructType, keys: Sequence[str]):
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, list(keys)

    def write(self, batch: DataFrame, number: int) -> None:
        """For `foreachBatch`."""
        batch.select(*self.schema.fieldNames()).write.mode("overwrite").parquet(f"{self.path}/batches/batch={number}")

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _whole(self, folder: str) -> dict[int, str]:
        """Number to path of the complete folders."""
        fs, to_path = self._fs(), self.spark._jvm.org.apache.hadoop.fs.Path
        root = to_path(f"{self.path}/{folder}")
        if not fs.exists(root):
            return {}
        found = [s.getPath() for s in fs.listStatus(root)]
        return {int(p.getName().split("=")[1]): p.toString() for p in found if fs.exists(to_path(p, "_SUCCESS"))}

    def read(self) -> DataFrame:
        bases, batches = self._whole("base"), self._whole("batches")
        last = max(bases, default=-1)
        parts = {n: path for n, path in batches.items() if n > last}
        rows = self.spark.createDataFrame([], self.schema).withColumn("_batch", F.lit(-1).cast("long"))
        if bases:
            rows = self.spark.read.schema(self.schema).parquet(bases[last]).withColumn("_batch", F.lit(last).cast("long"))
        if parts:
            numbered = st.StructType([*self.schema.fields, st.StructField("batch", st.LongType())])
            new = self.spark.read.schema(numbered).option("basePath", f"{self.path}/batches").parquet(*parts.values())
            rows = rows.unionByName(new.withColumnRenamed("batch", "_batch"))
        values = [c for c in self.schema.fieldNames() if c not in self.keys]
        newest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*values), "_batch").alias("_row"))
        return newest.select(*[F.col(c) if c in self.keys else F.col(f"_row.{c}").alias(c) for c in self.schema.fieldNames()])

    def compact(self) -> None:
        bases, batches = self._whole("base"), self._whole("batches")
        last = max([*bases, *batches], default=-1)
        if last < 0 or last in bases:
            return
        self.read().write.mode("overwrite").parquet(f"{self.path}/base/n={last}")
        fs, to_path = self._fs(), self.spark._jvm.org.apache.hadoop.fs.Path
        for path in [*bases.values(), *(p for n, p in batches.items() if n <= last)]:
            fs.delete(to_path(path), True)
