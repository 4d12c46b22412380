"""Keyed tables in a folder, changed by rewriting the touched buckets only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.lineage import cut


class BucketTable:
    """A Parquet table parted by a hash of its key into `buckets` folders.

    A change reads and rewrites the buckets that hold its keys; the files of the others stay. One
    writer at a time; a reader during a change may see a bucket before or after it.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "session_id", buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias("bucket_no")

    def create(self, rows: DataFrame) -> None:
        rows.withColumn("bucket_no", self._bucket()).repartition("bucket_no").write.partitionBy("bucket_no").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("bucket_no")

    def _some(self, numbers: list[int]) -> DataFrame:
        return self.spark.read.parquet(self.path).where(F.col("bucket_no").isin(numbers))

    def _replace(self, numbers: list[int], after: DataFrame) -> dict[str, int]:
        """Rewrite these buckets as `after` says; counts of rows added, changed and deleted."""
        before = self._some(numbers).drop("bucket_no")
        after = cut(after.select(before.columns))  # read in full before its files go
        fields = [c for c in before.columns if c != self.key]
        a = before.select(self.key, F.struct(*fields).alias("a"))
        both = a.join(after.select(self.key, F.struct(*fields).alias("b")), self.key, "full_outer")
        n = both.agg(
            F.count_if(F.col("a").isNull()).alias("added"), F.count_if(F.col("b").isNull()).alias("deleted"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull() & ~F.col("a").eqNullSafe(F.col("b"))).alias("changed")
        ).first()
        rows = after.withColumn("bucket_no", self._bucket())
        rows.repartition("bucket_no").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket_no").parquet(self.path)
        left = {r.bucket_no for r in rows.select("bucket_no").distinct().collect()}  # at most `buckets`
        for number in set(numbers) - left:  # an overwrite leaves alone what it has no row for
            place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/bucket_no={number}")
            place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        return n.asDict() | {"buckets": len(numbers)}

    def change(self, keys: DataFrame, how: Callable[[DataFrame], DataFrame]) -> dict[str, int]:
        """Replace the buckets that hold any of `keys` by how(their rows)."""
        numbers = sorted(r.bucket_no for r in keys.select(self._bucket()).distinct().collect())
        if not numbers:
            return {"added": 0, "deleted": 0, "changed": 0, "buckets": 0}
        return self._replace(numbers, how(self._some(numbers).drop("bucket_no")))

    def upsert(self, changes: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> dict[str, int]:
        """The table after merge(rows, changes), such as summaries.upsert, upsert_labels or observe."""
        return self.change(changes, lambda rows: merge(rows, changes))

    def delete(self, keys: DataFrame | None) -> dict[str, int]:
        """Without the rows of these keys; without any if keys is None."""
        gone = self.read() if keys is None else keys
        return self.change(gone, lambda rows: rows.limit(0) if keys is None else rows.join(keys.select(self.key).distinct(), self.key, "left_anti"))
