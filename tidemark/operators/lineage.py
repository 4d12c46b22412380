"""Cutting lineage through the cluster's shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _shared_folder(df: DataFrame) -> str:
    """The checkpoint folder; a temporary one only in local mode where none is set."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tidemark-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder and read back."""
    _shared_folder(df)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the checkpoint folder, of which later plans read only what they need."""
    path = f"{_shared_folder(df)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with their place 1, 2, ... in `order` (ascending, nulls first): sorted by ranges, so no task gets them all."""
    at = F.monotonically_increasing_id()
    dealt = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_task", F.shiftright(at, 33)).withColumn("_at", at.bitwiseAND(F.lit((1 << 33) - 1))))
    before, shifts = 1, []
    for r in sorted(dealt.groupBy("_task").count().collect()):  # a row for each task
        shifts.append((r["_task"], before))
        before += r["count"]
    shift = F.broadcast(rows.sparkSession.createDataFrame(shifts, "_task long, _shift long"))
    return dealt.join(shift, "_task").withColumn(name, F.col("_at") + F.col("_shift")).drop("_task", "_at", "_shift")


def running_sums(rows: DataFrame, by: list[str], order: list[str], values: dict[str, str]) -> DataFrame:
    """rows with exclusive running sums: values maps a new column to the column (long, no nulls) summed over the rows before.

    A segmented prefix sum: rows are sorted by ranges of (by, order), each range sums what it
    holds of each group, and a row gets its group's sums of the ranges before and the sum
    inside its own. A group of all rows is as many ranges as any other; its totals are a row a range.
    Rows that are equal in (by, order) are taken in any one order. Nulls in `by` are a group.
    """
    dealt = cut(rows.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()))
    totals = dealt.groupBy("_range", *by).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in values.items()])
    ranges = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("_range", *by, *[F.coalesce(F.sum(f"_t_{n}").over(ranges), F.lit(0)).alias(f"_b_{n}") for n in values])
    inside = W.partitionBy("_range", *by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = dealt.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_i_{n}") for n, c in values.items()])
    same = [F.col("l._range") == F.col("r._range"), *[F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by]]
    joined = local.alias("l").join(totals.alias("r"), same)
    return joined.select(*[F.col(f"l.{c}") for c in rows.columns], *[(F.col(f"_i_{n}") + F.col(f"_b_{n}")).cast("long").alias(n) for n in values])
