"""Running sums in an order, where a group may hold any share of the rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_folder


def running_sum(df: DataFrame, group: list[str], order: list[str], value: str, out: str, parts: int | None = None) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same ``group`` before this one by ``order`` (nulls first; rows equal in it stand in any order).

    Rows go to tasks by sampled ranges of (group, order), however their values cluster, and are stored with their task, so that what follows
    reads one dealing. A group's sums by task are added up first, a window of one row per task, then the rows inside each task.
    """
    spark = df.sparkSession
    along = [F.col(c).asc_nulls_first() for c in (*group, *order)]
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    where = f"{scratch_folder(spark)}/ordered-{uuid.uuid4().hex}"
    dealt = df.repartitionByRange(parts, *along).sortWithinPartitions(*along)
    dealt.withColumn("_at", F.monotonically_increasing_id()).write.parquet(where)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    rows = spark.read.parquet(where).withColumn("_task", F.shiftright("_at", 33))
    earlier = Window.partitionBy(*group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*group, "_task").agg(F.sum(value).alias("_s")).withColumn("_before", F.coalesce(F.sum("_s").over(earlier), F.lit(0)))
    sums = sums.select(*(F.col(g).alias(f"_group{k}") for k, g in enumerate(group)), F.col("_task").alias("_task2"), "_before")
    inside = Window.partitionBy(*group, "_task").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("_task") == F.col("_task2")
    for k, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_group{k}"))
    met = rows.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(sums, same)
    return met.withColumn(out, F.col("_before") + F.col("_inside")).drop("_at", "_task", "_task2", "_before", "_inside", *(f"_group{k}" for k in range(len(group))))
