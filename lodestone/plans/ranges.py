"""Running totals over ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.plans import scratch


def running_totals(rows: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """The rows with the sum of ``value`` over all rows up to each, in the order of ``by``, which
    must be unique.

    Rows are range-partitioned and written; sums of the ranges, one row each, give where a range
    starts, so no window has all rows in one task.
    """
    dealt = rows.repartitionByRange(by).withColumn("__range", F.spark_partition_id())
    dealt = scratch.written(dealt, narrow=True)
    sums = dealt.groupBy("__range").agg(F.sum(value).alias("__sum"))
    start = "coalesce(sum(__sum) over (order by __range rows between unbounded preceding and 1 preceding), 0)"
    starts = sums.select("__range", F.expr(start).alias("__start"))  # a row for each range
    within = F.expr(f"sum({value}) over (partition by __range order by {by})")
    out = dealt.withColumn("__within", within).join(F.broadcast(starts), "__range")
    return out.withColumn(name, F.col("__start") + F.col("__within")).drop("__range", "__within", "__start")
