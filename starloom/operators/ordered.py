"""Ordered computations over a whole result, without a task that holds all of it.

Rows are dealt to ranges of the order keys and written once; what lies before a range is a sum over earlier ranges, of
which there are as many as shuffle partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.keyspace import write_and_read

#: Rows of a bucket of a rolling frame.
BUCKET_ROWS = 1 << 16


def ranges(df: DataFrame, keys: list[Column]) -> DataFrame:
    """df with _part: equal keys share a part, and parts are in the keys' order."""
    return write_and_read(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "ranges")


def with_before(parts: DataFrame, **what: Column) -> DataFrame:
    """parts with, for each aggregate, its total over all earlier parts."""
    names = list(what)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    totals = parts.groupBy("_part").agg(*(a.alias(n) for n, a in what.items()))
    before = totals.select("_part", *(F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) for n in names))
    return parts.join(F.broadcast(before), "_part")


def running_sum(df: DataFrame, on: Column, keys: list[Column], new: str) -> DataFrame:
    parts = with_before(ranges(df, keys), _before=F.sum(on))
    upto = Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return parts.withColumn(new, F.when(on.isNotNull(), F.col("_before") + F.sum(on).over(upto))).drop("_part", "_before")


def running_share(df: DataFrame, on: Column, new: str) -> DataFrame:
    """The share of the total that a row's value and all larger ones have."""
    key = on.desc_nulls_last()
    parts = with_before(ranges(df, [key]), _before=F.sum(on)).crossJoin(F.broadcast(df.agg(F.sum(on).cast("double").alias("_total"))))
    upto = Window.partitionBy("_part").orderBy(key).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return parts.withColumn(new, F.try_divide((F.col("_before") + F.sum(on).over(upto)).cast("double"), F.col("_total"))).drop("_part", "_before", "_total")


def ranked(df: DataFrame, on: Column, ascending: bool, method: str, new: str) -> DataFrame:
    key = on.asc_nulls_last() if ascending else on.desc_nulls_last()
    parts = with_before(ranges(df, [key]), _before=F.count_distinct(on) if method == "dense" else F.count(on))
    own = {"dense": F.dense_rank, "min": F.rank, "first": F.row_number}[method]().over(Window.partitionBy("_part").orderBy(key))
    return parts.withColumn(new, F.when(on.isNotNull(), (F.col("_before") + own).cast("int"))).drop("_part", "_before")


def rolling_mean(df: DataFrame, on: Column, keys: list[Column], first: int, last: int, least: int, new: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The mean over the rows first .. last from each row: rows go to the bucket of their number, and to each bucket
    in which a row's frame reaches them."""
    parts = with_before(ranges(df, keys), _before=F.count(F.lit(1)))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*keys)) - 1
    numbered = parts.withColumn("_rn", F.col("_before") + place).drop("_part", "_before")
    bucket = lambda shift: F.floor((F.col("_rn") + F.lit(shift)) / F.lit(bucket_rows))
    spread = numbered.withColumn("_bucket", F.explode(F.sequence(bucket(-last), bucket(-first))))
    frame = Window.partitionBy("_bucket").orderBy("_rn").rowsBetween(first, last)
    mean = F.when(F.count(on).over(frame) >= max(least, 1), F.avg(on).over(frame))
    return spread.withColumn(new, mean).where(F.col("_bucket") == bucket(0)).drop("_bucket", "_rn")
