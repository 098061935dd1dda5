"""Positions in a sorted order without sorting any group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a bucket has on average.
BUCKET_ROWS = 2_000


def sum_before(df: DataFrame, group: list[str], bucket: str, order: list[Column], amount: Column, name: str) -> DataFrame:
    """Add, as column name, the sum of amount over the rows of the group that come earlier.

    The order is by bucket, then by order. Buckets are summed first, their sums are summed up along each
    group, and rows are only sorted inside a bucket: a group of any size is spread over its buckets. group and
    bucket must not be null.
    """
    keys = [*group, bucket]
    whole = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = df.groupBy(*keys).agg(F.sum(amount).alias("_sum")).select(*keys, F.coalesce(F.sum("_sum").over(whole), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.join(base, keys).withColumn(name, F.col("_base") + F.coalesce(F.sum(amount).over(inside), F.lit(0))).drop("_base")
