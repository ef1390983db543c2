"""Global ranks and running sums that no single task computes.

Rows are dealt into buckets that follow the order, by bounds on the driver (quantiles of the
one order column, or prefixes of a hash). Bucket totals are one row each; their running sum
is added to what a window inside each bucket gives. Equal values share a bucket, and bounds
are literals, so both passes deal rows alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 256


def by_value(df: DataFrame, column: str, n: int = BUCKETS) -> Column:
    """Bucket of a numeric column; null values come first."""
    bounds = sorted(set(df.select(F.col(column).cast("double").alias("v")).approxQuantile("v", [i / n for i in range(1, n)], 0.25 / n)))
    if not bounds:
        return F.lit(0)
    return F.when(F.col(column).isNull(), 0).otherwise(F.size(F.filter(F.lit(bounds), lambda b: b < F.col(column))) + 1)


def by_hash(digest: Column) -> Column:
    """Bucket of a hexadecimal hash: its first two digits."""
    return F.conv(F.left(digest, F.lit(2)), 16, 10).cast("int")


def bases(df: DataFrame, bucket: str, total: Column) -> Column:
    """Sum of ``total`` over all buckets before a row's; at most a row a bucket is collected."""
    rows = df.groupBy(bucket).agg(total.alias("t")).collect()
    out, at = {}, 0
    for r in sorted(rows, key=lambda r: r[0]):
        out[r[0]] = at
        at += r.t or 0
    return F.create_map(*[F.lit(x) for kv in out.items() for x in kv])[F.col(bucket)] if out else F.lit(0)


def rank(df: DataFrame, bucket: Column, order: list[Column | str], name: str) -> DataFrame:
    """Row number from 1 over all rows."""
    b = df.withColumn("_b", bucket)
    return b.withColumn(name, F.row_number().over(Window.partitionBy("_b").orderBy(*order)) + bases(b, "_b", F.count("*"))).drop("_b")


def running_sum(df: DataFrame, order: str, size: str, name: str) -> DataFrame:
    """Sum of ``size`` before each row in the order of a numeric column without ties."""
    b = df.withColumn("_b", by_value(df, order))
    inside = F.coalesce(F.sum(size).over(Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return b.withColumn(name, (inside + bases(b, "_b", F.sum(size))).cast("bigint")).drop("_b")


def mean_rank(df: DataFrame, score: str, name: str) -> DataFrame:
    """Rank from 1 over all rows, ties at their mean."""
    b = df.withColumn("_b", by_value(df, score))
    w = Window.partitionBy("_b")
    tied = F.count("*").over(Window.partitionBy("_b", score))
    return b.withColumn(name, F.rank().over(w.orderBy(score)) + (tied - 1) / F.lit(2.0) + bases(b, "_b", F.count("*"))).drop("_b")
