"""Length reports, moving statistics, length-bucketed batches and update plans."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ordered
from ..functions.text import REPORT_BOUNDS, length_bucket
from .sampling import stable_score


def nearest_rank(column: str, p: float) -> Column:
    """The value at the rank rounded up."""
    return F.expr(f"cast(percentile_disc({p}) within group (order by {column}) as bigint)")


def length_report(rows: DataFrame, by: str | None = None, column: str = "num_tokens") -> DataFrame:
    aggs = [F.count("*").alias("rows"), F.sum(column).cast("bigint").alias("total"), F.round(F.avg(column), 6).alias("mean"), F.min(column).cast("bigint").alias("least")]
    aggs += [nearest_rank(column, p / 100).alias(f"p{p}") for p in (50, 75, 90, 95, 99)] + [F.max(column).cast("bigint").alias("most")]
    return rows.groupBy(by).agg(*aggs) if by else rows.agg(*aggs)


def bucket_histogram(rows: DataFrame, column: str = "num_tokens", bounds: list[int] = REPORT_BOUNDS) -> DataFrame:
    return rows.groupBy(length_bucket(column, bounds).alias("bucket")).agg(F.count("*").alias("rows"))


def longest(rows: DataFrame, n: int = 20, column: str = "num_tokens", key: str = "trajectory_id", bucket: str | None = None, shortest: bool = False) -> DataFrame:
    """Longest or shortest rows, of one bucket if given; ties by key."""
    rows = rows.where(F.col("bucket") == bucket) if bucket else rows
    return rows.orderBy(F.col(column).asc() if shortest else F.col(column).desc(), key).limit(n)


def floor_rank_summary(rows: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Least, mean, middle (averaging two), p90 by the rank rounded down, most."""
    # counts by value, so a group is as large as its distinct values
    counts = rows.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by).orderBy(column)
    total = F.sum("n").over(Window.partitionBy(*by))
    c = counts.withColumns({"upto": F.sum("n").over(w), "total": total})
    at = lambda rank: F.min(F.when(F.col("upto") >= rank, F.col(column)))
    half = (at(F.floor((F.col("total") + 1) / 2)) + at(F.floor(F.col("total") / 2) + 1)) / 2
    p90 = at(F.greatest(F.floor(0.9 * F.col("total")), F.lit(1)))
    mean = F.round(F.sum(F.col(column) * F.col("n")) / F.sum("n"), 3)
    return c.groupBy(*by).agg(F.min(column).alias("least"), mean.alias("mean"), half.cast("double").alias("median"), p90.alias("p90"), F.max(column).alias("most"))


def running_offset(rows: DataFrame, order: str, size: str = "num_tokens", by: list[str] | None = None) -> DataFrame:
    """Sum of the sizes before each row, of its group or of the whole table."""
    if not by:
        return ordered.running_sum(rows, order, size, "offset")
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum(size).over(w), F.lit(0)).cast("bigint"))


def moving_average(rows: DataFrame, value: str, order: list[str], width: int, by: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-(width - 1), 0)
    return rows.withColumn("moving_average", F.avg(value).over(w))


def edge_padded_mean(rows: DataFrame, value: str, order: list[str], by: list[str], width: int = 25) -> DataFrame:
    """Trailing mean as if the first value went on to the left; series shorter than the window stay."""
    w = Window.partitionBy(*by).orderBy(*order)
    near = w.rowsBetween(-(width - 1), 0)
    first = F.first(value).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    padded = (F.sum(value).over(near) + (width - F.count(value).over(near)) * first) / width
    n = F.count("*").over(Window.partitionBy(*by))
    return rows.withColumn("smoothed", F.when(n < width, F.col(value)).otherwise(padded))


def average_rank(rows: DataFrame, score: str, by: list[str] | None = None) -> DataFrame:
    """Rank from 1 with ties at their mean."""
    if not by:
        return ordered.mean_rank(rows, score, "average_rank")
    tied = F.count("*").over(Window.partitionBy(*by, score))
    return rows.withColumn("average_rank", F.rank().over(Window.partitionBy(*by).orderBy(score)) + (tied - 1) / F.lit(2.0))


def contiguous_ranges(rows: DataFrame, by: list[str], pos: str = "pos") -> DataFrame:
    """First and last position of each gapless run."""
    island = F.col(pos) - F.row_number().over(Window.partitionBy(*by).orderBy(pos))
    return rows.withColumn("_i", island).groupBy(*by, "_i").agg(F.min(pos).alias("first"), F.max(pos).alias("last")).drop("_i")


def peaks_so_far(rows: DataFrame, value: str, order: str, by: list[str]) -> DataFrame:
    return rows.withColumn("peak", F.max(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def bucket_batches(rows: DataFrame, sizes: dict[str, int], seed: str, key: str, epoch: int = 0, shards: int = 1) -> DataFrame:
    """Batches of one length bucket each: hash order, then by length, cut to the bucket's size;
    batches in hash order. Buckets are few: on large tables each is dealt into hash ``shards``."""
    rows = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), key), F.lit(shards)))
    size = F.coalesce(*[F.when(F.col("bucket") == b, n) for b, n in sizes.items()], F.lit(1))
    w = Window.partitionBy("bucket", "shard").orderBy("num_tokens", stable_score(f"{seed}:{epoch}", key), key)
    out = rows.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("bigint"))
    return out.withColumn("batch_order", stable_score(f"{seed}:{epoch}", "bucket", F.col("shard").cast("string"), F.col("batch").cast("string")))


def padding_stats(batches: DataFrame) -> DataFrame:
    g = batches.groupBy(*[c for c in ("bucket", "shard", "batch") if c in batches.columns]).agg(F.count("*").alias("rows"), F.sum("num_tokens").cast("bigint").alias("real_tokens"), (F.max("num_tokens") * F.count("*")).cast("bigint").alias("padded_tokens"))
    return g.withColumn("padding", F.col("padded_tokens") - F.col("real_tokens"))


def padded(ids: Column, length: Column, pad: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad), F.greatest(length - F.size(ids), F.lit(0)).cast("int")))


def update_plan(rows: DataFrame, bounds: list[int], micro: list[int], target: int, seed: str, key: str = "row_id") -> DataFrame:
    """row, bucket, update and microbatch: every row once, ``target`` rows an update.

    Full updates hold one bucket each and come from ranks alone. What is left of a bucket is
    less than ``target`` rows; those few mix greedily, bucket after bucket in hash order, into
    updates of at most ``target`` whose microbatches stay within one bucket.
    """
    label = F.lit(len(bounds))
    for i, b in reversed(list(enumerate(bounds))):
        label = F.when(F.col("num_tokens") <= b, i).otherwise(label)
    bucketed = rows.select(key, "num_tokens", label.alias("bucket"))
    w = Window.partitionBy("bucket")
    ranked = bucketed.withColumns({"rn": F.row_number().over(w.orderBy(stable_score(seed, F.col(key).cast("string")), key)) - 1, "n": F.count("*").over(w)})
    full = F.col("n") - F.col("n") % target
    size = F.coalesce(*[F.when(F.col("bucket") == i, m) for i, m in enumerate(micro)], F.lit(1))
    body = ranked.where(F.col("rn") < full).select(key, "bucket", F.concat_ws(":", F.col("bucket").cast("string"), F.floor(F.col("rn") / target).cast("string")).alias("update"), F.floor(F.col("rn") % target / size).cast("int").alias("microbatch"))
    tails = ranked.where(F.col("rn") >= full)

    def mix(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tail_order", "rn"])
        out, held, update, micro_id = [], 0, 0, 0
        for bucket, part in pdf.groupby("bucket", sort=False):
            keys, at = part[key].tolist(), 0
            while at < len(keys):
                take = min(micro[bucket] if bucket < len(micro) else 1, target - held, len(keys) - at)
                out += [(k, bucket, f"tail:{update}", micro_id) for k in keys[at : at + take]]
                at, held, micro_id = at + take, held + take, micro_id + 1
                if held == target:
                    update, held, micro_id = update + 1, 0, 0
        return pd.DataFrame(out, columns=[key, "bucket", "update", "microbatch"])

    kind = dict(rows.dtypes)[key]
    rest = tails.withColumn("tail_order", stable_score(seed, F.lit("tail"), F.col("bucket").cast("string"))).withColumn("all", F.lit(0)).groupBy("all").applyInPandas(mix, f"{key} {kind}, bucket int, update string, microbatch int")
    return body.unionByName(rest)


def plan_faults(plan: DataFrame, rows: DataFrame, target: int, key: str = "row_id") -> DataFrame:
    """Rows planned not exactly once, and updates over the target. No rows: a sound plan."""
    per = rows.select(key).join(plan.groupBy(key).count(), key, "left").where(F.coalesce("count", F.lit(0)) != 1).select(F.concat(F.lit("row "), F.col(key).cast("string")).alias("fault"))
    big = plan.groupBy("update").count().where(F.col("count") > target).select(F.concat(F.lit("update "), "update").alias("fault"))
    return per.unionByName(big)


def training_gate(summary: dict[str, int], expected: dict[str, int]) -> None:
    wrong = {k: (summary.get(k), v) for k, v in expected.items() if summary.get(k) != v}
    if wrong:
        raise ValueError(f"counts differ from the audit: {wrong}")


def batches_in_order(plan: DataFrame) -> Iterator:
    """Rows of a plan batch after batch, streamed to the driver for a training loop."""
    return plan.orderBy("batch_order", "batch").toLocalIterator()
