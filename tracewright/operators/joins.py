"""Joins and set relations of the pipeline, each with its precondition checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total_join(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Inner join that must find every left row; a miss raises when its row is computed."""
    r = right.withColumn("_hit", F.lit(True))
    out = left.join(r, on, "left")
    ok = F.when(F.col("_hit"), True).otherwise(F.raise_error(F.concat(F.lit("no match for "), F.col(on).cast("string"))).cast("boolean"))
    return out.where(ok).drop("_hit")


def join_with_misses(left: DataFrame, right: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    return left.join(right, on), left.join(right, on, "left_anti")


def enrich(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    return left.join(right, on, "left")


def keep_known(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    return left.join(right.select(on).distinct(), on, "left_semi")


def drop_known(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    return left.join(right.select(on).where(F.col(on).isNotNull()).distinct(), on, "left_anti")


def split_catalog(splits: DataFrame) -> DataFrame:
    """instance_id and split; an id in two splits raises."""
    g = splits.groupBy("instance_id").agg(F.min("split").alias("split"), F.count_distinct("split").alias("n"))
    return g.where(F.when(F.col("n") == 1, True).otherwise(F.raise_error(F.concat(F.lit("conflicting splits of "), "instance_id")).cast("boolean"))).drop("n")


def id_difference(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Ids on one side only, with the side. No rows: the sets are equal."""
    a, b = left.select(on).distinct().withColumn("_a", F.lit(True)), right.select(on).distinct().withColumn("_b", F.lit(True))
    return a.join(b, on, "full").where("_a is null or _b is null").select(on, F.when(F.col("_b").isNull(), "left").otherwise("right").alias("side"))


def require_equal_ids(left: DataFrame, right: DataFrame, on: str) -> None:
    if not (diff := id_difference(left, right, on)).isEmpty():
        raise ValueError(f"id sets differ, e.g. {diff.first()}")


def require_subset(left: DataFrame, right: DataFrame, on: str) -> None:
    if not left.join(right, on, "left_anti").isEmpty():
        raise ValueError(f"ids of {on} are missing")


def in_several(rows: DataFrame, on: str, part: str, name: str = "parts") -> DataFrame:
    """Ids that occur in more than one part, with the number of parts."""
    return rows.groupBy(on).agg(F.count_distinct(part).alias(name)).where(F.col(name) > 1)


def require_disjoint(frames: dict[str, DataFrame], on: str) -> None:
    """No id may occur in two of the frames: one aggregation over all of them."""
    rows = None
    for name, f in frames.items():
        part = f.select(on, F.lit(name).alias("_part"))
        rows = part if rows is None else rows.unionByName(part)
    if not (both := in_several(rows, on, "_part")).isEmpty():
        raise ValueError(f"{on} in several parts, e.g. {both.first()[0]}")


def same_tasks(rows: DataFrame, run: str) -> DataFrame:
    """Runs whose task set differs from the union: relational division."""
    n = rows.select("instance_id").distinct().count()
    return rows.groupBy(run).agg(F.count_distinct("instance_id").alias("tasks")).where(F.col("tasks") != n)


def union_all(frames: dict[str, DataFrame], tag: str = "cohort") -> DataFrame:
    out = None
    for name, f in frames.items():
        part = f.withColumn(tag, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def files_hit(gold: Column, found: Column) -> Column:
    return F.arrays_overlap(gold, found)


def prefix_join(modules: DataFrame, candidates: DataFrame, module: str = "module", candidate: str = "candidate") -> DataFrame:
    """Modules with each candidate that equals them or a dotted prefix: an equi-join on all
    prefixes, which are as many as a name has parts."""
    parts = F.split(module, "\\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    return modules.withColumn(candidate, F.explode(prefixes)).join(candidates, candidate)


def pending(samples: int, tasks: DataFrame, results: DataFrame) -> DataFrame:
    """(task, sample index) without a valid result. Indices are generated for each task."""
    wanted = tasks.select("instance_id", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample_index"))
    return wanted.join(results.where(F.col("benchmark_resolved").isNotNull()), ["instance_id", "sample_index"], "left_anti")


def consistent(summaries: DataFrame, verifier: DataFrame) -> DataFrame:
    """Rows whose reward contradicts the verifier, or that have none."""
    v = verifier.select("instance_id", F.col("benchmark_resolved").cast("double").alias("_v"))
    return summaries.join(v, "instance_id", "left").where(~F.col("reward").eqNullSafe(F.col("_v"))).drop("_v")


def three_way(records: DataFrame, tasks: DataFrame, verifier: DataFrame, on: str = "instance_id") -> DataFrame:
    return records.join(tasks, on, "left").join(verifier, on, "left")
