"""Metrics of value models and training logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lengths import average_rank


def rank_auc(rows: DataFrame, label: str, score: str, by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve by average ranks; null with one class only."""
    ranked = average_rank(rows, score, by)
    pos = F.count_if(F.col(label) == 1)
    neg = F.count_if(F.col(label) == 0)
    auc = F.when((pos > 0) & (neg > 0), (F.sum(F.when(F.col(label) == 1, F.col("average_rank"))) - pos * (pos + 1) / 2.0) / (pos * neg))
    return ranked.groupBy(*by).agg(auc.alias("auc")) if by else ranked.agg(auc.alias("auc"))


def binary_metrics(rows: DataFrame, label: str, score: str, by: list[str]) -> DataFrame:
    """Squared error, Brier score of clipped scores, explained variance, means by class."""
    y, s = F.col(label).cast("double"), F.col(score)
    clipped = F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0))
    var = F.var_pop(y)
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg((s - y) * (s - y)).alias("mse"), F.avg((clipped - y) * (clipped - y)).alias("brier"),
        F.when(var > 0, 1 - F.var_pop(y - s) / var).alias("explained_variance"),
        F.avg(F.when(y == 1, s)).alias("mean_positive"), F.avg(F.when(y == 0, s)).alias("mean_negative"),
    )


def family_priors(rows: DataFrame, label: str = "reward", by: str = "dataset_family") -> DataFrame:
    return rows.where(F.col("split") == "train").groupBy(by).agg(F.avg(label).alias("prior"))


def constant_baseline(rows: DataFrame, priors: DataFrame, label: str = "reward", by: str = "dataset_family") -> DataFrame:
    """Brier score of always answering the prior."""
    y = F.col(label).cast("double")
    return rows.join(priors, by).groupBy(by).agg(F.avg((F.col("prior") - y) * (F.col("prior") - y)).alias("baseline_brier"))


def quality_gate(metrics: DataFrame, baselines: DataFrame, by: str = "dataset_family") -> DataFrame:
    """A family passes if it beats its baseline, ranks better than chance and explains something; unknown fails."""
    ok = (F.col("brier") < F.col("baseline_brier")) & (F.col("auc") > 0.5) & (F.col("explained_variance") > 0)
    return metrics.join(baselines, by, "left").withColumn("passed", F.coalesce(ok, F.lit(False)))


def all_pass(gate: DataFrame) -> DataFrame:
    return gate.agg(F.coalesce(F.bool_and("passed"), F.lit(False)).alias("passed"))


def selection_cells(rows: DataFrame) -> DataFrame:
    return rows.groupBy("dataset_family", "reward").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("instance_id")).alias("ids"))


def trajectory_views(tokens: DataFrame) -> DataFrame:
    """Mean and last value of each trajectory's tokens, and their number as a weight."""
    return tokens.groupBy("trajectory_id").agg(F.max("reward").alias("reward"), F.avg("value").alias("mean_value"), F.max_by("value", "pos").alias("final_value"), F.count("*").alias("weight"))


def weighted_mean(value: Column | str, weight: Column | str) -> Column:
    v, w = (F.col(x) if isinstance(x, str) else x for x in (value, weight))
    return F.sum(v * w) / F.sum(w)


def epoch_summary(log: DataFrame) -> DataFrame:
    """Token-weighted loss, its middle, interpolated p95 and peak gradient, last rate of each epoch."""
    return log.groupBy("epoch").agg(
        weighted_mean("loss", "tokens").alias("loss"), F.expr("percentile(loss, 0.5)").alias("median_loss"), F.expr("percentile(grad_norm, 0.95)").alias("p95_grad"),
        F.max("grad_norm").alias("max_grad"), F.max_by("lr", "step").alias("last_lr"), F.sum("tokens").cast("bigint").alias("tokens"),
    )


def value_set_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("dataset_family").agg(F.count("*").alias("rows"), F.count_if(F.col("reward") == 1).alias("successes"), F.sum("num_tokens").cast("bigint").alias("tokens"), F.sum("num_action_tokens").cast("bigint").alias("action_tokens"))


def repo_audit(tasks: DataFrame) -> DataFrame:
    """Tasks by repository and mutation kind."""
    return tasks.groupBy("repo", "kind").agg(F.count("*").alias("tasks"))


def checks(row: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """Named conditions of a one-row summary and whether all hold."""
    named = row.select("*", *[F.coalesce(c, F.lit(False)).alias(n) for n, c in conditions.items()])
    every = F.lit(True)
    for n in conditions:
        every = every & F.col(n)
    return named.withColumn("passed", every)


def trace_audit(traces: DataFrame) -> DataFrame:
    """Coverage and hit rates of grounded traces, with latencies."""
    hit = F.arrays_overlap("gold_files", "predicted_files")
    return traces.agg(
        F.count("*").alias("traces"), F.count_if("parse_ok").alias("parsed"), F.count_if(F.coalesce(hit, F.lit(False))).alias("hits"), F.round(F.count_if(F.coalesce(hit, F.lit(False))) / F.count("*"), 4).alias("hit_rate"),
        F.min("latency").alias("least_latency"), F.max("latency").alias("most_latency"), F.avg("latency").alias("mean_latency"), F.expr("percentile(latency, 0.5)").alias("median_latency"),
    )


def manifest_counters(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("rows"), F.count_if(F.col("route") == "sft").alias("sft"), F.count_if(F.col("route") == "duplicate").alias("duplicates"), F.count_if(F.col("route") == "excluded").alias("excluded"), F.min(F.size("messages")).alias("least_messages"), F.max(F.size("messages")).alias("most_messages"))


def event_counters(rows: DataFrame, events: str) -> DataFrame:
    return rows.select(F.explode(events).alias("event")).groupBy("event").agg(F.count("*").alias("n"))


def latest(rows: DataFrame, order: str, by: list[str]) -> DataFrame:
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(order).desc()))).where("_k = 1").drop("_k")
