"""Sample results of evaluations: outcome classes, trainability, Pass@k and its reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_any, first_match, or_default
from . import ordered

# Statuses of agents and verifiers.
NON_TRAINABLE = ["context_overflow", "model_api_failure", "parse_error", "infrastructure_blocked", "runner_error"]
INFRASTRUCTURE = ["infrastructure_blocked", "model_api_failure", "runner_error", "blocked_infrastructure"]
MODEL_FAILURES = ["no_edit", "max_steps", "parse_error", "context_overflow", "compile_failed"]
FAILURE_BUCKETS = [("tests failed", "tests_failed"), ("no edit", "no_edit"), ("max steps", "max_steps"), ("parse error", "parse_error"), ("context overflow", "context_overflow")]
PULL_MARKERS = ["unable to find image", "failed to resolve reference", "failed to copy", "could not fetch content descriptor", "manifest unknown", "pull access denied", "repository does not exist", "requested access to the resource is denied"]


def evaluation_only(df: DataFrame, with_split: bool = False) -> Column:
    """Rows that must never be trained on."""
    out = F.coalesce(F.col("exclude_from_training"), F.lit(False)) | (F.coalesce("data_role", F.lit("")) == "evaluation_only")
    return out | F.coalesce("split", F.lit("")).isin("evaluation", "evaluation_only") if with_split else out


def non_trainable(status: Column | str) -> Column:
    return F.coalesce((F.col(status) if isinstance(status, str) else status).isin(NON_TRAINABLE), F.lit(False))


def exclusion_reason(evaluation: Column, status: Column, resolved: Column, protocol_valid: Column) -> Column:
    """The first reason not to train on a row; null keeps it."""
    return (
        F.when(evaluation, "evaluation_excluded")
        .when(non_trainable(status), "non_trainable_status")
        .when(~F.coalesce(resolved, F.lit(False)), "verifier_unresolved")
        .when(~F.coalesce(protocol_valid, F.lit(False)), "invalid_tool_protocol")
    )


def training_decision(rows: DataFrame, verifier: DataFrame, key: str = "instance_id", include_unresolved: bool = False) -> DataFrame:
    """``rows`` with include, resolved and reason; a verifier row, where there is one, overrules the row's flag."""
    v = verifier.select(key, F.coalesce("benchmark_resolved", F.lit(False)).alias("_v"), F.lit(True).alias("_has"))
    resolved = F.when(F.col("_has"), F.col("_v")).otherwise(F.coalesce("resolved", F.lit(False)))
    joined = rows.join(v, key, "left").withColumn("_r", resolved)
    reason = (
        F.when(evaluation_only(joined, "split" in rows.columns), "evaluation_excluded")
        .when(non_trainable("status"), "non_trainable_status")
        .when(~F.col("_r") & F.lit(not include_unresolved), "unresolved_excluded")
        .otherwise("included")
    )
    out = joined.withColumn("reason", reason)
    included = F.col("reason") == "included"
    return out.withColumn("include", included).withColumn("resolved", included & F.col("_r")).drop("_v", "_has", "_r")


def export_resolved(resolved: Column, status: Column) -> Column:
    """For exports: a missing flag counts as resolved; a non-trainable status never does."""
    return F.coalesce(resolved, F.lit(True)) & ~non_trainable(status)


def valid_sample(df: DataFrame) -> Column:
    return F.coalesce("sample_valid", F.lit(False)) & F.col("benchmark_resolved").isNotNull()


def is_resolved(resolved: Column, verifier: Column) -> Column:
    return F.coalesce(resolved, F.lower(F.coalesce(verifier, F.lit(""))) == "resolved")


def canonical_outcome(resolved: Column, valid: Column, agent: Column, verifier: Column, patch: Column) -> Column:
    """One class for a sample; the order of the cases is the rule."""
    a, v = F.lower(F.coalesce(agent, F.lit("unknown"))), F.lower(F.coalesce(verifier, F.lit("unknown")))
    has_patch = F.coalesce(patch, F.lit(False))
    return (
        F.when(is_resolved(resolved, verifier), "resolved")
        .when((~F.coalesce(valid, F.lit(True))) | a.isin(INFRASTRUCTURE) | v.isin(INFRASTRUCTURE), "infrastructure")
        .when(a == "parse_error", "protocol_parse_error")
        .when(a == "context_overflow", "context_overflow")
        .when(a == "compile_failed", "compile_failed")
        .when(~has_patch & ((a == "max_steps") | (v == "model_failure_max_steps")), "no_patch_max_steps")
        .when(~has_patch, "no_effective_edit")
        .when(v == "unresolved_tests_failed", "tests_failed")
        .when(v.isin("unresolved_no_edit", "model_failure_no_edit"), "no_effective_edit")
        .when(v.isin("unresolved", "blocked_missing_patch"), "unresolved_patch")
        .otherwise(v)
    )


def classify_sample(df: DataFrame) -> DataFrame:
    """Validity of samples: a verdict makes one valid; a model that produced no patch failed;
    trouble of the infrastructure makes it invalid and its verdict null."""
    no_patch = F.col("benchmark_resolved").isNull() & (F.col("verifier_status") == "blocked_missing_patch") & F.col("agent_status").isin(MODEL_FAILURES)
    infra = F.coalesce(F.col("agent_status").isin(INFRASTRUCTURE), F.lit(False))
    failed = F.coalesce(no_patch, F.lit(False))
    return df.withColumns({
        "benchmark_resolved": F.when(infra, None).when(failed, False).otherwise(F.col("benchmark_resolved")),
        "sample_valid": F.when(infra, False).when(failed, True).otherwise(F.col("benchmark_resolved").isNotNull()),
        "verifier_status": F.when(failed, F.concat(F.lit("model_failure_"), "agent_status")).otherwise(F.coalesce("verifier_status", F.lit("verifier_missing_result"))),
    })


def failure_bucket(status: Column | str) -> Column:
    s = F.col(status) if isinstance(status, str) else status
    return F.when(s == "resolved", "resolved").otherwise(first_match(s, [(name, [mark]) for name, mark in FAILURE_BUCKETS], "other"))


def infrastructure_failure(returncode: Column, output: Column) -> Column:
    """Only the container runtime's own exit code tells of trouble outside the task."""
    return F.when(returncode == 125, F.when(contains_any(F.lower(output), PULL_MARKERS), "blocked_image_pull_failed").otherwise("blocked_docker_run_failed"))


def blocked_status(attempts: DataFrame, key: str = "instance_id") -> DataFrame:
    """Why no image of a task could be had, from all its attempts."""
    all_ = attempts.groupBy(key).agg(F.lower(F.array_join(F.array_sort(F.collect_list("output")), "\n")).alias("o"), F.bool_or(F.col("status") == "timeout").alias("late"))
    rules = [("blocked_image_not_found", ["not found", "manifest unknown"]), ("blocked_image_layer_fetch_failed", ["content descriptor", "failed to copy", "eof"]), ("blocked_image_access_denied", ["unauthorized", "denied"])]
    return all_.select(key, F.when(F.col("late"), "blocked_image_pull_timeout").otherwise(first_match("o", rules, "blocked_image_pull_failed")).alias("blocked_status"))


def preflight(candidates: DataFrame, limit: int | None = None) -> DataFrame:
    """First usable image of each task by ``ord``, else blocked; stops after ``limit`` runnable tasks.

    ``candidates(task_order, instance_id, image, ord, ok)``.
    """
    best = candidates.groupBy("task_order", "instance_id").agg(F.min_by("image", F.when(F.col("ok"), F.col("ord"))).alias("image"), F.bool_or("ok").alias("runnable"), F.count("*").alias("attempts"))
    best = best.withColumn("image", F.when(F.col("runnable"), F.col("image")))
    if limit is None:
        return best
    counted = ordered.running_sum(best.withColumn("_one", F.col("runnable").cast("int")), "task_order", "_one", "_b")
    return counted.where(F.col("_b") < limit).drop("_b", "_one")


def split_policy(split: Column | str) -> Column:
    s = F.col(split) if isinstance(split, str) else split
    return F.struct(F.when(s == "train", "train").when(s == "validation", "validation").otherwise("evaluation_only").alias("data_role"), (s != "train").alias("exclude_from_training"))


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """Unbiased estimate as a product, without binomials; null if there are fewer than k samples."""
    fail = F.lit(1.0)
    for i in range(k):
        fail = fail * F.greatest(n - c - i, F.lit(0)).cast("double") / F.greatest(n - i, F.lit(1)).cast("double")
    return F.when(n >= k, 1.0 - fail)


def k_values(n: int, style: str = "some") -> list[int]:
    """The k reported for n samples: {1, 3, n}, all, or those of the usual set that fit."""
    return {"some": sorted({1, min(3, n), n}), "all": list(range(1, n + 1)), "clipped": [k for k in (1, 3, 5, 10) if k <= n]}[style]


def pass_at_k_tasks(samples: DataFrame, ks: list[int], expected: int) -> DataFrame:
    """Per task: samples present, valid and resolved, completeness, and pass@k."""
    g = samples.groupBy("instance_id").agg(
        F.min_by("dataset", "sample_index").alias("dataset"),
        F.count("*").alias("present"),
        F.count("benchmark_resolved").alias("valid"),
        F.count_if(F.coalesce("benchmark_resolved", F.lit(False))).alias("resolved"),
    )
    g = g.withColumn("complete", (F.col("present") == expected) & (F.col("valid") == expected))
    return g.withColumns({f"pass_at_{k}": pass_at_k(F.col("valid"), F.col("resolved"), k) for k in ks})


def pass_at_k_aggregate(tasks: DataFrame, ks: list[int], by: str | None = None) -> DataFrame:
    """Means over complete tasks, for all of them or for each group as well."""
    aggs = [F.count("*").alias("tasks"), F.count_if("complete").alias("complete_tasks")] + [F.round(F.avg(F.when(F.col("complete"), F.col(f"pass_at_{k}"))), 6).alias(f"pass_at_{k}") for k in ks]
    if by is None:
        return tasks.agg(*aggs)
    return tasks.groupingSets([[F.col(by)], []], F.col(by)).agg(*aggs, F.grouping(by).alias("is_total")).withColumn(by, F.when(F.col("is_total") == 1, "overall").otherwise(F.col(by))).drop("is_total")


def summary(rows: DataFrame, *sets: list[str]) -> DataFrame:
    """Totals, resolved, rate, patches and steps for each grouping set; rolled-up keys read 'all'."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    ok = F.coalesce("benchmark_resolved", F.lit(False))
    aggs = [
        F.count("*").alias("total"), F.count_if(ok).alias("resolved"),
        F.round(100.0 * F.count_if(ok) / F.count("*"), 6).alias("pass_rate"),
        F.sum(F.coalesce("tool_steps", F.lit(0))).alias("tool_steps"),
        F.round(F.avg(F.coalesce("tool_steps", F.lit(0))), 6).alias("mean_tool_steps"),
    ]
    if not keys:
        return rows.agg(*aggs)
    marks = [F.grouping(k).alias(f"_g{i}") for i, k in enumerate(keys)]
    out = rows.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys]).agg(*aggs, *marks)
    for i, k in enumerate(keys):
        out = out.withColumn(k, F.when(F.col(f"_g{i}") == 1, "all").otherwise(F.col(k).cast("string")))
    return out.drop(*(f"_g{i}" for i in range(len(keys))))


def histogram(rows: DataFrame, column: Column | str, name: str = "value") -> DataFrame:
    c = F.col(column) if isinstance(column, str) else column
    return rows.groupBy(c.alias(name)).agg(F.count("*").alias("n"))


def coverage(rows: DataFrame) -> DataFrame:
    """Tasks solved at least once, and their share."""
    per = rows.groupBy("instance_id").agg(F.bool_or(F.coalesce("benchmark_resolved", F.lit(False))).alias("solved"))
    return per.agg(F.count("*").alias("tasks"), F.count_if("solved").alias("covered"), F.round(F.count_if("solved") / F.count("*"), 6).alias("coverage"))


def success_histogram(rows: DataFrame) -> DataFrame:
    """How many tasks were solved how often."""
    per = rows.groupBy("instance_id").agg(F.count_if(F.coalesce("benchmark_resolved", F.lit(False))).alias("successes"))
    return per.groupBy("successes").agg(F.count("*").alias("tasks"))


def duplicate_pairs(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.agg((F.count("*") - F.count_distinct(F.struct(*keys))).alias("duplicates"))


def compare_runs(rows: DataFrame, run: str = "run") -> DataFrame:
    """Tasks common to all runs and in any, and whether all runs have the same."""
    n = rows.select(run).distinct().count()  # runs are few
    per = rows.groupBy("instance_id").agg(F.count_distinct(run).alias("runs"))
    return per.agg(F.count_if(F.col("runs") == n).alias("common_tasks"), F.count("*").alias("union_tasks"), F.bool_and(F.col("runs") == n).alias("same_tasks"))


def renumber_rollouts(rows: DataFrame, file_order: str = "file_order") -> DataFrame:
    """One running sample index over several result files."""
    # ranks of the few distinct pairs, not a window over all rows of a dataset
    pairs = rows.select("dataset", file_order, "sample_index").distinct()
    numbered = pairs.withColumn("rollout", F.row_number().over(Window.partitionBy("dataset").orderBy(file_order, "sample_index")))
    return rows.join(numbered, ["dataset", file_order, "sample_index"])


def combined_accuracy(rows: DataFrame) -> DataFrame:
    """Per task and overall over cohorts: solved in any cohort, and in the current one."""
    per = rows.groupBy("instance_id").agg(F.bool_or(F.coalesce("benchmark_resolved", F.lit(False))).alias("any"), F.bool_or(F.coalesce(F.col("benchmark_resolved") & (F.col("cohort") == "current"), F.lit(False))).alias("current"))
    return per.agg(F.count("*").alias("tasks"), F.count_if("any").alias("solved_any"), F.count_if("current").alias("solved_current"), F.round(F.count_if("any") / F.count("*"), 6).alias("accuracy"))


def status_counts(rows: DataFrame) -> DataFrame:
    """Valid, resolved, unresolved and blocked: three-valued verdicts."""
    r = F.col("benchmark_resolved")
    return rows.agg(F.count("*").alias("total"), F.count(r).alias("valid"), F.count_if(F.coalesce(r, F.lit(False))).alias("resolved"), F.count_if(~F.coalesce(r, F.lit(True))).alias("unresolved"), F.count_if(r.isNull()).alias("blocked"))


def usage_totals(events: DataFrame, columns: list[str], fallback: dict[str, str] | None = None) -> DataFrame:
    """Sums of counters; a counter that is null or zero falls back to another field."""
    fallback = fallback or {}
    value = lambda c: F.coalesce(F.nullif(F.col(c), F.lit(0)), F.col(fallback[c]), F.lit(0)) if c in fallback else F.coalesce(c, F.lit(0))
    return events.agg(*[F.sum(value(c)).cast("bigint").alias(c) for c in columns])


def consistency_counts(solved_1: Column, solved_2: Column, solved_3: Column) -> dict[str, Column]:
    """Tasks with 1, 2 and 3 successes of 3, from the sums of pass@1..3 over tasks; what rounding
    leaves over belongs to the tasks without any.

    A task with c successes adds c/3, 1 - C(3-c,2)/3 and (c > 0) to the three sums.
    """
    three = F.bround(3 * solved_1 - 3 * solved_2 + solved_3).cast("bigint")
    one = F.bround(3 * (solved_3 - solved_2)).cast("bigint")
    two = F.bround(solved_3).cast("bigint") - one - three
    return {"one": one, "two": two, "three": three}


def normal_ci(values: DataFrame, column: str) -> DataFrame:
    """Mean and its 95 % interval within [0, 1]."""
    half = 1.96 * F.stddev_samp(column) / F.sqrt(F.count(column).cast("double"))
    mean = F.avg(column)
    return values.agg(F.round(mean, 6).alias("mean"), F.round(F.greatest(F.lit(0.0), mean - half), 6).alias("low"), F.round(F.least(F.lit(1.0), mean + half), 6).alias("high"))


def failures(rows: DataFrame, limit: int = 20, order: list[str] | None = None, **equal: str) -> DataFrame:
    """Unresolved rows by ``order`` (category, dataset and id); ``n_total`` counts them before the limit."""
    out = rows.where(~is_resolved(F.col("benchmark_resolved"), F.col("verifier_status")))
    for k, v in equal.items():
        out = out.where(F.col(k) == v)
    total = out.agg(F.count("*").alias("n_total"))
    return out.orderBy(*(order or ["category", "dataset", "instance_id"])).limit(limit).crossJoin(F.broadcast(total))  # one row


def suite_report(results: DataFrame) -> DataFrame:
    ok = F.col("passed")
    return results.agg(F.count("*").alias("suites"), F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"), (F.count_if(ok) / F.count("*")).alias("pass_rate"))


def readiness(tasks: DataFrame, expected: dict[str, int]) -> DataFrame:
    """Per dataset: as many tasks as expected, how many passed the gold check, distinct repositories."""
    g = tasks.groupBy("dataset").agg(F.count("*").alias("tasks"), F.count_if("gold_passed").alias("gold_passed"), F.count_distinct("repo").alias("repos"))
    want = F.coalesce(*[F.when(F.col("dataset") == d, n) for d, n in expected.items()], F.lit(0))
    return g.withColumn("ready", (F.col("tasks") == want) & (F.col("gold_passed") == F.col("tasks")))


def flatten_series(rows: DataFrame) -> DataFrame:
    """A run of several rounds is a series for each; of one round, a series by itself."""
    rounds = rows.groupBy("run").agg((F.min("round") < F.max("round")).alias("several"))
    return rows.join(rounds, "run").withColumn("series", F.when(F.col("several"), F.concat_ws(" #", "run", "round")).otherwise(F.col("run"))).drop("several")


def trace_verdict(exit_code: Column, fail_to_pass: Column, pass_to_pass: Column) -> Column:
    """Resolved: a clean exit and every named test passed."""
    return (exit_code == 0) & F.forall(fail_to_pass, lambda t: t["passed"]) & F.forall(pass_to_pass, lambda t: t["passed"])


def outcome_label(rows: DataFrame) -> DataFrame:
    return rows.withColumn("outcome", canonical_outcome(F.col("benchmark_resolved"), F.col("sample_valid"), F.col("agent_status"), or_default("verifier_status", "unknown"), F.col("patch_present")))


def select_rows(rows: DataFrame, splits: list[str] | None = None, datasets: list[str] | None = None, ids: DataFrame | None = None, groups: dict[str, list[str]] | None = None) -> DataFrame:
    """All given filters at once; a dataset name may stand for a group of them. Ids come as a frame."""
    if splits:
        rows = rows.where(F.col("split").isin(splits))
    if datasets:
        rows = rows.where(F.col("dataset").isin([d for name in datasets for d in (groups or {}).get(name, [name])]))
    return rows.join(ids.select("instance_id").distinct(), "instance_id", "left_semi") if ids is not None else rows


def planner_selection(plans: DataFrame, tasks: DataFrame, n: int, order: str = "ordinal") -> DataFrame:
    """The first ``n`` sound plans of known tasks."""
    sound = plans.where((F.col("status") == "ok") & F.col("parse_ok"))
    return sound.join(tasks.select("instance_id").distinct(), "instance_id", "left_semi").orderBy(order).limit(n)


def fingerprint(config: dict, ignored: tuple[str, ...] = ()) -> str:
    """Hash of a run's settings; ``ignored`` ones (workers, say) may change on a resume."""
    import hashlib
    import json

    kept = {k: v for k, v in config.items() if k not in ignored}
    return hashlib.sha256(json.dumps(kept, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()
