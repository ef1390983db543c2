import math

import pytest
from pyspark.sql import functions as F

from tracewright.operators import joins, metrics, samples
from tracewright.schemas import SAMPLE


def rows(spark, values):
    """(instance, index, resolved, agent, verifier)"""
    return spark.createDataFrame([(i, "function_a", k, r, a, v, True, None) for i, k, r, a, v in values], "instance_id string, dataset string, sample_index int, benchmark_resolved boolean, agent_status string, verifier_status string, sample_valid boolean, patch_present boolean")


def test_pass_at_k_values(spark):
    df = rows(spark, [("a", k, k == 0, "edited", "x") for k in range(5)] + [("b", k, None if k == 4 else True, "edited", "x") for k in range(5)])
    out = {r.instance_id: r for r in samples.pass_at_k_tasks(df, [1, 3, 5], 5).collect()}
    assert [round(out["a"][f"pass_at_{k}"], 6) for k in (1, 3, 5)] == [0.2, 0.6, 1.0]
    assert not out["b"].complete and out["b"].pass_at_5 is None
    agg = samples.pass_at_k_aggregate(samples.pass_at_k_tasks(df, [1], 5), [1]).first()
    assert (agg.tasks, agg.complete_tasks, agg.pass_at_1) == (2, 1, 0.2)


@pytest.mark.parametrize("n", range(1, 8))
def test_pass_at_k_equals_binomials(spark, n):
    cells = [(c, k) for c in range(n + 1) for k in range(1, n + 1)]
    df = spark.createDataFrame([(n, c) for c in range(n + 1)], "n int, c int")
    got = df.select("c", *[samples.pass_at_k(F.col("n"), F.col("c"), k).alias(f"p{k}") for k in range(1, n + 1)]).collect()
    by = {r.c: r for r in got}
    for c, k in cells:
        assert by[c][f"p{k}"] == pytest.approx(1 - math.comb(n - c, k) / math.comb(n, k))


def test_k_values():
    assert samples.k_values(5) == [1, 3, 5] and samples.k_values(2, "all") == [1, 2] and samples.k_values(4, "clipped") == [1, 3]


def test_duplicates_raise(spark):
    from tracewright.sources.readers import reject_duplicates

    df = rows(spark, [("a", 0, True, "x", "y"), ("a", 0, False, "x", "y")])
    with pytest.raises(Exception, match="duplicate key"):
        reject_duplicates(df, "instance_id", "sample_index").collect()
    assert reject_duplicates(df, "instance_id", "sample_index", conflicting_only=("agent_status",)).count() == 2


def test_outcomes_in_order(spark):
    cases = [
        (True, True, "parse_error", "x", False, "resolved"), (None, True, "edited", "Resolved", False, "resolved"), (False, False, "edited", "x", True, "infrastructure"),
        (False, True, "parse_error", "x", True, "protocol_parse_error"), (False, True, "context_overflow", "x", True, "context_overflow"), (False, True, "compile_failed", "x", True, "compile_failed"),
        (False, True, "max_steps", "x", False, "no_patch_max_steps"), (False, True, "edited", "x", None, "no_effective_edit"), (False, True, "edited", "unresolved_tests_failed", True, "tests_failed"),
        (False, True, "edited", "model_failure_no_edit", True, "no_effective_edit"), (False, True, "edited", "blocked_missing_patch", True, "unresolved_patch"), (False, True, "edited", "odd", True, "odd"),
    ]
    df = spark.createDataFrame([(*c, i) for i, c in enumerate(cases)], "r boolean, v boolean, a string, s string, p boolean, want string, i int")
    out = df.select(samples.canonical_outcome(F.col("r"), F.col("v"), F.col("a"), F.col("s"), F.col("p")).alias("got"), "want").collect()
    assert [x.got for x in out] == [x.want for x in out]


def test_classify_sample(spark):
    df = rows(spark, [("a", 0, None, "no_edit", "blocked_missing_patch"), ("b", 0, True, "runner_error", "resolved"), ("c", 0, False, "edited", None), ("d", 0, None, "edited", "x")])
    out = {r.instance_id: (r.benchmark_resolved, r.sample_valid, r.verifier_status) for r in samples.classify_sample(df).collect()}
    assert out == {"a": (False, True, "model_failure_no_edit"), "b": (None, False, "resolved"), "c": (False, True, "verifier_missing_result"), "d": (None, False, "x")}


def test_training_decision(spark):
    r = spark.createDataFrame([("a", "edited", True, False, "train"), ("b", "edited", False, False, "train"), ("c", "parse_error", True, False, "train"), ("d", "edited", True, None, "evaluation_only"), ("e", "edited", None, None, None)], "instance_id string, status string, resolved boolean, exclude_from_training boolean, data_role string")
    v = spark.createDataFrame([("a", False), ("b", True)], "instance_id string, benchmark_resolved boolean")
    out = {x.instance_id: (x.include, x.resolved, x.reason) for x in samples.training_decision(r, v).collect()}
    assert out == {"a": (False, False, "unresolved_excluded"), "b": (True, True, "included"), "c": (False, False, "non_trainable_status"), "d": (False, False, "evaluation_excluded"), "e": (False, False, "unresolved_excluded")}
    assert r.select(samples.export_resolved(F.lit(None).cast("boolean"), F.col("status")).alias("x")).first().x is True


def test_id_sets(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(2,), (3,)], "id int")
    assert {(r.id, r.side) for r in joins.id_difference(a, b, "id").collect()} == {(1, "left"), (3, "right")}
    with pytest.raises(ValueError):
        joins.require_disjoint({"x": a, "y": b}, "id")
    joins.require_disjoint({"x": a.where("id = 1"), "y": b}, "id")
    with pytest.raises(Exception, match="no match"):
        joins.total_join(a, b.withColumn("v", F.lit(1)), "id").collect()


def test_prefix_join(spark):
    m = spark.createDataFrame([("a.b.c",), ("ab",)], "module string")
    c = spark.createDataFrame([("a",), ("a.b",), ("a.b.c.d",)], "candidate string")
    assert {(r.module, r.candidate) for r in joins.prefix_join(m, c).collect()} == {("a.b.c", "a"), ("a.b.c", "a.b")}


def test_auc_and_metrics(spark):
    df = spark.createDataFrame([("f", 1, 0.9), ("f", 1, 0.5), ("f", 0, 0.5), ("f", 0, 0.1), ("g", 1, 0.2)], "family string, y int, s double")
    auc = {r.family: r.auc for r in metrics.rank_auc(df, "y", "s", ["family"]).collect()}
    assert float(auc["f"]) == 0.875 and auc["g"] is None
    m = {r.family: r for r in metrics.binary_metrics(df, "y", "s", ["family"]).collect()}
    assert m["f"].brier == pytest.approx((0.01 + 0.25 + 0.25 + 0.01) / 4) and m["g"].explained_variance is None
    gate = metrics.quality_gate(metrics.binary_metrics(df, "y", "s", ["family"]).join(metrics.rank_auc(df, "y", "s", ["family"]), "family"), spark.createDataFrame([("f", 0.25)], "family string, baseline_brier double"), "family")
    assert {r.family: r.passed for r in gate.collect()} == {"f": True, "g": False} and metrics.all_pass(gate).first().passed is False


def test_schema_parses(spark):
    assert "benchmark_resolved" in spark.createDataFrame([], SAMPLE).columns


def test_preflight_stops_early(spark):
    c = spark.createDataFrame([(1, "a", "x", 0, False), (1, "a", "y", 1, True), (2, "b", "x", 0, False), (3, "c", "z", 0, True), (4, "d", "z", 0, True)], "task_order int, instance_id string, image string, ord int, ok boolean")
    assert {(r.instance_id, r.image) for r in samples.preflight(c, 2).collect()} == {("a", "y"), ("b", None), ("c", "z")}


def test_blocked_status(spark):
    a = spark.createDataFrame([("a", "error", "Manifest UNKNOWN"), ("b", "timeout", "x"), ("c", "error", "denied")], "instance_id string, status string, output string")
    assert {r.instance_id: r.blocked_status for r in samples.blocked_status(a).collect()} == {"a": "blocked_image_not_found", "b": "blocked_image_pull_timeout", "c": "blocked_image_access_denied"}


def test_selections(spark):
    df = spark.createDataFrame([("a", "train", "x", 1, "ok", True), ("b", "train", "y", 0, "ok", True), ("c", "test", "x", 2, "bad", True)], "instance_id string, split string, dataset string, ordinal int, status string, parse_ok boolean")
    assert [r.instance_id for r in samples.select_rows(df, ["train"], ["both"], groups={"both": ["x"]}).collect()] == ["a"]
    assert [r.instance_id for r in samples.planner_selection(df, df, 1).collect()] == ["b"]
    assert samples.fingerprint({"a": 1, "workers": 2}, ("workers",)) == samples.fingerprint({"a": 1, "workers": 9}, ("workers",)) != samples.fingerprint({"a": 2})
