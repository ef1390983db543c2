import itertools

import pytest
from pyspark.sql import functions as F

from tracewright.operators import lengths as L
from tracewright.operators import sampling as N


def test_round_robin_equals_turn_taking(spark):
    rows = [("g", f"k{i % 3}", f"id{i}") for i in range(10)]
    df = spark.createDataFrame(rows, "g string, kind string, id string")
    got = {r.id for r in N.round_robin(df, "g", "kind", "s", "id", 7).collect()}
    import hashlib

    h = lambda *p: hashlib.sha256(":".join(p).encode()).hexdigest()
    queues = [sorted([r[2] for r in rows if r[1] == k], key=lambda i: h("s", i)) for k in sorted({r[1] for r in rows}, key=lambda k: h("s", k))]
    turns = [x for layer in itertools.zip_longest(*queues) for x in layer if x]
    assert got == set(turns[:7])
    with pytest.raises(Exception, match="too few"):
        N.round_robin(df, "g", "kind", "s", "id", 11, strict=True).collect()


def test_hash_order_ignores_partitions(spark):
    df = spark.range(100).withColumn("k", F.col("id").cast("string"))
    first = lambda d: [r.k for r in N.hash_first(d, "s", "k", 10).collect()]
    assert first(df.repartition(1)) == first(df.repartition(7))


def test_three_way_split_is_disjoint(spark):
    pool = spark.createDataFrame([("a" if i % 2 else "b", f"t{i}") for i in range(40)], "dataset string, instance_id string")
    ev = pool.where("instance_id in ('t1', 't2')")
    out = N.three_way_split(pool, ev, {"a": (3, 5), "b": (2, 4)}, "s")
    assert out.groupBy("instance_id").count().where("count > 1").isEmpty()
    assert {(r.split, r.dataset): r["count"] for r in out.groupBy("split", "dataset").count().collect()} == {("validation", "a"): 3, ("train", "a"): 5, ("validation", "b"): 2, ("train", "b"): 4, ("evaluation", "a"): 1, ("evaluation", "b"): 1}


def test_group_choice():
    groups = [(f"g{i}", n, p, f"{i}") for i, (n, p) in enumerate([(10, 5), (3, 0), (4, 4), (5, 1), (8, 2)])]
    chosen = N.choose_groups(groups, 0.3, 2, lambda k: k)
    rows = {g[0]: g for g in groups}
    assert abs(sum(rows[k][1] for k in chosen) - 9) <= 1 and any(rows[k][2] for k in chosen) and any(rows[k][2] < rows[k][1] for k in chosen)
    one = N.choose_groups([("a", 5, 0, "0"), ("b", 5, 5, "1")], 0.5, 1, lambda k: k)
    assert one == {"a", "b"}  # both outcomes


def test_eligibility(spark):
    patch = "diff --git a/x b/x\n+a\n+b\n"
    rows = [("a", patch, ["t"], ["p"], "s" * 80), ("b", patch, [], ["p"], "s" * 80), ("c", patch + patch, ["t"], ["p"], "s" * 80), ("d", patch, ["t"], ["p"], " " * 100), ("e", "diff --git a/x b/x\n+a\n", ["t"], ["p"], "s" * 80)]
    df = spark.createDataFrame(rows, "instance_id string, patch string, FAIL_TO_PASS array<string>, PASS_TO_PASS array<string>, problem_statement string")
    assert [r.instance_id for r in N.eligible_repo_tasks(df).collect()] == ["a"]


def test_even_lengths(spark):
    df = spark.createDataFrame([("g", f"i{n}", n) for n in range(11)], "g string, k string, num_tokens int")
    assert [r.num_tokens for r in N.even_lengths(df, 3, "s", "k", ["g"]).orderBy("num_tokens").collect()] == [0, 5, 10]
    assert [r.num_tokens for r in N.even_lengths(df, 1, "s", "k", ["g"]).collect()] == [5]


def test_update_plan(spark):
    sizes = [3000] * 9 + [7000] * 7 + [12000] * 5 + [60000] * 3
    rows = spark.createDataFrame(list(enumerate(sizes)), "row_id long, num_tokens int")
    plan = L.update_plan(rows, [4096, 8192, 16384, 32768, 49152, 65536], [8, 4, 2, 1, 1, 1], 8, "s")
    assert L.plan_faults(plan, rows, 8).isEmpty()
    assert plan.select("update").distinct().count() == 3
    assert plan.groupBy("update", "microbatch").agg(F.count_distinct("bucket").alias("b")).where("b > 1").isEmpty()


def test_length_report(spark):
    df = spark.createDataFrame([(v,) for v in (1, 2, 3, 10)], "num_tokens int")
    r = L.length_report(df).first()
    assert (r.rows, r.total, r.p50, r.p75, r.p90, r.p95, r.p99, r.most) == (4, 16, 2, 3, 10, 10, 10, 10)
    s = L.floor_rank_summary(df.withColumn("g", F.lit(1)), "num_tokens", ["g"]).first()
    assert (s.p90, s.median) == (3, 2.5)


def test_moving_statistics(spark):
    df = spark.createDataFrame([("g", i, float(v)) for i, v in enumerate([4, 2, 6])], "g string, i int, v double")
    assert [r.moving_average for r in L.moving_average(df, "v", ["i"], 2, ["g"]).orderBy("i").collect()] == [4, 3, 4]
    assert [r.smoothed for r in L.edge_padded_mean(df, "v", ["i"], ["g"], 2).orderBy("i").collect()] == [4, 3, 4]
    assert [r.smoothed for r in L.edge_padded_mean(df, "v", ["i"], ["g"], 9).orderBy("i").collect()] == [4, 2, 6]


def test_gate():
    with pytest.raises(ValueError):
        L.training_gate({"rows": 1}, {"rows": 2})
    L.training_gate({"rows": 2}, {"rows": 2})
