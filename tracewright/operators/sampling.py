"""Deterministic sampling and leak-safe splits."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ordered
from ..functions.text import patch_changed_lines, patch_file_count


def stable_score(seed: str, *parts: Column | str) -> Column:
    """Hash of ``seed:part:...``: the same order everywhere, on any number of partitions."""
    return F.sha2(F.concat_ws(":", F.lit(seed), *parts), 256)


def hash_rank(df: DataFrame, seed: str, key: str, by: list[str] | None = None) -> DataFrame:
    """Rank by hash within groups, or over all rows; ``hash_first`` is cheaper for the first rows only."""
    score = stable_score(seed, key)
    if not by:
        return ordered.rank(df, ordered.by_hash(score), [score, key], "hash_rank")
    return df.withColumn("hash_rank", F.row_number().over(Window.partitionBy(*by).orderBy(score, key)))


def hash_first(df: DataFrame, seed: str, key: str, n: int) -> DataFrame:
    """The first ``n`` rows by hash: a top-n, not a full sort."""
    return df.orderBy(stable_score(seed, key), key).limit(n)


def round_robin(df: DataFrame, group: str, kind: str, seed: str, key: str, n: int, strict: bool = False) -> DataFrame:
    """``n`` rows of each group, taken in turn from its kinds in hash order."""
    inside = df.withColumn("kind_rank", F.row_number().over(Window.partitionBy(group, kind).orderBy(stable_score(seed, key), key)))
    inside = inside.where(F.col("kind_rank") <= n)  # no kind gives more than all of them
    turn = Window.partitionBy(group).orderBy("kind_rank", stable_score(seed, kind), kind)
    out = inside.withColumn("pick", F.row_number().over(turn)).where(F.col("pick") <= n)
    if strict:
        out = out.withColumn("_have", F.count("*").over(Window.partitionBy(group)))
        out = out.where(F.when(F.col("_have") == n, True).otherwise(F.raise_error(F.concat(F.lit("too few rows in "), group)).cast("boolean"))).drop("_have")
    return out


def first_per_group(df: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_k") <= n).drop("_k")


def eligible_repo_tasks(tasks: DataFrame, files: int = 1, changed: tuple[int, int] = (2, 30), fails: tuple[int, int] = (1, 20), statement: int = 80) -> DataFrame:
    """Tasks of one file, a small change, some failing and passing tests and a real statement."""
    return tasks.where(
        (patch_file_count("patch") == files) & patch_changed_lines("patch").between(*changed) & F.size("FAIL_TO_PASS").between(*fails)
        & (F.size("PASS_TO_PASS") >= 1) & (F.length(F.trim("problem_statement")) >= statement)
    )


def eligible_function_tasks(tasks: DataFrame, evaluation: DataFrame, key: str = "task_id") -> DataFrame:
    """Tasks with prompt, reference and test, a unique id, and none of the evaluation's ids."""
    full = (F.trim("prompt") != "") & (F.trim("canonical_solution") != "") & (F.trim("test") != "")
    once = tasks.groupBy(key).count().where("count = 1").select(key)
    return tasks.where(full).join(once, key, "left_semi").join(evaluation.select(key), key, "left_anti")


def three_way_split(pool: DataFrame, evaluation: DataFrame, quotas: dict[str, tuple[int, int]], seed: str, key: str = "instance_id") -> DataFrame:
    """Validation first, then training from the rest, per dataset; evaluation ids never."""
    rest = pool.join(evaluation.select(key), key, "left_anti")
    parts = []
    for dataset, (n_val, n_train) in quotas.items():
        few = hash_first(rest.where(F.col("dataset") == dataset), seed, key, n_val + n_train)  # a top-n, then ranks of those
        ranked = hash_rank(few, seed, key, ["dataset"])
        part = F.when(F.col("hash_rank") <= n_val, "validation").when(F.col("hash_rank") <= n_val + n_train, "train")
        parts.append(ranked.withColumn("split", part).where("split is not null"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop("hash_rank").unionByName(evaluation.withColumn("split", F.lit("evaluation")), allowMissingColumns=True)


def repo_extension(pool: DataFrame, taken_repos: DataFrame, per_repo: int, n_repos: int, seed: str) -> DataFrame:
    """New repositories with enough tasks, hash-ranked, ``per_repo`` tasks of each over all kinds."""
    free = pool.join(taken_repos.select("repo").distinct(), "repo", "left_anti")
    enough = free.groupBy("repo").count().where(F.col("count") >= per_repo)
    chosen = hash_first(enough, seed, "repo", n_repos).select("repo")
    return round_robin(free.join(F.broadcast(chosen), "repo", "left_semi") if n_repos <= 10_000 else free.join(chosen, "repo", "left_semi"), "repo", "kind", seed, "instance_id", per_repo)


def group_key(family: Column | str, repo: Column | str, instance: Column | str) -> Column:
    f = F.col(family) if isinstance(family, str) else family
    return F.when(f == "repository", F.concat(F.lit("repo:"), repo)).otherwise(F.concat(F.lit("task:"), instance))


def choose_groups(groups: list[tuple[str, int, int, str]], ratio: float, least: int, score) -> set[str]:
    """Hold-out groups from ``(key, rows, positives, hash)``.

    With ``least`` over one, the combination of that many groups nearest to the target in
    rows, then positives, then by hash; then groups in hash order as long as they don't
    lead away from the target; then one for a label that is missing.
    """
    rows, positives = sum(g[1] for g in groups), sum(g[2] for g in groups)
    target = max(1, round(rows * ratio))
    ordered = sorted(groups, key=lambda g: (g[3], g[0]))
    chosen: dict[str, tuple] = {}
    if least > 1:
        if len(ordered) < least:
            raise ValueError(f"fewer than {least} groups")
        wanted = round(target * positives / rows)
        best = min(itertools.combinations(ordered, least), key=lambda c: (abs(sum(g[1] for g in c) - target), abs(sum(g[2] for g in c) - wanted), score("|".join(sorted(g[0] for g in c)))))
        chosen = {g[0]: g for g in best}
    have = sum(g[1] for g in chosen.values())
    for g in ordered:
        if g[0] not in chosen and (not chosen or abs(target - have - g[1]) <= abs(target - have)):
            chosen[g[0]] = g
            have += g[1]
        if have >= target:
            break
    for is_missing, has in ((lambda: positives < rows and all(g[1] == g[2] for g in chosen.values()), lambda g: g[2] < g[1]), (lambda: positives and not any(g[2] for g in chosen.values()), lambda g: g[2] > 0)):
        if is_missing() and (more := [g for g in ordered if g[0] not in chosen and has(g)]):
            chosen[more[0][0]] = more[0]
    return set(chosen)


def group_holdout(rows: DataFrame, ratio: float, seed: str, least: int = 1, max_groups: int = 5000) -> DataFrame:
    """``rows(group_key, reward, ...)`` with split train or validation, whole groups at a time.

    The choice runs on one row a group; more than ``max_groups`` are refused.
    """
    import hashlib

    stats = rows.groupBy("group_key").agg(F.count("*").alias("n"), F.sum(F.col("reward").cast("int")).alias("p"), F.first(stable_score(seed, "group_key")).alias("h"))
    found = stats.limit(max_groups + 1).collect()
    if len(found) > max_groups:
        raise ValueError("too many groups to choose from on the driver; split by hash instead")
    chosen = choose_groups([(r.group_key, r.n, r.p or 0, r.h) for r in found], ratio, least, lambda k: hashlib.sha256(f"{seed}:{k}".encode()).hexdigest())
    return rows.withColumn("split", F.when(F.col("group_key").isin(sorted(chosen)), "validation").otherwise("train"))


def reuse_holdout(rows: DataFrame, groups: DataFrame) -> DataFrame:
    g = groups.select("group_key").distinct().withColumn("_v", F.lit(True))
    return rows.join(g, "group_key", "left").withColumn("split", F.when(F.col("_v"), "validation").otherwise("train")).drop("_v")


def over_length(rows: DataFrame, most: int, policy: str = "exclude") -> DataFrame:
    """Rows within the length; longer ones are left out whole or raise, never cut."""
    if policy == "error":
        return rows.where(F.when(F.col("num_tokens") <= most, True).otherwise(F.raise_error(F.lit("a row is over the length")).cast("boolean")))
    return rows.where(F.col("num_tokens") <= most)


def even_lengths(rows: DataFrame, k: int, seed: str, key: str, by: list[str]) -> DataFrame:
    """``k`` rows of each group at even steps of the length order; one row is the middle one."""
    w = Window.partitionBy(*by)
    ranked = rows.withColumns({"_r": F.row_number().over(w.orderBy("num_tokens", stable_score(seed, key), key)) - 1, "_n": F.count("*").over(w)})
    want = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / (k - 1)).cast("bigint")) if k > 1 else F.array(F.floor(F.col("_n") / 2))
    return ranked.where((F.col("_n") <= k) | F.array_contains(want, F.col("_r").cast("bigint"))).drop("_r", "_n")


def overlap_groups(rows: DataFrame) -> DataFrame:
    """Distinct groups by split and family, and groups that are in two splits."""
    per = rows.groupBy("group_key").agg(F.count_distinct("split").alias("s"))
    counts = rows.groupBy("split", "dataset_family").agg(F.count_distinct("group_key").alias("groups"))
    return counts.crossJoin(F.broadcast(per.agg(F.count_if(F.col("s") > 1).alias("overlapping"))))  # one row
