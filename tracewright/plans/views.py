"""The driver's tables seen as the library's record kinds, in both engines.

``SQL`` holds the same views as DuckDB common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str, per_task: int | None) -> DataFrame:
    """Events of a user as the samples of a task, numbered by time."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    kind = F.col("event_type")
    out = e.select(
        F.concat(F.lit("task_"), F.col("user_id").cast("string")).alias("instance_id"),
        (F.row_number().over(w) - 1).cast("bigint").alias("sample_index"),
        F.when(F.col("user_id") % 3 == 0, "function_a").when(F.col("user_id") % 3 == 1, "function_b").otherwise("repository").alias("dataset"),
        F.when(kind == "purchase", True).when(kind == "error", None).otherwise(False).alias("benchmark_resolved"),
        F.when(kind == "error", "infrastructure_blocked").when(kind == "view", "max_steps").when(kind == "signup", "no_edit").when(kind == "purchase", "resolved").otherwise("edited").alias("agent_status"),
        F.when(kind == "error", "blocked_infrastructure").when(kind == "view", "unresolved").when(kind == "signup", "unresolved_no_edit").when(kind == "purchase", "resolved").otherwise("unresolved_tests_failed").alias("verifier_status"),
        (kind != "error").alias("sample_valid"),
        ((kind == "click") | (kind == "purchase") | ((kind == "view") & (F.col("value") > 20))).alias("patch_present"),
        F.floor("value").cast("bigint").alias("tool_steps"),
        F.concat(F.lit("repo_"), (F.col("user_id") % 7).cast("string")).alias("repo"),
        (F.col("event_id") % 4).cast("bigint").alias("round"),
        "user_id", "event_id", "ts", "event_type", "value",
    )
    return out.where(F.col("sample_index") < per_task) if per_task else out


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "labels")
    return table(spark, sf_dir, "documents").join(l, "doc_id", "left")


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.ceil(F.col("n_chars") / F.lit(3.5).cast("double")).cast("bigint").alias("num_tokens"), "lang", "source", "quality", "toxic")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("trajectory_id"), F.col("turn").alias("pos"), "role", F.col("text").alias("content"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir)
    return m.groupBy("trajectory_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "role", "content"))), lambda x: F.struct(x["role"], x["content"])).alias("messages"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as the steps of a trajectory."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    tool = F.when(F.col("event_type") == "purchase", "str_replace_editor").when(F.col("event_type") == "signup", "run_tests").when(F.col("event_type") == "view", "git_diff").when(F.col("event_type") == "error", "finish").otherwise("execute_bash")
    return e.select(
        F.col("user_id").cast("string").alias("trajectory_id"), F.row_number().over(w).cast("bigint").alias("step"), tool.alias("tool_name"), (F.col("event_type") == "purchase").alias("is_edit"),
        (F.col("event_id") % 3).cast("bigint").alias("returncode"), (F.col("event_id") % 5 == 0).alias("all_skipped"), "value", "ts", "event_id", "props",
    )


SQL = {
    "v_samples": """v_all AS (SELECT 'task_' || CAST(user_id AS VARCHAR) AS instance_id,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS sample_index,
  CASE user_id % 3 WHEN 0 THEN 'function_a' WHEN 1 THEN 'function_b' ELSE 'repository' END AS dataset,
  CASE event_type WHEN 'purchase' THEN true WHEN 'error' THEN NULL ELSE false END AS benchmark_resolved,
  CASE event_type WHEN 'error' THEN 'infrastructure_blocked' WHEN 'view' THEN 'max_steps' WHEN 'signup' THEN 'no_edit' WHEN 'purchase' THEN 'resolved' ELSE 'edited' END AS agent_status,
  CASE event_type WHEN 'error' THEN 'blocked_infrastructure' WHEN 'view' THEN 'unresolved' WHEN 'signup' THEN 'unresolved_no_edit' WHEN 'purchase' THEN 'resolved' ELSE 'unresolved_tests_failed' END AS verifier_status,
  event_type <> 'error' AS sample_valid,
  event_type IN ('click', 'purchase') OR (event_type = 'view' AND value > 20) AS patch_present,
  CAST(floor(value) AS BIGINT) AS tool_steps, 'repo_' || CAST(user_id % 7 AS VARCHAR) AS repo, event_id % 4 AS round,
  user_id, event_id, ts, event_type, value FROM events),
v_samples AS (SELECT * FROM v_all WHERE sample_index < 5)""",
    "v_docs": "v_docs AS (SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))",
    "v_lengths": "v_lengths AS (SELECT d.doc_id, CAST(ceil(d.n_chars / 3.5::DOUBLE) AS BIGINT) AS num_tokens, d.lang, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))",
    "v_messages": "v_messages AS (SELECT CAST(conv_id AS VARCHAR) AS trajectory_id, turn AS pos, role, text AS content FROM conversations)",
    "v_calls": """v_calls AS (SELECT CAST(user_id AS VARCHAR) AS trajectory_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS step,
  CASE event_type WHEN 'purchase' THEN 'str_replace_editor' WHEN 'signup' THEN 'run_tests' WHEN 'view' THEN 'git_diff' WHEN 'error' THEN 'finish' ELSE 'execute_bash' END AS tool_name,
  event_type = 'purchase' AS is_edit, event_id % 3 AS returncode, event_id % 5 = 0 AS all_skipped, value, ts, event_id, props FROM events)""",
}


def sql(body: str, *names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names) + "\n" + body if names else body
