"""Every query of the core library by name, with the same query in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dialects as D
from ..functions import text as T
from ..functions import toolcalls as C
from ..operators import conversations as V
from ..operators import joins as J
from ..operators import lengths as L
from ..operators import masks as M
from ..operators import metrics as E
from ..operators import samples as S
from ..operators import sampling as N
from ..operators import search as R
from ..sources import readers
from ..streaming import monitor
from . import views as W

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(body: str | None = None, *names: str):
    """Registers a query, with its SQL if there is one over the named views."""

    def add(f):
        QUERIES[f.__name__] = f
        if body:
            ORACLE_SQL[f.__name__] = W.sql(body, *names)
        return f

    return add


def _pass(k: int) -> str:
    product = " * ".join(f"CAST(greatest(valid - resolved - {i}, 0) AS DOUBLE) / CAST(greatest(valid - {i}, 1) AS DOUBLE)" for i in range(k))
    return f"CASE WHEN valid >= {k} THEN 1.0::DOUBLE - {product} END"


_TASKS = f"""tasks AS (SELECT *, present = 5 AND valid = 5 AS complete, {", ".join(f"{_pass(k)} AS pass_at_{k}" for k in (1, 3, 5))}
FROM (SELECT instance_id, min_by(dataset, sample_index) AS dataset, count(*) AS present, count(benchmark_resolved) AS valid,
count(*) FILTER (WHERE benchmark_resolved) AS resolved FROM v_samples GROUP BY instance_id) g)"""


@query(f", {_TASKS} SELECT instance_id, dataset, present, valid, resolved, complete, round(pass_at_1, 6) AS pass_at_1, round(pass_at_3, 6) AS pass_at_3, round(pass_at_5, 6) AS pass_at_5 FROM tasks", "v_samples")
def pass_at_k_tasks(spark, d):
    out = S.pass_at_k_tasks(W.samples(spark, d, 5), [1, 3, 5], 5)
    return out.withColumns({f"pass_at_{k}": F.round(f"pass_at_{k}", 6) for k in (1, 3, 5)})


@query(
    f""", {_TASKS} SELECT CASE WHEN grouping(dataset) = 1 THEN 'overall' ELSE dataset END AS dataset, count(*) AS tasks, count(*) FILTER (WHERE complete) AS complete_tasks,
{", ".join(f"round(avg(CASE WHEN complete THEN pass_at_{k} END), 6) AS pass_at_{k}" for k in (1, 3, 5))} FROM tasks GROUP BY GROUPING SETS ((dataset), ())""",
    "v_samples",
)
def pass_at_k_aggregate(spark, d):
    return S.pass_at_k_aggregate(S.pass_at_k_tasks(W.samples(spark, d, 5), [1, 3, 5], 5), [1, 3, 5], "dataset")


_OUTCOME = """CASE WHEN coalesce(benchmark_resolved, lower(verifier_status) = 'resolved') THEN 'resolved'
WHEN NOT sample_valid OR agent_status IN ('infrastructure_blocked','model_api_failure','runner_error','blocked_infrastructure') THEN 'infrastructure'
WHEN agent_status = 'parse_error' THEN 'protocol_parse_error' WHEN agent_status IN ('context_overflow','compile_failed') THEN agent_status
WHEN NOT patch_present AND (agent_status = 'max_steps' OR verifier_status = 'model_failure_max_steps') THEN 'no_patch_max_steps' WHEN NOT patch_present THEN 'no_effective_edit'
WHEN verifier_status = 'unresolved_tests_failed' THEN 'tests_failed' WHEN verifier_status IN ('unresolved_no_edit','model_failure_no_edit') THEN 'no_effective_edit'
WHEN verifier_status IN ('unresolved','blocked_missing_patch') THEN 'unresolved_patch' ELSE verifier_status END"""


@query(f"SELECT {_OUTCOME} AS outcome, count(*) AS n FROM v_all GROUP BY 1", "v_samples")
def outcome_histogram(spark, d):
    return S.histogram(S.outcome_label(W.samples(spark, d, None)), "outcome", "outcome")


_SUMMARY = """count(*) AS total, count(*) FILTER (WHERE benchmark_resolved) AS resolved, round(100.0::DOUBLE * count(*) FILTER (WHERE benchmark_resolved) / count(*), 6) AS pass_rate,
CAST(sum(tool_steps) AS BIGINT) AS tool_steps, round(avg(tool_steps), 6) AS mean_tool_steps"""


@query(f"SELECT CASE WHEN grouping(dataset) = 1 THEN 'all' ELSE dataset END AS dataset, {_SUMMARY} FROM v_all GROUP BY GROUPING SETS ((dataset), ())", "v_samples")
def by_dataset_rates(spark, d):
    return S.summary(W.samples(spark, d, None), ["dataset"], [])


@query(
    f"""SELECT CASE WHEN grouping(round) = 1 THEN 'all' ELSE CAST(round AS VARCHAR) END AS round, CASE WHEN grouping(dataset) = 1 THEN 'all' ELSE dataset END AS dataset, {_SUMMARY}
FROM v_all GROUP BY GROUPING SETS ((round), (round, dataset), ())""",
    "v_samples",
)
def by_round_grouping_sets(spark, d):
    return S.summary(W.samples(spark, d, None), ["round"], ["round", "dataset"], [])


@query("SELECT count(*) AS tasks, count(*) FILTER (WHERE s) AS covered, round(count(*) FILTER (WHERE s)::DOUBLE / count(*), 6) AS coverage FROM (SELECT instance_id, bool_or(coalesce(benchmark_resolved, false)) AS s FROM v_all GROUP BY 1)", "v_samples")
def coverage(spark, d):
    return S.coverage(W.samples(spark, d, None))


@query("SELECT successes, count(*) AS tasks FROM (SELECT instance_id, count(*) FILTER (WHERE benchmark_resolved) AS successes FROM v_all GROUP BY 1) GROUP BY 1", "v_samples")
def coverage_histogram(spark, d):
    return S.success_histogram(W.samples(spark, d, None))


@query("SELECT count(*) - count(DISTINCT (instance_id, round)) AS duplicates FROM v_all", "v_samples")
def duplicate_pairs(spark, d):
    return S.duplicate_pairs(W.samples(spark, d, None), "instance_id", "round")


@query("SELECT count(*) FILTER (WHERE r = 4) AS common_tasks, count(*) AS union_tasks, bool_and(r = 4) AS same_tasks FROM (SELECT instance_id, count(DISTINCT round) AS r FROM v_all WHERE tool_steps > 60 GROUP BY 1)", "v_samples")
def run_comparison(spark, d):
    return S.compare_runs(W.samples(spark, d, None).where("tool_steps > 60"), "round")


@query(
    """, a AS (SELECT DISTINCT instance_id FROM v_all WHERE round = 0 AND tool_steps > 60), b AS (SELECT DISTINCT instance_id FROM v_all WHERE round = 1 AND tool_steps > 60)
SELECT coalesce(a.instance_id, b.instance_id) AS instance_id, CASE WHEN b.instance_id IS NULL THEN 'left' ELSE 'right' END AS side FROM a FULL JOIN b ON a.instance_id = b.instance_id WHERE a.instance_id IS NULL OR b.instance_id IS NULL""",
    "v_samples",
)
def missing_tasks(spark, d):
    s = W.samples(spark, d, None).where("tool_steps > 60")
    return J.id_difference(s.where("round = 0"), s.where("round = 1"), "instance_id")


@query("SELECT count(*) AS total, count(benchmark_resolved) AS valid, count(*) FILTER (WHERE benchmark_resolved) AS resolved, count(*) FILTER (WHERE NOT benchmark_resolved) AS unresolved, count(*) FILTER (WHERE benchmark_resolved IS NULL) AS blocked FROM v_all", "v_samples")
def status_counts(spark, d):
    return S.status_counts(W.samples(spark, d, None))


@query(
    """, p AS (SELECT instance_id, avg(CASE WHEN benchmark_resolved THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS x FROM v_all GROUP BY 1), h AS (SELECT avg(x) AS m, 1.96 * stddev_samp(x) / sqrt(count(x)) AS w FROM p)
SELECT round(m, 6) AS mean, round(greatest(0.0, m - w), 6) AS low, round(least(1.0, m + w), 6) AS high FROM h""",
    "v_samples",
)
def normal_ci(spark, d):
    per = W.samples(spark, d, None).groupBy("instance_id").agg(F.avg(F.when(F.col("benchmark_resolved"), 1.0).otherwise(0.0)).alias("x"))
    return S.normal_ci(per, "x")


@query(
    """, c AS (SELECT count(*) AS n, sum((s >= 1)::INT) AS any1, sum(s) AS total, sum(CASE WHEN s = 1 THEN 1 ELSE 0 END) AS one, sum(CASE WHEN s = 2 THEN 1 ELSE 0 END) AS two, sum(CASE WHEN s = 3 THEN 1 ELSE 0 END) AS three,
 sum(CASE WHEN s = 0 THEN 1 ELSE 0 END) AS zero FROM (SELECT instance_id, count(*) FILTER (WHERE benchmark_resolved) AS s FROM v_all WHERE sample_index < 3 GROUP BY 1))
SELECT CAST(zero AS BIGINT) AS zero, CAST(one AS BIGINT) AS one, CAST(two AS BIGINT) AS two, CAST(three AS BIGINT) AS three FROM c""",
    "v_samples",
)
def task_consistency(spark, d):
    """Success counts recovered from pass@1..3 alone."""
    t = S.pass_at_k_tasks(W.samples(spark, d, 3).withColumn("benchmark_resolved", F.coalesce("benchmark_resolved", F.lit(False))), [1, 2, 3], 3)
    p = t.agg(F.count("*").alias("n"), *[F.avg(f"pass_at_{k}").alias(f"p{k}") for k in (1, 2, 3)])
    s1, s2, s3 = (F.col(f"p{k}") * F.col("n") for k in (1, 2, 3))
    counts = S.consistency_counts(s1, s2, s3)
    return p.select(*[c.alias(name) for name, c in {"zero": F.col("n") - counts["one"] - counts["two"] - counts["three"], **counts}.items()])



@query(
    """SELECT doc_id, source NOT IN ('src3', 'src4') AND lang <> 'de' AND coalesce(quality = 1, false) AS resolved, CASE WHEN source IN ('src3', 'src4') THEN 'evaluation_excluded' WHEN lang = 'de' THEN 'non_trainable_status'
WHEN NOT coalesce(quality = 1, false) THEN 'unresolved_excluded' ELSE 'included' END AS reason FROM v_docs""",
    "v_docs",
)
def verifier_authoritative(spark, d):
    docs = W.table(spark, d, "documents")
    rows = docs.select("doc_id", F.when(F.col("lang") == "de", "parse_error").otherwise("edited").alias("status"), F.col("source").isin("src3", "src4").alias("exclude_from_training"), F.lit("train").alias("data_role"), F.lit(False).alias("resolved"))
    verifier = W.table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("benchmark_resolved"))
    return S.training_decision(rows, verifier, "doc_id").select("doc_id", "resolved", "reason")


@query(
    """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN coalesce(toxic, 0) = 1 THEN 'evaluation_excluded' WHEN source IN ('src1', 'src2') THEN 'non_trainable_status' WHEN coalesce(quality, 0) <> 1 THEN 'verifier_unresolved'
WHEN n_chars < 400 THEN 'invalid_tool_protocol' END AS reason FROM v_docs) GROUP BY 1""",
    "v_docs",
)
def exclusion_reasons(spark, d):
    r = S.exclusion_reason(F.coalesce("toxic", F.lit(0)) == 1, F.when(F.col("source").isin("src1", "src2"), "parse_error"), F.col("quality") == 1, F.col("n_chars") >= 400)
    return S.histogram(W.docs(spark, d), r, "reason")


@query("SELECT p_partkey, p_brand FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def semi_join_runnable(spark, d):
    return J.keep_known(W.table(spark, d, "part").select("p_partkey", "p_brand"), W.table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey")


@query("SELECT o_custkey, count(*) AS orders FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1")
def anti_join_eval(spark, d):
    taken = W.table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return J.drop_known(W.table(spark, d, "orders"), taken, "o_custkey").groupBy("o_custkey").agg(F.count("*").alias("orders"))


@query("SELECT o_orderkey, o_custkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def catalog_join(spark, d):
    catalog = W.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    return J.total_join(W.table(spark, d, "orders").select("o_orderkey", "o_custkey"), catalog, "o_custkey")


@query("SELECT doc_id, first_value(doc_id) OVER (PARTITION BY sha256(text) ORDER BY string_split(source, '/'), doc_id) AS kept_id, sha256(text) AS sha256 FROM documents")
def exact_dedup_first_wins(spark, d):
    w = Window.partitionBy("sha256").orderBy(F.split("source", "/"), "doc_id")
    return W.table(spark, d, "documents").select("doc_id", "source", T.text_sha256("text").alias("sha256")).select("doc_id", F.first("doc_id").over(w).alias("kept_id"), "sha256")


@query(
    """SELECT doc_id, lang, CASE WHEN r <= 10 THEN 'validation' ELSE 'train' END AS split FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('s1:' || CAST(doc_id AS VARCHAR)), doc_id) AS r FROM v_lengths) WHERE r <= 40""",
    "v_lengths",
)
def hash_rank_split(spark, d):
    r = N.hash_rank(W.lengths(spark, d).withColumn("key", F.col("doc_id").cast("string")), "s1", "key", ["lang"])
    return r.where("hash_rank <= 40").select("doc_id", "lang", F.when(F.col("hash_rank") <= 10, "validation").otherwise("train").alias("split"))


@query(
    """, k AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY sha256('s2:' || CAST(doc_id AS VARCHAR)), CAST(doc_id AS VARCHAR)) AS kr FROM v_lengths),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY kr, sha256('s2:' || source), source) AS pick FROM k) SELECT doc_id, lang, source, pick FROM p WHERE pick <= 30""",
    "v_lengths",
)
def stratified_round_robin(spark, d):
    rows = W.lengths(spark, d).withColumn("key", F.col("doc_id").cast("string"))
    return N.round_robin(rows, "lang", "source", "s2", "key", 30).select("doc_id", "lang", "source", F.col("pick").cast("bigint").alias("pick"))


@query(
    r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, 'sk-[A-Za-z0-9_-]{16,}', '<redacted-secret>', 'g'), 'AKIA[A-Z0-9]{16}', '<redacted-secret>', 'g'), 'LTAI[A-Za-z0-9]{12,}', '<redacted-secret>', 'g')) AS clean_sha256,
CAST(len(regexp_extract_all(text, 'sk-[A-Za-z0-9_-]{16,}')) + len(regexp_extract_all(text, 'AKIA[A-Z0-9]{16}')) + len(regexp_extract_all(text, 'LTAI[A-Za-z0-9]{12,}')) AS BIGINT) AS redactions FROM documents"""
)
def redact_secrets(spark, d):
    text, n = T.redact_secrets("text")
    return W.table(spark, d, "documents").select("doc_id", T.text_sha256(text).alias("clean_sha256"), n.alias("redactions"))


@query("SELECT page_id, replace(replace(url, 'https://www.', '<secure>'), '/en/', '<lang>') AS clean FROM pages")
def sanitize_paths(spark, d):
    return W.table(spark, d, "pages").select("page_id", T.sanitize_paths("url", [("https://www.", "<secure>"), ("", "never"), ("/en/", "<lang>")]).alias("clean"))


@query("SELECT trajectory_id, pos, role, lead(role) OVER w AS next_role, length(lead(content) OVER w) AS next_length FROM v_messages WINDOW w AS (PARTITION BY trajectory_id ORDER BY pos)", "v_messages")
def message_lead_pairs(spark, d):
    return V.neighbours(W.messages(spark, d)).select("trajectory_id", "pos", "role", "next_role", F.length("next_content").cast("bigint").alias("next_length"))


@query("SELECT trajectory_id, pos, role FROM (SELECT *, max(CASE WHEN role = 'assistant' THEN pos END) OVER (PARTITION BY trajectory_id) AS last FROM v_messages) WHERE last IS NULL OR pos <= last", "v_messages")
def last_assistant_truncate(spark, d):
    marked = W.messages(spark, d).withColumn("tool", F.when(F.col("role") == "assistant", "finish"))
    return V.truncate_after_finish(marked).select("trajectory_id", "pos", "role")


@query("SELECT trajectory_id, pos, CAST(sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY trajectory_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS unit FROM v_messages", "v_messages")
def unit_segments(spark, d):
    return V.units(W.messages(spark, d)).select("trajectory_id", "pos", "unit")


@query("SELECT trajectory_id, pos, min(CASE WHEN role = 'assistant' THEN pos END) OVER (PARTITION BY trajectory_id ORDER BY pos ROWS BETWEEN 2 FOLLOWING AND UNBOUNDED FOLLOWING) AS recovery_pos FROM v_messages", "v_messages")
def next_matching_row(spark, d):
    marked = W.messages(spark, d).withColumn("tool", F.when(F.col("role") == "assistant", "t"))
    return V.next_valid_call(marked).select("trajectory_id", "pos", "recovery_pos")


@query("SELECT a.trajectory_id, a.pos AS step_index, count(b.pos) AS history_steps, coalesce(CAST(sum(length(b.content)) AS BIGINT), 0) AS history_chars FROM v_messages a LEFT JOIN v_messages b ON a.trajectory_id = b.trajectory_id AND b.pos < a.pos GROUP BY 1, 2", "v_messages")
def next_action_unroll(spark, d):
    steps = W.conversations(spark, d).withColumnRenamed("messages", "steps")
    chars = F.aggregate("history", F.lit(0).cast("bigint"), lambda a, m: a + F.length(m["content"]))
    return V.next_actions(steps).select("trajectory_id", F.col("step_index").cast("bigint").alias("step_index"), F.size("history").cast("bigint").alias("history_steps"), chars.alias("history_chars"))


@query("SELECT trajectory_id, greatest(1, CAST(ceil(sum(length(role) + length(content) + 24) / 3.5::DOUBLE) AS BIGINT)) AS tokens FROM v_messages GROUP BY 1", "v_messages")
def token_estimate(spark, d):
    return W.conversations(spark, d).select("trajectory_id", T.estimate_message_tokens("messages").alias("tokens"))


_Q = ", ".join(f"CAST(quantile_disc(num_tokens, 0.{p}) AS BIGINT) AS p{p}" for p in (50, 75, 90, 95, 99))


@query(f"SELECT lang, count(*) AS rows, CAST(sum(num_tokens) AS BIGINT) AS total, round(avg(num_tokens), 6) AS mean, min(num_tokens) AS least, {_Q}, max(num_tokens) AS most FROM v_lengths GROUP BY 1", "v_lengths")
def length_report(spark, d):
    return L.length_report(W.lengths(spark, d), "lang")


@query("SELECT CASE WHEN num_tokens <= 4096 THEN '<=4096' WHEN num_tokens <= 8192 THEN '<=8192' WHEN num_tokens <= 16384 THEN '<=16384' WHEN num_tokens <= 32768 THEN '<=32768' ELSE 'above' END AS bucket, count(*) AS rows FROM v_lengths GROUP BY 1", "v_lengths")
def length_buckets(spark, d):
    return L.bucket_histogram(W.lengths(spark, d))


@query("SELECT doc_id, num_tokens FROM v_lengths ORDER BY num_tokens DESC, doc_id LIMIT 20", "v_lengths")
def top20_longest(spark, d):
    return L.longest(W.lengths(spark, d), 20, key="doc_id").select("doc_id", "num_tokens")


@query(
    """, s AS (SELECT source, list_sort(list(num_tokens)) AS v, round(avg(num_tokens), 3) AS mean, quantile_cont(num_tokens, 0.5) AS median FROM v_lengths GROUP BY 1)
SELECT source, v[1] AS least, mean, CAST(median AS DOUBLE) AS median, v[greatest(CAST(floor(0.9 * len(v)) AS INT), 1)] AS p90, v[len(v)] AS most FROM s""",
    "v_lengths",
)
def distribution_floor_p90(spark, d):
    return L.floor_rank_summary(W.lengths(spark, d), "num_tokens", ["source"])


@query("SELECT source, doc_id, num_tokens, CAST(coalesce(sum(num_tokens) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM v_lengths", "v_lengths")
def running_offset(spark, d):
    return L.running_offset(W.lengths(spark, d), "doc_id", by=["source"]).select("source", "doc_id", "num_tokens", "offset")


@query("SELECT doc_id, CAST(coalesce(sum(num_tokens) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM v_lengths", "v_lengths")
def global_offset(spark, d):
    return L.running_offset(W.lengths(spark, d), "doc_id").select("doc_id", "offset")


@query("SELECT doc_id, row_number() OVER (ORDER BY sha256('g:' || CAST(doc_id AS VARCHAR))) AS hash_rank, rank() OVER (ORDER BY num_tokens) + (count(*) OVER (PARTITION BY num_tokens) - 1) / 2.0::DOUBLE AS average_rank FROM v_lengths", "v_lengths")
def global_ranks(spark, d):
    ranked = N.hash_rank(W.lengths(spark, d).withColumn("key", F.col("doc_id").cast("string")), "g", "key")
    return L.average_rank(ranked, "num_tokens").select("doc_id", F.col("hash_rank").cast("bigint").alias("hash_rank"), F.col("average_rank").cast("double").alias("average_rank"))


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS moving_average FROM events")
def moving_average(spark, d):
    return L.moving_average(W.table(spark, d, "events"), "value", ["ts", "event_id"], 5, ["user_id"]).select("event_id", F.round("moving_average", 6).alias("moving_average"))


@query(
    """, x AS (SELECT event_id, value, first_value(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f, sum(value) OVER w AS s, count(*) OVER w AS c, count(*) OVER (PARTITION BY user_id) AS n FROM v_all WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 24 PRECEDING AND CURRENT ROW))
SELECT event_id, round(CASE WHEN n < 25 THEN value ELSE (s + (25 - c) * f) / 25 END, 6) AS smoothed FROM x""",
    "v_samples",
)
def edge_padded_mean(spark, d):
    return L.edge_padded_mean(W.table(spark, d, "events"), "value", ["ts", "event_id"], ["user_id"]).select("event_id", F.round("smoothed", 6).alias("smoothed"))


@query("SELECT doc_id, rank() OVER (PARTITION BY lang ORDER BY num_tokens) + (count(*) OVER (PARTITION BY lang, num_tokens) - 1) / 2.0::DOUBLE AS average_rank FROM v_lengths", "v_lengths")
def average_rank(spark, d):
    return L.average_rank(W.lengths(spark, d), "num_tokens", ["lang"]).select("doc_id", F.col("average_rank").cast("double").alias("average_rank"))


_BATCHES = """, b AS (SELECT doc_id, num_tokens, CASE WHEN num_tokens <= 512 THEN '<=512' WHEN num_tokens <= 1024 THEN '<=1024' ELSE 'above' END AS bucket FROM v_lengths),
p AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY bucket ORDER BY num_tokens, sha256('b:0:' || CAST(doc_id AS VARCHAR)), CAST(doc_id AS VARCHAR)) - 1) / CASE bucket WHEN '<=512' THEN 8 WHEN '<=1024' THEN 4 ELSE 2 END) AS BIGINT) AS batch FROM b)"""


def _batches(spark, d):
    rows = W.lengths(spark, d).withColumn("bucket", T.length_bucket("num_tokens", [512, 1024])).withColumn("key", F.col("doc_id").cast("string"))
    return L.bucket_batches(rows, {"<=512": 8, "<=1024": 4, "above": 2}, "b", "key")


@query(_BATCHES + " SELECT doc_id, bucket, batch FROM p", "v_lengths")
def bucket_batches(spark, d):
    return _batches(spark, d).select("doc_id", "bucket", "batch")


@query(_BATCHES + " SELECT bucket, batch, count(*) AS rows, CAST(sum(num_tokens) AS BIGINT) AS real_tokens, CAST(max(num_tokens) * count(*) AS BIGINT) AS padded_tokens, CAST(max(num_tokens) * count(*) - sum(num_tokens) AS BIGINT) AS padding FROM p GROUP BY 1, 2", "v_lengths")
def padding_stats(spark, d):
    return L.padding_stats(_batches(spark, d)).drop("shard")


def _scored(spark, d):
    return W.lengths(spark, d).where("quality is not null").select("doc_id", "lang", F.col("quality").alias("reward"), (F.col("num_tokens") % 100 / F.lit(100.0)).cast("double").alias("score"), F.when(F.col("doc_id") % 3 == 0, "validation").otherwise("train").alias("split"))


_SCORED = ", sc AS (SELECT doc_id, lang, quality AS reward, (num_tokens % 100) / 100.0::DOUBLE AS score, CASE WHEN doc_id % 3 = 0 THEN 'validation' ELSE 'train' END AS split FROM v_lengths WHERE quality IS NOT NULL)"
_AUC = """SELECT lang, CASE WHEN count(*) FILTER (WHERE reward = 1) > 0 AND count(*) FILTER (WHERE reward = 0) > 0 THEN
 (sum(CASE WHEN reward = 1 THEN ar END) - count(*) FILTER (WHERE reward = 1) * (count(*) FILTER (WHERE reward = 1) + 1) / 2.0) / (count(*) FILTER (WHERE reward = 1) * count(*) FILTER (WHERE reward = 0)) END AS auc
FROM (SELECT *, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0::DOUBLE AS ar FROM sc) GROUP BY lang"""


@query(_SCORED + f" SELECT lang, round(auc, 6) AS auc FROM ({_AUC})", "v_lengths")
def rank_auc(spark, d):
    return E.rank_auc(_scored(spark, d), "reward", "score", ["lang"]).select("lang", F.round(F.col("auc").cast("double"), 6).alias("auc"))


_METRICS = """SELECT lang, count(*) AS n, avg((score - reward) * (score - reward)) AS mse, avg((least(greatest(score, 0), 1) - reward) * (least(greatest(score, 0), 1) - reward)) AS brier,
CASE WHEN var_pop(reward) > 0 THEN 1 - var_pop(reward - score) / var_pop(reward) END AS explained_variance, avg(CASE WHEN reward = 1 THEN score END) AS mean_positive, avg(CASE WHEN reward = 0 THEN score END) AS mean_negative FROM sc GROUP BY lang"""


@query(_SCORED + f" SELECT lang, n, round(mse, 6) AS mse, round(brier, 6) AS brier, round(explained_variance, 6) AS explained_variance, round(mean_positive, 6) AS mean_positive, round(mean_negative, 6) AS mean_negative FROM ({_METRICS})", "v_lengths")
def binary_metrics(spark, d):
    m = E.binary_metrics(_scored(spark, d), "reward", "score", ["lang"])
    return m.select("lang", "n", *[F.round(c, 6).alias(c) for c in ("mse", "brier", "explained_variance", "mean_positive", "mean_negative")])


@query(
    _SCORED + f""", pr AS (SELECT lang, avg(reward) AS prior FROM sc WHERE split = 'train' GROUP BY 1), ba AS (SELECT sc.lang, avg((prior - reward) * (prior - reward)) AS baseline_brier FROM sc JOIN pr USING (lang) GROUP BY 1)
SELECT m.lang, round(m.brier, 6) AS brier, round(ba.baseline_brier, 6) AS baseline_brier, coalesce(m.brier < ba.baseline_brier AND a.auc > 0.5 AND m.explained_variance > 0, false) AS passed FROM ({_METRICS}) m LEFT JOIN ({_AUC}) a USING (lang) LEFT JOIN ba USING (lang)""",
    "v_lengths",
)
def priors_baseline_gate(spark, d):
    rows = _scored(spark, d)
    base = E.constant_baseline(rows, E.family_priors(rows, by="lang"), by="lang")
    m = E.binary_metrics(rows, "reward", "score", ["lang"]).join(E.rank_auc(rows, "reward", "score", ["lang"]), "lang")
    return E.quality_gate(m, base, "lang").select("lang", F.round("brier", 6).alias("brier"), F.round("baseline_brier", 6).alias("baseline_brier"), "passed")


@query(
    """SELECT event_type AS epoch, round(sum(value * (user_id + 1)) / sum(user_id + 1), 6) AS loss, round(quantile_cont(value, 0.5), 6) AS median_loss, round(quantile_cont(value * 2, 0.95), 6) AS p95_grad, round(max(value * 2), 6) AS max_grad,
arg_max(value, event_id) AS last_lr, CAST(sum(user_id + 1) AS BIGINT) AS tokens FROM events GROUP BY 1"""
)
def weighted_loss_summary(spark, d):
    log = W.table(spark, d, "events").select(F.col("event_type").alias("epoch"), F.col("value").alias("loss"), (F.col("user_id") + 1).alias("tokens"), (F.col("value") * 2).alias("grad_norm"), F.col("value").alias("lr"), F.col("event_id").alias("step"))
    return E.epoch_summary(log).select("epoch", *[F.round(c, 6).alias(c) for c in ("loss", "median_loss", "p95_grad", "max_grad")], "last_lr", "tokens")


@query(
    """, l AS (SELECT *, sum(CASE WHEN is_edit THEN 1 ELSE 0 END) OVER (PARTITION BY trajectory_id ORDER BY step ROWS UNBOUNDED PRECEDING) AS island FROM v_calls WHERE step > 10),
s AS (SELECT *, row_number() OVER (PARTITION BY trajectory_id, island ORDER BY step) - CASE WHEN island > 0 THEN 1 ELSE 0 END AS streak FROM l)
SELECT trajectory_id, step, CAST(streak AS BIGINT) AS streak FROM s WHERE NOT is_edit AND tool_name <> 'finish' AND streak % 3 = 0""",
    "v_calls",
)
def readonly_counter(spark, d):
    return V.modification_reminders(W.calls(spark, d), 10, 3).where("remind").select("trajectory_id", "step", F.col("streak").cast("bigint").alias("streak"))


@query(
    """, g AS (SELECT trajectory_id, coalesce(max(CASE WHEN is_edit THEN step END), 0) AS last_edit, max(CASE WHEN tool_name = 'run_tests' AND returncode = 0 AND NOT all_skipped THEN step END) AS last_test,
 max(CASE WHEN tool_name = 'git_diff' AND returncode = 0 THEN step END) AS last_diff FROM v_calls GROUP BY 1) SELECT *, coalesce(last_test > last_edit, false) AND coalesce(last_diff > last_edit, false) AS ready FROM g""",
    "v_calls",
)
def completion_gate(spark, d):
    return V.completion_gate(W.calls(spark, d))


@query("SELECT trajectory_id, min(step) AS first, max(step) AS last FROM (SELECT *, step - row_number() OVER (PARTITION BY trajectory_id ORDER BY step) AS i FROM v_calls WHERE tool_name <> 'finish') GROUP BY trajectory_id, i", "v_calls")
def contiguous_ranges(spark, d):
    return L.contiguous_ranges(W.calls(spark, d).where("tool_name != 'finish'"), ["trajectory_id"], "step")


@query("SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY event_id) AS peak FROM events")
def peaks_so_far(spark, d):
    return L.peaks_so_far(W.table(spark, d, "events"), "value", "event_id", ["user_id"]).select("event_id", "peak")


_TERMS = "list_transform(regexp_extract_all({}, '[A-Za-z_][A-Za-z0-9_]+|[一-鿿]{{2,}}'), lambda x: lower(x))"


@query(
    f"""WITH q AS (SELECT item_id, unnest(list_distinct({_TERMS.format("text")})) AS term FROM benchmark), r AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TERMS.format("text")}) AS term FROM documents) GROUP BY 1, 2),
o AS (SELECT item_id, doc_id, count(*) * 5.0::DOUBLE + sum(least(tf, 3)) * 0.5::DOUBLE AS score FROM r JOIN q USING (term) GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM o)
SELECT item_id, doc_id, score, rank FROM k WHERE rank <= 5"""
)
def term_search_topk(spark, d):
    found = R.term_overlap(W.table(spark, d, "benchmark"), W.table(spark, d, "documents"), "item_id", "doc_id")
    scored = found.select("item_id", "doc_id", R.problem_score(F.col("overlap"), F.col("capped_tf")).cast("double").alias("score"))
    return R.top_k(scored, "item_id", "doc_id", 5).withColumn("rank", F.col("rank").cast("bigint"))


@query(f"SELECT item_id, CAST(len({_TERMS.format('text')}) AS BIGINT) AS terms, CAST(len(list_distinct({_TERMS.format('text')})) AS BIGINT) AS distinct_terms FROM benchmark")
def term_extraction(spark, d):
    t = T.terms("text")
    return W.table(spark, d, "benchmark").select("item_id", F.size(t).cast("bigint").alias("terms"), F.size(F.array_distinct(t)).cast("bigint").alias("distinct_terms"))


@query("SELECT dataset, count(*) AS seen, count(benchmark_resolved) AS valid, count(*) FILTER (WHERE benchmark_resolved) AS resolved, count(*) FILTER (WHERE benchmark_resolved IS NULL) AS blocked, round(100.0::DOUBLE * count(benchmark_resolved) / 500, 6) AS percent FROM v_all GROUP BY 1", "v_samples")
def live_progress(spark, d):
    return monitor.progress(W.samples(spark, d, None), 500)


@query(f"SELECT instance_id, {_OUTCOME} AS category, dataset, sample_index, count(*) OVER () AS n_total FROM v_all WHERE NOT coalesce(benchmark_resolved, lower(verifier_status) = 'resolved') ORDER BY category, dataset, instance_id, sample_index LIMIT 25", "v_samples")
def failures_top(spark, d):
    rows = S.outcome_label(W.samples(spark, d, None)).withColumnRenamed("outcome", "category")
    return S.failures(rows, 25, ["category", "dataset", "instance_id", "sample_index"]).select("instance_id", "category", "dataset", "sample_index", "n_total")


@query("SELECT source, count(DISTINCT lang) AS langs FROM documents GROUP BY 1 HAVING count(DISTINCT lang) > 1")
def disjointness(spark, d):
    """Groups that occur in several parts."""
    return J.in_several(W.table(spark, d, "documents"), "source", "lang", "langs")


@query(
    """, r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY num_tokens, sha256('e:' || CAST(doc_id AS VARCHAR)), CAST(doc_id AS VARCHAR)) - 1 AS r, count(*) OVER (PARTITION BY lang) AS n FROM v_lengths)
SELECT doc_id, lang FROM r WHERE n <= 5 OR r IN (SELECT CAST(round_even(i * (n - 1) / 4.0::DOUBLE, 0) AS BIGINT) FROM range(5) t(i))""",
    "v_lengths",
)
def even_length_sample(spark, d):
    return N.even_lengths(W.lengths(spark, d).withColumn("key", F.col("doc_id").cast("string")), 5, "e", "key", ["lang"]).select("doc_id", "lang")


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) WHERE k <= 3")
def first_n_per_group(spark, d):
    return N.first_per_group(W.table(spark, d, "documents").select("doc_id", "source"), "source", ["doc_id"], 3)


@query("SELECT t.instance_id, CAST(s.i AS BIGINT) AS sample_index FROM (SELECT DISTINCT instance_id FROM v_all) t CROSS JOIN range(8) s(i) WHERE NOT EXISTS (SELECT 1 FROM v_samples v WHERE v.instance_id = t.instance_id AND v.sample_index = s.i AND v.benchmark_resolved IS NOT NULL)", "v_samples")
def pending_work(spark, d):
    s = W.samples(spark, d, None)
    done = s.where("sample_index < 5").withColumn("sample_index", F.col("sample_index").cast("int"))
    return J.pending(8, s.select("instance_id").distinct(), done).select("instance_id", F.col("sample_index").cast("bigint").alias("sample_index"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1")
def last_wins(spark, d):
    return readers.last_wins(W.table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("SELECT instance_id, min(CASE WHEN event_type = 'click' THEN sample_index END) AS image, bool_or(event_type = 'click') AS runnable, count(*) AS attempts FROM v_all GROUP BY 1", "v_samples")
def preflight_first_usable(spark, d):
    c = W.samples(spark, d, None).select(F.col("user_id").alias("task_order"), "instance_id", F.col("sample_index").alias("image"), F.col("sample_index").alias("ord"), (F.col("event_type") == "click").alias("ok"))
    return S.preflight(c).select("instance_id", "image", "runnable", "attempts")


@query("SELECT event_id, dense_rank() OVER (PARTITION BY dataset ORDER BY round, sample_index) AS rollout FROM v_all", "v_samples")
def renumber_rollouts(spark, d):
    return S.renumber_rollouts(W.samples(spark, d, None), "round").select("event_id", F.col("rollout").cast("bigint").alias("rollout"))


@query(
    """SELECT count(*) AS tasks, count(*) FILTER (WHERE a) AS solved_any, count(*) FILTER (WHERE c) AS solved_current, round(count(*) FILTER (WHERE a)::DOUBLE / count(*), 6) AS accuracy FROM (SELECT instance_id, bool_or(coalesce(benchmark_resolved, false)) AS a,
bool_or(coalesce(benchmark_resolved AND round >= 2, false)) AS c FROM v_all GROUP BY 1)""",
    "v_samples",
)
def combined_accuracy(spark, d):
    s = W.samples(spark, d, None)
    return S.combined_accuracy(J.union_all({"legacy": s.where("round < 2"), "current": s.where("round >= 2")}))


@query(
    """, x AS (SELECT event_id, agent_status, CASE WHEN event_type = 'signup' THEN 'blocked_missing_patch' ELSE verifier_status END AS v, CASE WHEN event_type = 'signup' THEN NULL ELSE benchmark_resolved END AS r FROM v_all)
SELECT event_id, CASE WHEN agent_status = 'infrastructure_blocked' THEN NULL WHEN r IS NULL AND v = 'blocked_missing_patch' THEN false ELSE r END AS benchmark_resolved,
CASE WHEN agent_status = 'infrastructure_blocked' THEN false WHEN r IS NULL AND v = 'blocked_missing_patch' THEN true ELSE r IS NOT NULL END AS sample_valid, CASE WHEN r IS NULL AND v = 'blocked_missing_patch' THEN 'model_failure_' || agent_status ELSE v END AS verifier_status FROM x""",
    "v_samples",
)
def classify_samples(spark, d):
    s = W.samples(spark, d, None)
    lost = F.col("event_type") == "signup"
    raw = s.withColumn("verifier_status", F.when(lost, "blocked_missing_patch").otherwise(F.col("verifier_status"))).withColumn("benchmark_resolved", F.when(lost, None).otherwise(F.col("benchmark_resolved")))
    return S.classify_sample(raw).select("event_id", "benchmark_resolved", "sample_valid", "verifier_status")


@query("SELECT CASE WHEN verifier_status = 'resolved' THEN 'resolved' WHEN contains(verifier_status, 'tests_failed') THEN 'tests failed' WHEN contains(verifier_status, 'no_edit') THEN 'no edit' ELSE 'other' END AS bucket, count(*) AS n FROM v_all GROUP BY 1", "v_samples")
def failure_buckets(spark, d):
    return S.histogram(W.samples(spark, d, None), S.failure_bucket("verifier_status"), "bucket")


_TIER = "CASE WHEN user_id % 6 > 3 THEN 'C' WHEN user_id % 4 > 0 OR user_id % 5 = 0 THEN 'B' ELSE 'A' END"


@query(f"SELECT instance_id, tier, CASE tier WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.5 ELSE 0.0 END::DOUBLE AS sample_weight, CASE tier WHEN 'A' THEN 'primary' WHEN 'B' THEN 'optional' ELSE 'quarantine' END AS part FROM (SELECT DISTINCT instance_id, {_TIER} AS tier FROM v_all)", "v_samples")
def delivery_parts(spark, d):
    tasks = W.samples(spark, d, None).select("instance_id", "user_id").distinct()
    tiered = tasks.withColumn("tier", V.quality_tier(F.col("user_id") % 6, F.col("user_id") % 4, F.col("user_id") % 5 == 0))
    return V.deliver(tiered.limit(0).drop("tier"), tiered).select("instance_id", "tier", "sample_weight", "part")


@query("SELECT a.page_id, b.domain FROM (SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS host FROM pages) a JOIN (VALUES ('example.com'), ('www.therti'), ('blog'), ('m')) b(domain) ON a.host = b.domain OR starts_with(a.host, b.domain || '.')")
def prefix_join(spark, d):
    hosts = W.table(spark, d, "pages").select("page_id", F.split(F.split("url", "://")[1], "/")[0].alias("module"))
    known = spark.createDataFrame([("example.com",), ("www.therti",), ("blog",), ("m",)], "candidate string")
    return J.prefix_join(hosts, known).select("page_id", F.col("candidate").alias("domain"))


@query(r"SELECT page_id, regexp_replace(url, '[^A-Za-z0-9_.-]+', '_', 'g') AS safe, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, CASE WHEN length(url) <= 30 THEN url ELSE left(url, 20) || '..' || right(url, 10) END AS clipped FROM pages")
def name_functions(spark, d):
    return W.table(spark, d, "pages").select("page_id", T.safe_name("url").alias("safe"), T.slug("url").alias("slug"), T.clip_middle("url", 30, "..").alias("clipped"))


@query("SELECT CAST(sum(CASE WHEN user_id % 7 <> 0 THEN user_id % 7 ELSE event_id % 11 END) AS BIGINT) AS cached, CAST(sum(user_id) AS BIGINT) AS prompt FROM events")
def usage_totals(spark, d):
    e = W.table(spark, d, "events").select((F.col("user_id") % 7).alias("cached"), (F.col("event_id") % 11).alias("other"), F.col("user_id").alias("prompt"))
    return S.usage_totals(e, ["cached", "prompt"], {"cached": "other"})


@query("SELECT DISTINCT CASE WHEN n > 1 THEN dataset || ' #' || CAST(round AS VARCHAR) ELSE dataset END AS series FROM (SELECT dataset, round, len(list_distinct(list(round) OVER (PARTITION BY dataset))) AS n FROM v_all WHERE dataset <> 'repository' OR round = 1)", "v_samples")
def series_flattening(spark, d):
    s = W.samples(spark, d, None).where("dataset != 'repository' or round = 1").withColumn("run", F.col("dataset"))
    return S.flatten_series(s).select("series").distinct()


@query("SELECT trajectory_id, max(all_skipped::INT)::BIGINT AS reward, round(avg(value), 6) AS mean_value, max_by(value, step) AS final_value, count(*) AS weight FROM v_calls GROUP BY 1", "v_calls")
def trajectory_views(spark, d):
    t = W.calls(spark, d).select("trajectory_id", F.col("all_skipped").cast("bigint").alias("reward"), "value", F.col("step").alias("pos"))
    return E.trajectory_views(t).withColumn("mean_value", F.round("mean_value", 6))


@query("SELECT lang, count(*) AS rows, count(*) FILTER (WHERE quality = 1) AS successes, CAST(sum(num_tokens) AS BIGINT) AS tokens, CAST(sum(num_tokens % 50) AS BIGINT) AS action_tokens FROM v_lengths GROUP BY 1", "v_lengths")
def value_set_summary(spark, d):
    rows = W.lengths(spark, d).select(F.col("lang").alias("dataset_family"), F.col("quality").alias("reward"), "num_tokens", (F.col("num_tokens") % 50).alias("num_action_tokens"))
    return E.value_set_summary(rows).withColumnRenamed("dataset_family", "lang")


@query("SELECT dataset, count(*) AS tasks, count(*) FILTER (WHERE gold) AS gold_passed, count(DISTINCT repo) AS repos, count(*) = CASE dataset WHEN 'repository' THEN 1 ELSE 0 END AND count(*) FILTER (WHERE gold) = count(*) AS ready FROM (SELECT instance_id, dataset, repo, bool_or(coalesce(benchmark_resolved, false)) AS gold FROM v_all GROUP BY 1, 2, 3) GROUP BY 1", "v_samples")
def readiness_counts(spark, d):
    tasks = W.samples(spark, d, None).groupBy("instance_id", "dataset", "repo").agg(F.bool_or(F.coalesce("benchmark_resolved", F.lit(False))).alias("gold_passed"))
    return S.readiness(tasks, {"repository": 1})


@query("SELECT repo, agent_status AS kind, count(*) AS tasks FROM v_all GROUP BY 1, 2", "v_samples")
def repo_kind_audit(spark, d):
    return E.repo_audit(W.samples(spark, d, None).withColumnRenamed("agent_status", "kind"))


@query("SELECT CASE WHEN instance_id LIKE '%5' THEN 'validation' ELSE 'train' END AS split, dataset AS dataset_family, count(DISTINCT repo) AS groups, (SELECT count(*) FROM (SELECT repo FROM v_all GROUP BY repo HAVING count(DISTINCT instance_id LIKE '%5') > 1)) AS overlapping FROM v_all GROUP BY 1, 2", "v_samples")
def split_overlap(spark, d):
    rows = W.samples(spark, d, None).select(F.when(F.col("instance_id").endswith("5"), "validation").otherwise("train").alias("split"), F.col("dataset").alias("dataset_family"), F.col("repo").alias("group_key"))
    return N.overlap_groups(rows)


@query("SELECT 'label not 0 or 1' AS fault, count(*) AS n FROM labels WHERE quality NOT IN (0, 1) UNION ALL SELECT 'no document', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def consistency_faults(spark, d):
    l, docs = W.table(spark, d, "labels"), W.table(spark, d, "documents")
    bad = l.where(~F.col("quality").isin(0, 1)).agg(F.lit("label not 0 or 1").alias("fault"), F.count("*").alias("n"))
    return bad.unionByName(J.drop_known(l, docs, "doc_id").agg(F.lit("no document").alias("fault"), F.count("*").alias("n")))


@query("SELECT p_partkey, CASE WHEN p_name LIKE '%ring%' THEN 'ring' WHEN p_name LIKE '%bolt%' THEN 'bolt' ELSE 'other' END AS dataset FROM part")
def dataset_aliases(spark, d):
    return W.table(spark, d, "part").select("p_partkey", T.normalize_dataset_default("p_name", ["ring", "bolt"], "other").alias("dataset"))


# Queries that SQL does not express; tests hold them against brute force.


def _call_texts(spark, d):
    """Valid and broken calls made of events."""
    c = W.calls(spark, d)
    good = F.to_json(F.struct("tool_name", F.struct(F.when(F.col("tool_name") == "execute_bash", "ls").alias("command")).alias("arguments")))
    broken = F.when(F.col("event_id") % 7 == 0, F.col("props")).when(F.col("event_id") % 11 == 0, F.concat(good, F.lit(" and more"))).otherwise(good)
    return c.select("trajectory_id", "step", broken.alias("content"))


@query()
def tool_call_validate(spark, d):
    return _call_texts(spark, d).select("trajectory_id", "step", C.call_tool("content").alias("tool"), C.call_error("content").alias("category"))


@query()
def schema_errors(spark, d):
    return _call_texts(spark, d).select("trajectory_id", "step", C.schema_reason_a("content").alias("reason"), F.array_join(C.schema_errors_b("content"), ";").alias("errors"))


@query()
def canonical_hashes(spark, d):
    return W.table(spark, d, "events").select("event_id", C.canonical_json_sha256("props").alias("sha256"))


@query()
def group_holdout(spark, d):
    rows = W.lengths(spark, d).where("quality is not null").select("doc_id", F.col("quality").alias("reward"), N.group_key(F.lit("repository"), F.col("source"), F.col("source")).alias("group_key"))
    return N.group_holdout(rows, 0.2, "h", 2)


def _conversations_of_calls(spark, d):
    """Users as conversations: a call and an observation for each step."""
    start = F.array(F.struct(F.lit("system").alias("role"), F.lit("Use tools.").alias("content")), F.struct(F.lit("user").alias("role"), F.lit("Fix it.").alias("content")))
    steps = _call_texts(spark, d).groupBy("trajectory_id").agg(F.array_sort(F.collect_list(F.struct("step", "content"))).alias("s"))
    refused = lambda x: F.when(~F.contains(x["content"], F.lit("tool_name")) | x["content"].endswith("more"), F.lit("[tool_result] parser\nno call")).otherwise(F.lit("[tool_result] ok"))
    turn = lambda x: F.array(F.struct(F.lit("assistant").alias("role"), x["content"].alias("content")), F.struct(F.lit("user").alias("role"), refused(x).alias("content")))
    return steps.select("trajectory_id", F.concat(start, F.flatten(F.transform("s", turn))).alias("messages"))


@query()
def salvage_repair(spark, d):
    return V.salvage(_conversations_of_calls(spark, d)).select("trajectory_id", "status", "invalid_pairs", "protocol_pairs", "message_count", F.array_join("findings", ";").alias("findings"))


@query()
def strict_clean(spark, d):
    s = W.samples(spark, d, None).where("sample_index = 0").withColumn("trajectory_key", F.col("user_id").cast("string"))
    c = _conversations_of_calls(spark, d).withColumnRenamed("trajectory_id", "trajectory_key")
    rows = s.join(c, "trajectory_key").withColumns({"exclude_from_training": F.lit(False), "data_role": F.lit("train"), "path_order": F.split("instance_id", "_")})
    return V.strict_clean(rows).select("trajectory_id", "route", "reason", "kept_id", "reward")


@query()
def window_pack(spark, d):
    return M.window_records(_conversations_of_calls(spark, d), most=4096, overlap=2).select("trajectory_id", "window_index", "window_count", "token_count", "supervised_token_count", "error")


@query()
def mask_labels(spark, d):
    records = M.audit_windows(M.window_records(_conversations_of_calls(spark, d), most=4096)).withColumn("record_faults", M.record_faults())
    return records.select("trajectory_id", "window_index", F.array_join("faults", ";").alias("faults"), F.array_join("record_faults", ";").alias("record_faults"))


@query()
def context_compact(spark, d):
    return M.compact_conversations(W.conversations(spark, d), 400).select("trajectory_id", "compacted", "tokens", F.size("messages").alias("messages"), "error")


@query()
def update_plan(spark, d):
    rows = W.lengths(spark, d).select(F.col("doc_id").alias("row_id"), "num_tokens")
    return L.update_plan(rows, [256, 512, 1024, 4096], [8, 4, 2, 1], 8, "u")


@query()
def dialect_parse(spark, d):
    c = _call_texts(spark, d)
    return c.select("trajectory_id", "step", D.parse_first_call("content").alias("call")).select("trajectory_id", "step", "call.tool_name", "call.dialect")


@query()
def snippet_lines(spark, d):
    files = W.table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("path"), "text")
    return R.snippets(files, ["the"], 1, 1)


from . import more  # noqa: E402, F401  further queries, registered here
