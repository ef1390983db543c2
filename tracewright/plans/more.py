"""Queries of scalar functions, sources, sinks, joins and splits, with the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import toolcalls as C
from ..operators import joins as J
from ..operators import lengths as L
from ..operators import metrics as E
from ..operators import samples as S
from ..operators import sampling as N
from ..session import scratch
from ..sources import readers, writers
from . import views as W
from .catalog import query

# --- scalar functions


@query(r"SELECT doc_id, regexp_replace('/Users/' || source || '/x:' || CAST(doc_id AS VARCHAR), '/Users/[^\s:''\"]+', '<user-path>', 'g') AS clean FROM documents")
def redact_user_paths(spark, d):
    path = F.concat(F.lit("/Users/"), "source", F.lit("/x:"), F.col("doc_id").cast("string"))
    return W.table(spark, d, "documents").select("doc_id", T.redact_paths(path).alias("clean"))


_PATCH = "'diff --git a/' || p_brand || '.py b/' || p_brand || '.py' || chr(10) || '--- a/x' || chr(10) || '+++ b/x' || chr(10) || '+' || p_name || chr(10) || '-' || p_type || chr(10) || ' same' || chr(10)"


def _patches(spark, d):
    n = F.lit("\n")
    patch = F.concat(F.lit("diff --git a/"), "p_brand", F.lit(".py b/"), "p_brand", F.lit(".py\n--- a/x\n+++ b/x\n+"), "p_name", n, F.lit("-"), "p_type", F.lit("\n same\n"))
    return W.table(spark, d, "part").withColumn("patch", patch)


@query(
    f"""WITH p AS (SELECT p_partkey, {_PATCH} AS patch FROM part), l AS (SELECT *, string_split(patch, chr(10)) AS ls FROM p)
SELECT p_partkey, CAST(len(list_filter(ls, lambda x: starts_with(x, 'diff --git '))) AS BIGINT) AS files, CAST(len(list_filter(ls, lambda x: (starts_with(x, '+') AND NOT starts_with(x, '+++')) OR (starts_with(x, '-') AND NOT starts_with(x, '---')))) AS BIGINT) AS changed,
regexp_extract(patch, 'diff --git \\S+ b/(\\S+)', 1) AS names, sha256('reverse' || chr(0) || patch) AS reverse_sha256 FROM l""".replace("\\\\", "\\")
)
def patch_functions(spark, d):
    return _patches(spark, d).select("p_partkey", T.patch_file_count("patch").alias("files"), T.patch_changed_lines("patch").alias("changed"), F.array_join(T.patch_files("patch"), ",").alias("names"), T.reverse_patch_sha256("patch").alias("reverse_sha256"))


@query("SELECT p_partkey, 'kind_' || p_brand AS kind, 'o' || CAST(p_size AS VARCHAR) AS owner, 'r' || CAST(p_partkey AS VARCHAR) AS repo, 'abc123' AS commit, 'o' || CAST(p_size AS VARCHAR) || '/r' || CAST(p_partkey AS VARCHAR) AS slug FROM part")
def task_names(spark, d):
    """Mutation kinds and repository profiles of task names."""
    name = F.concat(F.lit("x/o"), F.col("p_size").cast("string"), F.lit("__r"), F.col("p_partkey").cast("string"), F.lit(".abc123"))
    task = F.concat(name, F.lit(".kind_"), "p_brand", F.lit("__7"))
    return W.table(spark, d, "part").select("p_partkey", T.mutation_kind(task).alias("kind"), T.repo_profile(name)["owner"].alias("owner"), T.repo_profile(name)["repo"].alias("repo"), T.repo_profile(name)["commit"].alias("commit"), T.github_slug(name).alias("slug"))


_PATHS = ["src/app.py", "tests/util.py", "pkg/test_a.py", "README.md", "conf/a.yaml", "lib/pkg/__init__.py", "web/main.ts", "run.sh"]


@query(
    f"""WITH p AS (SELECT page_id, ([{", ".join(f"'{p}'" for p in _PATHS)}])[1 + page_id % 8] AS path FROM pages)
SELECT page_id, CASE WHEN regexp_matches(path, '(^|/)tests?/|(^|/)test_[^/]*$') THEN 'test' WHEN regexp_matches(path, '\\.(md|rst|txt)$') THEN 'docs' WHEN regexp_matches(path, '\\.(ya?ml|json|toml)$') THEN 'config' ELSE 'source' END AS role,
CASE regexp_extract(path, '\\.([a-z]+)$', 1) WHEN 'py' THEN 'python' WHEN 'md' THEN 'markdown' WHEN 'ts' THEN 'typescript' WHEN 'sh' THEN 'shell' ELSE 'other' END AS language,
replace(regexp_replace(regexp_replace(regexp_replace(path, '\\.py$', ''), '(^|/)__init__$', ''), '^(src|lib)/', ''), '/', '.') AS module FROM p"""
)
def file_facts(spark, d):
    path = F.element_at(F.lit(_PATHS), (F.col("page_id") % 8 + 1).cast("int"))
    return W.table(spark, d, "pages").select("page_id", T.file_role(path).alias("role"), T.file_language(path).alias("language"), T.module_name(path).alias("module"))


@query("SELECT item_id, array_to_string(list_filter(['and', 'the', 'was'], lambda w: contains(lower(text), w)), ',') AS tags FROM benchmark")
def tag_inference(spark, d):
    return W.table(spark, d, "benchmark").select("item_id", F.array_join(T.problem_tags("text", {"the": ["the"], "was": ["was"], "and": ["and"]}), ",").alias("tags"))


@query(
    """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'a' || CAST(page_id AS VARCHAR) || '.py' WHEN 1 THEN 'b/c.md' ELSE '' END AS files_read,
CASE page_id % 4 WHEN 1 THEN 'b/c.md' WHEN 2 THEN 'x.json' ELSE '' END AS files_changed FROM pages"""
)
def command_hints(spark, d):
    c = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("cat a"), F.col("page_id").cast("string"), F.lit(".py"))).when(F.col("page_id") % 4 == 1, "grep x b/c.md > out").when(F.col("page_id") % 4 == 2, "rm x.json").otherwise("ls")
    return W.table(spark, d, "pages").select("page_id", F.array_join(T.files_read(c), ",").alias("files_read"), F.array_join(T.files_changed(c), ",").alias("files_changed"))


_QUOTED = "CASE WHEN regexp_full_match({0}, '[A-Za-z0-9_@%+=:,./-]+') THEN {0} ELSE '''' || replace({0}, '''', '''\"''\"''') || '''' END"


@query(f"SELECT p_partkey, 'python -m pytest -q ' || {_QUOTED.format('p_name')} || ' ' || {_QUOTED.format('p_brand')} AS command FROM part")
def test_commands(spark, d):
    return W.table(spark, d, "part").select("p_partkey", T.test_command(F.array("p_name", "p_brand")).alias("command"))


@query("SELECT event_id, '[tool_result] ' || event_type || CASE WHEN user_id % 2 = 0 THEN ' exit_code=' || CAST(user_id % 5 AS VARCHAR) ELSE '' END || chr(10) || coalesce(props, '') AS shown, event_type AS tool, CASE WHEN user_id % 2 = 0 THEN user_id % 5 END AS code FROM events")
def observations(spark, d):
    shown = T.observation("event_type", "props", F.when(F.col("user_id") % 2 == 0, F.col("user_id") % 5))
    return W.table(spark, d, "events").select("event_id", shown.alias("shown")).select("event_id", "shown", T.observation_tool("shown").alias("tool"), T.exit_code("shown").alias("code"))


@query("SELECT p_partkey, CASE WHEN p_brand = p_type THEN p_brand ELSE p_brand || '|' || p_type END AS head, '0001: ' || p_name || chr(10) || '0002: ' || p_type AS numbered FROM part")
def heads_and_numbers(spark, d):
    values = F.array(F.col("p_brand"), F.lit(""), F.lit(None), F.col("p_brand"), F.col("p_type"), F.col("p_name"))
    return W.table(spark, d, "part").select("p_partkey", F.array_join(T.ordered_head(values, 2), "|").alias("head"), T.numbered(F.concat("p_name", F.lit("\n"), "p_type", F.lit("\n"))).alias("numbered"))


@query("SELECT l_orderkey, l_linenumber, CAST(greatest(2000, floor(12000 / pow(2, greatest(0, l_linenumber - 1)))) AS BIGINT) AS retry, greatest(1, CAST(l_partkey - l_suppkey AS BIGINT)) AS budget FROM lineitem")
def budgets(spark, d):
    return W.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", T.retry_budget("l_linenumber").alias("retry"), T.input_budget("l_partkey", "l_suppkey").alias("budget"))


@query("SELECT p_partkey, 'diff --git a/' || p_brand || ' b/' || p_brand || chr(10) || 'new file mode 100644' || chr(10) || '--- /dev/null' || chr(10) || '+++ b/' || p_brand || chr(10) || '@@ -0,0 +1,2 @@' || chr(10) || '+' || p_name || chr(10) || '+' || p_type || chr(10) AS patch FROM part")
def new_file_patches(spark, d):
    return W.table(spark, d, "part").select("p_partkey", T.new_file_patch("p_brand", F.concat("p_name", F.lit("\n"), "p_type", F.lit("\n"))).alias("patch"))


@query("SELECT event_id, user_id % 4 AS passed, event_id % 3 AS failed, user_id % 2 AS skipped, user_id % 2 > 0 AND user_id % 4 + event_id % 3 = 0 AS all_skipped FROM events")
def test_output_counts(spark, d):
    part = lambda c, word: F.concat((c).cast("string"), F.lit(f" {word}, "))
    out = F.concat(F.lit("9 passed, then "), part(F.col("user_id") % 4, "passed"), part(F.col("event_id") % 3, "failed"), part(F.col("user_id") % 2, "skipped"))
    t = T.test_counts("out")
    return W.table(spark, d, "events").select("event_id", out.alias("out")).select("event_id", t["passed"].alias("passed"), t["failed"].alias("failed"), t["skipped"].alias("skipped"), T.all_skipped("out").alias("all_skipped"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang ELSE source END AS first, CASE WHEN doc_id % 3 = 0 THEN 'none' ELSE lang END AS filled FROM documents")
def blanks(spark, d):
    gap = F.when(F.col("doc_id") % 3 == 0, "  ").otherwise(F.col("source"))
    return W.table(spark, d, "documents").select("doc_id", T.first_non_blank(gap, "lang").alias("first"), T.or_default(F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang")), "none").alias("filled"))


@query("SELECT page_id, left('### ' || url || chr(10) || CAST(page_id AS VARCHAR) || chr(10) || chr(10) || '### b' || chr(10) || url, 60) AS excerpt FROM pages")
def excerpts(spark, d):
    return W.table(spark, d, "pages").select("page_id", T.excerpt(F.array(F.col("url"), F.lit("b")), F.array(F.col("page_id").cast("string"), F.col("url")), 60).alias("excerpt"))


@query("SELECT p_partkey, CASE WHEN length(p_name) <= 8 THEN p_name ELSE left(p_name, 8) || '...' END AS head, right(p_name, 5) AS tail, regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g') AS cache_key, 'registry/eval.' || replace(lower(p_brand || '__' || p_type), '__', '_s_') AS image FROM part")
def clips_and_names(spark, d):
    return W.table(spark, d, "part").select("p_partkey", T.clip_head("p_name", 8, "...").alias("head"), T.clip_tail("p_name", 5).alias("tail"), T.cache_key("p_type").alias("cache_key"), T.image_name(F.concat("p_brand", F.lit("__"), "p_type")).alias("image"))


@query("SELECT event_id, 'd' || CAST(user_id % 3 AS VARCHAR) || ':t' || CAST(user_id AS VARCHAR) || ':sample_' || lpad(CAST(event_id % 7 AS VARCHAR), 2, '0') AS id FROM events")
def trajectory_ids(spark, d):
    return W.table(spark, d, "events").select("event_id", T.trajectory_id(F.concat(F.lit("d"), (F.col("user_id") % 3).cast("string")), F.concat(F.lit("t"), F.col("user_id").cast("string")), F.col("event_id") % 7).alias("id"))


# --- decisions over samples


@query(
    """SELECT event_id, coalesce(benchmark_resolved, true) AND coalesce(agent_status NOT IN ('context_overflow','model_api_failure','parse_error','infrastructure_blocked','runner_error'), true) AS export, sample_valid AND benchmark_resolved IS NOT NULL AS valid,
CASE user_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'evaluation_only' END AS data_role, user_id % 3 <> 0 AS excluded FROM v_all""",
    "v_samples",
)
def sample_decisions(spark, d):
    s = W.samples(spark, d, None)
    split = F.when(F.col("user_id") % 3 == 0, "train").when(F.col("user_id") % 3 == 1, "validation").otherwise("test")
    return s.select("event_id", S.export_resolved(F.col("benchmark_resolved"), F.col("agent_status")).alias("export"), S.valid_sample(s).alias("valid"), S.split_policy(split)["data_role"].alias("data_role"), S.split_policy(split)["exclude_from_training"].alias("excluded"))


@query("SELECT event_id, CASE WHEN user_id % 2 = 0 THEN CASE WHEN event_type = 'view' THEN 'blocked_image_pull_failed' ELSE 'blocked_docker_run_failed' END END AS status FROM events")
def infrastructure_statuses(spark, d):
    output = F.when(F.col("event_type") == "view", "Manifest Unknown: x").otherwise("failed")
    return W.table(spark, d, "events").select("event_id", S.infrastructure_failure(F.when(F.col("user_id") % 2 == 0, 125).otherwise(1), output).alias("status"))


@query("SELECT event_id, dataset FROM v_all WHERE dataset IN ('function_a', 'function_b') AND round = 1 AND instance_id IN (SELECT 'task_' || CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 2 = 0)", "v_samples")
def selected_rows(spark, d):
    ids = W.table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("task_"), F.col("c_custkey").cast("string")).alias("instance_id"))
    rows = W.samples(spark, d, None).withColumn("split", F.col("round").cast("string"))
    return S.select_rows(rows, ["1"], ["function"], ids, {"function": ["function_a", "function_b"]}).select("event_id", "dataset")


@query("SELECT count(*) AS suites, count(*) FILTER (WHERE event_type <> 'error') AS passed, count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) FILTER (WHERE event_type <> 'error')::DOUBLE / count(*) AS pass_rate FROM events")
def suite_totals(spark, d):
    return S.suite_report(W.table(spark, d, "events").select((F.col("event_type") != "error").alias("passed")))


@query("SELECT event_id, user_id % 2 = 0 AND event_id % 3 > 0 AND event_id % 5 > 0 AS resolved FROM events")
def trace_verdicts(spark, d):
    tests = lambda n: F.array(F.struct(F.lit(True).alias("passed")), F.struct((F.col("event_id") % n > 0).alias("passed")))
    return W.table(spark, d, "events").select("event_id", S.trace_verdict(F.col("user_id") % 2, tests(3), tests(5)).alias("resolved"))


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2 UNION ALL SELECT source, 'any', count(*) FROM documents GROUP BY 1")
def multi_valued_counts(spark, d):
    rows = W.table(spark, d, "documents").select("source", F.array("lang", F.lit("any")).alias("flags"))
    return rows.select("source", F.explode("flags").alias("lang")).groupBy("source", "lang").agg(F.count("*").alias("n"))


@query("SELECT lang AS dataset_family, quality AS reward, count(*) AS n FROM v_lengths GROUP BY 1, 2", "v_lengths")
def selection_cell_counts(spark, d):
    rows = W.lengths(spark, d).select(F.col("lang").alias("dataset_family"), F.col("quality").alias("reward"), F.col("doc_id").alias("instance_id"))
    return E.selection_cells(rows).select("dataset_family", "reward", "n")


@query("SELECT count(*) AS traces, count(*) FILTER (WHERE o_orderstatus = 'F') AS parsed, count(*) FILTER (WHERE o_custkey % 3 = 0) AS hits, round(count(*) FILTER (WHERE o_custkey % 3 = 0)::DOUBLE / count(*), 4) AS hit_rate, min(o_totalprice) AS least_latency, max(o_totalprice) AS most_latency, round(avg(o_totalprice), 4) AS mean_latency FROM orders")
def trace_audit_summary(spark, d):
    t = W.table(spark, d, "orders").select((F.col("o_orderstatus") == "F").alias("parse_ok"), F.array(F.lit("0")).alias("gold_files"), F.array((F.col("o_custkey") % 3).cast("string")).alias("predicted_files"), F.col("o_totalprice").alias("latency"))
    return E.trace_audit(t).drop("median_latency").withColumn("mean_latency", F.round("mean_latency", 4))


# --- joins and sets


@query("SELECT o_orderkey, c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) ON o_custkey = c_custkey")
def enriched_orders(spark, d):
    known = W.table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return J.enrich(W.table(spark, d, "orders").select("o_orderkey", "o_custkey"), known, "o_custkey").select("o_orderkey", "c_name")


@query("SELECT o_orderkey, 'hit' AS side FROM orders WHERE o_custkey % 2 = 0 AND o_custkey IN (SELECT c_custkey FROM customer) UNION ALL SELECT o_orderkey, 'miss' FROM orders WHERE NOT (o_custkey % 2 = 0 AND o_custkey IN (SELECT c_custkey FROM customer))")
def joined_with_misses(spark, d):
    known = W.table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    hits, misses = J.join_with_misses(W.table(spark, d, "orders").select("o_orderkey", "o_custkey"), known, "o_custkey")
    return hits.select("o_orderkey", F.lit("hit").alias("side")).unionByName(misses.select("o_orderkey", F.lit("miss").alias("side")))


@query("SELECT DISTINCT 'task_' || CAST(user_id AS VARCHAR) AS instance_id, CASE WHEN user_id % 5 = 0 THEN 'validation' ELSE 'train' END AS split FROM events")
def split_catalog(spark, d):
    rows = W.table(spark, d, "events").select(F.concat(F.lit("task_"), F.col("user_id").cast("string")).alias("instance_id"), F.when(F.col("user_id") % 5 == 0, "validation").otherwise("train").alias("split"))
    return J.split_catalog(rows)


@query("SELECT d.doc_id, quality, b.item_id IS NOT NULL AS has_item FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN benchmark b ON b.item_id = d.doc_id")
def three_way_join(spark, d):
    items = W.table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit(True).alias("hit"))
    return J.three_way(W.table(spark, d, "documents").select("doc_id"), W.table(spark, d, "labels").select("doc_id", "quality"), items, "doc_id").select("doc_id", "quality", F.coalesce("hit", F.lit(False)).alias("has_item"))


@query(", n AS (SELECT count(DISTINCT instance_id) AS n FROM v_all WHERE tool_steps > 60) SELECT round, count(DISTINCT instance_id) AS tasks FROM v_all, n WHERE tool_steps > 60 GROUP BY round, n HAVING count(DISTINCT instance_id) <> n", "v_samples")
def incomplete_runs(spark, d):
    return J.same_tasks(W.samples(spark, d, None).where("tool_steps > 60"), "round")


@query("SELECT p_partkey, p_size % 4 IN (0, 1) AS hit FROM part")
def files_found(spark, d):
    named = lambda c: F.concat(F.lit("f"), c.cast("string"))
    return W.table(spark, d, "part").select("p_partkey", J.files_hit(F.array(F.lit("f0"), F.lit("f1")), F.array(named(F.col("p_size") % 4), F.lit("other"))).alias("hit"))


@query("SELECT s.doc_id FROM documents s LEFT JOIN labels l USING (doc_id) WHERE (CASE WHEN s.doc_id % 4 = 0 THEN 1.0 ELSE 0.0 END) IS DISTINCT FROM CAST(l.quality AS DOUBLE)")
def inconsistent_rewards(spark, d):
    summaries = W.table(spark, d, "documents").select(F.col("doc_id").alias("instance_id"), F.when(F.col("doc_id") % 4 == 0, 1.0).otherwise(0.0).alias("reward"))
    verifier = W.table(spark, d, "labels").select(F.col("doc_id").alias("instance_id"), F.col("quality").alias("benchmark_resolved"))
    return J.consistent(summaries, verifier).select(F.col("instance_id").alias("doc_id"))


# --- splits and sampling


@query(
    """, k AS (SELECT doc_id, lang, CAST(doc_id AS VARCHAR) AS key FROM v_lengths WHERE doc_id % 7 <> 0), r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('t:' || key), key) AS r FROM k WHERE lang IN ('en', 'fr'))
SELECT doc_id, CASE WHEN r <= 5 THEN 'validation' ELSE 'train' END AS split FROM r WHERE r <= 15 UNION ALL SELECT doc_id, 'evaluation' FROM v_lengths WHERE doc_id % 7 = 0""",
    "v_lengths",
)
def three_way_splits(spark, d):
    rows = W.lengths(spark, d).select("doc_id", F.col("lang").alias("dataset"), F.col("doc_id").cast("string").alias("instance_id"))
    return N.three_way_split(rows.where("doc_id % 7 != 0"), rows.where("doc_id % 7 = 0"), {"en": (5, 10), "fr": (5, 10)}, "t").select("doc_id", "split")


@query("SELECT doc_id, CASE WHEN source IN ('src1', 'src2') THEN 'validation' ELSE 'train' END AS split FROM documents")
def reused_holdout(spark, d):
    docs = W.table(spark, d, "documents").select("doc_id", F.col("source").alias("group_key"))
    return N.reuse_holdout(docs, docs.where(F.col("group_key").isin("src1", "src2"))).select("doc_id", "split")


@query("SELECT doc_id, num_tokens FROM v_lengths WHERE num_tokens <= 500", "v_lengths")
def within_length(spark, d):
    return N.over_length(W.lengths(spark, d), 500).select("doc_id", "num_tokens")


@query("SELECT doc_id, num_tokens FROM v_lengths WHERE num_tokens > 512 AND num_tokens <= 1024 ORDER BY num_tokens, doc_id LIMIT 7", "v_lengths")
def shortest_of_bucket(spark, d):
    rows = W.lengths(spark, d).withColumn("bucket", T.length_bucket("num_tokens", [512, 1024]))
    return L.longest(rows, 7, key="doc_id", bucket="<=1024", shortest=True).select("doc_id", "num_tokens")


# --- sinks and sources: what was written is read back


@query("SELECT event_id, user_id, event_type, value, props FROM events")
def jsonl_round_trip(spark, d):
    path = scratch(spark, "jsonl")
    writers.write_jsonl(W.table(spark, d, "events").select("event_id", "user_id", "event_type", "value", "props"), path)
    return readers.require_rows(readers.read_jsonl(spark, path, "event_id long, user_id long, event_type string, value double, props string"))


@query("SELECT region.*, 2::BIGINT AS copies FROM region")
def append_sink(spark, d):
    path, rows = scratch(spark, "append"), W.table(spark, d, "region")
    writers.append_jsonl(rows, path)
    writers.append_jsonl(rows, path)
    return readers.read_jsonl(spark, path, "r_regionkey int, r_name string").groupBy("r_regionkey", "r_name").agg(F.count("*").alias("copies"))


@query("SELECT n_nationkey FROM nation WHERE n_nationkey % 2 = 0")
def permissive_scan(spark, d):
    """Half of the lines are no JSON and are dropped."""
    path = scratch(spark, "lines")
    rows = W.table(spark, d, "nation").select(F.when(F.col("n_nationkey") % 2 == 0, F.to_json(F.struct("n_nationkey"))).otherwise("{broken").alias("value"))
    rows.write.option("compression", "gzip").text(path)
    return readers.read_jsonl(spark, path, "n_nationkey int", permissive=True)


@query("SELECT n_nationkey FROM nation WHERE n_nationkey % 2 = 1")
def replaced_parquet(spark, d):
    path, rows = scratch(spark, "replace"), W.table(spark, d, "nation").select("n_nationkey")
    writers.replace_parquet(rows, path)
    writers.replace_parquet(rows.where("n_nationkey % 2 = 1"), path)
    return readers.read_parquet(spark, [path])


@query("SELECT doc_id, lang AS route FROM documents")
def routed_outputs(spark, d):
    path = scratch(spark, "routes")
    writers.write_routes(W.table(spark, d, "documents").select("doc_id", F.col("lang").alias("route")), path)
    return readers.read_parquet(spark, [path])


@query("SELECT 'row ' || CAST(r_regionkey AS VARCHAR) AS name, r_regionkey FROM region")
def document_scan(spark, d):
    """One JSON object a file, found by a glob."""
    path = scratch(spark, "documents")
    W.table(spark, d, "region").select(F.concat(F.lit("row "), F.col("r_regionkey").cast("string")).alias("name"), "r_regionkey").repartition(5, "r_regionkey").write.option("maxRecordsPerFile", 1).json(path)
    return readers.read_tree(spark, f"{path}/*.json", "name string, r_regionkey int").select("name", "r_regionkey")


@query("SELECT r_regionkey, r_name FROM region")
def single_row_files(spark, d):
    path = scratch(spark, "single")
    W.table(spark, d, "region").repartition(5, "r_regionkey").write.option("maxRecordsPerFile", 1).json(path)
    return readers.single_rows(spark, path, "r_regionkey int, r_name string").select("r_regionkey", "r_name")


@query("SELECT r_regionkey, r_name FROM region")
def server_page(spark, d):
    path = scratch(spark, "page")
    rows = F.array_agg(F.struct(F.struct("r_regionkey", "r_name").alias("row"))).alias("rows")
    W.table(spark, d, "region").agg(rows).coalesce(1).write.json(path)
    return readers.read_server_page(spark, path, "r_regionkey:int,r_name:string")


@query("SELECT c_custkey, c_name FROM customer")
def unique_keys(spark, d):
    return readers.reject_duplicates(W.table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey")


@query("SELECT count(*) AS lines, 3::BIGINT AS most FROM (SELECT 1 FROM nation WHERE n_regionkey = 0 ORDER BY 1 LIMIT 3)")
def capped_lines(spark, d):
    path = scratch(spark, "capped")
    W.table(spark, d, "nation").where("n_regionkey = 0").select("n_name").coalesce(1).write.text(path)
    return readers.first_rows_per_file(spark, path, 3).agg(F.count("*").alias("lines"), F.max("line").cast("bigint").alias("most"))


@query("SELECT 'metric_' || event_type AS name, arg_max(value, event_id) AS value FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def gauge_scan(spark, d):
    line = F.concat(F.lit("metric_"), "event_type", F.lit('{model="x"} '), F.col("value").cast("string"))
    return readers.parse_gauges(W.table(spark, d, "events").select(line.alias("value"), F.col("event_id").alias("at")), ["metric_click", "metric_view"])


@query("SELECT CAST(p_size AS DOUBLE) AS used, p_retailprice AS total, 50.0::DOUBLE AS utilisation FROM part")
def gpu_lines(spark, d):
    line = F.concat_ws(", ", F.col("p_size").cast("string"), F.col("p_retailprice").cast("string"), F.lit("50"))
    return readers.parse_gpu_line(W.table(spark, d, "part").select(line.alias("value")))


@query("SELECT p_partkey, '[\"' || p_brand || '\", ' || CAST(p_size AS VARCHAR) || ', null]' AS parsed FROM part")
def literal_columns(spark, d):
    text = F.concat(F.lit("('"), "p_brand", F.lit("', "), F.col("p_size").cast("string"), F.lit(", None)"))
    return W.table(spark, d, "part").select("p_partkey", C.literal_json(text).alias("parsed"))


@query("SELECT doc_id, num_tokens % 5 AS num_tokens, CAST(list_sum(list_transform(range(num_tokens % 5), lambda i: doc_id + i)) AS BIGINT) AS total FROM v_lengths WHERE num_tokens % 5 > 0", "v_lengths")
def ragged_store(spark, d):
    """Ids concatenated into blocks and cut out again by offset."""
    rows = W.lengths(spark, d).select("doc_id", (F.col("num_tokens") % 5).alias("num_tokens")).where("num_tokens > 0")
    rows = L.running_offset(rows, "doc_id").select("doc_id", "num_tokens", "offset", F.col("doc_id").alias("record_index"), F.transform(F.sequence(F.lit(0), (F.col("num_tokens") - 1).cast("int")), lambda i: F.col("doc_id") + i).alias("input_ids"))
    back = readers.ragged_slices(rows.drop("input_ids"), writers.concatenated(rows, per_block=100), 100)
    return back.select("doc_id", "num_tokens", F.aggregate("input_ids", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS path, 'changed' AS state FROM customer WHERE c_custkey % 10 = 1 UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'missing' FROM customer WHERE c_custkey % 10 = 2")
def copy_faults(spark, d):
    m = W.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("path"), F.sha2("c_name", 256).alias("sha256"), "c_custkey")
    copy = m.where("c_custkey % 10 != 2").withColumn("sha256", F.when(F.col("c_custkey") % 10 == 1, "x").otherwise(F.col("sha256")))
    return writers.verify_copy(m, copy)


@query("SELECT sha256(r_name) || '  ' || CAST(r_regionkey AS VARCHAR) AS line FROM region")
def checksum_file(spark, d):
    return writers.checksum_lines(W.table(spark, d, "region").select(F.col("r_regionkey").cast("string").alias("path"), F.sha2("r_name", 256).alias("sha256")))


@query("SELECT '| r_regionkey | r_name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || CAST(r_regionkey AS VARCHAR) || ' | ' || r_name || ' |', chr(10) ORDER BY r_regionkey) AS markdown FROM region")
def markdown_report(spark, d):
    return writers.markdown_table(W.table(spark, d, "region"), ["r_regionkey", "r_name"], "r_regionkey")


@query("SELECT CAST(r_regionkey AS VARCHAR) AS r_regionkey, r_name FROM region")
def csv_sink(spark, d):
    path = scratch(spark, "csv")
    writers.write_csv(W.table(spark, d, "region"), path)
    return spark.read.option("header", True).csv(path)


@query("SELECT count(*) AS rows, max(c_custkey) AS most FROM customer")
def manifest_sink(spark, d):
    path = scratch(spark, "manifest")
    writers.write_manifest(W.table(spark, d, "customer").agg(F.count("*").alias("rows"), F.max("c_custkey").alias("most")), path)
    return readers.read_document(spark, path, "rows long, most long")


@query("SELECT trajectory_id, count(*) AS messages FROM v_messages GROUP BY 1", "v_messages")
def messages_sink(spark, d):
    path = scratch(spark, "messages")
    c = W.conversations(spark, d)
    writers.write_messages(c.select("trajectory_id", F.transform("messages", lambda m: F.struct(m["role"].alias("role"), c["trajectory_id"].alias("content"))).alias("messages")), path)
    return readers.read_parquet(spark, [path]).select(F.col("messages")[0]["content"].alias("trajectory_id"), F.size("messages").cast("bigint").alias("messages"))


