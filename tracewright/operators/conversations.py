"""Conversations: message rows and arrays, cleaning, repair, audit, delivery, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_any, first_non_blank, observation_tool, redact_secrets, sanitize_paths, trajectory_id
from ..functions.toolcalls import REJECTIONS, call_error, call_tool, schema_errors_b
from .samples import exclusion_reason

PARSER_REJECTION = "[tool_result] parser"
GATE_REJECTION = "Completion gate rejected finish"
FINISH = '{"tool_name":"finish","arguments":{}}'


def _order():
    return Window.partitionBy("trajectory_id").orderBy("pos")


def _after_next():
    return _order().rowsBetween(2, Window.unboundedFollowing)


def explode_messages(df: DataFrame, *keep: str) -> DataFrame:
    return df.select("trajectory_id", *keep, F.posexplode("messages").alias("pos", "m")).select("trajectory_id", *keep, "pos", "m.role", "m.content")


def collect_messages(rows: DataFrame, *keys: str) -> DataFrame:
    """Messages by position again; a conversation is a bounded group."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "role", "content")))
    return rows.groupBy("trajectory_id", *keys).agg(F.transform(ordered, lambda m: F.struct(m["role"], m["content"])).alias("messages"))


def well_formed(messages: Column | str, any_role: bool = False) -> Column:
    """A non-empty list of known roles with text."""
    m = F.col(messages) if isinstance(messages, str) else messages
    role = lambda x: x["role"].isNotNull() if any_role else x["role"].isin("system", "user", "assistant")
    return F.coalesce((F.size(m) > 0) & F.forall(m, lambda x: F.coalesce(role(x), F.lit(False)) & x["content"].isNotNull()), F.lit(False))


def sanitize(rows: DataFrame, replacements: list[tuple[Column | str, str]] = ()) -> DataFrame:
    """Message rows with paths and secrets replaced, and the number of secrets in each."""
    text, n = redact_secrets(sanitize_paths("content", list(replacements)))
    return rows.withColumn("redactions", n).withColumn("content", text)


def with_calls(rows: DataFrame) -> DataFrame:
    """``tool`` of assistant rows, null where the text is no valid call."""
    return rows.withColumn("tool", F.when(F.col("role") == "assistant", call_tool("content")))


def truncate_after_finish(rows: DataFrame) -> DataFrame:
    """Nothing after the last finish stays; conversations without one stay whole."""
    last = F.max(F.when(F.col("tool") == "finish", F.col("pos"))).over(Window.partitionBy("trajectory_id"))
    return rows.withColumn("_last", last).where("_last is null or pos <= _last").drop("_last")


def append_finish(rows: DataFrame, resolved: str = "resolved") -> DataFrame:
    """A closing finish for resolved conversations that end without one."""
    end = rows.groupBy("trajectory_id").agg(F.max("pos").alias("pos"), F.max_by("tool", "pos").alias("tool"), F.bool_or(F.coalesce(resolved, F.lit(False))).alias(resolved))
    extra = end.where((F.coalesce("tool", F.lit("")) != "finish") & F.col(resolved)).select("trajectory_id", (F.col("pos") + 1).alias("pos"), F.lit("assistant").alias("role"), F.lit(FINISH).alias("content"), F.lit("finish").alias("tool"), resolved)
    return rows.unionByName(extra, allowMissingColumns=True)


def neighbours(rows: DataFrame) -> DataFrame:
    """Each message with its successor's role and text."""
    return rows.withColumns({"next_role": F.lead("role").over(_order()), "next_content": F.lead("content").over(_order())})


def any_later_assistant(rows: DataFrame) -> DataFrame:
    return rows.withColumn("later_assistant", F.coalesce(F.max(F.col("role") == "assistant").over(_after_next()), F.lit(False)))


def next_valid_call(rows: DataFrame) -> DataFrame:
    """Position and tool of the first valid call from two messages on."""
    at = F.min(F.when(F.col("tool").isNotNull(), F.struct("pos", "tool"))).over(_after_next())
    return rows.withColumn("recovery_pos", at["pos"]).withColumn("recovery_tool", at["tool"])


def repair_marks(rows: DataFrame) -> DataFrame:
    """What repair does with each message of ``rows(trajectory_id, pos, role, content)``.

    ``action``: drop an invalid call with the parser's refusal after it; a finish with the
    gate's refusal, if an assistant goes on later; a call against its schema with an explicit
    refusal. An invalid call without a refusal is for manual review. ``drop`` marks both
    messages of a pair.
    """
    r = any_later_assistant(next_valid_call(neighbours(with_calls(rows))))
    refused = (F.col("next_role") == "user") & F.col("next_content").startswith(PARSER_REJECTION)
    gate = (F.col("next_role") == "user") & F.col("next_content").contains(GATE_REJECTION)
    against = F.size(F.coalesce(F.when(F.col("role") == "assistant", schema_errors_b("content")), F.array().cast("array<string>"))) > 0
    told = (F.col("next_role") == "user") & contains_any("next_content", REJECTIONS)
    asst = F.col("role") == "assistant"
    action = (
        F.when(asst & F.col("tool").isNull() & F.coalesce(refused, F.lit(False)), "invalid_pair")
        .when(asst & F.col("tool").isNull(), "manual_review")
        .when((F.col("tool") == "finish") & F.coalesce(gate, F.lit(False)) & F.col("later_assistant"), "premature_finish")
        .when(asst & against & F.coalesce(told, F.lit(False)), "protocol_pair")
    )
    r = r.withColumn("action", action).withColumn("category", F.when(asst & F.col("tool").isNull(), call_error("content")))
    paired = F.col("action").isin("invalid_pair", "premature_finish", "protocol_pair")
    return r.withColumn("drop", F.coalesce(paired, F.lit(False)) | F.coalesce(F.lag(paired).over(_order()), F.lit(False)))


def chain_findings(rows: DataFrame) -> DataFrame:
    """Per conversation, what is wrong with the chain of calls and observations; empty if sound."""
    r = neighbours(with_calls(rows))
    asst, last = F.col("role") == "assistant", F.col("next_role").isNull()
    found = F.array_compact(F.array(
        F.when((F.col("pos") == 0) & (F.col("role") != "system"), "no_system_start"),
        F.when((F.col("pos") == 1) & (F.col("role") != "user"), "no_user_second"),
        F.when(asst & F.col("tool").isNull(), "invalid_call"),
        F.when(asst & (F.size(F.coalesce(F.when(asst, schema_errors_b("content")), F.array().cast("array<string>"))) > 0), "schema_violation"),
        F.when((F.col("tool") == "finish") & ~last, "finish_not_terminal"),
        F.when(asst & F.col("tool").isNotNull() & (F.col("tool") != "finish") & F.coalesce(F.col("next_role") != "user", F.lit(True)), "no_observation"),
    ))
    return r.withColumn("f", found).groupBy("trajectory_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("f")))).alias("findings"), F.count("*").alias("message_count"))


def salvage(conversations: DataFrame) -> DataFrame:
    """Repair ``conversations(trajectory_id, messages)``: status, counts, messages after repair.

    Conversations with an unpaired invalid call, or whose repaired chain is unsound, are for
    manual review and have no messages. All repairs are flags on message rows, so one
    window over a conversation does them.
    """
    marks = repair_marks(explode_messages(conversations))
    counts = marks.groupBy("trajectory_id").agg(
        F.count_if(F.col("action") == "invalid_pair").alias("invalid_pairs"),
        F.count_if(F.col("action") == "premature_finish").alias("premature_pairs"),
        F.count_if(F.col("action") == "protocol_pair").alias("protocol_pairs"),
        F.count_if(F.col("action") == "manual_review").alias("unpaired"),
        F.array_sort(F.collect_list(F.when(F.col("drop"), F.col("pos")))).alias("removed"),
    )
    rest = marks.where(~F.col("drop")).select("trajectory_id", "pos", "role", "content", "tool", F.lit(True).alias("resolved"))
    whole = append_finish(truncate_after_finish(sanitize(rest)))
    renumbered = whole.withColumn("pos", F.row_number().over(_order()) - 1)
    chains = chain_findings(renumbered.select("trajectory_id", "pos", "role", "content"))
    appended = whole.groupBy("trajectory_id").agg(F.bool_or(F.col("redactions").isNull()).alias("finish_appended"), F.sum(F.coalesce("redactions", F.lit(0))).alias("secret_redactions"))
    messages = collect_messages(renumbered)
    out = counts.join(chains, "trajectory_id").join(appended, "trajectory_id").join(messages, "trajectory_id")
    sound = (F.col("unpaired") == 0) & (F.size("findings") == 0)
    return out.withColumn("status", F.when(sound, "recovered").otherwise("manual_review")).withColumn("messages", F.when(sound, F.col("messages")))


def strict_clean(samples: DataFrame) -> DataFrame:
    """Route of each sample: invalid, rl_only with a reason, duplicate of a kept id, or sft.

    ``samples`` carries sample fields, ``path_order`` and ``messages``. Exact duplicates are
    those of one text hash; the first by path order stays and names itself in the others.
    """
    ok = F.coalesce("sample_valid", F.lit(False)) & F.col("benchmark_resolved").isNotNull() & well_formed("messages")
    tid = trajectory_id("dataset", "instance_id", "sample_index")
    base = samples.withColumn("trajectory_id", tid).withColumn("_ok", ok)
    valid = explode_messages(base.where("_ok")).transform(with_calls)
    flags = valid.groupBy("trajectory_id").agg(F.count_if((F.col("role") == "assistant") & F.col("tool").isNull()).alias("invalid_calls"))
    hashed = base.join(flags, "trajectory_id", "left").withColumn("conversation_sha256", F.sha2(F.to_json("messages"), 256))
    evaluation = F.coalesce("exclude_from_training", F.lit(False)) | (F.coalesce("data_role", F.lit("")) == "evaluation_only")
    reason = exclusion_reason(evaluation, F.col("agent_status"), F.col("benchmark_resolved"), F.col("invalid_calls") == 0)
    judged = hashed.withColumn("reason", F.when(~F.col("_ok"), "invalid_sample").otherwise(reason))
    trainable = judged.where("reason is null")
    w = Window.partitionBy("conversation_sha256").orderBy("path_order", "trajectory_id")
    kept = trainable.select("trajectory_id", F.first("trajectory_id").over(w).alias("kept_id"))
    out = judged.join(kept, "trajectory_id", "left")
    route = F.when(~F.col("_ok"), "invalid").when(F.col("reason").isNotNull(), "excluded").when(F.col("kept_id") != F.col("trajectory_id"), "duplicate").otherwise("sft")
    return out.withColumn("route", route).withColumn("reward", F.when(F.col("_ok"), F.col("benchmark_resolved").cast("double"))).drop("_ok")


def quality_tier(invalid_pairs: Column, premature: Column, appended: Column) -> Column:
    """More than three repairs: C; any repair flag: B; else A."""
    return F.when(invalid_pairs > 3, "C").when((premature > 0) | appended, "B").otherwise("A")


def tier_weight(tier: Column) -> Column:
    return F.when(tier.isin("S", "A"), 1.0).when(tier == "B", 0.5).otherwise(0.0)


def quality_flags(invalid_pairs: Column, premature: Column, appended: Column) -> Column:
    return F.array_compact(F.array(F.when(appended, "synthetic_finish"), F.when(premature > 0, "premature_finish_removed"), F.when(invalid_pairs > 3, "high_repair_count")))


def audit(original: DataFrame, repaired: DataFrame, verifier: DataFrame) -> DataFrame:
    """Second look at repaired conversations, on purpose without the repair's own code path:
    removed positions replayed on the original, chains, observation headers, secrets, verdict."""
    rows = explode_messages(original.join(repaired.select("trajectory_id", "removed"), "trajectory_id"), "removed")
    replay = rows.where(~F.array_contains("removed", F.col("pos"))).groupBy("trajectory_id").agg(F.count("*").alias("kept_messages"))
    clean = explode_messages(repaired.where("messages is not null"))
    n = neighbours(with_calls(clean))
    header = observation_tool("next_content")
    secret = F.lit(False)
    for p in ("sk-[A-Za-z0-9_-]{16,}", "AKIA[A-Z0-9]{16}", "LTAI[A-Za-z0-9]{12,}"):
        secret = secret | F.col("content").rlike(p)
    asked = (F.col("role") == "assistant") & F.col("tool").isNotNull() & (F.col("tool") != "finish")
    checks = n.groupBy("trajectory_id").agg(
        F.count_if(asked & header.isNotNull() & (header != F.col("tool"))).alias("tool_mismatches"),
        F.count_if(secret).alias("secrets"),
        F.count_if((F.col("role") == "user") & contains_any("content", REJECTIONS)).alias("rejections_left"),
        F.max_by("tool", "pos").alias("last_tool"),
        F.count("*").alias("clean_messages"),
    )
    ok = verifier.groupBy("trajectory_id").agg(F.bool_or(F.coalesce("benchmark_resolved", F.lit(False))).alias("verified"))
    out = repaired.join(replay, "trajectory_id", "left").join(checks, "trajectory_id").join(ok, "trajectory_id", "left")
    extra = F.col("finish_appended").cast("int")
    errors = F.array_compact(F.array(
        F.when(F.col("clean_messages") > F.col("kept_messages") + extra, "more_messages_than_kept"),
        F.when(F.col("tool_mismatches") > 0, "observation_tool_mismatch"),
        F.when(F.col("secrets") > 0, "secret_shape_found"),
        F.when(F.col("rejections_left") > 0, "protocol_rejection_retained"),
        F.when(F.col("last_tool") != "finish", "no_terminal_finish"),
        F.when(~F.coalesce("verified", F.lit(False)), "verifier_not_resolved"),
    ))
    tier = quality_tier(F.col("invalid_pairs"), F.col("premature_pairs"), F.col("finish_appended"))
    return out.select("trajectory_id", errors.alias("errors"), (F.size(errors) == 0).alias("passed"), tier.alias("tier"), quality_flags(F.col("invalid_pairs"), F.col("premature_pairs"), F.col("finish_appended")).alias("flags"))


def tool_counts(rows: DataFrame) -> DataFrame:
    return with_calls(rows).where("tool is not null").groupBy("tool").agg(F.count("*").alias("n"))


def deliver(strict: DataFrame, tiered: DataFrame) -> DataFrame:
    """One table: strict rows and tier A are primary, B optional at half weight, C quarantined."""
    all_ = strict.withColumn("tier", F.lit("S")).unionByName(tiered, allowMissingColumns=True)
    part = F.when(F.col("tier").isin("S", "A"), "primary").when(F.col("tier") == "B", "optional").otherwise("quarantine")
    return all_.withColumns({"part": part, "sample_weight": tier_weight(F.col("tier")), "exclude_from_training": part == "quarantine"})


def check_package(rows: DataFrame) -> DataFrame:
    """Counts of a package's breaches: repeated ids, unresolved rows, no closing finish."""
    last = call_tool(F.element_at("messages", -1)["content"])
    return rows.withColumn("_last", last).agg(
        F.count("*").alias("rows"), (F.count("*") - F.count_distinct("trajectory_id")).alias("repeated"), F.count_if(~F.coalesce("resolved", F.lit(False))).alias("unresolved"),
        F.count_if(F.coalesce("_last", F.lit("")) != "finish").alias("without_finish"), F.min(F.size("messages")).alias("least_messages"), F.max(F.size("messages")).alias("most_messages"),
    )


def units(rows: DataFrame) -> DataFrame:
    """``unit`` 0 is what comes before the first assistant; each assistant begins another."""
    return rows.withColumn("unit", F.sum((F.col("role") == "assistant").cast("bigint")).over(_order().rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def next_actions(trajectories: DataFrame) -> DataFrame:
    """A training example for each step: the steps before it and the step."""
    steps = trajectories.select("*", F.posexplode("steps").alias("step_index", "target"))
    return steps.withColumn("history", F.slice("steps", F.lit(1), F.col("step_index"))).drop("steps")


def reward(passed: Column, steps: Column, timeout: Column) -> Column:
    """A pass earns less for each step beyond the first; a timeout costs."""
    return F.when(passed, F.round(F.greatest(F.lit(0.1), 1 - 0.02 * (steps - 1)), 4)).when(timeout, -0.5).otherwise(0.0)


def reward_episodes(trajectories: DataFrame) -> DataFrame:
    passed = F.col("status") == "pass"
    r = reward(passed, F.size("steps"), F.col("status") == "timeout")
    return trajectories.select("task_id", "instruction", "status", F.size("steps").alias("n_steps"), r.alias("reward"), F.when(passed, 1.0).otherwise(0.2).alias("sample_weight"))


def episodes(trajectories: DataFrame) -> DataFrame:
    return trajectories.select("task_id", "instruction", "status", F.transform("steps", lambda s: F.struct(s["tool_name"].alias("action"), s["output"].alias("observation"))).alias("turns"))


def export_views(rows: DataFrame) -> dict[str, DataFrame]:
    """Sampled, supervised and verifier projections of rollouts."""
    return {
        "sampled": rows.select("instance_id", "repo", "trajectory_id", F.to_json("messages").alias("conversation")),
        "sft": rows.where(F.coalesce("resolved", F.lit(True))).select("instance_id", "messages"),
        "verifier": rows.select("instance_id", "resolved", F.to_json(F.struct("verifier_status", "patch_lines")).alias("report")),
    }


def build_messages(repairs: DataFrame) -> DataFrame:
    """Training messages from repair steps: instruction, then a call and its result for each step."""
    turn = lambda s: F.array(
        F.struct(F.lit("assistant").alias("role"), F.to_json(F.struct(s["tool_name"].alias("tool_name"), F.struct(s["command"].alias("command")).alias("arguments"))).alias("content")),
        F.struct(F.lit("user").alias("role"), F.concat(F.lit("[tool_result] "), s["tool_name"], F.lit("\n"), F.coalesce(s["output"], F.lit(""))).alias("content")),
    )
    start = F.array(F.struct(F.lit("system").alias("role"), F.lit("You repair code with tools.").alias("content")), F.struct(F.lit("user").alias("role"), F.col("instruction").alias("content")))
    return repairs.withColumn("messages", F.concat(start, F.flatten(F.transform("steps", turn))))


def api_messages(messages: Column | str) -> Column:
    """Messages for an endpoint: a tool's message without a call before it is a user's; empty ones go."""
    m = F.col(messages) if isinstance(messages, str) else messages
    fix = lambda x: F.struct(F.when(x["role"] == "tool", "user").otherwise(x["role"]).alias("role"), x["content"].alias("content"))
    return F.transform(F.filter(m, lambda x: x["content"].isNotNull()), fix)


def session_summaries(trajectories: DataFrame) -> DataFrame:
    """What a session did: commands, files and tests, in order of first use."""
    s = F.col("steps")
    return trajectories.select("task_id", "status", F.size(s).alias("n_steps"), F.array_distinct(F.transform(s, lambda x: x["tool_name"])).alias("tools"), F.array_distinct(F.filter(F.transform(s, lambda x: x["command"]), lambda c: c.isNotNull())).alias("commands"), F.exists(s, lambda x: (x["tool_name"] == "run_tests") & (x["returncode"] == 0)).alias("tests_passed"))


def learned_memory(summaries: DataFrame) -> DataFrame:
    """Memory records of sessions: what worked, and what failed."""
    kind = F.when(F.col("status") == "pass", "success").otherwise("failure")
    return summaries.select(kind.alias("type"), F.concat_ws(" ", F.lit("task"), "task_id", F.lit("with"), F.array_join("tools", ", ")).alias("content"), F.col("tools").alias("tags"))


def compact_rows(rows: DataFrame, paths: dict[str, Column]) -> DataFrame:
    """Deep fields by name, with their defaults."""
    return rows.select(*[c.alias(name) for name, c in paths.items()])


def loss_ranges(messages: Column | str, lengths: Column | str) -> Column:
    """Role, whether a message trains, and its token range."""
    m, n = (F.col(x) if isinstance(x, str) else x for x in (messages, lengths))
    ends = F.transform(n, lambda x, i: F.aggregate(F.slice(n, F.lit(1), i + 1), F.lit(0), lambda a, b: a + b))
    return F.transform(m, lambda x, i: F.struct(x["role"].alias("role"), F.when(x["role"] == "assistant", "train").otherwise("masked").alias("loss"), (ends[i] - n[i]).alias("start"), ends[i].alias("end")))


def key_presence(raw: DataFrame, keys: list[str]) -> DataFrame:
    """Which keys the raw JSON rows have; a null value is present."""
    have = F.json_object_keys("value")
    return raw.select(*[F.coalesce(F.array_contains(have, k), F.lit(False)).alias(k) for k in keys])


def instance_of(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumn("instance_id", first_non_blank(*columns))


def modification_reminders(steps: DataFrame, checkpoint: int, grace: int) -> DataFrame:
    """Steps after the checkpoint at which the run of steps without an edit is a multiple of ``grace``.

    ``steps(trajectory_id, step, tool_name, is_edit)``: an edit begins a new island; a finish
    counts in the run but never reminds.
    """
    late = steps.where(F.col("step") > checkpoint)
    w = Window.partitionBy("trajectory_id").orderBy("step")
    island = F.sum(F.col("is_edit").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inside = Window.partitionBy("trajectory_id", "island").orderBy("step")
    streak = F.row_number().over(inside) - F.when(F.col("island") > 0, 1).otherwise(0)
    out = late.withColumn("island", island).withColumn("streak", streak)
    return out.withColumn("remind", ~F.col("is_edit") & (F.col("tool_name") != "finish") & (F.col("streak") % max(1, grace) == 0)).drop("island")


def completion_gate(steps: DataFrame) -> DataFrame:
    """Per trajectory: passing tests and a diff, both after the last edit (0 if there is none)."""
    edit = F.coalesce(F.max(F.when(F.col("is_edit"), F.col("step"))), F.lit(0))
    good = F.col("returncode") == 0
    tested = F.max(F.when((F.col("tool_name") == "run_tests") & good & ~F.coalesce("all_skipped", F.lit(False)), F.col("step")))
    shown = F.max(F.when((F.col("tool_name") == "git_diff") & good, F.col("step")))
    g = steps.groupBy("trajectory_id").agg(edit.alias("last_edit"), tested.alias("last_test"), shown.alias("last_diff"))
    return g.withColumn("ready", F.coalesce(F.col("last_test") > F.col("last_edit"), F.lit(False)) & F.coalesce(F.col("last_diff") > F.col("last_edit"), F.lit(False)))
