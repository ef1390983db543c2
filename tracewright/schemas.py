"""Explicit schemas of the record kinds, in DDL, and the registry of their formats."""

MESSAGE = "struct<role:string,content:string>"
SAMPLE = (
    "instance_id string, dataset string, repo string, sample_index int, attempt_index int, sample_valid boolean, "
    "benchmark_resolved boolean, agent_status string, verifier_status string, patch_present boolean, patch_lines int, "
    "edited_files array<string>, tool_steps int, usage map<string,bigint>, elapsed_sec double, data_role string, exclude_from_training boolean"
)
CONVERSATION = f"trajectory_id string, instance_id string, dataset string, sample_index int, messages array<{MESSAGE}>"
WINDOW = (
    "trajectory_id string, instance_id string, sample_index smallint, dataset string, quality_tier string, sample_weight float, window_index smallint, "
    "window_count smallint, token_count int, supervised_token_count int, input_ids array<int>, attention_mask array<tinyint>, labels array<int>"
)
SELECTION = "split string, dataset string, instance_id string, repo string, ordinal int"
TASK = "instance_id string, repo string, patch string, problem_statement string, FAIL_TO_PASS array<string>, PASS_TO_PASS array<string>"
FUNCTION_TASK = "task_id string, prompt string, canonical_solution string, test string, entry_point string, atol double"
VALUE_SAMPLE = (
    "record_index int, dataset_family string, dataset string, instance_id string, sample_index int, repo string, reward double, agent_status string, "
    "verifier_status string, trajectory_sha256 string, split string, offset bigint, num_tokens int, num_action_tokens int, assistant_turns int"
)
PREDICTION = "dataset_family string, instance_id string, reward double, num_tokens int, num_action_tokens int, mean_value double, final_value double"
STEP = "struct<step:int,tool_name:string,command:string,returncode:int,output:string,all_skipped:boolean>"
TRAJECTORY = f"task_id string, repo string, instruction string, status string, steps array<{STEP}>"
PROBLEM = "task_id string, kind string, source string, instruction string, validation_command string, final_status string, files array<string>, tags array<string>"
MEMORY = "type string, content string, tags array<string>"
SKILL = "name string, description string, keywords array<string>, priority double, body string"
METRIC = "ts timestamp, name string, value double"
PLAN = "update_id bigint, microbatch_id int, bucket int, row_id bigint"

FORMATS = {
    "sample.v1": SAMPLE, "conversation.v1": CONVERSATION, "token_window.v1": WINDOW, "selection.v1": SELECTION, "task.v1": TASK,
    "function_task.v1": FUNCTION_TASK, "value_sample.v1": VALUE_SAMPLE, "prediction.v1": PREDICTION, "trajectory.v1": TRAJECTORY,
    "problem.v1": PROBLEM, "memory.v1": MEMORY, "skill.v1": SKILL, "metric.v1": METRIC, "update_plan.v1": PLAN,
}
