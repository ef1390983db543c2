import json

import pytest
from pyspark.sql import functions as F

from tracewright.functions.tokenizers import ByteTokenizer, render
from tracewright.operators import conversations as V
from tracewright.operators import masks as M


def call(tool, **args):
    return json.dumps({"tool_name": tool, "arguments": args})


BASH, FINISH = call("execute_bash", command="ls"), call("finish")
PARSER, GATE = "[tool_result] parser\nno call", "Completion gate rejected finish because of tests"


def talk(*turns):
    roles = ["system", "user"] + ["assistant", "user"] * len(turns)
    return [{"role": r, "content": c} for r, c in zip(roles, ["s", "u", *turns])]


def salvaged(spark, *turns):
    df = spark.createDataFrame([("t", talk(*turns))], "trajectory_id string, messages array<struct<role:string,content:string>>")
    return V.salvage(df).first()


def contents(r):
    return [m.content for m in r.messages]


def test_invalid_call_with_refusal_goes_and_finish_is_added(spark):
    r = salvaged(spark, "not json", PARSER, BASH, "ok")
    assert (r.status, r.removed, r.finish_appended) == ("recovered", [2, 3], True)
    assert contents(r)[2:4] == [BASH, "ok"] and json.loads(contents(r)[-1])["tool_name"] == "finish"


def test_unpaired_invalid_call_is_for_review(spark):
    r = salvaged(spark, "not json", "what?", BASH, "ok")
    assert r.status == "manual_review" and r.messages is None and r.unpaired == 1


def test_premature_finish(spark):
    r = salvaged(spark, BASH, "ok", FINISH, GATE, BASH, "ok", FINISH)
    assert (r.status, r.premature_pairs, r.removed, r.finish_appended) == ("recovered", 1, [4, 5], False)


def test_schema_violation_goes_only_if_refused(spark):
    bad = call("execute_bash", cmd="x")
    r = salvaged(spark, bad, "command is required", BASH, "ok")
    assert (r.status, r.protocol_pairs) == ("recovered", 1)
    assert salvaged(spark, bad, "fine", BASH, "ok").status == "manual_review"
    assert salvaged(spark, call("unknown"), "Tool not allowed: unknown", BASH, "ok").status == "recovered"


def test_audit_tiers(spark):
    df = spark.createDataFrame([("t", talk("not json", PARSER, BASH, "[tool_result] execute_bash\nok"))], "trajectory_id string, messages array<struct<role:string,content:string>>")
    fixed = V.salvage(df)
    v = spark.createDataFrame([("t", True)], "trajectory_id string, benchmark_resolved boolean")
    a = V.audit(df, fixed, v).first()
    assert a.passed and a.tier == "B" and a.flags == ["synthetic_finish"]
    assert V.audit(df, fixed, v.withColumn("benchmark_resolved", F.lit(False))).first().errors == ["verifier_not_resolved"]


def test_strict_clean_routes(spark):
    ok = talk(BASH, "ok", FINISH)
    rows = [("a", 0, True, ["b", "x"], ok), ("b", 0, True, ["a", "y"], ok), ("c", 0, False, ["c"], ok), ("d", 0, True, ["d"], talk("bad", "x")), ("e", 0, None, ["e"], ok), ("f", 0, True, ["f"], [])]
    df = spark.createDataFrame([(i, "d", k, r is not None, r, "edited", False, "train", p, m) for i, k, r, p, m in rows], "instance_id string, dataset string, sample_index int, sample_valid boolean, benchmark_resolved boolean, agent_status string, exclude_from_training boolean, data_role string, path_order array<string>, messages array<struct<role:string,content:string>>")
    out = {r.instance_id: (r.route, r.reason, r.kept_id) for r in V.strict_clean(df).collect()}
    assert out["b"] == ("sft", None, "d:b:sample_00") and out["a"] == ("duplicate", None, "d:b:sample_00")
    assert out["c"][:2] == ("excluded", "verifier_unresolved") and out["d"][:2] == ("excluded", "invalid_tool_protocol")
    assert out["e"][0] == out["f"][0] == "invalid"


def test_reminders(spark):
    edits = [False, False, True, False, False, False, False]
    df = spark.createDataFrame([("t", i + 1, "execute_bash", e) for i, e in enumerate(edits)], "trajectory_id string, step int, tool_name string, is_edit boolean")
    assert [r.step for r in V.modification_reminders(df, 0, 2).where("remind").orderBy("step").collect()] == [2, 5, 7]


def test_masks_agree_and_pass_the_audit():
    tok, m = ByteTokenizer(), talk(BASH, "ok", FINISH)
    ids, labels = M.span_mask(m, tok)
    assert M.prefix_mask(m, tok) == (ids, labels) and tok.decode(ids) == render(m)[0]
    assert M.segment_mask(m, tok) == (ids, [int(x != M.MASKED) for x in labels])
    assert M.token_audit(ids, labels, tok) == []
    broken = list(labels)
    broken[next(i for i, x in enumerate(labels) if x != M.MASKED)] = M.MASKED
    assert M.token_audit(ids, broken, tok) == ["partly_supervised"]


class Spans:
    """Tokens with given spans."""

    def __init__(self, *edges):
        self.spans = list(zip(edges, edges[1:]))

    def encode(self, text):
        return list(range(len(self.spans))), self.spans


def test_tokens_at_the_edges_of_an_answer():
    m = [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]
    text, (_, (begin, end)) = render(m)
    assert M.span_mask(m, Spans(0, begin, begin, end, end, len(text)))[1] == [M.MASKED, 1, 2, M.MASKED, M.MASKED]
    for edges in ((0, begin + 1, end, len(text)), (0, begin, end + 1, len(text)), (0, len(text))):
        with pytest.raises(M.MaskError, match="crosses"):
            M.span_mask(m, Spans(*edges))


def test_spans_of_bytes():
    ids, spans = ByteTokenizer().encode("<|im_start|>aé€<|im_end|>\n")
    assert spans == [(0, 12), (12, 13), (13, 14), (13, 14), (14, 15), (14, 15), (14, 15), (15, 25), (25, 26)]
    assert ids == [0, *(b + 2 for b in "aé€".encode()), 1, 12] and ByteTokenizer().encode("") == ([], [])


def test_windows_cover_each_answer_once():
    tok, m = ByteTokenizer(), talk(*[x for k in range(9) for x in (call("execute_bash", command="x" * (k * 7 % 40)), "ok" * k)], FINISH)
    train = {i for i, x in enumerate(m) if x["role"] == "assistant"}
    found = M.windows(m, tok, 400, 2, train)
    assert len(found) > 2 and sorted(i for _, t in found for i in t) == sorted(train)
    for chosen, _ in found:
        assert chosen[:2] == [0, 1] and len(M.span_mask([m[i] for i in chosen], tok)[0]) <= 400
    assert len(M.windows(m, tok, 10**6, 2, train)) == 1


def test_record_faults(spark):
    df = spark.createDataFrame([([1, 2], [1, 1], [-100, 2]), ([1, 2], [1, 0], [-100, 2]), ([1], [1], [-100]), ([1], [1], [5])], "input_ids array<int>, attention_mask array<int>, labels array<int>")
    assert [r[0] for r in df.select(M.record_faults()).collect()] == [[], ["padding_in_loss"], ["nothing_trainable"], ["label_not_id"]]


def test_compaction():
    m = talk(*[x for k in range(20) for x in (BASH, f"line {k}\n" + "y" * 300)])
    out, was = M.compact(m, 800, turns=2)
    assert was and M.estimate(out) <= 800 and out[:2] == m[:2] and "WORKING_MEMORY" in out[2]["content"]
    assert M.compact(m, 10**6) == (m, False)
    long = talk(BASH, "z" * 9000)
    out, _ = M.compact(long, 600)
    assert M.estimate(out) <= 600
