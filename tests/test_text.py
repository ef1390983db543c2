import json

from pyspark.sql import functions as F

from tracewright.functions import text as T
from tracewright.functions import toolcalls as C


def one(spark, value, *columns):
    kind = "array<string>" if isinstance(value, list) else "string"
    return spark.createDataFrame([(value,)], f"x {kind}").select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_secrets(spark):
    text, n = T.redact_secrets("x")
    r = one(spark, "sk-" + "a" * 16 + " AKIA" + "B" * 16 + " LTAI" + "c" * 12 + " sk-short", text, n)
    assert r.c0 == "<redacted-secret> <redacted-secret> <redacted-secret> sk-short" and r.c1 == 3


def test_lines_are_those_of_splitlines(spark):
    for s in ["", "a", "a\n", "a\r\nb\rc\x0bd\x0ce\x1cf\x85g h i\n\n", "\n"]:
        assert one(spark, s, T.lines("x")).c0 == s.splitlines(), repr(s)


def test_patch_statistics(spark):
    p = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1 +1,2 @@\n-old\n+new\n+more\n diff\ndiff --git a/b/y b/b/y\n"
    r = one(spark, p, T.patch_file_count("x"), T.patch_changed_lines("x"), T.patch_files("x"))
    assert (r.c0, r.c1, r.c2) == (2, 3, ["b/y", "x.py"])


def test_user_paths(spark):
    r = one(spark, "/Users/bob/src/x y", T.redact_paths("x"), T.redact_paths("x", compat=True))
    assert r.c0 == "<user-path> y" and r.c1 == "<user-path>src/x y"


def test_small_functions(spark):
    r = one(spark, "abcdefghij", T.clip_head("x", 3, "!"), T.clip_tail("x", 2), T.clip_middle("x", 6, "-"), T.retry_budget(F.lit(3)), T.input_budget(F.lit(5), F.lit(9)))
    assert tuple(r) == ("abc!", "ij", "abcd-ij", 3000, 1)
    r = one(spark, "owner/org__repo.abc123", T.repo_profile("x"), T.github_slug("x"))
    assert tuple(r.c0) == ("org", "repo", "abc123") and r.c1 == "org/repo"
    assert one(spark, "a.b__c.lm_rewrite__xyz", T.mutation_kind("x")).c0 == "lm_rewrite"
    r = one(spark, "3 passed, 1 failed\n5 passed, 2 skipped in 1s", T.test_counts("x"), T.all_skipped("x"))
    assert r.c0.asDict() == {"passed": 5, "failed": 1, "skipped": 2, "error": 0} and r.c1 is False
    assert one(spark, "src/pkg/__init__.py", T.module_name("x"), T.file_role("x"), T.file_language("x"))[:] == ("pkg", "source", "python")
    assert one(spark, "it's", T.shell_quote("x")).c0 == "'it'\"'\"'s'"
    assert one(spark, "a\nb", T.numbered("x"), T.new_file_patch(F.lit("f"), "x"))[0] == "0001: a\n0002: b"
    assert one(spark, ["", "b", "a", "b"], T.ordered_head("x", 2)).c0 == ["b", "a"]
    assert one(spark, "Foo_bar x 中文字", T.terms("x"), T.terms("x", True))[:] == (["foo_bar", "中文字"], ["foo_bar", "中文字", "foo", "bar"])


def test_buckets(spark):
    df = spark.createDataFrame([(n,) for n in (1, 4096, 4097, 40000)], "t int")
    assert [r[0] for r in df.select(T.length_bucket("t", T.REPORT_BOUNDS)).collect()] == ["<=4096", "<=4096", "<=8192", "above"]


def test_strict_calls(spark):
    good = '{"tool_name":"finish","arguments":{}}'
    cases = {good: (None, None), good + "x": (None, "extra_data"), "no": (None, "non_json_text"), '{"tool_name":"finish"}': (None, "invalid_tool_schema"), '{"tool_name":5,"arguments":{}}': (None, "invalid_tool_schema"), '{"tool_name":"a","arguments":{"x":"\\q"}}': (None, "invalid_escape"), '{"tool_name":"a': (None, "unterminated_string"), '{"tool_name" 1}': (None, "missing_delimiter")}
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    out = {r.x: (r.t, r.e) for r in df.select("x", C.call_tool("x").alias("t"), C.call_error("x").alias("e")).collect()}
    assert out == cases | {good: ("finish", None)}


def call(tool, **args):
    return json.dumps({"tool_name": tool, "arguments": args})


def test_two_validators_differ():
    ed = dict(command="insert", path="a", insert_line=True, new_str="x")
    assert C.reason_a(call(C.EDITOR, **ed)) is None  # true is a number there
    assert C.call_errors_b(call(C.EDITOR, **ed)) == ["arguments.insert_line:not_integer"]
    assert C.reason_a(call("execute_bash", command=" ")) == "execute_bash_missing_command"
    assert C.call_errors_b(call("execute_bash", command="")) == ["arguments.command:too_short"]
    assert C.reason_a(call("nope")) == "unknown_tool" and C.call_errors_b(call("nope")) == ["unknown_tool"]
    assert C.reason_a(call("finish", x=1)) == "finish_unexpected_arguments" and C.call_errors_b(call("finish", x=1)) == ["arguments.x:unexpected"]
    assert C.reason_a(call("run_tests", targets=[1])) == "run_tests_targets"
    assert C.call_errors_b(call("run_tests", targets=[1])) == ["arguments.targets:not_string"] and C.call_errors_b(call("run_tests", targets=[1]), True) == ["arguments.targets[0]:not_string"]
    assert C.reason_a(call(C.EDITOR, command="str_replace", path="a", old_str="x")) == "editor_str_replace_new_str"
    assert C.reason_a(call(C.EDITOR, command="view", path="a", view_range=[1])) == "editor_view_range"
    assert C.call_errors_b("no json") is None and C.reason_a("x") == "invalid_json"


def test_json_tools():
    assert C.canonical_json('{"b":1,"a":"é\\u001b"}') == '{"a":"é\\u001b","b":1}'
    assert C.literal("{'a': (1, None)}") == {"a": (1, None)} and C.literal("{") is None
    assert C.answer_object('```json\n{"a": 1}\n```') == {"a": 1} and C.answer_object("see {\"a\": 2} ok") == {"a": 2} and C.answer_object("x", {}) == {}
    assert C.drop_fields({"a": ["/r/x/y"], "local": 1}, {"local"}, [("/r", "R"), ("/r/x", "X")]) == {"a": ["X/y"]}
    assert C.shrink({"a": list(range(30)), "b": "x" * 600})["a"] == list(range(20))
    assert C.python_outline("import a.b\nfrom . import c\ndef f(): pass") == {"imports": [".", "a.b"], "symbols": ["f"]}
    assert C.entry_point("def f(): pass\ndef g(): pass", "assert f()") == "f"
    assert "NotImplementedError" in C.stub_function("def f():\n    'd'\n    return 1", "f")
    assert C.apply_edit("a\nb\n", "b", "c") == "a\nc\n" and C.apply_edit("a\nb\n", "zzz", "c", 1, 1) == "c\nb\n"
    assert C.apply_edit("def foo(x):\n    return x+1\n", "def foo(x):\n    return x + 1\n", "new") == "new\n" and C.apply_edit("a\n", "zzzzzzz", "c") is None
    assert C.unified_diff("a\n", "b\n", "f").startswith("--- a/f")
