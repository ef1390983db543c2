import pytest

from tracewright.functions import dialects as D
from tracewright.functions import toolcalls as T

V = D.VENDOR
CASES = [
    ("Let us see.\n<function=execute_bash>\n<parameter=command>python3 -V</parameter>\n</function>", "execute_bash", {"command": "python3 -V"}),
    ("First this.<execute_bash>\n<command>pwd && ls</command>\n</execute_bash>", "execute_bash", {"command": "pwd && ls"}),
    ("<repo_context><query>x &lt; y</query></repo_context>", "repo_context", {"query": "x < y"}),
    ('<tool_call>\n<invoke name="execute_bash">\n<command>pwd</command>\n</invoke>\n</tool_call>', "execute_bash", {"command": "pwd"}),
    ("<invoke name='run_tests'>\n</invoke>", "run_tests", {}),
    ('<tool_call>execute_bash{"arguments": {"command":"pwd"}}\n</tool_call>', "execute_bash", {"command": "pwd"}),
    (f'<{V}tool_calls>\n<{V}invoke name="str_replace_editor">\n<{V}parameter name="command" string="true">view</{V}parameter>\n<{V}parameter name="path" string="true">a.py</{V}parameter>\n<{V}parameter name="view_range" string="false">2300, 2365</{V}parameter>\n<{V}parameter name="start_line">7</{V}parameter>\n</{V}invoke>\n</{V}tool_calls>', "str_replace_editor", {"command": "view", "path": "a.py", "view_range": [2300, 2365], "start_line": 7}),
    ('<tool_invoke>\n<tool_name>execute_bash</tool_name>\n<command>grep -n "D" s/d.py</command>\n</invoke>', "execute_bash", {"command": 'grep -n "D" s/d.py'}),
    (f'<tool_calls>\n<tool_invoke>\n<tool_name>execute_bash</{V}>\n<command>grep -rn "E" s</command>\n</invoke>\n</tool_calls>', "execute_bash", {"command": 'grep -rn "E" s'}),
    (f'<{V}>\n<tool_name>execute_bash</{V}>\n<command>grep -rn "D" tests</command>\n</{V}>', "execute_bash", {"command": 'grep -rn "D" tests'}),
    ("<function=execute_bash><parameter>command>pwd</parameter></function>", "execute_bash", {"command": "pwd"}),
    ("<function=execute_bash><parameter=command>grep -n size f.py</parameter></figure>", "execute_bash", {"command": "grep -n size f.py"}),
    ("```bash\nsed -n '1,5p' demo.py\n```</observation>", "execute_bash", {"command": "sed -n '1,5p' demo.py"}),
    ('{"tool_name": "execute_bash", "arguments": {"command": "pwd"}}', "execute_bash", {"command": "pwd"}),
    ('{"tool_name": "answer", "arguments": {"content": "done"}', "answer", {"content": "done"}),
    ('{"tool_name":"finish","arguments:{}}', "finish", {}),
    ('Let me see.\n\n{"tool_name": "str_replace_editor", "arguments": {"command": "view", "path": "s.py"}}\n\n{"tool_name": "finish", "arguments": {}}', "str_replace_editor", {"command": "view", "path": "s.py"}),
    ("<function=execute_bash><parameter=command>grep -n foo src/app.py</parameter>", "execute_bash", {"command": "grep -n foo src/app.py"}),
    ("PYTHONPATH=src python -m pytest tests/test_app.py", "execute_bash", {"command": "PYTHONPATH=src python -m pytest tests/test_app.py"}),
    ("$ awk '{print}' f", "execute_bash", {"command": "awk '{print}' f"}),
    ("python3.11 -V", "execute_bash", {"command": "python3.11 -V"}),
    ("The fix is implemented and validation is complete.", "finish", {}),
]


@pytest.mark.parametrize("text,tool,arguments", CASES)
def test_first_call(text, tool, arguments):
    call = D.parse_call(text)
    assert (call["tool_name"], call["arguments"]) == (tool, arguments)


@pytest.mark.parametrize("text", [None, "", "echo hi", "cd src", "rm -r x", "It is done but the build failed", "a < b > c", "<command>ls</command>", "ls\na\nb\nc", "{broken", "undone"])
def test_no_call(text):
    assert D.parse_call(text) is None


def test_all_calls_by_notation():
    text = "<git_diff></git_diff><function=finish></function><invoke name='run_tests'></invoke><execute_bash><command>ls</command></execute_bash>"
    assert [c["tool_name"] for c in D.parse_all(text)] == ["finish", "git_diff", "execute_bash", "run_tests"]
    assert D.parse_all(None) == []


@pytest.mark.parametrize("text,mended", [('{"a": [1, {"b": "}"', '{"a": [1, {"b": "}"}]}'), ('{"a": 1}', None), ('{"a": ]', None), ("{" * 4, None)])
def test_closing(text, mended):
    assert D.closed(text) == mended


def test_columns(spark):
    df = spark.createDataFrame([("ls",), (None,), ("<finish></finish>",)], "t string").select(D.parse_first_call("t").alias("c"), D.summarize_call("t").alias("s"), D.parse_all_calls("t").alias("a"))
    out = df.collect()
    assert [r.c.tool_name for r in out] == ["execute_bash", None, "finish"] and out[1].s == "no tool call" and len(out[2].a) == 1


@pytest.mark.parametrize("content,category", [("x", "non_json_text"), (None, "non_json_text"), ('{"a": "\\q"}', "invalid_escape"), ('{"a": "b', "unterminated_string"), ('{"a": "b\n"}', "invalid_control_character"), ("{} x", "extra_data"), ('{"a" 1}', "missing_delimiter"), ("{}", "invalid_tool_schema"), ('{"tool_name": "", "arguments": {}}', "invalid_tool_schema"), ("{a}", "invalid_json"), ('{"tool_name": "x", "arguments": {}}', None)])
def test_categories(content, category):
    assert T.error_category(content) == category
