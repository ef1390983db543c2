"""Tool calls in the notations that models write: a tag lexer, a table of notations, JSON repairs.

A text is cut into tags once. A notation says which tag opens a call, which tags may close
it, where the tool's name stands and how its arguments are written; ``NOTATIONS`` lists them
in the order in which they are tried. Texts without a tagged call may hold a shell fence, a
JSON object (whole, embedded, or with small damage), a call whose end is missing, a bare
shell line, or the intent to finish.

Deliberate difference: lost closing brackets are put back in the order of nesting and
without counting those inside strings, so a few more damaged objects are read.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from .toolcalls import compact_arguments

# Tools that may be written as a tag, the vendor's mark, closing tags that stand
# for </function>, names of shell programs, words of an intent to finish and words against it.
TAG_TOOLS = "execute_bash str_replace_editor run_tests git_diff finish repo_context problem_search web_search download_repo answer".split()
VENDOR = "｜｜DSML｜｜"
WRONG_ENDS = ["figure", "tool_call", "observation"]
PROGRAMS = "python pytest pip git rg grep sed cat find ls pwd head tail awk perl cp mkdir touch".split()
FINISHING = "done finished complete completed fixed resolved implemented ready".split()
FAILING = ["Traceback", "Error:", "failed"]


@dataclass
class Tag:
    start: int
    end: int
    closes: bool
    vendor: bool
    name: str
    value: str | None  # after = or in name="..."


_TAG = re.compile(rf"<(?P<closes>/?)(?P<vendor>{VENDOR})?(?P<name>\w*)(?:=(?P<value>[^<>]+)|\s+name=(?P<quote>[\"'])(?P<named>[^\"'<>]+)(?P=quote)[^<>]*)?\s*>")


def tags(text: str) -> list[Tag]:
    return [Tag(m.start(), m.end(), bool(m["closes"]), bool(m["vendor"]), m["name"], m["value"] or m["named"]) for m in _TAG.finditer(text)]


def _value(raw: str) -> str:
    return html.unescape(raw.strip())


def _elements(text: str, found: list[Tag], opens: Callable[[Tag], bool], closes: Callable[[Tag, Tag], bool]) -> Iterator[tuple[Tag, int, int]]:
    """(opening tag, start and end of its body) of elements that follow each other."""
    at = 0
    for k, tag in enumerate(found):
        if tag.start >= at and not tag.closes and opens(tag):
            end = next((t for t in found[k + 1 :] if closes(tag, t)), None)
            if end:
                yield tag, tag.end, end.start
                at = end.end


def _whole_number(raw: str):
    return int(raw) if re.fullmatch(r"-?\d+", raw) else raw


def _number_pair(raw: str):
    parts = [p.strip() for p in raw.split(",")]
    return [int(p) for p in parts] if len(parts) == 2 and all(re.fullmatch(r"-?\d+", p) for p in parts) else raw


#: Arguments that the vendor's notation writes as numbers.
_TYPED = {"view_range": _number_pair, "insert_line": _whole_number, "start_line": _whole_number, "end_line": _whole_number}


def parameters(body: str) -> dict:
    """``<parameter=name>value</parameter>``, also misspelt ``<parameter>name>value</parameter>``."""
    found = tags(body)
    out, misspelt = {}, {}
    for tag, a, b in _elements(body, found, lambda t: t.name == "parameter" and not t.vendor, lambda _, t: t.closes and t.name == "parameter"):
        if tag.value is not None:
            out[tag.value.strip()] = _value(body[a:b])
        else:
            name, bracket, value = body[a:b].partition(">")
            if bracket and re.fullmatch(r"[A-Za-z_]\w*", name, re.A):
                misspelt[name] = _value(value)
    return misspelt | out


def vendor_parameters(body: str) -> dict:
    found = tags(body)
    inside = _elements(body, found, lambda t: t.vendor and t.name == "parameter" and t.value is not None, lambda _, t: t.closes and t.vendor and t.name == "parameter")
    out = {tag.value.strip(): _value(body[a:b]) for tag, a, b in inside}
    return {k: _TYPED.get(k, str)(v) for k, v in out.items()}


def children(body: str) -> dict:
    """``<name>value</name>``."""
    found = tags(body)
    plain = lambda t: not t.vendor and t.value is None and bool(t.name) and not t.name[0].isdigit()
    return {tag.name: _value(body[a:b]) for tag, a, b in _elements(body, found, plain, lambda o, t: t.closes and not t.vendor and t.name == o.name)}


def json_arguments(body: str) -> dict:
    try:
        value = json.loads(body[body.index("{") :])
    except ValueError:
        return {}
    found = value.get("arguments") if isinstance(value, dict) else None
    return found if isinstance(found, dict) else {}


@dataclass
class Notation:
    label: str
    opens: Callable[[Tag], bool]
    closes: Callable[[Tag, Tag], bool]
    arguments: Callable[[str], dict]
    name: Callable[[Tag, str], str | None] = lambda tag, body: tag.value


def _closing(*names: str, vendor: bool | None = False) -> Callable[[Tag, Tag], bool]:
    return lambda _, t: t.closes and t.name in names and vendor in (None, t.vendor)


def _inner_name(_: Tag, body: str) -> str | None:
    m = re.match(rf"\s*<tool_name>([^<]+)</(?:tool_name|{VENDOR})>", body)
    return m and m[1]


def _leading_name(_: Tag, body: str) -> str | None:
    m = re.match(r"\s*([A-Za-z_]\w*)\s*\{.*\}\s*$", body, re.S | re.A)
    return m and m[1]


def _is_function(t: Tag) -> bool:
    return t.name == "function" and t.value is not None and not t.vendor


def _without_name(body: str) -> dict:
    return {k: v for k, v in children(body).items() if k != "tool_name"}


def _wrapper_end(_: Tag, t: Tag) -> bool:
    return t.closes and (t.name in ("invoke", "tool_invoke") and not t.vendor or t.vendor and not t.name)


def _wrapper(t: Tag) -> bool:
    return t.value is None and (t.name == "tool_invoke" and not t.vendor or t.vendor and not t.name)


NOTATIONS = [
    Notation("function", _is_function, _closing("function"), parameters),
    Notation("lenient", _is_function, _closing("function", *WRONG_ENDS), parameters),
    Notation("direct", lambda t: t.name in TAG_TOOLS and t.value is None and not t.vendor, lambda o, t: t.closes and t.name == o.name, children, lambda tag, body: tag.name),
    Notation("vendor", lambda t: t.vendor and t.name == "invoke" and t.value is not None, _closing("invoke", vendor=True), vendor_parameters),
    Notation("invoke", lambda t: not t.vendor and t.name == "invoke" and t.value is not None, _closing("invoke"), children),
    Notation("wrapped", _wrapper, lambda o, t: _wrapper_end(o, t), _without_name, _inner_name),
    Notation("named", lambda t: t.name == "tool_call" and t.value is None, _closing("tool_call"), json_arguments, _leading_name),
]


def _wrapped_tags(found: list[Tag]) -> list[Tag]:
    """A vendor's end right behind a tool name closes that name, not the wrapper."""
    names = {t.end for t in found if t.name == "tool_name" and not t.closes}
    out, inside = [], False
    for t in found:
        if inside and t.closes and t.vendor and not t.name:
            inside = False
            continue
        inside = t.end in names
        out.append(t)
    return out


def tagged_calls(text: str, notation: Notation) -> Iterator[dict]:
    found = tags(text)
    for tag, a, b in _elements(text, _wrapped_tags(found) if notation.label == "wrapped" else found, notation.opens, notation.closes):
        name = notation.name(tag, text[a:b])
        if name:
            yield {"tool_name": name.strip(), "arguments": notation.arguments(text[a:b]), "dialect": notation.label}


def _fence(text: str, languages: str, body: str) -> str | None:
    m = re.search(rf"```(?:{languages})\s*{body}\s*```", text, re.S | re.I)
    return m and m[1].strip()


def closed(text: str, most: int = 3) -> str | None:
    """The text with its missing closing brackets, if at most ``most`` are missing at its end."""
    open_: list[str] = []
    for m in re.finditer(r'"(?:[^"\\]|\\.)*"|[\[\]{}]', text, re.S):
        if m[0] in "[{":
            open_.append("]" if m[0] == "[" else "}")
        elif m[0] in "]}" and (not open_ or open_.pop() != m[0]):
            return None
    return text + "".join(reversed(open_)) if 0 < len(open_) <= most else None


def json_values(text: str, most: int = 5) -> Iterator:
    """JSON values that a text holds: in a fence, whole, embedded, with brackets or a quote put back."""
    for whole in (_fence(text, "json|", r"(\{.*?\})"), text):
        try:
            yield json.loads(whole or "")
        except ValueError:
            pass
    at, found, decoder = text.find("{"), 0, json.JSONDecoder()
    while at >= 0 and found < most:
        try:
            yield decoder.raw_decode(text, at)[0]
            found += 1
        except ValueError:
            pass
        at = text.find("{", at + 1)
    if text.startswith("{"):
        quoted = re.sub(r'(?<=")(arguments|parameters)(?=\s*:)', r'\1"', text)
        for mended in (closed(text), quoted):
            try:
                yield json.loads(mended or "")
            except ValueError:
                pass


def json_call(text: str) -> dict | None:
    for value in json_values(text.strip()):
        if isinstance(value, dict):
            name = next((v for k in ("tool_name", "name", "function") if (v := value.get(k))), None)
            if is_name := isinstance(name, str):
                given = next((v for k in ("arguments", "parameters") if (v := value.get(k))), {})
                return {"tool_name": name, "arguments": given if is_name and isinstance(given, dict) else {}, "dialect": "json"}
    return None


def _bash(command: str, dialect: str) -> dict:
    return {"tool_name": "execute_bash", "arguments": {"command": _value(command)}, "dialect": dialect}


def shell_line(text: str, most: int = 3) -> dict | None:
    """The first line that starts a known program, if there are at most ``most`` lines."""
    lines = [line for raw in text.splitlines() if (line := raw.strip())]
    for line in lines if len(lines) <= most else ():
        command = line.removeprefix("$ ").strip()
        words = re.split(r"\s+", command)
        while len(words) > 1 and re.fullmatch(r"[A-Z_][A-Z0-9_]*=\S+", words[0]):
            words.pop(0)
        program = re.match(r"\w*", words[0])[0]
        if program in PROGRAMS or re.fullmatch(r"python\d+", program):
            return _bash(command, "shell")
    return None


def parse_call(text: str | None) -> dict | None:
    """The first call of a text, by the order of notations."""
    text = text or ""
    for notation in NOTATIONS:
        for call in tagged_calls(text, notation):
            return call
    if (command := _fence(text, "bash|sh|shell", "(.*?)")) is not None:
        return _bash(command, "fence")
    if call := json_call(text):
        return call
    if opener := next((t for t in tags(text) if _is_function(t) and not t.closes), None):
        return {"tool_name": opener.value.strip(), "arguments": parameters(text[opener.end :]), "dialect": "partial"}
    if call := shell_line(text):
        return call
    if re.search(rf"\b(?:{'|'.join(FINISHING)})\b", text, re.I) and not any(sign in text for sign in FAILING):
        return {"tool_name": "finish", "arguments": {}, "dialect": "intent"}
    return None


def parse_all(text: str | None) -> list[dict]:
    """All complete calls in tagged notations, notation by notation."""
    return [c for n in NOTATIONS if n.label not in ("lenient", "named") for c in tagged_calls(text or "", n)]


_CALL = StructType([StructField(c, StringType()) for c in ("tool_name", "arguments", "dialect")])


def _row(call: dict | None) -> dict:
    return call | {"arguments": json.dumps(call["arguments"], ensure_ascii=False, sort_keys=True)} if call else dict.fromkeys(_CALL.names)


@F.pandas_udf(_CALL)
def parse_first_call(text: pd.Series) -> pd.DataFrame:
    """A struct of nulls where there is no call."""
    return pd.DataFrame([_row(parse_call(t)) for t in text], columns=_CALL.names, dtype=object)


@F.pandas_udf(ArrayType(_CALL))
def parse_all_calls(text: pd.Series) -> pd.Series:
    return pd.Series([[_row(c) for c in parse_all(t)] for t in text], dtype=object)


def call_summary(content: str | None) -> str:
    call = parse_call(content)
    return f"{call['tool_name']}({compact_arguments(call['arguments'])})" if call else "no tool call"


@F.pandas_udf(StringType())
def summarize_call(content: pd.Series) -> pd.Series:
    return pd.Series([call_summary(c) for c in content], dtype=object)
