"""Assistant-only loss masks, length-bounded windows, their audits, and context compaction.

A conversation is a bounded group, so these run on rows of collected messages in Arrow
batches (``mapInPandas``), without a shuffle.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dialects import parse_call
from ..functions.toolcalls import CATALOG, compact_arguments, reason_a
from ..functions.tokenizers import ByteTokenizer, Tokenizer, render

MASKED = -100


class MaskError(ValueError):
    pass


def _span_mask(messages: list[dict], tokenizer: Tokenizer, trainable: set[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    text, contents = render(messages)
    ids, spans = tokenizer.encode(text)
    ids, at = np.array(ids, np.int32), np.array(spans, np.int64).reshape(-1, 2)
    labels = np.full(len(ids), MASKED, np.int32)
    for i, (m, (begin, end)) in enumerate(zip(messages, contents)):
        if m["role"] != "assistant" or (trainable is not None and i not in trainable):
            continue
        first, stop = np.searchsorted(at[:, 0], [begin, end])  # tokens that start in the span
        if first and at[first - 1, 1] > begin:
            raise MaskError(f"a token crosses the edge of an answer at {at[first - 1, 0]}")
        if stop > first and at[stop - 1, 1] > end:
            raise MaskError(f"a token crosses the edge of an answer at {at[stop - 1, 0]}")
        labels[first:stop] = ids[first:stop]
    return ids, labels


def span_mask(messages: list[dict], tokenizer: Tokenizer, trainable: set[int] | None = None) -> tuple[list[int], list[int]]:
    """Ids and labels: tokens inside a trainable assistant's content and end marker keep their id.

    A token across the edge of such a span is an error: no mask would be right for it.
    """
    ids, labels = _span_mask(messages, tokenizer, trainable)
    return ids.tolist(), labels.tolist()


def prefix_mask(messages: list[dict], tokenizer: Tokenizer, trainable: set[int] | None = None) -> tuple[list[int], list[int]]:
    """The same by lengths: prompt up to an answer against prompt with it."""
    ids, _ = tokenizer.encode(render(messages)[0])
    labels = [MASKED] * len(ids)
    for i, m in enumerate(messages):
        if m["role"] != "assistant" or (trainable is not None and i not in trainable):
            continue
        before = len(tokenizer.encode(render(messages[:i], prompt=True)[0])[0])
        whole = tokenizer.encode(render(messages[: i + 1])[0].removesuffix("\n"))[0]
        if ids[: len(whole)] != whole:
            raise MaskError(f"message {i} tokenizes differently in its context")
        labels[before : len(whole)] = ids[before : len(whole)]
    return ids, labels


def segment_mask(messages: list[dict], tokenizer: Tokenizer) -> tuple[list[int], list[int]]:
    """Message-wise ids, which must equal the whole's, and a 0/1 mask of answers without headers."""
    ids, action = [], []
    for m in messages:
        head = tokenizer.encode(render([m])[0][: render([m])[1][0][0]])[0]
        rest = tokenizer.encode(render([m])[0][render([m])[1][0][0] :])[0]
        ids += head + rest
        newline = len(tokenizer.encode("\n")[0])
        action += [0] * len(head) + [int(m["role"] == "assistant")] * (len(rest) - newline) + [0] * newline
    if ids != tokenizer.encode(render(messages)[0])[0]:
        raise MaskError("messages tokenize differently one by one")
    return ids, action


def windows(messages: list[dict], tokenizer: Tokenizer, most: int, overlap: int, trainable: set[int]) -> list[tuple[list[int], set[int]]]:
    """Message indices and trainable ones of each window of at most ``most`` ids.

    The messages before the first assistant open every window; from there on each assistant
    begins a unit. A window takes up to ``overlap`` units before it as context, fewer if not
    even one new unit would fit, and then as many new units as fit. Each trainable message
    trains in exactly one window.
    """
    starts = [i for i, m in enumerate(messages) if m["role"] == "assistant"]
    if not starts:
        raise MaskError("no assistant message")
    base = list(range(starts[0]))
    units = [list(range(a, b)) for a, b in zip(starts, [*starts[1:], len(messages)])]

    def size(chosen: list[int]) -> int:
        return len(tokenizer.encode(render([messages[i] for i in chosen])[0])[0])

    # chat text is a concatenation, so lengths of units add up
    fixed, lengths = size(base), [size(u) for u in units]
    if fixed + sum(lengths) <= most:
        return [(list(range(len(messages))), set(trainable))]
    out, at = [], 0
    while at < len(units):
        for back in range(min(overlap, at), -1, -1):
            room, end = most - fixed - sum(lengths[at - back : at]), at
            while end < len(units) and lengths[end] <= room:
                room -= lengths[end]
                end += 1
            if end > at:
                break
        else:
            raise MaskError(f"unit {at} alone is too long")
        fresh = [i for u in units[at:end] for i in u]
        out.append((base + [i for u in units[at - back : at] for i in u] + fresh, {i for i in fresh if i in trainable}))
        at = end
    return out


_WINDOW = (
    "trajectory_id string, window_index int, window_count int, token_count int, supervised_token_count int, "
    "input_ids array<int>, attention_mask array<tinyint>, labels array<int>, error string"
)


def window_records(conversations: DataFrame, tokenizer: Callable[[], Tokenizer] = ByteTokenizer, most: int = 32_768, overlap: int = 2) -> DataFrame:
    """Masked windows of ``conversations(trajectory_id, messages)``; answers that validator A
    rejects are context only. A conversation that can't be windowed gives one row with its error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = tokenizer()
        for pdf in parts:
            rows = []
            for tid, raw in zip(pdf["trajectory_id"], pdf["messages"]):
                messages = [dict(m) if isinstance(m, dict) else m.asDict() for m in raw]
                good = {i for i, m in enumerate(messages) if m["role"] == "assistant" and reason_a(m["content"]) is None}
                try:
                    found = windows(messages, tok, most, overlap, good)
                    for k, (chosen, train) in enumerate(found):
                        ids, labels = _span_mask([messages[i] for i in chosen], tok, {at for at, i in enumerate(chosen) if i in train})
                        rows.append((tid, k, len(found), len(ids), int((labels != MASKED).sum()), ids, np.ones(len(ids), np.int8), labels, None))
                except MaskError as e:
                    rows.append((tid, 0, 0, 0, 0, [], [], [], str(e)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _WINDOW.split(", ")])

    return conversations.select("trajectory_id", "messages").mapInPandas(run, _WINDOW)


def record_faults() -> Column:
    """What is wrong with a masked record: lengths, negative ids, labels, padding, nothing to learn."""
    ids, labels, mask = F.col("input_ids"), F.col("labels"), F.col("attention_mask")
    pair = F.arrays_zip(ids.alias("i"), labels.alias("l"), mask.alias("m"))
    return F.array_compact(F.array(
        F.when((F.size(ids) != F.size(labels)) | (F.size(ids) != F.size(mask)), "lengths"),
        F.when(F.exists(ids, lambda i: i < 0), "negative_id"),
        F.when(F.exists(pair, lambda p: (p["l"] != MASKED) & (p["l"] != p["i"])), "label_not_id"),
        F.when(F.exists(pair, lambda p: (p["m"] == 0) & (p["l"] != MASKED)), "padding_in_loss"),
        F.when(~F.exists(labels, lambda l: l != MASKED), "nothing_trainable"),
    ))


def token_audit(ids: list[int], labels: list[int], tokenizer: Tokenizer) -> list[str]:
    """Checks a mask from its ids alone: balanced markers, roles, whole answers or none, valid calls."""
    start, end = tokenizer.encode("<|im_start|>")[0], tokenizer.encode("<|im_end|>")[0]
    if len(start) != 1 or len(end) != 1:
        return ["markers_not_single_tokens"]
    faults, at = [], 0
    while at < len(ids):
        if ids[at] != start[0]:
            faults.append("no_start_marker")
            break
        try:
            stop = ids.index(end[0], at)
        except ValueError:
            faults.append("no_end_marker")
            break
        head = tokenizer.decode(ids[at + 1 : stop]).split("\n", 1)
        role, content = head[0], head[1] if len(head) > 1 else ""
        if role not in ("system", "user", "assistant"):
            faults.append("bad_role")
        skip = 1 + len(tokenizer.encode(role + "\n")[0])
        trained = [labels[i] != MASKED for i in range(at + skip, stop + 1)]
        if any(labels[i] != MASKED for i in range(at, at + skip)):
            faults.append("header_supervised")
        if any(trained) and not all(trained):
            faults.append("partly_supervised")
        if any(trained) and role != "assistant":
            faults.append("supervised_" + role)
        if all(trained) and role == "assistant" and reason_a(content):
            faults.append("invalid_call_supervised")
        at = stop + 1 + len(tokenizer.encode("\n")[0])
    return sorted(set(faults))


def audit_windows(records: DataFrame, tokenizer: Callable[[], Tokenizer] = ByteTokenizer) -> DataFrame:
    @F.pandas_udf("array<string>")
    def run(ids: pd.Series, labels: pd.Series) -> pd.Series:
        tok = tokenizer()
        return pd.Series([token_audit(list(i), list(l), tok) for i, l in zip(ids, labels)], dtype=object)

    return records.withColumn("faults", run("input_ids", "labels"))


def mask_totals(records: DataFrame) -> DataFrame:
    return records.agg(
        F.count("*").alias("windows"), F.count_distinct("trajectory_id").alias("conversations"), F.sum("token_count").cast("bigint").alias("tokens"), F.sum("supervised_token_count").cast("bigint").alias("supervised"),
        F.round(F.sum("supervised_token_count") / F.sum("token_count"), 6).alias("supervised_fraction"), F.min("supervised_token_count").alias("least_supervised"),
    )


def estimate(messages: list[dict]) -> int:
    return max(1, math.ceil(sum(len(m["role"]) + len(m["content"]) + 24 for m in messages) / 3.5))


def clip(text: str, n: int) -> str:
    return text if len(text) <= n else text[: max(0, n - 15)] + "...[clipped]..."[: max(0, min(15, n))]


def summarize(messages: list[dict], chars: int) -> str:
    """A line for each call and the first line of each observation."""
    out, step = [], 0
    for m in messages:
        text = m["content"] or ""
        if m["role"] == "assistant":
            step += 1
            call = parse_call(text)
            out.append(f"step {step}: called {call['tool_name']}({compact_arguments(call['arguments'])})" if call else f"step {step}: said {clip(text, 240)}")
        else:
            out.append(f"  saw: {clip((text.splitlines() or ['nothing'])[0], 220)}")
    return clip("\n".join(out) or "no earlier steps", chars)


def compact(messages: list[dict], most: int, turns: int = 6, chars: int = 6000, count: Callable[[list[dict]], int] = estimate) -> tuple[list[dict], bool]:
    """Messages within a budget: two at the start, a summary, and the last turns.

    While they are too long, the oldest turn goes, then long messages are clipped, then the
    last one is cut to the longest length that fits.
    """
    if count(messages) <= most:
        return messages, False
    if len(messages) <= 2:
        raise MaskError("the opening messages alone are over the budget")
    start, rest = messages[:2], messages[2:]
    keep = max(2, 2 * turns)
    note = {"role": "user", "content": "<WORKING_MEMORY>\n" + summarize(rest[:-keep], chars) + "\n</WORKING_MEMORY>"}
    recent = [dict(m) for m in rest[-keep:]]
    fixed = [*start, note]
    while len(recent) > 2 and count(fixed + recent) > most:
        recent.pop(0)
    if count(fixed + recent) > most:
        for m in recent[:-1]:
            m["content"] = clip(m["content"], 4000)
    if count(fixed + recent) > most:
        last, low, high = recent[-1]["content"], 0, len(recent[-1]["content"])
        while low < high:
            mid = (low + high + 1) // 2
            recent[-1]["content"] = clip(last, mid)
            low, high = (mid, high) if count(fixed + recent) <= most else (low, mid - 1)
        recent[-1]["content"] = clip(last, low)
    return fixed + recent, True


def compact_conversations(conversations: DataFrame, most: int, turns: int = 6, chars: int = 6000) -> DataFrame:
    """trajectory_id, compacted flag, token estimate, messages."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for tid, raw in zip(pdf["trajectory_id"], pdf["messages"]):
                messages = [dict(m) if isinstance(m, dict) else m.asDict() for m in raw]
                try:
                    out, was = compact(messages, most, turns, chars)
                    rows.append((tid, was, estimate(out), out, None))
                except MaskError as e:
                    rows.append((tid, False, estimate(messages), messages, str(e)))
            yield pd.DataFrame(rows, columns=["trajectory_id", "compacted", "tokens", "messages", "error"])

    return conversations.select("trajectory_id", "messages").mapInPandas(run, "trajectory_id string, compacted boolean, tokens int, messages array<struct<role:string,content:string>>, error string")


def tool_catalog_json() -> str:
    return json.dumps(CATALOG, sort_keys=True)
