"""The tokenizer interface of masks and windows, and a reversible one that needs no files."""

from __future__ import annotations

import re
from typing import Protocol

# The chat markup.
START, END = "<|im_start|>", "<|im_end|>"
_MARKERS = re.compile(f"({re.escape(START)}|{re.escape(END)})")


class Tokenizer(Protocol):
    def encode(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        """Ids and their character spans."""

    def decode(self, ids: list[int]) -> str: ...


class ByteTokenizer:
    """UTF-8 bytes from 2 on; the chat markers are 0 and 1. A character's bytes share its span."""

    def encode(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        ids, spans, at = [], [], 0
        for part in _MARKERS.split(text):
            end = at + len(part)
            if part in (START, END):
                ids.append((START, END).index(part))
                spans.append((at, end))
            else:
                raw = part.encode("utf-8", "surrogatepass")
                ids += [b + 2 for b in raw]
                if len(raw) == len(part):
                    spans += zip(range(at, end), range(at + 1, end + 1))
                else:
                    spans += [(at + k, at + k + 1) for k, c in enumerate(part) for _ in c.encode("utf-8", "surrogatepass")]
            at = end
        return ids, spans

    def decode(self, ids: list[int]) -> str:
        out = bytearray()
        for i in ids:
            out += (START, END)[i].encode() if i < 2 else bytes([i - 2])
        return out.decode("utf-8", "replace")


def render(messages: list[dict], prompt: bool = False) -> tuple[str, list[tuple[int, int]]]:
    """Chat text, and for each message the span of its content with the end marker."""
    text, spans = "", []
    for m in messages:
        text += f"{START}{m['role']}\n"
        begin = len(text)
        text += f"{m['content']}{END}"
        spans.append((begin, len(text)))
        text += "\n"
    return text + (f"{START}assistant\n" if prompt else ""), spans
