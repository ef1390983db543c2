"""Byte-level BPE ids for batches of texts, with a bounded memo of their pieces."""

from __future__ import annotations

import functools
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import process_memo

DEFAULT_VOCABULARY = "byte_bpe_50k.json"
#: Entries of the memo; about 200 bytes each.
MEMO_ENTRIES = 400_000
#: Texts that are encoded at once.
BATCH_DOCS = 2000
#: Further cuts: behind a run of letters, and around a line feed between two other characters.
_CUTS = [("([A-Za-zÀ-ÖØ-öø-ÿ])([.,;:!?\n])", "\\1 \0\\2"), ("([.,;:!?])\n([^\\s])", "\\1 \0\n \0\\2")]


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    """Path of a public vocabulary file of this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class _Numbers(dict):
    """Words by number; a new one gets the next number and waits for its ids.

    A key stands for the word with a space before it, or after a NUL for the rest alone.
    """

    def __init__(self) -> None:
        super().__init__()
        self.next = 0
        self.waiting: list[str] = []

    def __missing__(self, key: str) -> int:
        n = self.next
        self[key] = n
        self.next = n + 1
        self.waiting.append(key)
        return n


def _cut(texts: pa.Array) -> pa.Array:
    """Texts with a space where one may be cut; a NUL after it tells that there was none."""
    led = pc.binary_join_element_wise("\0", texts, "")
    for pattern, cut in _CUTS:
        led = pc.replace_substring_regex(led, pattern=pattern, replacement=cut)
    return led


class PieceEncoder:
    """Encodes texts with a ``tokenizers`` vocabulary.

    The pre-tokenizer of byte-level BPE starts a new token at every single space that
    follows and precedes other characters, and where a run of letters ends, so a text may
    be cut there and each piece encoded alone, with the same ids. Arrow splits a batch's
    texts at spaces and numbers their distinct words; each of those is looked up once, and
    the ids of all words lie in one array by number, so the batch is one gather. When there
    are too many words the less used half is forgotten. Texts with runs of spaces, spaces
    at their ends, a NUL or a special token's ``<|`` are encoded whole. Empty texts have no
    ids.
    """

    def __init__(self, path: str | None = None, memo_entries: int = MEMO_ENTRIES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or vocabulary_path())
        self.memo_entries = memo_entries
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.leads = np.zeros(size, dtype=bool)  # ids whose token starts with a space
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.leads[i] = token.startswith("Ġ")
        self.vocab_size = size
        self.numbers = _Numbers()
        self.ids = np.zeros(0, np.uint32)  # of all pieces, one after the other
        self.sizes = np.zeros(0, np.int64)  # by number, as is the next
        self.uses = np.zeros(0, np.int64)

    def _direct(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]  # without offsets

    def _pieces(self, pieces: list[str]) -> list[np.ndarray]:
        """Encode pieces that start with their only space, many to a text."""
        out: list[np.ndarray] = []
        parts = [pieces[k : k + 256] for k in range(0, len(pieces), 256)]
        for part, ids in zip(parts, self._direct(["".join(p) for p in parts])):
            cuts = np.flatnonzero(self.leads[ids])
            if len(cuts) == len(part) and not cuts[0]:
                out += np.split(ids, cuts[1:])
            else:
                out += self._direct(part)
        return out

    def _learn(self) -> None:
        """Ids of the words that wait."""
        new = self.numbers.waiting
        led = [k for k in new if k[:1] != "\0"]
        rest = [k for k in new if k[:1] == "\0"]
        found = dict(zip(led, self._pieces([f" {k}" for k in led])))
        found.update(zip(rest, self._direct([k[1:] for k in rest])))
        self.ids = np.concatenate([self.ids, *(found[k] for k in new)])
        self.sizes = np.concatenate([self.sizes, np.fromiter((len(found[k]) for k in new), np.int64, len(new))])
        self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])
        self.numbers.waiting = []

    def _forget(self) -> None:
        """Keep the more used half of the pieces."""
        first = np.cumsum(self.sizes) - self.sizes
        keep = np.zeros(len(self.sizes), bool)
        keep[np.argsort(-self.uses, kind="stable")[: self.memo_entries // 2]] = True
        self.ids = self.ids[np.repeat(keep, self.sizes)]
        new = (np.cumsum(keep) - 1).tolist()
        kept = [(p, new[n]) for p, n in self.numbers.items() if keep[n]]
        self.numbers = _Numbers()
        self.numbers.update(kept)
        self.numbers.next = len(kept)
        self.sizes, self.uses = self.sizes[keep], self.uses[keep] // 2

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts`` in one array, and the offsets of each text's in it.

        ``end`` is an id after each text.
        """
        texts = texts.fill_null("")
        odd = functools.reduce(pc.or_, [pc.match_substring(texts, x) for x in ("  ", "<|", "\0")] + [pc.starts_with(texts, " "), pc.ends_with(texts, " ")])
        lists = pc.split_pattern(_cut(pc.if_else(odd, "", texts)), " ")
        edges = lists.offsets.to_numpy().astype(np.int64)
        words = lists.flatten()
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        find = self.numbers.__getitem__
        at = np.fromiter(map(find, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
        if self.numbers.waiting:
            self._learn()
        known = len(self.sizes)
        self.uses += np.bincount(at, minlength=known)
        whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        alone = self._direct(texts.take(pa.array(whole)).to_pylist())
        at[edges[:-1][whole]] = known + np.arange(len(whole))
        if end is not None:
            at = np.insert(at, edges[1:], known + len(whole))
            edges = edges + np.arange(len(edges))
        ends = np.array([] if end is None else [end], np.uint32)
        store = np.concatenate([self.ids, *alone, ends])
        size = np.concatenate([self.sizes, np.array([len(x) for x in alone], np.int64), [len(ends)]])
        n = size[at]
        flat = cut_out(store, (np.cumsum(size) - size)[at], n)
        offsets = np.concatenate([[0], np.cumsum(n)])[edges]
        if len(self.numbers) > self.memo_entries:
            self._forget()
        return flat, offsets


def encoder(path: str, memo_entries: int = MEMO_ENTRIES) -> PieceEncoder:
    """The encoder of this worker process."""
    return process_memo(("encoder", path, memo_entries), lambda: PieceEncoder(path, memo_entries))


def cut_out(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``values[f : f + s]`` of all pairs, one after the other."""
    before = np.cumsum(size) - size
    return values[np.repeat(first - before, size) + np.arange(int(size.sum()))]
