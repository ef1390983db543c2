"""Substring removal by bytes: longest-previous-factor arrays.

A byte goes if a string of ``length`` bytes that covers it starts more than once in the
corpus. With ``keep_first`` the strings of the first document that has them stay;
without it every occurrence goes. Strings are judged on the input and never cross
documents.

In suffix order, the longest earlier match of a suffix is with the nearest neighbour on
either side whose position is smaller: its previous and next smaller positions. The longer
of the two common prefixes is its longest previous factor. With larger positions instead,
the same gives its longest next factor, the longest match that comes later. A string of
``length`` bytes starts elsewhere too if one of the two factors is that long. The corpus's
suffix order is made in partitions (see ``repeats``); ``factors`` reads both arrays off
each of them, and ``previous_factors`` off a whole text.

Defined cases: null texts are empty; a null id is larger than any other; repeated rows
repeat each other's strings; texts shorter than ``length`` bytes are unchanged; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .repeats import KEY, MAX_KINDS, Bytes, keyed, repeated_windows, spans_of
from .substring_dedup import covered

_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def suffix_array(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array by prefix doubling, and common prefixes of neighbours by Kasai's walk."""
    n = len(text)
    rank = np.frombuffer(text, np.uint8).astype(np.int64)
    k = 1
    order = np.argsort(rank, kind="stable")
    while n > 1:
        after = np.full(n, -1, np.int64)
        after[: n - k] = rank[k:] if k < n else after[:0]
        order = np.lexsort((after, rank))
        new = (rank[order][1:] != rank[order][:-1]) | (after[order][1:] != after[order][:-1])
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(new)])
        if rank[order[-1]] == n - 1 or k >= n:
            break
        k *= 2
    if n == 1:
        rank = np.zeros(1, np.int64)
    lcp, h = np.zeros(n, np.int64), 0
    for i in range(n):
        r = int(rank[i])
        if r:
            j = int(order[r - 1])
            while i + h < n and j + h < n and text[i + h] == text[j + h]:
                h += 1
            lcp[r] = h
            h = max(0, h - 1)
        else:
            h = 0
    return order, lcp


def _nearest(place: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Common prefix of each entry with the nearest one before it of a smaller ``place``, or -1.

    ``at`` is a candidate that all entries between it and its own exceed. One that is not
    smaller hands on its own candidate, so the steps double and a few rounds do.
    """
    n = len(place)
    at = np.arange(n) - 1
    least = lcp.copy()  # of all between the candidate and the entry
    open_ = np.flatnonzero((least >= 0) & (at >= 0))
    open_ = open_[place[at[open_]] > place[open_]]
    while len(open_):
        hop = at[open_]
        shared = np.minimum(least[open_], least[hop])
        at[open_], least[open_] = at[hop], shared
        open_ = open_[(shared >= 0) & (at[open_] >= 0)]
        open_ = open_[place[at[open_]] > place[open_]]
    return np.where(at >= 0, least, -1)


def factors(lcp: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longest previous and longest next factor of each suffix of a suffix order.

    ``lcp`` is each one's common prefix with the one before, -1 where a partition begins;
    ``place`` the positions of the suffixes in the text or corpus, all different.
    """
    ahead = np.append(lcp[1:], -1)[::-1]  # the same order read from its end
    back, mirrored = place[::-1], -place
    previous = np.maximum(_nearest(place, lcp), _nearest(back, ahead)[::-1])
    following = np.maximum(_nearest(mirrored, lcp), _nearest(mirrored[::-1], ahead)[::-1])
    return np.maximum(previous, 0), np.maximum(following, 0)


def matched_elsewhere(lcp: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    """Whether the longest previous or next factor of a suffix reaches ``length``.

    Suffixes that share less with both neighbours have shorter factors and are left out.
    """
    deep = lcp >= length
    near = np.flatnonzero(deep | np.append(deep[1:], False))
    out = np.zeros(len(lcp), bool)
    if len(near):
        previous, following = factors(np.where(deep[near], lcp[near], -1), place[near])
        out[near] = np.maximum(previous, following) >= length
    return out


def previous_factors(text: bytes) -> np.ndarray:
    """LPF: for each position the longest match that starts earlier."""
    order, lcp = suffix_array(text)
    out = np.zeros(len(order), np.int64)
    if len(order):
        lcp[0] = -1
        out[order] = factors(lcp, order)[0]
    return out


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for noid, kid, raw, packed in zip(*(batch.column(c).to_pylist() for c in range(4))):
            if packed:
                gone = covered(len(raw), spans_of(packed))
                n_spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                kept, n_gone = np.frombuffer(raw, np.uint8)[~gone].tobytes(), int(gone.sum())
            else:
                kept, n_gone, n_spans = raw, 0, 0
            out.append((None if noid else kid, len(raw), n_gone, n_spans, hashlib.sha256(kept).hexdigest(), kept))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 6, kinds)], names=[x.split()[0] for x in _OUT.split(", ")])


def remove_repeats(docs: DataFrame, length: int = 400, keep_first: bool = True, max_kinds: int = MAX_KINDS) -> DataFrame:
    """doc_id, counts, and the bytes of each row that are left."""
    rows = keyed(docs)
    spans, _ = repeated_windows(rows, Bytes, length, matched_elsewhere, earlier=keep_first, max_kinds=max_kinds)
    return rows.join(spans.hint("merge"), KEY, "left").select("noid", "kid", "text", "spans").mapInArrow(_remove, _OUT)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), keep_first=False).drop("kept")
