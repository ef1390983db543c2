"""Substring removal by words: prefix-partitioned suffix trees.

A window is ``length`` consecutive words of one document. A word goes if a window that
covers it also starts in a document with a smaller id; windows are judged on the input.

Suffixes are partitioned by prefixes of different lengths, those that end with the
window's anchor: the suffixes of one partition begin alike down to the anchor, and all
windows that could be equal meet in one partition. Where an anchor's partitions are too
large for a task, their prefixes are lengthened to the whole window. A partition is a
subtree of the generalised suffix tree of the corpus, built as the sorted order of its
suffixes with the depths between neighbours (see ``repeats``). ``deep_nodes`` gives its
topmost inner nodes at least ``length`` words deep: the leaves below such a node are the
places of a maximal repeat, and the least document among them is where it stays.

Defined cases: null and empty texts have no words; documents with a null id count as
larger than any id, so they lose words but cause no removal; repeated ids are not smaller
than each other, so their rows keep what only they share; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .repeats import KEY, MAX_KINDS, Words, keyed, repeated_windows, spans_of

_OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def deep_nodes(lcp: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first leaf, number of leaves, depth) of the topmost inner nodes at least ``length`` deep.

    ``lcp`` are the depths of the nodes between neighbouring leaves; a node's own depth is
    the least one below it.
    """
    first = np.flatnonzero(lcp < length)
    leaves = np.diff(np.append(first, len(lcp)))
    inner = leaves > 1
    if not inner.any():
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = np.where(lcp < length, np.iinfo(np.int64).max, lcp)
    return first[inner], leaves[inner], np.minimum.reduceat(inside, first)[inner]


def below_deep_nodes(lcp: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    """Whether a leaf is below a node at least ``length`` deep."""
    first, leaves, _ = deep_nodes(lcp, length)
    edge = np.zeros(len(lcp) + 1, np.int64)
    edge[first] += 1
    np.subtract.at(edge, first + leaves, 1)
    return np.cumsum(edge)[:-1] > 0


def covered(n: int, spans: np.ndarray) -> np.ndarray:
    """Which of ``n`` units lie in one of the spans (start, size)."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, spans[:, 0], 1)
    np.subtract.at(depth, np.minimum(n, spans.sum(axis=1)), 1)
    return np.cumsum(depth)[:n] > 0


def _remove(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for noid, kid, raw, packed in zip(*(batch.column(c).to_pylist() for c in range(4))):
                words = raw.split()
                n_gone = 0
                if packed:
                    gone = covered(len(words), spans_of(packed))
                    n_gone = int(gone.sum())
                    kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
                else:
                    kept = b" ".join(words)
                out.append((None if noid else kid, len(words), n_gone, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if with_text else None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 5, kinds)], names=[x.split()[0] for x in _OUT.split(", ")])

    return run


def remove_repeats(docs: DataFrame, length: int = 50, with_text: bool = True, max_kinds: int = MAX_KINDS) -> DataFrame:
    """doc_id, counts, and what is left of each row's words, joined by one space."""
    rows = keyed(docs)
    spans, _ = repeated_windows(rows, Words, length, below_deep_nodes, earlier=True, max_kinds=max_kinds)
    return rows.join(spans.hint("merge"), KEY, "left").select("noid", "kid", "text", "spans").mapInArrow(_remove(with_text), _OUT)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False).drop("kept_text")
