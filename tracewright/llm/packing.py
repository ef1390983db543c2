"""Packing documents into fixed-length sequences: first-fit decreasing on a tournament tree.

Each document's ids (with the end id) are cut into full pieces of ``size`` ids and one
tail. Full pieces are sequences by themselves. Tails are dealt into randomised groups of
about ``group_docs`` documents; a group is packed alone, so any number of groups run in
parallel and a lost one is repeated alone. Inside a group tails go, longest first, into
the first bin with room; a tournament tree over the bins' free room finds it in
O(log n). Bins that stay less full than ``full_enough`` are emptied again and their ids
re-cut into whole sequences and power-of-two ones, which need no padding.

Defined cases: null and empty texts have the end id alone and are packed; null or
repeated ``doc_id`` values are separate documents; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import mix
from .common import bounded_batches, table
from .tokens import BATCH_DOCS, cut_out, encoder, vocabulary_path

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = [x.split()[0] for x in PIECES.split(", ")]
_SPREAD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


class FirstFit:
    """Bins of one capacity; each inner node keeps the larger free room of its children."""

    def __init__(self, capacity: int, bins: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """Index of the first bin with room for ``size``, whose room shrinks."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        room[at] -= size
        bin_ = at - self.leaves
        while at > 1:
            at //= 2
            room[at] = max(room[2 * at], room[2 * at + 1])
        return bin_


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices into ``sizes``; equal sizes keep their order."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    tree, bins = FirstFit(capacity, max(1, len(sizes))), []
    for i in order:
        b = tree.place(sizes[i])
        if b == len(bins):
            bins.append([])
        bins[b].append(i)
    return bins


def pack_group(sizes: list[int], capacity: int, full_enough: float) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (index, start within it, length), without gaps."""
    out, loose = [], []
    for b in first_fit_decreasing(sizes, capacity):
        fill = sum(sizes[i] for i in b)
        if fill >= full_enough * capacity or fill & (fill - 1) == 0:
            out.append([(i, 0, sizes[i]) for i in b])
        else:
            loose += b
    left = sum(sizes[i] for i in loose)
    lengths = [capacity] * (left // capacity) + [1 << k for k in range(capacity.bit_length() - 1, -1, -1) if left % capacity >> k & 1]
    at, done = 0, 0
    for length in lengths:
        seq = []
        while length:
            take = min(length, sizes[loose[at]] - done)
            seq.append((loose[at], done, take))
            length -= take
            done += take
            if done == sizes[loose[at]]:
                at, done = at + 1, 0
        out.append(seq)
    return out


def _encode(path: str, end_id: int, size: int, groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        width = 2 if max(enc.vocab_size - 1, end_id) < 2**16 else 4
        task = TaskContext.get().partitionId() if TaskContext.get() else 0
        copies: Counter[int] = Counter()
        for batch in batches:
            for k in range(0, batch.num_rows, BATCH_DOCS):
                part = batch.slice(k, BATCH_DOCS)
                ids, offsets = enc.encode(part.column(1), end_id)
                n = np.diff(offsets)
                raw = memoryview(ids.astype("<u4").tobytes())
                crcs = [[zlib.crc32(raw[4 * c : 4 * (c + size)]) for c in range(a, b - size + 1, size)] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                rest = n % size
                tails = cut_out(ids, offsets[1:] - rest, rest).astype(f"<u{width}")
                edges = np.concatenate([[0], np.cumsum(rest * width)]).astype(np.int32)
                binary = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(edges), pa.py_buffer(tails)])
                # equal rows can't be told apart, so it's all the same which is counted first
                nth = []
                for h in part.column(2).to_pylist():
                    nth.append(copies[h])
                    copies[h] += 1
                drawn = mix(part.column(2).to_numpy().view(np.uint64) + np.array(nth, np.uint64) * _SPREAD[0] + np.uint64(task) * _SPREAD[1])
                grp = (drawn % np.uint64(groups)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(grp), pa.array(n), pa.array(crcs, pa.list_(pa.int64())), binary, pa.array(np.full(len(n), width, np.int32))], names=["doc_id", "grp", "n", "crcs", "tail", "width"])

    return run


def _pack(size: int, full_enough: float):
    def run(group: pa.Table) -> pa.Table:
        ids, grps, n, crcs, tails, widths = (group.column(c).to_pylist() for c in ("doc_id", "grp", "n", "crcs", "tail", "width"))
        order = sorted(range(len(ids)), key=lambda i: (-len(tails[i]), ids[i] is None, ids[i] or 0, tails[i]))  # the same whatever order rows arrive in
        seq, rows = grps[0] << 32, []
        for i in order:
            for j, crc in enumerate(crcs[i]):
                rows.append((ids[i], j * size, size, crc, n[i], seq, 0))
                seq += 1
        held = [i for i in order if tails[i]]
        toks = [np.frombuffer(tails[i], f"<u{widths[i]}").astype("<u4") for i in held]
        for pieces in pack_group([len(t) for t in toks], size, full_enough):
            at = 0
            for j, a, length in pieces:
                i = held[j]
                rows.append((ids[i], n[i] - len(toks[j]) + a, length, zlib.crc32(toks[j][a : a + length].tobytes()), n[i], seq, at))
                at += length
            seq += 1
        return pa.table([pa.array(c, pa.int64()) for c in zip(*rows)], names=_NAMES)

    return run


def pack_documents(docs: DataFrame, vocabulary: str, size: int = 2048, end_id: int = 1, group_docs: int = 1024, full_enough: float = 0.97, seed: int = 17) -> DataFrame:
    """Pieces of every document with the sequence and offset they are packed at.

    The groups are drawn by a hash of id, text, task and how many equal rows the task had
    before, so they are random and even, also among copies, and the same if a task runs
    again. Only tails travel (at most ``2 * size`` bytes a document) with one checksum for
    each full piece.
    """
    bounded_batches(docs.sparkSession)
    groups = max(1, -(-docs.count() // group_docs))
    drawn = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")).alias("drawn")
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", drawn)
        .mapInArrow(_encode(vocabulary, end_id, size, groups), "doc_id long, grp long, n long, crcs array<long>, tail binary, width int")
        .groupBy("grp")
        .applyInArrow(_pack(size, full_enough), PIECES)
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary_path())
