"""Benchmark decontamination: n-gram hits counted by window, then Smith-Waterman alignment.

Words are lower-cased runs of letters and digits. A passage is a leak if its alignment's
matched words cover ``min_cover`` of the item and ``min_identity`` of the aligned stretch.
What a leak must have follows from the two: of ``m`` matched words with at most ``e`` other
columns, at least ``m - (n - 1) * (e + 1)`` n-grams are intact, within as many words as the
longest allowed alignment has. ``n`` is the largest (at most 3) that leaves one. All n-grams
of all items are looked up in the documents; only windows with that many hits, wherever
edits and insertions lie, are aligned. No leak of the thresholds is without a window.

The test items are the side that is sent to all tasks; its size is checked first. Items
beyond ``MAX_ITEM_BYTES`` are taken in as many blocks as needed, each within the bound,
with a pass run for each block: a stated query set against all rows. Documents are never
shuffled.

Defined cases: null and empty texts, on either side, match nothing; items of a few words
are looked up word by word; repeated items and rows each report their own match; null ids
pass through; an empty table on either side gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .common import bounded_batches, table, unused

MAX_ITEM_BYTES = 16 << 20
_WORD = re.compile(r"[^\W_]+")
MATCH, MISMATCH, GAP = 2, -1, -1
STEP = 5000  # words of a document that are looked up at once


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams(ws: list[str], n: int) -> list[tuple[str, ...]]:
    return [tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)] if len(ws) >= n else [tuple(ws)] if ws else []


def needs(length: int, min_cover: float, min_identity: float) -> tuple[int, int, int]:
    """(n, hits, span): a leak of an item has that many intact n-grams within ``span`` words."""
    least = max(1, math.ceil(min_cover * length - 1e-9))
    others = [math.floor(m / min_identity - m + 1e-9) for m in range(least, length + 1)]
    for n in (3, 2, 1):
        hits = min(m - (n - 1) * (e + 1) for m, e in enumerate(others, least))
        if hits > 0:
            return n, hits, math.floor(length / min_identity + 1e-9)
    raise AssertionError("a matched word is a hit")


class Index:
    """N-grams of items by their words' numbers, for look-ups of whole documents at once."""

    def __init__(self, wanted: dict[tuple[str, ...], list[int]], n: int):
        self.n = n
        self.numbers: dict[str, int] = {}
        for g in wanted:
            for w in g:
                self.numbers.setdefault(w, len(self.numbers) + 1)
        self.base = len(self.numbers) + 1
        codes = np.array([self._code(g) for g in wanted], dtype=np.int64)
        order = np.argsort(codes)
        lists = list(wanted.values())
        self.codes = codes[order]
        self.sizes = np.array([len(lists[k]) for k in order], dtype=np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.items = np.array([i for k in order for i in lists[k]], dtype=np.int64)
        # a first look in a bit table spares most positions the binary search
        self.bits = np.zeros(1 << 20, dtype=bool)
        self.bits[self.codes % (1 << 20)] = True

    def _code(self, gram: tuple[str, ...]) -> int:
        code = 0
        for w in gram:
            code = code * self.base + self.numbers[w]
        return (code + 2**63) % 2**64 - 2**63  # as 64-bit numbers run over; equal codes are only a hint

    def hits(self, ws: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Items and positions of every wanted n-gram of ``ws``, by item and position."""
        n = self.n
        if len(ws) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        get = self.numbers.get
        ids = np.array([get(w, 0) for w in ws], dtype=np.int64)
        code = np.zeros(len(ids) - n + 1, dtype=np.int64)
        known = np.ones(len(code), dtype=bool)
        for k in range(n):
            part = ids[k : k + len(code)]
            code = code * self.base + part
            known &= part > 0
        at = np.flatnonzero(known & self.bits[code % (1 << 20)])
        where = np.minimum(np.searchsorted(self.codes, code[at]), len(self.codes) - 1)
        same = self.codes[where] == code[at]
        at, where = at[same], where[same]
        size = self.sizes[where]
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        item, at = self.items[np.repeat(self.first[where], size) + step], np.repeat(at, size)
        order = np.argsort(item, kind="stable")
        return item[order], at[order]


def align(a: list[str], b: list[str], match: int = MATCH, mismatch: int = MISMATCH, gap: int = GAP) -> tuple[int, int, int, int, int]:
    """Best local alignment: matched words, aligned columns, start and end in ``a``, score.

    Row by row; each cell carries the alignment that ends there as its start and counts, so
    memory is a few rows and not a matrix.
    """
    codes: dict[str, int] = {}
    x = np.array([codes.setdefault(w, len(codes)) for w in a])
    y = np.array([codes.setdefault(w, len(codes)) for w in b])
    m = len(y)
    at, ramp = np.arange(m + 1), gap * np.arange(m + 1)
    score, matched, columns, start = (np.zeros(m + 1, np.int64) for _ in range(4))
    best = (0, 0, 0, 0, 0)
    for i, word in enumerate(x.tolist(), 1):
        equal = y == word
        across, down = score[:-1] + np.where(equal, match, mismatch), score[1:] + gap
        diagonal = across >= down
        value = np.concatenate([[0], np.where(diagonal, across, down)])
        new_matched = np.concatenate([[0], np.where(diagonal, matched[:-1] + equal, matched[1:])])
        new_columns = np.concatenate([[0], np.where(diagonal, columns[:-1], columns[1:]) + 1])
        new_start = np.concatenate([[i], np.where(diagonal, start[:-1], start[1:])])
        none = value <= 0
        value[none], new_matched[none], new_columns[none], new_start[none] = 0, 0, 0, i
        # gaps along the row: the cell that each one is best reached from
        origin = np.maximum.accumulate((value - ramp) * (m + 1) + at) % (m + 1)
        along = at - origin
        score, matched, columns, start = value[origin] + gap * along, new_matched[origin], new_columns[origin] + along, new_start[origin]
        j = int(score.argmax())
        if score[j] > best[4]:
            best = (int(matched[j]), int(columns[j]), int(start[j]), i, int(score[j]))
    return best


def _matcher(item_words: list[list[str]], item_ids: list, min_cover: float, min_identity: float):
    bags = [Counter(ws) for ws in item_words]
    of = {length: needs(length, min_cover, min_identity) for length in {len(ws) for ws in item_words}}
    n, least, span = (np.array(x, dtype=np.int64) for x in zip(*(of[len(ws)] for ws in item_words)))
    wanted: dict[int, dict[tuple[str, ...], list[int]]] = defaultdict(lambda: defaultdict(list))
    for k, ws in enumerate(item_words):
        for g in dict.fromkeys(grams(ws, int(n[k]))):
            wanted[int(n[k])][g].append(k)
    longest = int(span.max())
    # best score first; a passage that it bridges with too many other words is sought by harder ones
    weights = [(MATCH, MISMATCH, GAP), (1, -1, -1), (round(100 * (1 - min_identity)), *[-round(100 * min_identity)] * 2)]
    indexes = [Index(w, size) for size, w in wanted.items()]

    def windows(ws: list[str]) -> dict[int, list[list[int]]]:
        """Item -> stretches of ``ws`` that hold every passage with enough hits."""
        out: dict[int, list[list[int]]] = defaultdict(list)
        for index, start in itertools.product(indexes, range(0, len(ws), STEP)):
            item, at = index.hits(ws[start : start + STEP + longest])
            at = at + start
            last = np.arange(len(item)) + least[item] - 1
            inside = np.flatnonzero(last < len(item))
            last = last[inside]
            enough = (item[last] == item[inside]) & (at[last] + index.n - at[inside] <= span[item[inside]])
            for k, lo, hi in zip(item[inside][enough].tolist(), at[inside][enough].tolist(), at[last][enough].tolist()):
                width = int(span[k])
                # a passage with these hits starts and ends within its span around them
                lo, hi = max(0, hi + index.n - width), min(len(ws), lo + width)
                if out[k] and lo <= out[k][-1][1]:
                    out[k][-1][1] = max(hi, out[k][-1][1])
                else:
                    out[k].append([lo, hi])
        return out

    def matches(text: str) -> list[tuple]:
        """(item id, cover, first and last word, alignment score) of each leaked item, best passage."""
        ws = words(text)
        out = []
        for item, stretches in sorted(windows(ws).items()):
            target, best, width = item_words[item], None, int(span[item])
            for first, end in stretches:
                # long stretches in pieces; each passage is whole in one of them
                for lo in range(first, max(first + 1, end - width), 3 * width):
                    window = ws[lo : min(end, lo + 4 * width)]
                    if (Counter(window) & bags[item]).total() < min_cover * len(target) - 1e-9:
                        continue  # no alignment matches more words than both have
                    for w in weights:
                        matched, columns, a, b, score = align(window, target, *w)
                        cover, identity = matched / len(target), matched / max(columns, 1)
                        if cover < min_cover or identity >= min_identity:
                            break  # harder weights never match more words
                    score = MATCH * matched + GAP * (columns - matched)
                    if cover >= min_cover and identity >= min_identity and (best is None or score > best[4]):
                        best = (item_ids[item], cover, lo + a, lo + b, score)
            if best:
                out.append(best)
        return out

    return matches


def _report(matches):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "item_id", "cover", "start_word", "end_word", "alignment"]
        for batch in batches:
            at, found = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                for hit in matches(text) if text else ():
                    at.append(k)
                    found.append(hit)
            columns = list(zip(*found)) or [[]] * 5
            kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(list(c), t) for c, t in zip(columns, kinds))], names=names)

    return run


def _drop(matches):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not text or not matches(text) for text in batch.column(1).to_pylist()], pa.bool_()))

    return run


def _blocks(items: DataFrame) -> list[list]:
    """Items by blocks whose texts stay within ``MAX_ITEM_BYTES``, one block on the driver at a time."""
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-2 * total // MAX_ITEM_BYTES))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [items.where(part == k) for k in range(n)] if n > 1 else [items]


def _matchers(docs: DataFrame, benchmark: DataFrame, min_cover: float = 0.6, min_identity: float = 0.6) -> Iterator:
    """A matcher for each block of items."""
    bounded_batches(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull())
    for block in _blocks(items):
        rows = sorted(block.collect(), key=lambda r: (r.item_id is None, r.item_id or 0, r.text))
        kept = [(r.item_id, ws) for r in rows if (ws := words(r.text))]
        if kept:
            yield _matcher([ws for _, ws in kept], [i for i, _ in kept], min_cover, min_identity)


def _packed(docs: DataFrame) -> DataFrame:
    rest = [docs[c] for c in docs.columns if c != "text"]
    return docs.select(F.struct(*rest, F.lit(0).alias(unused(docs, "filler"))).alias("row"), "text")


def leaks(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """One row for each document and test item it leaks: doc_id, item_id and the alignment."""
    packed = _packed(docs.select("doc_id", "text"))
    found = StructType([packed.schema["row"], *(StructField(c, DoubleType() if c == "cover" else LongType()) for c in ("item_id", "cover", "start_word", "end_word", "alignment"))])
    parts = [packed.mapInArrow(_report(m), found) for m in _matchers(docs, benchmark, **parameters)]
    if not parts:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, cover double, start_word long, end_word long, alignment long")
    return functools.reduce(DataFrame.unionByName, parts).select(F.col("row.doc_id").alias("doc_id"), "item_id", "cover", "start_word", "end_word", "alignment")


def without_leaks(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` that leak no test item, with their columns; nothing is joined back."""
    out = _packed(docs)
    for matches in _matchers(docs, benchmark, **parameters):
        out = out.mapInArrow(_drop(matches), out.schema)
    return out.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
