"""Windows that occur more than once, from anchors and the suffix orders of their groups.

The engine under the word and byte substring removers, which differ in their units, their
window length, in how they read a suffix order, and in what they remove.

1. A task cuts each text into segments (see ``anchors``): runs of windows with one anchor.
   Equal segments of a batch of documents are one row from here on, with the first of
   their places; the other places stay behind in the written table. A passage that a third
   of all documents copy is one row for each batch.
2. The rows meet by anchor, without texts or places. Anchors that occur once are done with;
   of the others only a small table is kept: how often a segment's kind occurs, where its
   first place is, and how many kinds its anchor has. If all occurrences of an anchor are
   equal, every window of them is repeated.
3. For each kind of the other anchors the content of its first place is fetched, and the
   kinds are grouped by anchor. The suffixes that start ``x`` units before the anchor and
   agree down to it are one partition, named by that prefix; its order and the longest
   common prefixes of neighbours (its subtree) follow from one order of the suffixes at the
   anchors and one of the reversed texts before them. The caller's ``read`` finds the
   repeated windows in it. Tasks take groups one batch after the other.
4. An anchor with more than ``max_kinds`` kinds is too large a group. Its prefixes are
   lengthened to the whole window: the windows themselves are the groups then, and they are
   combined by aggregation before they travel.
5. The windows' spans go back to all places of a kind, and from there to their documents.

Joins are by shuffle and merge at every size: both sides grow with the input.

Sizes: step 2 moves a row for half a window of text; a task of step 3 holds at most
``max_kinds`` contents of one anchor and a batch of smaller groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .anchors import byte_hashes, segments, word_hashes
from .common import bounded_batches, lookup, materialize, release

#: A row of the input: whether it has no id, its id (or a hash of the text), a hash of the text.
KEY = ["noid", "kid", "kh"]
_SEGMENT = "batch long, ah long, sh long, off int, ns int, cnt long, noid boolean, kid long, kh long, s0 int, more binary"
_KIND = "ah long, sh long, cnt long, noid boolean, kid long, kh long, at int, off int, ns int, content binary"
_WINDOW = "ah long, wh long, sh long, j int, cnt long, noid boolean, kid long"
_RUNS = "ah long, sh long, runs array<struct<j:int,len:int,noid:boolean,kid:long>>"
_SPANS = "noid boolean, kid long, kh long, spans binary"
_PLACE = np.dtype([("noid", "?"), ("kid", "<i8"), ("kh", "<i8"), ("s0", "<i4")])
_BATCH = 200_000  # segments that are combined at once
MAX_KINDS = 20_000  #: contexts of one anchor that a task takes, of at most two windows' length each


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.replace("<struct<", " ").split(", ")]


class Bytes:
    """Texts as UTF-8 bytes."""

    gram = 32

    @staticmethod
    def split(raw: bytes) -> tuple[bytes, np.ndarray]:
        return raw, byte_hashes(raw)

    @staticmethod
    def units(raw: bytes) -> bytes:
        return raw

    @staticmethod
    def cut(units: bytes, a: int, b: int) -> bytes:
        return units[a:b]

    @staticmethod
    def strings(contents: list[bytes]) -> tuple[list[bytes], int]:
        return contents, 1


class Words:
    """Texts as their words, joined by one space."""

    gram = 8

    @staticmethod
    def split(raw: bytes) -> tuple[list[bytes], np.ndarray]:
        words = raw.split()
        return words, word_hashes(words)

    @staticmethod
    def units(raw: bytes) -> list[bytes]:
        return raw.split()

    @staticmethod
    def cut(units: list[bytes], a: int, b: int) -> bytes:
        return b" ".join(units[a:b])

    @staticmethod
    def strings(contents: list[bytes]) -> tuple[list[bytes], int]:
        """Words numbered in order, four bytes each, so that byte order is word order."""
        lists = [c.split(b" ") for c in contents]
        number = {w: i for i, w in enumerate(sorted(set().union(*lists)))}
        return [np.fromiter(map(number.__getitem__, ws), ">u4", len(ws)).tobytes() for ws in lists], 4


def _combined(batch: int, keys: list[tuple], found: list[tuple]) -> pa.RecordBatch:
    """One row for each kind of a batch's segments, by its least place."""
    doc = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
    ah, sh, s0, off, ns = (np.concatenate(c) for c in zip(*found))
    places = np.zeros(len(doc), _PLACE)
    for name, values, kind in zip(KEY, zip(*keys), (bool, np.int64, np.int64)):
        places[name] = np.array(values, kind)[doc]
    places["s0"] = s0
    order = np.lexsort((s0, places["kh"], places["kid"], places["noid"], sh, ah))
    ah, sh, off, ns, places = ah[order], sh[order], off[order], ns[order], places[order]
    first = np.flatnonzero(np.concatenate([[True], (ah[1:] != ah[:-1]) | (sh[1:] != sh[:-1])]))
    cnt = np.diff(np.append(first, len(ah)))
    more: list[bytes | None] = [None] * len(first)
    for k in np.flatnonzero(cnt > 1).tolist():
        more[k] = places[first[k] + 1 : first[k] + cnt[k]].tobytes()
    columns = [np.full(len(first), batch), ah[first].view(np.int64), sh[first].view(np.int64), off[first].astype(np.int32), ns[first].astype(np.int32), cnt]
    arrays = [pa.array(c) for c in columns] + [pa.array(np.ascontiguousarray(places[c][first])) for c in (*KEY, "s0")]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(more, pa.binary())], names=_names(_SEGMENT))


def _segments(unit, length: int, batch_size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 24
        keys: list[tuple] = []
        found: list[tuple] = []
        held = 0
        for part in batches:
            for *key, raw in zip(*(part.column(c).to_pylist() for c in range(4))):
                units, hashes = unit.split(raw or b"")
                ah, at, first, n = segments(hashes, length, unit.gram)
                if not len(ah):
                    continue
                plain, width = (raw, 1) if unit is Bytes else (hashes.tobytes(), 8)
                digests = [xxhash.xxh3_64_intdigest(plain[width * a : width * (a + m + length - 1)]) for a, m in zip(first.tolist(), n.tolist())]
                # the place of the anchor belongs to the kind
                sh = np.array(digests, np.uint64) ^ ((at - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                keys.append(key)
                found.append((ah, sh, first, at - first, n))
                held += len(ah)
                if held >= batch_size:
                    yield _combined(batch, keys, found)
                    batch, held = batch + 1, 0
                    keys, found = [], []
        if held:
            yield _combined(batch, keys, found)

    return run


def _emit(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[x.split()[1]]) for c, x in zip(zip(*rows), schema.split(", "))], names=_names(schema))


def _fetch(unit, length: int):
    """The content of each segment that ``wanted`` names in a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for *key, raw, wanted in zip(*(batch.column(c).to_pylist() for c in range(5))):
                units = unit.units(raw)
                rows += [(w["ah"], w["sh"], w["cnt"], *key, w["s0"] + w["off"], w["off"], w["ns"], unit.cut(units, w["s0"], w["s0"] + w["ns"] + length - 1)) for w in wanted]
                if len(rows) > 5000:
                    yield _emit(rows, _KIND)
                    rows = []
            if rows:
                yield _emit(rows, _KIND)

    return run


def _whole_windows(unit, length: int):
    """The windows of each segment that ``wanted`` names in a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for noid, kid, _, raw, wanted in zip(*(batch.column(c).to_pylist() for c in range(5))):
                units = unit.units(raw)
                for w in wanted:
                    for j in range(w["ns"]):
                        digest = xxhash.xxh3_64_intdigest(unit.cut(units, w["s0"] + j, w["s0"] + j + length))
                        rows.append((w["ah"], digest - (digest >> 63 << 64), w["sh"], j, w["cnt"], noid, kid))
                    if len(rows) > 20_000:
                        yield _emit(rows, _WINDOW)
                        rows = []
            if rows:
                yield _emit(rows, _WINDOW)

    return run


def _common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int((x != y).argmax())


def suffix_order(groups: np.ndarray, strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of ``strings`` within their groups, and each one's common prefix with the one before.

    Units of ``width`` bytes; -1 where a group begins.
    """
    of = groups.tolist()
    order = sorted(range(len(strings)), key=lambda i: (of[i], strings[i]))
    lcp = np.full(len(order), -1, np.int64)
    for k in range(1, len(order)):
        i, j = order[k - 1], order[k]
        if of[i] == of[j]:
            lcp[k] = _common(strings[i], strings[j]) // width
    return np.array(order, np.int64), lcp


class RangeMin:
    """Least value of any range, by a table of ranges of powers of two."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= len(values):
            low = self.levels[-1]
            step = 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(low[:-step], low[step:]))

    def least(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of ``values[first:end]`` for each pair; ranges are not empty."""
        level = np.frexp((end - first).astype(float))[1] - 1
        out = np.empty(len(first), np.int64)
        for k in np.unique(level).tolist():
            own = level == k
            out[own] = np.minimum(self.levels[k][first[own]], self.levels[k][end[own] - (1 << k)])
        return out


def _reverse(string: bytes, width: int) -> bytes:
    return string[::-1] if width == 1 else np.frombuffer(string, ">u4")[::-1].tobytes()


def subtrees(unit, groups: np.ndarray, contents: list[bytes], off: np.ndarray, ns: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(x, order, lcp): the suffixes that start ``x`` units before their anchors, in suffix
    order within their partition, and the common prefix of each with the one before.

    Suffixes are of one partition if they are equal down to the anchor; -1 is where one
    begins. A common prefix ends with the shorter content at the latest.
    """
    strings, width = unit.strings(contents)
    before = [_reverse(s[: width * int(o)], width) for s, o in zip(strings, off)]
    after = [s[width * int(o) :] for s, o in zip(strings, off)]
    by_left, lcp_left = suffix_order(groups, before, width)
    by_right, lcp_right = suffix_order(groups, after, width)
    size = len(contents)
    left, right = np.empty(size, np.int64), np.empty(size, np.int64)
    right[by_right] = np.arange(size)
    shared = RangeMin(lcp_right)
    for x in range(int((off - ns + 1).min()), int(off.max()) + 1):
        have = np.flatnonzero((off >= x) & (x > off - ns))
        if not len(have):
            continue
        left[by_left] = np.cumsum(lcp_left < x)
        order = have[np.argsort(left[have] * (size + 1) + right[have])]
        lcp = np.full(len(order), -1, np.int64)
        same = np.flatnonzero(left[order[1:]] == left[order[:-1]])
        if len(same):
            lcp[same + 1] = x + shared.least(right[order[same]] + 1, right[order[same + 1]] + 1)
        yield x, order, lcp


def repeated_starts(read: Callable, unit, groups, contents, off, ns, cnt, least, place, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, window, least document) of each window that occurs at least twice.

    ``read(lcp, place, length)`` tells of a suffix order which suffixes share ``length``
    units with another one. Windows are numbered from the first of their segment.
    """
    out: list[list[np.ndarray]] = [[], [], []]
    for x, order, lcp in subtrees(unit, groups, contents, off, ns):
        first = np.flatnonzero(lcp < length)
        smallest = np.repeat(np.minimum.reduceat(least[order], first), np.diff(np.append(first, len(order))))
        twice = (cnt[order] > 1) | read(lcp, place[order], length)
        which = order[twice]
        for column, values in zip(out, (which, off[which] - x, smallest[twice])):
            column.append(values)
    return tuple(np.concatenate([np.zeros(0, np.int64), *c]) for c in out)


def runs_of(which: np.ndarray, window: np.ndarray, least: np.ndarray, size: int) -> list[list[tuple[int, int, int]]]:
    """Maximal runs (first, number, least document) of consecutive windows, by segment."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(size)]
    if not len(which):
        return out
    order = np.lexsort((window, which))
    which, window, least = which[order], window[order], least[order]
    new = np.concatenate([[True], (which[1:] != which[:-1]) | (window[1:] != window[:-1] + 1) | (least[1:] != least[:-1])])
    first = np.flatnonzero(new)
    for k, n in zip(first.tolist(), np.diff(np.append(first, len(which))).tolist()):
        out[which[k]].append((int(window[k]), n, int(least[k])))
    return out


def _resolve(unit, length: int, read: Callable, batch_bytes: int = 4 << 20):
    """Groups, sorted by anchor, batch after batch."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        rows = list({r[:2]: r for r in rows}.values())  # repeated rows fetch a segment once each
        ah, sh, cnt, noid, kid, kh, at, off, ns, contents = (list(c) for c in zip(*rows))
        groups = np.unique(np.array(ah, np.int64), return_inverse=True)[1]
        ids = sorted(set(zip(noid, kid)))
        number = {i: k for k, i in enumerate(ids)}
        least = np.array([number[i] for i in zip(noid, kid)])
        place = np.empty(len(rows), np.int64)
        place[np.lexsort((at, kh, least))] = np.arange(len(rows))
        found = repeated_starts(read, unit, groups, contents, np.array(off), np.array(ns), np.array(cnt), least, place, length)
        runs = [[{"j": j, "len": n, "noid": ids[m][0], "kid": ids[m][1]} for j, n, m in of] for of in runs_of(*found, len(rows))]
        kind = pa.list_(pa.struct([("j", pa.int32()), ("len", pa.int32()), ("noid", pa.bool_()), ("kid", pa.int64())]))
        return pa.RecordBatch.from_arrays([pa.array(ah, pa.int64()), pa.array(sh, pa.int64()), pa.array(runs, kind)], names=["ah", "sh", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held >= batch_bytes and row[0] != rows[-1][0]:
                    yield solve(rows)
                    rows, held = [], 0
                rows.append(row)
                held += len(row[-1])
        if rows:
            yield solve(rows)

    return run


def _spread(length: int, earlier: bool, most: int = 20_000):
    """Runs of a kind -> spans (start, size) of each place they hold for, by document.

    With ``earlier`` a window counts only where a smaller document has it.
    """

    def emit(spans: dict[tuple, list[int]]) -> pa.RecordBatch:
        return _emit([(*key, np.array(s, "<i4").tobytes()) for key, s in spans.items()], _SPANS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans: dict[tuple, list[int]] = {}
        for batch in batches:
            for *key, s0, more, runs in zip(*(batch.column(c).to_pylist() for c in range(6))):
                for noid, kid, kh, at in ((*key, s0), *(np.frombuffer(more, _PLACE).tolist() if more else ())):
                    for r in runs:
                        if not earlier or (r["noid"], 0 if r["noid"] else r["kid"]) < (noid, 0 if noid else kid):
                            spans.setdefault((noid, kid, kh), []).extend((at + r["j"], r["len"] + length - 1))
                if len(spans) >= most:
                    yield emit(spans)
                    spans = {}
        if spans:
            yield emit(spans)

    return run


def keyed(docs: DataFrame) -> DataFrame:
    """KEY and the text as bytes.

    Ids may be null or repeated, so a 64-bit hash of the text tells rows apart; without an
    id there are two. Rows that agree in all three are copies of each other.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    given = F.col("doc_id").cast("long")
    return docs.select(given.isNull().alias("noid"), F.coalesce(given, F.xxhash64(F.lit("row"), text)).alias("kid"), F.xxhash64(text).alias("kh"), text.cast("binary").alias("text"))


def repeated_windows(rows: DataFrame, unit, length: int, read: Callable, earlier: bool, max_kinds: int = MAX_KINDS, batch_size: int = _BATCH) -> tuple[DataFrame, list[str]]:
    """KEY and ``spans``: packed (start, size) pairs of the windows of ``rows`` (see ``keyed``)
    that occur twice or more anywhere, or with ``earlier`` in a document with a smaller id.

    Also the paths of the tables it reads, to be released after use.
    """
    bounded_batches(rows.sparkSession)
    segs, segs_path = materialize(rows.mapInArrow(_segments(unit, length, batch_size), _SEGMENT), "segments")
    anchor, kind = Window.partitionBy("ah"), Window.partitionBy("ah", "sh")
    met = (
        segs.drop("more")
        .repartition("ah")
        .withColumn("nth", F.row_number().over(kind.orderBy(*KEY, "s0")))
        .withColumn("total", F.sum("cnt").over(kind))
        .withColumn("least", F.min(F.struct("noid", "kid")).over(kind))
        .withColumn("kinds", F.sum((F.col("nth") == 1).cast("long")).over(anchor))
        .withColumn("times", F.sum("cnt").over(anchor))
        .where("times > 1")
    )
    met, met_path = materialize(met.drop("times"), "shared-segments")
    # all occurrences are equal: every window of the segment is repeated
    whole = met.where("kinds = 1").withColumn("runs", F.array(F.struct(F.lit(0).alias("j"), F.col("ns").alias("len"), "least.noid", "least.kid")))
    found = met.where("kinds > 1").join(_runs(rows, met, unit, length, read, max_kinds).hint("merge"), ["ah", "sh"])
    held = ["batch", "ah", "sh", "cnt", *KEY, "s0", "runs"]
    verdicts = whole.select(held).unionByName(found.select(held))
    more = segs.where("cnt > 1").select("batch", "ah", "sh", "more")
    alone = verdicts.where("cnt = 1").select(*KEY, "s0", F.lit(None).cast("binary").alias("more"), "runs")
    copied = verdicts.where("cnt > 1").join(more.hint("merge"), ["batch", "ah", "sh"]).select(*KEY, "s0", "more", "runs")
    spans = alone.unionByName(copied).mapInArrow(_spread(length, earlier), _SPANS)
    return spans.groupBy(*KEY).agg(F.collect_list("spans").alias("spans")), [segs_path, met_path]


def _runs(rows: DataFrame, met: DataFrame, unit, length: int, read: Callable, max_kinds: int) -> DataFrame:
    """The runs of repeated windows of each kind whose anchor has several kinds."""
    place = F.struct("ah", "sh", F.col("total").alias("cnt"), "s0", "off", "ns")

    def fetched(which: str, function, schema: str) -> DataFrame:
        wanted = met.where(which).where("nth = 1").select(*KEY, place.alias("w")).groupBy(*KEY).agg(F.collect_list("w").alias("wanted"))
        return rows.join(wanted.hint("merge"), KEY).select(*KEY, "text", "wanted").mapInArrow(function, schema)

    contents = fetched(f"kinds > 1 and kinds <= {max_kinds}", _fetch(unit, length), _KIND)
    runs = contents.repartition("ah").sortWithinPartitions("ah").mapInArrow(_resolve(unit, length, read), _RUNS)
    if not met.where(F.col("kinds") > max_kinds).take(1):
        return runs
    windows, _ = materialize(fetched(f"kinds > {max_kinds}", _whole_windows(unit, length), _WINDOW).distinct(), "windows")
    least = windows.groupBy("ah", "wh").agg(F.sum("cnt").alias("times"), F.min(F.struct("noid", "kid")).alias("least")).where("times > 1").drop("times")
    run = F.struct("j", F.lit(1).alias("len"), F.col("least.noid").alias("noid"), F.col("least.kid").alias("kid"))
    hot = lookup(windows, least, ["ah", "wh"]).groupBy("ah", "sh").agg(F.collect_list(run).alias("runs"))
    return runs.unionByName(hot)


def spans_of(packed: list[bytes] | None) -> np.ndarray:
    """(start, size) rows of a document's packed spans."""
    return np.frombuffer(b"".join(packed or ()), "<i4").reshape(-1, 2)
