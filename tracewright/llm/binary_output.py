"""Token-id output: id blocks with Elias-Fano document boundaries.

A dataset is a folder of Parquet rows, one per block; Spark's writer commits them, so a
lost executor only repeats its task. A block is an opaque byte string that holds the ids
of consecutive documents, one after the other in ascending ``doc_id`` order, and two
monotone sequences in Elias-Fano form: the documents' end offsets and their ids. Both
take about ``2 + log2(universe / n)`` bits an entry; a sampled select directory answers
"where does document i start" without decoding the block and without a 64-bit table.

Defined cases: null text counts as empty and has the end id alone; rows with a null
``doc_id`` come first, in blocks of their own; repeated ids are kept one after the other,
in any order; an empty table gives an empty dataset. Other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, new_path, process_memo, shuffle_partitions, table
from .tokens import BATCH_DOCS, encoder, vocabulary_path

MAGIC = b"TWEF"
SELECT_EVERY = 64


class EliasFano:
    """A monotone sequence of non-negative integers."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, marks: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.marks = n, low_bits, low, high, marks

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        l = max(0, (max(top, 1) // max(n, 1)).bit_length() - 1)
        ones = (values >> np.uint64(l)).astype(np.int64) + np.arange(n)
        bits = np.zeros((int(ones[-1]) + 1) if n else 0, dtype=np.uint8)
        bits[ones] = 1
        low = ((values[:, None] >> np.arange(l, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        return cls(n, l, np.packbits(low.ravel(), bitorder="little"), np.packbits(bits, bitorder="little"), ones[::SELECT_EVERY].astype("<u4"))

    def select(self, i: int) -> int:
        """The i-th value: jump to the sampled mark before it and count ones from there."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.marks[i // SELECT_EVERY]), i % SELECT_EVERY
        byte = at // 8
        word = int(self.high[byte]) >> (at % 8) << (at % 8)
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        bit = byte * 8 + (word & -word).bit_length() - 1
        at = i * self.low_bits
        low = sum((int(self.low[(at + b) // 8]) >> ((at + b) % 8) & 1) << b for b in range(self.low_bits))
        return (bit - i) << self.low_bits | low

    def select_many(self, a: int, b: int) -> np.ndarray:
        """Values ``a`` to ``b - 1``: the bits from the mark before the first on, no others."""
        if not 0 <= a < b <= self.n:
            raise IndexError((a, b))
        mark, after = a // SELECT_EVERY, -(-b // SELECT_EVERY)
        start = int(self.marks[mark]) // 8
        end = int(self.marks[after]) // 8 + 1 if after < len(self.marks) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[start:end], bitorder="little")) + 8 * start
        ones = ones[ones >= self.marks[mark]][a - mark * SELECT_EVERY :][: b - a]
        out = (ones - np.arange(a, b)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            first = a * self.low_bits
            bits = np.unpackbits(self.low[first // 8 : -(-b * self.low_bits // 8)], bitorder="little")[first % 8 :][: (b - a) * self.low_bits]
            out |= (bits.reshape(b - a, self.low_bits).astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return out

    def all(self) -> np.ndarray:
        high = np.flatnonzero(np.unpackbits(self.high, bitorder="little")) - np.arange(self.n)
        out = high.astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            low = np.unpackbits(self.low, bitorder="little", count=self.n * self.low_bits).reshape(self.n, self.low_bits)
            out |= (low.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return out

    def to_bytes(self) -> bytes:
        return struct.pack("<QBQQQ", self.n, self.low_bits, len(self.low), len(self.high), len(self.marks)) + self.low.tobytes() + self.high.tobytes() + self.marks.tobytes()

    @classmethod
    def from_bytes(cls, raw: memoryview, at: int) -> tuple[EliasFano, int]:
        n, l, nl, nh, nm = struct.unpack_from("<QBQQQ", raw, at)
        at += struct.calcsize("<QBQQQ")
        low = np.frombuffer(raw, np.uint8, nl, at)
        high = np.frombuffer(raw, np.uint8, nh, at + nl)
        marks = np.frombuffer(raw, "<u4", nm, at + nl + nh)
        return cls(n, l, low, high, marks), at + nl + nh + 4 * nm


class Block:
    """Ids of consecutive documents; ``doc_ids`` are offset by the block's smallest id."""

    def __init__(self, raw: bytes):
        view = memoryview(raw)
        magic, self.width, self.null_ids, self.least = struct.unpack_from("<4sBBq", view, 0)
        if magic != MAGIC:
            raise ValueError("not a token block")
        at = struct.calcsize("<4sBBq")
        self.ends, at = EliasFano.from_bytes(view, at)
        self.ids_of_docs, at = EliasFano.from_bytes(view, at)
        self.tokens = np.frombuffer(view, f"<u{self.width}", -1, at)

    def __len__(self) -> int:
        return self.ends.n

    def span(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def document(self, i: int) -> np.ndarray:
        a, b = self.span(i)
        return self.tokens[a:b]

    def doc_id(self, i: int) -> int | None:
        return None if self.null_ids else self.least + self.ids_of_docs.select(i)

    @staticmethod
    def pack(doc_ids: list[int | None], ids: list[bytes], width: int) -> bytes:
        null_ids = bool(doc_ids) and doc_ids[0] is None
        least = 0 if null_ids else doc_ids[0]
        ends = np.cumsum([len(x) // width for x in ids])
        keys = np.zeros(len(ids), np.uint64) if null_ids else np.array([x - least for x in doc_ids], dtype=np.uint64)
        return struct.pack("<4sBBq", MAGIC, width, null_ids, least) + EliasFano.build(ends).to_bytes() + EliasFano.build(keys).to_bytes() + b"".join(ids)


def _encode(path: str, end_id: int, bounds: list[int], null_parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, edges = encoder(path), np.array(bounds, dtype=np.int64)
        width = 2 if max(enc.vocab_size - 1, end_id) < 2**16 else 4
        for batch in batches:
            for k in range(0, batch.num_rows, BATCH_DOCS):
                part = batch.slice(k, BATCH_DOCS)
                ids, drawn = part.column(0), part.column(2).to_numpy().view(np.uint64)
                flat, offsets = enc.encode(part.column(1), end_id)
                known = ids.fill_null(0).to_numpy()
                low, high = np.searchsorted(edges, known, side="left"), np.searchsorted(edges, known, side="right")
                # an id that is the bound of several ranges is dealt over all of them
                to = null_parts + low + (drawn % np.maximum(high - low, 1).astype(np.uint64)).astype(np.int64)
                to = np.where(ids.is_null().to_numpy(zero_copy_only=False), (drawn % np.uint64(max(null_parts, 1))).astype(np.int64), to)
                raw = pa.py_buffer(flat.astype(f"<u{width}"))
                binary = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer((offsets * width).astype(np.int32)), raw])
                yield pa.RecordBatch.from_arrays([ids, pa.array(to.astype(np.int32)), binary, pa.array(np.full(len(ids), width, np.int32))], names=["doc_id", "part", "ids", "width"])

    return run


def _blocks(block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        process_memo("blocks", dict)  # makes room: the encoder is done here
        held: list[tuple[int | None, bytes]] = []
        state = {"n": 0, "base": 0, "seq": 0, "part": 0, "width": 2}

        def flush() -> pa.RecordBatch:
            raw = Block.pack([i for i, _ in held], [x for _, x in held], state["width"])
            row = [state["part"], state["seq"], state["base"], len(held), state["n"], raw]
            state["base"] += state["n"]
            state["seq"] += 1
            state["n"] = 0
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["part", "seq", "base", "n_docs", "n_ids", "payload"])

        for batch in batches:
            for i, to, raw, width in zip(*(batch.column(c).to_pylist() for c in range(4))):
                n = len(raw) // width
                if held and (state["n"] + n > block_ids or (held[-1][0] is None) != (i is None)):
                    yield flush()
                held.append((i, raw))
                state.update(n=state["n"] + n, part=to, width=width)
        if held:
            yield flush()

    return run


def write_token_dataset(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, block_ids: int = 1 << 17) -> None:
    """Encode ``docs(doc_id, text)`` and write blocks of about ``block_ids`` ids.

    Texts are encoded where they lie; only ids are dealt out, by ranges of ``doc_id``
    whose bounds are quantiles of that column alone. An id that fills several ranges and
    the rows without an id are dealt over as many as they need. Each range is one task's
    block run, so its blocks hold one bounded group of documents at a time in memory.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    n = shuffle_partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total, given = rows.agg(F.count("*"), F.count("doc_id")).first()
    null_parts = -(-n * (total - given) // total) if total else 0
    bounds = rows.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.1 / n) if n > 1 and given else []
    (
        rows.select("doc_id", "text", F.xxhash64("text").alias("drawn"))
        .mapInArrow(_encode(vocabulary, end_id, sorted(int(b) for b in bounds), null_parts), "doc_id long, part int, ids binary, width int")
        .repartitionById(n + null_parts, F.col("part"))
        .sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "ids")
        .mapInArrow(_blocks(block_ids), "part int, seq long, base long, n_docs long, n_ids long, payload binary")
        .write.parquet(path)
    )


def read_token_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of a dataset with ``first``: the number of ids in all blocks before."""
    blocks = spark.read.schema("part int, seq long, base long, n_docs long, n_ids long, payload binary").parquet(path)
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()  # a row per range, not per document
    before, at = {}, 0
    for r in sorted(totals, key=lambda r: r.part):
        before[r.part] = at
        at += r.n
    start = F.create_map(*[F.lit(x) for p in before.items() for x in p])[F.col("part")] if before else F.lit(0)
    return blocks.withColumn("first", start.cast("long") + F.col("base"))


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            block, before = Block(raw), 0
            for a in range(0, len(block), 8 * SELECT_EVERY):
                b = min(len(block), a + 8 * SELECT_EVERY)
                ends = block.ends.select_many(a, b).astype(np.int64)
                starts = np.concatenate([[before], ends[:-1]]).astype(np.int64)
                before = int(ends[-1])
                crc = [zlib.crc32(block.tokens[i:j].astype("<u4")) for i, j in zip(starts.tolist(), ends.tolist())]
                ids = [None] * (b - a) if block.null_ids else block.ids_of_docs.select_many(a, b).view(np.int64) + block.least
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts + first), pa.array(ends - starts), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def document_index(spark: SparkSession, path: str) -> DataFrame:
    """Per document, decoded from the written blocks: place, length and checksum of its ids."""
    return read_token_dataset(spark, path).select("first", "payload").mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-ids")
    write_token_dataset(table(spark, sf_dir, "documents"), path, vocabulary_path(), end_id=0)
    return document_index(spark, path)
