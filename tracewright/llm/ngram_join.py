"""N-gram Jaccard join: prefix-tree join over globally ordered shingle sets.

Exact at the threshold: two documents link if ``den * |x & y| >= num * |x | y|`` of their
sets of five-word shingles. ``jaccard_components`` gives each document's component,
``jaccard_join`` also its class and number of links, and every link of two classes.

1. *Sets.* A task turns its documents into sets of 64-bit shingle hashes. Equal sets of a
   task are one class from here on, so groups of exact copies shrink before any shuffle.
   Shingles travel as packed arrays, eight bytes each, dealt into buckets by hash.
2. *Global order.* A bucket counts in how many classes each of its shingles occurs and
   returns those of two or more to their task's batch: rare first, then by hash. A class
   with too few shared shingles to reach the threshold is alone and leaves here; on texts
   that are mostly unique this is most of the input.
3. *Prefixes.* By the order, two linked sets share a shingle of their prefixes, the first
   ``n - ceil(t n) + 1`` entries. Shingles of one class only come first in the order and
   match nothing, so prefixes keep just what is left after them.
4. *Stars.* Within a prefix shingle, every set is a candidate of the least set. Each set
   is verified against the one least set it shares most prefix shingles with. One tree
   walk serves all of a star's sets; large stars are salted over tasks.
5. *The rest.* Only pairs from different components that share a prefix shingle, and pass
   the size and remaining-length bounds at it, are still open; they are verified the same
   way. Pairs inside a component are never formed, so a group of thousands of near copies
   costs its stars. The sets of a frequent prefix shingle are compared by their sizes and
   remaining lengths in one task, or in pairs of blocks of ``few``. Only if fewer pairs
   than sets are left open do those become rows; else the sets themselves travel, and one
   tree walks them all: each against the open sets of other components only, which are joined at the first
   link, so what comes out is a forest. Components are then joined over all links.
6. *All links* (``jaccard_join``). Both ends of a link are in one component, so the sets of
   a component are compared with each other, in pairs of blocks where it is large. Links
   are between classes of equal sets; the members of a class are linked by its class id.

Verification is the tree walk of the name: a star's sets, in global order, form a trie;
the walk carries the overlap with the centre down shared prefixes and leaves a subtree as
soon as overlap plus remaining length can't reach the needed overlap.

Memory: a bucket of about four million shingles, a batch, or a salted star. The one thing
a bucket can't split is a single shingle's list, eight bytes for each class it is in.
Shingles are compared by 48 bits of hash and those that name the bucket (56 at most from
there on); two texts differ in far more shingles than collide.

Defined cases: null and empty texts have the empty set and link with nothing; fewer than
five words are one shingle; rows with one id and different texts are separate documents;
a null id is never a representative and has a null component unless its set links to that
of a row with an id; an empty table gives no rows; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import functools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .anchors import mix, word_hashes
from .common import bounded_batches, lookup, materialize, release, shuffle_partitions, table
from .components import connected_components

_M1 = np.uint64(0x9E3779B97F4A7C15)
_LOW56 = np.uint64((1 << 56) - 1)
STAR = 500  # sets of a star that one task walks
PAIRED = 32  # open sets of a prefix shingle that are paired by a join
BLOCK = 2_000_000  # shingles of a block of sets
_MEMBER = np.dtype([("noid", "?"), ("id", "<i8"), ("kh", "<i8")])


def shingle_set(raw: bytes, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles."""
    words = raw.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    w = min(n, width)
    code = np.full(n - w + 1, w, np.uint64)
    for k in range(w):
        code = (code + h[k : k + len(code)]) * _M1
        code ^= code >> np.uint64(32)
    return np.unique(mix(code))


def _least(num: int, den: int, n: int) -> int:
    return -(-num * n // den)


def _needed(num: int, den: int, a: int, b: int) -> int:
    """Least overlap of two linked sets of these sizes."""
    return -(-num * (a + b) // (num + den))


_BUCKETED = "key int, batch long, kind int, payload binary"
_NAMES = ["key", "batch", "kind", "payload"]


def _table(keys: list[int], batches: list[int], kinds: list[int], payloads: list[bytes]) -> pa.Table:
    return pa.table([pa.array(keys, pa.int32()), pa.array(batches, pa.int64()), pa.array(kinds, pa.int32()), pa.array(payloads, pa.binary())], names=_NAMES)


def _shingle(bits: int, batch_docs: int, batch_tokens: int):
    """Texts -> per batch: a directory of its classes (kind 1) and shingles by bucket (kind 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 24
        seq = 0
        ids: list[tuple] = []
        of: list[int] = []
        classes: dict[tuple[int, int, int], int] = {}
        sets: list[np.ndarray] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal seq, held
            batch = task + seq
            sizes = np.array([len(s) for s in sets], np.int64)
            tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            owner = np.repeat(np.arange(len(sets), dtype=np.uint64), sizes)
            order = np.argsort(tokens)
            tokens, owner = tokens[order], owner[order]
            bucket = (tokens >> np.uint64(64 - bits)).astype(np.int64)
            packed = ((tokens << np.uint64(bits)) >> np.uint64(16)) << np.uint64(16) | owner
            edges = np.searchsorted(bucket, np.arange((1 << bits) + 1)).tolist()
            filled = [b for b in range(1 << bits) if edges[b] < edges[b + 1]]
            digests = np.array(list(classes), np.uint64).reshape(-1, 3)
            directory = struct.pack("<II", len(ids), len(classes)) + np.array(ids, _MEMBER).tobytes() + np.array(of, "<u4").tobytes() + digests.astype("<u8").tobytes()
            out = _table([batch % (1 << bits), *filled], [batch] * (1 + len(filled)), [1] + [0] * len(filled), [directory] + [packed[edges[b] : edges[b + 1]].astype("<u8").tobytes() for b in filled])
            seq, held = seq + 1, 0
            for x in (ids, of, classes, sets):
                x.clear()
            yield from out.to_batches()

        for part in batches:
            for i, raw, kh in zip(*(part.column(c).to_pylist() for c in range(3))):
                s = shingle_set(raw or b"")
                digest = (len(s), int(s.sum(dtype=np.uint64)), int(mix(s * _M1).sum(dtype=np.uint64)))
                if digest not in classes:
                    classes[digest] = len(classes)
                    sets.append(s)
                    held += len(s)
                ids.append((i is None, i or 0, kh))
                of.append(classes[digest])
                if len(sets) >= batch_docs or held >= batch_tokens or len(ids) >= 20 * batch_docs:
                    yield from flush()
        if ids:
            yield from flush()

    return run


def _count(bits: int):
    """A bucket's shingles -> those in two or more classes, with their order byte, by batch."""

    def run(group: pa.Table) -> pa.Table:
        kinds = group.column("kind").to_pylist()
        batches = group.column("batch").to_pylist()
        payloads = group.column("payload").to_pylist()
        key = group.column("key")[0].as_py()
        at = [k for k, kind in enumerate(kinds) if kind == 0]
        out_batches, out_kinds, out = [b for b, k in zip(batches, kinds) if k], [1] * (len(kinds) - len(at)), [p for p, k in zip(payloads, kinds) if k]
        if at:
            parts = [np.frombuffer(payloads[k], "<u8") for k in at]
            entries = np.concatenate(parts)
            source = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
            order = np.argsort(entries)
            shingle = entries[order] >> np.uint64(16)
            first = np.flatnonzero(np.concatenate([[True], shingle[1:] != shingle[:-1]]))
            times = np.diff(np.append(first, len(shingle)))
            count = np.empty(len(entries), np.int64)
            count[order] = np.repeat(times, times)
            rare = np.minimum(255, np.floor(8 * np.log2(np.maximum(count, 1)))).astype(np.uint8)
            shared = count > 1
            bounds = np.searchsorted(source, np.arange(len(parts) + 1))
            for j, k in enumerate(at):
                own = slice(bounds[j], bounds[j + 1])
                keep = shared[own]
                if keep.any():
                    e, q = entries[own][keep], rare[own][keep]
                    # rank: order byte, then 56 bits of the hash that all tasks agree on
                    full = (e >> np.uint64(16)) << np.uint64(16) if bits == 0 else (np.uint64(key) << np.uint64(64 - bits)) | ((e >> np.uint64(16)) << np.uint64(16) >> np.uint64(bits))
                    rank = (q.astype(np.uint64) << np.uint64(56)) | (mix(full) & _LOW56)
                    out_batches.append(batches[k])
                    out_kinds.append(0)
                    out.append(struct.pack("<I", len(rank)) + rank.astype("<u8").tobytes() + (e & np.uint64(0xFFFF)).astype("<u2").tobytes())
        return _table([key] * len(out), out_batches, out_kinds, out)

    return run


_CLASSES = "rep struct<noid:boolean,id:long,kh:long>, times long, members array<long>, n long, d1 long, d2 long, shared long, ranks binary"


def _assemble(num: int, den: int):
    """A batch's directory and shared shingles -> its classes; ``ranks`` only where a link is possible."""

    def run(group: pa.Table) -> pa.Table:
        directory, ranks, owners = b"", [np.zeros(0, np.uint64)], [np.zeros(0, np.uint16)]
        for kind, raw in zip(group.column("kind").to_pylist(), group.column("payload").to_pylist()):
            if kind:
                directory = raw
                continue
            (n,) = struct.unpack_from("<I", raw)
            ranks.append(np.frombuffer(raw, "<u8", n, 4))
            owners.append(np.frombuffer(raw, "<u2", n, 4 + 8 * n))
        docs, classes = struct.unpack_from("<II", directory)
        wide = _MEMBER.itemsize
        ids = np.frombuffer(directory, _MEMBER, docs, 8)
        of = np.frombuffer(directory, "<u4", docs, 8 + wide * docs)
        digests = np.frombuffer(directory, "<u8", 3 * classes, 8 + (wide + 4) * docs).reshape(-1, 3)
        rank, owner = np.concatenate(ranks), np.concatenate(owners)
        order = np.lexsort((rank, owner))
        rank, owner = rank[order], owner[order]
        bounds = np.searchsorted(owner, np.arange(classes + 1))
        by_class = np.argsort(of, kind="stable")
        cuts = np.searchsorted(of[by_class], np.arange(classes + 1))
        rows: list[tuple] = []
        for c in range(classes):
            members = sorted(ids[by_class[cuts[c] : cuts[c + 1]]].tolist())
            n, shared = int(digests[c, 0]), int(bounds[c + 1] - bounds[c])
            alive = n > 0 and shared >= _least(num, den, n)
            d1, d2 = digests[c, 1:].view(np.int64).tolist()
            rep = members[0]
            rows.append((dict(zip(_MEMBER.names, rep)), members.count(rep), [None if noid else i for noid, i, _ in members], n, d1, d2, shared, rank[bounds[c] : bounds[c + 1]].astype("<u8").tobytes() if alive else None))
        rep = pa.struct([("noid", pa.bool_()), ("id", pa.int64()), ("kh", pa.int64())])
        kinds = (rep, pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["rep", "times", "members", "n", "d1", "d2", "shared", "ranks"])

    return run


def _prefixes(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, nodes, ns, rests = [], [], [], []
            for node, n, raw in zip(*(batch.column(c).to_pylist() for c in ("node", "n", "ranks"))):
                ranks = np.frombuffer(raw, "<u8")
                size = n - _least(num, den, n) + 1 - (n - len(ranks))
                tokens.append(ranks[:size])
                nodes.append(np.full(size, node))
                ns.append(np.full(size, n))
                rests.append(len(ranks) - np.arange(size))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in ([t.view(np.int64) for t in tokens], nodes, ns, rests)], names=["token", "node", "n", "rest"])

    return run


class Trie:
    """Sets in global order; a node holds a run of ranks that all sets below it share."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.order = sorted(range(len(sets)), key=lambda k: sets[k].astype(">u8").tobytes())

    def overlaps(self, centre: np.ndarray, needed: list[int], only: list[int] | None = None) -> list[bool]:
        """For each set, whether it shares ``needed`` ranks with ``centre``.

        With ``only``, places in ``order``, the other sets are left out (and are False).

        Walks depth first: the counts along the path of the set before are kept for the
        prefix it shares with the next one. Where the count plus what the centre has left
        can't reach the least need of any set, the node's whole subtree is skipped; a
        single set is left where its own rest is too small.
        """
        out = [False] * len(self.sets)
        order = self.order if only is None else [self.order[x] for x in only]
        least = min((needed[k] for k in order), default=0)
        before, dead = np.zeros(0, np.uint64), None
        counts, rests = np.zeros(1, np.int64), np.array([len(centre)])  # after each rank of the path
        for k in order:
            s = self.sets[k]
            m = min(len(s), len(before))
            differ = np.flatnonzero(s[:m] != before[:m])
            common = int(differ[0]) if len(differ) else m
            if dead is not None and common >= dead:
                continue  # below the node that was given up
            dead, at = None, min(common, len(counts) - 1)
            counts, rests = counts[: at + 1], rests[: at + 1]
            while at < len(s) and counts[-1] + min(len(s) - at, rests[-1]) >= needed[k]:
                step = s[at : at + 64]
                where = np.searchsorted(centre, step)
                hit = centre[np.minimum(where, len(centre) - 1)] == step
                counts = np.concatenate([counts, counts[-1] + np.cumsum(hit)])
                rests = np.concatenate([rests, len(centre) - where - hit])
                at += len(step)
                hopeless = np.flatnonzero(counts[at - len(step) + 1 :] + rests[at - len(step) + 1 :] < least)
                if len(hopeless):
                    dead = at - len(step) + 1 + int(hopeless[0])
                    counts, rests = counts[: dead + 1], rests[: dead + 1]
                    break
            out[k] = dead is None and at == len(s) and bool(counts[-1] >= needed[k])
            before = s[: len(counts) - 1]
        return out


def _verify(num: int, den: int):
    def run(group: pa.Table) -> pa.Table:
        centre, n_centre, leaves = None, 0, []
        for node, n, raw, leaf, c in zip(*(group.column(x).to_pylist() for x in ("node", "n", "ranks", "leaf", "centre"))):
            if leaf:
                leaves.append((node, n, np.frombuffer(raw, "<u8")))
            else:
                centre, n_centre = np.frombuffer(raw, "<u8"), n
        who = group.column("centre")[0].as_py()
        linked = Trie([s for *_, s in leaves]).overlaps(centre, [_needed(num, den, n, n_centre) for _, n, _ in leaves]) if leaves else []
        found = [node for (node, *_), yes in zip(leaves, linked) if yes]
        return pa.table([pa.array([who] * len(found), pa.int64()), pa.array(found, pa.int64())], names=["a", "b"])

    return run


def _links(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs ``(centre, node)`` that link, star by star; stars are salted to ``STAR`` sets.

    ``pairs`` is a written table.
    """
    sizes = pairs.groupBy("centre").agg(F.count("*").alias("size"))
    salts = F.ceil(F.col("size") / STAR)
    salted = lookup(pairs, sizes, ["centre"]).select("centre", "node", F.pmod(F.xxhash64("node"), salts).alias("salt"))
    leaves = salted.join(nodes, "node").select("centre", "salt", "node", "n", "ranks", F.lit(True).alias("leaf"))
    hubs = sizes.select("centre", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt")).join(nodes.withColumnRenamed("node", "centre"), "centre").select("centre", "salt", F.col("centre").alias("node"), "n", "ranks", F.lit(False).alias("leaf"))
    return leaves.unionByName(hubs).groupBy("centre", "salt").applyInArrow(_verify(num, den), "a long, b long")


def _open_with(k: int, n: np.ndarray, rest: np.ndarray, label: np.ndarray, num: int, den: int) -> np.ndarray:
    """The sets behind the k-th, in order of size, that the bounds leave open with it."""
    if rest[k] * (num + den) < 2 * num * n[k]:
        return np.zeros(0, np.int64)  # too short a rest even for a set of its own size
    own = slice(k + 1, int(np.searchsorted(n, n[k] * den // num, "right")))
    need = -(-num * (n[k] + n[own]) // (num + den))
    return k + 1 + np.flatnonzero((label[own] != label[k]) & (np.minimum(rest[k], rest[own]) >= need))


_CELL = "token long, i int, j int"
_OPEN = f"{_CELL}, node long, salt int, rest long, component long, other long"


def _compare(num: int, den: int):
    """A cell of a frequent shingle's open sets -> its open pairs (``node``, ``other``), or the sets that have one if these are fewer.

    So a cell never makes more rows than it has sets.
    """

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("n", "ascending"), ("node", "ascending")])
        node, n, rest, component, salt = (group.column(c).to_numpy() for c in ("node", "n", "rest", "component", "salt"))
        across = group.column("i")[0].as_py() != group.column("j")[0].as_py()
        met, pairs, many = np.zeros(len(node), bool), [], 0
        for k in range(len(node)):
            at = _open_with(k, n, rest, component, num, den)
            at = at[salt[at] != salt[k]] if across else at
            if len(at):
                met[k] = met[at] = True
                many += len(at)
                if many <= len(node):
                    pairs.append((np.full(len(at), k), at))
        if many > met.sum():
            out = group.filter(pa.array(met))
            return out.drop_columns(["n"]).append_column("other", pa.nulls(len(out), pa.int64())).select([x.split()[0] for x in _OPEN.split(", ")])
        x, y = (np.concatenate([np.zeros(0, np.int64), *c]) for c in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
        x, y = np.where(component[x] < component[y], x, y), np.where(component[x] < component[y], y, x)
        out = group.take(pa.array(x))
        return out.drop_columns(["n"]).append_column("other", pa.array(node[y], pa.int64())).select([x.split()[0] for x in _OPEN.split(", ")])

    return run


def _forest(num: int, den: int):
    """A cell's sets -> links that join the components it joins, one for each two that meet."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("n", "ascending"), ("node", "ascending")])
        node, n, rest, component, salt = (group.column(c).to_numpy() for c in ("node", "n", "rest", "component", "salt"))
        across = group.column("i")[0].as_py() != group.column("j")[0].as_py()
        trie = Trie([np.frombuffer(raw, "<u8") for raw in group.column("ranks").to_pylist()])
        place = np.empty(len(node), np.int64)
        place[trie.order] = np.arange(len(node))
        label = np.unique(component, return_inverse=True)[1]
        found: list[tuple[int, int]] = []
        for k in range(len(node)):
            at = _open_with(k, n, rest, label, num, den)
            at = at[salt[at] != salt[k]] if across else at
            needed = -(-num * (n + n[k]) // (num + den))
            at = at[np.argsort(place[at])]
            while len(at):
                linked = np.array(trie.overlaps(trie.sets[k], needed, place[at[:64]].tolist()))
                for x in np.flatnonzero(linked):
                    if label[x] != label[k]:
                        found.append((int(node[k]), int(node[x])))
                        label[label == label[x]] = label[k]
                at = at[64:]
                at = at[label[at] != label[k]]
        return pa.table([pa.array([x[c] for x in found], pa.int64()) for c in (0, 1)], names=["a", "b"])

    return run


def _across(open_: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of one shingle's sets in different components that the bounds leave open."""
    left, right = open_.alias("x"), open_.alias("y")
    need = F.ceil(num * (F.col("x.n") + F.col("y.n")) / (num + den))
    return (
        left.join(right, (F.col("x.token") == F.col("y.token")) & (F.col("x.component") < F.col("y.component")))
        .where((F.least("x.n", "y.n") * den >= F.greatest("x.n", "y.n") * num) & (F.least("x.rest", "y.rest") >= need))
        .select(F.col("x.node").alias("centre"), F.col("y.node").alias("node"))
        .distinct()
    )


def text_hash() -> F.Column:
    """Tells rows of one id apart."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def shingle_classes(docs: DataFrame, num: int, den: int, batch_docs: int = 60_000, batch_tokens: int = 1_500_000) -> DataFrame:
    """Steps 1 and 2: classes of equal sets with their members and shared shingles in global order."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(4 * shuffle_partitions(spark) - 1, total // 6 // 4_000_000, 1).bit_length()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), text_hash().alias("kh"))
    return (
        rows.mapInArrow(_shingle(bits, batch_docs, batch_tokens), _BUCKETED)
        .groupBy("key")
        .applyInArrow(_count(bits), _BUCKETED)
        .groupBy("batch")
        .applyInArrow(_assemble(num, den), _CLASSES)
    )


def _graph(docs: DataFrame, num: int, den: int, few: int = 1000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes, the nodes of those that may link, and the component of each node that has a link."""
    spark = docs.sparkSession
    bounded_batches(spark)
    classes, classes_path = materialize(shingle_classes(docs, num, den), "classes")
    alive = classes.where(F.col("ranks").isNotNull())
    by_set, set_path = materialize(alive.groupBy(*_DIGEST).agg(F.min("rep").alias("rep"), F.first("ranks").alias("ranks")), "nodes")
    # a node's name is half of its digest; should two sets share it, all of theirs
    twice = by_set.groupBy("d1").count().where("count > 1").select("d1", F.lit(True).alias("twice"))
    nodes = by_set.withColumn("node", F.col("d1"))
    if twice.take(1):
        named = by_set.join(twice, "d1", "left").withColumn("node", F.when(F.col("twice"), F.xxhash64(*_DIGEST)).otherwise(F.col("d1")))
        nodes, _ = materialize(named.drop("twice"), "nodes")
    sets = nodes.select("node", "n", "ranks")
    prefixes, prefix_path = materialize(sets.mapInArrow(_prefixes(num, den), "token long, node long, n long, rest long"), "prefixes")
    shared = prefixes.groupBy("token").agg(F.min("node").alias("centre"), F.min_by("n", "node").alias("n_centre"), F.count("*").alias("size")).where("size > 1")
    close = F.least("n", "n_centre") * den >= F.greatest("n", "n_centre") * num
    stars = (
        prefixes.join(shared, "token")
        .where((F.col("node") != F.col("centre")) & close)
        .groupBy("node", "centre")
        .agg(F.count("*").alias("k"))
        .groupBy("node")
        .agg(F.max_by("centre", F.struct("k", -F.col("centre"))).alias("centre"))
    )
    stars, star_path = materialize(stars, "stars")
    first, first_path = materialize(_links(stars, sets, num, den), "links")
    labels = connected_components(first)
    labelled = prefixes.join(labels, "node", "left").select("token", "node", "n", "rest", F.coalesce("component", "node").alias("component"))
    labelled, labelled_path = materialize(labelled, "labelled")
    blocks = F.greatest(F.ceil(F.count("*") / few), F.ceil(F.sum("n") / BLOCK)).cast("int")
    several = labelled.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size"), blocks.alias("blocks")).where("lo < hi").select("token", "size", "blocks")
    open_, open_path = materialize(lookup(labelled, several, ["token"]), "open")
    pairs = _across(open_.where(F.col("size") <= min(few, PAIRED)), num, den)
    frequent = open_.where(F.col("size") > min(few, PAIRED)).withColumn("salt", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    links = [first]
    if frequent.take(1):
        cells = frequent.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        cells = cells.select("token", F.least("salt", "other").alias("i"), F.greatest("salt", "other").alias("j"), "node", "salt", "n", "rest", "component")
        compared, _ = materialize(cells.groupBy("token", "i", "j").applyInArrow(_compare(num, den), _OPEN), "compared")
        pairs = pairs.unionByName(compared.where("other is not null").select(F.col("node").alias("centre"), F.col("other").alias("node"))).distinct()
        dense = compared.where("other is null").drop("other")
        if dense.take(1):
            links.append(dense.join(sets, "node").groupBy("token", "i", "j").applyInArrow(_forest(num, den), "a long, b long"))
    pairs, pair_path = materialize(pairs, "pairs")
    links.append(_links(pairs, sets, num, den))
    found, found_path = materialize(functools.reduce(DataFrame.unionByName, links), "links")
    joined = connected_components(found)
    release(spark, prefix_path, star_path, first_path, labelled_path, open_path, pair_path, found_path)
    return classes, nodes, joined


_DIGEST = ["n", "d1", "d2"]


def _with_components(classes: DataFrame, nodes: DataFrame, joined: DataFrame) -> DataFrame:
    """Every class with its node, its component (null if it can't have a link) and the least member of that."""
    placed, _ = materialize(nodes.join(joined, "node", "left").select(*_DIGEST, "node", "rep", F.coalesce("component", "node").alias("component")), "placed")
    least = placed.groupBy("component").agg(F.min("rep").alias("least"))
    by_digest = lookup(placed.drop("rep"), least, ["component"])  # a component may have a third of all nodes
    # classes of one set in several batches have a node, so those without one stand for themselves
    return classes.join(by_digest, _DIGEST, "left").withColumn("least", F.coalesce("least", "rep"))


def _least_id() -> F.Column:
    """The component's least id; that of the row itself if its text has no words."""
    return F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(~F.col("least.noid"), F.col("least.id"))


def jaccard_components(docs: DataFrame, num: int = 75, den: int = 100, few: int = 1000) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs(doc_id, text)``."""
    out = _with_components(*_graph(docs, num, den, few)).select(F.explode("members").alias("doc_id"), F.col("n").alias("n_shingles"), "least")
    return out.select("doc_id", "n_shingles", _least_id().alias("component_id"))


def _pairs(num: int, den: int):
    """A pair of blocks of one component (or a block with itself) -> its links."""

    def run(group: pa.Table) -> pa.Table:
        node, n, salt = (group.column(c).to_numpy() for c in ("node", "n", "salt"))
        order = np.argsort(node)
        node, n, salt = node[order], n[order], salt[order]
        raws = group.column("ranks").to_pylist()
        sets = [np.frombuffer(raws[k], "<u8") for k in order]
        starts = np.cumsum([0] + [len(s) for s in sets])
        code = np.unique(np.concatenate(sets), return_inverse=True)[1]
        mark = np.zeros(len(code), dtype=bool)
        across = group.column("i")[0].as_py() != group.column("j")[0].as_py()
        out: list[list[np.ndarray]] = [[], [], []]
        for k in range(len(sets) - 1):
            own = code[starts[k] : starts[k + 1]]
            mark[own] = True
            overlap = np.add.reduceat(mark[code[starts[k + 1] :]], starts[k + 1 : -1] - starts[k + 1], dtype=np.int64)
            mark[own] = False
            linked = overlap * (num + den) >= num * (n[k] + n[k + 1 :])
            if across:
                linked &= salt[k + 1 :] != salt[k]
            at = np.flatnonzero(linked)
            for column, values in zip(out, (np.full(len(at), node[k]), node[k + 1 :][at], overlap[at])):
                column.append(values)
        return pa.table([pa.array(np.concatenate([np.zeros(0, np.int64), *c]), pa.int64()) for c in out], names=["a", "b", "overlap"])

    return run


def jaccard_join(docs: DataFrame, num: int = 75, den: int = 100, block: int = STAR) -> tuple[DataFrame, DataFrame]:
    """The whole join: every row's class and every link of two classes.

    The first frame has doc_id, n_shingles, component_id, class_id and n_links of every row
    of ``docs``; rows with equal sets share their class, and ``n_links`` counts the other
    rows a row links with, in its class and in others. The second has ``a < b``, two class
    ids, and the overlap of their sets, for each link between different sets, also inside
    a component. A class id is a number made from the class's set; empty texts have null.
    """
    spark = docs.sparkSession
    classes, nodes, joined = _graph(docs, num, den)
    blocks = joined.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    salted = nodes.join(lookup(joined, blocks, ["component"]), "node").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = salted.select("component", "node", "n", "ranks", "salt", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = other.select("component", "node", "n", "ranks", "salt", F.least("salt", "other").alias("i"), F.greatest("salt", "other").alias("j"))
    links, _ = materialize(cells.groupBy("component", "i", "j").applyInArrow(_pairs(num, den), "a long, b long, overlap long"), "class-links")
    # a class may come from several batches; those without a node are in one only
    found = _with_components(classes, nodes, joined).withColumn("class_id", F.when(F.col("n") > 0, F.coalesce("node", "d1")))
    sizes = found.where("n > 0").groupBy("class_id", *_DIGEST).agg(F.sum(F.size("members")).alias("size"))
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    node_sizes = sizes.join(nodes.select("node", *_DIGEST), _DIGEST).select(F.col("node").alias("b"), "size")
    further = both.join(node_sizes, "b").groupBy(F.col("a").alias("node")).agg(F.sum("size").alias("further"))
    counted = sizes.join(nodes.select("node", *_DIGEST), _DIGEST, "left").join(further, "node", "left")
    counted = counted.select(*_DIGEST, (F.col("size") - 1 + F.coalesce("further", F.lit(0))).alias("links"))
    out = found.join(counted, _DIGEST, "left").select(F.explode("members").alias("doc_id"), F.col("n").alias("n_shingles"), "least", "class_id", F.coalesce("links", F.lit(0)).alias("n_links"))
    return out.select("doc_id", "n_shingles", _least_id().alias("component_id"), "class_id", "n_links"), links


def one_of_each(docs: DataFrame, num: int = 75, den: int = 100) -> DataFrame:
    """``docs`` with one row of each component, that of the least id, with all columns.

    Rows without an id come after those with one, rows of one id by their text's hash. Rows
    without words link with nothing and all stay.
    """
    found = _with_components(*_graph(docs, num, den)).withColumn("component", F.coalesce("component", F.col("d1")))
    several = (F.max("times") > 1) | (F.count("*") > 1)
    linked = found.where("n > 0").groupBy("component").agg(F.min("least").alias("least"), several.alias("several")).select("least.*", "several")
    key = [F.col("doc_id").isNull().alias("noid"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), text_hash().alias("kh")]
    rows = docs.select(F.struct(*docs.columns).alias("row"), *key)
    kept = rows.join(linked, ["noid", "id", "kh"])
    first = kept.where("several").withColumn("nth", F.row_number().over(Window.partitionBy("noid", "id", "kh").orderBy(F.lit(0)))).where("nth = 1")
    empty = rows.where(~F.coalesce(F.col("row.text").cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    out = kept.where("not several").select("row").unionByName(first.select("row")).unionByName(empty.select("row"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
