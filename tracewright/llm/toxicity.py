"""Toxicity: a support vector machine on a gap-tolerant subsequence string kernel.

Kernel. A word (lower-cased, letters only, between boundary marks) is the vector of its
three- and four-letter subsequences of small span; each gap multiplies a subsequence's
weight by ``DECAY``. Inserted characters therefore cost weight, not the match: symbols
inside a word are dropped and single letters in a row are read as one word as well.

Nystrom. ``k(x, z) = <phi(x), phi(z)> / (|phi(x)| |phi(z)|)`` is evaluated at landmark
words ``z`` alone, so a word has ``K_zz^(-1/2) k(x, z)`` as features and a linear SVM in
that space is a kernel SVM. As its decision is linear in ``phi(x)``, the weights of all
landmarks fold into one table over subsequences: scoring a word is a few look-ups.

Training. The bags are the labelled documents' sentences: a sentence counts by its most
toxic word, and only some sentences of a toxic document need to be toxic (MI-SVM: witness
words of its most toxic sentences are chosen, the SVM fitted, and the witnesses chosen
again). Only words that toxic documents have twice as often as others can be witnesses.
Labels are of documents, not of sentences, so a document is scored as a whole: part of the
labelled rows is held back to fit the logistic curve that turns the margins of its words
(the two largest, the positive ones, and how many words there are) into a probability.

Scoring is one pass of ``mapInArrow`` with a model of fixed size; nothing is shuffled.

Defined cases: null and empty texts and texts without letters score as the curve's value
for "no toxic word"; null or repeated ``doc_id`` rows are each scored, and a null id is not
held out; without labels of
both kinds every text scores 0.0; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import bounded_batches, process_memo, table

DECAY = 0.6
WORD_LENGTH = 20  # longer words are read in overlapping parts
#: Offsets of the letters of a subsequence, and its number of gaps.
SHAPES = [
    ((0, 1, 2), 0), ((0, 1, 3), 1), ((0, 2, 3), 1), ((0, 1, 4), 2), ((0, 2, 4), 2), ((0, 3, 4), 2),
    ((0, 1, 2, 3), 0), ((0, 1, 2, 4), 1), ((0, 1, 3, 4), 1), ((0, 2, 3, 4), 1), ((0, 1, 3, 5), 2), ((0, 2, 3, 5), 2), ((0, 2, 4, 5), 2),
]
TABLE_BITS = 20
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], dtype=np.uint64)
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")
MEMO_ENTRIES = 300_000


def words_of(text: str) -> set[str]:
    """Distinct normal forms of the words of a text."""
    out: set[str] = set()
    run: list[str] = []
    for token in set(text.lower().split()) if not _has_single_run(text) else text.lower().split():
        word = token if token.isalpha() else _NOT_LETTERS.sub("", token)
        if len(word) == 1:
            run.append(word)
            continue
        if len(run) > 2:
            out.add("".join(run))
        run = []
        if len(word) > 2:
            out.add(word)
    if len(run) > 2:
        out.add("".join(run))
    return out


_SINGLES = re.compile(r"(?<!\w)\w\W+\w\W+\w(?!\w)")


def _has_single_run(text: str) -> bool:
    return _SINGLES.search(text) is not None


def _parts(word: str) -> list[str]:
    inner = WORD_LENGTH - 2
    if len(word) <= inner:
        return [f"\x02{word}\x03"]
    marked = f"\x02{word}\x03"
    return [marked[k : k + WORD_LENGTH] for k in range(0, len(marked) - 4, WORD_LENGTH - 4)]


def _codes(words: list[str]) -> np.ndarray:
    raw = "".join(w.ljust(WORD_LENGTH, "\0") for w in words).encode("utf-32-le", "replace")
    return np.frombuffer(raw, "<u4").reshape(len(words), WORD_LENGTH).astype(np.uint64)


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot in the table, weight; 0 where absent) of each subsequence, and each word's norm."""
    codes = _codes(words)
    slots, weights = [], []
    for offsets, gaps in SHAPES:
        n = WORD_LENGTH - offsets[-1]
        h = np.full((len(words), n), len(offsets), dtype=np.uint64)
        for o, m in zip(offsets, _MULTIPLIERS):
            h = (h ^ codes[:, o : o + n]) * m
            h ^= h >> np.uint64(29)
        slots.append((h >> np.uint64(64 - TABLE_BITS)).astype(np.int32))
        weights.append(np.where(codes[:, offsets[-1] : offsets[-1] + n] > 0, np.float32(DECAY**gaps), np.float32(0)))
    weight = np.concatenate(weights, axis=1)
    return np.concatenate(slots, axis=1), weight, np.sqrt((weight**2).sum(axis=1)) + 1e-9


@dataclass
class Model:
    weights: np.ndarray  # by slot: the landmarks' subsequences, times their coefficients
    bias: float
    curve: np.ndarray  # of a document's evidence; the last entry is its offset
    floor: float  # the margin of a text without words

    def margins(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros(0, np.float32)
        parts = [_parts(w) for w in words]
        flat = [p for ps in parts for p in ps]
        out = np.concatenate([self._margins(flat[k : k + 4096]) for k in range(0, len(flat), 4096)])
        return out if len(flat) == len(words) else np.maximum.reduceat(out, np.cumsum([0, *(len(p) for p in parts[:-1])]))

    def _margins(self, words: list[str]) -> np.ndarray:
        slot, weight, norm = subsequences(words)
        return (self.weights[slot] * weight).sum(axis=1) / norm + self.bias

    def evidence(self, margins: list[float]) -> list[float]:
        """Of a document's distinct words: the two largest margins, the sum and number of the
        positive ones, and how many words there are."""
        top = sorted(margins, reverse=True)[:2] if margins else []
        positive = [m for m in margins if m > 0]
        return [top[0] if top else self.floor, top[1] if len(top) > 1 else self.floor, np.log1p(sum(positive)), np.log1p(len(positive)), np.log1p(len(margins))]

    def probability(self, evidence: list[list[float]]) -> np.ndarray:
        x = np.array(evidence, dtype=np.float64).reshape(-1, 5)
        return 1 / (1 + np.exp(-np.clip(x @ self.curve[:-1] + self.curve[-1], -30, 30)))


def _unit(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slots and weights of marked words or parts of words, scaled to norm 1."""
    slot, weight, norm = subsequences(parts)
    return slot, weight / norm[:, None]


def _against(parts: list[str], landmarks: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """k(word, landmark) for all landmarks, a landmark's table at a time."""
    slot, weight = _unit(parts)
    out = np.zeros((len(parts), len(landmarks[0])), np.float32)
    dense = np.zeros(1 << TABLE_BITS, np.float32)
    for j, (s, w) in enumerate(zip(*landmarks)):
        np.add.at(dense, s, w)
        out[:, j] = (dense[slot] * weight).sum(axis=1)
        dense[s] = 0
    return out


def _linear_svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, lam: float = 1e-4, epochs: int = 150) -> tuple[np.ndarray, float]:
    """Squared-hinge SVM by Nesterov's method; deterministic."""
    x1 = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    cost = cost / cost.sum()
    step = 1 / (2 * np.linalg.norm(x1 * np.sqrt(cost)[:, None], 2) ** 2 + lam)
    w = v = np.zeros(x1.shape[1])
    for t in range(epochs):
        gap = np.maximum(0, 1 - y * (x1 @ v))
        grad = -2 * x1.T @ (cost * y * gap) + lam * v
        new = v - step * grad
        v = new + t / (t + 3) * (new - w)
        w = new
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray, prior: float = 0.3) -> np.ndarray:
    """Weights and offset of a ridge-penalised logistic regression on Platt's smoothed targets."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w, ridge = np.zeros(z.shape[1]), np.array([prior] * x.shape[1] + [1e-6])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (p - t) + ridge * w)
        step *= min(1, 4 / (np.abs(step).max() + 1e-12))
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    weights = w[:-1] / scale
    return np.append(weights, w[-1] - (weights * mean).sum())


@dataclass
class Labelled:
    """A labelled text: the words of each sentence, its label, and a hash that equal texts share."""

    sentences: list[set[str]]
    toxic: bool
    digest: int

    @property
    def words(self) -> set[str]:
        return set().union(*self.sentences)

    @classmethod
    def of(cls, text: str, toxic: int) -> Labelled:
        return cls([w for s in _SENTENCE.split(text) if (w := words_of(s))], bool(toxic), zlib.crc32(text.encode("utf-8", "replace")))


def _kernel_machine(bad: Counter[str], good: dict[str, float], landmarks: list[str]) -> Model:
    """A support vector machine of witness words against clean ones, in the landmarks' space."""
    marks = _unit([p for w in landmarks for p in _parts(w)])
    gram = _against([p for w in landmarks for p in _parts(w)], marks).astype(np.float64)
    value, vector = np.linalg.eigh((gram + gram.T) / 2)
    root = vector * (np.maximum(value, 1e-3) ** -0.5) @ vector.T
    rows = [(p, 1.0, float(min(n, 20)) / len(ps)) for w, n in sorted(bad.items()) for ps in [_parts(w)] for p in ps]
    n_bad = len(rows)
    rows += [(p, -1.0, cost) for w, cost in sorted(good.items()) for p in _parts(w)]
    y, cost = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    cost[:n_bad] *= 0.35 * cost[n_bad:].sum() / cost[:n_bad].sum()
    weight, bias = _linear_svm(_against([r[0] for r in rows], marks) @ root, y, cost)
    table_ = np.zeros(1 << TABLE_BITS, np.float32)
    for slot, w, c in zip(*marks, root @ weight):
        np.add.at(table_, slot, (w * c).astype(np.float32))
    return Model(table_, bias, np.zeros(6), bias)


def fit_labelled(rows: list[Labelled], landmarks: int = 96, confused: int = 24, rounds: int = 4) -> Model | None:
    """Fit on labelled texts; None unless both labels occur. Every third text only calibrates.

    After each round the clean words that the machine takes for toxic ones in most clean
    texts become landmarks as well, so that it can tell them from the insults they resemble.
    """
    docs = [r.words for r in rows]
    held = [r.digest % 3 == 0 for r in rows]
    own = list({r.digest: i for i, r in reversed(list(enumerate(rows))) if not held[i]}.values())  # copies count once
    pos, neg = sorted(i for i in own if rows[i].toxic), sorted(i for i in own if not rows[i].toxic)
    if not pos or not neg:
        return None
    in_pos, in_neg = Counter(w for i in pos for w in docs[i]), Counter(w for i in neg for w in docs[i])
    odds = {w: np.log((n + 0.1) / (len(pos) + 0.2)) - np.log((in_neg[w] + 0.1) / (len(neg) + 0.2)) for w, n in in_pos.items()}
    worth = {w: odds[w] * min(n, 20) ** 0.5 for w, n in in_pos.items() if n > 1 or len(pos) < 20}
    best = sorted(worth, key=lambda w: (-worth[w], w))[: landmarks // 2]
    common = sorted(in_neg, key=lambda w: (-in_neg[w], w))[: landmarks - len(best)]
    chosen = dict.fromkeys([*best, *common])
    vocabulary = sorted(set(in_neg) | set(in_pos))
    margin = {w: float(odds.get(w, -3.0)) * (1 if w in worth else 0.2) for w in vocabulary}
    model = Model(np.zeros(1 << TABLE_BITS, np.float32), 0.0, np.zeros(6), -1.0)
    clean = set(common) | {w for w, n in in_neg.items() if n >= 0.02 * len(neg)}
    clean.update(w for w in sorted(in_neg) if zlib.crc32(w.encode()) % max(1, len(in_neg) // 4000) == 0)
    for _ in range(rounds):
        witness: Counter[str] = Counter()
        for i in pos:  # of each sentence the most toxic word, of each text its most toxic sentences
            top = sorted({max(s, key=lambda w: (margin[w], w)) for s in rows[i].sentences}, key=lambda w: (-margin[w], w))
            likely = [w for w in top if odds[w] > 0.7]
            witness.update(w for k, w in enumerate(likely[:3]) if not k or margin[w] > 0)
        hardest = Counter(max(docs[i], key=lambda w: (margin[w], w)) for i in neg if docs[i])
        clean.update(hardest)
        clean -= set(witness)
        if not witness:
            break
        mistaken = sorted((w for w in hardest if margin[w] > -0.5 and w not in witness), key=lambda w: (-hardest[w], w))
        chosen.update(dict.fromkeys(mistaken[:confused]))
        model = _kernel_machine(witness, {w: 1.0 + in_neg[w] ** 0.5 for w in clean}, list(chosen))
        margin = dict(zip(vocabulary, model.margins(vocabulary).tolist()))
    at = [i for i in range(len(rows)) if held[i]]
    if sum(rows[i].toxic for i in at) < 50 or all(rows[i].toxic for i in at):
        at = list(range(len(rows)))  # too few held back for a curve
    words = sorted(set().union(*(docs[i] for i in at)))
    margin = dict(zip(words, model.margins(words).tolist()))
    seen_by = np.array([model.evidence([margin[w] for w in docs[i]]) for i in at])
    model.curve = _logistic(seen_by, np.array([1 if rows[i].toxic else -1 for i in at]))
    return model


def fit(texts: list[str], toxic: list[int], **parameters) -> Model | None:
    return fit_labelled([Labelled.of(t, y) for t, y in zip(texts, toxic)], **parameters)


def _sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole texts to the distinct words of their sentences, which are all that training reads."""
    for batch in batches:
        for k in range(0, batch.num_rows, 200):
            part = batch.slice(k, 200)
            rows = [Labelled.of(t or "", 0) for t in part.column(2).to_pylist()]
            words, digests = [], []
            for r in rows:
                kept = list({frozenset(s): None for s in r.sentences})
                words.append("\n".join(sorted(" ".join(sorted(s)) for s in kept)))
                digests.append(r.digest)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(words), pa.array(digests, pa.int64())], names=["doc_id", "toxic", "words", "digest"])


def labelled_sample(docs: DataFrame, labels: DataFrame, usable, max_rows: int = 2400) -> list[Labelled]:
    """At most ``max_rows`` labelled texts for training, half of them toxic if there are so many.

    Label rows are chosen first, by a hash of their id, so only they meet the documents:
    a broadcast of at most ``max_rows`` ids and one scan. Texts are read whole. Rows with
    two labels count as toxic if either is; of rows with one id the first by its text counts.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).dropna().where(usable).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    mixed = F.xxhash64(F.lit("train"), "doc_id")
    chosen = [r for kind in (1, 0) for r in known.where(F.col("toxic") == kind).orderBy(mixed, "doc_id").limit(max_rows // 2).collect()]
    if not chosen:
        return []
    ids = spark.createDataFrame([(r.doc_id, r.toxic) for r in chosen], "doc_id long, toxic int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id").select("doc_id", "toxic", "text")
    found = rows.mapInArrow(_sentences, "doc_id long, toxic int, words string, digest long").groupBy("doc_id").agg(F.min(F.struct("digest", "words", "toxic")).alias("r")).select("r.*").collect()
    found.sort(key=lambda r: (r.digest, r.words, r.toxic))
    return [Labelled([set(s.split(" ")) for s in r.words.split("\n") if s], bool(r.toxic), r.digest) for r in found]


def _score(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        process_memo("toxicity", dict)  # makes room
        memo: dict[str, float] = {}
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                if model is None:
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([0.0] * part.num_rows)], names=["row", "score"])
                    continue
                docs = [words_of(t or "") for t in part.column(1).to_pylist()]
                new = list(set().union(*docs).difference(memo))
                found = dict(zip(new, model.margins(new).tolist()))
                if len(memo) + len(found) > MEMO_ENTRIES:
                    look = found
                    look.update((w, memo[w]) for d in docs for w in d if w in memo)
                else:
                    memo.update(found)
                    look = memo
                scores = model.probability([model.evidence([look[w] for w in d]) for d in docs])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores)], names=["row", "score"])

    return run


def toxicity_scores(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with a ``score`` column; columns of ``docs`` named so are replaced."""
    return _scored(docs, model).select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() != "score"], "score")


def below(docs: DataFrame, model: Model | None, threshold: float) -> DataFrame:
    """The rows of ``docs`` that score less, with all their columns."""
    return _scored(docs, model).where(F.col("score") < threshold).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def _scored(docs: DataFrame, model: Model | None) -> DataFrame:
    bounded_batches(docs.sparkSession)
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["text"])
    return packed.mapInArrow(_score(model), StructType([packed.schema["row"], StructField("score", DoubleType())]))


def not_held_out(column: str = "doc_id"):
    """Rows whose crc32 of the id as text, modulo 4, isn't 2."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 4 != 2


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    return fit_labelled(labelled_sample(docs, labels, not_held_out()))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity_scores(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(~not_held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
