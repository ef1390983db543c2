"""Quality rules: base counts, then distribution divergence from language references.

One pass of ``mapInArrow`` turns each text into its base counts and two histograms: the
classes of its code points, and its common words (function words of the reference
languages, all others in one bin). The references are those histograms summed over every
document of a language that passes the base rules, so they follow the corpus whatever its
size; they are one short row a language. A document is dropped if the Jensen-Shannon
distance (square root of the divergence in bits, 0 to 1) to its language's reference is
over a threshold; a document whose language has no reference is held against the nearest
one. Short texts are guarded: a histogram with too few entries says nothing and is skipped.

Memory: a batch of texts in a task, and ``len(languages)`` reference rows on the driver.

Defined cases: null and empty texts have no words and fail the base rules; null ids and
repeated rows are judged row by row; an empty table gives an empty result; without any
document that passes the base rules nothing is compared; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, table

# Frequent function words of the reference languages.
COMMON_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec son ou mais comme".split(),
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como o pero sus le ha me si sin".split(),
}
CLASSES = ["lower", "upper", "digit", "space", "line", "stop", "mark", "symbol", "accented lower", "accented upper", "other letter", "other"]
_WHITE = b" \t\n\r\x0b\x0c"
_SYMBOLS = b"#*$%&|<>"
_VOCABULARY = {w.encode(): i for i, w in enumerate(dict.fromkeys(w for ws in COMMON_WORDS.values() for w in ws))}
WORDS = len(_VOCABULARY) + 1  # the last bin: all other words


def _class_table(size: int = 0x250) -> np.ndarray:
    def kind(c: str) -> str:
        if "a" <= c <= "z":
            return "lower"
        if "A" <= c <= "Z":
            return "upper"
        if c.isdigit():
            return "digit"
        if c == "\n":
            return "line"
        if c.isspace():
            return "space"
        if c in ".,;:!?":
            return "stop"
        if c in "'\"()-[]{}":
            return "mark"
        if c < "\x80":
            return "symbol"
        return "accented lower" if c.islower() else "accented upper" if c.isupper() else "other letter" if c.isalpha() else "other"

    return np.array([CLASSES.index(kind(chr(i))) for i in range(size)], dtype=np.uint8)


_TABLE = _class_table()


def class_histogram(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    far = len(_TABLE)
    counts = np.bincount(_TABLE[points[points < far]], minlength=len(CLASSES))
    counts[CLASSES.index("other letter")] += int((points >= far).sum())
    return counts


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that the text has at least twice."""
    n = len(words)
    if n < 4:
        return 0
    known = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(known.__getitem__, words), np.int64, n)
    v = len(known)
    pair = ids[:-1] * v + ids[1:]
    if v > 2_000_000:  # keeps the next product within 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    code = pair[:-1] * v + ids[2:]
    order = np.argsort(code, kind="stable")
    same = code[order[1:]] == code[order[:-1]]
    hit = np.zeros(n, dtype=bool)
    twice = np.concatenate([order[1:][same], order[:-1][same]])
    for k in range(3):
        hit[twice + k] = True
    return int(hit.sum())


def measure(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class and word histograms."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    white = len(raw) - len(raw.translate(None, _WHITE))
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += bool(line.encode("utf-8", "surrogatepass").split())
        else:
            seen.add(line)
    common = [0] * WORDS
    for i in map(_VOCABULARY.get, raw.lower().split()):
        common[-1 if i is None else i] += 1
    return len(words), len(text) - white, len(raw) - len(raw.translate(None, _SYMBOLS)), dup, repeated_words(words), class_histogram(text).tolist(), common


def _measure_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 2000):
            part = batch.slice(k, 2000)
            columns = list(zip(*(measure(t) for t in part.column(2).to_pylist())))
            arrays = [pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(c, pa.list_(pa.int32())) for c in columns[5:]]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *arrays], names=["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "classes", "common"])


_MEASURES = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, classes array<int>, common array<int>"


def base_measures(docs: DataFrame) -> DataFrame:
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text").mapInArrow(_measure_all, _MEASURES).withColumn("base_failed", failed)


def references(measured: DataFrame, languages: list[str]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Summed histograms of each language over its documents that pass the base rules."""
    sums = [F.sum(F.col(c)[i].cast("long")).alias(f"{c}{i}") for c, n in (("classes", len(CLASSES)), ("common", WORDS)) for i in range(n)]
    rows = measured.where(~F.col("base_failed") & F.col("lang").isin(languages)).groupBy("lang").agg(*sums).collect()
    return {r.lang: (np.array(r[1 : 1 + len(CLASSES)], float), np.array(r[1 + len(CLASSES) :], float)) for r in rows}


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distance of each row of counts ``p`` to the counts ``q``; rows without counts: 0."""
    total = p.sum(axis=1, keepdims=True)
    p = p / np.maximum(total, 1)
    q = q / q.sum()
    m = (p + q) / 2

    def part(x: np.ndarray) -> np.ndarray:
        return np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(m > 0, m, 1)), 0).sum(axis=1)

    return np.where(total[:, 0] > 0, np.sqrt(np.clip((part(p) + part(np.broadcast_to(q, p.shape))) / 2, 0, 1)), 0)


def _judge(refs: dict[str, tuple[np.ndarray, np.ndarray]], max_classes: float, max_common: float, min_chars: int, min_words: int):
    langs = sorted(refs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            far = np.zeros((2, n))
            if refs and n:
                hists = [np.array(col[c].flatten().to_numpy(zero_copy_only=False), float).reshape(n, -1) for c in ("classes", "common")]
                each = np.array([[jensen_shannon(h, refs[g][k]) for g in langs] for k, h in enumerate(hists)])  # (2, languages, n)
                nearest = each.sum(axis=0).argmin(axis=0)
                own = np.array([langs.index(g) if g in refs else k for g, k in zip(col["lang"].to_pylist(), nearest)])
                far = each[:, own, np.arange(n)]
                far[0, hists[0].sum(axis=1) < min_chars] = 0
                far[1, hists[1].sum(axis=1) < min_words] = 0
            kept = ~np.array(col["base_failed"].to_pylist(), bool) & (far[0] <= max_classes) & (far[1] <= max_common)
            names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
            yield pa.RecordBatch.from_arrays([*(col[c] for c in names), pa.array(kept), pa.array(far[0]), pa.array(far[1])], names=[*names, "kept", "class_distance", "word_distance"])

    return run


def quality_verdicts(
    docs: DataFrame, languages: tuple[str, ...] = tuple(COMMON_WORDS), max_classes: float = 0.25, max_common: float = 0.45, min_chars: int = 200, min_words: int = 50
) -> DataFrame:
    """Base counts, distances and the verdict ``kept`` of every row of ``docs(doc_id, lang, text)``."""
    bounded_batches(docs.sparkSession)
    measured, _ = materialize(base_measures(docs), "quality")
    refs = references(measured, list(languages))
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double"
    return measured.mapInArrow(_judge(refs, max_classes, max_common, min_chars, min_words), schema)


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the verdicts that SQL can express: base counts and ``base_failed``."""
    return base_measures(table(spark, sf_dir, "documents")).drop("lang", "classes", "common")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents"))
