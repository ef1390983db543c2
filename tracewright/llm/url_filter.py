"""URL filters: rules by host and path first, gradient-boosted trees for all other URLs.

Everything on the main path is column expressions: parsing, rules, features and the
trees, which become nested ``CASE WHEN`` over the features and run inside the scan's
generated code, without a shuffle. Features are lexical: lengths, path depth, digit and
symbol ratios, character entropy of the host, parameter counts, and statistics of the
host's suffix (the smoothed log-odds of each public suffix among the labelled URLs).

Training takes a frame of labelled URLs, at most ``MAX_LABELLED`` of them, to the driver;
``op6_url_filter`` reads the table ``url_labels(url, label)`` beside the pages if there is
one. Where a deployment has none, ``seed_urls`` makes a labelled set by rule.

Defined cases: a null or empty URL and one without ``://`` has an empty host and path, no
rule, and the trees' verdict on empty features (allow); null ids and repeated rows are
judged row by row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import random

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MAX_LABELLED = 20_000
#: (host, path, verdict)
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
FEATURES = ["url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "symbol_ratio", "entropy", "params", "hyphens", "longest_label", "suffix_odds"]

# Words and endings that labelled hosts are made of.
_LURES = "account alert bonus cash casino cheap click coupon credit deal discount free gift instant login loan lucky meds offer pills prize promo replica reward secure slots update verify viagra winner".split()
_TOPICS = "academy archive astronomy bakery blog books bridge city college community courier daily docs forest forum garden guide harbor health history journal kitchen library market museum music news photos politics recipes research review science sports studio summit travel university weather wiki".split()
_COMMON_ENDINGS = "com org net edu gov de fr es co.uk io".split()
_CHEAP_ENDINGS = "top xyz click info biz com net org".split()
_PLAIN_PATHS = ["/", "/about", "/{year}/{n}/{topic}", "/{topic}/{topic2}.html", "/article/{n}", "/{topic}?page={n}", "/search?q={topic}&sort=date", "/en/{topic}/", "/{topic}#section{n}"]
_LURE_PATHS = ["/", "/{lure}/{lure2}", "/{n}{n2}/", "/{lure}.php?id={n}{n2}&aff={n}", "/go?u={n2}&src={lure}&c={n}", "/{lure}-{lure2}-{n}", "/?ref={n}", "/l/{n}{n2}{n}"]


def seed_urls(n: int = 4000) -> list[tuple[str, int]]:
    """Labelled URLs by rule, 1 to block and 0 to allow, where a deployment has none of its own.

    Blocked hosts chain words that lure, with hyphens, numbers and cheap endings more often;
    allowed ones are topics, also two of them, and institutions. Both have every kind of
    prefix and ending at times, so no single feature decides.
    """
    out = []
    for k in range(n):
        r = random.Random(f"url {k}")
        bad = k % 2
        some = r.sample(_LURES if bad else _TOPICS, 3)
        names = {"n": r.randrange(1, 1000), "n2": r.randrange(1000, 10**6), "year": r.randrange(1999, 2026), "lure": some[1], "lure2": some[2], "topic": some[1], "topic2": some[2]}
        if bad:
            host = r.choice(["-", "-", "", ""]).join(some[: r.choice([1, 2, 2, 3])]) + r.choice(["", "", str(r.randrange(10, 9999))])
        else:
            host = r.choice(["", "", "", "-"]).join([*some[: r.choice([1, 1, 2])]]) + r.choice(["", "", "", "s", str(r.randrange(1, 60))])
        prefix = r.choice(["", "", "www.", "www.", "m.", "blog.", "shop.", f"{some[2]}."])
        ending = r.choice(_CHEAP_ENDINGS if bad else _COMMON_ENDINGS)
        path = r.choice(_LURE_PATHS if bad else _PLAIN_PATHS).format(**names)
        out.append((f"{r.choice(['http', 'https'])}://{prefix}{host}.{ending}{path}", bad))
    return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(lowered, F.lit("")), F.coalesce(path, F.lit(""))


def rule_and_verdict(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):  # the last one that fits wins
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def suffix_of(host: Column) -> Column:
    """The last label, or the last two if the one before it has at most three letters."""
    return F.regexp_extract(host, r"((?:\.[a-z]{1,3})?\.[^.]*)$", 1)


def features(url: Column, host: Column, path: Column, odds: dict[str, float]) -> dict[str, Column]:
    url = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    letters = F.split(host, "")
    n = F.greatest(F.length(host), F.lit(1)).cast("double")
    share = lambda c: F.size(F.filter(letters, lambda x: x == c)) / n
    entropy = F.aggregate(F.array_distinct(F.filter(letters, lambda c: c != "")), F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c)))
    suffix = suffix_of(host)
    known = functools.reduce(lambda e, kv: F.when(suffix == kv[0], F.lit(kv[1])).otherwise(e), sorted(odds.items()), F.lit(0.0))
    length = F.greatest(F.length(url), F.lit(1)).cast("double")
    return {
        "url_length": F.length(url).cast("double"),
        "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "depth": _count(path, "/").cast("double"),
        "labels": F.when(host == "", 0.0).otherwise(_count(host, "[.]") + 1.0),
        "digit_ratio": _count(url, "[0-9]") / length,
        "symbol_ratio": _count(url, "[^A-Za-z0-9]") / length,
        "entropy": entropy,
        "params": F.when(query == "", 0.0).otherwise(_count(query, "&") + 1.0),
        "hyphens": _count(host, "-").cast("double"),
        "longest_label": F.array_max(F.transform(F.split(host, "[.]"), lambda x: F.length(x))).cast("double"),
        "suffix_odds": known,
    }


def _leaf(g: np.ndarray, h: np.ndarray) -> float:
    return float(g.sum() / (h.sum() + 1.0))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
    """A tree: a leaf's value, or (feature, threshold, at most it, above it). Histogram splits."""
    best = (1e-3, None)
    total = g.sum() ** 2 / (h.sum() + 1.0)
    if depth and len(x) >= 20:
        for j in range(x.shape[1]):
            for cut in np.unique(np.quantile(x[:, j], np.linspace(0.03, 0.97, 24))):
                left = x[:, j] <= cut
                if 8 <= left.sum() <= len(x) - 8:
                    gl, hl = g[left].sum(), h[left].sum()
                    gain = gl**2 / (hl + 1.0) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1.0) - total
                    if gain > best[0]:
                        best = (gain, (j, float(cut)))
    if best[1] is None:
        return _leaf(g, h)
    j, cut = best[1]
    left = x[:, j] <= cut
    return j, cut, _grow(x[left], g[left], h[left], depth - 1), _grow(x[~left], g[~left], h[~left], depth - 1)


def _values(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    j, cut, low, high = tree
    return np.where(x[:, j] <= cut, _values(low, x), _values(high, x))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.3) -> tuple[float, list]:
    """Boosting on the logistic loss with second-order leaves."""
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    score, out = np.full(len(y), base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        tree = _grow(x, rate * (y - p), p * (1 - p), depth)
        score += _values(tree, x)
        out.append(tree)
    return base, out


def tree_column(tree, cols: list[Column]) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    j, cut, low, high = tree
    return F.when(cols[j] <= cut, tree_column(low, cols)).otherwise(tree_column(high, cols))


def suffix_odds(suffixes: list[str], labels: list[int], most: int = 200) -> dict[str, float]:
    """Smoothed log-odds of blocking for each of the ``most`` commonest suffixes."""
    odds = {}
    for s in sorted(set(suffixes), key=lambda s: (-suffixes.count(s), s))[:most]:
        bad = sum(y for t, y in zip(suffixes, labels) if t == s)
        odds[s] = float(np.log((bad + 2.0) / (suffixes.count(s) - bad + 2.0)))
    return odds


def _with_features(urls: DataFrame, odds: dict[str, float]) -> DataFrame:
    host, path = host_and_path(F.col("url"))
    parsed = urls.withColumns({"host": host, "path": path})
    return parsed.withColumns(features(F.col("url"), F.col("host"), F.col("path"), odds))


def train(labelled: DataFrame) -> tuple[dict[str, float], tuple[float, list]]:
    """Fit on ``labelled(url, label)``; more than ``MAX_LABELLED`` rows are sampled by hash."""
    bounded = labelled.select("url", F.col("label").cast("int").alias("label")).dropna().orderBy(F.xxhash64("url"), "url", "label").limit(MAX_LABELLED)
    host, _ = host_and_path(F.col("url"))
    rows = _with_features(bounded, {}).select(suffix_of(host).alias("suffix"), "label", *FEATURES).collect()
    y = np.array([r.label for r in rows], float)
    odds = suffix_odds([r.suffix for r in rows], y.astype(int).tolist())
    x = np.array([[odds.get(r.suffix, 0.0) if f == "suffix_odds" else r[f] for f in FEATURES] for r in rows], float).reshape(-1, len(FEATURES))
    return odds, fit_trees(x, y)


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str, str]], model, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and the trees' probability that a URL is to be blocked."""
    odds, (base, trees) = model
    rows = _with_features(pages.select("page_id", "url"), odds)
    cols = [F.col(f) for f in FEATURES]
    margin = functools.reduce(lambda a, b: a + b, (tree_column(t, cols) for t in trees), F.lit(base))
    rule, verdict = rule_and_verdict(F.col("host"), F.col("path"), rules)
    score = F.when(F.col("host") == "", F.lit(0.0)).otherwise(1 / (1 + F.exp(-margin)))
    judged = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), score.alias("score"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the filter that SQL can express: host, path and rule."""
    host, path = host_and_path(F.col("url"))
    rows = table(spark, sf_dir, "pages").select("page_id", host.alias("host"), path.alias("path"))
    return rows.withColumn("rule", rule_and_verdict(F.col("host"), F.col("path"), RULES)[0])


def labelled_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    try:
        return table(spark, sf_dir, "url_labels").select("url", "label")
    except AnalysisException:  # no such table
        return spark.createDataFrame(seed_urls(), "url string, label int")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"), RULES, train(labelled_urls(spark, sf_dir)))
