"""Term search, relevance, source graphs and context assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lines, terms
from .joins import prefix_join


def term_overlap(queries: DataFrame, records: DataFrame, query_key: str, record_key: str, text: str = "text") -> DataFrame:
    """Distinct shared terms, and occurrences up to three of each, of all pairs that share one.

    Both sides are exploded to terms and joined on them, so pairs without a shared term never
    exist; counts of a record's terms are combined before the join.
    """
    q = queries.select(query_key, F.explode(F.array_distinct(terms(text))).alias("term"))
    r = records.select(record_key, F.explode(terms(text)).alias("term")).groupBy(record_key, "term").agg(F.count("*").alias("tf"))
    return r.join(q, "term").groupBy(query_key, record_key).agg(F.count("*").alias("overlap"), F.sum(F.least("tf", F.lit(3))).alias("capped_tf"))


def problem_score(overlap: Column, capped_tf: Column, status: Column | None = None, kind: Column | None = None) -> Column:
    bonus = (F.when(status == "pass", 0.5).otherwise(0.0) if status is not None else F.lit(0.0)) + (F.when(kind.isin("trajectory", "episode"), 0.25).otherwise(0.0) if kind is not None else F.lit(0.0))
    return overlap * F.lit(5.0) + capped_tf * F.lit(0.5) + bonus


def top_k(scored: DataFrame, by: str, key: str, k: int, score: str = "score") -> DataFrame:
    """Best ``k`` (1 to 50) with a positive score; ties by key."""
    k = min(50, max(1, k))
    w = Window.partitionBy(by).orderBy(F.col(score).desc(), key)
    return scored.where(F.col(score) > 0).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search_problems(queries: DataFrame, problems: DataFrame, k: int) -> DataFrame:
    hay = F.concat_ws(" ", "task_id", "instruction", "validation_command", F.array_join("files", " "), F.array_join("tags", " "), "final_status")
    found = term_overlap(queries, problems.withColumn("text", hay), "query", "record_id").join(problems.select("record_id", "final_status", "kind"), "record_id")
    return top_k(found.withColumn("score", problem_score(F.col("overlap"), F.col("capped_tf"), F.col("final_status"), F.col("kind"))), "query", "record_id", k)


def memory_score(task: Column, text: Column, tags: Column) -> Column:
    return F.size(F.array_intersect(terms(task), terms(text))) * F.lit(5.0) + F.size(tags)


def skill_score(task: Column, text: Column, priority: Column) -> Column:
    return F.size(F.array_intersect(terms(task), terms(text))) * F.lit(5.0) + priority


def file_score(path_hits: Column, symbol_hits: Column, text_hits: Column, role: Column) -> Column:
    return path_hits * F.lit(3.0) + symbol_hits * F.lit(2.5) + text_hits * F.lit(2.0) - F.when(role == "test", 1.0).otherwise(0.0)


def rank_files(task_terms: list[str], files: DataFrame, most: int, tests: bool = True) -> DataFrame:
    """Files by relevance; tests are left out after ranking, as the rank counts them."""
    wanted = F.lit(task_terms)
    n = lambda c: F.size(F.array_intersect(c, wanted))
    scored = files.withColumn("score", file_score(n(terms("path", True)), n(F.transform("symbols", F.lower)), n(terms("text", True)), F.col("role")))
    ranked = scored.where("score > 0").orderBy(F.col("score").desc(), "path").limit(most)
    return ranked if tests else ranked.where("role != 'test'")


def fit_budget(files: list[dict], chars: int) -> list[dict]:
    """Files within a character budget: snippets go first, then half of the files, again and again."""
    size = lambda fs: sum(len(f["path"]) + len(f.get("snippet") or "") for f in fs)
    if size(files) > chars:
        files = [{**f, "snippet": ""} for f in files]
    while len(files) > 1 and size(files) > chars:
        files = files[: len(files) // 2]
    return files


def import_graph(files: DataFrame) -> DataFrame:
    """(src, dst) of ``files(path, module, imports)``: an import names a module or a name in it."""
    wanted = files.select(F.col("path").alias("src"), F.explode("imports").alias("module_used"))
    known = files.select(F.col("module").alias("candidate"), F.col("path").alias("dst"))
    return prefix_join(wanted, known, "module_used").where("src != dst").select("src", "dst").distinct()


def reverse_graph(edges: DataFrame) -> DataFrame:
    return edges.groupBy("dst").agg(F.array_sort(F.collect_set("src")).alias("used_by"))


def repo_stats(files: DataFrame) -> DataFrame:
    return files.groupingSets([["role"], ["language"], []], "role", "language").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def snippets(files: DataFrame, words: list[str], before: int = 3, after: int = 5, most: int = 3) -> DataFrame:
    """Lines around matches, numbered; overlapping ranges of one file are one snippet."""
    rows = files.select("path", F.posexplode(lines("text")).alias("pos", "line"))
    hit = F.lit(False)
    for w in words:
        hit = hit | F.lower("line").contains(w.lower())
    near = Window.partitionBy("path").orderBy("pos").rowsBetween(-after, before)
    shown = rows.withColumn("show", F.max(hit).over(near)).where("show")
    island = F.col("pos") - F.row_number().over(Window.partitionBy("path").orderBy("pos"))
    g = shown.withColumn("i", island).groupBy("path", "i").agg(F.min("pos").alias("first"), F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: F.concat(F.lpad((x["pos"] + 1).cast("string"), 4, "0"), F.lit(": "), x["line"])), "\n")
    ranked = g.withColumn("k", F.row_number().over(Window.partitionBy("path").orderBy("first")))
    return ranked.where(F.col("k") <= most).select("path", (F.col("first") + 1).alias("line"), text.alias("snippet"))


def build_index(records: DataFrame, per_file: int = 1000) -> DataFrame:
    """Problem records, at most ``per_file`` of a source, the first of each (task, instruction, source)."""
    w = Window.partitionBy("source").orderBy("ordinal")
    some = records.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= per_file).drop("_k")
    once = Window.partitionBy("task_id", "instruction", "source").orderBy("ordinal")
    return some.withColumn("_k", F.row_number().over(once)).where("_k = 1").drop("_k")


def context_bundle(parts: dict[str, str], chars: int) -> str:
    """Titled parts that have text, in order, within a budget."""
    out = "\n\n".join(f"## {title}\n{text}" for title, text in parts.items() if text)
    return out[:chars]
