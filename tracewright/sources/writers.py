"""Writing record sets, manifests, checksums and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Compact JSON lines, non-ASCII kept. Spark's commit makes the folder appear as a whole."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    write_jsonl(df, path, "append")


def replace_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def guarded(out: str, source: str) -> str:
    """The output path; an error if it lies in the source's tree."""
    if (out.rstrip("/") + "/").startswith(source.rstrip("/") + "/"):
        raise ValueError("the output must lie outside the source")
    return out


def write_routes(df: DataFrame, path: str, column: str = "route") -> None:
    """All outputs of a classification in one pass, a folder for each route."""
    df.write.partitionBy(column).parquet(path)


def write_messages(df: DataFrame, path: str) -> None:
    df.select("messages").write.parquet(path)


def write_windows(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.option("header", True).csv(path)


def write_manifest(summary: DataFrame, path: str) -> None:
    """One JSON row."""
    summary.coalesce(1).write.mode("overwrite").json(path)


def concatenated(df: DataFrame, ids: str = "input_ids", per_block: int = 10_000) -> DataFrame:
    """Concatenated id blocks of rows with ``record_index`` and ``offset``: block, offset, ids."""
    block = F.floor(F.col("record_index") / per_block)
    parts = df.groupBy(block.alias("block")).agg(F.min("offset").alias("offset"), F.array_sort(F.collect_list(F.struct("record_index", F.col(ids).alias("ids")))).alias("r"))
    return parts.select("block", "offset", F.flatten(F.transform("r", lambda x: x["ids"])).alias("ids"))


def file_manifest(df: DataFrame, root: str) -> DataFrame:
    """Relative path, size and SHA-256 of files read by the ``binaryFile`` source."""
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), f"^{root.rstrip('/')}/", "")
    return df.select(path.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def checksum_lines(manifest: DataFrame) -> DataFrame:
    return manifest.orderBy("path").select(F.concat_ws("  ", "sha256", "path").alias("line"))


def verify_copy(source: DataFrame, copy: DataFrame) -> DataFrame:
    """Differences of two manifests: missing, extra or changed paths. No rows: a faithful copy."""
    s, c = source.select("path", F.col("sha256").alias("before")), copy.select("path", F.col("sha256").alias("after"))
    state = F.when(F.col("after").isNull(), "missing").when(F.col("before").isNull(), "extra").otherwise("changed")
    return s.join(c, "path", "full").where(~F.col("before").eqNullSafe(F.col("after"))).select("path", state.alias("state"))


def snapshot_id(manifest: DataFrame) -> DataFrame:
    """One hash for a set of files, whatever order they are listed in."""
    lines = F.array_sort(F.collect_list(F.concat_ws(" ", "sha256", "path")))
    return manifest.agg(F.sha2(F.array_join(lines, "\n"), 256).alias("snapshot_id"), F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def external_name(path, sha256):
    """Content-addressed name of a file kept outside its tree."""
    return F.concat(F.left(sha256, F.lit(16)), F.lit("-"), F.regexp_extract(path, "([^/]+)$", 1))


def markdown_table(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """A Markdown table as one text."""
    head = F.lit("| " + " | ".join(columns) + " |\n|" + " --- |" * len(columns) + "\n")
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), row.alias("r")))), lambda x: x["r"])
    return df.agg(F.concat(head, F.array_join(rows, "\n")).alias("markdown"))


def run_bundle(trajectories: DataFrame, path: str) -> None:
    """Trajectory, messages, patch and summary of runs, each in its folder."""
    trajectories.write.json(f"{path}/trajectory")
    trajectories.select("trajectory_id", "messages").write.json(f"{path}/messages")
    trajectories.select("trajectory_id", "patch").write.json(f"{path}/patch")
    trajectories.select("trajectory_id", "status", F.size("messages").alias("message_count")).write.json(f"{path}/summary")
