"""Reading record files: JSON lines, documents, Parquet, dataset-server pages, metrics text, trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str, permissive: bool = False) -> DataFrame:
    """JSON lines, also gzipped, by an explicit schema. A bad line fails the read, or is dropped if ``permissive``."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if permissive else "FAILFAST").json(path)


def jsonl_errors(spark: SparkSession, path: str) -> DataFrame:
    """file, offset-ordered row and text of the lines that are no JSON object; blank lines are skipped."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value"))
    return lines.where((F.trim("value") != "") & F.schema_of_variant(F.try_parse_json("value")).isNull() | (F.trim("value") != "") & ~F.ltrim("value").startswith("{"))


def require_rows(df: DataFrame, what: str = "result rows") -> DataFrame:
    """The frame itself; an error if it has no row."""
    if df.isEmpty():
        raise ValueError(f"no {what} found")
    return df


def single_rows(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """Files that hold exactly one row. Others raise, or give their first row if not ``strict``."""
    rows = spark.read.schema(schema).json(path).withColumn("_file", F.col("_metadata.file_path"))
    n = Window.partitionBy("_file")
    counted = rows.withColumn("_n", F.count("*").over(n)).withColumn("_k", F.row_number().over(n.orderBy(F.monotonically_increasing_id())))
    if strict:
        return counted.where(F.when(F.col("_n") == 1, True).otherwise(F.raise_error(F.concat(F.lit("more than one row in "), F.col("_file"))).cast("boolean"))).drop("_n", "_k")
    return counted.where("_k = 1").drop("_n", "_k")


def read_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One JSON object a file."""
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def read_tree(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Documents under a glob with ``path_order``: the path by its parts, which orders files."""
    return read_document(spark, pattern, schema).withColumn("path_order", F.split(F.col("_metadata.file_path"), "/"))


def read_parquet(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(*paths)


def read_server_page(spark: SparkSession, path: str, row_schema: str) -> DataFrame:
    """Rows of a dataset server's answer: ``rows[].row``, or the items themselves."""
    page = spark.read.option("multiLine", True).schema(f"rows array<struct<row:struct<{row_schema}>>>, items array<struct<{row_schema}>>").json(path)
    rows = F.coalesce(F.transform("rows", lambda r: r["row"]), F.col("items"))
    return page.select(F.explode(rows).alias("r")).select("r.*")


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by ``order``."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def reject_duplicates(df: DataFrame, *keys: str, conflicting_only: tuple[str, ...] = ()) -> DataFrame:
    """The frame; rows of a repeated key raise. With ``conflicting_only`` columns, only if those differ."""
    w = Window.partitionBy(*keys)
    bad = F.count("*").over(w) > 1
    if conflicting_only:
        bad = F.size(F.collect_set(F.struct(*conflicting_only)).over(w)) > 1
    named = F.concat_ws(",", *[F.col(k).cast("string") for k in keys])
    checked = df.withColumn("_ok", F.when(bad, F.raise_error(F.concat(F.lit("duplicate key: "), named)).cast("boolean")).otherwise(True))
    return checked.where("_ok").drop("_ok")


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    """First ``n`` rows by an order; any ``n`` rows without one, which ends a scan early."""
    return (df.orderBy(*order) if order else df).limit(n)


def first_rows_per_file(spark: SparkSession, path: str, n: int = 1000) -> DataFrame:
    """At most ``n`` physical lines of each text file."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value", F.monotonically_increasing_id().alias("at"))
    return rows.withColumn("line", F.row_number().over(Window.partitionBy("file").orderBy("at"))).where(F.col("line") <= n).select("file", "line", "value")


def read_sources(spark: SparkSession, root: str, ignored: tuple[str, ...] = (".git", "node_modules", "__pycache__", ".venv"), max_bytes: int = 200_000) -> DataFrame:
    """Files of a source tree by relative path, size and text; large ones as metadata only."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), f"^{root.rstrip('/')}/", "")
    out = files.select(path.alias("path"), "length", "modificationTime", F.when(F.col("length") <= max_bytes, F.col("content").cast("string")).alias("text"))
    return out.where(~F.arrays_overlap(F.split("path", "/"), F.lit(list(ignored))))


def read_gauges(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Metrics text: the last readable value of each gauge; labels are ignored."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("at"))
    return parse_gauges(lines, names)


def parse_gauges(lines: DataFrame, names: list[str]) -> DataFrame:
    """name and value from ``lines(value, at)``."""
    name, number = F.regexp_extract("value", r"^([A-Za-z_:][\w:]*)", 1), F.regexp_extract("value", r"(\S+)\s*$", 1)
    rows = lines.where(~F.col("value").startswith("#")).select(name.alias("name"), number.try_cast("double").alias("v"), "at")
    return rows.where(F.col("name").isin(names) & F.col("v").isNotNull()).groupBy("name").agg(F.max_by("v", "at").alias("value"))


def parse_gpu_line(lines: DataFrame) -> DataFrame:
    """Used and total memory and utilisation of a captured line of comma-separated numbers."""
    return lines.select(F.from_csv("value", F.lit("used double, total double, utilisation double"), {"ignoreLeadingWhiteSpace": "true"}).alias("g")).select("g.*")


def ragged_slices(index: DataFrame, arrays: DataFrame, per_block: int = 10_000) -> DataFrame:
    """Rows of a ragged store: ``index(record_index, offset, num_tokens)`` cut from ``arrays(block, offset, ids)``.

    Blocks hold ``per_block`` records each (see ``writers.concatenated``), so the join is by block number.
    """
    a = arrays.select("block", F.col("offset").alias("block_offset"), "ids")
    at = index.withColumn("block", F.floor(F.col("record_index") / per_block))
    return at.join(a, "block").withColumn("input_ids", F.slice("ids", (F.col("offset") - F.col("block_offset") + 1).cast("int"), F.col("num_tokens").cast("int"))).drop("ids", "block_offset", "block")
