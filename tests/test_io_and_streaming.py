import gzip
import json

import pytest
from pyspark.sql import functions as F

from tracewright.operators import search as R
from tracewright.schemas import SAMPLE
from tracewright.sources import readers, writers
from tracewright.streaming import monitor


def put(path, *rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in rows))
    return str(path)


def test_jsonl(spark, tmp_path):
    p = put(tmp_path / "a.jsonl", {"a": 1, "t": "x y"}, "", {"a": 2}, "{bad")
    with pytest.raises(Exception):
        readers.read_jsonl(spark, p, "a int, t string").collect()
    assert {(r.a, r.t) for r in readers.read_jsonl(spark, p, "a int, t string", permissive=True).collect()} == {(1, "x y"), (2, None)}
    assert [r.value for r in readers.jsonl_errors(spark, p).collect()] == ["{bad"]
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as f:
        f.write('{"a": 3}\n')
    assert readers.read_jsonl(spark, str(tmp_path / "b.jsonl.gz"), "a int").first().a == 3
    with pytest.raises(ValueError):
        readers.require_rows(spark.createDataFrame([], "a int"))


def test_trees_pages_and_singles(spark, tmp_path):
    for k in (1, 2):
        put(tmp_path / f"sample_{k}/tasks/x/y/result.json", {"instance_id": f"t{k}"})
    assert readers.read_tree(spark, f"{tmp_path}/sample_*/tasks/*/*/result.json", "instance_id string").count() == 2
    p = put(tmp_path / "page.json", {"rows": [{"row": {"a": 1}}, {"row": {"a": 2}}]})
    assert sorted(r.a for r in readers.read_server_page(spark, p, "a int").collect()) == [1, 2]
    put(tmp_path / "one/a.jsonl", {"a": 1}), put(tmp_path / "one/b.jsonl", {"a": 2}, {"a": 3})
    assert {r.a for r in readers.single_rows(spark, f"{tmp_path}/one", "a int", strict=False).collect()} >= {1}
    with pytest.raises(Exception, match="more than one row"):
        readers.single_rows(spark, f"{tmp_path}/one", "a int").collect()


def test_gauges(spark, tmp_path):
    p = put(tmp_path / "m.txt", "# HELP x", 'running{a="b"} 1', "running 3", "cache bad", "cache 0.5", "other 9")
    assert {r.name: r.value for r in readers.read_gauges(spark, p, ["running", "cache"]).collect()} == {"running": 3.0, "cache": 0.5}
    assert readers.parse_gpu_line(spark.createDataFrame([("10, 20, 30",)], "value string")).first().total == 20


def test_sources_and_graph(spark, tmp_path):
    put(tmp_path / "src/pkg/a.py", "import pkg.b\nfrom pkg import c"), put(tmp_path / "src/pkg/b.py", "x = 1\nfind me\n"), put(tmp_path / "src/.git/x.py", "no")
    files = readers.read_sources(spark, str(tmp_path / "src"))
    assert {r.path for r in files.collect()} == {"pkg/a.py", "pkg/b.py"}
    from tracewright.functions.text import module_name
    from tracewright.functions.toolcalls import outline

    m = files.select("path", module_name("path").alias("module"), outline("text")["imports"].alias("imports"))
    edges = R.import_graph(m)
    assert [tuple(r) for r in edges.collect()] == [("pkg/a.py", "pkg/b.py")] and R.reverse_graph(edges).first().used_by == ["pkg/a.py"]
    assert R.snippets(files, ["find"], 1, 0).first().snippet == "0001: x = 1\n0002: find me"


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", "é", "x"), ("b", None, "y")], "k string, v string, route string")
    out = str(tmp_path / "o")
    writers.write_jsonl(df, out)
    assert '"v":null' in "".join(r.value for r in spark.read.text(out).collect())
    with pytest.raises(Exception):
        writers.write_jsonl(df, out)
    writers.append_jsonl(df, out)
    assert spark.read.json(out).count() == 4
    writers.write_routes(df, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r/route=x")).count() == 1
    with pytest.raises(ValueError):
        writers.guarded(f"{tmp_path}/o/inner", out)
    raw = spark.read.format("binaryFile").load(f"{out}/*.json")
    m = writers.file_manifest(raw, out)
    assert writers.verify_copy(m, m).isEmpty() and writers.verify_copy(m, m.limit(0)).first().state == "missing"
    assert len(writers.snapshot_id(m).first().snapshot_id) == 64
    assert writers.markdown_table(df, ["k", "v"], "k").first().markdown.endswith("| a | é |\n| b |  |")


def test_ragged_store(spark):
    rows = spark.createDataFrame([(0, 0, 2, [1, 2]), (1, 2, 3, [3, 4, 5])], "record_index int, offset long, num_tokens int, input_ids array<int>")
    blocks = writers.concatenated(rows)
    back = readers.ragged_slices(rows.drop("input_ids"), blocks)
    assert {r.record_index: r.input_ids for r in back.collect()} == {0: [1, 2], 1: [3, 4, 5]}


def test_search_ranks(spark):
    q = spark.createDataFrame([("q", "fix parser error")], "query string, text string")
    p = spark.createDataFrame([(1, "t1", "parser error parser", "fail", "task"), (2, "t2", "parser", "pass", "trajectory"), (3, "t3", "nothing", "pass", "task")], "record_id int, task_id string, instruction string, final_status string, kind string").withColumns({"validation_command": F.lit(""), "files": F.array().cast("array<string>"), "tags": F.array().cast("array<string>")})
    assert [(r.record_id, r.score) for r in R.search_problems(q, p, 5).orderBy("rank").collect()] == [(1, 11.5), (2, 6.25)]


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    for k in range(3):
        put(src / f"{k}.json", *[{"instance_id": f"t{i}", "dataset": "d", "sample_index": k, "benchmark_resolved": [True, False, None][(i + k) % 3], "attempt_index": 0} for i in range(5)])
    stream = monitor.progress(monitor.sample_stream(spark, str(src), files=1), 15)
    monitor.run_available(stream, str(tmp_path / "cp"), monitor.snapshot_sink(str(tmp_path / "out"))).awaitTermination(120)
    batch = monitor.progress(spark.read.schema(SAMPLE).json(str(src)), 15).collect()
    last = spark.read.json(f"{tmp_path}/out/batch=2").select(*batch[0].__fields__).collect()
    assert [tuple(r) for r in last] == [tuple(r) for r in batch] and not monitor.reached(spark.createDataFrame(batch), 99)


def test_latest_attempts(spark):
    df = spark.createDataFrame([("t", 0, "d", None, 2), ("t", 0, "d", True, 1), ("t", 0, "d", None, 0)], "instance_id string, sample_index int, dataset string, benchmark_resolved boolean, attempt_index int")
    assert monitor.latest_attempts(df).first().attempt_index == 1
