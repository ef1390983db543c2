"""Each stage against a brute-force version on its own input."""

import collections

import duckdb

import corpus_pipeline
from tracewright.llm.common import materialize

from test_operators import components

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "ngram_join", "decontamination", "pii", "packing"]
    labels = dict(duckdb.sql(f"select doc_id, toxic from '{SF}/labels.parquet'").fetchall())

    a, _ = materialize(stages["toxicity"](spark, docs, SF), "a")
    left = {r.doc_id for r in a.collect()}
    agree = sum((i in left) != bool(toxic) for i, toxic in labels.items())  # nine toxic texts to learn from
    assert a.columns == columns and agree >= 0.9 * len(labels), (agree, len(labels))

    b, _ = materialize(stages["ngram_join"](spark, a, SF), "b")
    group = {i: c for i, _, c in components(sorted((r.doc_id, r.text) for r in a.collect()))}
    assert sorted(r.doc_id for r in b.collect()) == sorted(set(group.values()))

    c, _ = materialize(stages["decontamination"](spark, b, SF), "c")
    items = [t for (t,) in duckdb.sql(f"select text from '{SF}/benchmark.parquet'").fetchall()]
    whole = {r.doc_id for r in b.collect() if any(t in r.text for t in items)}
    gone = {r.doc_id for r in b.collect()} - {r.doc_id for r in c.collect()}
    assert whole <= gone and len(gone) <= 2 * len(whole) + 1

    d, _ = materialize(stages["pii"](spark, c, SF), "d")
    before, after = ({r.doc_id: r for r in x.collect()} for x in (c, d))
    assert d.columns == columns and before.keys() == after.keys()
    assert all(r.n_chars == len(r.text) for r in after.values())
    assert 0 < sum(before[i].text != after[i].text for i in before) < len(before) / 2

    out = stages["packing"](spark, d, SF).collect()
    total = collections.Counter()
    for r in out:
        total[r.doc_id] += r.length
    assert total.keys() == after.keys() and all(total[r.doc_id] == r.doc_tokens for r in out)


def test_clashing_columns(spark):
    """Columns named like the operators' own go through all stages unchanged."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40).selectExpr("*", "doc_id * 2 as score", "doc_id * 3 as n_email", "doc_id * 5 as _rank", "1 as _", "2 as row", "3 as kh")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs, _ = materialize(stage(spark, docs, SF), "clash")
    rows = docs.collect()
    assert rows and all((r.score, r.n_email, r._rank) == (2 * r.doc_id, 3 * r.doc_id, 5 * r.doc_id) for r in rows)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
