"""Registered queries against their SQL, and the pipeline's stages on small documents."""

from __future__ import annotations

import os

import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the small data set is not here")


def test_every_operator_and_the_pipeline_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names


@pytest.mark.parametrize("name", ["op5_url_filters", "op7_mixing", "op9_quality_rules", "sharded_rows"])
def test_sql_gives_the_same_rows(spark, name):
    import duckdb

    from tidewright.llm.queries import ORACLE_SQL, QUERIES

    db = duckdb.connect()
    for t in ("documents", "pages"):
        db.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = db.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, DATA).select(*want.columns)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))


def test_pipeline(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in c.STAGES:
        out = stage(spark, docs, DATA)
        if name != "byte_bpe":
            assert out.columns == columns, name
        if name in ("quality_rules", "simhash_near_dedup"):
            assert 0.5 * n < out.count() <= n
        docs = spark.createDataFrame(out.collect(), out.schema)
        n = docs.count()
    assert {"doc_id", "ids"} <= set(docs.columns)
    assert c.run(spark, DATA).columns == docs.columns


def test_a_sample_of_quality_is_bounded_in_bytes(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tidewright.llm import quality

    monkeypatch.setattr(quality, "SAMPLE_BYTES", 1 << 20)
    long = spark.range(200).select(F.expr("repeat(concat('word', id, ' '), 15000)").alias("text"))
    got = quality._sample(long, "p_", "text", 500).agg(F.sum(F.octet_length("p_text")), F.count("*"), F.countDistinct("p_row")).first()
    assert 0 < got[0] < 3 << 20 and got[1] == got[2]
    copies = spark.range(4000).select(F.lit("one text that comes four thousand times over in this table").alias("text"))
    assert 300 < quality._sample(copies, "p_", "text", 500).count() < 700
    assert [r.name for r, _, _ in quality.estimate(spark.createDataFrame([], "text string"))]
