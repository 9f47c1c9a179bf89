"""The pipeline's stages on small tables, and the queries that have SQL."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.functions.storage import table
from lectern.llm.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_stages_keep_columns_and_shrink(spark):
    docs = table(spark, SF, "documents")
    n = docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF).cache()
        assert after.columns == docs.columns
        assert 0 < after.count() <= n
        n, docs = after.count(), after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").isEmpty()
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "piece", "ids_crc32").collect())) == sorted(map(tuple, packed.select("doc_id", "piece", "ids_crc32").collect()))


def test_stages_take_an_empty_table(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_stages_take_awkward_rows(spark):
    """Nulls, repeated rows and ids, empty and very long texts, and columns with names that stages use, through every stage."""
    whole = table(spark, SF, "documents")
    text = whole.where("length(text) > 600").orderBy("doc_id").first()["text"]
    rows = [(None, text), (None, None), (5001, text), (5001, text), (5001, f"{text} and more"), (5002, ""), (5003, None), (5004, " \n"), (5005, "w " * 60_000), (5006, "alone here"), (5006, "other words")]
    clashing = ["row", "ident", "id", "first", "kept", "words", "base", "score", "table", "key", "n", "way", "__hits", "__quality", "__lines", "__row"]
    extra = [c for c in whole.columns if c not in ("doc_id", "text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit(None).cast(dict(whole.dtypes)[c]).alias(c) for c in extra), *(F.lit(7).alias(c) for c in clashing)).select(*whole.columns, *clashing)
    stages = dict(corpus_pipeline.STAGES)
    made = {name: [(r["doc_id"], r["text"]) for r in stage(spark, docs, SF).collect()] for name, stage in corpus_pipeline.STAGES[:-1]}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns and {tuple(r) for r in after.select(*clashing).collect()} <= {(7,) * len(clashing)}
    # Judged by its text alone: all rows of a text stay or go together; null, empty and short ones go.
    assert set(made["quality_rules"]) in ({(None, text), (5001, text), (5001, f"{text} and more")}, set(), {(None, text), (5001, text)}) and made["quality_rules"].count((5001, text)) in (0, 2)
    assert len(made["line_dedup"]) == len(rows) and made["line_dedup"].count((5001, text)) in (0, 2) and (5003, None) in made["line_dedup"]
    assert sorted(i for i, _ in made["near_dedup"]) == [5001, 5002, 5005, 5006, 5006]
    assert sorted(made["decontamination"], key=str) == sorted(rows, key=str)
    packed = stages["packing"](spark, docs, SF)
    assert packed.where("piece = 0").count() == len(rows) and packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").isEmpty()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    told = con.sql(ORACLES[name])
    df = QUERIES[name](spark, SF)
    assert sorted(told.columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*told.columns).collect())) == sorted(told.fetchall())
