"""Every query that has SQL against DuckDB, over the smallest tables."""

import math
import os

import duckdb
import pytest

from lectern.plans import ORACLES, QUERIES
from lectern.plans.views import TABLES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{round(value, 9) + 0.0!r}"
    return repr(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    rows, columns = df.collect(), sorted(df.columns)
    if name not in ORACLES:
        assert rows
        return
    told = con.sql(ORACLES[name])
    assert sorted(told.columns) == columns
    at = [told.columns.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in rows) == sorted(tuple(plain(r[i]) for i in at) for r in told.fetchall())


@pytest.mark.parametrize("name", ["d22_history", "d23_prompt_messages"])
def test_messages_cut_or_blank_at_white_space(spark, tmp_path, name):
    """SQL's trim takes off spaces, those of Unicode too, and leaves tabs and line feeds."""
    texts = ["a" * 199 + "\nb", "a" * 198 + " \n" + "b", "a" * 199 + " b", "\n", "  ", "a" * 198 + "\n " + "b", "\t", "short \n"]
    said = [(k // 2, k % 2, ("user", "assistant")[k % 2], t) for k, t in enumerate(texts)]
    spark.createDataFrame(said, "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    c = duckdb.connect()
    for t in TABLES:
        if t != "conversations":
            os.symlink(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
        c.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet{'/*.parquet' if t == 'conversations' else ''}'")
    df, told = QUERIES[name](spark, str(tmp_path)), c.sql(ORACLES[name])
    at = [told.columns.index(x) for x in df.columns]
    assert sorted(map(repr, df.rdd.map(tuple).collect())) == sorted(repr(tuple(r[i] for i in at)) for r in told.fetchall())


@pytest.mark.parametrize("name", ["a16_markdown_report", "a17_flat_export", "e16_verdict_requests", "f16_feedback_export"])
def test_lines_are_exchanged_once(spark, name):
    """Requirements, sources and quotes come from one scan of the lines, as each exchange of them costs several times the input."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1


def test_lines_of_the_export_are_stored_compressed(spark):
    files = QUERIES["a14_feedback_csv"](spark, SF).inputFiles()
    assert files and all(f.endswith(".gz") for f in files)
