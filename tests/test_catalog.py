"""Every registered query against its oracle, and the shape of the plans that matter."""

from __future__ import annotations

import math
import re
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from folioforge.operators.assemble import assemble_chunks
from folioforge.operators.chunk import chunk_documents
from folioforge.operators.enforce import enforce
from folioforge.operators.history import history_page
from folioforge.operators.transitions import admit_books
from folioforge.plans import catalog

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="test tables are not mounted")
ORACLES = catalog.ORACLES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in SF.glob("*.parquet"):
        con.sql(f"create view {file.stem} as select * from '{file}'")
    return con


def rows(pdf: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return f"{float(v):.9g}" if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)

    ordered = pdf[sorted(pdf.columns)]
    return sorted(tuple(cell(v) for v in r) for r in ordered.itertuples(index=False))


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(ORACLES)
    assert set(catalog.QUERIES) <= set(driver.queries()) and set(ORACLES) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    got = catalog.QUERIES[name](spark, str(SF)).toPandas()
    expected = duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


def test_entry(spark):
    assert driver.entry(spark).columns == ["lang", "category", "fixes"]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_text_operators_do_not_shuffle_and_prune_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for df in (
        enforce(docs.select("doc_id", "text"), audit=True),
        chunk_documents(docs),
    ):
        text = plan(df)
        assert "Exchange" not in text
        assert re.search(r"ReadSchema: struct<doc_id:bigint,text:string>", text)


def test_cursor_is_pushed_to_the_scan(spark):
    df = spark.read.parquet(f"{SF}/orders.parquet")
    page = history_page(df, cursor=100, id_col="o_orderkey", ts_col="o_orderdate")
    text = plan(page)
    assert "PushedFilters: [Or(LessThan(o_orderdate" in text and "TakeOrderedAndProject" in text


def test_assembly_shuffles_texts_once(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "text")
    out = assemble_chunks(df, id_col="conv_id", order_col="turn")
    out.collect()
    final = plan(out).split("Initial Plan")[0]
    assert final.count("Exchange hashpartitioning") == 1


def test_assembly_takes_its_rows_once(spark):
    """What makes the pieces runs once, however many branches read the grouping."""
    rows = [(k, i, f"{k} {i}.") for k in "abc" for i in range(10 if k == "a" else 2)]
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    ddl = "doc_id string, chunk_index int, text string"
    df = spark.createDataFrame(rows, ddl).repartition(3, "doc_id").mapInPandas(counted, ddl)
    got = {r.doc_id: (r.text, r.n) for r in assemble_chunks(df, block_rows=4, totals={"n": ("sum", F.lit(1))}).collect()}
    assert got == {k: ("\n\n".join(t for i, _, t in rows if i == k), 10 if k == "a" else 2) for k in "abc"}
    assert seen.value == len(rows)


def test_chapters_of_a_book_meet_its_facts_in_parts(spark):
    rows = [("big", i, f"text {i}") for i in range(90)] + [("huge", i, f"text {i}") for i in range(101)]
    df = spark.createDataFrame(rows, "book_id string, chapter_index int, text string")
    wanted = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        accepted, rejected = admit_books(df)
        got = accepted.withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r.book_id, r.chapter_index, r.total_chapters) for r in got) == [("big", i, 90) for i in range(90)]
    assert len({r.task for r in got}) > 1
    assert [r.reason for r in rejected.collect()] == ["too_many_chapters"]
