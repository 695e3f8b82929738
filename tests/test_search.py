"""The search store finds what a scan finds, from few blocks."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from folioforge.operators.search import (
    BLOCK, GRAM, blocks_with, search_store, text_search, trigrams, write_search_store,
)

ROWS = [
    (1, "A quiet Garden", "by the river"),
    (2, None, "GARDEN wall"),
    (3, "", None),
    (4, "x" * 120_000 + "needle" + "y" * 9, ""),
    (None, "no id, a garden", None),
    (1, "repeated id", "garden \U0001f600 path"),
    *[(i, f"filler row {i} of plain words", f"tail {i * 7919}") for i in range(10, 400)],
]
DDL = "id long, title string, body string, search_note string"
FIELDS = ("title", "body")


def fields():
    return [F.col(c) for c in FIELDS]


@pytest.fixture(scope="module")
def rows_in(spark):
    return spark.createDataFrame([(*r, "n") for r in ROWS], DDL)


@pytest.fixture(scope="module")
def store(spark, rows_in, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("search") / "store")
    write_search_store(rows_in, path, fields(), ["id"], blocks=64)
    return path


def found(df):
    return sorted((tuple(r) for r in df.select("id", "title", "body", "search_note").collect()), key=repr)


@pytest.mark.parametrize(
    "needle",
    ["garden", " GARDEN ", "n by", "needle", "\U0001f600 p", "a", "zq", "", "  ", "garden wall", "not there", "plain words", "row 39", "%_.*"],
)
def test_store_equals_scan(spark, rows_in, store, needle):
    assert found(search_store(spark, store, needle)) == found(text_search(rows_in, needle, fields()))


def test_only_blocks_with_all_trigrams_are_read(spark, store):
    assert len(blocks_with(spark, store, "needle")) == 1
    assert blocks_with(spark, store, "not there") == [] and blocks_with(spark, store, "ab") is None
    plan = search_store(spark, store, "needle")._jdf.queryExecution().executedPlan().toString()
    assert re.search(rf"PartitionFilters: \[[^]]*{BLOCK}", plan)
    index = spark.read.parquet(f"{store}/index")
    assert index.count() == index.distinct().count()
    hits = index.filter(F.col(GRAM).isin(["gar"]))
    assert "PushedFilters: [" in hits._jdf.queryExecution().executedPlan().toString()


def test_trigrams(spark):
    texts = spark.createDataFrame([("abcabc",), ("ab",), ("",), (None,), ("a\U0001f600bc",)], "t string")
    got = [r[0] for r in texts.select(trigrams(F.col("t"))).collect()]
    assert got == [["abc", "bca", "cab"], None, None, None, ["a\U0001f600b", "\U0001f600bc"]]


def test_empty_store(spark, rows_in, tmp_path):
    path = str(tmp_path / "store")
    write_search_store(rows_in.limit(0), path, fields(), ["id"])
    assert search_store(spark, path, "garden").count() == 0
