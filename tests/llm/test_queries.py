"""The registered queries against their oracle SQL, and the pipeline."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folioforge.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    db = duckdb.connect()
    for table in ("documents", "benchmark", "labels", "conversations"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), db.sql(ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(got) == len(want)

    keys = [c for c in ("doc_id", "conv_id", "item_id") if c in columns]
    a, b = (df[columns].sort_values(keys).reset_index(drop=True) for df in (got, want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-12)


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline_decisions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, seen, SF).cache()
        assert after.columns == docs.columns, name
        assert after.join(seen, docs.columns, "left_anti").count() == 0
        seen = after
    good = corpus_pipeline.good_documents(spark, docs, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = labels.join(good.select("doc_id", F.lit(1).alias("kept")), "doc_id", "left").groupBy("quality").agg(F.count("kept") / F.count("*")).collect()
    shares = {r[0]: r[1] for r in kept}
    assert shares[1] > 0.97 and shares[0] < 0.25
    once = corpus_pipeline.deduplicated(spark, docs, SF)
    assert once.count() == QUERIES["op6_simhash"](spark, SF).select("component_id").distinct().count()
    clean = corpus_pipeline.clean_of_benchmarks(spark, docs, SF)
    held = QUERIES["op8_decontamination"](spark, SF).select("doc_id").distinct()
    assert clean.count() == docs.count() - held.count() and clean.join(held, "doc_id").count() == 0


def test_pipeline_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    rows = out.select("shard", "slot").collect()
    assert rows and len({tuple(r) for r in rows}) == len(rows)
    shards = pd.DataFrame([tuple(r) for r in rows], columns=["shard", "slot"]).groupby("shard")["slot"]
    assert (shards.max() + 1 == shards.count()).all() and (shards.min() == 0).all()


@pytest.mark.parametrize("index", range(5))
def test_stages_on_odd_tables(spark, docs_of, index):
    name, stage = corpus_pipeline.STAGES[index]
    plain = "some ordinary words of a page that goes on for a while without any harm"
    docs = docs_of((None, plain, None, None), (1, None), (2, ""), (3, plain + " x"), (3, plain + " x"), (4, "word " * 50_000), clash=True)
    out = stage(spark, docs, "/root/testdata/sf0.001")
    out.count()
    if index < 4:
        assert out.columns == docs.columns
    assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0
