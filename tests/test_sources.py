"""Snapshots of a change feed and pages of a clustered table on small fixtures."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from folioforge.operators.history import history_page
from folioforge.operators.paging import clustered_page, page_files, write_in_page_order
from folioforge.sources.snapshots import BUCKET, _finished, append_changes, compact, snapshot

DDL = "id long, v string, ts int"
HOW = {"key": "id", "order": ["ts"]}


def state(spark, path, **options):
    return {r.id: r.v for r in snapshot(spark, path, DDL, **HOW, **options).collect()}


def test_snapshot_merges_late_repeated_and_compacted_batches(spark, tmp_path):
    path = str(tmp_path / "view")
    batches = [
        [(1, "a", 5), (2, "b", 1), (None, "n", 1)],
        [(1, "old", 3), (2, "c", 2), (3, "d", 1)] + [(4, f"x{i}", i) for i in range(500)],
        [(None, "m", 2), (3, "e", 7)],
    ]
    assert state(spark, path) == {}
    compact(spark, path, DDL, **HOW)  # nothing to compact
    frames = [spark.createDataFrame(b, DDL) for b in batches]
    append_changes(frames[0], path, 0, **HOW)
    append_changes(frames[1], path, 1, **HOW)
    two = {1: "a", 2: "c", 3: "d", 4: "x499", None: "n"}
    assert state(spark, path) == two
    compact(spark, path, DDL, **HOW)
    assert state(spark, path) == two and _finished(spark, f"{path}/base") == [1]
    append_changes(frames[0], path, 0, **HOW)  # the base holds it
    for _ in range(2):
        append_changes(frames[2], path, 2, **HOW)
    assert _finished(spark, f"{path}/delta") == [0, 1, 2]
    assert state(spark, path) == two | {3: "e", None: "m"}
    assert state(spark, path, keys=[3, 9]) == {3: "e"}


def test_looking_up_keys_reads_their_buckets_only(spark, tmp_path):
    path = str(tmp_path / "view")
    append_changes(spark.range(1000).selectExpr("id", "'x' as v", "1 as ts"), path, 0, **HOW)
    plan = snapshot(spark, path, DDL, keys=[5], **HOW)._jdf.queryExecution().executedPlan().toString()
    assert f"PartitionFilters: [isnotnull({BUCKET}" in plan


def test_pages_of_a_clustered_table(spark, tmp_path):
    path, start = str(tmp_path / "pages"), datetime(2024, 1, 1)
    rows = [(i, None if i % 50 == 0 else start + timedelta(hours=i * 7 % 97)) for i in range(1, 400)]
    df = spark.createDataFrame(rows, "translation_id long, created_at timestamp").repartition(5)
    write_in_page_order(df, path, rows_per_file=30)
    assert spark.read.parquet(f"{path}/files").count() >= 14
    order = df.orderBy(F.desc("created_at"), F.desc("translation_id")).collect()
    after, seen = None, []
    while True:
        assert len(page_files(spark, path, after, 50)) <= 4
        page = clustered_page(spark, path, after, 50).orderBy(F.desc("created_at"), F.desc("translation_id")).collect()
        seen += [r.translation_id for r in page]
        if not page or page[0].next_cursor is None:
            break
        after = (page[-1].created_at, page[-1].translation_id)
    assert seen == [r.translation_id for r in order]
    first = {tuple(r) for r in history_page(df).collect()}
    assert {tuple(r) for r in clustered_page(spark, path).collect()} == first
    assert clustered_page(spark, path, after=(None, 0)).count() == 0
