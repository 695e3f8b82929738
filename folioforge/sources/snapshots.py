"""Compacted snapshot of a change log: a base and later deltas, merged when read.

``path/delta/batch=N`` holds the newest row per key of batch N, ``path/base/batch=N`` the
newest row per key of everything up to batch N; both lie in buckets of the key.  A folder
counts once it is complete.  Writing a batch again replaces its delta, or does nothing if a
base holds it already, so a stream may repeat its batches after a failure.

A batch is reduced to one row per key before its rows are moved, so a key with very many
changes weighs no more than any other.  Null keys are a key.  Extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.state import latest_by_key

BUCKETS, BUCKET = 64, "__bucket"


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _finished(spark: SparkSession, folder: str) -> list[int]:
    """Batch numbers of the complete folders below ``folder``."""
    here = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = here.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(here):
        return []
    found = [s.getPath() for s in fs.listStatus(here) if s.getPath().getName().startswith("batch=")]
    marker = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(int(p.getName().split("=")[1]) for p in found if fs.exists(marker(p, "_SUCCESS")))


def _write(rows: DataFrame, path: str, key: str, buckets: int) -> None:
    dealt = rows.withColumn(BUCKET, _bucket(F.col(key), buckets)).repartition(BUCKET)
    dealt.write.mode("overwrite").partitionBy(BUCKET).parquet(path)


def append_changes(
    batch: DataFrame, path: str, batch_id: int, *, key: str, order: Sequence[str], buckets: int = BUCKETS
) -> None:
    """Add one batch of changes."""
    bases = _finished(batch.sparkSession, f"{path}/base")
    if not bases or batch_id > bases[-1]:
        _write(latest_by_key(batch, key, order), f"{path}/delta/batch={batch_id}", key, buckets)


def _parts(spark: SparkSession, path: str) -> tuple[list[str], int | None]:
    """Folders that make up the snapshot, and the last batch in it."""
    bases, deltas = _finished(spark, f"{path}/base"), _finished(spark, f"{path}/delta")
    upto = bases[-1] if bases else -1
    later = [n for n in deltas if n > upto]
    folders = [f"{path}/base/batch={upto}"] if bases else []
    return folders + [f"{path}/delta/batch={n}" for n in later], max([upto, *later]) if folders or later else None


def snapshot(
    spark: SparkSession,
    path: str,
    ddl: str,
    *,
    key: str,
    order: Sequence[str],
    keys: Sequence | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Newest row per key; with ``keys`` only theirs, read from their buckets alone."""
    rows = spark.createDataFrame([], ddl)
    for folder in _parts(spark, path)[0]:
        part = spark.read.parquet(folder)
        if keys is not None:
            kind = rows.schema[key].dataType
            wanted = F.array(*[_bucket(F.lit(k).cast(kind), buckets) for k in keys])
            numbers = spark.range(1).select(wanted.alias("b")).first()["b"]  # as many as the caller names
            part = part.where(F.col(BUCKET).isin(numbers) & F.col(key).isin(list(keys)))
        rows = rows.unionByName(part.drop(BUCKET))
    return latest_by_key(rows, key, order)


def compact(
    spark: SparkSession, path: str, ddl: str, *, key: str, order: Sequence[str], buckets: int = BUCKETS
) -> None:
    """Merge the base and all deltas into a new base; the old folders stay for their readers."""
    last = _parts(spark, path)[1]
    if last is not None and last not in _finished(spark, f"{path}/base"):
        whole = snapshot(spark, path, ddl, key=key, order=order)
        _write(whole, f"{path}/base/batch={last}", key, buckets)


def feed_snapshot(
    changes: DataFrame, path: str, *, key: str, order: Sequence[str], compact_every: int = 20
) -> DataStreamWriter:
    """A stream writer that keeps the snapshot below ``path``; it wants a checkpoint location."""
    ddl = changes.schema

    def add(batch: DataFrame, batch_id: int) -> None:
        append_changes(batch, path, batch_id, key=key, order=order)
        if (batch_id + 1) % compact_every == 0:
            compact(batch.sparkSession, path, ddl, key=key, order=order)

    return changes.writeStream.foreachBatch(add)
