"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.session import scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# The two word patterns the operators use, as the class of separators.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, UPPER.lower())


def words(text: Column, separators: str) -> Column:
    """The words between runs of ``separators``; none for null or empty text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def n_words(text: Column) -> Column:
    """Number of whitespace-separated words."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE))).cast("long")


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The written table survives lost executors, and its files give the planner a true
    size, so joins against it are planned by what it really holds.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "staged")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_bytes(batch: pa.RecordBatch, column: str, size: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about ``size`` bytes of ``column``; a longer value is a slice of its own."""
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(lengths, dtype=np.int64), 0
    while at < len(ends):
        before = ends[at] - lengths[at]
        to = max(at + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield batch.slice(at, to - at)
        at = to


def literal_table(spark: SparkSession, names: Sequence[str], rows: Sequence[tuple]) -> DataFrame:
    """A small constant table as part of the plan, without Python on the executors."""
    row = lambda r: F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r, strict=True)])
    return spark.range(1).select(F.explode(F.array(*[row(r) for r in rows])).alias("r")).select("r.*")


#: DuckDB: CRC-32's table of 256 entries by its rule, for :func:`crc32_sql`.
CRC_TABLE_SQL = """crc_table AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n::BIGINT], range(8)),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc_of)"""


def crc32_sql(text: str) -> str:
    """DuckDB expression of the unsigned CRC-32 of ``text``'s UTF-8 bytes, beside ``crc_table``."""
    byte = f"('0x' || substr(hex(encode({text})), (2 * i + 1)::INT, 2))::BIGINT"
    return f"""xor(4294967295, list_reduce(list_concat([4294967295::BIGINT],
      list_transform(range(0, octet_length(encode({text}))), lambda i: {byte})),
      lambda c, b: xor(c >> 8, crc_of[(xor(c, b) & 255) + 1])))"""
