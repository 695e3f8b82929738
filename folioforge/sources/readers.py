"""Readers: text corpora, typed tables, change feeds, reference data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORRUPT = "_corrupt_record"


def read_text_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): one document per UTF-8 text file."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def read_table(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A Parquet table read with its declared schema (missing columns come back null)."""
    return spark.read.schema(ddl).parquet(path)


def read_json_table(spark: SparkSession, path: str, ddl: str) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejects) of a JSON-lines table.

    Fields that are not declared are ignored (older rows carry extras); a line that does
    not fit the schema goes to the rejects with its text.
    """
    options = {
        "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": CORRUPT,
        "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSS]X",
    }
    parsed = spark.read.text(path).select(
        "value", F.from_json("value", f"{ddl}, {CORRUPT} string", options).alias("row")
    )
    fits = F.col("row").isNotNull() & F.col(f"row.{CORRUPT}").isNull()
    valid = parsed.filter(fits).select("row.*").drop(CORRUPT)
    rejects = parsed.filter(~fits).select(F.col("value").alias("line"))
    return valid, rejects


def change_feed(
    spark: SparkSession, path: str, ddl: str, *, fmt: str = "json", files_per_batch: int = 100
) -> DataFrame:
    """An append-only change log as a stream; a micro-batch takes a bounded set of files."""
    return (
        spark.readStream.schema(ddl)
        .format(fmt)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(path)
    )


def read_small_text(spark: SparkSession, path: str, max_bytes: int = 10_000_000) -> str:
    """A small reference file (glossary, rule notes) as text; its size is checked first."""
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length").alias("n")).first().n
    if size is None or size > max_bytes:
        raise ValueError(f"reference file missing or larger than {max_bytes} bytes: {path}")
    rows = spark.read.text(path, wholetext=True).take(1)
    return rows[0].value
