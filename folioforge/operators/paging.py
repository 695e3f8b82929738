"""Keyset paging over a table that lies in page order.

The table is written newest first in files that do not overlap, with a small table that
says what each file holds.  A page then reads the files that can hold its rows, mostly one
or two, however large the table is.  Rows without a time come last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .history import PAGE_SIZE, page_limit, page_of

ROWS_PER_FILE = 1_000_000


def write_in_page_order(
    df: DataFrame,
    path: str,
    *,
    id_col: str = "translation_id",
    ts_col: str = "created_at",
    rows_per_file: int = ROWS_PER_FILE,
) -> None:
    """Write ``df`` below ``path``, clustered by time and id, and the table of its files."""
    newest = [F.desc(ts_col), F.desc(id_col)]
    ordered = df.repartitionByRange(*newest).sortWithinPartitions(*newest)
    ordered.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(f"{path}/rows")
    rows, place = df.sparkSession.read.parquet(f"{path}/rows"), F.struct(ts_col, id_col)
    files = rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.min(place).alias("oldest"), F.max(place).alias("newest"), F.count(F.lit(1)).alias("n")
    )
    files.write.mode("overwrite").parquet(f"{path}/files")


def page_files(
    spark: SparkSession, path: str, after: tuple | None = None, limit: int | None = PAGE_SIZE
) -> list[str]:
    """The files a page after the row (time, id) has to read.

    Each but the first of them holds nothing but rows of the page or later ones, and the
    first at least one, so at most ``limit + 1`` rows of the file table reach the driver.
    """
    files, n = spark.read.parquet(f"{path}/files"), page_limit(limit)
    if after is not None:
        kinds = [f.dataType for f in files.schema["oldest"].dataType.fields]
        names = files.schema["oldest"].dataType.names
        at = F.struct(*[F.lit(v).cast(k).alias(c) for v, k, c in zip(after, kinds, names, strict=True)])
        files = files.where(F.col("oldest") < at)
    found, rows = [], 0
    for f in files.orderBy(F.desc("newest"), "file").limit(n + 1).collect():
        if rows > n:
            break
        rows += 1 if after is not None and not found else f.n
        found.append(f.file)
    return found


def clustered_page(
    spark: SparkSession,
    path: str,
    after: tuple | None = None,
    limit: int | None = PAGE_SIZE,
    *,
    id_col: str = "translation_id",
    ts_col: str = "created_at",
) -> DataFrame:
    """:func:`..history.history_page` of a table in page order; ``after`` is (time, id)."""
    files = page_files(spark, path, after, limit)
    rows = spark.read.schema(spark.read.parquet(f"{path}/rows").schema).parquet(*(files or [f"{path}/rows"]))
    if not files:
        rows = rows.where(F.lit(False))
    if after is not None:
        ts, same = F.lit(after[0]), F.col(ts_col).eqNullSafe(F.lit(after[0])) & (F.col(id_col) < F.lit(after[1]))
        later = F.lit(False) if after[0] is None else (F.col(ts_col) < ts) | F.col(ts_col).isNull()
        rows = rows.where(same | later)
    return page_of(rows, limit, id_col=id_col, ts_col=ts_col)
