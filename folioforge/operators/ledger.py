"""Ledger of finished pages: what a resumed job need not send to the model again.

A row is (keys, ``text_hash``, ``output``): the page, a digest of the text it was made
from, and the result.  A page counts as finished only while its text is the same.  Each
run writes its own folder and replaces it if it is run again, so a repeated or lost write
changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import non_blank

HASH, OUTPUT, RUN = "text_hash", "output", "run"


def text_hash(text: Column) -> Column:
    """Digest of a page's text; a null text counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def finished_pages(
    pages: DataFrame, keys: list[str], *, text_col: str = "source_text", output_col: str
) -> DataFrame:
    """Ledger rows of a page table that stores its results beside the texts."""
    done = pages.filter(non_blank(F.coalesce(output_col, F.lit(""))))
    return done.select(
        *keys, text_hash(F.col(text_col)).alias(HASH), F.col(output_col).alias(OUTPUT)
    )


def record_pages(finished: DataFrame, path: str, run: str) -> None:
    """Write a run's finished pages; the same run again replaces what it wrote before."""
    finished.write.mode("overwrite").parquet(f"{path}/{RUN}={run}")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """All runs of a ledger, with the column ``run``."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def latest(ledger: DataFrame, keys: list[str]) -> DataFrame:
    """One row per page and text: that of the last run, then of the smallest output.

    Rows are dealt by page alone, as :func:`with_finished` needs them.
    """
    order = [F.col(OUTPUT)]
    if RUN in ledger.columns:
        order.insert(0, F.col(RUN).cast("string").desc())
    page = W.partitionBy(*keys).orderBy(HASH, *order)
    first = (F.row_number().over(page) == 1) | ~F.col(HASH).eqNullSafe(F.lag(HASH).over(page))
    usable = ledger.filter(non_blank(F.coalesce(OUTPUT, F.lit(""))))
    return usable.withColumn("__first", first).filter("__first").select(*keys, HASH, OUTPUT)


def with_finished(
    pages: DataFrame, ledger: DataFrame | None, keys: list[str], *, text_col: str = "text"
) -> DataFrame:
    """``pages`` plus ``text_hash`` and the stored ``output``, null where there is none.

    A page without a complete key never counts as finished.  A page meets all its ledger
    rows in one, so that only the keys deal the rows out: pages and ledgers that already
    lie by page are not shuffled again, and no digest is.
    """
    plain, digest = pages.drop(HASH, OUTPUT), text_hash(F.col(text_col))
    if ledger is None:
        return plain.withColumns({HASH: digest, OUTPUT: F.lit(None).cast("string")})
    row = F.struct(HASH, OUTPUT)
    complete = F.forall(F.array(*[F.col(c).isNotNull() for c in (*keys, HASH)]), lambda known: known)
    stored = latest(ledger.filter(complete), keys)
    texts = stored.groupBy(*keys).agg(F.map_from_entries(F.collect_list(row)).alias("__texts"))
    found = plain.join(texts, keys, "left").withColumn(HASH, digest)
    others = [c for c in plain.columns if c not in keys]
    return found.select(*keys, HASH, *others, F.try_element_at("__texts", F.col(HASH)).alias(OUTPUT))
