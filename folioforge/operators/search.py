"""Substring search: over the rows as they lie, or over a store with a trigram index.

The store deals the rows into blocks, one folder each, and lists for every trigram of the
searched text the blocks that hold it.  A needle can only stand in blocks that hold all
its trigrams, so only those are read, and their rows are compared as a whole: the store
finds exactly the rows that a scan finds.  Needles of fewer than three characters have no
trigram and read every block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let

BLOCK, TEXT, GRAM = "search_block", "search_text", "gram"
#: Blocks of a store: what a search brings to the driver is at most one number for each.
BLOCKS = 256


def search_text(fields: Sequence[Column]) -> Column:
    """What is searched: the fields joined by blanks, in lower case, nulls as empty."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(f, F.lit("")) for f in fields]))


def wanted_text(needle: str) -> str:
    return needle.strip().lower()


def head(column: str, chars: int | None) -> Column:
    """The first ``chars`` characters of a text, or with None the whole of it."""
    return F.col(column) if chars is None else F.substring(column, 1, chars)


def text_search(df: DataFrame, needle: str, fields: Sequence[Column]) -> DataFrame:
    """Case-insensitive substring search; a blank needle finds every row."""
    wanted = wanted_text(needle)
    return df.filter(F.contains(search_text(fields), F.lit(wanted))) if wanted else df


def trigrams(text: Column) -> Column:
    """Distinct runs of three characters, in time linear in the text."""

    def runs(chars: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(chars) - 3)
        return F.transform(starts, lambda i: F.concat(chars[i], chars[i + 1], chars[i + 2]))

    return F.when(F.length(text) >= 3, F.array_distinct(let(F.split(text, F.lit("")), runs)))


def write_search_store(
    df: DataFrame, path: str, fields: Sequence[Column], id_cols: Sequence[str], *, blocks: int = BLOCKS
) -> None:
    """Write ``df`` by blocks of its ids' hash to ``path``/rows, the index to ``path``/index.

    Rows need no unique id.  The index holds each pair of trigram and block once; pairs are
    combined before their shuffle and lie sorted by trigram, so that a search reads few of them.
    """
    block = F.pmod(F.xxhash64(*id_cols), F.lit(blocks)).cast("int")
    rows = df.withColumn(TEXT, search_text(fields)).withColumn(BLOCK, block)
    rows.limit(0).write.mode("overwrite").parquet(f"{path}/columns")  # a store may be empty
    rows.repartition(BLOCK).write.mode("overwrite").partitionBy(BLOCK).parquet(f"{path}/rows")
    stored = df.sparkSession.read.schema(rows.schema).parquet(f"{path}/rows")
    pairs = stored.select(BLOCK, F.explode(trigrams(F.col(TEXT))).alias(GRAM)).distinct()
    ordered = pairs.repartitionByRange(GRAM, BLOCK).sortWithinPartitions(GRAM, BLOCK)
    ordered.write.mode("overwrite").parquet(f"{path}/index")


def blocks_with(spark: SparkSession, path: str, wanted: str) -> list[int] | None:
    """Blocks that hold every trigram of ``wanted``; None if it has no trigram."""
    grams = {wanted[i : i + 3] for i in range(len(wanted) - 2)}
    if not grams:
        return None
    hits = spark.read.parquet(f"{path}/index").filter(F.col(GRAM).isin(sorted(grams)))
    full = hits.groupBy(BLOCK).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(grams))
    return [r[BLOCK] for r in full.select(BLOCK).collect()]


def search_store(spark: SparkSession, path: str, needle: str) -> DataFrame:
    """The rows of a store that hold ``needle``, as :func:`text_search` finds them."""
    columns = spark.read.parquet(f"{path}/columns").schema
    rows, wanted = spark.read.schema(columns).parquet(f"{path}/rows"), wanted_text(needle)
    if wanted:
        blocks = blocks_with(spark, path, wanted)
        if blocks is not None:
            rows = rows.filter(F.col(BLOCK).isin(blocks))
        rows = rows.filter(F.contains(TEXT, F.lit(wanted)))
    return rows.drop(TEXT, BLOCK)
