"""Sinks: plain-text export with a flags appendix, and the review training export."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import let, trim_ws

RULE_WIDTH = 60


def flagged_chunks(chunk_data: Column) -> Column:
    """Chunks with at least one flag, ordered by index: ``array<struct<index, flags>>``."""
    kept = F.filter(chunk_data, lambda c: F.coalesce(F.size(c["flags"]), F.lit(0)) > 0)
    return F.array_sort(
        F.transform(
            kept,
            lambda c: F.struct(
                F.coalesce(c["index"], F.lit(0)).alias("index"), c["flags"].alias("flags")
            ),
        )
    )


def _plural(n: Column, word: str) -> Column:
    return F.concat(
        n.cast("string"), F.lit(f" {word}"), F.when(n == 1, F.lit("")).otherwise(F.lit("s"))
    )


def flags_appendix(chunk_data: Column) -> Column:
    """The appendix lines; an empty array when no chunk has flags."""

    def lines(chunks: Column) -> Column:
        total = F.aggregate(chunks, F.lit(0), lambda acc, c: acc + F.size(c["flags"]))
        head = F.array(
            F.lit(""),
            F.lit(""),
            F.lit("TRANSLATOR FLAGS"),
            F.lit("—" * RULE_WIDTH),
            F.concat(
                _plural(total, "self-flag"),
                F.lit(" across "),
                _plural(F.size(chunks), "section"),
                F.lit(" — translator concerns the reviewer may want to verify."),
            ),
            F.lit(""),
        )
        per_chunk = F.transform(
            chunks,
            lambda c: F.concat(
                F.array(F.concat(F.lit("Section "), (c["index"] + 1).cast("string"))),
                F.transform(c["flags"], lambda f: F.concat(F.lit("  • "), f)),
                F.array(F.lit("")),
            ),
        )
        return F.when(
            F.size(chunks) > 0, F.concat(head, F.flatten(per_chunk))
        ).otherwise(F.array().cast("array<string>"))

    return let(flagged_chunks(chunk_data), lines)


def export_txt(
    df: DataFrame,
    *,
    id_col: str = "translation_id",
    title_col: str = "chapter_title",
    text_col: str = "output",
    chunks_col: str | None = "chunk_data",
) -> DataFrame:
    """(id, body): title with its rule, text, flags appendix."""
    title = F.col(title_col)
    none = F.array().cast("array<string>")
    header = F.when(
        F.coalesce(title != "", F.lit(False)),
        F.array(
            title,
            F.repeat(F.lit("—"), F.least(F.lit(RULE_WIDTH), F.length(title))),
            F.lit(""),
        ),
    ).otherwise(none)
    appendix = F.coalesce(flags_appendix(F.col(chunks_col)), none) if chunks_col else none
    text = F.array(trim_ws(F.coalesce(F.col(text_col), F.lit(""))))
    return df.select(
        id_col, F.array_join(F.concat(header, text, appendix), "\n").alias("body")
    )


def write_txt(bodies: DataFrame, path: str, separator: str = "\n\f\n") -> None:
    """Write bodies as text files; documents are separated by a form feed."""
    bodies.select("body").write.option("lineSep", separator).text(path)


def export_training_json(
    translations: DataFrame,
    reviews: DataFrame,
    *,
    exported_at: datetime,
    exported_by: str,
    reviews_per_row: int = 10_000,
) -> DataFrame:
    """Translations with their reviews in time order.

    Reviews are counted off in time order: part 0 holds the first ``reviews_per_row`` of
    a translation, part 1 the next ones, so that no list outgrows a row and the parts in
    order are the thread.  Positions are counted within hours and offset by the counts of
    the earlier hours, so a long thread is never sorted in one task.
    """
    is_time = reviews.schema["created_at"].dataType.typeName().startswith("timestamp")
    hour = F.date_trunc("hour", "created_at") if is_time else F.col("created_at")
    hourly = reviews.withColumn("__hour", hour)
    counts = hourly.groupBy("translation_id", "__hour").agg(F.count(F.lit(1)).alias("__n"))
    earlier = W.partitionBy("translation_id").orderBy("__hour").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        F.col("translation_id").alias("__t"),
        F.col("__hour").alias("__h"),
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"),
    )
    within = W.partitionBy("translation_id", "__hour").orderBy("created_at", "review_id")
    same = F.col("translation_id").eqNullSafe(F.col("__t")) & F.col("__hour").eqNullSafe(F.col("__h"))
    position = F.col("__before") + F.col("__at") - 1
    placed = (
        hourly.withColumn("__at", F.row_number().over(within))
        .join(offsets, same)
        .withColumn("part", F.floor(position / F.lit(reviews_per_row)).cast("int"))
    )
    fields = [c for c in reviews.columns if c not in ("translation_id", "created_at", "review_id")]
    threads = placed.groupBy("translation_id", "part").agg(
        F.array_sort(F.collect_list(F.struct("created_at", "review_id", *fields))).alias("reviews")
    )
    empty = F.array().cast(threads.schema["reviews"].dataType)
    return translations.join(threads, "translation_id", "left").select(
        "translation_id",
        F.coalesce("part", F.lit(0)).alias("part"),
        "input_preview",
        "input_word_count",
        "output_word_count",
        "flags_count",
        "chapter_title",
        F.coalesce("output", F.lit("")).alias("output"),
        F.coalesce("reviews", empty).alias("reviews"),
        F.lit(exported_at).alias("exported_at"),
        F.lit(exported_by).alias("exported_by"),
    )


def training_rows(translations: DataFrame, reviews: DataFrame) -> DataFrame:
    """The same data flat: one row per translation and review (or one without review)."""
    renamed = reviews.select(
        "translation_id",
        "review_id",
        "comment",
        "section_index",
        F.col("created_at").alias("reviewed_at"),
    )
    return translations.join(renamed, "translation_id", "left")
