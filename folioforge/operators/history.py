"""Listing, search, grouping, export rows and review threads of finished translations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import non_blank, trim_ws
from .search import head, text_search

PAGE_SIZE = 20
MAX_PAGE_SIZE = 50


def page_limit(limit: int | None) -> int:
    return min(limit or PAGE_SIZE, MAX_PAGE_SIZE)


def history_page(
    df: DataFrame,
    cursor: str | int | None = None,
    limit: int | None = PAGE_SIZE,
    *,
    id_col: str = "translation_id",
    ts_col: str = "created_at",
) -> DataFrame:
    """One page, newest first, with ``next_cursor`` (null on the last page).

    Keyset paging: the cursor row becomes a plain predicate on (time, id), which is
    pushed to the scan, and ``limit + 1`` rows are taken.  An unknown cursor gives the
    first page.
    """
    rows = df
    if cursor is not None:
        at = df.filter(F.col(id_col) == F.lit(cursor)).select(ts_col).take(1)
        if at:
            ts = F.lit(at[0][0])
            rows = df.filter(
                (F.col(ts_col) < ts) | ((F.col(ts_col) == ts) & (F.col(id_col) < F.lit(cursor)))
            )
    return page_of(rows, limit, id_col=id_col, ts_col=ts_col)


def page_of(rows: DataFrame, limit: int | None, *, id_col: str, ts_col: str) -> DataFrame:
    """The newest ``limit`` of ``rows`` with ``next_cursor``."""
    n = page_limit(limit)
    order = [F.desc(ts_col), F.desc(id_col)]
    top = rows.orderBy(*order).limit(n + 1)
    everything = W.partitionBy(F.lit(0)).orderBy(*order)  # at most n + 1 rows
    numbered = top.withColumn("__rn", F.row_number().over(everything)).withColumn(
        "__more", F.lead(id_col, 1).over(everything)
    )
    last = F.max(F.when((F.col("__rn") == n) & F.col("__more").isNotNull(), F.col(id_col))).over(
        W.partitionBy(F.lit(0))
    )
    return (
        numbered.withColumn("next_cursor", last).filter(F.col("__rn") <= n).drop("__rn", "__more")
    )


def history_fields(
    output_chars: int | None = 400, preview_chars: int | None = 200
) -> list[Column]:
    """What the history is searched by; None takes a text as a whole."""
    return [
        F.col("chapter_title"),
        F.col("book_title"),
        F.col("email"),
        head("output", output_chars),
        head("input_preview", preview_chars),
    ]


def history_search(
    df: DataFrame,
    needle: str,
    *,
    output_chars: int | None = 400,
    preview_chars: int | None = 200,
) -> DataFrame:
    return text_search(df, needle, history_fields(output_chars, preview_chars))


def group_books(df: DataFrame, *, id_col: str = "translation_id") -> DataFrame:
    """History items: one row per book, and one per translation outside a book.

    A book is summarised by aggregates that combine before the shuffle, so a book with
    very many chapters costs one partial row per task.  Its chapters in order are
    :func:`book_chapters`.  The first chapter (lowest index, then id) gives title, time
    and e-mail.
    """
    in_book = F.coalesce(F.col("book_id") != "", F.lit(False))
    first = F.struct(F.coalesce("chapter_index", F.lit(0)), F.col(id_col))
    lead = F.struct("book_title", "created_at", "email")
    books = (
        df.filter(in_book)
        .groupBy("book_id")
        .agg(
            F.min_by(lead, first).alias("lead"),
            F.count(F.lit(1)).alias("chapters"),
            F.sum(F.coalesce("output_word_count", F.lit(0))).alias("total_words"),
            F.sum(F.coalesce("flags_count", F.lit(0))).alias("total_flags"),
        )
        .select(
            F.lit("book").alias("type"),
            F.col("book_id").alias("item_id"),
            F.coalesce(
                F.when(F.col("lead.book_title") != "", F.col("lead.book_title")),
                F.lit("Untitled Book"),
            ).alias("title"),
            "chapters",
            "total_words",
            "total_flags",
            F.col("lead.created_at").alias("created_at"),
            F.col("lead.email").alias("email"),
        )
    )
    singles = df.filter(~in_book).select(
        F.lit("single").alias("type"),
        F.col(id_col).cast("string").alias("item_id"),
        F.col("chapter_title").alias("title"),
        F.lit(1).cast("long").alias("chapters"),
        F.coalesce("output_word_count", F.lit(0)).cast("long").alias("total_words"),
        F.coalesce("flags_count", F.lit(0)).cast("long").alias("total_flags"),
        "created_at",
        "email",
    )
    return books.unionByName(singles)


def book_chapters(df: DataFrame, *, id_col: str = "translation_id") -> DataFrame:
    """Chapters of all books, globally sorted by (book, chapter)."""
    rows = df.filter(F.coalesce(F.col("book_id") != "", F.lit(False)))
    return rows.withColumn("chapter_index", F.coalesce("chapter_index", F.lit(0))).orderBy(
        "book_id", "chapter_index", id_col
    )


def sort_items(items: DataFrame, key: str = "date-desc", *, id_col: str = "item_id") -> DataFrame:
    orders = {
        "date-desc": F.desc("created_at"),
        "date-asc": F.asc("created_at"),
        "words-desc": F.desc("total_words"),
        "flags-desc": F.desc(F.coalesce("total_flags", F.lit(0))),
    }
    return items.orderBy(orders.get(key, orders["date-desc"]), id_col)


def chapter_summary(df: DataFrame) -> DataFrame:
    """Words, chapters and flags per book."""
    return (
        df.filter(F.coalesce(F.col("book_id") != "", F.lit(False)))
        .groupBy("book_id")
        .agg(
            F.sum(F.coalesce("output_word_count", F.lit(0))).alias("words"),
            F.count(F.lit(1)).alias("chapter_count"),
            F.sum(F.coalesce("flags_count", F.lit(0))).alias("flags"),
        )
    )


def flag_histogram(df: DataFrame, *, by: Sequence[str] = ("book_id",)) -> DataFrame:
    """Documents per flag band, per group."""
    n = F.coalesce("flags_count", F.lit(0))
    return df.groupBy(*by).agg(
        F.count_if(n == 0).alias("no_flags"),
        F.count_if((n >= 1) & (n <= 2)).alias("few_flags"),
        F.count_if(n >= 3).alias("many_flags"),
    )


def delete_owned(
    df: DataFrame, requests: DataFrame, *, id_col: str = "translation_id"
) -> tuple[DataFrame, DataFrame]:
    """(remaining rows, outcomes) for deletion requests (id, uid).

    Outcomes are ``ok``, ``forbidden`` (someone else's row) or ``not_found``.
    """
    owners = df.select(id_col, F.col("uid").alias("__owner"), F.lit(True).alias("__found"))
    outcomes = (
        requests.select(id_col, "uid")
        .distinct()
        .join(owners, id_col, "left")
        .select(
            id_col,
            "uid",
            F.when(F.col("__found").isNull(), "not_found")
            .when(F.col("__owner").eqNullSafe(F.col("uid")), "ok")
            .otherwise("forbidden")
            .alias("outcome"),
        )
    )
    granted = requests.select(id_col, "uid").distinct()
    remaining = df.join(granted, [id_col, "uid"], "left_anti").select(df.columns)
    return remaining, outcomes


def reviews_for(
    reviews: DataFrame, translation_id: str | int, section_index: int | None = None
) -> DataFrame:
    rows = reviews.filter(F.col("translation_id") == F.lit(translation_id))
    if section_index is not None:
        rows = rows.filter(F.col("section_index") == section_index)
    return rows.orderBy("created_at", "review_id")


def reviews_by_section(reviews: DataFrame) -> DataFrame:
    """Review threads: rows sorted by (translation, section, time).

    The thread stays a relation: a section with very many comments is split over tasks
    by the range sort instead of being gathered into one array.
    """
    return reviews.orderBy("translation_id", "section_index", "created_at", "review_id")


def comment_counts(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("translation_id", "section_index").agg(
        F.count(F.lit(1)).alias("comments")
    )


def ingest_reviews(submissions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) review submissions.

    The display name is the one given, else the local part of the e-mail (which may be
    empty), else ``Anonymous``.
    """
    reason = F.when(
        F.col("translation_id").isNull()
        | F.col("section_index").isNull()
        | F.col("comment").isNull(),
        "missing_field",
    ).when(~non_blank(F.col("comment")), "empty_comment")
    checked = submissions.withColumn("reason", reason)
    accepted = (
        checked.filter(F.col("reason").isNull())
        .drop("reason")
        .withColumn(
            "display_name",
            F.coalesce(
                F.col("display_name"),
                F.split_part("email", F.lit("@"), F.lit(1)),
                F.lit("Anonymous"),
            ),
        )
        .withColumn("email", F.coalesce("email", F.lit("")))
        .withColumn("comment", trim_ws("comment"))
    )
    return accepted, checked.filter(F.col("reason").isNotNull())


def visible_rows(df: DataFrame, uid: str, admin: bool = False) -> DataFrame:
    """Rows the caller may read: their own, or all for an admin."""
    return df if admin else df.filter(F.col("uid") == uid)


def visible_children(
    children: DataFrame, parents: DataFrame, key: str, uid: str, admin: bool = False
) -> DataFrame:
    """Reviews or pages inherit visibility from their parent row."""
    if admin:
        return children
    return children.join(visible_rows(parents, uid).select(key), key, "left_semi")
