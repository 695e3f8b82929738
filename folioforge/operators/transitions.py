"""Fan-out, status transitions and key joins: table in, new table version out."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import non_blank, trim_ws, word_count
from ..schemas import IN_FLIGHT_STATUSES, JOB_TERMINAL, TRANSLIT_TERMINAL

MAX_CHAPTERS = 100
#: Parts of a book that are joined to its facts apart.
BOOK_PARTS = 16
MAX_WORDS = 50_000
MAX_BYTES = 100 * 1024 * 1024
MAX_IMAGE_BYTES = 20 * 1024 * 1024
TEXT_TYPES = ["pdf", "docx", "doc", "txt"]
IMAGE_TYPES = ["png", "jpg", "jpeg"]
UNCONVERTED_IMAGE_TYPES = ["gif", "webp"]


def _now(as_of: datetime | Column) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of)


# --- admission ---------------------------------------------------------------------


def admission_reason(
    name: Column, size: Column, text: Column | None = None
) -> Column:
    """Why a document is rejected; null when it is admitted.

    Documents that carry text (text formats) must not be blank.
    """
    ext = F.lower(F.element_at(F.split(name, "\\."), -1))
    reason = (
        F.when(size > MAX_BYTES, "too_large")
        .when(size == 0, "empty_file")
        .when(ext == "", "no_extension")
        .when(ext.isin(IMAGE_TYPES + UNCONVERTED_IMAGE_TYPES) & (size > MAX_IMAGE_BYTES), "image_too_large")
        .when(ext.isin(UNCONVERTED_IMAGE_TYPES), "image_type_not_supported")
        .when(~ext.isin(TEXT_TYPES + IMAGE_TYPES), "unsupported_type")
    )
    if text is not None:
        blank = ~F.coalesce(non_blank(text), F.lit(False))
        reason = reason.when(ext.isin(["docx", "doc", "txt"]) & blank, "no_text")
    return reason


def admit_documents(
    df: DataFrame,
    *,
    name_col: str = "filename",
    size_col: str = "size_bytes",
    text_col: str | None = "text",
) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with ``reason``)."""
    text = F.col(text_col) if text_col else None
    checked = df.withColumn("reason", admission_reason(F.col(name_col), F.col(size_col), text))
    accepted = checked.filter(F.col("reason").isNull()).drop("reason")
    return accepted, checked.filter(F.col("reason").isNotNull())


def admit_sections(df: DataFrame, *, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Single sections of 1 to 50 000 words: (accepted with ``word_count``, rejected)."""
    counted = df.withColumn("word_count", word_count(F.coalesce(F.col(text_col), F.lit(""))))
    reason = F.when(F.col("word_count") == 0, "no_text").when(
        F.col("word_count") > MAX_WORDS, "too_long"
    )
    checked = counted.withColumn("reason", reason)
    accepted = checked.filter(F.col("reason").isNull()).drop("reason")
    return accepted, checked.filter(F.col("reason").isNotNull())


def admit_books(
    chapters: DataFrame, *, book_col: str = "book_id", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """(accepted chapters, rejected books with ``reason``).

    Blank chapters are left out silently but count for ``total_chapters``; a book with no
    chapters left, more than 100 chapters or one over-long chapter is rejected whole.
    The book-level facts are aggregates that combine before the shuffle; chapters meet them
    in ``BOOK_PARTS`` parts of a book, so no task reads all texts of a huge, rejected one.
    """
    counted = chapters.withColumn(
        text_col, trim_ws(F.coalesce(F.col(text_col), F.lit("")))
    ).withColumn("word_count", word_count(text_col))
    books = (
        counted.groupBy(book_col)
        .agg(
            F.count(F.lit(1)).alias("total_chapters"),
            F.count_if(F.col("word_count") > 0).alias("__filled"),
            F.max("word_count").alias("__longest"),
        )
        .withColumn(
            "reason",
            F.when(F.col("total_chapters") > MAX_CHAPTERS, "too_many_chapters")
            .when(F.col("__longest") > MAX_WORDS, "chapter_too_long")
            .when(F.col("__filled") == 0, "no_text"),
        )
    )
    good = books.filter(F.col("reason").isNull()).select(
        book_col, F.col("total_chapters").cast("int")
    )
    part = F.pmod(F.xxhash64(*chapters.columns), F.lit(BOOK_PARTS)).cast("int").alias("__part")
    parts = good.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(BOOK_PARTS - 1))))
    accepted = counted.filter(F.col("word_count") > 0).select("*", part).join(parts, [book_col, "__part"])
    accepted = accepted.drop("__part")
    rejected = books.filter(F.col("reason").isNotNull()).select(
        book_col, "total_chapters", "reason"
    )
    return accepted, rejected


# --- fan-out -----------------------------------------------------------------------


def fan_out_pages(jobs: DataFrame) -> DataFrame:
    """Page rows 1…N per job; the page id is the number padded to four digits."""
    rows = jobs.filter(F.col("total_pages") > 0).select(
        "job_id",
        "created_at",
        F.explode(F.sequence(F.lit(1), F.col("total_pages"))).alias("page_num"),
    )
    padded = F.when(F.col("page_num") < 10_000, F.lpad(F.col("page_num").cast("string"), 4, "0"))
    return rows.select(
        "job_id",
        "page_num",
        F.coalesce(padded, F.col("page_num").cast("string")).alias("page_id"),
        F.lit("pending").alias("status"),
        F.lit(0).alias("attempts"),
        "created_at",
    )


def fan_out_chapters(accepted: DataFrame, as_of: datetime | Column) -> DataFrame:
    """One pending job per admitted chapter (see :func:`admit_books`)."""
    return accepted.select(
        F.concat_ws("-", "book_id", F.col("chapter_index").cast("string")).alias("job_id"),
        "book_id",
        "chapter_index",
        "chapter_title",
        "text",
        "word_count",
        "total_chapters",
        F.lit("local").alias("mode"),
        F.lit("pending").alias("status"),
        _now(as_of).alias("created_at"),
    )


# --- transitions -------------------------------------------------------------------


def transition(
    jobs: DataFrame,
    actions: DataFrame,
    as_of: datetime | Column,
    *,
    terminal: list[str] | None = None,
    stamp_col: str = "updated_at",
) -> tuple[DataFrame, DataFrame]:
    """(new jobs, outcomes) for admin actions (seq, job_id, action, admin).

    ``cancel`` clears the error, ``force-fail`` sets it.  The first action on a job
    counts; later ones meet a terminal job.  Outcomes: ``ok``, ``not_found``,
    ``conflict`` or ``invalid``.
    """
    final = terminal or TRANSLIT_TERMINAL
    valid = F.col("action").isin("cancel", "force-fail")
    firsts = (
        actions.filter(valid)
        .groupBy("job_id")
        .agg(
            F.min("seq").alias("__seq"),
            F.min_by(F.struct("action", "admin"), "seq").alias("__act"),
        )
    )
    status = F.coalesce("status", F.lit("unknown"))
    act, admin = F.col("__act.action"), F.col("__act.admin")
    hit = F.col("__act").isNotNull() & ~status.isin(final)
    new_status = F.when(act == "cancel", "cancelled").otherwise("failed")
    by = F.concat(F.lit(" by admin <"), admin, F.lit(">"))
    changed = jobs.join(firsts, "job_id", "left").withColumn("__hit", hit)
    updates = {
        "error": F.when(act == "force-fail", F.concat(F.lit("Force-failed"), by)),
        "note": F.concat(F.lit("Status set to "), new_status, by),
        stamp_col: _now(as_of),
        "status": new_status,
    }
    new_jobs = changed.select(
        *[
            F.when(F.col("__hit"), updates[c]).otherwise(F.col(c)).alias(c)
            if c in updates
            else F.col(c)
            for c in jobs.columns
        ]
    )
    known = jobs.select("job_id", status.alias("__status"))
    outcomes = (
        actions.join(known, "job_id", "left")
        .join(firsts.select("job_id", "__seq"), "job_id", "left")
        .select(
            "seq",
            "job_id",
            "action",
            F.when(~valid, "invalid")
            .when(F.col("__status").isNull(), "not_found")
            .when(F.col("__status").isin(final) | (F.col("seq") > F.col("__seq")), "conflict")
            .otherwise("ok")
            .alias("outcome"),
        )
    )
    return new_jobs, outcomes


def bulk_transition(
    jobs: DataFrame,
    action: str,
    as_of: datetime | Column,
    admin: str,
    *,
    stuck: list[str] | None = None,
    stamp_col: str = "updated_at",
) -> tuple[DataFrame, DataFrame]:
    """(new jobs, one-row count ``affected``) of a bulk action on a status set."""
    in_flight = stuck or IN_FLIGHT_STATUSES
    status = F.col("status")
    if action in ("delete-failed", "delete-cancelled"):
        target = status == action.removeprefix("delete-")
        hit = F.coalesce(target, F.lit(False))
        return jobs.filter(~hit), jobs.agg(F.count_if(hit).alias("affected"))
    if action == "cancel-pending":
        hit = F.coalesce(status == "pending", F.lit(False))
        updates = {
            "status": F.lit("cancelled"),
            "note": F.lit(f"Bulk cancel by admin <{admin}>"),
            stamp_col: _now(as_of),
        }
    elif action == "force-fail-stuck":
        hit = F.coalesce(status.isin(in_flight), F.lit(False))
        updates = {
            "status": F.lit("failed"),
            "error": F.lit(f"Force-failed (bulk) by admin <{admin}>"),
            "note": F.concat(F.lit("Bulk force-fail from "), status),
            stamp_col: _now(as_of),
        }
    else:
        raise ValueError(f"unknown action: {action}")
    new_jobs = jobs.select(
        *[
            F.when(hit, updates[c]).otherwise(F.col(c)).alias(c) if c in updates else F.col(c)
            for c in jobs.columns
        ]
    )
    return new_jobs, jobs.agg(F.count_if(hit).alias("affected"))


def legacy_bulk_transition(jobs: DataFrame, action: str, as_of, admin: str):
    """Bulk actions of translation jobs: ``running`` is stuck, completion is stamped."""
    return bulk_transition(
        jobs, action, as_of, admin, stuck=["running"], stamp_col="completed_at"
    )


def legacy_transition(jobs: DataFrame, actions: DataFrame, as_of):
    return transition(jobs, actions, as_of, terminal=JOB_TERMINAL, stamp_col="completed_at")


def cascade_delete(
    jobs: DataFrame, pages: DataFrame, doomed: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(jobs, pages) without the doomed job ids and all of their pages."""
    ids = doomed.select("job_id").distinct()
    return jobs.join(ids, "job_id", "left_anti"), pages.join(ids, "job_id", "left_anti")


def retry_pages(
    jobs: DataFrame,
    pages: DataFrame,
    requests: DataFrame,
    as_of: datetime | Column,
    *,
    reset_attempts: bool = True,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new jobs, new pages, outcomes) for retry requests (job_id, page_num, admin).

    Pages that are not done go back to pending and a finished parent is reopened.  With
    ``reset_attempts`` the page gets all its attempts back; without, its counter stays.
    """
    asked = requests.groupBy("job_id", "page_num").agg(F.min("admin").alias("__admin"))
    jobs_known = jobs.select("job_id", F.lit(True).alias("__job"))
    page_known = pages.select("job_id", "page_num", F.col("status").alias("__status"))
    in_range = F.col("page_num").between(1, 9999)
    outcomes = (
        asked.join(jobs_known, "job_id", "left")
        .join(page_known, ["job_id", "page_num"], "left")
        .select(
            "job_id",
            "page_num",
            "__admin",
            F.when(~in_range, "invalid_page")
            .when(F.col("__job").isNull(), "job_not_found")
            .when(F.col("__status").isNull(), "page_not_found")
            .when(F.col("__status") == "ocr_done", "conflict")
            .otherwise("ok")
            .alias("outcome"),
        )
    )
    granted = outcomes.filter(F.col("outcome") == "ok")
    now = _now(as_of)
    hit = F.col("__admin").isNotNull()
    page_updates = {
        "status": F.lit("pending"),
        "error": F.lit(None).cast("string"),
        "retry_requested_at": now,
        "retry_requested_by": F.col("__admin"),
    }
    if reset_attempts:
        page_updates["attempts"] = F.lit(0)
    marked = pages.join(
        granted.select("job_id", "page_num", "__admin"), ["job_id", "page_num"], "left"
    )
    new_pages = marked.select(
        *[
            F.when(hit, page_updates[c]).otherwise(F.col(c)).alias(c)
            if c in page_updates
            else F.col(c)
            for c in pages.columns
        ]
    )
    reopened = granted.groupBy("job_id").agg(
        F.min_by("__admin", "page_num").alias("__admin"), F.min("page_num").alias("__page")
    )
    reopen = hit & F.col("status").isin(TRANSLIT_TERMINAL)
    job_updates = {
        "status": F.lit("ocr_running"),
        "error": F.lit(None).cast("string"),
        "completed_at": F.lit(None).cast("timestamp"),
        "note": F.concat(
            F.lit("Re-opened by admin <"),
            F.col("__admin"),
            F.lit("> for page "),
            F.col("__page").cast("string"),
            F.lit(" retry"),
        ),
    }
    joined = jobs.join(reopened, "job_id", "left").withColumn("__reopen", reopen)
    new_jobs = joined.select(
        *[
            F.when(F.col("__reopen"), job_updates[c]).otherwise(F.col(c)).alias(c)
            if c in job_updates
            else F.col(c)
            for c in jobs.columns
        ]
    )
    return new_jobs, new_pages, outcomes.select("job_id", "page_num", "outcome")


# --- key joins ---------------------------------------------------------------------


def resume_skip(pages: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Pages still to do: those without output, minus the keys already finished."""
    output = F.coalesce("transliterated_text", F.lit(""))
    todo = pages.filter(~non_blank(output))
    if done is None:
        return todo
    return todo.join(done.select("job_id", "page_num"), ["job_id", "page_num"], "left_anti")


def ready_parents(jobs: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Jobs in OCR whose pages are all done.

    With ``pages`` the completed pages are counted from the page table (distinct page
    numbers) instead of trusting the stored counter.
    """
    running = jobs.filter(F.col("status") == "ocr_running")
    if pages is None:
        return running.filter(F.col("pages_completed") >= F.col("total_pages"))
    done = completed_pages(pages.filter(F.col("status") == "ocr_done"))
    return (
        running.drop("pages_completed")
        .join(done, "job_id", "left")
        .withColumn("pages_completed", F.coalesce("pages_completed", F.lit(0)))
        .filter(F.col("pages_completed") >= F.col("total_pages"))
    )


def completed_pages(done: DataFrame) -> DataFrame:
    """Distinct finished pages per job, in two levels: (job, page) first, then job."""
    return (
        done.groupBy("job_id", "page_num")
        .agg(F.lit(1).alias("one"))
        .groupBy("job_id")
        .agg(F.count(F.lit(1)).cast("int").alias("pages_completed"))
    )
