"""Operations views over job and page tables: listings, counts, heartbeats, progress."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schemas import ACTIVE_STATUSES, JOB_STATUSES, TRANSLIT_STATUSES
from .search import head, text_search


def job_limit(limit: int | None) -> int:
    return 50 if limit is None else min(max(limit, 1), 200)


def admin_jobs(jobs: DataFrame, status: str | None = None, limit: int | None = None) -> DataFrame:
    """Newest jobs first, projected to the listed fields with their defaults."""
    rows = jobs.filter(F.col("status") == status) if status else jobs

    def default(name: str, value) -> Column:
        return F.coalesce(F.col(name), F.lit(value)).alias(name)

    return (
        rows.select(
            F.col("job_id").alias("id"),
            "uid",
            "email",
            "filename",
            default("status", "unknown"),
            default("total_pages", 0),
            default("pages_completed", 0),
            default("translate_requested", False),
            "translation_status",
            "created_at",
            "started_at",
            "completed_at",
            "error",
        )
        .orderBy(F.desc_nulls_last("created_at"), "id")
        .limit(job_limit(limit))
    )


def status_counts(jobs: DataFrame, vocabulary: list[str] | None = None) -> DataFrame:
    """Count per status; statuses without jobs are kept with zero."""
    names = vocabulary or TRANSLIT_STATUSES
    counts = jobs.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    known = jobs.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(s) for s in names])).alias("status")
    )
    return known.join(counts, "status", "left").select(
        "status", F.coalesce("n", F.lit(0)).alias("n")
    )


def legacy_status_counts(jobs: DataFrame) -> DataFrame:
    return status_counts(jobs, JOB_STATUSES)


def oldest_pending(jobs: DataFrame) -> DataFrame:
    return jobs.filter(F.col("status") == "pending").agg(
        F.min("created_at").alias("oldest_pending")
    )


def last_activity(jobs: DataFrame) -> DataFrame:
    """Latest completion, and latest of completed/started/created per job."""
    return jobs.agg(
        F.max("completed_at").alias("last_completed"),
        F.max(F.coalesce("completed_at", "started_at", "created_at")).alias("last_activity"),
    )


def day_stats(jobs: DataFrame, as_of: datetime | Column) -> DataFrame:
    """Counters since the start of the ``as_of`` day."""
    now = as_of if isinstance(as_of, Column) else F.lit(as_of)
    today = F.date_trunc("day", now)
    status = F.col("status")
    return jobs.agg(
        F.count_if(status == "pending").alias("pending"),
        F.count_if(status == "running").alias("running"),
        F.count_if((status == "completed") & (F.col("completed_at") >= today)).alias("done_today"),
        F.count_if(
            (status == "failed") & (F.coalesce("completed_at", "created_at") >= today)
        ).alias("failed_today"),
        F.count(F.lit(1)).alias("total"),
    )


def search_jobs(jobs: DataFrame, needle: str, *, text_chars: int | None = 200) -> DataFrame:
    """Jobs by e-mail, titles and the first characters of the text (None: the whole)."""
    return text_search(
        jobs,
        needle,
        [
            F.col("email"),
            F.col("input.chapterTitle"),
            F.col("input.bookTitle"),
            head("input.text", text_chars),
        ],
    )


def search_translit_jobs(jobs: DataFrame, needle: str) -> DataFrame:
    return text_search(jobs, needle, [F.col("filename"), F.col("email")])


def active_jobs(jobs: DataFrame, uid: str | None = None, k: int = 4) -> DataFrame:
    """The ``k`` newest jobs in flight, for one user or for every user.

    For all users the rank filter is a group limit: each task keeps ``k`` rows per user
    before the shuffle, whatever one user's share of the table.
    """
    rows = jobs.filter(F.col("status").isin(ACTIVE_STATUSES))
    shown = rows.select(
        "uid",
        F.col("job_id").alias("id"),
        F.coalesce("filename", F.lit("(untitled)")).alias("filename"),
        "status",
        F.coalesce("pages_completed", F.lit(0)).alias("pages_completed"),
        F.coalesce("total_pages", F.lit(0)).alias("total_pages"),
    )
    if uid is not None:
        return shown.filter(F.col("uid") == uid).orderBy(F.desc("id")).limit(k)
    newest = W.partitionBy("uid").orderBy(F.desc("id"))
    return shown.withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= k)


def progress_pct(done: Column | str, total: Column | str) -> Column:
    """Rounded half up; zero when there is nothing to do."""
    d = F.col(done) if isinstance(done, str) else done
    t = F.col(total) if isinstance(total, str) else total
    return F.when(t > 0, F.floor(d / t * 100 + 0.5)).otherwise(F.lit(0)).cast("int")


def page_overview(pages: DataFrame) -> DataFrame:
    """Per job: pages, done, failed and OCR attempts."""
    return pages.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if(F.col("status") == "ocr_done").alias("done"),
        F.count_if(F.col("status") == "ocr_failed").alias("failed"),
        F.sum(F.coalesce("attempts", F.lit(0))).alias("attempts"),
    )


def failed_pages(pages: DataFrame) -> DataFrame:
    return pages.filter(F.col("status") == "ocr_failed").select(
        "job_id",
        "page_num",
        F.coalesce("error", F.lit("OCR failed")).alias("error"),
        "attempts",
    )


def next_job(jobs: DataFrame, mode: str = "local") -> DataFrame:
    """The oldest pending job of a mode (true first in, first out)."""
    rows = jobs.filter((F.col("mode") == mode) & (F.col("status") == "pending"))
    return rows.orderBy("created_at", "job_id").limit(1)


def pending_translations(jobs: DataFrame) -> DataFrame:
    return jobs.filter(F.col("translate_requested") & (F.col("translation_status") == "pending"))


def stuck_alert(jobs: DataFrame, as_of: datetime | Column, minutes: int = 5) -> DataFrame:
    """Oldest pending job and whether it has waited longer than ``minutes``."""
    now = as_of if isinstance(as_of, Column) else F.lit(as_of)
    limit = now - F.make_interval(mins=F.lit(minutes))
    return oldest_pending(jobs).select(
        "oldest_pending",
        F.coalesce(F.col("oldest_pending") < limit, F.lit(False)).alias("stuck"),
    )
