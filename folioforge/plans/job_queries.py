"""Queries over job, page, history and review tables (see :mod:`.standins`)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import admin, history, transitions
from ..operators.audit import flags_count
from ..operators.transitions import (
    admission_reason,
    admit_books,
    admit_sections,
    fan_out_chapters,
    fan_out_pages,
)
from ..operators.search import search_store, write_search_store
from ..session import cut_lineage, scratch_path
from ..sources.exports import export_training_json, export_txt
from .registry import query, ts_text
from .standins import load, standin, standin_sql
from .text_queries import trim, words

AS_OF = datetime(1998, 6, 15, 12, 0, 0)
AS_OF_SQL = "timestamp '1998-06-15 12:00:00'"
AS_OF_TEXT = "'1998-06-15 12:00:00'"
ADMIN = "admin@example.org"

TR, TJ, LJ, PG, RV = (
    standin_sql(n) for n in ("translations", "translit_jobs", "jobs", "job_pages", "reviews")
)


# --- history -------------------------------------------------------------------------

_PAGE_COLS = "translation_id, uid, chapter_title, book_id"


def _page_sql(where: str) -> str:
    return f"""
    with {TR},
    p as (select {_PAGE_COLS}, created_at, row_number() over (order by created_at desc, translation_id desc) as rn
          from translations {where})
    select {_PAGE_COLS}, {ts_text('p.created_at')} as created_at,
      case when (select count(*) from p) > 20 then (select translation_id from p where rn = 20) end as next_cursor
    from p where rn <= 20
    """


@query("history_page", _page_sql(""))
def _page(spark, sf_dir):
    cols = [c.strip() for c in _PAGE_COLS.split(",")]
    out = history.history_page(standin(spark, sf_dir, "translations"))
    return out.select(*cols, "created_at", "next_cursor")


@query(
    "history_page_after_cursor",
    _page_sql(
        "where created_at < (select o_orderdate from orders where o_orderkey = 100) or "
        "(created_at = (select o_orderdate from orders where o_orderkey = 100) and translation_id < 100)"
    ),
)
def _page_after(spark, sf_dir):
    cols = [c.strip() for c in _PAGE_COLS.split(",")]
    out = history.history_page(standin(spark, sf_dir, "translations"), cursor=100)
    return out.select(*cols, "created_at", "next_cursor")


_HAY = (
    "lower(concat_ws(' ', coalesce(chapter_title, ''), coalesce(book_title, ''), coalesce(email, ''), "
    "left(coalesce(output, ''), 400), left(coalesce(input_preview, ''), 200)))"
)


@query(
    "history_search",
    f"with {TR} select translation_id, email from translations where contains({_HAY}, 'in building')",
)
def _search(spark, sf_dir):
    rows = history.history_search(standin(spark, sf_dir, "translations"), "  In BUILDING ")
    return rows.select("translation_id", "email")


_WHOLE = _HAY.replace("left(coalesce(output, ''), 400)", "coalesce(output, '')").replace(
    "left(coalesce(input_preview, ''), 200)", "coalesce(input_preview, '')"
)


@query(
    "history_search_store",
    f"with {TR} select translation_id, email from translations where contains({_WHOLE}, '000000012. in')",
)
def _search_store(spark, sf_dir):
    """Whole texts, from a store with a trigram index."""
    path = scratch_path(spark, "search")
    rows = standin(spark, sf_dir, "translations")
    fields = history.history_fields(None, None)
    write_search_store(rows, path, fields, ["translation_id"], blocks=32)
    return search_store(spark, path, " 000000012. IN").select("translation_id", "email")


BOOKS_SQL = f"""
    {TR},
    o as (select *, row_number() over (partition by book_id order by coalesce(chapter_index, 0), translation_id) as rn
          from translations where coalesce(book_id, '') <> ''),
    items as (
      select 'book' as type, book_id as item_id,
        coalesce(nullif(max(case when rn = 1 then book_title end), ''), 'Untitled Book') as title,
        count(*) as chapters, cast(sum(coalesce(output_word_count, 0)) as bigint) as total_words,
        cast(sum(coalesce(flags_count, 0)) as bigint) as total_flags,
        max(case when rn = 1 then created_at end) as created_at, max(case when rn = 1 then email end) as email
      from o group by book_id
      union all
      select 'single', cast(translation_id as varchar), chapter_title, 1, output_word_count, flags_count, created_at, email
      from translations where coalesce(book_id, '') = '')
"""


@query(
    "group_books",
    f"""
    with {BOOKS_SQL}
    select type, item_id, title, chapters, total_words, total_flags,
      {ts_text('created_at')} as created_at, email from items
    """,
)
def _books(spark, sf_dir):
    return history.group_books(standin(spark, sf_dir, "translations"))


def _positions(ordered: DataFrame) -> DataFrame:
    """Every row of a sorted table with its place in it, as the table's own order has it.

    Rows are counted within the partitions of the sort; only the partitions' sizes are
    summed up in one task.
    """
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    numbered = cut_lineage(
        ordered.select("*", F.spark_partition_id().alias("__part"), within.alias("__i"))
    )
    before = W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    sizes = numbered.groupBy(F.col("__part").alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    starts = sizes.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    placed = numbered.join(starts, F.col("__part") == F.col("__p"))
    return placed.withColumn("position", F.col("__start") + F.col("__i") + 1)


def _sorted_items(key: str, sql_order: str):
    @query(
        f"sort_items_{key.replace('-', '_')}",
        f"""
        with {BOOKS_SQL}
        select type, item_id, total_words, total_flags,
          row_number() over (order by {sql_order}, item_id) as position
        from items
        """,
    )
    def _q(spark, sf_dir):
        items = history.group_books(standin(spark, sf_dir, "translations"))
        placed = _positions(history.sort_items(items, key))
        return placed.select("type", "item_id", "total_words", "total_flags", "position")


_sorted_items("date-desc", "created_at desc")
_sorted_items("date-asc", "created_at asc")
_sorted_items("words-desc", "total_words desc")
_sorted_items("flags-desc", "total_flags desc")


@query(
    "book_chapters",
    f"""
    with {TR} select book_id, coalesce(chapter_index, 0)::bigint as chapter_index, translation_id
    from translations where coalesce(book_id, '') <> ''
    """,
)
def _book_chapters(spark, sf_dir):
    out = history.book_chapters(standin(spark, sf_dir, "translations"))
    return out.select("book_id", "chapter_index", "translation_id")


@query(
    "chapter_summary",
    f"""
    with {TR} select book_id, cast(sum(output_word_count) as bigint) as words, count(*) as chapter_count,
      cast(sum(flags_count) as bigint) as flags
    from translations where coalesce(book_id, '') <> '' group by book_id
    """,
)
def _chapter_summary(spark, sf_dir):
    return history.chapter_summary(standin(spark, sf_dir, "translations"))


@query(
    "flag_bands",
    f"""
    with {TR} select book_id, count(*) filter (where flags_count = 0) as no_flags,
      count(*) filter (where flags_count between 1 and 2) as few_flags,
      count(*) filter (where flags_count >= 3) as many_flags
    from translations group by book_id
    """,
)
def _bands(spark, sf_dir):
    return history.flag_histogram(standin(spark, sf_dir, "translations"))


def _delete_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order asks to delete the order with its customer's number, as its own user."""
    return load(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("translation_id"),
        F.concat(F.lit("u"), F.col("o_orderkey").cast("string")).alias("uid"),
    )


_DELETE = """
    rq as (select distinct o_custkey as translation_id, concat('u', o_orderkey) as uid from orders)
"""


@query(
    "delete_owned_outcomes",
    f"""
    with {TR}, {_DELETE}
    select rq.translation_id, rq.uid, case when t.translation_id is null then 'not_found'
      when t.uid = rq.uid then 'ok' else 'forbidden' end as outcome
    from rq left join translations t on t.translation_id = rq.translation_id
    """,
)
def _delete(spark, sf_dir):
    rows = standin(spark, sf_dir, "translations")
    return history.delete_owned(rows, _delete_requests(spark, sf_dir))[1]


@query(
    "delete_owned_remaining",
    f"""
    with {TR}, {_DELETE}
    select translation_id, uid from translations t
    where not exists (select 1 from rq where rq.translation_id = t.translation_id and rq.uid = t.uid)
    """,
)
def _remaining(spark, sf_dir):
    rows = standin(spark, sf_dir, "translations")
    left = history.delete_owned(rows, _delete_requests(spark, sf_dir))[0]
    return left.select("translation_id", "uid")


# --- reviews ----------------------------------------------------------------------------


@query(
    "reviews_for",
    f"""
    with {RV} select review_id, section_index, md5(comment) as comment_hash from reviews
    where translation_id = 7
    """,
)
def _reviews_for(spark, sf_dir):
    rows = history.reviews_for(standin(spark, sf_dir, "reviews"), 7)
    return rows.select("review_id", "section_index", F.md5("comment").alias("comment_hash"))


@query(
    "reviews_by_section",
    f"with {RV} select translation_id, section_index::bigint as section_index, review_id from reviews",
)
def _threads(spark, sf_dir):
    rows = history.reviews_by_section(standin(spark, sf_dir, "reviews"))
    return rows.select("translation_id", "section_index", "review_id")


@query(
    "comment_counts",
    f"""
    with {RV} select translation_id, section_index::bigint as section_index, count(*) as comments
    from reviews group by translation_id, section_index
    """,
)
def _comments(spark, sf_dir):
    return history.comment_counts(standin(spark, sf_dir, "reviews"))


_SUBMITTED_FIELDS = [
    "case when turn = 3 then null when turn = 4 then '  ' else concat(' ', text, ' ') end as comment",
    "case when turn = 5 then null when role = 'user' then '@example.org' else 'helper@example.org' end as email",
    "case when turn = 1 then 'Given' end as display_name",
]
_SUBMITTED = ", ".join(_SUBMITTED_FIELDS)


def _submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "conversations").selectExpr(
        "conv_id as translation_id", "turn as section_index", *_SUBMITTED_FIELDS
    )


@query(
    "ingest_reviews_accepted",
    f"""
    with s as (select conv_id as translation_id, turn as section_index, {_SUBMITTED} from conversations)
    select translation_id, section_index, md5({trim('comment')}) as comment_hash, coalesce(email, '') as email,
      coalesce(display_name, split_part(email, '@', 1), 'Anonymous') as display_name
    from s where comment is not null and {trim('comment')} <> ''
    """,
)
def _accepted(spark, sf_dir):
    rows = history.ingest_reviews(_submissions(spark, sf_dir))[0]
    return rows.select(
        "translation_id",
        "section_index",
        F.md5("comment").alias("comment_hash"),
        "email",
        "display_name",
    )


@query(
    "ingest_reviews_rejected",
    f"""
    with s as (select conv_id as translation_id, turn as section_index, {_SUBMITTED} from conversations)
    select translation_id, section_index,
      case when comment is null then 'missing_field' else 'empty_comment' end as reason
    from s where comment is null or {trim('comment')} = ''
    """,
)
def _rejected(spark, sf_dir):
    rows = history.ingest_reviews(_submissions(spark, sf_dir))[1]
    return rows.select("translation_id", "section_index", "reason")


@query("visible_rows", f"with {TR} select translation_id from translations where uid = 'u7'")
def _visible(spark, sf_dir):
    rows = history.visible_rows(standin(spark, sf_dir, "translations"), "u7")
    return rows.select("translation_id")


@query(
    "visible_children",
    f"""
    with {TJ}, {PG} select job_id, page_num::bigint as page_num from job_pages
    where job_id in (select job_id from translit_jobs where uid = 'u7')
    """,
)
def _children(spark, sf_dir):
    pages, jobs = standin(spark, sf_dir, "job_pages"), standin(spark, sf_dir, "translit_jobs")
    return history.visible_children(pages, jobs, "job_id", "u7").select("job_id", "page_num")


# --- operations views ----------------------------------------------------------------------

_ADMIN_COLS = """job_id as id, uid, email, filename, status, total_pages::bigint as total_pages,
    pages_completed::bigint as pages_completed, translate_requested, translation_status"""


@query(
    "admin_jobs",
    f"""
    with {TJ} select {_ADMIN_COLS}, {ts_text('created_at')} as created_at,
      {ts_text('started_at')} as started_at, {ts_text('completed_at')} as completed_at, error
    from translit_jobs order by translit_jobs.created_at desc, job_id limit 50
    """,
)
def _admin_jobs(spark, sf_dir):
    return admin.admin_jobs(standin(spark, sf_dir, "translit_jobs"))


@query(
    "admin_jobs_by_status",
    f"""
    with {TJ} select {_ADMIN_COLS}, {ts_text('created_at')} as created_at,
      {ts_text('started_at')} as started_at, {ts_text('completed_at')} as completed_at, error
    from translit_jobs where status = 'failed' order by translit_jobs.created_at desc, job_id limit 200
    """,
)
def _admin_failed(spark, sf_dir):
    return admin.admin_jobs(standin(spark, sf_dir, "translit_jobs"), "failed", 1000)


@query(
    "status_counts",
    f"""
    with {TJ},
    v as (select unnest(['pending', 'ocr_running', 'assembling', 'transliterating', 'done', 'failed', 'cancelled']) as status)
    select v.status, count(j.job_id) as n from v left join translit_jobs j on j.status = v.status group by v.status
    """,
)
def _status_counts(spark, sf_dir):
    return admin.status_counts(standin(spark, sf_dir, "translit_jobs"))


@query(
    "legacy_status_counts",
    f"""
    with {LJ}, v as (select unnest(['pending', 'running', 'completed', 'failed', 'cancelled']) as status)
    select v.status, count(j.job_id) as n from v left join jobs j on j.status = v.status group by v.status
    """,
)
def _legacy_counts(spark, sf_dir):
    return admin.legacy_status_counts(standin(spark, sf_dir, "jobs"))


@query(
    "oldest_pending",
    f"""
    with {TJ} select strftime(min(created_at), '%Y-%m-%d %H:%M:%S') as oldest_pending
    from translit_jobs where status = 'pending'
    """,
)
def _oldest(spark, sf_dir):
    return admin.oldest_pending(standin(spark, sf_dir, "translit_jobs"))


@query(
    "last_activity",
    f"""
    with {TJ} select {ts_text('max(completed_at)')} as last_completed,
      {ts_text('max(coalesce(completed_at, started_at, created_at))')} as last_activity from translit_jobs
    """,
)
def _activity(spark, sf_dir):
    return admin.last_activity(standin(spark, sf_dir, "translit_jobs"))


@query(
    "day_stats",
    f"""
    with {LJ}, d as (select date_trunc('day', {AS_OF_SQL}) as today)
    select count(*) filter (where status = 'pending') as pending,
      count(*) filter (where status = 'running') as running,
      count(*) filter (where status = 'completed' and completed_at >= today) as done_today,
      count(*) filter (where status = 'failed' and coalesce(completed_at, created_at) >= today) as failed_today,
      count(*) as total
    from jobs, d
    """,
)
def _day(spark, sf_dir):
    return admin.day_stats(standin(spark, sf_dir, "jobs"), AS_OF)


@query(
    "search_translit_jobs",
    f"""
    with {TJ} select job_id, filename from translit_jobs
    where contains(lower(concat_ws(' ', filename, email)), '7.pdf user')
    """,
)
def _search_jobs(spark, sf_dir):
    rows = admin.search_translit_jobs(standin(spark, sf_dir, "translit_jobs"), "7.PDF user")
    return rows.select("job_id", "filename")


@query(
    "search_jobs",
    """
    select conv_id, turn from conversations
    where contains(lower(concat_ws(' ', concat(role, '@example.org'), 'Chapter', '', left(text, 200))), 'chapter  in')
    """,
)
def _search_legacy(spark, sf_dir):
    rows = load(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        F.concat("role", F.lit("@example.org")).alias("email"),
        F.struct(
            F.lit("Chapter").alias("chapterTitle"),
            F.lit(None).cast("string").alias("bookTitle"),
            F.col("text").alias("text"),
        ).alias("input"),
    )
    return admin.search_jobs(rows, "chapter  in").select("conv_id", "turn")


@query(
    "search_jobs_whole_text",
    """
    select conv_id, turn from conversations
    where contains(lower(concat_ws(' ', concat(role, '@example.org'), coalesce(text, ''))), 'e th')
    """,
)
def _search_whole(spark, sf_dir):
    """Every text as a whole, not its first characters only."""
    rows = load(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        F.concat("role", F.lit("@example.org")).alias("email"),
        F.struct(
            F.lit("").alias("chapterTitle"),
            F.lit(None).cast("string").alias("bookTitle"),
            F.col("text").alias("text"),
        ).alias("input"),
    )
    return admin.search_jobs(rows, "e th", text_chars=None).select("conv_id", "turn")


@query(
    "active_topn",
    f"""
    with {TJ}, r as (select uid, job_id as id, status, row_number() over (partition by uid order by job_id desc) as rank
      from translit_jobs where status in ('pending', 'ocr_running', 'assembling', 'transliterating'))
    select uid, id, status, rank from r where rank <= 4
    """,
)
def _active(spark, sf_dir):
    rows = admin.active_jobs(standin(spark, sf_dir, "translit_jobs"))
    return rows.select("uid", "id", "status", "rank")


@query(
    "progress_pct",
    f"""
    with {TJ} select job_id, cast(case when total_pages > 0
      then floor(pages_completed::double / total_pages * 100 + 0.5) else 0 end as bigint) as pct from translit_jobs
    """,
)
def _pct(spark, sf_dir):
    return standin(spark, sf_dir, "translit_jobs").select(
        "job_id", admin.progress_pct("pages_completed", "total_pages").alias("pct")
    )


@query(
    "page_overview",
    f"""
    with {PG} select job_id, count(*) as pages, count(*) filter (where status = 'ocr_done') as done,
      count(*) filter (where status = 'ocr_failed') as failed, cast(sum(attempts) as bigint) as attempts
    from job_pages group by job_id
    """,
)
def _overview(spark, sf_dir):
    return admin.page_overview(standin(spark, sf_dir, "job_pages"))


@query(
    "failed_pages",
    f"""
    with {PG} select job_id, page_num::bigint as page_num, coalesce(error, 'OCR failed') as error,
      attempts::bigint as attempts from job_pages where status = 'ocr_failed'
    """,
)
def _failed_pages(spark, sf_dir):
    return admin.failed_pages(standin(spark, sf_dir, "job_pages"))


@query(
    "next_job",
    f"""
    with {LJ} select job_id, uid, {ts_text('created_at')} as created_at from jobs
    where mode = 'local' and status = 'pending' order by jobs.created_at, job_id limit 1
    """,
)
def _next(spark, sf_dir):
    return admin.next_job(standin(spark, sf_dir, "jobs")).select("job_id", "uid", "created_at")


@query(
    "pending_translations",
    f"""
    with {TJ} select job_id from translit_jobs where translate_requested and translation_status = 'pending'
    """,
)
def _pending(spark, sf_dir):
    return admin.pending_translations(standin(spark, sf_dir, "translit_jobs")).select("job_id")


@query(
    "stuck_alert",
    f"""
    with {TJ} select {ts_text('min(created_at)')} as oldest_pending,
      coalesce(min(created_at) < {AS_OF_SQL} - interval '5' minute, false) as stuck
    from translit_jobs where status = 'pending'
    """,
)
def _stuck(spark, sf_dir):
    return admin.stuck_alert(standin(spark, sf_dir, "translit_jobs"), AS_OF)


# --- admission and fan-out ---------------------------------------------------------------------

_FILE_FIELDS = [
    "concat('doc', doc_id, case lang when 'en' then '.txt' when 'de' then '.pdf' when 'fr' then '.GIF' else '.exe' end) as filename",
    "case when n_chars < 100 then 0 when n_chars > 20000 then n_chars * 20000 else n_chars end as size_bytes",
]
_FILES = ", ".join(_FILE_FIELDS)


@query(
    "admit_documents",
    f"""
    with f as (select doc_id, {_FILES}, text from documents)
    select doc_id, case when size_bytes > 104857600 then 'too_large' when size_bytes = 0 then 'empty_file'
      when filename like '%.GIF' and size_bytes > 20971520 then 'image_too_large'
      when filename like '%.GIF' then 'image_type_not_supported'
      when filename like '%.exe' then 'unsupported_type'
      when filename like '%.txt' and {trim('text')} = '' then 'no_text' end as reason
    from f
    """,
)
def _admit(spark, sf_dir):
    files = load(spark, sf_dir, "documents").selectExpr("doc_id", "text", *_FILE_FIELDS)
    reason = admission_reason(F.col("filename"), F.col("size_bytes"), F.col("text"))
    return files.select("doc_id", reason.alias("reason"))


@query(
    "admit_sections",
    f"""
    select doc_id, {words('text')} as word_count from documents
    where {words('text')} between 1 and 50000
    """,
)
def _admit_sections(spark, sf_dir):
    accepted, _ = admit_sections(load(spark, sf_dir, "documents"))
    return accepted.select("doc_id", "word_count")


_CHAPTERS = """
    ch as (
      select concat('conv-', conv_id) as book_id, turn as chapter_index, role as chapter_title,
        case when turn = 2 then '  ' else text end as text from conversations
      union all
      select concat('lang-', lang), doc_id, source, text from documents),
    ct as (select *, {w} as word_count from ch),
    bk as (select book_id, count(*) as total_chapters, count(*) filter (where word_count > 0) as filled,
             max(word_count) as longest from ct group by book_id)
""".format(w=words("text"))


def _chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = load(spark, sf_dir, "conversations").select(
        F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("book_id"),
        F.col("turn").alias("chapter_index"),
        F.col("role").alias("chapter_title"),
        F.when(F.col("turn") == 2, "  ").otherwise(F.col("text")).alias("text"),
    )
    docs = load(spark, sf_dir, "documents").select(
        F.concat(F.lit("lang-"), "lang").alias("book_id"),
        F.col("doc_id").alias("chapter_index"),
        F.col("source").alias("chapter_title"),
        "text",
    )
    return talks.unionByName(docs)


@query(
    "admit_books_rejected",
    f"""
    with {_CHAPTERS}
    select book_id, total_chapters, case when total_chapters > 100 then 'too_many_chapters'
      when longest > 50000 then 'chapter_too_long' else 'no_text' end as reason
    from bk where total_chapters > 100 or longest > 50000 or filled = 0
    """,
)
def _rejected_books(spark, sf_dir):
    return admit_books(_chapters(spark, sf_dir))[1]


@query(
    "fan_out_chapters",
    f"""
    with {_CHAPTERS}
    select concat_ws('-', ct.book_id, chapter_index::varchar) as job_id, ct.book_id, chapter_index, chapter_title,
      md5({trim('text')}) as text_hash, word_count, total_chapters, 'local' as mode, 'pending' as status,
      {AS_OF_TEXT} as created_at
    from ct join bk on bk.book_id = ct.book_id
    where word_count > 0 and total_chapters <= 100 and longest <= 50000
    """,
)
def _fan_chapters(spark, sf_dir):
    accepted, _ = admit_books(_chapters(spark, sf_dir))
    jobs = fan_out_chapters(accepted, AS_OF)
    return jobs.withColumn("text_hash", F.md5("text")).drop("text")


@query(
    "page_fanout",
    f"""
    with {TJ}, e as (select job_id, created_at, unnest(range(1, total_pages + 1)) as page_num from translit_jobs)
    select job_id, page_num, lpad(page_num::varchar, 4, '0') as page_id, 'pending' as status,
      cast(0 as bigint) as attempts, {ts_text('created_at')} as created_at from e
    """,
)
def _fan_pages(spark, sf_dir):
    return fan_out_pages(standin(spark, sf_dir, "translit_jobs"))


# --- transitions ---------------------------------------------------------------------------------

_ACTIONS = """
    actions as (select job_id * 10 + page_num as seq, case when page_num = 7 then -job_id else job_id end as job_id,
      case status when 'ocr_done' then 'cancel' when 'ocr_failed' then 'force-fail' else 'restart' end as action,
      'admin@example.org' as admin from job_pages),
    firsts as (select job_id, min(seq) as seq, arg_min(action, seq) as action from actions
      where action in ('cancel', 'force-fail') group by job_id)
"""


def _actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standin(spark, sf_dir, "job_pages").select(
        (F.col("job_id") * 10 + F.col("page_num")).alias("seq"),
        F.when(F.col("page_num") == 7, -F.col("job_id")).otherwise(F.col("job_id")).alias("job_id"),
        F.when(F.col("status") == "ocr_done", "cancel")
        .when(F.col("status") == "ocr_failed", "force-fail")
        .otherwise("restart")
        .alias("action"),
        F.lit(ADMIN).alias("admin"),
    )


@query(
    "transition_jobs",
    f"""
    with {TJ}, {PG}, {_ACTIONS},
    j as (select t.*, f.action, f.action is not null and t.status not in ('done', 'failed', 'cancelled') as hit
          from translit_jobs t left join firsts f on f.job_id = t.job_id)
    select job_id,
      case when not hit then status when action = 'cancel' then 'cancelled' else 'failed' end as status,
      case when not hit then error when action = 'force-fail' then 'Force-failed by admin <admin@example.org>' end as error,
      case when not hit then note when action = 'cancel' then 'Status set to cancelled by admin <admin@example.org>'
        else 'Status set to failed by admin <admin@example.org>' end as note,
      case when hit then {AS_OF_TEXT} end as updated_at
    from j
    """,
)
def _transition(spark, sf_dir):
    jobs = standin(spark, sf_dir, "translit_jobs")
    new, _ = transitions.transition(jobs, _actions(spark, sf_dir), AS_OF)
    return new.select("job_id", "status", "error", "note", "updated_at")


@query(
    "transition_outcomes",
    f"""
    with {TJ}, {PG}, {_ACTIONS}
    select a.seq, a.job_id, a.action,
      case when a.action not in ('cancel', 'force-fail') then 'invalid' when t.job_id is null then 'not_found'
        when t.status in ('done', 'failed', 'cancelled') or a.seq > f.seq then 'conflict' else 'ok' end as outcome
    from actions a left join translit_jobs t on t.job_id = a.job_id left join firsts f on f.job_id = a.job_id
    """,
)
def _outcomes(spark, sf_dir):
    jobs = standin(spark, sf_dir, "translit_jobs")
    return transitions.transition(jobs, _actions(spark, sf_dir), AS_OF)[1]


def _bulk(action: str, cases: str):
    @query(f"bulk_{action.replace('-', '_')}", f"with {TJ} {cases}")
    def _q(spark, sf_dir):
        jobs = standin(spark, sf_dir, "translit_jobs")
        new, _ = transitions.bulk_transition(jobs, action, AS_OF, ADMIN)
        return new.select("job_id", "status", "error", "note", "updated_at")


_bulk(
    "cancel-pending",
    f"""select job_id, case when status = 'pending' then 'cancelled' else status end as status, error,
      case when status = 'pending' then 'Bulk cancel by admin <{ADMIN}>' else note end as note,
      case when status = 'pending' then {AS_OF_TEXT} end as updated_at from translit_jobs""",
)
_bulk(
    "force-fail-stuck",
    f"""select job_id,
      case when status in ('ocr_running', 'assembling', 'transliterating') then 'failed' else status end as status,
      case when status in ('ocr_running', 'assembling', 'transliterating') then 'Force-failed (bulk) by admin <{ADMIN}>' else error end as error,
      case when status in ('ocr_running', 'assembling', 'transliterating') then 'Bulk force-fail from ' || status else note end as note,
      case when status in ('ocr_running', 'assembling', 'transliterating') then {AS_OF_TEXT} end as updated_at
      from translit_jobs""",
)
_bulk(
    "delete-failed",
    """select job_id, status, error, note, cast(null as varchar) as updated_at from translit_jobs
    where status <> 'failed'""",
)
_bulk(
    "delete-cancelled",
    """select job_id, status, error, note, cast(null as varchar) as updated_at from translit_jobs
    where status <> 'cancelled'""",
)


@query(
    "bulk_affected",
    f"""
    with {TJ} select count(*) filter (where status in ('ocr_running', 'assembling', 'transliterating')) as affected
    from translit_jobs
    """,
)
def _affected(spark, sf_dir):
    jobs = standin(spark, sf_dir, "translit_jobs")
    return transitions.bulk_transition(jobs, "force-fail-stuck", AS_OF, ADMIN)[1]


@query(
    "legacy_bulk_force_fail",
    f"""
    with {LJ} select job_id, case when status = 'running' then 'failed' else status end as status,
      case when status = 'running' then 'Bulk force-fail from running' else note end as note from jobs
    """,
)
def _legacy_bulk(spark, sf_dir):
    jobs = standin(spark, sf_dir, "jobs")
    new, _ = transitions.legacy_bulk_transition(jobs, "force-fail-stuck", AS_OF, ADMIN)
    return new.select("job_id", "status", "note")


def _doomed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standin(spark, sf_dir, "translit_jobs").filter(F.col("status") == "failed").select("job_id")


@query(
    "cascade_delete",
    f"""
    with {TJ}, {PG} select job_id, page_num::bigint as page_num from job_pages p
    where not exists (select 1 from translit_jobs t where t.job_id = p.job_id and t.status = 'failed')
    """,
)
def _cascade(spark, sf_dir):
    jobs, pages = standin(spark, sf_dir, "translit_jobs"), standin(spark, sf_dir, "job_pages")
    kept = transitions.cascade_delete(jobs, pages, _doomed(spark, sf_dir))[1]
    return kept.select("job_id", "page_num")


_RETRY = """
    rq as (select distinct case when page_num = 1 then -job_id else job_id end as job_id,
             case when page_num = 6 then 12000 when page_num = 5 then 50 else page_num end as page_num from job_pages),
    oc as (select rq.job_id, rq.page_num, case when rq.page_num not between 1 and 9999 then 'invalid_page'
             when j.job_id is null then 'job_not_found' when p.job_id is null then 'page_not_found'
             when p.status = 'ocr_done' then 'conflict' else 'ok' end as outcome
           from rq left join translit_jobs j on j.job_id = rq.job_id
           left join job_pages p on p.job_id = rq.job_id and p.page_num = rq.page_num),
    ok as (select * from oc where outcome = 'ok')
"""


def _retry(spark: SparkSession, sf_dir: str):
    jobs, pages = standin(spark, sf_dir, "translit_jobs"), standin(spark, sf_dir, "job_pages")
    n = F.col("page_num")
    requests = pages.select(
        F.when(n == 1, -F.col("job_id")).otherwise(F.col("job_id")).alias("job_id"),
        F.when(n == 6, 12000).when(n == 5, 50).otherwise(n).alias("page_num"),
        F.lit(ADMIN).alias("admin"),
    )
    return transitions.retry_pages(jobs, pages, requests, AS_OF)


@query(
    "retry_outcomes",
    f"with {TJ}, {PG}, {_RETRY} select job_id, page_num::bigint as page_num, outcome from oc",
)
def _retry_outcomes(spark, sf_dir):
    return _retry(spark, sf_dir)[2]


@query(
    "retry_pages",
    f"""
    with {TJ}, {PG}, {_RETRY}
    select p.job_id, p.page_num::bigint as page_num, case when ok.job_id is null then p.status else 'pending' end as status,
      case when ok.job_id is null then p.attempts else 0 end::bigint as attempts,
      case when ok.job_id is null then p.error end as error,
      case when ok.job_id is not null then {AS_OF_TEXT} end as retry_requested_at,
      case when ok.job_id is not null then '{ADMIN}' end as retry_requested_by
    from job_pages p left join ok on ok.job_id = p.job_id and ok.page_num = p.page_num
    """,
)
def _retry_page_rows(spark, sf_dir):
    pages = _retry(spark, sf_dir)[1]
    return pages.select(
        "job_id", "page_num", "status", "attempts", "error", "retry_requested_at", "retry_requested_by"
    )


@query(
    "retry_jobs",
    f"""
    with {TJ}, {PG}, {_RETRY},
    f as (select job_id, min(page_num) as page from ok group by job_id),
    j as (select t.*, f.page, f.page is not null and t.status in ('done', 'failed', 'cancelled') as hit
          from translit_jobs t left join f on f.job_id = t.job_id)
    select job_id, case when hit then 'ocr_running' else status end as status, case when not hit then error end as error,
      case when hit then 'Re-opened by admin <{ADMIN}> for page ' || page || ' retry' else note end as note,
      case when not hit then {ts_text('completed_at')} end as completed_at
    from j
    """,
)
def _retry_job_rows(spark, sf_dir):
    jobs = _retry(spark, sf_dir)[0]
    return jobs.select("job_id", "status", "error", "note", "completed_at")


@query(
    "resume_skip",
    f"""
    with {PG} select job_id, page_num::bigint as page_num from job_pages
    where coalesce(transliterated_text, '') = '' and status <> 'ocr_done'
    """,
)
def _resume(spark, sf_dir):
    pages = standin(spark, sf_dir, "job_pages")
    done = pages.filter(F.col("status") == "ocr_done")
    return transitions.resume_skip(pages, done).select("job_id", "page_num")


@query(
    "ready_parents",
    f"""
    with {TJ} select job_id from translit_jobs where status = 'ocr_running' and pages_completed >= total_pages
    """,
)
def _ready(spark, sf_dir):
    return transitions.ready_parents(standin(spark, sf_dir, "translit_jobs")).select("job_id")


@query(
    "ready_parents_counted",
    f"""
    with {TJ}, {PG}, d as (select job_id, count(distinct page_num) as done from job_pages where status = 'ocr_done' group by job_id)
    select t.job_id, coalesce(done, 0) as pages_completed from translit_jobs t left join d on d.job_id = t.job_id
    where status = 'ocr_running' and coalesce(done, 0) >= total_pages
    """,
)
def _ready_counted(spark, sf_dir):
    jobs, pages = standin(spark, sf_dir, "translit_jobs"), standin(spark, sf_dir, "job_pages")
    return transitions.ready_parents(jobs, pages).select("job_id", "pages_completed")


# --- exports -------------------------------------------------------------------------------------


def _with_chunks(rows: DataFrame) -> DataFrame:
    n = F.col("flags_count")
    none = F.array().cast("array<string>")

    def chunk(index: int, flags) -> F.Column:
        return F.struct(
            F.lit(index).alias("index"),
            F.lit("o").alias("original"),
            F.lit("t").alias("translation"),
            flags.alias("flags"),
        )

    late = F.when(n >= 2, F.array(F.lit("flag a"), F.lit("flag b"))).otherwise(none)
    early = F.when(n.isin(1, 3), F.array(F.lit("flag c"))).otherwise(none)
    return rows.withColumn("chunk_data", F.array(chunk(1, late), chunk(0, early)))


@query(
    "export_txt",
    f"""
    with {TR}, p as (select translation_id, chapter_title, {trim('output')} as body,
      flags_count >= 2 as late, flags_count in (1, 3) as early,
      (case when flags_count >= 2 then 2 else 0 end) + (case when flags_count in (1, 3) then 1 else 0 end) as n,
      (case when flags_count >= 2 then 1 else 0 end) + (case when flags_count in (1, 3) then 1 else 0 end) as s
      from translations)
    select translation_id, md5(chapter_title || E'\\n' || repeat('—', least(60, length(chapter_title))) || E'\\n\\n' || body ||
      case when n = 0 then '' else E'\\n\\n\\nTRANSLATOR FLAGS\\n' || repeat('—', 60) || E'\\n' || n || ' self-flag'
        || case when n = 1 then '' else 's' end || ' across ' || s || ' section' || case when s = 1 then '' else 's' end
        || E' — translator concerns the reviewer may want to verify.\\n\\n'
        || array_to_string(list_filter([case when early then E'Section 1\\n  • flag c\\n' end,
             case when late then E'Section 2\\n  • flag a\\n  • flag b\\n' end], lambda x: x is not null), chr(10)) end) as body_hash
    from p
    """,
)
def _export(spark, sf_dir):
    rows = _with_chunks(standin(spark, sf_dir, "translations"))
    return export_txt(rows).select("translation_id", F.md5("body").alias("body_hash"))


@query(
    "flags_count",
    f"""
    with {TR} select translation_id, cast((case when flags_count >= 2 then 2 else 0 end)
      + (case when flags_count in (1, 3) then 1 else 0 end) as bigint) as flags from translations
    """,
)
def _flags(spark, sf_dir):
    rows = _with_chunks(standin(spark, sf_dir, "translations"))
    return rows.select("translation_id", flags_count("chunk_data").alias("flags"))


@query(
    "training_join",
    f"""
    with {TR}, {RV}, g as (select translation_id, count(*) as n, string_agg(comment, '|' order by created_at) as c
      from reviews group by translation_id)
    select t.translation_id, cast(0 as bigint) as part, coalesce(n, 0) as reviews, md5(coalesce(c, '')) as comments_hash,
      flags_count::bigint as flags_count, chapter_title
    from translations t left join g on g.translation_id = t.translation_id
    """,
)
def _training(spark, sf_dir):
    out = export_training_json(
        standin(spark, sf_dir, "translations"),
        standin(spark, sf_dir, "reviews"),
        exported_at=AS_OF,
        exported_by=ADMIN,
    )
    return out.select(
        "translation_id",
        "part",
        F.size("reviews").alias("reviews"),
        F.md5(F.array_join(F.col("reviews")["comment"], "|")).alias("comments_hash"),
        "flags_count",
        "chapter_title",
    )
