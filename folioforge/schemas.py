"""Table schemas and status vocabularies."""

from __future__ import annotations


_CORRECTION = "struct<from:string,to:string,rule:string,count:int>"
_CHUNK = "struct<index:int,original:string,translation:string,flags:array<string>>"
_STAGE = "struct<status:string,completed:int,total:int,chunkCount:int,totalFixes:int>"



JOBS_DDL = (
    "job_id string, uid string, email string, mode string, status string, "
    "input struct<text:string,wordCount:int,chapterTitle:string,bookId:string,"
    "bookTitle:string,chapterIndex:int,totalChapters:int>, "
    "created_at timestamp, started_at timestamp, completed_at timestamp, "
    "error string, note string, "
    "progress struct<currentStage:string,commentary:string,"
    f"stages:map<string,{_STAGE}>,chunks:array<{_CHUNK}>>, "
    "result struct<output:string,wordCount:int,totalFixes:int,flagsCount:int,"
    f"translationId:string,corrections:array<{_CORRECTION}>>"
)
TRANSLIT_JOBS_DDL = (
    "job_id string, uid string, email string, filename string, total_pages int, "
    "pages_completed int, status string, created_at timestamp, started_at timestamp, "
    "completed_at timestamp, updated_at timestamp, error string, note string, "
    "source_output string, transliterated_output string, translate_requested boolean, "
    "translation_status string, translation_output string, translation_error string"
)
PAGES_DDL = (
    "job_id string, page_num int, page_id string, status string, attempts int, "
    "claimed_by string, claimed_at timestamp, source_text string, "
    "transliterated_text string, word_count int, error string, created_at timestamp, "
    "completed_at timestamp, retry_requested_at timestamp, retry_requested_by string"
)
TRANSLATIONS_DDL = (
    "translation_id string, uid string, email string, chapter_title string, "
    "book_id string, book_title string, chapter_index int, total_chapters int, "
    "input_word_count int, output_word_count int, output string, input_preview string, "
    f"chunk_data array<{_CHUNK}>, flags_count int, created_at timestamp"
)
REVIEWS_DDL = (
    "translation_id string, review_id string, uid string, email string, "
    "display_name string, comment string, section_index int, created_at timestamp"
)
PAGE_EVENTS_DDL = (
    "job_id string, page_num int, event string, worker string, error string, ts timestamp"
)
REQUESTS_DDL = "key string, ts timestamp"

# Status vocabularies.
JOB_STATUSES = ["pending", "running", "completed", "failed", "cancelled"]
TRANSLIT_STATUSES = [
    "pending", "ocr_running", "assembling", "transliterating", "done", "failed", "cancelled",
]
IN_FLIGHT_STATUSES = ["ocr_running", "assembling", "transliterating"]
ACTIVE_STATUSES = ["pending", *IN_FLIGHT_STATUSES]
PAGE_STATUSES = ["pending", "ocr_running", "ocr_done", "ocr_failed"]
TRANSLATION_STATUSES = ["idle", "pending", "running", "done", "failed"]
JOB_TERMINAL = ["completed", "failed", "cancelled"]
TRANSLIT_TERMINAL = ["done", "failed", "cancelled"]
