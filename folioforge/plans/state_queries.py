"""Queries for assembly, response parsing, stage flows and keyed state, batch and stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import state, transitions
from ..operators.assemble import assemble_book, assemble_chunks, assemble_pages, final_word_count
from ..operators.chunk import chunk_documents
from ..operators.digest import PART_CHARS, md5_of_parts
from ..operators.ledger import finished_pages, read_ledger, record_pages
from ..operators.responses import annotate_responses
from ..operators.rules import RuleBook
from ..session import scratch_path
from ..streaming import live, pages
from .flows import build_requests, secondary_flow, translate_flow, transliterate_flow
from .registry import query, ts_text
from .standins import load, standin, standin_sql
from .text_queries import (
    chunks_sql,
    documents,
    marks,
    plain_letters,
    tidy,
    trim,
    words,
)

PG, TR = standin_sql("job_pages"), standin_sql("translations")
PE, PU = standin_sql("page_events"), standin_sql("progress_updates")


# --- assembly ----------------------------------------------------------------------------


def _sentences(x: str) -> str:
    marked = f"regexp_replace({x}, '([.!?])\\s+', '\\1␞', 'g')"
    return f"list_filter(string_split({marked}, '␞'), lambda s: s <> '')"


def assembly_sql(source: str, prefix: str) -> str:
    """CTEs that assemble ``source`` (id, idx, text) to ``{prefix}_out`` (id, text, pieces)."""
    p = prefix
    same = lambda n: (
        f"len(f.s) >= {n} and len(c.s) >= {n} and "
        f"array_to_string(f.s[len(f.s) - {n - 1} : len(f.s)], ' ') = array_to_string(c.s[1:{n}], ' ')"
    )
    cut = lambda n: f"array_to_string(c.s[{n + 1} : len(c.s)], ' ')"
    piece = f"case when {same(2)} then {cut(2)} when {same(1)} then {cut(1)} else c.t end"
    return f"""
    {p}_n as (select id, count(*) as n, min(text) as single from {source} group by id),
    {p}_t as (select id, idx, {trim('text')} as t from {source}),
    {p}_p as (select id, t, {_sentences('t')} as s, row_number() over (partition by id order by idx) as rn
              from {p}_t where t <> ''),
    {p}_f as (
      select id, rn, t as piece, s from {p}_p where rn = 1
      union all
      select id, rn, piece, {_sentences('piece')} as s from (
        select c.id, c.rn, {piece} as piece from {p}_f f join {p}_p c on c.id = f.id and c.rn = f.rn + 1)),
    {p}_j as (select id, string_agg(piece, E'\\n\\n' order by rn) as text, count(*) as pieces from {p}_f group by id),
    {p}_out as (select n.id, case when n.n = 1 then single else coalesce(text, '') end as text,
                  coalesce(pieces, 0) as pieces from {p}_n n left join {p}_j j on j.id = n.id)
    """


@query(
    "assemble_conversations",
    f"""
    with recursive src as (select conv_id as id, turn as idx, text from conversations), {assembly_sql('src', 'a')}
    select id as conv_id, md5(text) as text_hash, pieces, {words('text')} as words from a_out
    """,
)
def _assemble(spark, sf_dir):
    out = assemble_chunks(load(spark, sf_dir, "conversations"), id_col="conv_id", order_col="turn")
    return out.select(
        "conv_id", F.md5("text").alias("text_hash"), "pieces", final_word_count("text").alias("words")
    )


OVERLAP_SQL = f"""
    cs as (select conv_id, turn, {_sentences(trim('text'))} as s from conversations),
    src as (select conv_id as id, turn as idx, text from conversations
            union all
            select conv_id, turn + 1000, array_to_string(s[len(s) - 1 : len(s)], ' ') || ' And so on. ' || turn || '.'
            from cs where len(s) > 1)
"""


def _overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations followed by pieces that repeat the last two sentences of each turn."""
    talks = load(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    sents = F.filter(F.split(F.btrim("text", F.lit(" \t\n\r")), "(?<=[.!?])\\s+"), lambda s: s != "")
    echoes = (
        talks.withColumn("s", sents)
        .filter(F.size("s") > 1)
        .select(
            "conv_id",
            (F.col("turn") + 1000).alias("turn"),
            F.concat(
                F.array_join(F.slice("s", F.size("s") - 1, F.lit(2)), " "),
                F.lit(" And so on. "),
                F.col("turn").cast("string"),
                F.lit("."),
            ).alias("text"),
        )
    )
    return talks.unionByName(echoes)


@query(
    "assemble_overlapping",
    f"""
    with recursive {OVERLAP_SQL}, {assembly_sql('src', 'a')}
    select id as conv_id, md5(text) as text_hash, pieces from a_out
    """,
)
def _assemble_overlap(spark, sf_dir):
    """Pieces spread over several order blocks, so the block fold takes part."""
    out = assemble_chunks(_overlapping(spark, sf_dir), id_col="conv_id", order_col="turn")
    return out.select("conv_id", F.md5("text").alias("text_hash"), "pieces")


@query(
    "assemble_pages",
    f"""
    with {PG} select job_id, md5(string_agg(source_text, E'\\n\\n' order by page_num)) as text_hash,
      count(*) as pieces from job_pages group by job_id
    """,
)
def _pages(spark, sf_dir):
    out = assemble_pages(standin(spark, sf_dir, "job_pages"))
    return out.select("job_id", F.md5("text").alias("text_hash"), "pieces")


@query(
    "assemble_book",
    """
    select concat('lang-', lang) as book_id, md5(string_agg(text, E'\\n\\n' order by doc_id)) as text_hash,
      sum(length(text))::bigint + 2 * (count(*) - 1) as n_chars, count(*) as pieces
    from documents where text <> '' group by lang
    """,
)
def _book(spark, sf_dir):
    """Documents of one language as the chapters of one book."""
    # (``when`` keeps the column nullable; otherwise assembly would cast its key and shuffle again)
    book_id = F.when(F.col("lang").isNull(), "lang-").otherwise(F.concat(F.lit("lang-"), "lang"))
    chapters = load(spark, sf_dir, "documents").select(
        book_id.alias("book_id"),
        "doc_id",
        F.col("text").alias("output"),
    )
    parts = assemble_book(chapters, chapter_col="doc_id", part_chars=PART_CHARS)
    return md5_of_parts(parts, id_col="book_id")


# --- responses -----------------------------------------------------------------------------

_RAW = """
    case turn when 0 then concat('<translation>', text, '</translation>', chr(10), '<flags><flag> ', role, ' </flag><flag> </flag></flags>')
      when 1 then concat('```xml', chr(10), '<translation>', text, '</translation><flags></flags>', chr(10), '```')
      when 2 then concat('<translation>', text)
      when 3 then concat('<translation>', text, '</translation>')
      when 4 then concat('<translation>', text, '</translation><translation>x</translation><flags></flags>')
      when 5 then '  '
      when 6 then concat('<translation>', text, '</translation></translation><flags></flags>')
      else text end as raw
"""


@query(
    "parse_responses",
    f"""
    select conv_id, turn,
      case when turn in (0, 1) then md5({trim('text')}) end as text_hash,
      case when turn = 0 then role when turn = 1 then '' end as flags,
      case turn when 0 then null when 1 then null when 2 then 'missing_close:translation' when 3 then 'missing_open:flags'
        when 4 then 'multiple_open:translation' when 5 then 'empty_output:' when 6 then 'multiple_close:translation'
        else 'missing_open:translation' end as error_code,
      case turn when 0 then null when 1 then null when 2 then 'Missing </translation> closing tag'
        when 3 then 'Missing <flags> opening tag' when 4 then 'Multiple <translation> opening tags'
        when 5 then 'Empty translator output' when 6 then 'Multiple </translation> closing tags'
        else 'Missing <translation> opening tag' end as error,
      case when turn in (0, 1) then null else left({trim('raw')}, 200) end as preview
    from (select *, {_RAW} from conversations)
    """,
)
def _responses(spark, sf_dir):
    raw = _RAW.replace("chr(10)", "'\n'")
    rows = load(spark, sf_dir, "conversations").selectExpr(
        "conv_id", "turn", "'translator' as stage", raw
    )
    return annotate_responses(rows).select(
        "conv_id",
        "turn",
        F.md5("text").alias("text_hash"),
        F.array_join("flags", "|").alias("flags"),
        "error_code",
        "error",
        "preview",
    )


@query(
    "build_requests",
    f"""
    with recursive {chunks_sql()}
    select doc_id, cast(chunk_index as bigint) as chunk_index, md5('Chunk ' || (chunk_index + 1) || ' of ' || chunk_count
      || E'. Translate it.\\n\\nSOURCE:\\n' || text) as prompt_hash from z
    """,
)
def _requests(spark, sf_dir):
    chunks = chunk_documents(documents(spark, sf_dir))
    rows = build_requests(chunks, "translator", instruction="Translate it.")
    return rows.select("doc_id", "chunk_index", F.md5("prompt").alias("prompt_hash"))


# --- stage flows ------------------------------------------------------------------------------


def echo_model(requests: DataFrame) -> DataFrame:
    """A deterministic model: echoes its input, flags every chunk, breaks on quotes.

    Translations of chunks with a straight quote lose their closing tag; smoothing fails
    for every chunk with an odd index.
    """

    def block(tag: str, text: Column) -> Column:
        return F.concat(F.lit(f"<{tag}>"), text, F.lit(f"</{tag}>"))

    if "translated" in requests.columns:
        ok = block("smoothed", F.col("translated"))
        raw = F.when(F.col("chunk_index") % 2 == 1, "no tags").otherwise(ok)
        return requests.withColumn("raw", raw)
    text = F.col("text")
    translation = F.concat(
        F.when(F.contains(text, F.lit('"')), F.concat(F.lit("<translation>"), text)).otherwise(
            block("translation", text)
        ),
        F.lit("<flags><flag>check</flag></flags>"),
    )
    raw = F.when(F.col("stage") == "translator", translation).otherwise(
        block("transliteration", text)
    )
    return requests.withColumn("raw", raw)


def _enforced(x: str) -> str:
    return plain_letters(marks(tidy(x)))


def _flow_sql(reject_quotes: bool) -> str:
    bad = "contains(text, '\"')" if reject_quotes else "false"
    return f"""
    {chunks_sql()},
    bad as (select distinct doc_id from z where {bad}),
    src as (select doc_id as id, chunk_index as idx, {_enforced('text')} as text from z
            where doc_id not in (select doc_id from bad)),
    {assembly_sql('src', 'a')},
    fin as (select id as doc_id, {_enforced('text')} as output from a_out),
    cc as (select doc_id, count(*) as n from z group by doc_id)
    """


@query(
    "translate_flow_documents",
    f"""
    with recursive {_flow_sql(True)}
    select fin.doc_id, md5(output) as output_hash, {words('output')} as output_word_count,
      n as chunk_count, n as flags_count
    from fin join cc on cc.doc_id = fin.doc_id
    """,
)
def _translate(spark, sf_dir):
    flow = translate_flow(documents(spark, sf_dir), echo_model)
    return flow.documents.select(
        "doc_id",
        F.md5("output").alias("output_hash"),
        "output_word_count",
        "chunk_count",
        "flags_count",
    )


@query(
    "translate_flow_chunks",
    f"""
    with recursive {_flow_sql(True)}
    select z.doc_id, cast(chunk_index as bigint) as chunk_index, md5({_enforced('text')}) as translation_hash,
      chunk_index % 2 = 1 as fallback
    from z where z.doc_id not in (select doc_id from bad)
    """,
)
def _translate_chunks(spark, sf_dir):
    flow = translate_flow(documents(spark, sf_dir), echo_model)
    return flow.chunks.select(
        "doc_id", "chunk_index", F.md5("translation").alias("translation_hash"), "fallback"
    )


@query(
    "translate_flow_rejects",
    f"""
    with recursive {chunks_sql()}
    select distinct doc_id, 'Missing </translation> closing tag' as error from z where contains(text, '"')
    union all
    select doc_id, 'No content to translate' from documents where {trim('text')} = ''
    """,
)
def _translate_rejects(spark, sf_dir):
    flow = translate_flow(documents(spark, sf_dir), echo_model)
    return flow.rejects


@query(
    "secondary_flow",
    f"""
    with recursive {_flow_sql(True)}
    select doc_id, md5(output) as output_hash from fin
    """,
)
def _secondary(spark, sf_dir):
    flow = secondary_flow(documents(spark, sf_dir), echo_model)
    return flow.documents.select("doc_id", F.md5("output").alias("output_hash"))


@query(
    "transliterate_flow",
    f"""
    with recursive {_flow_sql(False)}
    select fin.doc_id, md5(output) as output_hash, n as chunk_count from fin join cc on cc.doc_id = fin.doc_id
    """,
)
def _transliterate(spark, sf_dir):
    flow = transliterate_flow(documents(spark, sf_dir), echo_model)
    return flow.documents.select("doc_id", F.md5("output").alias("output_hash"), "chunk_count")


@query(
    "transliterate_flow_by_page",
    f"""
    with {PG} select job_id, md5(string_agg(source_text, E'\\n\\n' order by page_num)) as output_hash,
      count(*) as chunk_count from job_pages group by job_id
    """,
)
def _by_page(spark, sf_dir):
    pages = standin(spark, sf_dir, "job_pages").withColumnRenamed("source_text", "text")
    flow = transliterate_flow(pages, echo_model, by="page", id_col="job_id")
    return flow.documents.select("job_id", F.md5("output").alias("output_hash"), "chunk_count")


@query(
    "transliterate_flow_resumed",
    f"""
    with {PG} select job_id,
      md5(string_agg(coalesce(transliterated_text, source_text), E'\\n\\n' order by page_num)) as output_hash,
      count(*) filter (transliterated_text is null) as chunk_count
    from job_pages group by job_id
    """,
)
def _resumed(spark, sf_dir):
    """Pages with a stored result are not sent again; ``chunk_count`` counts the requests."""
    pages = standin(spark, sf_dir, "job_pages")
    stored = finished_pages(pages, ["job_id", "page_num"], output_col="transliterated_text")
    flow = transliterate_flow(
        pages.withColumnRenamed("source_text", "text"),
        echo_model,
        by="page",
        id_col="job_id",
        finished=stored,
    )
    return flow.documents.select("job_id", F.md5("output").alias("output_hash"), "chunk_count")


@query(
    "transliterate_flow_second_run",
    f"""
    with {PG},
    p as (select job_id, page_num, case when page_num = 5 then concat(source_text, ' Mended.') else source_text end as text
          from job_pages)
    select job_id, md5(string_agg(text, E'\\n\\n' order by page_num)) as output_hash,
      count(*) filter (page_num in (2, 5)) as chunk_count
    from p group by job_id
    """,
)
def _second_run(spark, sf_dir):
    """The first run gets no answer for any page 2 and is recorded twice; before the second
    run every page 5 changes.  Only pages 2 and 5 reach the model again."""
    pages = standin(spark, sf_dir, "job_pages").withColumnRenamed("source_text", "text")
    options = {"by": "page", "id_col": "job_id"}

    def forgetful(requests: DataFrame) -> DataFrame:
        answer = F.when(F.col("page_num") == 2, "").otherwise(F.col("raw"))
        return echo_model(requests).withColumn("raw", answer)

    path = scratch_path(spark, "ledger")
    first = transliterate_flow(pages, forgetful, **options)
    for _ in range(2):
        record_pages(first.pages, path, "first")
    mended = F.when(F.col("page_num") == 5, F.concat("text", F.lit(" Mended."))).otherwise(F.col("text"))
    flow = transliterate_flow(
        pages.withColumn("text", mended), echo_model, finished=read_ledger(spark, path), **options
    )
    return flow.documents.select("job_id", F.md5("output").alias("output_hash"), "chunk_count")


@query(
    "response_table_flow",
    f"""
    select item_id, md5({_enforced(trim('text'))}) as output_hash from benchmark where {words('text')} <= 500
    """,
)
def _response_table(spark, sf_dir):
    """The model's answers come from a table made elsewhere."""
    items = load(spark, sf_dir, "benchmark")
    wrap = F.concat(F.lit("<transliteration>"), "text", F.lit("</transliteration>"))
    answers = items.select(
        "item_id",
        F.lit(0).alias("chunk_index"),
        F.lit("transliterator").alias("stage"),
        wrap.alias("raw"),
    )
    flow = transliterate_flow(items, answers, RuleBook.default(), id_col="item_id")
    return flow.documents.select("item_id", F.md5("output").alias("output_hash"))


# --- keyed state, batch -------------------------------------------------------------------------


def _bucket_sql(capacity: int, refill: int) -> str:
    width = refill * 1_000_000
    return f"""
    with recursive e as (select user_id, event_id, epoch_us(ts) as s,
        row_number() over (partition by user_id order by ts, event_id) as rn from events),
    b as (
      select user_id, event_id, s, rn, cast({(capacity - 1) * width} as bigint) as level,
        true as allowed, cast({capacity - 1} as bigint) as remaining, cast(0 as bigint) as retry_after_seconds
      from e where rn = 1
      union all
      select user_id, event_id, s, rn, case when l >= {width} then l - {width} else l end, l >= {width},
        case when l >= {width} then (l - {width}) // {width} else 0 end,
        case when l >= {width} then 0 else ({width} - l + 999999) // 1000000 end
      from (select e.*, least({capacity * width}, b.level + e.s - b.s) as l
            from b join e on e.user_id = b.user_id and e.rn = b.rn + 1))
    select user_id, event_id, allowed, remaining, retry_after_seconds from b
    """


BUCKET = {"key_col": "user_id", "id_col": "event_id", "capacity": 2, "refill_seconds": 43_200}


@query("rate_limit", _bucket_sql(2, 43_200))
def _rate_limit(spark, sf_dir):
    out = state.rate_limit(load(spark, sf_dir, "events"), **BUCKET)
    return out.select("user_id", "event_id", "allowed", "remaining", "retry_after_seconds")


@query("rate_limit_single", _bucket_sql(1, 43_200))
def _rate_limit_single(spark, sf_dir):
    """One token: the passing times hang on each other; crowded cells are split too."""
    options = BUCKET | {"capacity": 1, "split_rows": 2}
    out = state.rate_limit(load(spark, sf_dir, "events"), **options)
    return out.select("user_id", "event_id", "allowed", "remaining", "retry_after_seconds")


@query("rate_limit_default", _bucket_sql(5, 60).replace("user_id", "event_type"))
def _rate_limit_default(spark, sf_dir):
    """The default bucket, with the few event types as keys that hold all rows."""
    out = state.rate_limit(load(spark, sf_dir, "events"), key_col="event_type", id_col="event_id", split_rows=1000)
    return out.select("event_type", "event_id", "allowed", "remaining", "retry_after_seconds")


PAGE_STATES_SQL = f"""
    {PE},
    n as (select *, row_number() over (partition by job_id, page_num order by ts, seq) as rn from page_events),
    m as (
      select job_id, page_num, cast(0 as bigint) as rn, 'pending' as status, cast(0 as bigint) as attempts,
        cast(null as varchar) as claimed_by, cast(null as timestamp) as claimed_at, cast(null as varchar) as error
      from n where rn = 1
      union all
      select n.job_id, n.page_num, n.rn,
        case n.event
          when 'claim' then case when m.status <> 'pending' then m.status when m.attempts >= 3 then 'ocr_failed' else 'ocr_running' end
          when 'done' then 'ocr_done'
          when 'error' then case when m.attempts >= 3 then 'ocr_failed' else 'pending' end
          else case when m.status = 'ocr_done' then m.status else 'pending' end end,
        case n.event
          when 'claim' then case when m.status = 'pending' and m.attempts < 3 then m.attempts + 1 else m.attempts end
          when 'retry' then case when m.status = 'ocr_done' then m.attempts else 0 end
          else m.attempts end,
        case n.event when 'claim' then case when m.status = 'pending' and m.attempts < 3 then n.worker else m.claimed_by end
          when 'error' then null else m.claimed_by end,
        case n.event when 'claim' then case when m.status = 'pending' and m.attempts < 3 then n.ts else m.claimed_at end
          when 'error' then null else m.claimed_at end,
        case n.event when 'done' then null when 'error' then n.error
          when 'retry' then case when m.status = 'ocr_done' then m.error end else m.error end
      from m join n on n.job_id = m.job_id and n.page_num = m.page_num and n.rn = m.rn + 1),
    last as (select job_id, page_num, max(rn) as rn from m group by job_id, page_num),
    ps as (select m.* from m join last l on l.job_id = m.job_id and l.page_num = m.page_num and l.rn = m.rn)
"""
_STATE_COLS = f"""job_id, page_num::bigint as page_num, status, attempts, claimed_by,
    {ts_text('claimed_at')} as claimed_at, error"""


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.page_states(standin(spark, sf_dir, "page_events"))


@query("page_states", f"with recursive {PAGE_STATES_SQL} select {_STATE_COLS} from ps")
def _page_states(spark, sf_dir):
    return _states(spark, sf_dir)


_EXHAUSTED_SQL = f"""
    with recursive {PAGE_STATES_SQL},
    x as (select job_id, min(page_num) as page_num, arg_min(error, page_num) as error from ps
          where status = 'ocr_failed' and attempts >= 3 group by job_id)
    select job_id, page_num::bigint as page_num, 'failed' as status,
      'Page ' || page_num || ' OCR failed after 3 attempts: ' || coalesce(left(error, 200), '') as error from x
"""


@query("exhausted_jobs", _EXHAUSTED_SQL)
def _exhausted(spark, sf_dir):
    return state.exhausted_jobs(_states(spark, sf_dir))


@query(
    "stale_claims",
    f"""
    with recursive {PAGE_STATES_SQL},
    t as (select *, status = 'ocr_running' and claimed_at < timestamp '2024-01-30 12:00:00' - interval '600' second as stale from ps)
    select job_id, page_num::bigint as page_num, case when stale then 'pending' else status end as status,
      case when not stale then claimed_by end as claimed_by from t
    """,
)
def _stale(spark, sf_dir):
    as_of = F.lit("2024-01-30 12:00:00").cast("timestamp")
    freed = state.stale_claims(_states(spark, sf_dir), as_of)
    return freed.select("job_id", "page_num", "status", "claimed_by")


_DONE_SQL = f"""
    with {PE} select job_id, count(distinct page_num) as pages_completed from page_events
    where event = 'done' group by job_id
"""


@query("completion_counter", _DONE_SQL)
def _completion(spark, sf_dir):
    events = standin(spark, sf_dir, "page_events")
    return transitions.completed_pages(events.filter(F.col("event") == "done"))


def _last(field: str) -> str:
    return f"last({field} order by ts, seq) filter (where {field} is not null)"


_PROGRESS_SQL = f"""
    with {PU} select job_id, stage, {_last('status')} as status, {_last('completed')}::bigint as completed,
      {_last('total')}::bigint as total, {_last('chunk_count')}::bigint as chunk_count,
      {_last('total_fixes')}::bigint as total_fixes
    from progress_updates group by job_id, stage
"""


@query("progress_merge", _PROGRESS_SQL)
def _progress(spark, sf_dir):
    return state.merge_progress(standin(spark, sf_dir, "progress_updates"))


_LIVE_SQL = f"""
    with r as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events)
    select user_id, event_id, event_type, {ts_text('ts')} as ts from r where rn = 1
"""


@query("live_view", _LIVE_SQL)
def _live(spark, sf_dir):
    events = load(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return state.live_view(events, "user_id", ["ts", "event_id"])


# --- keyed state, stream --------------------------------------------------------------------------


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = load(spark, sf_dir, "events").schema
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", "events.parquet")
        .option("maxFilesPerTrigger", 1)
        .parquet(sf_dir)
    )


def _page_event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_events(_event_stream(spark, sf_dir))


def _page_events(events: DataFrame) -> DataFrame:
    kinds = {"purchase": "done", "error": "error", "signup": "retry"}
    kind = F.lit("claim")
    for name, event in kinds.items():
        kind = F.when(F.col("event_type") == name, event).otherwise(kind)
    n = F.col("event_id").cast("string")
    return events.select(
        F.concat(F.lit("job-"), F.col("user_id").cast("string")).alias("job_id"),
        (F.floor("value") % 3).cast("int").alias("page_num"),
        kind.alias("event"),
        F.concat(F.lit("worker-"), (F.col("event_id") % 4).cast("string")).alias("worker"),
        F.when(kind == "error", F.concat(F.lit("failure "), n)).alias("error"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
    )


def run_to_table(stream: DataFrame, mode: str = "update") -> DataFrame:
    """Run a stream over what is there now; every batch's rows are kept with its number."""
    spark = stream.sparkSession
    folder = scratch_path(spark, "folioforge-stream")

    def write(batch: DataFrame, batch_id: int) -> None:
        numbered = batch.withColumn("batch_id", F.lit(batch_id).cast("long"))
        numbered.write.mode("overwrite").parquet(f"{folder}/out/run={batch_id}")

    with pages.stream_settings(spark, until_read=True):
        run = (
            stream.writeStream.outputMode(mode)
            .foreachBatch(write)
            .option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        run.awaitTermination()
    return spark.read.parquet(f"{folder}/out").drop("run")


@query("live_view_stream", _LIVE_SQL)
def _live_stream(spark, sf_dir):
    events = _event_stream(spark, sf_dir).select("user_id", "event_id", "event_type", "ts")
    out = run_to_table(live.live_view_stream(events, "user_id", ["ts", "event_id"]))
    return state.latest_by_key(out, "user_id", ["batch_id"]).drop("batch_id")


@query("progress_stream", _PROGRESS_SQL)
def _progress_stream(spark, sf_dir):
    n, whole = F.floor("value"), F.floor("value").cast("int")
    updates = _event_stream(spark, sf_dir).select(
        F.col("user_id").alias("job_id"),
        F.col("event_type").alias("stage"),
        F.when(F.col("value") < 10, "done").when(F.col("value") < 40, "running").alias("status"),
        F.when(n % 2 == 0, whole).alias("completed"),
        F.when(n % 3 == 0, whole).alias("total"),
        F.when(n % 5 == 0, whole).alias("chunk_count"),
        F.when(n % 7 == 0, whole).alias("total_fixes"),
        "ts",
        F.col("event_id").alias("seq"),
    )
    out = run_to_table(live.progress_stream(updates))
    newest = F.max_by(F.struct(*[c for c in out.columns if c not in ("job_id", "stage")]), "batch_id")
    latest = out.groupBy("job_id", "stage").agg(newest.alias("r"))
    return latest.select("job_id", "stage", "r.*").drop("batch_id")


@query("completion_stream", _DONE_SQL)
def _completion_stream(spark, sf_dir):
    done = live.completion_stream(_page_event_stream(spark, sf_dir))
    return transitions.completed_pages(run_to_table(done, "append"))


@query("rate_limit_stream", _bucket_sql(2, 43_200))
def _rate_limit_stream(spark, sf_dir):
    events = _event_stream(spark, sf_dir).select("user_id", "event_id", "ts")
    out = run_to_table(live.rate_limit_stream(events, **BUCKET), "append")
    return out.select("user_id", "event_id", "allowed", "remaining", "retry_after_seconds")


_AGES = 10 * 365 * 86_400


@query("page_states_stream", f"with recursive {PAGE_STATES_SQL} select {_STATE_COLS} from ps")
def _page_states_stream(spark, sf_dir):
    """With a time-out longer than the data, so that the result equals the batch fold."""
    states = pages.page_state_stream(_page_event_stream(spark, sf_dir), stale_seconds=_AGES)
    return pages.newest_states(run_to_table(states))


def _late_page_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of page events in four instalments by time, every seventh event one
    instalment (a quarter of the whole time) too late."""
    folder = f"{scratch_path(spark, "folioforge-stream")}/in"
    events = load(spark, sf_dir, "events")
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    first, last = events.agg(F.min(seconds), F.max(seconds)).first()
    span = F.lit(max((last or 0) - (first or 0), 0) + 1)
    turn = F.floor((seconds - F.lit(first or 0)) * 4 / span) + (F.col("event_id") % 7 == 0).cast("int")
    for i in range(5):
        events.where(turn == i).write.mode("append").parquet(folder)
    return _page_events(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(folder))


@query("page_states_late_stream", f"with recursive {PAGE_STATES_SQL} select {_STATE_COLS} from ps")
def _page_states_late_stream(spark, sf_dir):
    """Late events: the states end up as if all had come in order."""
    states = pages.page_state_stream(_late_page_events(spark, sf_dir), stale_seconds=_AGES)
    return pages.newest_states(run_to_table(states))


@query("job_failures_stream", _EXHAUSTED_SQL)
def _job_failures_stream(spark, sf_dir):
    """Page states and job failures as two chained stateful operators, with late events."""
    states = pages.page_state_stream(_late_page_events(spark, sf_dir), stale_seconds=_AGES, output_mode="append")
    told = run_to_table(pages.job_failure_stream(states), "append")
    newest = told.groupBy("job_id").agg(F.max_by(F.struct("page_num", "status", "error"), "batch_id").alias("j"))
    return newest.select("job_id", "j.*").where("status = 'failed'")
