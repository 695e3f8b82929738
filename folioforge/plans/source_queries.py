"""Queries over sources that are written to files and read back, and over awkward answers.

The given tables are Parquet only, so each query first writes what it needs of them to the
shared folder in the form it reads: text files, JSON lines, change feeds, rule tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunk import chunk_documents
from ..operators.enforce import enforce
from ..operators.paging import clustered_page, write_in_page_order
from ..operators.rules import RuleBook, rules_from_table, rules_table
from ..session import scratch_path
from ..sources.readers import change_feed, read_json_table, read_table, read_text_corpus
from ..sources.snapshots import append_changes, feed_snapshot, snapshot
from .flows import translate_flow, transliterate_flow
from .job_queries import _PAGE_COLS
from .registry import ORACLES, query, ts_text
from .standins import load, standin
from .state_queries import PG, echo_model
from .styled_queries import styled
from .text_queries import chunks_sql, documents, marks, tidy, trim

# --- sources --------------------------------------------------------------------------------


@query("text_corpus", "select item_id, md5(text || chr(10)) as text_hash from benchmark where text is not null")
def _corpus(spark, sf_dir):
    """One text file per benchmark item; a written text ends with a line break."""
    folder = scratch_path(spark, "corpus")
    items = load(spark, sf_dir, "benchmark").select("item_id", "text").where("text is not null")
    items.write.partitionBy("item_id").text(folder)
    number = F.regexp_extract("doc_id", r"item_id=(\d+)/", 1).cast("bigint")
    return read_text_corpus(spark, folder).select(number.alias("item_id"), F.md5("text").alias("text_hash"))


#: Every ninth line lacks its end, every fifth has a field too many.
_LINE = """concat('{"event_id":', event_id, ',"user_id":', user_id, ',"kind":"', event_type, '"',
    case when event_id % 5 = 0 then ',"extra":[1]' else '' end, case when event_id % 9 = 0 then '' else '}' end)"""


def _json_events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    folder = scratch_path(spark, "lines")
    load(spark, sf_dir, "events").selectExpr(f"{_LINE} as value").write.text(folder)
    return read_json_table(spark, folder, "event_id bigint, user_id bigint, kind string, note string")


@query(
    "json_table",
    """
    select event_id, user_id, event_type as kind, cast(null as varchar) as note from events where event_id % 9 <> 0
    """,
)
def _json(spark, sf_dir):
    return _json_events(spark, sf_dir)[0]


@query("json_table_rejects", f"select {_LINE} as line from events where event_id % 9 = 0")
def _json_rejects(spark, sf_dir):
    return _json_events(spark, sf_dir)[1]


@query("typed_table", "select doc_id, lang, cast(null as varchar) as translator from documents")
def _typed(spark, sf_dir):
    """A declared column that the files lack comes back null."""
    return read_table(spark, f"{sf_dir}/documents.parquet", "doc_id bigint, lang string, translator string")


@query("house_rules_from_table", ORACLES["house_rules_text"])
def _rules_from_table(spark, sf_dir):
    """The default rules, kept as a table and loaded from there."""
    folder = scratch_path(spark, "rules")
    rules_table(spark, RuleBook.default()).write.parquet(folder)
    book = rules_from_table(spark.read.parquet(folder))
    return enforce(styled(spark, sf_dir), book).select("doc_id", F.md5("text").alias("text_hash"))


@query("snapshot_from_feed", ORACLES["live_view"])
def _snapshot(spark, sf_dir):
    """A feed in several batches, compacted on the way; then one batch comes again that the
    base holds, and one that no base has seen."""
    folder = scratch_path(spark, "feed")
    events = load(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    for i in range(4):
        part = events.where(F.pmod(F.xxhash64("event_id"), F.lit(4)) == i)
        part.write.mode("append").parquet(f"{folder}/in")
    one = max(1, len(spark.read.parquet(f"{folder}/in").inputFiles()) // 4)
    changes = change_feed(spark, f"{folder}/in", events.schema, fmt="parquet", files_per_batch=one)
    how = {"key": "user_id", "order": ["ts", "event_id"]}
    writer = feed_snapshot(changes, f"{folder}/view", compact_every=3, **how)
    writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    again = events.where(F.pmod(F.xxhash64("event_id"), F.lit(4)) == 0)
    for batch_id in (0, 1000, 1000):
        append_changes(again, f"{folder}/view", batch_id, **how)
    return snapshot(spark, f"{folder}/view", events.schema, **how)


@query("history_page_clustered", ORACLES["history_page_after_cursor"])
def _page_clustered(spark, sf_dir):
    """The page after translation 100, from a table that lies in page order."""
    folder, rows = scratch_path(spark, "pages"), standin(spark, sf_dir, "translations")
    write_in_page_order(rows, folder)
    at = rows.where("translation_id = 100").select("created_at").first()
    page = clustered_page(spark, folder, after=(at.created_at, 100) if at else None)
    return page.select(*[c.strip() for c in _PAGE_COLS.split(",")], "created_at", "next_cursor")


# --- answers ---------------------------------------------------------------------------------


def _block(tag: str, text: Column) -> Column:
    return F.concat(F.lit(f"<{tag}>"), text, F.lit(f"</{tag}>"))


def chatty_model(requests: DataFrame) -> DataFrame:
    """Talks around its answer, says it twice, or forgets its end on page 2 of every seventh job."""
    text = F.col("text")
    good = _block("transliteration", text)
    raw = (
        F.when((F.col("job_id") % 7 == 0) & (F.col("page_num") == 2), F.concat(F.lit("<transliteration>"), text))
        .when(F.col("page_num") % 4 == 1, F.concat(F.lit("Here it is: "), good, F.lit(" I hope that helps.")))
        .when(F.col("page_num") % 4 == 2, F.concat(good, F.lit("\n<transliteration>again</transliteration>")))
        .when(F.col("page_num") % 4 == 3, F.concat(F.lit("```xml\n"), good, F.lit("\n```")))
        .otherwise(good)
    )
    return requests.withColumn("raw", raw)


@query(
    "transliterate_flow_lenient",
    f"""
    with {PG} select job_id, md5(string_agg(source_text, E'\\n\\n' order by page_num)) as output_hash,
      count(*) as chunk_count from job_pages group by job_id
    having count(*) filter (where job_id % 7 = 0 and page_num = 2) = 0
    """,
)
def _lenient(spark, sf_dir):
    """By page, the first complete block of an answer counts; an answer without one fails its job."""
    pages = standin(spark, sf_dir, "job_pages").withColumnRenamed("source_text", "text")
    flow = transliterate_flow(pages, chatty_model, by="page", id_col="job_id")
    return flow.documents.select("job_id", F.md5("output").alias("output_hash"), "chunk_count")


@query("response_table_documents", ORACLES["transliterate_flow"])
def _response_documents(spark, sf_dir):
    """The answers to every chunk come from a table that holds each of them twice."""
    docs = documents(spark, sf_dir)
    chunks = chunk_documents(docs).select(
        "doc_id", "chunk_index", "text", F.lit("transliterator").alias("stage")
    )
    answers = echo_model(chunks).select("doc_id", "chunk_index", "stage", "raw")
    flow = transliterate_flow(docs, answers.unionByName(answers))
    return flow.documents.select("doc_id", F.md5("output").alias("output_hash"), "chunk_count")


def plain_smoother(requests: DataFrame) -> DataFrame:
    """Translates with macrons and smooths them away."""
    if "translated" in requests.columns:
        return requests.withColumn("raw", _block("smoothed", F.translate("translated", "āĀ", "aA")))
    translation = _block("translation", F.translate("text", "aA", "āĀ"))
    return requests.withColumn("raw", F.concat(translation, F.lit("<flags></flags>")))


def _light(x: str) -> str:
    return tidy(marks(x))


@query(
    "translate_flow_macrons",
    f"""
    with recursive {chunks_sql()},
    qb as (select doc_id, chunk_index, {_light(trim("translate(text, 'aA', 'āĀ')"))} as before from z),
    qd as (select doc_id, chunk_index, before, {trim("translate(before, 'āĀ', 'aA')")} as after from qb),
    ql as (select *, list_filter(string_split(before, chr(10)), lambda x: regexp_matches(x, '[Āā]')) as ls,
            length(regexp_replace(before, '[^Āā]', '', 'g')) as nb, length(regexp_replace(after, '[^Āā]', '', 'g')) as na
          from qd),
    qv as (select doc_id, chunk_index, unnest(ls) as line, unnest(range(1, len(ls) + 1)) as i from ql where nb > 0 and na < nb),
    qm as (
      select doc_id, chunk_index, cast(0 as bigint) as i, after as t, cast(0 as bigint) as restored from qd
      union all
      select m.doc_id, m.chunk_index, v.i,
        case when not contains(m.t, v.line) and contains(m.t, translate(v.line, 'āĀ', 'aA'))
          then left(m.t, strpos(m.t, translate(v.line, 'āĀ', 'aA')) - 1) || v.line
            || substr(m.t, strpos(m.t, translate(v.line, 'āĀ', 'aA')) + length(v.line)) else m.t end,
        case when not contains(m.t, v.line) and contains(m.t, translate(v.line, 'āĀ', 'aA'))
          then m.restored + length(regexp_replace(v.line, '[^Āā]', '', 'g')) else m.restored end
      from qm m join qv v on v.doc_id = m.doc_id and v.chunk_index = m.chunk_index and v.i = m.i + 1),
    qr as (select doc_id, chunk_index, arg_max(t, i) as t, cast(arg_max(restored, i) as bigint) as restored
          from qm group by doc_id, chunk_index)
    select doc_id, cast(chunk_index as bigint) as chunk_index, md5({_light('t')}) as text_hash, restored,
      case when restored > 0 then 'Smoother stripped ' || restored || ' macron' || case when restored = 1 then '' else 's' end
        || ' from verse transliteration' || case when restored = 1 then '' else 's' end
        || ' — auto-restored from translator output.' else '' end as flags
    from qr
    """,
)
def _macron_flow(spark, sf_dir):
    """Every macron is lost in smoothing and put back, and the chunk's flags say so."""
    flow = translate_flow(documents(spark, sf_dir), plain_smoother, profile="light")
    return flow.chunks.select(
        "doc_id",
        "chunk_index",
        F.md5("translation").alias("text_hash"),
        "restored",
        F.array_join("flags", "|").alias("flags"),
    )
