"""Job, page, review and event tables derived from the given tables.

The driver's tables have no translation jobs; these views map orders, customers, line
items, events and conversations to the schemas of :mod:`folioforge.schemas`, row by row.
One SQL text serves Spark and the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STANDINS = {
    "translations": """
        select o_orderkey as translation_id,
               concat('u', o_custkey) as uid,
               concat('user', o_custkey, '@example.org') as email,
               o_orderpriority as chapter_title,
               case when o_orderstatus = 'P' then null else concat('book-', o_custkey) end as book_id,
               case when c_mktsegment = 'MACHINERY' then null else c_mktsegment end as book_title,
               cast(year(o_orderdate) as int) as chapter_index,
               cast(floor(o_totalprice) as int) as output_word_count,
               cast(floor(o_totalprice / 2) as int) as input_word_count,
               cast(floor(o_totalprice) % 5 as int) as flags_count,
               concat(o_orderpriority, ' of ', c_name, '. In ', c_mktsegment, '.') as output,
               c_name as input_preview,
               o_orderdate as created_at
        from {orders} join {customer} on o_custkey = c_custkey""",
    "translit_jobs": """
        select o_orderkey as job_id,
               concat('u', o_custkey) as uid,
               concat('user', o_custkey, '@example.org') as email,
               concat(c_name, '.pdf') as filename,
               cast(1 + o_custkey % 7 as int) as total_pages,
               cast(o_orderkey % 8 as int) as pages_completed,
               case when o_orderstatus = 'P' then 'pending'
                    when o_orderstatus = 'F' and o_orderpriority = '1-URGENT' then 'failed'
                    when o_orderstatus = 'F' and o_orderpriority = '2-HIGH' then 'cancelled'
                    when o_orderstatus = 'F' then 'done'
                    when o_orderpriority = '1-URGENT' then 'assembling'
                    when o_orderpriority = '2-HIGH' then 'transliterating'
                    else 'ocr_running' end as status,
               o_orderdate as created_at,
               case when o_orderstatus <> 'P' then o_orderdate + interval '1' day end as started_at,
               case when o_orderstatus = 'F' then o_orderdate + interval '3' day end as completed_at,
               cast(null as timestamp) as updated_at,
               case when o_orderstatus = 'F' and o_orderpriority = '1-URGENT' then 'Page 1 failed' end as error,
               case when o_orderpriority = '5-LOW' then 'slow' end as note,
               o_orderstatus = 'F' as translate_requested,
               case when o_orderpriority = '3-MEDIUM' then 'pending' else 'idle' end as translation_status,
               case when o_orderpriority = '5-LOW' then 'cloud' else 'local' end as mode
        from {orders} join {customer} on o_custkey = c_custkey""",
    "jobs": """
        select o_orderkey as job_id,
               concat('u', o_custkey) as uid,
               concat('user', o_custkey, '@example.org') as email,
               case when o_orderstatus = 'P' then 'pending' when o_orderstatus = 'O' then 'running'
                    when o_orderpriority = '1-URGENT' then 'failed' else 'completed' end as status,
               case when o_orderpriority = '5-LOW' then 'cloud' else 'local' end as mode,
               o_orderdate as created_at,
               case when o_orderstatus <> 'P' then o_orderdate + interval '1' day end as started_at,
               case when o_orderstatus = 'F' and o_orderpriority <> '1-URGENT'
                    then o_orderdate + interval '3' day end as completed_at,
               case when o_orderpriority = '1-URGENT' then 'broken' end as error,
               cast(null as varchar(100)) as note
        from {orders}""",
    "job_pages": """
        select l_orderkey as job_id,
               l_linenumber as page_num,
               case when max(l_returnflag) = 'R' then 'ocr_failed'
                    when max(l_returnflag) = 'N' and max(l_linestatus) = 'O' then 'ocr_running'
                    when max(l_returnflag) = 'N' then 'pending'
                    else 'ocr_done' end as status,
               cast(max(l_quantity) % 4 as int) as attempts,
               case when max(l_returnflag) = 'N' then 'worker-1' end as claimed_by,
               case when max(l_returnflag) = 'N' then max(l_shipdate) end as claimed_at,
               concat('Page ', l_linenumber, ' holds ', cast(max(l_quantity) as int), ' lines.') as source_text,
               case when max(l_linestatus) = 'F' then concat('page ', l_linenumber) end as transliterated_text,
               case when max(l_returnflag) = 'R' then concat('bad scan ', l_linenumber) end as error,
               cast(null as timestamp) as retry_requested_at,
               cast(null as varchar(100)) as retry_requested_by
        from {lineitem} group by l_orderkey, l_linenumber""",
    "reviews": """
        select conv_id as translation_id,
               turn as review_id,
               role as uid,
               concat(role, '@example.org') as email,
               case when role = 'assistant' then 'Helper' end as display_name,
               text as comment,
               cast(floor(turn / 2) as int) as section_index,
               turn as created_at
        from {conversations}""",
    "page_events": """
        select concat('job-', user_id) as job_id,
               cast(floor(value) % 3 as int) as page_num,
               case when event_type = 'purchase' then 'done' when event_type = 'error' then 'error'
                    when event_type = 'signup' then 'retry' else 'claim' end as event,
               concat('worker-', event_id % 4) as worker,
               case when event_type = 'error' then concat('failure ', event_id) end as error,
               ts, event_id as seq
        from {events}""",
    "progress_updates": """
        select user_id as job_id, event_type as stage,
               case when value < 10 then 'done' when value < 40 then 'running' end as status,
               case when floor(value) % 2 = 0 then cast(floor(value) as int) end as completed,
               case when floor(value) % 3 = 0 then cast(floor(value) as int) end as total,
               case when floor(value) % 5 = 0 then cast(floor(value) as int) end as chunk_count,
               case when floor(value) % 7 = 0 then cast(floor(value) as int) end as total_fixes,
               ts, event_id as seq
        from {events}""",
}
SOURCES = ["orders", "customer", "lineitem", "conversations", "events"]


#: Session setting: into how many partitions a text table that is one small file is dealt.
#: Unset, as it should be for tables of many splits, tables are read as they lie.
SOURCE_PARTITIONS = "folioforge.source.partitions"
_TEXT_TABLES = {"documents": "doc_id", "pages": "page_id"}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    parts = spark.conf.get(SOURCE_PARTITIONS, None)
    if parts and table in _TEXT_TABLES:
        return df.repartition(int(parts), _TEXT_TABLES[table])
    return df


def standin(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = STANDINS[name]
    used = {t: load(spark, sf_dir, t) for t in SOURCES if "{" + t + "}" in sql}
    view = spark.sql(sql, **used)
    zoned = [
        F.col(f.name).cast("timestamp").alias(f.name)
        if isinstance(f.dataType, T.TimestampNTZType)
        else F.col(f.name)
        for f in view.schema.fields
    ]
    return view.select(*zoned)


def standin_sql(*names: str) -> str:
    """``with`` clause that defines the stand-ins for the oracle."""
    tables = {t: t for t in SOURCES}
    views = [f"{name} as ({STANDINS[name].format(**tables)})" for name in names]
    return ",\n".join(views)
