"""Queries over derived texts that make every default rule and every strategy fire.

The given documents hold few of the things the house rules look for, so each text here
is a whole document with lines added, chosen by its id: phrases of the rules, dates,
quotes, verse, Indic script, headings and contents lists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import has_valid_script, is_ocr_refusal, script_ratio
from ..operators.audit import corrections_log, idempotency_check, qa_summary
from ..operators.chapters import detect_chapters
from ..operators.chunk import chunk_documents
from ..operators.enforce import apply_mixed, enforce
from ..operators.rules import DATE_RULES, DIACRITIC_LABEL, DIACRITIC_MAP, FunctionRule, Rule, RuleBook
from ..operators.sections import parse_sections
from .registry import query
from .standins import load
from .text_queries import (
    PAGE_TEXT_SQL,
    chunks_sql,
    curl,
    marks,
    page_texts,
    plain_letters,
    rule_count_sql,
    rule_sql,
    sections_sql,
    tidy,
    trim,
    words,
)

WORDING = RuleBook.default().wording
SPREAD = 12


def _phrase_lines() -> list[str]:
    """One text per class of documents: its share of the rules' phrases in three spellings,
    then a line for the steps that are not rules."""
    others = [
        "on January 5, 1837 and on March 12,1901 the rain came",
        "he said 'come in' to them",
        "one word—and another  —  word",
        "Ātmā prāṇī sūtra ṣaṭkona ñ",
        'she said "well" and "so',
        "it it seems seems late",
        "  the third   day",
    ]
    out = []
    for n in range(SPREAD):
        phrases = [r.phrase for i, r in enumerate(WORDING) if i % SPREAD == n]
        said = [f"the {p} and {p[0].upper()}{p[1:]}, {p.upper()}" for p in phrases]
        out.append("; ".join(said) + f"\n{others[n % len(others)]}\n")
    return out


PHRASES = _phrase_lines()


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


STYLED_SQL = (
    f"styled as (select doc_id, lang, ([{', '.join(map(_sql_text, PHRASES))}])[1 + doc_id % {SPREAD}] || text as text"
    " from documents)"
)


def styled(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = F.get(F.array(*[F.lit(p) for p in PHRASES]), (F.col("doc_id") % SPREAD).cast("int"))
    return load(spark, sf_dir, "documents").select("doc_id", "lang", F.concat(added, "text").alias("text"))


# --- every default rule ----------------------------------------------------------------

_MONTH = DATE_RULES[0].phrase.split("(")[2].split(")")[0]
_DATE = f"\\b({_MONTH})\\s+([0-9]{{1,2}}),\\s*([0-9]{{4}})\\b"


def _date_sql(x: str) -> str:
    return f"regexp_replace({x}, '{_DATE}', '\\2 \\1 \\3', 'g')"


def _house_sql(x: str) -> str:
    for rule in WORDING:
        x = rule_sql(x, rule)
    return plain_letters(marks(_date_sql(tidy(x))))


@query(
    "house_rules_text",
    f"with {STYLED_SQL} select doc_id, md5({_house_sql('text')}) as text_hash from styled",
)
def _house_text(spark, sf_dir):
    return enforce(styled(spark, sf_dir)).select("doc_id", F.md5("text").alias("text_hash"))


def _first_hit_sql(x: str, rule: Rule) -> str:
    return f"regexp_extract({x}, '\\b{rule.phrase}\\b', 0, '{'i' if rule.ignore_case else 'c'}')"


def _house_log() -> str:
    """CTEs w0…wN with the text around every rule, and ``log`` with every correction."""
    ctes = [STYLED_SQL, "w0 as (select doc_id, lang, text as t from styled)"]
    rows = []

    def log(table: str, at: int, source: str, target: str, label: str, n: str) -> None:
        rows.append(
            f"select doc_id, lang, {at} as place, {source} as \"from\", {target} as \"to\", "
            f"{_sql_text(label)} as rule, {n} as count from {table} where {n} > 0"
        )

    for i, rule in enumerate(WORDING):
        first = _first_hit_sql("t", rule)
        log(f"w{i}", i, first, rule_sql(first, rule), rule.label, rule_count_sql("t", rule))
        ctes.append(f"w{i + 1} as materialized (select doc_id, lang, {rule_sql('t', rule)} as t from w{i})")
    at = len(WORDING)
    ctes.append(f"tidied as materialized (select doc_id, lang, {tidy('t')} as t from w{at})")
    first = f"regexp_extract(t, '{_DATE}')"
    log("tidied", at, first, _date_sql(first), DATE_RULES[0].label, f"len(regexp_extract_all(t, '{_DATE}'))")
    ctes.append(f"dated as materialized (select doc_id, lang, {_date_sql('t')} as t from tidied)")
    log("dated", at + 1, "'\"'", "'“/”'", "straight quotes→curly quotes", "(length(t) - length(replace(t, '\"', '')))")
    ctes.append(f"curled as materialized (select doc_id, lang, {curl('t')} as t from dated)")
    single = "regexp_replace(t, '''([^'']{2,})''', '‘\\1’', 'g')"
    log("curled", at + 2, "'''x'''", "'‘x’'", "straight single quotes→curly", f"cast({single} <> t as int)")
    ctes.append(f"quoted as materialized (select doc_id, lang, {single} as t from curled)")
    dashed = "regexp_replace(replace(t, '—', ' – '), ' {2,}– {2,}', ' – ', 'g')"
    rows.append(
        f"select doc_id, lang, {at + 3}, '—', ' – ', 'em dash→spaced en dash', "
        f"length(t) - length(replace(t, '—', '')) from quoted where {dashed} <> t"
    )
    ctes.append(f"dashes as materialized (select doc_id, lang, {dashed} as t from quoted)")
    for j, (mark, plain) in enumerate(DIACRITIC_MAP):
        n = f"(length(t) - length(replace(t, '{mark}', '')))"
        log("dashes", at + 4 + j, f"'{mark}'", f"'{plain}'", DIACRITIC_LABEL, n)
    ctes.append(f"log as ({' union all '.join(rows)})")
    return ",\n".join(ctes)


HOUSE_LOG_SQL = _house_log()


@query(
    "house_rules_log",
    f"""
    with {HOUSE_LOG_SQL}
    select doc_id, row_number() over (partition by doc_id order by place) - 1 as seq, "from", "to", rule,
      cast(count as bigint) as count from log
    """,
)
def _house_corrections(spark, sf_dir):
    """Every correction with its first sample, what became of it, and its place."""
    return corrections_log(enforce(styled(spark, sf_dir), audit=True))


# every category of the summary, the places and names among them
_CATEGORY = """case when contains(l, 'diacritics') then 'Diacritics' when contains(l, 'forbidden') then 'Forbidden Vocab'
    when contains(l, 'hedging') then 'Hedging' when regexp_matches(l, 'quotes|dash') then 'Punctuation'
    when contains(l, 'date') then 'Date Format'
    when regexp_matches(l, 'province|pipalana|chanasad|bamangaon|dholiya|dungara|bhadarod|chokshi|saurashtra') then 'Place Names'
    when regexp_matches(l, 'bhilalbhai|narayanda|naranda') then 'Historical Names' else 'Terminology' end"""


@query(
    "house_rules_summary",
    f"""
    with {HOUSE_LOG_SQL},
    named as (select lang, count, lower(rule) as l, {_CATEGORY} as category from log)
    select lang, category, cast(sum(count) as bigint) as fixes, count(*) as entries,
      cast(list_position(['Terminology', 'Forbidden Vocab', 'Hedging', 'Historical Names', 'Place Names',
        'Date Format', 'Punctuation', 'Diacritics', 'Other'], category) as bigint) as category_rank
    from named group by lang, category
    """,
)
def _house_summary(spark, sf_dir):
    audited = enforce(styled(spark, sf_dir), audit=True)
    return qa_summary(corrections_log(audited, id_cols=["doc_id", "lang"]), by=["lang"])


@query(
    "house_rules_repeat",
    f"""
    with {STYLED_SQL},
    a as materialized (select doc_id, {_house_sql('text')} as once from styled),
    b as (select doc_id, once, {_house_sql('once')} as twice from a)
    select doc_id, md5(once) as once, md5(twice) as twice from b where once <> twice
    """,
)
def _house_repeat(spark, sf_dir):
    """Documents that a second run changes again (a removed hedge can close up to another)."""
    changed = idempotency_check(styled(spark, sf_dir))
    return changed.select("doc_id", F.md5("once").alias("once"), F.md5("twice").alias("twice"))


# --- script tests, verse -----------------------------------------------------------------


def _share_sql(chars: str) -> str:
    return f"((length(text) - length(regexp_replace(text, '[{chars}]', '', 'g')))::double / length(text))"


_GUJARATI, _INDIC = "\\x{0A80}-\\x{0AFF}", "\\x{0A80}-\\x{0AFF}\\x{0900}-\\x{097F}"


@query(
    "script_tests_mixed",
    f"""
    with s as (select doc_id, repeat('ક', cast(length(text) * (doc_id % 5) // 40 as int))
                 || repeat('न', cast(length(text) * (doc_id % 3) // 50 as int)) || text as text from documents)
    select doc_id, {_share_sql(_INDIC)} as indic_ratio,
      length(text) > 50 and {_share_sql(_INDIC)} > 0.05 as valid_script,
      {_share_sql(_GUJARATI)} < 0.05 as refusal
    from s where length(text) > 0
    """,
)
def _scripts(spark, sf_dir):
    """Documents with none to some fifth of their text in Gujarati and Devanagari letters."""
    n = F.length("text")
    mixed = F.concat(
        F.repeat(F.lit("ક"), F.floor(n * (F.col("doc_id") % 5) / 40).cast("int")),
        F.repeat(F.lit("न"), F.floor(n * (F.col("doc_id") % 3) / 50).cast("int")),
        F.col("text"),
    )
    docs = load(spark, sf_dir, "documents").where(n > 0).select("doc_id", mixed.alias("text"))
    return docs.select(
        "doc_id",
        script_ratio("text").alias("indic_ratio"),
        has_valid_script("text").alias("valid_script"),
        is_ocr_refusal("text").alias("refusal"),
    )


VERSE = "“ātmā jāgo re”\n“bhajo āja re”"


@query(
    "chunks_with_verses",
    f"""
    with recursive versed as (
      select doc_id, replace(text, chr(10), E'\\n\\n' || {_sql_text(VERSE)} || E'\\n\\n') as text from documents),
    {chunks_sql('versed')}
    select doc_id, cast(chunk_index as bigint) as chunk_index, cast(chunk_count as bigint) as chunk_count,
      md5(text) as text_hash, {words('text')} as words
    from z
    """,
)
def _verse_chunks(spark, sf_dir):
    """A verse between all lines: no cut may part it from the prose around it."""
    docs = load(spark, sf_dir, "documents").select(
        "doc_id", F.replace("text", F.lit("\n"), F.lit(f"\n\n{VERSE}\n\n")).alias("text")
    )
    return chunk_documents(docs).select(
        "doc_id", "chunk_index", "chunk_count", F.md5("text").alias("text_hash"), "words"
    )


@query(
    "sections_with_meanings",
    f"""
    with raw as (select page_id, {PAGE_TEXT_SQL} as text from pages),
    t as (select page_id, replace(text, E'\\n\\n', E'\\n\\n' || {_sql_text(VERSE)} || E'\\n(page ' || page_id || E')\\n\\n') as text from raw),
    {sections_sql()}
    select page_id, cast(index as bigint) as index, case when verse then 'verse' else 'prose' end as type,
      md5(content) as content_hash,
      case when verse and len(roman) > 0 then md5(array_to_string(roman, chr(10))) end as roman_hash,
      case when verse and len(meanings) > 0 then regexp_extract(meanings[-1], '^\\((.+)\\)$', 1) end as meaning
    from m
    """,
)
def _meanings(spark, sf_dir):
    glossed = F.concat(F.lit(f"\n\n{VERSE}\n(page "), F.col("page_id"), F.lit(")\n\n"))
    texts = page_texts(spark, sf_dir).select("page_id", F.replace("text", F.lit("\n\n"), glossed).alias("text"))
    return parse_sections(texts, id_col="page_id").select(
        "page_id",
        "index",
        "type",
        F.md5("content").alias("content_hash"),
        F.md5("transliteration").alias("roman_hash"),
        "meaning",
    )


# --- chapters by every strategy --------------------------------------------------------------

#: Every word of the document is a line of its own (w), so that chapters are long enough.
_LAYOUTS = {
    "marker": "=== Chapter: opening of {s} ===\n{w}\n=== CHAPTER:  middle ===\n{w}\n===chapter: end===\n{w}",
    "toc": (
        "Contents\n1.\tOpening of {s}\t1\n2.\tMiddle part of the whole…3\n3.\tEnd of {s}\n\n\n\n\n\n"
        "Opening of {s}\n{w}\n\nMiddle part of the whole text\n{w}\n\nEnd of {s}\n{w}"
    ),
    "number": "Chapter 1: Opening\n{w}\n2. Middle of {s}\n{w}\nChapter 3\n{w}\n4) End of {s}\n{w}",
}


def _laid_out_sql(layout: str) -> str:
    word_lines = "replace(text, ' ', chr(10))"
    return f"replace(replace({_sql_text(layout)}, '{{s}}', source), '{{w}}', {word_lines})"


def _laid_out(layout: str):
    word_lines = F.replace("text", F.lit(" "), F.lit("\n"))
    return F.replace(F.replace(F.lit(layout), F.lit("{s}"), F.col("source")), F.lit("{w}"), word_lines)


_BLANK_LINES_SQL = "replace(text, chr(10), E'\\n\\n')"


def _strategy_sql() -> str:
    """CTEs for a table ``x`` (doc_id, text): ``by_marker``, ``by_toc``, ``by_number`` with
    (doc_id, start_line, title), each for the documents in which the strategy finds chapters."""
    return f"""
    ls as materialized (select doc_id, string_split(text, chr(10)) as ls from x),
    ln as materialized (select doc_id, least(50, floor(len(ls) * 0.05)) as skip,
             unnest(list_transform(ls, lambda l: {trim('l')})) as s, unnest(range(len(ls))) as i from ls),
    m1 as (select doc_id, i as start_line, regexp_extract(s, '(?i)^===\\s*CHAPTER:\\s*(.+?)\\s*===$', 1) as title
           from ln where i >= skip and regexp_matches(s, '(?i)^===\\s*CHAPTER:\\s*(.+?)\\s*===$')),
    by_marker as (select * from m1 qualify count(*) over (partition by doc_id) > 1),
    n1 as (select doc_id, i as start_line, s,
             {trim("regexp_replace(s, '(?i)^(?:chapter\\s+[0-9]+(?:[:.]|\\s)|[0-9]{1,2}[.)]\\s*)', '')")} as rest
           from ln where i >= skip and {words('s')} <= 12
             and regexp_matches(s, '(?i)^(?:chapter\\s+[0-9]+(?::|\\s)|[0-9]{{1,2}}[.)]\\s)')),
    by_number as (select doc_id, start_line, case when rest = '' then s else rest end as title from n1
      window d as (partition by doc_id)
      qualify count(*) over d > 1 and (max(start_line) over d - min(start_line) over d) / count(*) over d > 30),
    t1 as (select doc_id, i, {trim("regexp_extract(s, '^[0-9]{1,2}\\.\\t(.+)', 1)")} as title from ln
           where regexp_matches(s, '^[0-9]{{1,2}}\\.\\t(.+)') and i < 8),
    t2 as (select doc_id, i, array_to_string(regexp_split_to_array({trim("regexp_replace(title, '[\\t0-9.…]+$', '')")}, '\\s+')[1:4], ' ') as needle,
             max(i) over (partition by doc_id) + 5 as body_from from t1 qualify count(*) over (partition by doc_id) >= 3),
    t3 as (select doc_id, i, s, lag(s) over (partition by doc_id order by i) as above from ln),
    t4 as (select t2.doc_id, t2.i as entry, min_by(t3.s, t3.i) as title, min(t3.i) as start_line
           from t2 join t3 on t3.doc_id = t2.doc_id and t3.i >= body_from and t3.s <> '' and above = ''
             and contains(t3.s, needle) and len(string_split_regex(t3.s, '\\s+')) <= 15
           where length(needle) >= 3 group by t2.doc_id, t2.i),
    by_toc as (select doc_id, start_line, title from t4
      window d as (partition by doc_id),
        e as (partition by doc_id order by entry rows between unbounded preceding and unbounded following)
      qualify count(*) over d >= 3 and (last_value(start_line) over e - first_value(start_line) over e) / count(*) over d > 20)
    """


def _one_strategy(name: str) -> str:
    return f"""
    with x as (select doc_id, {_laid_out_sql(_LAYOUTS[name])} as text from documents),
    {_strategy_sql()}
    select doc_id, '{name}' as strategy, row_number() over (partition by doc_id order by start_line) - 1 as chapter_index,
      title, cast(start_line as bigint) as start_line from by_{name}
    """


@query("chapters_by_toc", _one_strategy("toc"))
def _toc(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", _laid_out(_LAYOUTS["toc"]).alias("text"))
    return detect_chapters(docs, strategies=("toc",))


@query("chapters_by_number", _one_strategy("number"))
def _number(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", _laid_out(_LAYOUTS["number"]).alias("text"))
    return detect_chapters(docs, strategies=("number",))


@query(
    "chapters_detected",
    f"""
    with recursive x as (
      select doc_id, case doc_id % 4 when 0 then {_laid_out_sql(_LAYOUTS['marker'])} when 1 then {_laid_out_sql(_LAYOUTS['toc'])}
        when 2 then {_laid_out_sql(_LAYOUTS['number'])} else {_BLANK_LINES_SQL} end as text from documents),
    {_strategy_sql()},
    headed as (select 'marker' as strategy, 1 as rank, * from by_marker
      union all select 'toc', 2, * from by_toc union all select 'number', 3, * from by_number),
    best as (select * from headed qualify rank = min(rank) over (partition by doc_id)),
    w as (select doc_id, len(ls) as n, cast(least(50, floor(len(ls) * 0.05)) as bigint) as skip,
            list_transform(ls, lambda l: {words('l')}) as ws from ls anti join best using (doc_id)),
    f as (
      select doc_id, n, ws, skip as i, cast(0 as bigint) as total, [skip] as starts from w where list_sum(ws) >= 200
      union all
      select doc_id, n, ws, case when cut > 0 then cut else i + 1 end, case when cut > 0 then 0 else total end,
        case when cut > 0 then list_append(starts, cut) else starts end
      from (select *, case when total >= 200 and gap > 0 and i + gap < n then i + gap else 0 end as cut
            from (select doc_id, n, ws, i, starts, cast(total + ws[i + 1] as bigint) as total,
                    coalesce(list_position(ws[i + 1 : i + 20], 0), 0) as gap from f where i < n))),
    e as (select doc_id, starts from f where i >= n and len(starts) > 1),
    u as (select doc_id, unnest(starts) as start_line, unnest(range(1, len(starts) + 1)) as k from e)
    select doc_id, strategy, row_number() over (partition by doc_id order by start_line) - 1 as chapter_index, title,
      cast(start_line as bigint) as start_line from best
    union all
    select doc_id, 'words', k - 1, 'Section ' || k, cast(start_line as bigint) from u
    """,
)
def _all_strategies(spark, sf_dir):
    """A quarter of the documents in each layout; each strategy wins somewhere, and short
    documents fall through to a later one or to none."""
    layout = (
        F.when(F.col("doc_id") % 4 == 0, _laid_out(_LAYOUTS["marker"]))
        .when(F.col("doc_id") % 4 == 1, _laid_out(_LAYOUTS["toc"]))
        .when(F.col("doc_id") % 4 == 2, _laid_out(_LAYOUTS["number"]))
        .otherwise(F.replace("text", F.lit("\n"), F.lit("\n\n")))
    )
    docs = load(spark, sf_dir, "documents").select("doc_id", layout.alias("text"))
    return detect_chapters(docs, target_words=200)


# --- function rules between pattern rules ------------------------------------------------

_MIXED_BOOK = RuleBook.of(
    Rule("the", "chapter 12", "the→chapter 12"),
    FunctionRule("[0-9]", lambda digit: str(9 - int(digit)), "digit→nine's complement"),
    Rule("chapter 87", "part", "chapter 87→part"),
    FunctionRule("[xX]+", lambda run: f"[{len(run)}]", "x→its length"),
)
_MIXED_SQL = r"""
    m0 as (select doc_id, coalesce(text, '') as t from documents),
    m1 as (select doc_id, t as t0, regexp_replace(t, '(?i)\bthe\b', 'chapter 12', 'g') as t from m0),
    m2 as (select doc_id, t0, t as t1, translate(t, '0123456789', '9876543210') as t from m1),
    m3 as (select doc_id, t0, t1, t as t2, regexp_replace(t, '(?i)\bchapter 87\b', 'part', 'g') as t from m2),
    mx as (select doc_id, list(len(x) order by i) as runs from (
        select doc_id, unnest(regexp_extract_all(t, '[xX]+')) as x, generate_subscripts(regexp_extract_all(t, '[xX]+'), 1) as i
        from m3) group by doc_id),
    ml as (
      select doc_id, 0 as place, regexp_extract(t0, '(?i)\bthe\b') as "from", 'chapter 12' as "to", 'the→chapter 12' as rule,
        len(regexp_extract_all(t0, '(?i)\bthe\b')) as count from m3
      union all select doc_id, 1, regexp_extract(t1, '[0-9]'), translate(regexp_extract(t1, '[0-9]'), '0123456789', '9876543210'),
        'digit→nine''s complement', len(regexp_extract_all(t1, '[0-9]')) from m3
      union all select doc_id, 2, regexp_extract(t2, '(?i)\bchapter 87\b'), 'part', 'chapter 87→part',
        len(regexp_extract_all(t2, '(?i)\bchapter 87\b')) from m3
      union all select doc_id, 3, regexp_extract(t, '[xX]+'), '[' || runs[1] || ']', 'x→its length', len(runs) from m3 join mx using (doc_id))
"""


@query(
    "function_rules_log",
    f"""
    with {_MIXED_SQL}
    select doc_id, row_number() over (partition by doc_id order by place) - 1 as seq, "from", "to", rule, count
    from ml where count > 0
    """,
)
def _function_rules(spark, sf_dir):
    """Two pattern rules and two functions in turn: each sees what those before it made."""
    docs = load(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    listed = {r.label for r in _MIXED_BOOK.wording}
    logged = corrections_log(enforce(docs, _MIXED_BOOK, audit=True))
    return logged.where(F.col("rule").isin(sorted(listed)))


@query("function_rules_text", f"with {_MIXED_SQL} select doc_id, md5(t) as text_hash from m3")
def _function_rules_text(spark, sf_dir):
    """The text after a rule, a function and a rule that sees the function's result."""
    docs = load(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return apply_mixed(docs, "text", _MIXED_BOOK.wording[:3]).select("doc_id", F.md5("text").alias("text_hash"))
