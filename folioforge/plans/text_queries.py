"""Queries over document text: metrics, enforcement, audit, chunks, sections, markup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.markup import markup_to_text, normalise_newlines
from ..functions.text import (
    charset_violations,
    estimated_chunks,
    explode_indexed,
    has_valid_script,
    is_book_mode,
    is_ocr_refusal,
    macron_count,
    preview,
    script_ratio,
    trimmed_lines,
    warn_long,
    word_count,
    word_count_raw,
)
from ..functions.verse import is_verse_block, is_verse_like, line_kind
from ..operators.audit import (
    corrections_log,
    idempotency_check,
    length_drift,
    qa_summary,
    top_rules,
)
from ..operators.chapters import detect_chapters, slice_chapters
from ..operators.chunk import chunk_documents
from ..operators.enforce import (
    enforce,
    enforced_text,
    preserve_macrons,
    strip_diacritics_extended,
    strip_verse_tags,
)
from ..operators.rules import FORBIDDEN_VOCABULARY, Rule, RuleBook
from ..operators.sections import align_paragraphs, parse_sections
from ..operators.vocabulary import (
    forbidden_vocab_scan,
    glossary_hits,
    glossary_table,
    never_use_violations,
    protected_terms_check,
)
from .registry import query
from .standins import load


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents")


# --- SQL fragments -----------------------------------------------------------------

TRIM = "trim({0}, E' \\t\\n\\r')"
DIA = "[āīūṛṅñṭḍṇśṣḥ]"


def trim(x: str) -> str:
    return TRIM.format(x)


def words(x: str) -> str:
    return (
        f"cast(len(list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')) as bigint)"
    )


def words_raw(x: str) -> str:
    return f"cast(len(regexp_split_to_array({x}, '\\s+')) as bigint)"


def lines(x: str) -> str:
    parts = f"list_transform(string_split({x}, chr(10)), lambda l: {trim('l')})"
    return f"list_filter({parts}, lambda l: l <> '')"


def verse_block(ls: str) -> str:
    """Packing-step verse test over a list of trimmed lines."""
    mean = f"(list_sum(list_transform({ls}, lambda l: length(l)))::double / len({ls}))"
    dia = f"regexp_matches(l, '{DIA}')"
    return f"""case when len({ls}) < 2 then false else
        len(list_filter({ls}, lambda l: regexp_matches(l, '^[“”"''‘’]') and {dia})) > 0
        or (len(list_filter({ls}, lambda l: abs(length(l) - {mean}) < {mean} * 0.5)) = len({ls})
            and len(list_filter({ls}, lambda l: {dia})) >= len({ls}) * 0.5) end"""


def verse_like(ls: str) -> str:
    """Section-step verse test over a list of trimmed lines."""
    mean = f"(list_sum(list_transform({ls}, lambda l: length(l)))::double / len({ls}))"
    dia = f"regexp_matches(l, '{DIA}')"
    some = lambda test: f"len(list_filter({ls}, lambda l: {test})) > 0"
    return f"""case when len({ls}) < 1 then false else
        {some(f"regexp_matches(l, '^[“”]') and {dia}")}
        or {some("regexp_matches(l, '^_.*_$') or regexp_matches(l, '^[*].*[*]$')")}
        or (len({ls}) >= 2 and (
             len(list_filter({ls}, lambda l: {dia} or regexp_matches(l, '[“”]'))) >= len({ls}) * 0.5
             or ({mean} < 80 and
                 len(list_filter({ls}, lambda l: abs(length(l) - {mean}) < {mean} * 0.6)) = len({ls}))))
        or ({some("regexp_matches(l, '^[“\"'']')")} and {some(dia)}) end"""


def curl(x: str) -> str:
    paired = f"""regexp_replace({x}, '"([^"]*)"', '“\\1”', 'g')"""
    return f"""replace({paired}, '"', '“')"""


def marks(x: str) -> str:
    """Quotes and dashes."""
    out = curl(x)
    out = f"regexp_replace({out}, '''([^'']{{2,}})''', '‘\\1’', 'g')"
    return f"regexp_replace(replace({out}, '—', ' – '), ' {{2,}}– {{2,}}', ' – ', 'g')"


def plain_letters(x: str) -> str:
    out = f"translate({x}, 'ṁṭṇīūṛṅḍħñ', 'mtniurndhn')"
    return f"replace(replace({out}, 'ṣ', 'sh'), 'ś', 'sh')"


def tidy(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, ' {{2,}}', ' ', 'g'), '(?m)^ +', '', 'g')"


# --- user rules over words that occur in the tables ----------------------------------

USER_RULES = [
    Rule("thing", "matter", "thing→matter", upper="Matter", family="terminology"),
    Rule("that", "which", "that→which", upper="Which", family="terminology"),
    Rule("which with", "whereby", "which with→whereby", family="terminology"),
    Rule("nicht", "kein", "forbidden: nicht→kein", family="forbidden_vocab"),
    Rule("elle la", "elle", "elle la→elle", family="terminology"),
    Rule("sich", "", 'hedging removed: "sich"', family="hedging"),
    Rule("pour", "par", "pour→par (exact)", ignore_case=False, family="place_name"),
]
USER_BOOK = RuleBook.of(*USER_RULES)


def rule_sql(x: str, rule: Rule) -> str:
    if rule.upper is not None:
        first, rest = rule.phrase[0], rule.phrase[1:]
        x = f"regexp_replace({x}, '\\b{first.upper()}(?i:{rest})\\b', '{rule.upper}', 'g')"
        return f"regexp_replace({x}, '\\b{first.lower()}(?i:{rest})\\b', '{rule.replacement}', 'g')"
    flag = "gi" if rule.ignore_case else "g"
    return f"regexp_replace({x}, '\\b{rule.phrase}\\b', '{rule.replacement}', '{flag}')"


def rule_count_sql(x: str, rule: Rule) -> str:
    flag = "i" if rule.ignore_case else "c"
    return f"len(regexp_extract_all({x}, '\\b{rule.phrase}\\b', 0, '{flag}'))"


def _rule_stages() -> str:
    """CTEs r0…rN: the text before and after every user rule."""
    ctes = ["r0 as (select doc_id, lang, text as t from documents)"]
    for i, rule in enumerate(USER_RULES):
        ctes.append(
            f"r{i + 1} as (select doc_id, lang, {rule_sql('t', rule)} as t, "
            f"{rule_count_sql('t', rule)} as n from r{i})"
        )
    return ",\n".join(ctes)


def _rule_log() -> str:
    parts = []
    for i, rule in enumerate(USER_RULES):
        label = rule.label.replace("'", "''")
        parts.append(f"select doc_id, lang, '{label}' as rule, n from r{i + 1} where n > 0")
    last = f"r{len(USER_RULES)}"
    parts.append(
        f"""select doc_id, lang, 'straight quotes→curly quotes' as rule,
            length(t) - length(replace(t, '"', '')) as n from {last} where contains(t, '"')"""
    )
    for ch in "ṁṭṣśṇīūṛṅḍħñ":
        parts.append(
            f"""select doc_id, lang, 'forbidden diacritics stripped (only ā permitted)' as rule,
                length(t) - length(replace(t, '{ch}', '')) as n from {last} where contains(t, '{ch}')"""
        )
    return "\n union all ".join(parts)


LOG_SQL = f"with {_rule_stages()},\nlog as ({_rule_log()})"

CATEGORY_SQL = """case when contains(lower(rule), 'diacritics') then 'Diacritics'
    when contains(lower(rule), 'forbidden') then 'Forbidden Vocab'
    when contains(lower(rule), 'hedging') then 'Hedging'
    when contains(lower(rule), 'quotes') or contains(lower(rule), 'dash') then 'Punctuation'
    else 'Terminology' end"""


# --- metrics -------------------------------------------------------------------------


@query(
    "script_and_length_metrics",
    f"""
    select doc_id, {words('text')} as words, {words_raw('text')} as words_raw,
      (length(text) - length(regexp_replace(text, '[\\x{{0A80}}-\\x{{0AFF}}\\x{{0900}}-\\x{{097F}}]', '', 'g')))::double
        / nullif(length(text), 0) as indic_ratio,
      coalesce(length(text) > 50 and (length(text) - length(regexp_replace(text, '[\\x{{0A80}}-\\x{{0AFF}}\\x{{0900}}-\\x{{097F}}]', '', 'g')))::double
        / length(text) > 0.05, false) as valid_script,
      length(text) > 0 and (length(text) - length(regexp_replace(text, '[\\x{{0A80}}-\\x{{0AFF}}]', '', 'g')))::double
        / length(text) < 0.05 as refusal,
      cast(length(text) - length(regexp_replace(text, '[Āā]', '', 'g')) as bigint) as macrons,
      cast(length(regexp_replace(text, '[A-Za-z 0-9.,;:!?\\-–"''“”‘’()\\nāĀ]', '', 'g')) as bigint) as outside_alphabet,
      md5(left(text, 200)) as preview_hash
    from documents
    """,
)
def _metrics(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "doc_id",
        word_count("text").alias("words"),
        word_count_raw("text").alias("words_raw"),
        script_ratio("text").alias("indic_ratio"),
        has_valid_script("text").alias("valid_script"),
        is_ocr_refusal("text").alias("refusal"),
        macron_count("text").alias("macrons"),
        charset_violations("text").alias("outside_alphabet"),
        F.md5(preview("text")).alias("preview_hash"),
    )


@query(
    "document_size_flags",
    f"""
    with w as (select lang, source, {words('text')} as words from documents)
    select lang, source, count(*) as documents,
      count(*) filter (where words > 3000) as book_mode,
      count(*) filter (where words > 6000) as long_documents,
      cast(sum(ceil(words / 500.0)) as bigint) as estimated_chunks
    from w group by lang, source
    """,
)
def _size_flags(spark, sf_dir):
    counted = documents(spark, sf_dir).select("lang", "source", word_count("text").alias("words"))
    return counted.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if(is_book_mode("words")).alias("book_mode"),
        F.count_if(warn_long("words")).alias("long_documents"),
        F.sum(estimated_chunks("words")).alias("estimated_chunks"),
    )


@query(
    "verse_blocks",
    f"""
    with l as (select doc_id, {lines('text')} as ls from documents)
    select doc_id, {verse_block('ls')} as verse_block, {verse_like('ls')} as verse_like from l
    """,
)
def _verse(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "doc_id",
        is_verse_block("text").alias("verse_block"),
        is_verse_like("text").alias("verse_like"),
    )


@query(
    "line_kinds",
    f"""
    with l as (select lang, unnest({lines('text')}) as line from documents)
    select lang, case when regexp_matches(line, '{DIA}|^[“”]') then 'transliteration'
        when regexp_matches(line, '^\\(.*\\)$') then 'meaning' else 'plain' end as kind,
      count(*) as n
    from l group by all
    """,
)
def _line_kinds(spark, sf_dir):
    parts = documents(spark, sf_dir).select("lang", trimmed_lines("text").alias("ls"))
    rows = explode_indexed(parts, "ls", ["lang"], "i", "line", "k")
    return rows.groupBy("lang", line_kind("line").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


# --- enforcement and audit -------------------------------------------------------------


@query(
    "enforce_punct_summary",
    f"""
    with hits as (
      select lang, 'Punctuation' as category,
        length(text) - length(replace(text, '"', '')) as n from documents
      union all
      select lang, 'Diacritics', length(text) - length(regexp_replace(text, '[ṁṭṣśṇīūṛṅḍħñ]', '', 'g'))
      from documents)
    select lang, category, cast(sum(n) as bigint) as fixes from hits where n > 0 group by all
    """,
)
def enforce_punct_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: corrections of the default rules, by language and category."""
    audited = enforce(documents(spark, sf_dir), audit=True)
    log = corrections_log(audited, id_cols=["doc_id", "lang"])
    return qa_summary(log, by=["lang"]).select("lang", "category", "fixes")


@query(
    "enforce_text",
    f"""
    with {_rule_stages()}
    select doc_id, md5({plain_letters(marks(tidy('t')))}) as text_hash from r{len(USER_RULES)}
    """,
)
def _enforce_text(spark, sf_dir):
    out = enforce(documents(spark, sf_dir), USER_BOOK)
    return out.select("doc_id", F.md5("text").alias("text_hash"))


@query(
    "enforce_default_rules",
    f"select doc_id, md5({plain_letters(marks(tidy('text')))}) as text_hash from documents",
)
def _enforce_default(spark, sf_dir):
    out = enforce(documents(spark, sf_dir))
    return out.select("doc_id", F.md5("text").alias("text_hash"))


@query(
    "enforce_light",
    f"select doc_id, md5({tidy(marks('text'))}) as text_hash from documents",
)
def _enforce_light(spark, sf_dir):
    out = enforce(documents(spark, sf_dir), profile="light")
    return out.select("doc_id", F.md5("text").alias("text_hash"))


@query(
    "strip_diacritics_extended",
    """
    select doc_id, md5(replace(replace(replace(replace(replace(replace(
        translate(text, 'īĪūŪṅṄñÑṭṬḍḌṇṆḥḤ', 'iIuUnNnNtTdDnNhH'),
        'ṛ', 'ri'), 'Ṛ', 'Ri'), 'ś', 'sh'), 'Ś', 'Sh'), 'ṣ', 'sh'), 'Ṣ', 'Sh')) as text_hash
    from documents
    """,
)
def _extended(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "doc_id", F.md5(strip_diacritics_extended("text")).alias("text_hash")
    )


@query(
    "strip_verse_tags",
    """
    select conv_id, turn, md5(text) as text_hash from conversations
    """,
)
def _verse_tags(spark, sf_dir):
    marked = load(spark, sf_dir, "conversations").withColumn(
        "text",
        F.concat(
            F.lit("<verse>"), F.replace("text", F.lit("\n"), F.lit("</verse>\n<verse>")), F.lit("</verse>")
        ),
    )
    return marked.select("conv_id", "turn", F.md5(strip_verse_tags("text")).alias("text_hash"))


@query(
    "corrections_log",
    f"""
    {LOG_SQL}
    select doc_id, rule, cast(sum(n) as bigint) as fixes, count(*) as entries
    from log group by doc_id, rule
    """,
)
def _log(spark, sf_dir):
    log = corrections_log(enforce(documents(spark, sf_dir), USER_BOOK, audit=True))
    return log.groupBy("doc_id", "rule").agg(
        F.sum("count").alias("fixes"), F.count(F.lit(1)).alias("entries")
    )


@query(
    "rule_hits_topk",
    f"""
    {LOG_SQL}
    select rule, cast(sum(n) as bigint) as fixes, count(*) as documents
    from log group by rule order by fixes desc, rule limit 5
    """,
)
def _topk(spark, sf_dir):
    log = corrections_log(enforce(documents(spark, sf_dir), USER_BOOK, audit=True))
    return top_rules(log, 5)


@query(
    "qa_summary",
    f"""
    {LOG_SQL}
    select lang, {CATEGORY_SQL} as category, cast(sum(n) as bigint) as fixes,
      count(*) as entries,
      cast(list_position(['Terminology', 'Forbidden Vocab', 'Hedging', 'Historical Names',
        'Place Names', 'Date Format', 'Punctuation', 'Diacritics', 'Other'], category) as bigint)
        as category_rank
    from log group by lang, category
    """,
)
def _qa(spark, sf_dir):
    audited = enforce(documents(spark, sf_dir), USER_BOOK, audit=True)
    return qa_summary(corrections_log(audited, id_cols=["doc_id", "lang"]), by=["lang"])


@query(
    "total_fixes",
    f"""
    {LOG_SQL}
    select d.doc_id, cast(coalesce(sum(n), 0) as bigint) as total_fixes
    from documents d left join log on log.doc_id = d.doc_id group by d.doc_id
    """,
)
def _total_fixes(spark, sf_dir):
    return enforce(documents(spark, sf_dir), USER_BOOK, audit=True).select("doc_id", "total_fixes")


def _enforced_sql(x: str) -> str:
    for rule in USER_RULES:
        x = rule_sql(x, rule)
    return plain_letters(marks(tidy(x)))


@query(
    "idempotency_check",
    f"""
    with a as (select doc_id, {_enforced_sql('text')} as once from documents),
    b as (select doc_id, once, {_enforced_sql('once')} as twice from a)
    select doc_id, md5(once) as once, md5(twice) as twice from b where once <> twice
    """,
)
def _idempotent(spark, sf_dir):
    changed = idempotency_check(documents(spark, sf_dir), USER_BOOK)
    return changed.select("doc_id", F.md5("once").alias("once"), F.md5("twice").alias("twice"))


@query(
    "length_drift",
    f"""
    with a as (select doc_id, length(text) as n, length({_enforced_sql('text')}) as m from documents)
    select doc_id, case when n > 0 then abs(m - n)::double / n end as drift,
      n > 0 and abs(m - n)::double / n < 0.05 as bounded from a
    """,
)
def _drift(spark, sf_dir):
    drift = length_drift("text", enforced_text("text", USER_BOOK))
    out = documents(spark, sf_dir).select("doc_id", drift.alias("drift"))
    return out.withColumn("bounded", F.coalesce(F.col("drift") < 0.05, F.lit(False)))


@query(
    "preserve_macrons",
    """
    with recursive d as (select doc_id, text as after, translate(text, 'aA', 'āĀ') as before from documents),
    l as (select doc_id, list_filter(string_split(before, chr(10)), lambda x: regexp_matches(x, '[Āā]')) as ls,
            length(regexp_replace(before, '[^Āā]', '', 'g')) as nb, length(regexp_replace(after, '[^Āā]', '', 'g')) as na
          from d),
    v as (select doc_id, unnest(ls) as line, unnest(range(1, len(ls) + 1)) as i from l where nb > 0 and na < nb),
    m as (
      select doc_id, cast(0 as bigint) as i, after as t, cast(0 as bigint) as restored from d
      union all
      select m.doc_id, v.i,
        case when not contains(m.t, v.line) and contains(m.t, translate(v.line, 'āĀ', 'aA'))
          then left(m.t, strpos(m.t, translate(v.line, 'āĀ', 'aA')) - 1) || v.line
            || substr(m.t, strpos(m.t, translate(v.line, 'āĀ', 'aA')) + length(v.line)) else m.t end,
        case when not contains(m.t, v.line) and contains(m.t, translate(v.line, 'āĀ', 'aA'))
          then m.restored + length(regexp_replace(v.line, '[^Āā]', '', 'g')) else m.restored end
      from m join v on v.doc_id = m.doc_id and v.i = m.i + 1)
    select doc_id, md5(arg_max(t, i)) as text_hash, cast(arg_max(restored, i) as bigint) as restored
    from m group by doc_id
    """,
)
def _macrons(spark, sf_dir):
    """Lines whose ``a`` had a macron before and lost it after."""
    pairs = documents(spark, sf_dir).select(
        "doc_id", F.translate("text", "aA", "āĀ").alias("before"), F.col("text").alias("after")
    )
    out = preserve_macrons(pairs, "before", "after")
    return out.select("doc_id", F.md5("text").alias("text_hash"), "restored")


# --- vocabulary -------------------------------------------------------------------------

SCAN_TERMS = ["thing", "that", "with", "that with", "with the", "nicht", "sich", "elle", "la", "elle la"]
GLOSSARY_TEXT = """
--- ENGLISH ---
thing: a matter (NEVER "thin")
that: a pronoun (NEVER just "than" in prose)
the thing: a known matter
--- OTHER ---
nicht: a negation (NEVER "nichts")
la: an article (NEVER "le" or similar)
thing: a loan word
ting: an assembly (NEVER "thin", NEVER "le")
"""


def _count_terms(terms: list[str], table: str = "documents", x: str = "text") -> str:
    parts = [
        f"select doc_id, '{t}' as term, len(regexp_extract_all({x}, '\\b{t}\\b', 0, 'i')) as n from {table}"
        for t in terms
    ]
    return " union all ".join(parts)


@query(
    "forbidden_scan",
    f"""
    with c as ({_count_terms(SCAN_TERMS)})
    select doc_id, term, cast(n as bigint) as count from c where n > 0
    """,
)
def _scan(spark, sf_dir):
    return forbidden_vocab_scan(documents(spark, sf_dir), SCAN_TERMS)


@query(
    "forbidden_scan_default",
    f"""
    with c as ({_count_terms(FORBIDDEN_VOCABULARY)})
    select doc_id, term, cast(n as bigint) as count from c where n > 0
    """,
)
def _scan_default(spark, sf_dir):
    return forbidden_vocab_scan(documents(spark, sf_dir))


@query(
    "protected_check",
    f"""
    with a as (select doc_id, text as b, {_enforced_sql('text')} as a from documents),
    c as ({' union all '.join(
        f"select doc_id, '{t}' as term, len(regexp_extract_all(b, '\\b{t}\\b')) as before, "
        f"len(regexp_extract_all(a, '\\b{t}\\b')) as after from a"
        for t in ['that', 'with', 'sich', 'pour', 'la', 'matter'])})
    select doc_id, term, cast(before as bigint) as before, cast(after as bigint) as after
    from c where after < before
    """,
)
def _protected(spark, sf_dir):
    pairs = documents(spark, sf_dir).select(
        "doc_id", F.col("text").alias("b"), enforced_text("text", USER_BOOK).alias("a")
    )
    return protected_terms_check(pairs, "b", "a", ["that", "with", "sich", "pour", "la", "matter"])


@query(
    "glossary_hits",
    f"""
    with c as ({_count_terms(['thing', 'that', 'the thing', 'nicht', 'la', 'ting'])})
    select doc_id, term, cast(n as bigint) as count, category
    from c join (values ('thing', 'ENGLISH'), ('that', 'ENGLISH'), ('the thing', 'ENGLISH'),
                        ('nicht', 'OTHER'), ('la', 'OTHER'), ('thing', 'OTHER'), ('ting', 'OTHER')) g(term, category)
    using (term) where n > 0
    """,
)
def _glossary(spark, sf_dir):
    return glossary_hits(documents(spark, sf_dir), glossary_table(spark, GLOSSARY_TEXT))


@query(
    "never_use_violations",
    f"""
    with c as ({_count_terms(['thin', 'than', 'nichts', 'le'])})
    select doc_id, c.term as banned, cast(n as bigint) as count, use as term
    from c join (values ('thin', 'thing'), ('than', 'that'), ('nichts', 'nicht'), ('le', 'la'),
                        ('thin', 'ting'), ('le', 'ting')) g(banned, use) on c.term = g.banned
    where n > 0
    """,
)
def _never_use(spark, sf_dir):
    return never_use_violations(documents(spark, sf_dir), glossary_table(spark, GLOSSARY_TEXT))


# --- markup, sections, chapters, chunks ----------------------------------------------------


def _named(x: str) -> str:
    for entity, text in [
        ("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
        ("&apos;", "''"), ("&#039;", "''"), ("&rsquo;", "’"), ("&lsquo;", "‘"),
        ("&rdquo;", "”"), ("&ldquo;", "“"), ("&ndash;", "–"), ("&mdash;", "—"),
        ("&hellip;", "…"),
    ]:
        x = f"replace({x}, '{entity}', '{text}')"
    return x


_STRIPPED = "regexp_replace(replace(replace(html, '</p>', E'\\n\\n'), '<br/>', E'\\n'), '<[^>]+>', '', 'g')"
PAGE_TEXT_SQL = trim(f"regexp_replace({_named(_STRIPPED)}, '\\n{{3,}}', E'\\n\\n', 'g')")


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages")
    return pages.select("page_id", markup_to_text("html").alias("text"))


@query(
    "markup_text",
    f"""
    with t as (select page_id, {PAGE_TEXT_SQL} as text from pages)
    select page_id, md5(text) as text_hash, cast(length(text) as bigint) as n_chars from t
    """,
)
def _markup(spark, sf_dir):
    return page_texts(spark, sf_dir).select(
        "page_id", F.md5("text").alias("text_hash"), F.length("text").alias("n_chars")
    )


@query(
    "numeric_entities",
    f"""
    with t as (select page_id, {PAGE_TEXT_SQL} as text from pages)
    select page_id, md5(text) as text_hash, cast(length(text) as bigint) as n_chars from t
    """,
)
def _numeric(spark, sf_dir):
    """Pages whose vowels and blanks are numeric entities decode to the same text."""
    coded = F.col("html")
    for ch, entity in ((" ", "&#32;"), ("a", "&#x61;"), ("e", "&#101;"), ("o", "&#x6F;"), ("i", "&#00105;")):
        coded = F.replace(coded, F.lit(ch), F.lit(entity))
    pages = load(spark, sf_dir, "pages").withColumn("html", coded)
    return pages.select("page_id", markup_to_text("html").alias("text")).select(
        "page_id", F.md5("text").alias("text_hash"), F.length("text").alias("n_chars")
    )


@query(
    "normalise_newlines",
    f"""
    select conv_id, turn,
      md5({trim("regexp_replace(replace(text || E'\\r\\n\\r\\n\\r\\nend ', E'\\r\\n', E'\\n'), '\\n{3,}', E'\\n\\n', 'g')")}) as text_hash
    from conversations
    """,
)
def _newlines(spark, sf_dir):
    raw = F.concat("text", F.lit("\r\n\r\n\r\nend "))
    return load(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.md5(normalise_newlines(raw)).alias("text_hash")
    )


def _blocks(x: str) -> str:
    parts = f"list_transform(regexp_split_to_array({x}, '\\n\\s*\\n'), lambda b: {trim('b')})"
    return f"list_filter({parts}, lambda b: b <> '')"


def sections_sql() -> str:
    """Sections of a table ``t`` (page_id, text)."""
    return f"""
    b as (select page_id, {_blocks('text')} as bs from t),
    e as (select page_id, unnest(bs) as content, unnest(range(len(bs))) as index from b),
    l as (select *, {lines('content')} as ls from e),
    v as (select *, {verse_like('ls')} as verse from l),
    m as (select *,
      list_filter(ls, lambda l: not regexp_matches(l, '^\\(.+\\)$') and regexp_matches(l, '{DIA}|^[“”]')) as roman,
      list_filter(ls, lambda l: regexp_matches(l, '^\\(.+\\)$')) as meanings from v)
"""


@query(
    "sections",
    f"""
    with t as (select page_id, {PAGE_TEXT_SQL} as text from pages),
    {sections_sql()}
    select page_id, cast(index as bigint) as index, case when verse then 'verse' else 'prose' end as type,
      md5(content) as content_hash,
      case when verse and len(roman) > 0 then md5(array_to_string(roman, chr(10))) end as roman_hash,
      case when verse and len(meanings) > 0 then regexp_extract(meanings[-1], '^\\((.+)\\)$', 1) end as meaning
    from m
    """,
)
def _sections(spark, sf_dir):
    out = parse_sections(page_texts(spark, sf_dir), id_col="page_id")
    return out.select(
        "page_id",
        "index",
        "type",
        F.md5("content").alias("content_hash"),
        F.md5("transliteration").alias("roman_hash"),
        "meaning",
    )


@query(
    "align_paragraphs",
    f"""
    with t as (select page_id, {PAGE_TEXT_SQL} as text from pages),
    b as (select page_id, {_blocks('text')} as s, {_blocks("regexp_replace(text, '\\n\\n', ' ')")} as g from t),
    e as (select page_id, s, g, unnest(range(greatest(len(s), len(g)))) as position from b)
    select page_id, cast(position as bigint) as position, md5(s[position + 1]) as source,
      md5(g[position + 1]) as target from e
    """,
)
def _align(spark, sf_dir):
    # the second text has its first paragraph break removed, so the sides differ in length
    pairs = page_texts(spark, sf_dir).select(
        "page_id",
        F.col("text").alias("original"),
        F.regexp_replace("text", "(?s)\\A(.*?)\\n\\n", "$1 ").alias("translation"),
    )
    out = align_paragraphs(pairs, id_cols=["page_id"])
    return out.select(
        "page_id", "position", F.md5("source").alias("source"), F.md5("target").alias("target")
    )


def headed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which every line is announced by a chapter marker line."""
    return documents(spark, sf_dir).select(
        "doc_id",
        F.regexp_replace("text", "(?m)^(.)", "=== Chapter: part $1 ===\n$1").alias("text"),
    )


HEADED_SQL = """
    h as (select doc_id, string_split(regexp_replace(text, '(?m)^(.)', E'=== Chapter: part \\\\1 ===\\n\\\\1', 'g'), chr(10)) as ls
          from documents),
    k as (select doc_id, ls, least(50, floor(len(ls) * 0.05)) as skip from h),
    n as (select doc_id, skip, unnest(ls) as line, unnest(range(len(ls))) as i, len(ls) as total from k),
    c as (select doc_id, i as start_line, total,
            regexp_extract(line, '(?i)^===\\s*CHAPTER:\\s*(.+?)\\s*===$', 1) as title
          from n where i >= skip and regexp_matches(line, '(?i)^===\\s*CHAPTER:\\s*(.+?)\\s*===$')),
    q as (select *, count(*) over (partition by doc_id) as found,
            row_number() over (partition by doc_id order by start_line) - 1 as chapter_index,
            lead(start_line) over (partition by doc_id order by start_line) as following from c)
"""


@query(
    "chapters_by_marker",
    f"""
    with {HEADED_SQL}
    select doc_id, 'marker' as strategy, cast(chapter_index as bigint) as chapter_index, title,
      cast(start_line as bigint) as start_line
    from q where found > 1
    """,
)
def _markers(spark, sf_dir):
    return detect_chapters(headed_documents(spark, sf_dir), strategies=("marker",))


@query(
    "chapter_slices",
    f"""
    with {HEADED_SQL}
    select q.doc_id, cast(chapter_index as bigint) as chapter_index, title,
      md5({trim("array_to_string(h.ls[start_line + 1 : coalesce(following, total)], chr(10))")}) as text_hash,
      cast(found as bigint) as total_chapters
    from q join h on h.doc_id = q.doc_id where found > 1
    """,
)
def _slices(spark, sf_dir):
    out = slice_chapters(headed_documents(spark, sf_dir))
    return out.select(
        "doc_id", "chapter_index", "title", F.md5("text").alias("text_hash"), "total_chapters"
    )


@query(
    "chapters_by_words",
    f"""
    with recursive t as (select page_id, string_split({PAGE_TEXT_SQL}, chr(10)) as ls from pages),
    w as (select page_id, len(ls) as n, cast(least(50, floor(len(ls) * 0.05)) as bigint) as skip,
            list_transform(ls, lambda l: {words('l')}) as ws from t),
    f as (
      select page_id, n, ws, skip as i, cast(0 as bigint) as total, [skip] as starts from w where list_sum(ws) >= 200
      union all
      select page_id, n, ws, case when cut > 0 then cut else i + 1 end, case when cut > 0 then 0 else total end,
        case when cut > 0 then list_append(starts, cut) else starts end
      from (select *, case when total >= 200 and gap > 0 and i + gap < n then i + gap else 0 end as cut
            from (select page_id, n, ws, i, starts, cast(total + ws[i + 1] as bigint) as total,
                    coalesce(list_position(ws[i + 1 : i + 20], 0), 0) as gap from f where i < n))),
    e as (select page_id, starts from f where i >= n and len(starts) > 1),
    u as (select page_id, unnest(starts) as start_line, unnest(range(len(starts))) as chapter_index from e)
    select page_id, 'words' as strategy, chapter_index, 'Section ' || (chapter_index + 1) as title,
      cast(start_line as bigint) as start_line from u
    """,
)
def _by_words(spark, sf_dir):
    return detect_chapters(
        page_texts(spark, sf_dir), id_col="page_id", strategies=("words",), target_words=200
    )


def chunks_sql(table: str = "documents") -> str:
    return f"""
    d as (select doc_id, {trim('text')} as t from {table}),
    p0 as (select doc_id, t, {words('t')} as total, {_blocks('t')} as bs from d where t <> ''),
    p1 as (select doc_id, t, total, case
             when len(list_filter(bs, lambda b: {words_raw('b')} > 500)) > 0
             then {lines('t')} else bs end as ps from p0 where total > 500),
    p2 as (select doc_id, unnest(ps) as p, unnest(range(1, len(ps) + 1)) as i, len(ps) as n from p1),
    p3 as (select doc_id, p, i, n, {words_raw('p')} as w, {lines('p')} as ls from p2),
    p4 as (select doc_id, p, i, n, w, {verse_block('ls')} as verse from p3),
    f as (
      select doc_id, i, n, cast(0 as bigint) as chunk, w as grp, cast(i as bigint) as grp_at,
        not verse as prose, cast([] as bigint[]) as breaks
      from p4 where i = 1
      union all
      select p.doc_id, p.i, p.n,
        case when p.verse or not f.prose then f.chunk
             when f.chunk + f.grp > 500 and f.chunk >= 300 then f.grp else f.chunk + f.grp end,
        case when p.verse or not f.prose then f.grp + p.w else p.w end,
        case when p.verse or not f.prose then f.grp_at else cast(p.i as bigint) end,
        f.prose or not p.verse,
        case when p.verse or not f.prose then f.breaks
             when f.chunk + f.grp > 500 and f.chunk >= 300 then list_append(f.breaks, f.grp_at)
             else f.breaks end
      from f join p4 p on p.doc_id = f.doc_id and p.i = f.i + 1),
    g as (select doc_id, n,
            case when chunk + grp > 500 and chunk >= 300 then list_append(breaks, grp_at) else breaks end as breaks,
            case when chunk + grp > 500 and chunk >= 300 then grp else chunk + grp end as tail
          from f where i = n),
    s as (select doc_id, n, case when tail < 150 and len(breaks) > 0 then breaks[1 : len(breaks) - 1]
            else breaks end as breaks from g),
    x as (select doc_id, n, list_prepend(1, breaks) as starts, list_append(breaks, n + 1) as ends from s),
    y as (select doc_id, unnest(starts) as a, unnest(ends) as b, unnest(range(len(starts))) as chunk_index,
            len(starts) as chunk_count from x),
    z as (select y.doc_id, chunk_index, chunk_count,
            array_to_string(p1.ps[a : b - 1], E'\\n\\n') as text
          from y join p1 on p1.doc_id = y.doc_id
          union all
          select doc_id, 0, 1, t from p0 where total <= 500)
"""


@query(
    "chunks",
    f"""
    with recursive {chunks_sql()}
    select doc_id, cast(chunk_index as bigint) as chunk_index, cast(chunk_count as bigint) as chunk_count,
      md5(text) as text_hash, {words('text')} as words
    from z
    """,
)
def _chunks(spark, sf_dir):
    out = chunk_documents(documents(spark, sf_dir))
    return out.select(
        "doc_id", "chunk_index", "chunk_count", F.md5("text").alias("text_hash"), "words"
    )
