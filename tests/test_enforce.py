from __future__ import annotations

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioforge.functions.text import flag_band
from folioforge.operators import enforce as E
from folioforge.operators import rules as R
from folioforge.operators.audit import CATEGORY_ORDER, categorise, corrections_log, idempotency_check, qa_summary
from folioforge.operators.enforce import (
    custom_rewrite,
    enforce,
    enforced_text,
    preserve_macrons,
    strip_diacritics_extended,
    strip_verse_tags,
)
from folioforge.operators.vocabulary import (
    forbidden_vocab_scan,
    glossary_hits,
    glossary_table,
    never_use_violations,
    parse_glossary,
    protected_terms_check,
    term_layers,
)

ALL_RULES = [
    *R.TERMINOLOGY_RULES,
    *R.PERSONAL_NAME_RULES,
    *R.PLACE_NAME_RULES,
    *R.FORBIDDEN_VOCAB_RULES,
    *R.HEDGING_RULES,
]


def run(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return [r.text for r in enforce(df, **options).orderBy("doc_id").collect()]


def _in_order(spark, texts, rules):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    t = F.col("text")
    slow = E._audit_in_order(t, rules)
    fast, plain = E.audit_rules(t, rules), E.apply_rules(t, rules)
    rows = df.select("text", slow.alias("a"), fast.alias("b"), plain.alias("c")).collect()
    for r in rows:
        assert r.a == r.b, r.text
        assert r.a["text"] == r.c, r.text


def test_layers_equal_rules_in_order(spark):
    """Random texts of rule words, against the fold of one rule after another."""
    rng = random.Random(2)
    words = sorted({w for r in ALL_RULES for w in (r.phrase, *r.phrase.split(), r.replacement)})
    words += [w.upper() for w in words] + [w.capitalize() for w in words] + ["x", "é", "the", ""]
    gaps = [" ", " ", "  ", "-", ", ", "\n", "’", "_", "."]
    texts = ["".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randint(0, 14))) for _ in range(400)]
    _in_order(spark, [*texts, "", None, "saint \ue000 monk", "saint", "SAINT saint Saint"], ALL_RULES)


def test_layers_of_rules_that_feed_each_other(spark):
    rule = lambda a, b, **more: R.Rule(a, b, f"{a}→{b}", **more)
    rules = [
        rule("a", "b"), rule("b", "c"), rule("c d", "e"), rule("d", ""), rule("(x)", "y"), rule("e", "a b"),
        rule("B", "Q", ignore_case=False), rule("b, a", "-"), rule("k", ", "), rule("m k n", "o"), rule("p", "", upper="R"),
        rule("[0-9]+ (a)", "$1", regex=True), rule("a", "z"), rule("z's", "w"),
    ]
    assert E.rule_layers(rules[:4]) == [[0], [1], [2], [3]]
    rng = random.Random(3)
    words = ["a", "b", "c", "d", "e", "(x)", "x", "A", "B", "k", "m", "n", "p", "P", "7", "z", "z's", ""]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", ", ", ",", "-"]) for _ in range(rng.randint(1, 12))) for _ in range(400)]
    assert not E._in_layers(rules)  # too many: the fold itself
    for some in (rules[:4], rules[4:8], rules[6:10], rules[8:12], rules[10:], [rules[2], rules[4], rules[6]]):
        assert E._in_layers(some)
        _in_order(spark, texts, some)


def _plain_hits(text, terms):
    """As a search for the literal would count, edges of words kept whole."""
    out = {}
    for term in {t.lower() for t in terms if t}:
        left = r"(?<![a-z0-9_])" if re.match("[a-z0-9_]", term[0]) else ""
        right = r"(?![a-z0-9_])" if re.match("[a-z0-9_]", term[-1]) else ""
        n = len(re.findall(left + re.escape(term) + right, text.lower()))
        if n:
            out[term] = n
    return out


def test_glossary_hits_equal_a_search(spark):
    rng = random.Random(6)
    terms = ["a", "a a", "a b a", "b-c", "(a)", "!a!", "-a-a-", "!!", "!", "C++", "é", "éa", "d  e", "", "a, b", "x_1", "..a", "b.", "A"]
    bits = ["a", "b", "c", "A", "d", "e", "é", "x_1", "!", "!!", "-", "(", ")", "++", ".", "..", ", ", " ", "  ", "\n"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 25))) for _ in range(300)] + ["", "!!!!!", "a a a a a"]
    texts += ["-a-a-a-a-", "!a!a!", None]
    df = spark.createDataFrame([(i % 300, t) for i, t in enumerate(texts)], "doc_id int, text string")
    table = spark.createDataFrame([("c", t, "", []) for t in terms], "category string, term string, definition string, never_use array<string>")
    got = sorted((r.doc_id, r.term, r["count"]) for r in glossary_hits(df, table).collect())
    want = sorted((i % 300, term, n) for i, t in enumerate(texts) for term, n in _plain_hits(t or "", terms).items())
    assert got == want
    plan = glossary_hits(df, table)._jdf.queryExecution().executedPlan().toString()
    assert "RLIKE" not in plan and "regexp_count" not in plan
    assert glossary_hits(df, table.limit(0)).count() == 0


def test_glossary_of_many_terms(spark):
    many = spark.range(100_000).select(
        F.lit("c").alias("category"), F.format_string("term %d x", "id").alias("term"), F.lit("").alias("definition"),
        F.array().cast("array<string>").alias("never_use"),
    )
    df = spark.createDataFrame([(1, "Term 7 x, term 99999 x; term 100000 x and term 7 x")], "doc_id int, text string")
    assert sorted((r.term, r["count"]) for r in glossary_hits(df, many).collect()) == [("term 7 x", 2), ("term 99999 x", 1)]


def test_functions_keep_their_place_and_their_audit(spark):
    book = R.RuleBook.of(
        R.Rule("one", "11", "one"),
        R.FunctionRule(r"\d+", lambda n: str(int(n) * 2), "double"),
        R.Rule("22", "done one", "22"),
        R.FunctionRule("never", str.upper, "never"),
        R.FunctionRule("o", str.upper, "o"),
    )
    texts = ["one and 4", None, "", "plain", "one one 3"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = {r.doc_id: r for r in enforce(df, book, audit=True).collect()}
    log = lambda i: [tuple(c) for c in rows[i].corrections]
    assert rows[0].text == "dOne One and 8"
    assert log(0) == [("one", "11", "one", 1), ("11", "22", "double", 2), ("22", "done one", "22", 1), ("o", "O", "o", 2)]
    assert rows[4].text == "dOne One dOne One 6" and rows[4].total_fixes == 2 + 3 + 2 + 4
    assert rows[1].text is None and rows[2].text == "" and log(2) == []
    assert rows[3].text == "plain" and rows[3].total_fixes == 0
    assert [r.text for r in enforce(df, book).orderBy("doc_id").collect()] == [rows[i].text for i in range(5)]
    with pytest.raises(ValueError, match="table"):
        R.rules_table(spark, book)


def test_default_rules_need_two_layers():
    assert [len(x) for x in E.rule_layers(ALL_RULES)] == [58, 5]


def test_rule_lists_are_complete():
    sizes = [
        len(R.TERMINOLOGY_RULES),
        len(R.PERSONAL_NAME_RULES),
        len(R.PLACE_NAME_RULES),
        len(R.FORBIDDEN_VOCAB_RULES),
        len(R.HEDGING_RULES),
        len(R.DATE_RULES),
        len(R.DIACRITIC_MAP),
        len(R.EXTENDED_DIACRITIC_MAP),
    ]
    assert sizes == [33, 3, 9, 11, 7, 1, 12, 22]
    assert all(r.label for r in ALL_RULES)
    assert len(set(R.FORBIDDEN_VOCABULARY)) == len(R.FORBIDDEN_VOCABULARY) == 50
    assert len(set(R.PROTECTED_TERMS)) == len(R.PROTECTED_TERMS) == 20


def test_every_rule_fires(spark):
    before = [f"intro {r.phrase} outro" for r in ALL_RULES]
    after = run(spark, before)
    assert [b for b, a in zip(before, after, strict=True) if a == b] == []


@pytest.mark.parametrize("audit", [False, True])
def test_wording(spark, audit):
    cases = {
        "the saint walked": "the swami walked",
        "the Saint walked": "the Swami walked",
        "SAINTS sAINTS": "Swamis swamis",
        "the saints gathered": "the swamis gathered",
        "a temple here": "a mandir here",
        "aarti time": "arti time",
        "Lord Swaminarayan said": "Bhagwan Swaminarayan said",
        "lord swaminarayan said": "lord swaminarayan said",
        "Hindu mythology tells": "Hindu sacred history tells",
        "Greek mythology": "Greek sacred history",
        "the sannyasis arrived": "the bawas arrived",
        "the monkey jumped": "the monkey jumped",
        "xSaint Saintx _saint": "xSaint Saintx _saint",
        "ésaint": "éswami",  # ASCII word boundary
        "born in Pipalana": "born in Piplana",
        "the Mumbai Province": "the Bombay Province",
        "Narayanda spoke": "Naran’da spoke",
        "he perhaps came": "he came",
        "It is believed that he came": "he came",
        "on January 5, 1837 the event": "on 5 January 1837 the event",
        "December 25, 1999 came": "25 December 1999 came",
        'a "b" c "d': "a “b” c “d",
        "'ab' 'c'": "‘ab’ 'c'",
        "a—b  –  c": "a – b – c",
        "  two   spaces": "two spaces",
        "prāṇī, sūtra, ṣaṭkona — and “Ātmā jāgo”.": "prāni, sutra, shatkona – and “Ātmā jāgo”.",
        "Kṛṣṇa jñāna namaḥ": "Krshna jnāna namaḥ",
        "": "",
    }
    assert run(spark, list(cases), audit=audit) == list(cases.values())


def test_text_and_audit_agree_and_are_a_fixed_point(spark):
    text = (
        "The saint walked to the temple. On January 5, 1837 he reached Pipalana in Mumbai "
        "Province. Lord Swaminarayan blessed the followers."
    )
    once = run(spark, [text])
    assert run(spark, once) == once == run(spark, [text], audit=True)


def test_audit_counts_on_the_text_each_rule_sees(spark):
    df = spark.createDataFrame(
        [(1, 'Hindu mythology and mythology. It seems that it seems "x" Shrīji sūraj ī')],
        "doc_id int, text string",
    )
    log = corrections_log(enforce(df, audit=True)).orderBy("seq").collect()
    got = [(r["from"], r["to"], r["rule"], r["count"]) for r in log]
    assert got == [
        ("Hindu mythology", "Hindu sacred history", "Hindu mythology→Hindu sacred history", 1),
        ("mythology", "sacred history", "mythology→sacred history", 1),
        ("It seems that", "", 'hedging removed: "It seems that"', 1),
        ("it seems", "", 'hedging removed: "it seems"', 1),
        ('"', "“/”", "straight quotes→curly quotes", 2),
        ("ī", "i", R.DIACRITIC_LABEL, 2),
        ("ū", "u", R.DIACRITIC_LABEL, 1),
    ]
    assert enforce(df, audit=True).first().total_fixes == 9


def test_light_and_extended_profiles(spark):
    assert run(spark, ['the saint  said "a—b" ñ'], profile="light") == ["the saint said “a – b” ñ"]
    assert run(spark, ["Ṛṣi Kṛṣṇa namaḥ Ś"], profile="extended") == ["Rishi Krshna namah Sh"]
    row = spark.range(1).select(
        strip_diacritics_extended(F.lit("ṛṢḥ")).alias("a"),
        strip_verse_tags(F.lit("<verse>x</verse>")).alias("b"),
    )
    assert tuple(row.first()) == ("rishh"[0:2] + "Shh", "x")


def test_function_rule_and_flag_bands(spark):
    df = spark.createDataFrame([("a1b22", 0), (None, 2), ("x", 3)], "text string, n int")
    out = df.select(
        custom_rewrite("text", r"\d+", lambda m: str(int(m.group()) + 1)), flag_band("n")
    )
    assert [tuple(r) for r in out.collect()] == [("a2b23", "none"), (None, "some"), ("x", "many")]


def test_rules_round_trip_through_a_table(spark):
    table = R.rules_table(spark, R.RuleBook.default())
    book = R.rules_from_table(table)
    text = "The Saint, the monks and Pipalana on May 1, 1900"
    assert run(spark, [text], book=book) == run(spark, [text])


def test_case_preserving_rule_must_not_feed_itself():
    with pytest.raises(ValueError):
        R.Rule("thing", "thing", "x", upper="Thing thing")


def test_preserve_macrons(spark):
    cases = [
        ("Plain prose.", "Plain prose.", "Plain prose.", 0),
        ("“Ātmā jāgo re”.", "— “Ātmā jāgo re”.", "— “Ātmā jāgo re”.", 0),
        ("A.\n“Ātmā jāgo re”\nB.", "A.\n“Atma jago re”\nB.", "A.\n“Ātmā jāgo re”\nB.", 3),
        ("“Pārabrahma”\np\n“Mukundā”", "“Parabrahma”\np\n“Mukunda”", "“Pārabrahma”\np\n“Mukundā”", 2),
        ("we use atma.\n“Ātmā jāgo”", "we use atma.\n“Atma jago”", "we use atma.\n“Ātmā jāgo”", 3),
        ("ā $1\nā $1", "a $1\na $1\nx", "ā $1\na $1\nx", 1),  # first occurrence only, literal
    ]
    df = spark.createDataFrame(
        [(i, b, a) for i, (b, a, _, _) in enumerate(cases)], "i int, b string, a string"
    )
    out = preserve_macrons(df, "b", "a").orderBy("i").collect()
    assert [(r.text, r.restored) for r in out] == [(t, n) for _, _, t, n in cases]


def test_categories(spark):
    labels = {
        "saint→Swami": "Terminology",
        "forbidden: legendary→renowned": "Forbidden Vocab",
        'hedging removed: "perhaps"': "Hedging",
        "straight quotes→curly quotes": "Punctuation",
        "em dash→spaced en dash": "Punctuation",
        "American date→British date format": "Date Format",
        "Saurashtra→Kathiawad": "Place Names",
        "Naranda→Naran’da": "Historical Names",
        R.DIACRITIC_LABEL: "Diacritics",
    }
    df = spark.createDataFrame([(k,) for k in labels], "rule string")
    got = df.select("rule", categorise("rule").alias("c"), categorise("rule", True).alias("s"))
    for r in got.collect():
        assert r.c == labels[r.rule]
        assert r.s == ("Forbidden Vocab" if r.rule == R.DIACRITIC_LABEL else labels[r.rule])
        assert r.c in CATEGORY_ORDER


def test_qa_summary_skips_clean_documents(spark):
    df = spark.createDataFrame([(1, "clean"), (2, "a saint — b")], "doc_id int, text string")
    rows = qa_summary(corrections_log(enforce(df, audit=True))).collect()
    assert {(r.doc_id, r.category, r.fixes) for r in rows} == {
        (2, "Terminology", 1),
        (2, "Punctuation", 1),
    }


def test_protected_terms_survive_default_rules(spark):
    df = spark.createDataFrame(
        [(i, f"the {t} is sacred") for i, t in enumerate(R.PROTECTED_TERMS)],
        "doc_id int, text string",
    ).withColumn("after", enforced_text("text"))
    assert protected_terms_check(df, "text", "after").count() == 0
    broken = df.withColumn("after", F.lit("nothing"))
    assert protected_terms_check(broken, "text", "after").count() == 20


def test_overlapping_terms_are_all_counted(spark):
    terms = ["role", "role model", "model citizen", "a b a", "b"]
    df = spark.createDataFrame(
        [(1, "Role model citizen, role. a b a b a"), (2, "roles modelx")],
        "doc_id int, text string",
    )
    got = {(r.doc_id, r.term, r["count"]) for r in forbidden_vocab_scan(df, terms).collect()}
    assert got == {
        (1, "role", 2),
        (1, "role model", 1),
        (1, "model citizen", 1),
        (1, "a b a", 1),
        (1, "b", 2),
    }
    assert len(term_layers(terms)) == 3


def test_glossary(spark):
    text = '\n--- PRACTICE ---\nmandir: a place (NEVER "temple")\nseva: service (NEVER just "service")\n'
    assert parse_glossary(text)[1] == (
        "PRACTICE",
        "seva",
        'service (NEVER just "service")',
        ["service"],
    )
    df = spark.createDataFrame([(1, "Temple service in the mandir")], "doc_id int, text string")
    out = never_use_violations(df, glossary_table(spark, text)).collect()
    assert {(r.banned, r.term) for r in out} == {("temple", "mandir"), ("service", "seva")}


def test_glossary_keeps_every_pair(spark):
    rows = [
        ("A", "foo", "", ["soul"]),
        ("B", "Foo", "", ["soul", "self ("]),
        ("B", "bar", "", ["soul"]),
        ("C", "(x", "", []),
        ("C", "a b a", "", []),
    ]
    glossary = spark.createDataFrame(rows, "category string, term string, definition string, never_use array<string>")
    texts = [(1, "Foo food FOO; soul"), (2, "no self (here) (x y"), (3, None), (4, ""), (None, "a b a b a"), (1, "foo")]
    df = spark.createDataFrame(texts, "doc_id int, text string")
    hits = {(r.doc_id, r.term, r["count"], r.category) for r in glossary_hits(df, glossary).collect()}
    assert hits == {
        (1, "foo", 2, "A"), (1, "foo", 2, "B"), (1, "foo", 1, "A"), (1, "foo", 1, "B"),
        (2, "(x", 1, "C"), (None, "a b a", 1, "C"),
    }
    banned = {(r.doc_id, r.banned, r.term) for r in never_use_violations(df, glossary).collect()}
    assert banned == {(1, "soul", "foo"), (1, "soul", "Foo"), (1, "soul", "bar"), (2, "self (", "Foo")}
    assert glossary_hits(df, glossary.limit(0)).count() == 0


def test_function_rules_hold_few_rows_at_once():
    batch = pa.RecordBatch.from_pydict({"n": list(range(1000))})
    some = list(E._slices(iter([batch, batch.slice(0, 0), batch.slice(3, 1)])))
    assert max(b.num_rows for b in some) <= 128
    assert [n for b in some for n in b.column("n").to_pylist()] == [*range(1000), 3]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_second_run_enforces_no_text_for_a_filter(spark):
    book = R.RuleBook.of(R.Rule("one", "two one", "one"), R.Rule("old", "new", "old"))
    rows = [(1, "one"), (2, "old"), (3, None), (4, ""), (5, "none")]
    changed = idempotency_check(spark.createDataFrame(rows, "doc_id int, text string"), book)
    assert [tuple(r) for r in changed.collect()] == [(1, "two one", "two two one")]
    assert not [x for x in _plan(changed).splitlines() if "Filter" in x and "regexp_replace" in x]


def test_exact_terms_are_found_by_predefined_classes(spark):
    text = "la la, LA éla la_ 1la laé (la) la"
    df = spark.createDataFrame([(1, text, text.replace("(la)", ""))], "doc_id int, b string, a string")
    lost = protected_terms_check(df, "b", "a", ["la", "LA"])
    assert [tuple(r) for r in lost.collect()] == [(1, "la", 6, 5)]
    assert "[^A-Za-z0-9_](" not in _plan(lost)


def test_small_glossary_does_not_shuffle_runs_of_words(spark):
    table = glossary_table(spark, "--- A ---\nthat: x\nold that: y\n")
    df = spark.createDataFrame([(1, "That that-that, Old that thatthat")], "doc_id int, text string")
    hits = glossary_hits(df, table)
    assert sorted((r.term, r["count"]) for r in hits.collect()) == [("old that", 1), ("that", 4)]
    hits = glossary_hits(df, table)
    assert "hashpartitioning(gram" not in _plan(hits) and "SortMergeJoin" not in _plan(hits)
    assert "collect_list" not in _plan(hits)


def test_rule_of_a_match_is_looked_up_once(spark):
    df = spark.createDataFrame([("Old",), ("old",), ("none",)], "m string")
    lookup = E._lookup([(0, R.Rule("old", "new", "old", upper="New"))])
    out = df.select(E._result(F.col("m"), E._rule_of(F.col("m"), lookup)).alias("to"))
    assert [r.to for r in out.collect()] == ["New", "new", "none"]
    # the exact key, the lower-cased one, and the bound rule
    assert _plan(out).count("element_at(") <= 3
    # and the text is searched once to be taken apart
    apart = df.select(E._taken_apart(F.col("m"), [R.Rule("old", "new", "old")]).alias("p"))
    assert [r.p for r in apart.collect()] == [["", "Old", ""], ["", "old", ""], ["none"]]
    assert _plan(apart).count("regexp_replace(") == 1
