from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import plainpy
from folioforge.functions.markup import decode_entities, markup_to_text, normalise_newlines
from folioforge.functions.text import (
    charset_violations,
    has_valid_script,
    is_ocr_refusal,
    trim_ws,
    word_count,
    word_count_raw,
)
from folioforge.functions.verse import is_verse_block, is_verse_like, line_kind
from folioforge.operators.assemble import assemble_chunks, assemble_pages
from folioforge.operators.chapters import detect_chapters, slice_chapters
from folioforge.operators.chunk import chunk_documents
from folioforge.operators.responses import parse_responses
from folioforge.operators.sections import align_paragraphs, parse_sections


def one(spark, value, *columns):
    return tuple(spark.createDataFrame([(value,)], "t string").select(*columns).first())


def test_whitespace_and_word_counts(spark):
    text = " a b﻿ c　"
    assert one(spark, text, trim_ws("t"), word_count("t")) == ("a b﻿ c", 3)
    assert one(spark, "", word_count("t"), word_count_raw("t")) == (0, 1)
    assert one(spark, " a b ", word_count("t"), word_count_raw("t")) == (2, 4)


def test_script_predicates(spark):
    edge = "ક" * 3 + "x" * 57  # exactly 5 % of 60 characters
    strict, loose = has_valid_script("t").alias("a"), has_valid_script("t", False).alias("b")
    assert one(spark, edge, strict, loose) == (False, True)
    assert one(spark, "", is_ocr_refusal("t")) == (False,)
    assert one(spark, "I see no image", is_ocr_refusal("t")) == (True,)
    assert one(spark, "aā–“x”ñ#", charset_violations("t")) == (2,)


def test_markup(spark):
    cases = {
        "<p>a</p><p>b<br/>c</p>": "a\n\nb\nc",
        "&amp;lt;&nbsp;x&hellip;": "< x…",
        "&#65;&#38;#66;|&#x20AC;&#8364;": "A&#66;|€€",
        "&#55357;&#56832; &#xD83D;": "😀 �",
        "&#039;&apos;&quot;&rsquo;&ldquo;&ndash;&mdash;": "''\"’“–—",
        "a</p></p></p>b": "a\n\nb",
    }
    for source, expected in cases.items():
        assert one(spark, source, markup_to_text("t")) == (expected,)
    assert one(spark, " a\r\n\r\n\r\nb ", normalise_newlines("t")) == ("a\n\nb",)


def test_verse_predicates(spark):
    verse = "“Ātmā jāgo re”\nsūraj ūgyo re"
    assert one(spark, verse, is_verse_block("t"), is_verse_like("t")) == (True, True)
    assert one(spark, "single līne", is_verse_block("t"), is_verse_like("t")) == (False, False)
    assert one(spark, "*soft*", is_verse_block("t"), is_verse_like("t")) == (False, True)
    assert one(spark, "aaaa bbbb\ncccc dddd", is_verse_block("t"), is_verse_like("t")) == (False, True)
    kinds = [one(spark, s, line_kind("t"))[0] for s in ("“x", "ñ", "(why)", "prose")]
    assert kinds == ["transliteration", "transliteration", "meaning", "plain"]


def _random_document(rng: random.Random) -> str:
    parts = []
    for _ in range(rng.choice([1, 3, 8, 20])):
        if rng.random() < 0.3:
            parts.append("“ātmā jāgo re”\n" + "sūraj ūgyo re")
        elif rng.random() < 0.15:
            parts.append("\n".join(" ".join(["long"] * rng.randint(1, 90)) for _ in range(9)))
        else:
            parts.append(" ".join(["word"] * rng.choice([1, 20, 90, 160, 320, 480])))
    return rng.choice(["\n\n", "\n \n"]).join(parts)


def test_chunks_match_plain_python(spark):
    rng = random.Random(11)
    texts = ["", "   ", *[_random_document(rng) for _ in range(150)]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got: dict = {}
    for r in chunk_documents(df).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append(r.text)
        assert r.words == len(r.text.split())
    assert {i: got.get(i, []) for i in range(len(texts))} == {
        i: plainpy.chunks(t) for i, t in enumerate(texts)
    }


def _random_pieces(rng: random.Random) -> list[str]:
    pieces = []
    for _ in range(rng.choice([1, 2, 3, 5, 17, 40])):
        k = rng.choice([0, 1, 1, 2, 2, 3, 4])
        pieces.append(rng.choice([" ", ""]) + " ".join(rng.choice(["A.", "B!", "C?"]) for _ in range(k)))
    return pieces


@pytest.mark.parametrize(
    ("block_rows", "part_chars", "span_blocks"),
    [(256, 10**8, 256), (3, 10**8, 256), (3, 10, 256), (1, 10**8, 2), (3, 10**8, 2), (2, 10, 3)],
)
def test_assembly_matches_plain_python(spark, block_rows, part_chars, span_blocks):
    rng = random.Random(7)
    docs = [_random_pieces(rng) for _ in range(200)]
    rows = [(d, i, t) for d, pieces in enumerate(docs) for i, t in enumerate(pieces)]
    df = spark.createDataFrame(rows, "doc_id long, chunk_index int, text string")
    out = assemble_chunks(df, block_rows=block_rows, part_chars=part_chars, span_blocks=span_blocks)
    got: dict = {}
    for r in out.orderBy("doc_id", "part").collect():
        got.setdefault(r.doc_id, []).append((r.pieces, r.text))
    for d, pieces in enumerate(docs):
        parts = got[d]
        whole = parts[0][1] if len(parts) == 1 else "\n\n".join(t for n, t in parts if n)
        assert whole == plainpy.assembled(pieces)
    if part_chars == 10:
        assert max(len(v) for v in got.values()) > 5


def test_one_document_with_most_rows_is_split_and_whole(spark):
    rows = [(0, i, f"S{i}. T{i}.") for i in range(5000)] + [(d, 9 * d, " x ") for d in range(1, 50)]
    df = spark.createDataFrame(rows, "doc_id long, chunk_index int, text string")
    out = assemble_chunks(df, block_rows=64, part_chars=4000).collect()
    hot = sorted((r.part, r.text) for r in out if r.doc_id == 0)
    assert len(hot) > 10
    assert "\n\n".join(t for _, t in hot) == "\n\n".join(f"S{i}. T{i}." for i in range(5000))
    assert {r.text for r in out if r.doc_id} == {" x "}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.sampled_from(["w " * 90, "w " * 260, "x\ny", "z"]), min_size=1, max_size=12))
def test_chunking_keeps_all_words(spark, parts):
    text = "\n\n".join(parts)
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    texts = [r.text for r in chunk_documents(df).orderBy("chunk_index").collect()]
    assert " ".join(texts).split() == text.split()


def test_pages_join_without_blank_ones(spark):
    df = spark.createDataFrame(
        [("j", 2, " b "), ("j", 1, "a"), ("j", 3, " \n"), ("j", 4, None)],
        "job_id string, page_num int, source_text string",
    )
    assert assemble_pages(df).first().text == "a\n\n b "
    kept = assemble_pages(df, skip_blank=False).first().text
    assert kept == "a\n\n b \n\n \n"


RESPONSES = [
    ("translator", "<translation>\nHi.\n</translation>\n<flags>\n<flag> a </flag><flag></flag>\n</flags>", "Hi.", ["a"], None),
    ("translator", "```xml\n<translation>G.</translation>\n<flags></flags>\n```", "G.", [], None),
    ("translator", "```\n<translation>G.</translation>\n<flags> \n </flags>\n```", "G.", [], None),
    ("translator", "<flags></flags>", None, None, "Missing <translation> opening tag"),
    ("translator", "<translation>x\n<flags></flags>", None, None, "Missing </translation> closing tag"),
    ("translator", "<translation>x</translation>", None, None, "Missing <flags> opening tag"),
    ("translator", "<translation>1</translation><translation>2</translation><flags></flags>", None, None, "Multiple <translation> opening tags"),
    ("translator", "<translation>1</translation> </translation><flags></flags>", None, None, "Multiple </translation> closing tags"),
    ("translator", "<translation> \n </translation>\n<flags></flags>", None, None, "Empty <translation> block"),
    ("translator", "  \n ", None, None, "Empty translator output"),
    ("translator", None, None, None, "Empty or non-string translator output"),
    ("translator", "</translation><translation>1</translation><flags></flags>", "1", [], None),
    ("smoother", "```xml\n   <smoothed>Body.</smoothed>   \n```", "Body.", [], None),
    ("smoother", "<translation>oops</translation>", None, None, "Missing <smoothed> opening tag"),
    ("smoother", "", None, None, "Empty smoother output"),
    ("transliterator", "<transliteration>\na\n<verse>b</verse>\n</transliteration>", "a\n<verse>b</verse>", [], None),
    ("transliterator", "<transliteration></transliteration>", None, None, "Empty <transliteration> block"),
    ("transliterator", "<transliteration>", None, None, "Missing </transliteration> closing tag"),
    ("other", "x", None, None, "Unknown stage"),
]


def test_responses(spark):
    df = spark.createDataFrame(
        [(i, s, raw) for i, (s, raw, *_) in enumerate(RESPONSES)], "i int, stage string, raw string"
    )
    valid, quarantine = parse_responses(df)
    good = {r.i: (r.text, r.flags) for r in valid.collect()}
    bad = {r.i: r.error for r in quarantine.collect()}
    for i, (_, _, text, flags, error) in enumerate(RESPONSES):
        assert bad.get(i) == error
        if error is None:
            assert good[i] == (text, flags)


def test_lenient_responses(spark):
    raw = "x <translation>1</translation><translation>2</translation>"
    df = spark.createDataFrame([("translator", raw)], "stage string, raw string")
    for lenient in (True, "closed"):
        valid, _ = parse_responses(df, lenient=lenient)
        assert valid.first().text == "1"


def test_sections(spark):
    text = "Prose one.\n\n“Ātmā jāgo re”\nplain\n(Wake, soul)\n(Again)\n \nProse two."
    df = spark.createDataFrame([(1, text), (2, " ")], "doc_id int, text string")
    got = [tuple(r)[1:] for r in parse_sections(df).orderBy("index").collect()]
    assert got == [
        (0, "prose", "Prose one.", None, None),
        (1, "verse", "“Ātmā jāgo re”\nplain\n(Wake, soul)\n(Again)", "“Ātmā jāgo re”", "Again"),
        (2, "prose", "Prose two.", None, None),
    ]


def test_aligned_paragraphs(spark):
    df = spark.createDataFrame([(1, "a\n\nb", "x")], "doc_id int, original string, translation string")
    got = [tuple(r) for r in align_paragraphs(df, id_cols=["doc_id"]).orderBy("position").collect()]
    assert got == [(1, 0, "a", "x"), (1, 1, "b", None)]


def found(spark, text, **options):
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    rows = detect_chapters(df, **options).orderBy("chapter_index").collect()
    return [(r.strategy, r.title, r.start_line) for r in rows]


def test_marker_chapters(spark):
    lines = ["intro"] * 40 + ["=== chapter: One ===", "a"] + ["===CHAPTER:Two===", "b"]
    text = "\n".join(lines)
    assert found(spark, text) == [("marker", "One", 40), ("marker", "Two", 42)]
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    sliced = [(r.title, r.text) for r in slice_chapters(df).orderBy("chapter_index").collect()]
    assert sliced == [("One", "=== chapter: One ===\na"), ("Two", "===CHAPTER:Two===\nb")]
    assert found(spark, "\n".join(lines[:42])) == []


def test_toc_chapters(spark):
    names = ["The early years of life", "A long journey north", "Home again at last"]
    toc = [f"{i + 1}.\t{n} ........ {i * 9}" for i, n in enumerate(names)]
    body = []
    for n in names:
        body += ["", n, *["text line"] * 30]
    lines = ["front", *toc, *["x"] * 6, *body]
    start = len(lines) - len(body)
    expected = [("toc", n, start + 1 + 32 * i) for i, n in enumerate(names)]
    assert found(spark, "\n".join(lines)) == expected


def test_numbered_chapters(spark):
    lines = ["skip"] * 5
    for title in ("Chapter 1: Begin", "2) Middle part", "3. End"):
        lines += [title, *["text"] * 60]
    expected = [("number", "Chapter 1: Begin", 5), ("number", "Middle part", 66), ("number", "End", 127)]
    assert found(spark, "\n".join(lines), skip_front=False) == expected
    lower = [s.replace("Chapter", "chapter") for s in lines]
    assert found(spark, "\n".join(lower), skip_front=False)[0][1] == "Begin"


def test_word_sections_match_plain_python(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(60):
        n = rng.choice([10, 60, 200, 400])
        texts.append("\n".join(rng.choice(["", " ", "w " * rng.randint(1, 12), "w x", "y"]) for _ in range(n)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got: dict = {}
    rows = detect_chapters(df, strategies=("words",), target_words=60)
    for r in rows.orderBy("doc_id", "chapter_index").collect():
        got.setdefault(r.doc_id, []).append(r.start_line)
    for i, t in enumerate(texts):
        assert got.get(i, []) == plainpy.word_sections(t.split("\n"), 60)


def test_sections_of_long_text_are_named(spark):
    text = "\n".join(["w " * 50, ""] * 200)
    rows = found(spark, text)
    assert [r[1] for r in rows][:2] == ["Section 1", "Section 2"]
    assert F is not None and rows[0][0] == "words"


def test_long_runs_and_huge_numbers_of_entities(spark):
    run = "&#2709;" * 200_000
    rows = [(1, run), (2, f"a&#{'9' * 40};b"), (3, "&#x" + "F" * 40 + ";"), (4, "&#000065;&#0;"), (5, "&#55357;&#56832;"), (6, "&#128512;"), (7, None)]
    df = spark.createDataFrame(rows, "i int, t string").select("i", decode_entities("t").alias("t"))
    got = {r.i: r.t for r in df.collect()}
    assert got[1] == chr(2709) * 200_000
    assert got[2] == "a\ufffdb" and got[4] == "A\0" and got[5] == "\U0001f600" and got[7] is None
    assert got[6] == chr(128512 % 65536)


def test_contents_are_sought_before_lines_are_trimmed(spark):
    body = "\n".join(["word"] * 30)
    heads = ["First part here", "Second part here", "Third part here"]
    listed = "\n".join(f" {i + 1}.\t{h}\t{i}" for i, h in enumerate(heads))
    text = f"Contents\n{listed}\n\n\n\n\n\n" + "".join(f"{blank}\n {h} \n{body}\n" for blank, h in zip(["", "  \t", "﻿"], heads))
    df = spark.createDataFrame([(1, text), (2, text.replace("﻿", "x")), (3, None)], "doc_id int, text string")
    got = detect_chapters(df, strategies=("toc",))
    assert [(r.doc_id, r.title) for r in got.collect()] == [(1, h) for h in heads]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Contains(") < plan.index("ascii(")
