"""MD5 that is carried on from task to task, against hashlib over the whole text."""

from __future__ import annotations

import hashlib
import random
from pathlib import Path

import duckdb
import pytest

from folioforge.operators import digest
from folioforge.operators.assemble import assemble_book
from folioforge.plans import catalog, state_queries


@pytest.mark.parametrize("blocks", [digest._plain_blocks, digest._blocks()])
def test_md5_goes_on_from_its_state_after_any_byte(blocks):
    rng = random.Random(3)
    data = bytes(rng.choice([0, 10, 128, rng.randrange(256)]) for _ in range(300))
    for size in [0, 1, 54, 55, 56, 57, 63, 64, 65, 119, 120, 128, 300]:
        for cut in {0, 1, 55, 64, 65, size // 2, size}:
            first = digest.Md5(blocks=blocks)
            first.update(data[: min(cut, size)])
            second = digest.Md5(first.state, blocks)
            second.update(data[min(cut, size) : size])
            assert first.hexdigest() == hashlib.md5(data[: min(cut, size)]).hexdigest()
            assert second.hexdigest() == hashlib.md5(data[:size]).hexdigest()


def test_no_task_digests_more_than_a_leg_of_a_book(spark, monkeypatch):
    rng = random.Random(5)
    books = {f"b{k}": [rng.choice(["", " ", "Ātmā 𝄞 \n", "x" * rng.randrange(90)]) for _ in range(n)] for k, n in enumerate([1, 2, 30, 700])}
    books |= {"none": ["", None], "late": [""] * 40 + ["a"], "long": ["y" * 5000, "z"], "blank after": ["ab"] + [""] * 600, None: ["one", "two"]}
    rows = [(b, i, t) for b, texts in books.items() for i, t in enumerate(texts)]
    rng.shuffle(rows)
    inner, seen = digest._digest_in_order, []

    def counted(separator):
        run, rows_read = inner(separator), spark.sparkContext.accumulator(0)
        seen.append(rows_read)

        def through(batches):
            for batch in batches:
                rows_read.add(batch.num_rows)
                yield batch

        return lambda batches: run(through(batches))

    monkeypatch.setattr(digest, "_digest_in_order", counted)
    df = spark.createDataFrame(rows, "book_id string, chapter_index int, output string")
    parts = assemble_book(df, part_chars=200, block_rows=4)
    got = {r.book_id: (r.text_hash, r.n_chars, r.pieces) for r in digest.md5_of_parts(parts, id_col="book_id", leg_parts=3).collect()}
    expected = {}
    for b, texts in books.items():
        kept = [t for t in texts if t]
        if kept:
            whole = "\n\n".join(kept)
            expected[b] = (hashlib.md5(whole.encode()).hexdigest(), len(whole), len(kept))
    assert got == expected
    # a leg of a book is three parts and the state before them; many legs were needed
    assert len(seen) > 10 and all(0 < n.value <= 4 * len(books) for n in seen)


def test_book_query_in_many_legs(spark, tmp_path, monkeypatch):
    """The registered query with short parts, a language that is missing and one without text."""
    rows = [(i * 37 % 4001, None if i % 5 == 3 and i < 200 else ["en", "de"][i % 7 == 0], f"Text {i} é" if i % 11 else "") for i in range(4000)]
    rows += [(5000 + i, "fr", "") for i in range(3)]
    folder = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(folder)
    monkeypatch.setattr(state_queries, "PART_CHARS", 100)
    got = [tuple(r) for r in catalog.QUERIES["assemble_book"](spark, str(tmp_path)).orderBy("book_id").collect()]
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{folder}/*.parquet'")
    expected = con.sql(f"select * from ({catalog.ORACLES['assemble_book']}) order by book_id").fetchall()
    assert got == expected and len(got) == 3


def test_parts_do_not_stay_in_the_shared_folder(spark, monkeypatch):
    paths, inner = [], digest.scratch_path
    monkeypatch.setattr(digest, "scratch_path", lambda *args: paths.append(inner(*args)) or paths[-1])
    df = spark.createDataFrame([("b", i, f"text {i}") for i in range(9)], "book_id string, chapter_index int, output string")
    out = digest.md5_of_parts(assemble_book(df, part_chars=10, block_rows=2), id_col="book_id", leg_parts=2)
    assert len(paths) == 1 and not Path(paths[0].removeprefix("file:")).exists()
    whole = "\n\n".join(f"text {i}" for i in range(9))
    assert [tuple(r) for r in out.collect()] == [("b", hashlib.md5(whole.encode()).hexdigest(), len(whole), 9)]


def test_no_text_at_all(spark):
    df = spark.createDataFrame([("b", 1, "")], "book_id string, chapter_index int, output string")
    out = digest.md5_of_parts(assemble_book(df, part_chars=10), id_col="book_id")
    assert out.columns == ["book_id", "text_hash", "n_chars", "pieces"] and out.count() == 0
