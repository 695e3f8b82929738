from __future__ import annotations

import datetime as dt
import os
import re
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioforge import session
from folioforge.operators.assemble import assemble
from folioforge.operators.ledger import latest, read_ledger, record_pages, with_finished
from folioforge.operators.state import rate_limit
from folioforge.plans import flows
from folioforge.plans.flows import (
    batch_model,
    build_requests,
    chunk_progress,
    secondary_flow,
    translate_flow,
    transliterate_flow,
)
from folioforge.session import cut_lineage, shared_folder
from folioforge.sources.readers import change_feed
from folioforge.streaming import live, pages


def tagged(requests, translation, smoothed):
    if "translated" in requests.columns:
        return requests.withColumn("raw", smoothed)
    return requests.withColumn("raw", translation)


def translated(text):
    return F.concat(F.lit("<translation>"), text, F.lit("</translation><flags><flag>f</flag></flags>"))


def test_smoothing_that_drops_macrons_is_repaired_and_flagged(spark):
    docs = spark.createDataFrame([(1, "the saint said\n“Ātmā jāgo”")], "doc_id int, text string")

    def model(requests):
        plain = F.translate(F.col("translated") if "translated" in requests.columns else F.col("text"), "Āā", "Aa")
        smooth = F.concat(F.lit("<smoothed>"), plain, F.lit("</smoothed>"))
        return tagged(requests, translated(F.col("text")), smooth)

    flow = translate_flow(docs, model)
    row = flow.documents.first()
    assert row.output == "the swami said\n“Ātmā jāgo”"
    assert (row.chunk_count, row.flags_count, row.output_word_count) == (1, 2, 5)
    chunk = flow.chunks.first()
    assert chunk.restored == 3 and not chunk.fallback
    assert chunk.flags[1].startswith("Smoother stripped 3 macrons from verse transliterations")
    assert chunk_progress(flow.chunks).first()["index"] == 0


def test_failed_smoothing_falls_back(spark):
    docs = spark.createDataFrame([(1, "a  saint")], "doc_id int, text string")

    def model(requests):
        return tagged(requests, translated(F.col("text")), F.lit("no tags"))

    for flow in (translate_flow(docs, model), secondary_flow(docs, model)):
        assert flow.chunks.first().fallback
        assert flow.documents.first().output == "a swami"


def test_one_failed_chunk_rejects_its_document(spark):
    long = "\n\n".join(["good " * 299] * 2 + ["bad " * 299])
    docs = spark.createDataFrame([(1, long), (2, "good"), (3, "  ")], "doc_id int, text string")

    def model(requests):
        raw = F.when(F.contains("text", F.lit("bad")), "<translation>").otherwise(
            translated(F.col("text"))
        )
        smooth = F.lit("<smoothed>s</smoothed>")
        return tagged(requests, raw, smooth)

    flow = translate_flow(docs, model)
    assert [r.doc_id for r in flow.documents.collect()] == [2]
    assert {(r.doc_id, r.error) for r in flow.rejects.collect()} == {
        (1, "Missing </translation> closing tag"),
        (3, "No content to translate"),
    }


def test_pages_are_joined_per_job_and_a_failed_page_fails_the_job(spark):
    pages = spark.createDataFrame(
        [("a", 2, "two ī"), ("a", 1, "one “x"), ("a", 3, " "), ("b", 1, "ok"), ("b", 2, "bad")],
        "job_id string, page_num int, text string",
    )

    def model(requests):
        ok = F.concat(F.lit("x <transliteration> "), "text", F.lit(" </transliteration>"))
        return requests.withColumn("raw", F.when(F.col("text") == "bad", "none").otherwise(ok))

    flow = transliterate_flow(pages, model, by="page", id_col="job_id")
    assert [(r.job_id, r.output) for r in flow.documents.collect()] == [("a", "one “x\n\ntwo i")]
    assert [r.job_id for r in flow.rejects.collect()] == ["b"]


def test_batch_model_gets_prompts(spark):
    docs = spark.createDataFrame([(1, "hello")], "doc_id int, text string")

    def answer(prompts: pd.Series) -> pd.Series:
        return "<transliteration>" + prompts.str.upper() + "</transliteration>"

    out = transliterate_flow(docs, batch_model(answer)).documents.first().output
    assert out.startswith("CHUNK 1 OF 1. ") and out.endswith("SOURCE:\nHELLO")


def test_smoother_prompt_has_no_chunk_number(spark):
    df = spark.createDataFrame([("x", 0, 1)], "text string, chunk_index int, chunk_count int")
    assert build_requests(df, "smoother", instruction="Do.").first().prompt == "Do.\n\nx"


def test_lineage_is_cut_into_the_checkpoint_folder(spark):
    cut = cut_lineage(spark.range(3).withColumn("x", F.col("id") * 2))
    assert spark.sparkContext.getCheckpointDir() is not None
    assert "Range" not in cut._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.x for r in cut.collect()) == [0, 2, 4]


def test_rate_limit_stream_carries_its_state_over_batches(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [("u" if i % 5 else "v", start + dt.timedelta(seconds=7 * i), i) for i in range(120)]
    ddl = "key string, ts timestamp, request_id long"
    source = str(tmp_path / "in")
    for part in (rows[:40], rows[40:45], rows[45:]):
        spark.createDataFrame(part, ddl).coalesce(1).write.mode("append").json(source)
    got: dict = {}

    def keep(batch, _):
        for r in batch.collect():
            got[r.request_id] = (r.allowed, r.remaining, r.retry_after_seconds)

    feed = change_feed(spark, source, ddl, files_per_batch=1)
    verdicts = live.rate_limit_stream(feed, capacity=3, refill_seconds=30)
    writer = verdicts.writeStream.outputMode("append").foreachBatch(keep)
    with pages.stream_settings(spark, until_read=True):
        run = writer.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        run.awaitTermination()
    batch = rate_limit(spark.createDataFrame(rows, ddl), capacity=3, refill_seconds=30).collect()
    assert len(run.recentProgress) >= 3
    assert got == {r.request_id: (r.allowed, r.remaining, r.retry_after_seconds) for r in batch}


def test_a_job_of_blank_pages_is_done_with_an_empty_text(spark):
    pages = spark.createDataFrame(
        [("j", 1, " "), ("j", 2, ""), ("k", 1, "words here"), ("k", 2, " "), ("n", 1, None)],
        "doc_id string, page_num int, text string",
    )

    def answer(prompts: pd.Series) -> pd.Series:
        return "<transliteration>" + prompts.str.upper() + "</transliteration>"

    out = transliterate_flow(pages, batch_model(answer), by="page")
    done = {r.doc_id: (r.output, r.chunk_count, r.total_fixes) for r in out.documents.collect()}
    assert done["j"] == ("", 0, 0) and done["n"] == ("", 0, 0) and done["k"][0].endswith("WORDS HERE")
    assert out.rejects.count() == 0


def test_finished_pages_are_not_sent_again(spark, tmp_path):
    ddl = "doc_id string, page_num int, text string"
    pages_in = [("j", 1, "one"), ("j", 2, "two"), ("j", 3, " "), ("k", 1, "bad"), ("k", 2, "good"), ("n", 1, None)]
    sent = str(tmp_path / "sent")

    def answer_but(refused: str):
        def answer(prompts: pd.Series) -> pd.Series:
            texts = prompts.str.split("SOURCE:\n").str[-1]
            texts.to_frame("t").to_json(f"{sent}-{uuid.uuid4().hex}", orient="records", lines=True)
            return texts.map(lambda t: "" if t == refused else f"<transliteration>{t.upper()}</transliteration>")

        return batch_model(answer)

    def seen() -> list[str]:
        found = [f for f in tmp_path.glob("sent-*")]
        texts = sorted(t for f in found for t in pd.read_json(f, lines=True, dtype=str).get("t", []))
        for f in found:
            f.unlink()
        return texts

    path = str(tmp_path / "ledger")
    first = transliterate_flow(spark.createDataFrame(pages_in, ddl), answer_but("bad"), by="page")
    assert {r.doc_id: r.output for r in first.documents.collect()} == {"j": "ONE\n\nTWO", "n": ""}
    assert [r.doc_id for r in first.rejects.collect()] == ["k"]
    for _ in range(2):  # a repeated write replaces the first
        record_pages(first.pages, path, "1")
    assert seen() == ["bad", "good", "one", "two"]
    assert read_ledger(spark, path).count() == 3

    changed = [(d, n, "two again" if t == "two" else t) for d, n, t in pages_in]
    again = transliterate_flow(
        spark.createDataFrame(changed, ddl), answer_but("-"), by="page", finished=read_ledger(spark, path)
    )
    done = {r.doc_id: (r.output, r.chunk_count) for r in again.documents.collect()}
    assert done == {"j": ("ONE\n\nTWO AGAIN", 1), "k": ("BAD\n\nGOOD", 1), "n": ("", 0)}
    assert seen() == ["bad", "two again"]
    record_pages(again.pages, path, "2")

    third = transliterate_flow(
        spark.createDataFrame(changed, ddl), answer_but("-"), by="page", finished=read_ledger(spark, path)
    )
    assert {r.doc_id: (r.output, r.chunk_count) for r in third.documents.collect()} == {
        "j": ("ONE\n\nTWO AGAIN", 0), "k": ("BAD\n\nGOOD", 0), "n": ("", 0),
    }
    assert seen() == [] and third.pages.count() == 0


def test_ledger_rows(spark):
    rows = [("1", "a", 1, "h", "old"), ("2", "a", 1, "h", "new"), ("2", "a", 1, "g", "other"), ("1", "a", 2, "h", " ")]
    ledger = spark.createDataFrame(rows, "run string, doc_id string, page_num int, text_hash string, output string")
    kept = {(r.page_num, r.text_hash): r.output for r in latest(ledger, ["doc_id", "page_num"]).collect()}
    assert kept == {(1, "h"): "new", (1, "g"): "other"}  # the last run; blank results are no results
    pages_in = spark.createDataFrame([(None, 1, "x"), ("a", None, None)], "doc_id string, page_num int, text string")
    found = with_finished(pages_in, ledger, ["doc_id", "page_num"])
    assert found.count() == 2 and found.where("output is not null").count() == 0
    with pytest.raises(ValueError, match="only pages"):
        transliterate_flow(pages_in, pages_in, finished=ledger)


def test_a_cluster_must_name_its_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session())


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_pages_of_many_rows_or_chunks_are_put_together(spark, monkeypatch):
    """The others are finished where they lie, and repeated or broken keys keep their results."""
    long = "\n\n".join(f"word{i} " * 299 for i in range(3))
    rows = [("j", 1, "One. Two."), ("j", 1, "One. Two."), ("j", 2, "b"), ("j", 2, "a"), ("j", 3, "saint"), ("j", 4, " ")]
    rows += [("k", 1, long), ("l", 1, "fine"), ("l", 2, "bad"), ("l", 3, "bad"), ("l", 3, "good")]
    rows += [("n", None, "x"), ("n", None, "y"), (None, 1, "z")]
    joined = []

    def put_together(df, **options):
        joined.extend((r.doc_id, r.page_num) for r in df.collect())
        return assemble_chunks(df, **options)

    assemble_chunks = flows.assemble_chunks
    monkeypatch.setattr(flows, "assemble_chunks", put_together)

    def model(requests):
        ok = F.concat(F.lit("<transliteration>"), "text", F.lit("</transliteration>"))
        return requests.withColumn("raw", F.when(F.col("text") != "bad", ok))

    out = transliterate_flow(spark.createDataFrame(rows, "doc_id string, page_num int, text string"), model, by="page")
    done = {r.doc_id: (r.output, r.chunk_count) for r in out.documents.collect()}
    assert done.pop("k")[1] == 2
    assert done == {"j": ("One. Two.\n\n\n\na\n\nb\n\nswami", 5), "n": ("x\n\ny", 2), None: ("z", 1)}
    assert [r.doc_id for r in out.rejects.collect()] == ["l"]
    assert sorted((r.page_num, r.output) for r in out.pages.where("doc_id = 'l'").collect()) == [(1, "fine")]
    assert out.pages.where("doc_id = 'j'").count() == 4 and out.chunks.count() == 10
    assert {*joined} == {("j", 1), ("j", 2), ("k", 1), ("n", None)}


def test_pages_dealt_by_key_meet_their_ledger_in_place(spark, monkeypatch):
    keys = ["doc_id", "page_num"]
    ddl = "run string, doc_id string, page_num int, text_hash string, output string"
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pages_in = spark.createDataFrame([("a", 1, "x")], "doc_id string, page_num int, text string")
        ledger = spark.createDataFrame([("1", "a", 1, "h", "old")], ddl).repartition(5, *keys)
        assert _plan(with_finished(pages_in.repartition(5, *keys), ledger, keys)).count("Exchange") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_keys_of_one_block_are_not_dealt_out_for_the_fold(spark):
    rows = [(f"d{i}", o, f"t{o}") for i in range(3) for o in range(1 + 300 * (i == 2))] + [("e", 700, "late"), ("f", -1, "m"), ("f", 0, "n")]
    joined = assemble(spark.createDataFrame(rows, "doc_id string, chunk_index int, text string"))
    assert not re.search(r"hashpartitioning\(key#\d+, \d+\)", _plan(joined))
    got = {r.doc_id: (r.text, r.pieces) for r in joined.collect()}
    assert got.pop("d2") == ("\n\n".join(f"t{o}" for o in range(301)), 301)
    assert got == {"d0": ("t0", 1), "d1": ("t0", 1), "e": ("late", 1), "f": ("m\n\nn", 2)}


def test_written_tables_are_known_to_go_at_the_end(spark, monkeypatch):
    """They are named for deletion once they are there; before, Hadoop refuses to note them."""
    noted = []
    monkeypatch.setattr(session, "delete_at_end", lambda spark, path: noted.append(os.path.exists(path.removeprefix("file:"))))
    assert session.written(spark.range(3), compression="zstd").count() == 3 and noted[-1]
