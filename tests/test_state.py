from __future__ import annotations

import datetime as dt
import time
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

import plainpy
from folioforge.functions.page_machine import START, advance
from folioforge.operators.state import (
    exhausted_jobs,
    merge_progress,
    page_states,
    rate_limit,
    single_passes,
    stale_claims,
)
from folioforge.operators.transitions import completed_pages
from folioforge.sources.exports import export_training_json, export_txt, write_txt
from folioforge.sources.readers import (
    change_feed,
    read_json_table,
    read_small_text,
    read_table,
    read_text_corpus,
)
from folioforge.schemas import PAGE_EVENTS_DDL, REVIEWS_DDL
from folioforge.streaming import live, pages

T0 = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize(
    ("capacity", "refill", "gap"), [(5, 60, 20), (2, 10, 3), (1, 10, 5), (3, 7, 30), (5, 60, 0.1)]
)
def test_rate_limit_matches_replay(spark, capacity, refill, gap):
    rng = random.Random(capacity * refill)
    rows, rid = [], 0
    for k in range(6):
        t = 1_700_000_000_000_000
        for _ in range(rng.choice([1, 50, 600])):
            steps = [0, 1, 500_000, int(rng.expovariate(1 / gap) * 1e6), refill * 1_000_000]
            t += rng.choice(steps)
            rows.append((f"k{k}", t, rid))
            rid += 1
    df = spark.createDataFrame(rows, "key string, us long, request_id long")
    df = df.withColumn("ts", F.timestamp_micros("us"))
    out = rate_limit(df, capacity=capacity, refill_seconds=refill).collect()
    got = {r.request_id: (r.allowed, r.remaining, r.retry_after_seconds) for r in out}
    assert got == plainpy.bucket(rows, capacity, refill * 1_000_000)


def page_event_rows(seed: int, hot: int):
    rng, rows, seq = random.Random(seed), [], 0
    for job in range(3):
        for page in range(4):
            for _ in range(hot if (job, page) == (1, 2) else rng.choice([1, 3, 20])):
                event = rng.choice(["claim", "claim", "done", "error", "retry", "reap"])
                at = T0 + dt.timedelta(seconds=seq // 3)
                rows.append((f"j{job}", page, event, f"w{seq % 5}", f"e{seq}", at, seq))
                seq += 1
    return rows


PAGE_DDL = f"{PAGE_EVENTS_DDL}, seq long"


@pytest.mark.parametrize(("capacity", "split"), [(1, 5), (1, 10**6), (2, 3), (4, 50)])
def test_rate_limit_of_a_hot_key_with_repeated_requests(spark, capacity, split):
    rng = random.Random(capacity)
    rows, at = [], T0
    for i in range(1500):
        at += dt.timedelta(milliseconds=rng.choice([0, 1, 40, 700, 2500, 30_000]))
        rows.append(("hot" if i % 3 else f"k{i % 9}", at, i))
    df = spark.createDataFrame(rows, "key string, ts timestamp, request_id long")
    twice = df.union(df.where("request_id % 4 = 0"))
    out = rate_limit(twice.repartition(7), capacity=capacity, refill_seconds=7, split_rows=split).collect()
    assert len(out) == 1875
    got = {r.request_id: (r.allowed, r.remaining, r.retry_after_seconds) for r in out}
    micros = [(k, (t - T0) // dt.timedelta(microseconds=1), i) for k, t, i in rows]
    assert got == plainpy.bucket(micros, capacity, 7_000_000)


def test_passing_times_over_many_ranges(spark):
    """One key over eight ranges: each is walked from where the one before really ended."""
    rng = random.Random(1)
    times = sorted({rng.randrange(0, 200_000) for _ in range(4000)})
    keyed = spark.createDataFrame([("a", 5), *[("b", t) for t in times], ("c", 7)], "k string, __s long")
    for width in (3, 170, 5_000, 10**9):
        want, x = [], None
        for t in times:
            if x is None or t >= x:
                want.append(t)
                x = t + width
        got = sorted(r[1] for r in single_passes(keyed, width).collect() if r[0] == "b")
        assert got == want


@pytest.mark.parametrize("reset", [True, False])
def test_page_states_match_replay_with_a_hot_page(spark, reset):
    rows = page_event_rows(3, hot=3000)
    df = spark.createDataFrame(rows, PAGE_DDL)
    expected: dict = {}
    for job, page, event, worker, error, at, _ in rows:
        state = expected.get((job, page), START)
        expected[(job, page)] = advance(state, event, worker, error, at, reset)
    got = {(r.job_id, r.page_num): r for r in page_states(df, reset_attempts=reset).collect()}
    assert got.keys() == expected.keys()
    for key, s in expected.items():
        r = got[key]
        assert (r.status, r.attempts, r.claimed_by, r.claimed_at, r.error) == (
            s[0], s[1], s[3], s[4], s[6],
        )


def test_three_failed_attempts_fail_the_job(spark):
    steps = [("claim", None), ("error", "e1")] * 3
    rows = [("j", 1, e, "w", msg, T0 + dt.timedelta(seconds=i), i) for i, (e, msg) in enumerate(steps)]
    states = page_states(spark.createDataFrame(rows, PAGE_DDL))
    assert (states.first().status, states.first().attempts) == ("ocr_failed", 3)
    assert exhausted_jobs(states).first().error == "Page 1 OCR failed after 3 attempts: e1"


def test_stale_claims(spark):
    rows = [("j", 1, "ocr_running", "w", T0), ("j", 2, "ocr_running", "w", T0 + dt.timedelta(minutes=5))]
    df = spark.createDataFrame(
        rows, "job_id string, page_num int, status string, claimed_by string, claimed_at timestamp"
    )
    out = stale_claims(df, T0 + dt.timedelta(minutes=11)).orderBy("page_num").collect()
    assert [(r.status, r.claimed_by) for r in out] == [("pending", None), ("ocr_running", "w")]


def test_progress_keeps_omitted_fields(spark):
    rows = [
        ("j", "translator", "running", 1, None, T0, 1),
        ("j", "translator", None, 2, 5, T0, 2),
        ("j", "translator", "done", None, None, T0, 3),
    ]
    df = spark.createDataFrame(
        rows, "job_id string, stage string, status string, completed int, total int, ts timestamp, seq int"
    )
    out = merge_progress(df, fields=["status", "completed", "total"]).first()
    assert tuple(out) == ("j", "translator", "done", 2, 5)


def test_finishing_a_page_twice_counts_once(spark):
    df = spark.createDataFrame([("j", 1), ("j", 1), ("j", 2)], "job_id string, page_num int")
    assert completed_pages(df).first().pages_completed == 2


def _stream_rows(spark, path, rows, ddl):
    spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").json(path)


def _run_pages(spark, tmp_path, steps, ddl=f"{PAGE_EVENTS_DDL}, seq long", batch=0, **options):
    """(batch rows so far) after every step: rows to add, or seconds to wait first."""
    source, seen = str(tmp_path / "in"), []
    if not batch:
        (tmp_path / "in").mkdir()

    def collect(batch, _):
        seen.extend((r.job_id, r.page_num, r.status, r.claimed_by) for r in batch.collect())

    states = pages.page_state_stream(change_feed(spark, source, ddl), **options)
    for wait, rows in steps:
        time.sleep(wait)
        _stream_rows(spark, source, rows, ddl)
        writer = states.writeStream.outputMode("update").foreachBatch(collect)
        with pages.stream_settings(spark, until_read=True):
            run = writer.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            run.awaitTermination()
    return seen


def test_stream_frees_stale_claims(spark, tmp_path):
    late = T0 + dt.timedelta(hours=2)
    steps = [
        (0, [("j", 1, "claim", "w", None, T0, 1)]),
        (3, [("j", 2, "claim", "w", None, late, 2)]),
    ]
    seen = _run_pages(spark, tmp_path, steps, stale_seconds=1)
    assert ("j", 1, "ocr_running", "w") in seen
    assert seen.index(("j", 1, "pending", None)) > seen.index(("j", 1, "ocr_running", "w"))
    assert ("j", 2, "pending", None) not in seen


@pytest.mark.parametrize("bucket", [2, 256])
def test_stream_keeps_late_events(spark, tmp_path, bucket):
    at = lambda minutes: T0 + dt.timedelta(minutes=minutes)
    steps = [
        (0, [("j", 1, "claim", "w", None, at(0), 1)]),
        (0, [("j", 2, "claim", "w", None, at(60), 9)]),
        (0, [("j", 1, "done", "w", None, at(2), 2), ("j", 2, "error", "w", "x", at(61), 10)]),
        # an older claim of the finished page, and an older retry of the failed one
        (0, [("j", 1, "claim", "v", None, at(1), 0), ("j", 2, "claim", "u", None, at(60), 11)]),
        # an error of the first attempt, a month late
        (0, [("j", 1, "error", "w", "late", at(1), 1), ("j", 1, "done", "w", None, at(50_000), 20)]),
        (0, [("j", 1, "error", "w", "later", at(40_000), 15)]),
    ]
    seen = _run_pages(spark, tmp_path, steps, bucket_events=bucket)
    last = {page: (status, by) for _, page, status, by in seen}
    assert last[1][0] == "ocr_done"
    assert last[2][0] == "pending"


@pytest.mark.parametrize("bucket", [1, 4, 256])
def test_stream_equals_batch_after_every_batch(spark, tmp_path, bucket):
    """Events in random order, with null times, in many buckets."""
    rng = random.Random(bucket)
    rows = page_event_rows(5, hot=60)[-150:]
    rows = [(*r[:5], None if i % 29 == 0 else r[5], r[6]) for i, r in enumerate(rows)]
    rng.shuffle(rows)
    parts = [rows[:50], rows[50:90], rows[90:]]
    (tmp_path / "all").mkdir()
    so_far: list = []
    for n, part in enumerate(parts):
        so_far += part
        seen = _run_pages(spark, tmp_path / "all", [(0, part)], bucket_events=bucket, stale_seconds=10**9, batch=n)
        want = {(r.job_id, r.page_num): (r.status, r.claimed_by) for r in page_states(spark.createDataFrame(so_far, PAGE_DDL)).collect()}
        got = {r[:2]: r[2:] for r in seen}
        assert got and all(want[k] == v for k, v in got.items())
        assert set(got) == {(r[0], r[1]) for r in part}


class _Store:
    """A state store of one key that counts how often it is asked."""

    def __init__(self):
        self.values, self.asked, self.timers = {}, 0, set()

    def getValueState(self, name, *schemas):  # noqa: N802
        return _Held(self, name)

    getMapState = getValueState  # noqa: N815

    def registerTimer(self, at):  # noqa: N802
        self.asked += 1
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.asked += 1
        self.timers.remove(at)


class _Held:
    def __init__(self, store, name):
        self.store, self.name = store, name

    def _ask(self):
        self.store.asked += 1
        return self.store.values

    def get(self):
        return self._ask().get(self.name)

    def update(self, value):
        self._ask()[self.name] = value

    def clear(self):
        self._ask().pop(self.name, None)

    def exists(self):
        return self.name in self._ask()

    def getValue(self, key):  # noqa: N802
        return self._ask()[self.name, key]

    def updateValue(self, key, value):  # noqa: N802
        self._ask()[self.name, key] = value

    def removeKey(self, key):  # noqa: N802
        self._ask().pop((self.name, key), None)

    def containsKey(self, key):  # noqa: N802
        return (self.name, key) in self._ask()

    def iterator(self):
        return iter([(k[1], v) for k, v in self._ask().items() if isinstance(k, tuple)])


class _Now:
    def getCurrentProcessingTimeInMs(self):  # noqa: N802
        return 1000


def test_a_page_of_one_bucket_asks_the_store_little():
    store = _Store()
    page = pages.PageStates(True, 600, 4)
    page.init(store)
    told = lambda *events: list(page.handleInputRows(("j", 1), iter([("j", 1, *e) for e in events]), _Now()))[0]
    first = told((0, 1, "claim", "w", None))
    assert (first.status, first.claimed_at, store.asked, store.timers) == ("ocr_running", 0, 3, {601_000})
    late = told((5, 3, "error", "w", "x"), (4, 2, "done", "w", None))
    assert (late.status, late.error, store.asked, store.timers) == ("pending", "x", 6, set())
    for n in range(6, 26):  # the page grows into many buckets and stays the fold of all
        got = told((n, n, ("claim", "error", "retry")[n % 3], f"w{n}", f"e{n}"))
    assert sum(isinstance(k, tuple) for k in store.values) > 4
    state = START
    for n, event in [(0, "claim"), (4, "done"), (5, "error")]:
        state = advance(state, event, "w", "x" if n == 5 else None, n)
    for n in range(6, 26):
        state = advance(state, ("claim", "error", "retry")[n % 3], f"w{n}", f"e{n}", n)
    assert (got.status, got.attempts, got.claimed_by, got.claimed_at, got.error) == (*state[:2], state[3], state[4], state[6])


def test_a_job_without_exhausted_pages_is_asked_once():
    store, job = _Store(), pages.JobFailures()
    job.init(store)
    row = lambda page, status, attempts, error: Row(page_num=page, status=status, attempts=attempts, error=error)
    told = lambda *rows: list(job.handleInputRows(("j",), iter(rows), _Now()))
    assert told(*[row(n, "ocr_done", 1, None) for n in range(50)]) == [] and store.asked == 1
    assert [r.page_num for r in told(row(7, "ocr_failed", 3, "x"), row(3, "ocr_failed", 3, "y"))] == [3]
    assert told(row(9, "ocr_failed", 3, "z"), row(7, "pending", 0, None)) == []
    assert [(r.page_num, r.status) for r in told(row(3, "pending", 0, None))] == [(9, "failed")]
    assert [(r.page_num, r.status) for r in told(row(9, "pending", 0, None))] == [(9, "ocr_running")]
    asked = store.asked
    assert told(row(9, "ocr_done", 1, None)) == [] and store.asked == asked + 1


def test_job_fails_once_in_the_stream(spark, tmp_path):
    at = lambda i: T0 + dt.timedelta(minutes=i)
    tries = lambda page, first, n: [
        ("j", page, kind, "w", f"e{first + i}" if kind == "error" else None, at(first + i), first + i)
        for i, kind in enumerate(["claim", "error"] * n)
    ]
    batches = [
        tries(2, 0, 2),
        [("k", 1, "claim", "w", None, at(1), 1)],
        tries(2, 10, 1),  # the third attempt
        tries(3, 20, 3),  # a higher page changes nothing
        tries(1, 40, 3),  # a lower one is reported
        [("j", 1, "retry", None, None, at(60), 60), ("j", 2, "retry", None, None, at(61), 61)],
        [("j", 3, "retry", None, None, at(62), 62)],
    ]
    source, told = str(tmp_path / "in"), []
    (tmp_path / "in").mkdir()
    states = pages.page_state_stream(change_feed(spark, source, PAGE_DDL), stale_seconds=10**9, output_mode="append")

    def collect(batch, _):
        told.extend((r.job_id, r.page_num, r.status, r.error) for r in batch.collect())

    for rows in batches:
        _stream_rows(spark, source, rows, PAGE_DDL)
        with pages.stream_settings(spark, until_read=True):
            writer = pages.job_failure_stream(states).writeStream.outputMode("append").foreachBatch(collect)
            writer.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert told == [
        ("j", 2, "failed", "Page 2 OCR failed after 3 attempts: e11"),
        ("j", 1, "failed", "Page 1 OCR failed after 3 attempts: e45"),
        ("j", 3, "failed", "Page 3 OCR failed after 3 attempts: e25"),
        ("j", 3, "ocr_running", None),
    ]


def _days_reversed():
    """Events days apart, newest first: pages 0 and 1 end done, page 2 is mixed."""
    kinds = ["claim", "error", "claim", "done"]
    rows = [("j", p, kinds[i % 4], f"w{i}", f"e{i}", T0 + dt.timedelta(days=2 * i), i) for p in (0, 1) for i in range(8)]
    rng = random.Random(4)
    rows += [("j", 2, rng.choice(kinds + ["retry"]), f"w{i}", f"e{i}", T0 + dt.timedelta(hours=9 * i), i) for i in range(60)]
    return rows[::-1]


def test_stream_settles_after_the_whole_batch(spark, tmp_path):
    """Every Arrow chunk holds one row, so a key's rows come in many chunks."""
    rows = _days_reversed()
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "1")
    try:
        seen = _run_pages(spark, tmp_path, [(0, rows)])
    finally:
        spark.conf.set(key, before)
    want = page_states(spark.createDataFrame(rows, PAGE_DDL)).collect()
    assert {r[:2]: r[2:] for r in seen} == {(r.job_id, r.page_num): (r.status, r.claimed_by) for r in want}


def test_micro_batch_driver_runs_all_steps(spark, tmp_path):
    source = str(tmp_path / "in")
    _stream_rows(spark, source, page_event_rows(1, 5), PAGE_DDL)
    counts: dict = {}
    steps = [
        lambda batch, i: counts.__setitem__("rows", batch.count()),
        lambda batch, i: counts.__setitem__("pages", batch.select("job_id", "page_num").distinct().count()),
    ]
    feed = change_feed(spark, source, PAGE_DDL)
    run = live.run_in_batches(feed, steps, checkpoint=str(tmp_path / "cp"), once=True).start()
    run.awaitTermination()
    assert counts["pages"] == 12 and counts["rows"] >= 12


def test_readers(spark, tmp_path):
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts" / "a.txt").write_text("line one\nline ક", encoding="utf-8")
    rows = read_text_corpus(spark, str(tmp_path / "texts")).collect()
    assert rows[0].text == "line one\nline ક" and rows[0].doc_id.endswith("a.txt")
    assert read_small_text(spark, str(tmp_path / "texts" / "a.txt")).startswith("line one")
    with pytest.raises(ValueError):
        read_small_text(spark, str(tmp_path / "texts" / "a.txt"), max_bytes=3)
    lines = [
        '{"translation_id":"t","review_id":"r","section_index":1,"created_at":"2024-01-01T00:00:00.000Z","extra":5}',
        '{"translation_id":"t","section_index":"not a number"}',
    ]
    (tmp_path / "reviews.json").write_text("\n".join(lines))
    valid, rejects = read_json_table(spark, str(tmp_path / "reviews.json"), REVIEWS_DDL)
    assert valid.first().created_at == T0 and valid.count() == 1
    assert "not a number" in rejects.first().line
    valid.write.parquet(str(tmp_path / "reviews"))
    assert read_table(spark, str(tmp_path / "reviews"), f"{REVIEWS_DDL}, added int").first().added is None


def test_text_export(spark, tmp_path):
    df = spark.createDataFrame(
        [("t1", "Title", " body ", [(1, "o", "t", ["f2"]), (0, "o", "t", ["f1"]), (2, "o", "t", [])]), ("t2", None, "x", None)],
        "translation_id string, chapter_title string, output string, "
        "chunk_data array<struct<index:int,original:string,translation:string,flags:array<string>>>",
    )
    bodies = {r.translation_id: r.body for r in export_txt(df).collect()}
    assert bodies["t2"] == "x"
    head, _, appendix = bodies["t1"].partition("\n\n\n")
    assert head == "Title\n—————\n\nbody"
    assert "2 self-flags across 2 sections" in appendix
    assert appendix.index("Section 1\n  • f1") < appendix.index("Section 2\n  • f2")
    write_txt(export_txt(df).coalesce(1), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert text.count("\n\f\n") == 2


def test_training_export_splits_long_threads(spark):
    translations = spark.createDataFrame(
        [("hot", "p", 1, 2, 0, "c", "out"), ("none", "p", 1, 2, 0, None, None)],
        "translation_id string, input_preview string, input_word_count int, output_word_count int, "
        "flags_count int, chapter_title string, output string",
    )
    reviews = spark.createDataFrame(
        [("hot", f"r{i}", f"c{i}", T0 + dt.timedelta(seconds=i)) for i in range(100)],
        "translation_id string, review_id string, comment string, created_at timestamp",
    )
    out = export_training_json(
        translations, reviews, exported_at=T0, exported_by="me", reviews_per_row=30
    ).collect()
    parts = [r.reviews for r in out if r.translation_id == "hot"]
    assert len(parts) == 4 and sum(map(len, parts)) == 100
    in_order = [r.reviews for r in sorted((r for r in out if r.translation_id == "hot"), key=lambda r: r.part)]
    assert [x.review_id for p in in_order for x in p] == [f"r{i}" for i in range(100)]
    assert [len(p) for p in in_order] == [30, 30, 30, 10]
    assert [len(r.reviews) for r in out if r.translation_id == "none"] == [0]
