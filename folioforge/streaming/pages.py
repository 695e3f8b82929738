"""Page life-cycle and job failure as Structured Streaming operators, exact however late.

A page's events lie in buckets: runs of at most ``BUCKET_EVENTS`` consecutive events in
order of (ts, seq). The state store holds every bucket under its own key, and for the page
one index with each bucket's first place and its outcome for every state it may be entered
in. An event, late or not, is put into the bucket of its place, only that bucket is folded
again, and the outcomes are composed in order. So a page equals the batch fold of all its
events after every micro-batch, and nothing is ever dropped or settled out of order.

What a page holds in memory at once is its index, ``CHUNK_EVENTS`` new events and one
bucket; all its events stay in the state store, on disk, as the log from which a bucket is
folded again. The index has one entry per bucket, at least half a bucket of events each.
Most pages are one bucket; its events lie beside the index, so that a micro-batch costs
such a page one read and one write. Nothing comes before the first bucket, so it is folded
for the starting state alone.
Timers run on processing time: no watermark, so no clock that steps back can drop a row.

These operators need the RocksDB state store (:func:`stream_settings`).
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import batched
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.page_machine import FAILED, MAX_ATTEMPTS, RUNNING, STALE_SECONDS, START, advance, entries

PAGE_STATE = (
    "job_id string, page_num int, status string, attempts int, claimed_by string, "
    "claimed_at timestamp, error string"
)
#: As the processor tells it, with the time in microseconds.
_PAGE_ROW = PAGE_STATE.replace("claimed_at timestamp", "claimed_at long")
JOB_STATE = "job_id string, page_num int, status string, error string"
#: Most events of a bucket; one that grows beyond is cut into halves of it.
BUCKET_EVENTS = 256
#: New events of a page that are put into its buckets together.
CHUNK_EVENTS = 10_000
#: After every event of the same time.
_LAST = 1 << 62
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


@contextmanager
def stream_settings(spark: SparkSession, until_read: bool = False) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB; settings return afterwards.

    ``until_read`` is for a trigger that stops when all input is read: without it, timers
    on processing time ask for one more empty batch for ever.
    """
    wanted = {_PROVIDER: _ROCKSDB} | ({_EMPTY_BATCHES: "false"} if until_read else {})
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


_ENTRIES = entries()
_ENTRY = {(s[0], s[1]): i for i, s in enumerate(_ENTRIES)}


def _place(event: list) -> list:
    return [event[0] is not None, event[0] or 0, event[1]]


def _outcomes(events: list[list], entered: list[tuple], reset_attempts: bool) -> list:
    """What a run of events does: the different outcomes, and which one each entry has."""
    states, chosen = list(entered), list(range(len(entered)))
    for ts, _, event, worker, error in events:
        moved = [advance(s, event, worker, error, ts, reset_attempts) for s in states]
        states = list(dict.fromkeys(moved))
        if len(states) < len(moved):
            place = {s: i for i, s in enumerate(states)}
            chosen = [place[moved[i]] for i in chosen]
    return [[list(s) for s in states], chosen]


def _composed(index: list[list]) -> tuple:
    """(status, attempts, claimed_by, claimed_at, error) after all buckets."""
    status, attempts, _, by, at, _, error = START
    for n, (_, _, (different, chosen)) in enumerate(index):
        entry = _ENTRY[status, attempts] if n else 0
        status, attempts, claim_known, b, a, error_known, e = different[chosen[entry]]
        by, at = (b, a) if claim_known else (by, at)
        error = e if error_known else error
    return status, attempts, by, at, error


class PageStates(StatefulProcessor):
    """The state of one page, and the timer that frees a stale claim."""

    def __init__(self, reset_attempts: bool, stale_seconds: int, bucket_events: int) -> None:
        self.reset_attempts, self.stale_seconds, self.bucket_events = reset_attempts, stale_seconds, bucket_events

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.page = handle.getValueState("page", "held string")
        self.events = handle.getMapState("events", "bucket long", "events string")

    def _held(self) -> list:
        """[time of the timer, index, events of the only bucket]; other events are in the map.

        An entry of the index is [place of the first event, bucket, outcomes].
        """
        held = self.page.get()
        return json.loads(held[0]) if held else [None, [], []]

    def _put(self, page: list, new: list[list]) -> None:
        """Put events into the buckets of their places and fold those again."""
        new.sort(key=_place)
        _, index, only = page
        firsts = [entry[0] for entry in index]
        alone = len(index) < 2
        touched: dict[int, list[list]] = {}
        if alone:
            touched[0] = new
        else:
            for event in new:
                touched.setdefault(max(bisect_right(firsts, _place(event)) - 1, 0), []).append(event)
        number = max((entry[1] for entry in index), default=-1)
        for at in sorted(touched, reverse=True):  # from the end, so that places before stay
            held = only if alone else json.loads(self.events.getValue((index[at][1],))[0])
            held = sorted([*held, *touched[at]], key=_place)
            size = len(held) if len(held) <= self.bucket_events else max(self.bucket_events // 2, 1)
            made = []
            for low in range(0, len(held), size):
                part = held[low : low + size]
                bucket = index[at][1] if index and low == 0 else (number := number + 1)
                if not alone or size < len(held):
                    self.events.updateValue((bucket,), (json.dumps(part),))
                entered = _ENTRIES if at or low else [START]
                made.append([_place(part[0]), bucket, _outcomes(part, entered, self.reset_attempts)])
            index[at : at + 1] = made
            page[2] = held if alone and len(made) == 1 else []

    def _told(self, key: tuple, page: list, now: int) -> Row:
        status, attempts, by, at, error = _composed(page[1])
        if page[0] is not None:
            self.handle.deleteTimer(page[0])
        page[0] = now + self.stale_seconds * 1000 if status == RUNNING else None
        if page[0] is not None:
            self.handle.registerTimer(page[0])
        self.page.update((json.dumps(page),))
        return Row(
            job_id=key[0], page_num=key[1], status=status, attempts=attempts, claimed_by=by, claimed_at=at, error=error
        )

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        page = self._held()
        for some in batched(rows, CHUNK_EVENTS):
            self._put(page, [list(row[2:]) for row in some])
        yield self._told(key, page, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        page = self._held()
        page[0] = None  # the timer that expired is deleted by Spark
        status, _, _, at, _ = _composed(page[1])
        if status == RUNNING:
            due = None if at is None else at + self.stale_seconds * 1_000_000
            self._put(page, [[due, _LAST, "reap", None, None]])
            yield self._told(key, page, timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def page_state_stream(
    events: DataFrame,
    *,
    reset_attempts: bool = True,
    stale_seconds: int = STALE_SECONDS,
    bucket_events: int = BUCKET_EVENTS,
    output_mode: str = "update",
) -> DataFrame:
    """Current state of every page that changed; stale claims go back to pending.

    The state is the fold of all events so far in order of (ts, seq), in whatever order
    they arrive. A claim without a further event for ``stale_seconds`` after it arrived is
    freed, as an event at the time it went stale.
    """
    seq = F.coalesce(F.col("seq").cast("long"), F.lit(0)) if "seq" in events.columns else F.lit(0)
    narrow = events.select(
        "job_id",
        "page_num",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"),
        seq.alias("seq"),
        "event",
        "worker",
        "error",
    )
    told = narrow.groupBy("job_id", "page_num").transformWithState(
        PageStates(reset_attempts, stale_seconds, bucket_events), _PAGE_ROW, output_mode, "ProcessingTime"
    )
    return told.withColumn("claimed_at", F.timestamp_micros("claimed_at"))


class JobFailures(StatefulProcessor):
    """The pages of one job that used up their attempts, and what was last said of the job."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.spent = handle.getMapState("spent", "page_num int", "error string")
        self.told = handle.getValueState("told", "page_num int, error string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        told = self.told.get()
        before = tuple(told) if told else None
        some, changed = before is not None, False  # a job told as failed has exhausted pages, another one none
        for row in rows:
            page = (row.page_num,)
            if row.status == FAILED and row.attempts >= MAX_ATTEMPTS:
                self.spent.updateValue(page, (row.error,))
                some = changed = True
            elif some:
                self.spent.removeKey(page)
                changed = True
        if not changed:
            return
        worst = min(((k[0], v[0]) for k, v in self.spent.iterator()), key=lambda s: s[0], default=None)
        if worst == before:
            return
        if worst is None:
            self.told.clear()
            row = (key[0], before[0], "ocr_running", None)
        else:
            self.told.update(worst)
            why = f"Page {worst[0]} OCR failed after {MAX_ATTEMPTS} attempts: {(worst[1] or '')[:200]}"
            row = (key[0], worst[0], "failed", why)
        yield Row(**dict(zip(["job_id", "page_num", "status", "error"], row, strict=True)))

    def close(self) -> None:
        pass


def job_failure_stream(pages: DataFrame) -> DataFrame:
    """A row when a job fails since one of its pages used up its attempts (the lowest such
    page is reported), when another page becomes the lowest, and when a retry reopens the
    job. A job that stays failed is told once.

    ``pages`` is :func:`page_state_stream` in append mode; both operators run in one query.
    State per job: its exhausted pages. A page's rows reach its job in the order of the
    micro-batches, one per batch.
    """
    narrow = pages.select("job_id", "page_num", "status", "attempts", "error")
    return narrow.groupBy("job_id").transformWithState(JobFailures(), JOB_STATE, "append", "None")


def newest_states(rows: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Of the written rows of a stream the newest one per page."""
    newest = F.max_by(F.struct("status", "attempts", "claimed_by", "claimed_at", "error"), batch)
    return rows.groupBy("job_id", "page_num").agg(newest.alias("s")).select("job_id", "page_num", "s.*")
