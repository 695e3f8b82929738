"""Structured Streaming forms of the stateful operators.

Key-wise last values are streaming aggregations; the token bucket keeps one small state
per key, and the page life-cycle is in :mod:`folioforge.streaming.pages`.  A micro-batch
is bounded by the source options (``maxFilesPerTrigger`` or the broker's offsets per
trigger), so the share of one key in a batch is bounded too.  There are no watermarks,
so no row is too late to count; timers run on processing time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.state import latest_by_key, merge_progress


def live_view_stream(changes: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Latest row per key (update or complete mode)."""
    return latest_by_key(changes, key, order)


def progress_stream(updates: DataFrame, **options) -> DataFrame:
    """Merged progress per (job, stage), update mode."""
    return merge_progress(updates, **options)


def completion_stream(events: DataFrame) -> DataFrame:
    """(job_id, page_num) once per finished page, however often it is finished.

    Count it per job in the sink (:func:`folioforge.operators.transitions.completed_pages`).
    """
    done = events.filter(F.col("event") == "done")
    return done.select("job_id", "page_num").dropDuplicates(["job_id", "page_num"])


def rate_limit_stream(
    requests: DataFrame,
    *,
    key_col: str = "key",
    ts_col: str = "ts",
    id_col: str = "request_id",
    capacity: int = 5,
    refill_seconds: int = 60,
    idle_seconds: int = 7 * 86_400,
) -> DataFrame:
    """Allow/deny requests as they arrive; the state per key is (time when full again).

    A key from which nothing arrives for ``idle_seconds`` is forgotten, which is a
    full bucket; keep it well above the time a full refill takes.
    """
    width = refill_seconds * 1_000_000
    types = {f.name: f.dataType.simpleString() for f in requests.schema.fields}
    schema = (
        f"{key_col} {types[key_col]}, {id_col} {types[id_col]}, {ts_col} timestamp, "
        "allowed boolean, remaining int, retry_after_seconds int"
    )

    def judge(
        key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(batches)).sort_values([ts_col, id_col], kind="stable")
        full_at = state.get[0] if state.exists else None
        verdicts = []
        for ts in pdf[ts_col]:
            now = pd.Timestamp(ts).value // 1000
            start = now if full_at is None else max(full_at, now)
            level = capacity * width - (start - now)
            if level >= width:
                full_at = start + width
                verdicts.append((True, (level - width) // width, 0))
            else:
                verdicts.append((False, 0, -((level - width) // 1_000_000)))
        state.update((full_at,))
        state.setTimeoutDuration(idle_seconds * 1000)
        out = pdf[[key_col, id_col, ts_col]].copy()
        out["allowed"], out["remaining"], out["retry_after_seconds"] = zip(*verdicts, strict=True)
        yield out

    return (
        requests.withColumn(ts_col, F.col(ts_col).cast("timestamp"))
        .groupBy(key_col)
        .applyInPandasWithState(
            judge, schema, "full_at long", "append", GroupStateTimeout.ProcessingTimeTimeout
        )
    )


def run_in_batches(
    stream: DataFrame,
    steps: Sequence[Callable[[DataFrame, int], Any]],
    *,
    checkpoint: str,
    interval: str = "5 seconds",
    once: bool = False,
) -> DataStreamWriter:
    """Drive batch operators from a stream: every micro-batch goes through the steps.

    The batch is persisted for the steps, since each of them reads it.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for step in steps:
                step(batch, batch_id)
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    if once:
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=interval)
