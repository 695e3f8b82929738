"""Batch forms of the stateful operators.

None of them gathers one key's history in a group: last values are combinable
aggregates, page states are folded per sorted range and then composed, and the token
bucket only folds one summary row per key and refill interval.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence
from datetime import datetime

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.page_machine import MAX_ATTEMPTS, STALE_SECONDS, START, advance, entries
from ..functions.text import let
from ..session import cut_lineage

# --- latest row, merged progress ---------------------------------------------------


def latest_by_key(changes: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The latest version of every row of a change log."""
    rest = [c for c in changes.columns if c != key]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")
    return changes.groupBy(key).agg(newest).select(key, "__row.*")


def live_view(changes: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """:func:`latest_by_key` of a table, newest first: a group limit before the shuffle."""
    newest = F.row_number().over(W.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    rest = [c for c in changes.columns if c != key]
    latest = changes.withColumn("__rn", newest).where("__rn = 1").select(key, *rest)
    return latest.orderBy(*[F.desc(c) for c in order], key)


def last_known(field: str, order: Column) -> Column:
    """Last non-null value of a field (an update that omits a field keeps the old one)."""
    known = F.col(field).isNotNull()
    return F.max_by(F.when(known, F.col(field)), F.when(known, order)).alias(field)


def merge_progress(
    updates: DataFrame,
    *,
    keys: Sequence[str] = ("job_id", "stage"),
    fields: Sequence[str] = ("status", "completed", "total", "chunk_count", "total_fixes"),
    order: Sequence[str] = ("ts", "seq"),
) -> DataFrame:
    """Deep merge of partial updates: per key, every field keeps its last given value."""
    at = F.struct(*order)
    return updates.groupBy(*keys).agg(*[last_known(f, at) for f in fields])


# --- page life-cycle ---------------------------------------------------------------

_OUTCOME = (
    "struct<entry:string,status:string,attempts:int,claim_known:boolean,claimed_by:string,"
    "claimed_at:timestamp,error_known:boolean,error:string>"
)


def page_states(
    events: DataFrame, *, reset_attempts: bool = True, order: Sequence[str] = ("ts", "seq")
) -> DataFrame:
    """State of every page after all its events (job_id, page_num, event, worker, error, …).

    Events are range-partitioned by (job, page, time), so even one page with a large
    share of all events is spread over many tasks.  A task streams through its sorted
    range.  Only the first page of a range can have earlier events elsewhere: for it the
    outcome of every possible entry state is kept; all other pages start afresh.  One
    small row per page and range is then composed in time order.
    """
    keys = ["job_id", "page_num"]
    cols = events.select(*keys, "event", "worker", "error", *order)
    ordered = cols.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    types = {f.name: f.dataType.simpleString() for f in cols.schema.fields}
    at_type = ", ".join(f"{c}:{types[c]}" for c in order)
    schema = (
        f"job_id {types['job_id']}, page_num {types['page_num']}, "
        f"run struct<{at_type}>, outcomes array<{_OUTCOME}>"
    )

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, run, states, fresh_range = None, None, {}, True

        def flush() -> dict:
            outcomes = []
            for entry, s in states.items():
                at = None if s[4] is None or pd.isna(s[4]) else s[4]
                outcomes.append(
                    {
                        "entry": f"{entry[0]}:{entry[1]}",
                        "status": s[0],
                        "attempts": s[1],
                        "claim_known": s[2],
                        "claimed_by": s[3],
                        "claimed_at": at,
                        "error_known": s[5],
                        "error": s[6],
                    }
                )
            return {"job_id": key[0], "page_num": key[1], "run": run, "outcomes": outcomes}

        for pdf in batches:
            out = []
            stamps = list(pdf["ts"]) if "ts" in pdf else [None] * len(pdf)
            columns = zip(
                pdf["job_id"],
                pdf["page_num"],
                pdf["event"],
                pdf["worker"],
                pdf["error"],
                stamps,
                *[pdf[c] for c in order],
                strict=True,
            )
            for job, page, event, worker, error, ts, *at in columns:
                if (job, page) != key:
                    if key is not None:
                        out.append(flush())
                        fresh_range = False
                    key, run = (job, page), dict(zip(order, at, strict=True))
                    states = {s: s for s in (entries() if fresh_range else [START])}
                moved = {
                    s: advance(s, event, worker, error, ts, reset_attempts)
                    for s in set(states.values())
                }
                states = {entry: moved[s] for entry, s in states.items()}
            if out:
                yield pd.DataFrame(out)
        if key is not None:
            yield pd.DataFrame([flush()])

    runs = ordered.mapInPandas(fold, schema)
    start = F.struct(
        F.lit("pending").alias("status"),
        F.lit(0).alias("attempts"),
        F.lit(None).cast("string").alias("claimed_by"),
        F.lit(None).cast("timestamp").alias("claimed_at"),
        F.lit(None).cast("string").alias("error"),
    )

    def compose(acc: Column, outcomes: Column) -> Column:
        entry = F.concat_ws(":", acc["status"], acc["attempts"].cast("string"))

        def take(o: Column) -> Column:
            return F.struct(
                o["status"].alias("status"),
                o["attempts"].alias("attempts"),
                F.when(o["claim_known"], o["claimed_by"])
                .otherwise(acc["claimed_by"])
                .alias("claimed_by"),
                F.when(o["claim_known"], o["claimed_at"])
                .otherwise(acc["claimed_at"])
                .alias("claimed_at"),
                F.when(o["error_known"], o["error"]).otherwise(acc["error"]).alias("error"),
            )

        return let(F.get(F.filter(outcomes, lambda o: o["entry"] == entry), F.lit(0)), take)

    in_order = F.array_sort(F.collect_list(F.struct("run", "outcomes")))["outcomes"]
    return (
        runs.groupBy(*keys)
        .agg(F.aggregate(in_order, start, compose).alias("s"))
        .select(*keys, "s.*")
    )


def stale_claims(pages: DataFrame, as_of: datetime | Column, seconds: int = STALE_SECONDS):
    """Pages whose claim is older than the time-out, put back to pending."""
    now = as_of if isinstance(as_of, Column) else F.lit(as_of)
    cutoff = now - F.make_interval(secs=F.lit(seconds))
    stale = F.coalesce(
        (F.col("status") == "ocr_running") & (F.col("claimed_at") < cutoff), F.lit(False)
    )
    freed = {
        "status": F.lit("pending"),
        "claimed_by": F.lit(None).cast("string"),
        "claimed_at": F.lit(None).cast("timestamp"),
    }
    return pages.select(
        *[
            F.when(stale, freed[c]).otherwise(F.col(c)).alias(c) if c in freed else F.col(c)
            for c in pages.columns
        ]
    )


def exhausted_jobs(states: DataFrame) -> DataFrame:
    """Jobs that fail because one page used up its attempts (lowest page is reported)."""
    spent = (F.col("status") == "ocr_failed") & (F.col("attempts") >= MAX_ATTEMPTS)
    worst = states.filter(spent).groupBy("job_id").agg(
        F.min("page_num").alias("page_num"), F.min_by("error", "page_num").alias("page_error")
    )
    return worst.select(
        "job_id",
        "page_num",
        F.lit("failed").alias("status"),
        F.concat(
            F.lit("Page "),
            F.col("page_num").cast("string"),
            F.lit(f" OCR failed after {MAX_ATTEMPTS} attempts: "),
            F.coalesce(F.substring("page_error", 1, 200), F.lit("")),
        ).alias("error"),
    )


# --- token bucket ------------------------------------------------------------------


def rate_limit(
    requests: DataFrame,
    *,
    key_col: str = "key",
    ts_col: str = "ts",
    id_col: str = "request_id",
    capacity: int = 5,
    refill_seconds: int = 60,
    split_rows: int = 1_000_000,
) -> DataFrame:
    """Allow/deny every request under a token bucket per key, in time order.

    Adds ``allowed``, ``remaining`` and ``retry_after_seconds``.  Exact, in whole
    microseconds, without replaying a key's requests one by one:

    The bucket is held as the time ``x`` at which it would be full again.  A denied
    request does not change ``x``; an allowed one moves it to ``max(x, now)`` plus one
    refill interval ``T``.  Within a cell of width ``T`` at most the first ``m`` requests
    plus one later request pass.  So requests are pre-aggregated to one row per (key,
    cell), these rows are folded in order (a key has at most one per interval, however
    many requests it sends), and each request is then judged against its cell.

    With ``capacity`` 2 or more, what a cell does to ``x`` follows from its request count,
    first and last time.  With 1, the time of the request that passes decides, so the
    passing times come first from :func:`single_passes`; everything else is the same.

    A cell with more than ``split_rows`` requests is dealt over as many salts, each with a
    copy of the cell's bounds.  Requests equal in key, time and id are one request: they
    use one token and share the verdict.
    """
    width = refill_seconds * 1_000_000
    keyed = requests.withColumn("__s", F.unix_micros(F.col(ts_col).cast("timestamp")))
    keyed = keyed.withColumn("__cell", F.floor(F.col("__s") / F.lit(width)).cast("long"))
    slim = keyed.select(F.col(key_col).alias("k"), "__cell", "__s", F.col(id_col).alias("i")).distinct()
    cells = slim.groupBy("k", "__cell").agg(
        F.count(F.lit(1)).alias("n"), F.min("__s").alias("first"), F.max("__s").alias("last")
    )
    if capacity == 1:
        passing = single_passes(slim.select("k", "__s").distinct(), width)
        at = F.floor(F.col("__s") / F.lit(width)).cast("long").alias("__cell")
        cells = cells.join(passing.select("k", at, F.col("__s").alias("pass")), ["k", "__cell"], "left")
    else:
        cells = cells.withColumn("pass", F.lit(None).cast("long"))
    state = _fold_cells(cells, width, capacity)
    rank = F.row_number().over(W.partitionBy("k", "__cell").orderBy("__s", "i"))
    firsts = (
        slim.withColumn("__rn", rank)
        .filter(F.col("__rn") <= capacity)  # group limit: applied before the shuffle
        .groupBy("k", "__cell")
        .agg(F.array_sort(F.collect_list(F.struct("__s", "i"))).alias("firsts"))
    )
    salts = F.ceil(F.col("n") / F.lit(split_rows)).cast("int").alias("__salts")
    copies = F.explode(F.sequence(F.lit(0), F.col("__salts") - 1)).alias("__salt")
    bounds = state.join(firsts, ["k", "__cell"]).select(
        "k",
        "__cell",
        "x",
        "m",
        (F.col("x") + F.col("m") * width - (capacity - 1) * width).alias("tau"),
        F.slice("firsts", F.lit(1), F.col("m")).alias("early"),
        salts,
    )
    # at most one crowded cell for every ``split_rows`` requests
    crowded = cells.where(F.col("n") > split_rows).select("k", "__cell", salts)

    def salted(rows: DataFrame) -> DataFrame:
        known = rows.join(crowded, ["k", "__cell"], "left")
        salt = F.pmod(F.xxhash64("__s", "i"), F.coalesce("__salts", F.lit(1))).cast("int")
        return known.withColumn("__salt", salt).drop("__salts")

    me = F.struct(F.col("__s"), F.col("i"))
    after_early = (F.col("m") == 0) | (me > F.try_element_at("early", F.lit(-1)))
    lates = (
        salted(slim)
        .join(bounds.select("k", "__cell", "m", "tau", "early", copies), ["k", "__cell", "__salt"])
        .where((F.col("__s") >= F.col("tau")) & after_early)
        .groupBy("k", "__cell", "__salt")
        .agg(F.min(me).alias("late"))
        .groupBy("k", "__cell")
        .agg(F.min("late").alias("late"))
    )
    verdicts = bounds.join(lates, ["k", "__cell"], "left").select("k", "__cell", "x", "m", "early", "late", copies)
    judged = salted(keyed.withColumn("k", F.col(key_col)).withColumn("i", F.col(id_col))).join(
        verdicts, ["k", "__cell", "__salt"]
    )
    early_at = F.array_position("early", me)  # 1-based, 0 when not among them
    is_late = F.coalesce(F.col("late") == me, F.lit(False))
    past_late = F.coalesce(me > F.col("late"), F.lit(False))
    allowed = (early_at > 0) | is_late
    # the time at which the bucket is full again, as the request finds it
    after_firsts = F.col("x") + F.col("m") * width
    full = (
        F.when(early_at > 0, F.col("x") + (early_at - 1) * width)
        .when(past_late, F.greatest(after_firsts, F.col("late")["__s"]) + width)
        .otherwise(after_firsts)
    )
    # microseconds' worth of tokens in the bucket when the request arrives
    level = F.lit(capacity * width) - F.greatest(full - F.col("__s"), F.lit(0))
    return judged.select(
        *requests.columns,
        allowed.alias("allowed"),
        F.when(allowed, F.floor((level - width) / F.lit(width)))
        .otherwise(F.lit(0))
        .cast("int")
        .alias("remaining"),
        F.when(allowed, F.lit(0))
        .otherwise(F.ceil((F.lit(width) - level) / F.lit(1_000_000)))
        .cast("int")
        .alias("retry_after_seconds"),
    )


def single_passes(times: DataFrame, width: int) -> DataFrame:
    """Of distinct (k, __s) the times that pass a bucket of one token, ``width`` apart.

    The next time that passes is the first one at or after the last plus ``width``, so all
    of a key's times hang on its first.  They are spread by ranges of (k, time).  Only the
    first key of a range can have passed before it; for it the range finds out at which
    time it would end for every time it may be entered at.  Entries that ever pass at the
    same time go on as one.  One small row per key and range is composed in order, and
    each range then walks from the entry it really has.
    """
    ordered = cut_lineage(times.repartitionByRange("k", "__s").sortWithinPartitions("k", "__s"))
    kind = times.schema["k"].dataType.simpleString()

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run = TaskContext.get().partitionId()
        key, begun, fresh = None, False, True  # fresh: other ranges may hold earlier times
        first, x, alive, parent, upto = 0, None, deque(), [], []

        def flush() -> dict:
            if not fresh:
                return {"k": key, "run": run, "steps": [{"upto": None, "exit": x}]}
            exits = {node: at for at, node in alive}
            steps: list[dict] = []
            for node, limit in upto:
                while parent[node] != node:
                    parent[node] = node = parent[parent[node]]
                if steps and steps[-1]["exit"] == exits[node]:
                    steps[-1]["upto"] = limit
                else:
                    steps.append({"upto": limit, "exit": exits[node]})
            return {"k": key, "run": run, "steps": steps}

        for pdf in batches:
            out = []
            for k, s in zip(pdf["k"], pdf["__s"], strict=True):
                if not begun or k != key:
                    if begun:
                        out.append(flush())
                        fresh = False
                    key, begun, first, x = k, True, s, None
                if not fresh:
                    if x is None or s >= x:
                        x = s + width
                    continue
                joined = None
                while alive and alive[0][0] <= s:
                    node = alive.popleft()[1]
                    if joined is None:
                        joined = node
                    else:
                        parent[node] = joined
                if s <= first + width:  # entered with a time in (the last one, s]
                    if joined is None:
                        joined = len(parent)
                        parent.append(joined)
                    upto.append((joined, s))
                if joined is not None:
                    alive.append((s + width, joined))
            if out:
                yield pd.DataFrame(out)
        if begun:
            yield pd.DataFrame([flush()])

    runs = ordered.mapInPandas(ends, f"k {kind}, run int, steps array<struct<upto:bigint,exit:bigint>>")

    def on(acc: Column, r: Column) -> Column:
        hit = F.filter(r["steps"], lambda p: acc["x"].isNull() | p["upto"].isNull() | (acc["x"] <= p["upto"]))
        after = F.when(F.size(hit) > 0, F.get(hit, F.lit(0))["exit"]).otherwise(acc["x"])
        entry = F.struct(r["run"].alias("run"), acc["x"].alias("x"))
        return F.struct(after.alias("x"), F.concat(acc["entries"], F.array(entry)).alias("entries"))

    none = F.lit(None).cast("long").alias("x")
    start = F.struct(none, F.array().cast("array<struct<run:int,x:bigint>>").alias("entries"))
    in_order = F.array_sort(F.collect_list(F.struct("run", "steps")))
    composed = runs.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.aggregate(in_order, start, on)["entries"].alias("e"))
    # one row per range at most: the key it begins with came from an earlier one
    begun = composed.where("n > 1").select(F.explode("e").alias("e")).where("e.x is not null").select("e.*")
    entered = {r["run"]: r["x"] for r in begun.collect()}

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, begun, x = None, False, entered.get(TaskContext.get().partitionId())
        for pdf in batches:
            passed = []
            for k, s in zip(pdf["k"], pdf["__s"], strict=True):
                if begun and k != key:
                    x = None
                key, begun = k, True
                if x is None or s >= x:
                    x = s + width
                    passed.append((k, s))
            yield pd.DataFrame(passed, columns=["k", "__s"])

    return ordered.mapInPandas(walk, f"k {kind}, __s long")


def _fold_cells(cells: DataFrame, width: int, capacity: int) -> DataFrame:
    """Per cell: ``x`` at its first request and ``m``, the requests that pass at once."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, x = None, None
        for pdf in batches:
            out = []
            rows = zip(
                pdf["k"], pdf["__cell"], pdf["n"], pdf["first"], pdf["last"], pdf["pass"], strict=True
            )
            for k, cell, n, first, last, single in rows:
                if k != key:
                    key, x = k, first
                x0 = max(x, first)
                m = min(n, (capacity * width - (x0 - first)) // width)
                tau = x0 + m * width - (capacity - 1) * width
                passed = m + (1 if n > m and last >= tau else 0)
                if passed:
                    x = x0 + passed * width if pd.isna(single) else int(single) + width
                out.append((k, cell, n, x0, m))
            yield pd.DataFrame(out, columns=["k", "__cell", "n", "x", "m"])

    key_type = cells.schema["k"].dataType.simpleString()
    ordered = cells.repartition("k").sortWithinPartitions("k", "__cell")
    return ordered.mapInPandas(fold, f"k {key_type}, __cell long, n long, x long, m int")
