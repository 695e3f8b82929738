"""Conversation structure repair by square-root checkpointed dynamic programming.

A repaired conversation has the role initials ``(s?(ua)+)?``. Rows are kept, given the role
that is due, or deleted, and empty turns are inserted; the cheapest edits win, and of equally
cheap ones those whose initials (D, I, K, R) come first in ASCII.

Four states say which initials may follow. Backward vectors hold the cost from each state
to the end. They are stored only at checkpoints, one every ``SPACING`` rows or, in longer
conversations, one every square root of their rows: each block of rows first becomes one
4 x 4 matrix of costs, and the matrices of a conversation are folded backward. Then each
block recomputes its own vectors from its checkpoint and walks forward along edits that
keep the cost; where it ends for each state it may begin in is folded forward. So rows
are never gathered by conversation, only by block; the folds hold square root of the rows.

Only writing out a repaired conversation in order, and the digest over its whole text, pass
through one task a conversation. That is a stream over sorted rows which holds one block's
edits and one Arrow batch.

Defined cases: a null role or text is one space; an empty role is no legal initial; a null
conv_id is a conversation of its own; null turns come first, equal turns are ordered by role
and text; an empty table gives an empty result. Extra columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.common import CRC_TABLE_SQL, SPACE_CHARS, crc32_sql, staged, table
from folioforge.llm.registry import query

#: Fixed values: costs of the edits and of keeping or changing a truncated row.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Fewest rows between two checkpoints.
SPACING = 1024

#: States: nothing yet, after s, after u, after a. The state after an initial; the state
#: after the turn that is due, and that turn's role; the cost of ending in a state.
AFTER = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
DUE, DUE_ROLE = (2, 2, 3, 2), ("user", "user", "assistant", "user")
END = (0, 2 * INSERT, INSERT, 0)
NEVER = 1 << 60

Vector = tuple[int, int, int, int]


def _used(state: int, symbol: str, after: Vector) -> int:
    """Least cost from ``state`` that uses up a row of this symbol without inserting first."""
    best = DELETE + after[state]
    if symbol != "D":
        extra = TRUNCATED if symbol.isupper() else 0
        best = min(best, extra + REROLE + after[DUE[state]])
        kept = AFTER[state].get(symbol.lower())
        if kept is not None:
            best = min(best, extra + after[kept])
    return best


@lru_cache(maxsize=1 << 16)
def _before(symbol: str, after: Vector) -> Vector:
    """The backward vector in front of a row; more than two turns are never inserted."""
    used = [_used(s, symbol, after) for s in range(4)]
    twice = lambda s: min(used[DUE[s]], INSERT + used[DUE[DUE[s]]])  # noqa: E731
    a, b, c, d = (min(used[s], INSERT + twice(s), NEVER) for s in range(4))
    return a, b, c, d


def _relative(vector: Vector) -> tuple[int, Vector]:
    """A vector as its least cost and the rest, of which few different ones exist."""
    low = min(vector)
    a, b, c, d = (NEVER if v >= NEVER else v - low for v in vector)
    return low, (a, b, c, d)


def backward(symbols: str, end: Vector) -> tuple[int, Vector]:
    """(least cost, rest) of the backward vector in front of all rows."""
    total, vector = _relative(end)
    for symbol in reversed(symbols):
        low, vector = _relative(_before(symbol, vector))
        total += low
    return total, vector


def cost_matrix(symbols: str) -> list[int]:
    """16 costs: from each state in front of the rows to each state behind them."""
    columns = []
    for end in range(4):
        total, vector = backward(symbols, tuple(0 if s == end else NEVER for s in range(4)))
        columns.append([NEVER if v >= NEVER else total + v for v in vector])
    return [columns[end][start] for start in range(4) for end in range(4)]


def walk(symbols: str, end: Vector, state: int, last: bool) -> tuple[int, str]:
    """State behind the rows and the edits, least in ASCII, whose cost stays the least."""
    vectors = [_relative(end)[1]]
    lows = []
    for symbol in reversed(symbols):
        low, vector = _relative(_before(symbol, vectors[-1]))
        vectors.append(vector)
        lows.append(low)
    edits = []
    for i, symbol in enumerate(symbols):
        at, after, low = vectors[len(symbols) - i], vectors[len(symbols) - i - 1], lows[len(symbols) - i - 1]
        while True:
            cost = at[state] + low
            if DELETE + after[state] == cost:
                edits.append("D")
                break
            if INSERT + at[DUE[state]] == at[state]:
                edits.append("I")
                state = DUE[state]
                continue
            extra = TRUNCATED if symbol.isupper() else 0
            kept = AFTER[state].get(symbol.lower())
            if kept is not None and extra + after[kept] == cost:
                edits.append("K")
                state = kept
            else:
                edits.append("R")
                state = DUE[state]
            break
    while last and END[state]:
        edits.append("I")
        state = DUE[state]
    return state, "".join(edits)


def _fold_back(blocks: list[dict]) -> dict:
    """Checkpoints of one conversation: the vector behind every block, and the whole cost."""
    end, ends = END, []
    for b in reversed(blocks):
        ends.append({"block": b["block"], "ends": list(end)})
        m = b["matrix"]
        end = tuple(min(NEVER, *(m[4 * s + e] + end[e] for e in range(4))) for s in range(4))
    return {"cost": end[0], "checkpoints": ends}


def _fold_on(blocks: list[dict]) -> list[dict]:
    """The state in which the forward walk enters every block."""
    state, entries = 0, []
    for b in blocks:
        entries.append({"block": b["block"], "entry": state})
        state = b["exits"][state]
    return entries


def numbered(rows: DataFrame) -> DataFrame:
    """Written rows with ``pos``, which grows along each conversation, their initial, and
    whether they are blank or end like a truncated text. One shuffle, by ranges."""
    text, role = (F.coalesce(F.col(c), F.lit(" ")) for c in ("text", "role"))
    plain = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    trimmed = F.btrim(F.col("text"), F.lit(SPACE_CHARS))
    ordered = plain.repartitionByRange(*order).sortWithinPartitions(*order)
    return staged(
        ordered.select(
            "*",
            F.monotonically_increasing_id().alias("pos"),
            F.left("role", F.lit(1)).alias("initial"),
            (trimmed == "").alias("blank"),
            (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
            F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("said"),
        )
    )


def with_blocks(rows: DataFrame, spacing: int = SPACING) -> DataFrame:
    """Numbered rows with ``block``; only conversations above ``spacing`` squared are wider."""
    root = F.ceil(F.sqrt(F.count(F.lit(1)))).cast("long")
    wide = rows.groupBy(F.col("conv_id").alias("w_conv")).agg(root.alias("root")).where(F.col("root") > spacing)
    place = F.floor(F.col("pos") / F.coalesce(F.col("root"), F.lit(spacing)))
    joined = rows.join(wide, F.col("conv_id").eqNullSafe(F.col("w_conv")), "left")
    return joined.withColumn("block", place).drop("w_conv", "root")


def judged(rows: DataFrame, spacing: int = SPACING) -> DataFrame:
    """Written (conv_id, block, pos, turn, initial, fault, symbol) of numbered rows.

    A symbol is D for a row that must go, else its initial (o: none of s, u, a), in upper
    case if truncated. A row is a duplicate if the first row of its conversation that says
    the same lies before it; that join is on conversation and digest.
    """
    firsts = (
        rows.where(~F.col("blank"))
        .groupBy("conv_id", "said")
        .agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("times"))
        .where("times > 1")
        .select(F.col("conv_id").alias("f_conv"), F.col("said").alias("f_said"), "first")
    )
    narrow = with_blocks(rows.drop("role", "text"), spacing)
    known = narrow.join(
        firsts, F.col("conv_id").eqNullSafe(F.col("f_conv")) & (F.col("said") == F.col("f_said")), "left"
    )
    fault = (
        F.when(F.col("blank"), "blank")
        .when(F.coalesce(F.col("pos") > F.col("first"), F.lit(False)), "duplicate")
        .when(F.col("truncated"), "truncated")
    )
    role = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "D").when(F.col("fault").isNull(), role)
    return staged(
        known.withColumn("fault", fault).select(
            "conv_id",
            "block",
            "pos",
            "turn",
            role.alias("initial"),
            "fault",
            symbol.otherwise(F.upper(role)).alias("symbol"),
        )
    )


def _breaks(initials: str) -> int:
    """Neighbouring initials other than su, ua, au."""
    return sum(pair not in ("su", "ua", "au") for pair in map("".join, zip(initials, initials[1:], strict=False)))


def edit_blocks(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of judged rows: (conv_id, cost, illegal) and written (conv_id, block, edits)."""
    listed = F.sort_array(F.collect_list(F.struct("pos", "symbol", "initial")))
    said = lambda c: F.array_join(F.transform("rows", lambda r: r[c]), "")  # noqa: E731
    blocks = marked.groupBy("conv_id", "block").agg(listed.alias("rows"))
    blocks = blocks.select("conv_id", "block", said("symbol").alias("symbols"), said("initial").alias("initials"))

    @F.pandas_udf("array<long>")
    def matrix(symbols: pd.Series) -> pd.Series:
        return symbols.map(cost_matrix)

    @F.pandas_udf("long")
    def breaks(initials: pd.Series) -> pd.Series:
        return initials.map(_breaks)

    blocks = staged(blocks.withColumn("matrix", matrix("symbols")).withColumn("inside", breaks("initials")))

    @F.pandas_udf("cost long, checkpoints array<struct<block: long, ends: array<long>>>")
    def checkpoints(sorted_blocks: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_fold_back(list(b)) for b in sorted_blocks], columns=["cost", "checkpoints"])

    edges = (F.left("initials", F.lit(1)).alias("head"), F.right("initials", F.lit(1)).alias("tail"))
    per_conv = blocks.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("block", "matrix", *edges))).alias("sorted"),
        F.sum("inside").alias("inside"),
        F.min("block").alias("opening"),
        F.max("block").alias("last"),
    )
    meeting = F.transform(
        F.slice("sorted", F.lit(2), F.size("sorted")),
        lambda b, i: F.concat(F.get("sorted", i)["tail"], b["head"]).isin("su", "ua", "au"),
    )
    between = F.size(F.filter(meeting, lambda legal: ~legal))
    folded = staged(
        per_conv.select(
            "conv_id", "opening", "last", checkpoints("sorted").alias("f"), (F.col("inside") + between).alias("illegal")
        ).select("conv_id", "opening", "last", "f.cost", "illegal", "f.checkpoints")
    )

    stops = folded.select("conv_id", "opening", "last", F.explode("checkpoints").alias("c")).select(
        F.col("conv_id").alias("s_conv"), "opening", "last", F.col("c.block").alias("s_block"), "c.ends"
    )

    @F.pandas_udf("exits array<long>, edits array<string>")
    def walks(symbols: pd.Series, ends: pd.Series, last: pd.Series, opening: pd.Series) -> pd.DataFrame:
        out = []
        for text, end, is_last, is_first in zip(symbols, ends, last, opening, strict=True):
            starts = [0] if is_first else range(4)
            got = [walk(text, tuple(map(int, end)), s, bool(is_last)) for s in starts]
            out.append(([g[0] for g in got], [g[1] for g in got]))
        return pd.DataFrame(out, columns=["exits", "edits"])

    placed = blocks.join(
        stops, F.col("conv_id").eqNullSafe(F.col("s_conv")) & (F.col("block") == F.col("s_block"))
    )
    walked = staged(
        placed.select(
            "conv_id",
            "block",
            walks("symbols", "ends", F.col("block") == F.col("last"), F.col("block") == F.col("opening")).alias("w"),
        ).select("conv_id", "block", "w.exits", "w.edits")
    )

    @F.pandas_udf("array<struct<block: long, entry: long>>")
    def entries(sorted_blocks: pd.Series) -> pd.Series:
        return sorted_blocks.map(lambda b: _fold_on(list(b)))

    entered = walked.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "exits"))).alias("sorted"))
    entered = entered.select("conv_id", F.explode(entries("sorted")).alias("e")).select(
        F.col("conv_id").alias("e_conv"), F.col("e.block").alias("e_block"), F.col("e.entry").cast("int").alias("entry")
    )
    edits = walked.join(
        entered, F.col("conv_id").eqNullSafe(F.col("e_conv")) & (F.col("block") == F.col("e_block"))
    ).select("conv_id", "block", F.get("edits", F.col("entry")).alias("edits"))
    return folded.select("conv_id", "cost", "illegal"), staged(edits)


def repaired_messages(rows: DataFrame, edits: DataFrame, spacing: int = SPACING) -> DataFrame:
    """(conv_id, place, role, text) of numbered rows and the edits of their blocks: the
    repaired conversations, each as consecutive rows in order."""
    none = F.lit(None).cast("string")
    columns = ["conv_id", "block", "pos", "role", "text", "edits"]
    said = with_blocks(rows, spacing).withColumn("edits", none).select(*columns)
    ahead = edits.withColumns({"pos": F.lit(-1).cast("long"), "role": none, "text": none}).select(*columns)
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "block", "pos")]
    lined = ahead.unionByName(said).repartition("conv_id").sortWithinPartitions(*order)
    kind = next(f.dataType for f in lined.schema.fields if f.name == "conv_id").simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = ()
        left: list[str] = []
        state = place = 0
        for batch in batches:
            out: dict[str, list] = {"conv_id": [], "place": [], "role": [], "text": []}

            def tell(*message: object) -> None:
                for values, value in zip(out.values(), message, strict=True):  # noqa: B023
                    values.append(value)

            for conv, role, text, block_edits in zip(
                *(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "edits")), strict=True
            ):
                if block_edits is not None:  # a block begins
                    if held != (conv,):
                        held, state, place = (conv,), 0, 0
                    left = list(reversed(block_edits))
                else:
                    edit = left.pop()
                    if edit != "D":
                        tell(conv, place, role if edit == "K" else DUE_ROLE[state], text)
                        state = AFTER[state][role[0]] if edit == "K" else DUE[state]
                        place += 1
                while left and left[-1] == "I":
                    left.pop()
                    tell(conv, place, DUE_ROLE[state], "")
                    state = DUE[state]
                    place += 1
            arrays = [pa.array(out["conv_id"], batch.schema.field("conv_id").type), pa.array(out["place"], pa.int64())]
            arrays += [pa.array(out[c], pa.string()) for c in ("role", "text")]
            yield pa.RecordBatch.from_arrays(arrays, list(out))

    return lined.mapInArrow(run, f"conv_id {kind}, place long, role string, text string")


def message_digests(messages: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) over ``role:text``, joined by newlines, of messages that
    lie in order, as :func:`repaired_messages` gives them."""
    kind = next(f.dataType for f in messages.schema.fields if f.name == "conv_id").simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, digest, as_type = None, None, None
        done: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            out = [pa.array([d[0] for d in done], as_type), pa.array([d[1] for d in done], pa.string())]
            done.clear()
            return pa.RecordBatch.from_arrays(out, ["conv_id", "repaired_sha256"])

        for batch in batches:
            as_type = batch.schema.field("conv_id").type
            for conv, role, text in zip(
                *(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True
            ):
                if digest is None or conv != held:
                    if digest is not None:
                        done.append((held, digest.hexdigest()))
                    held, digest = conv, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            yield batch_of()
        if digest is not None:
            done.append((held, digest.hexdigest()))
            yield batch_of()

    return messages.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def repaired(rows: DataFrame, spacing: int = SPACING) -> tuple[DataFrame, DataFrame]:
    """Of conversations (conv_id, turn, role, text): one row per conversation with gaps,
    blank, duplicate, truncated, illegal, cost and audit; and its messages after repair."""
    rows = numbered(rows.select("conv_id", "turn", "role", "text"))
    marked = judged(rows, spacing)
    costs, edits = edit_blocks(marked)
    number = lambda fault: F.count(F.when(F.col("fault") == fault, 1)).alias(fault)  # noqa: E731
    span = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    counts = marked.groupBy("conv_id").agg(
        F.coalesce(span, F.lit(0)).cast("long").alias("gaps"),
        *[number(f) for f in ("blank", "duplicate", "truncated")],
    )
    pieces = F.sort_array(F.collect_list(F.struct("block", "edits")))
    audits = edits.groupBy(F.col("conv_id").alias("a_conv")).agg(
        F.array_join(F.transform(pieces, lambda p: p["edits"]), "").alias("audit")
    )
    found = (
        counts.join(costs.withColumnRenamed("conv_id", "c_conv"), F.col("conv_id").eqNullSafe(F.col("c_conv")))
        .join(audits, F.col("conv_id").eqNullSafe(F.col("a_conv")))
        .select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    )
    return found, repaired_messages(rows, edits, spacing)


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` with the faults that the CRC-32 of conversation and turn plants."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))  # noqa: E731
    fault = F.pmod(F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))), F.lit(20))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate(part("text"), ".!?", ""))
    return (
        rows.select("conv_id", "turn", "role", "text", fault.alias("fault"))
        .where("fault <> 0")
        .select(
            "conv_id",
            "turn",
            F.when(F.col("fault") == 4, "user").otherwise(part("role")).alias("role"),
            text.otherwise(part("text")).alias("text"),
            F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1))),
        )
        .drop("col")
    )


def _least_sql(state: int) -> str:
    """DuckDB: cheapest edits that use up row ``f`` from ``state``, given vector ``v``."""
    after = lambda s: f"v[{s + 1}]"  # noqa: E731
    add = lambda cost, letter, s, said: (  # noqa: E731
        f"{{'c': {cost} + {after(s)}.c, 's': '{letter}' || {after(s)}.s, 'r': {said} || {after(s)}.r}}"
    )
    extra = f"(CASE WHEN fault = 't' THEN {TRUNCATED} ELSE 0 END)"
    may = "fault IN ('t', 'k')"
    options = [add(DELETE, "D", state, "''")]
    options.append(
        f"CASE WHEN {may} THEN {add(f'{REROLE} + {extra}', 'R', DUE[state], f"'{DUE_ROLE[state]}:' || text || chr(10)")} END"
    )
    for initial, then in AFTER[state].items():
        options.append(
            f"CASE WHEN {may} AND initial = '{initial}' THEN {add(extra, 'K', then, "role || ':' || text || chr(10)")} END"
        )
    return f"list_sort(list_filter([{', '.join(options)}], lambda o: o IS NOT NULL))[1]"


def _vector_sql() -> str:
    """DuckDB: the vector in front of a row; ``q`` uses the row up without inserting first."""
    said = lambda s: f"'{DUE_ROLE[s]}:' || chr(10)"  # noqa: E731
    out = []
    for s in range(4):
        t = DUE[s]
        u = DUE[t]
        out.append(
            f"list_sort([q[{s + 1}], {{'c': {INSERT} + q[{t + 1}].c, 's': 'I' || q[{t + 1}].s, 'r': {said(s)} || q[{t + 1}].r}}, "
            f"{{'c': {2 * INSERT} + q[{u + 1}].c, 's': 'II' || q[{u + 1}].s, 'r': {said(s)} || {said(t)} || q[{u + 1}].r}}])[1]"
        )
    return f"[{', '.join(out)}]"


_END_SQL = """[{'c': 0::BIGINT, 's': '', 'r': ''}, {'c': 6, 's': 'II', 'r': 'user:' || chr(10) || 'assistant:' || chr(10)},
  {'c': 3, 's': 'I', 'r': 'assistant:' || chr(10)}, {'c': 0, 's': '', 'r': ''}]"""

REPAIR_SQL = rf"""
WITH RECURSIVE {CRC_TABLE_SQL},
k AS (SELECT conv_id, row_number() OVER () AS k FROM (SELECT DISTINCT conv_id FROM conversations)),
h AS (SELECT k, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             {crc32_sql("coalesce(c.conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS h
      FROM conversations c JOIN k ON c.conv_id IS NOT DISTINCT FROM k.conv_id, crc_table),
d AS (SELECT k, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
             CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM h WHERE h <> 0
      UNION ALL SELECT k, turn, role, text FROM h WHERE h = 3),
n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, text) AS i,
             count(*) OVER (PARTITION BY k) AS n FROM d),
f AS (SELECT k, i, n, turn, role, text, left(role, 1) AS initial,
             CASE WHEN NOT regexp_matches(text, '[^ 	-]') THEN 'b'
                  WHEN row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 THEN 'd'
                  WHEN NOT regexp_matches(text, '[.!?][ 	-]*\z') THEN 't' ELSE 'k' END AS fault,
             lag(left(role, 1)) OVER (PARTITION BY k ORDER BY i) AS prev FROM n),
r AS (SELECT k, n + 1 AS i, {_END_SQL} AS v FROM f WHERE i = n
      UNION ALL
      SELECT k, i, {_vector_sql()} FROM (
        SELECT f.k, f.i, [{", ".join(_least_sql(s) for s in range(4))}] AS q
        FROM r JOIN f ON f.k = r.k AND f.i = r.i - 1)),
a AS (SELECT k, v[1].c AS cost, v[1].s AS audit, v[1].r AS said FROM r WHERE i = 1),
g AS (SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
             count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
             count(*) FILTER (fault = 't') AS truncated,
             count(*) FILTER (i > 1 AND prev || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY k)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(left(said, length(said) - 1), '')) AS repaired_sha256
FROM k LEFT JOIN g USING (k) LEFT JOIN a USING (k)
"""


@query("op11_repair", REPAIR_SQL)
def repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation after damage: its faults, the cheapest repair and its digest."""
    given = table(spark, sf_dir, "conversations")
    found, messages = repaired(damaged(given))
    digests = message_digests(messages)
    every = given.select(F.col("conv_id").alias("every")).distinct()
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)  # noqa: E731
    return (
        every.join(found, F.col("every").eqNullSafe(F.col("conv_id")), "left")
        .drop("conv_id")
        .join(digests, F.col("every").eqNullSafe(F.col("conv_id")), "left")
        .select(
            F.col("every").alias("conv_id"),
            *[number(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
            F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
        )
    )
