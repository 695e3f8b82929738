"""MD5 of texts that come in parts and are too long for one row or one task.

MD5 goes through its input byte by byte, but what it knows after any byte is four words
and the bytes that do not fill a block yet.  A text is therefore digested in legs of
``leg_parts`` parts: the tasks of one leg start from the state the leg before has left,
and no task reads more than one leg of a text.  Texts of one leg are all done at once;
longer ones take one more job per leg.
"""

from __future__ import annotations

import ctypes
import hashlib
import math
import struct
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path, written

#: What to ask assembly for, so that a part is far from the limits of a row.
PART_CHARS = 1 << 20
#: Parts that one task digests before another goes on.
LEG_PARTS = 64

_START = struct.pack("<4I", 0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]]


def _plain_blocks(words: bytes, data: bytes) -> bytes:
    """The four words after whole blocks of 64 bytes (RFC 1321); slow, for Pythons without OpenSSL."""
    mask = 0xFFFFFFFF
    state = struct.unpack("<4I", words)
    for block in struct.iter_unpack("<16I", data):
        a, b, c, d = state
        for i in range(64):
            kind = i // 16
            if kind == 0:
                f, at = d ^ (b & (c ^ d)), i
            elif kind == 1:
                f, at = c ^ (d & (b ^ c)), 5 * i + 1
            elif kind == 2:
                f, at = b ^ c ^ d, 3 * i + 5
            else:
                f, at = c ^ (b | (d ^ mask)), 7 * i
            f = (a + f + _SINES[i] + block[at % 16]) & mask
            turn = _TURNS[kind][i % 4]
            a, d, c, b = d, c, b, (b + (f << turn | f >> (32 - turn))) & mask
        state = [(x + y) & mask for x, y in zip(state, (a, b, c, d), strict=True)]
    return struct.pack("<4I", *state)


def _blocks() -> Callable[[bytes, bytes], bytes]:
    """The same by the library behind ``hashlib``, whose own objects can't be set to a state."""
    try:
        import _hashlib

        update = ctypes.CDLL(_hashlib.__file__).MD5_Update
    except (ImportError, AttributeError, OSError):
        return _plain_blocks
    if sys.byteorder != "little":
        return _plain_blocks
    update.argtypes = [ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t]

    def run(words: bytes, data: bytes) -> bytes:
        context = ctypes.create_string_buffer(words, 256)  # MD5_CTX begins with the words
        update(context, data, len(data))
        return context.raw[:16]

    # a library that lays its context out otherwise must not be trusted
    return run if _closed(run, _START, 3, b"abc") == hashlib.md5(b"abc", usedforsecurity=False).hexdigest() else _plain_blocks


def _closed(blocks: Callable[[bytes, bytes], bytes], words: bytes, size: int, rest: bytes) -> str:
    """The digest if the text ended after ``size`` bytes, the last of them ``rest``."""
    zeros = bytes((55 - size) % 64)
    return blocks(words, rest + b"\x80" + zeros + struct.pack("<Q", size * 8 % 2**64)).hex()


class Md5:
    """MD5 that can be stopped after any byte and goes on elsewhere from ``state``."""

    def __init__(self, state: bytes | None = None, blocks: Callable[[bytes, bytes], bytes] | None = None):
        state = state or _START + bytes(8)
        self._words, (self._size,), self._rest = state[:16], struct.unpack("<Q", state[16:24]), state[24:]
        self._blocks = blocks or _blocks()

    def update(self, data: bytes) -> None:
        self._size += len(data)
        data = self._rest + data
        whole = len(data) // 64 * 64
        if whole:
            self._words = self._blocks(self._words, data[:whole])
        self._rest = data[whole:]

    @property
    def state(self) -> bytes:
        return self._words + struct.pack("<Q", self._size) + self._rest

    def hexdigest(self) -> str:
        return _closed(self._blocks, self._words, self._size, self._rest)


def md5_of_parts(
    parts: DataFrame,
    *,
    id_col: str | list[str],
    part_col: str = "part",
    text_col: str = "text",
    pieces_col: str = "pieces",
    separator: str = "\n\n",
    leg_parts: int = LEG_PARTS,
) -> DataFrame:
    """(id, text_hash, n_chars, pieces) of texts whose parts are joined with ``separator``.

    ``parts`` is what :func:`~folioforge.operators.assemble.assemble` returns with
    ``part_chars``: parts without a piece do not count, and a text without any has no row.
    """
    spark = parts.sparkSession
    ids = [id_col] if isinstance(id_col, str) else list(id_col)
    path = scratch_path(spark, "parts")
    rows = parts.where(F.col(pieces_col) > 0).select(
        F.struct(*ids).alias("key"),
        F.col(part_col).cast("long").alias("part"),
        F.col(text_col).cast("binary").alias("data"),
        F.length(text_col).cast("long").alias("n_chars"),
        F.col(pieces_col).cast("long").alias("pieces"),
        F.floor(F.col(part_col) / F.lit(leg_parts)).cast("int").alias("leg"),
    )
    # a leg is a folder, so that its job reads nothing else
    rows.write.partitionBy("leg").parquet(path)
    stored = spark.read.schema(rows.schema).parquet(path)
    totals = written(
        stored.groupBy("key").agg(
            (F.sum("n_chars") + (F.count("*") - 1) * len(separator)).alias("n_chars"),
            F.sum("pieces").alias("pieces"),
        )
    )
    legs = sorted(r.leg for r in stored.select("leg").distinct().collect())
    kind = stored.schema["key"].dataType.simpleString()
    states = None
    for leg in legs or [0]:
        todo = stored.where(F.col("leg") == leg).select("key", "part", "data", _none("binary").alias("state"))
        if states is not None:  # a state comes before the parts
            todo = todo.unionByName(
                states.select("key", F.lit(-1).cast("long").alias("part"), _none("binary").alias("data"), "state")
            )
        sorted_rows = todo.repartition("key").sortWithinPartitions("key", "part")
        states = written(
            sorted_rows.mapInArrow(_digest_in_order(separator.encode()), f"key {kind}, state binary, text_hash string")
        )
    # the result reads the states and totals only; the parts are as large as all texts
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return totals.join(states, "key").select("key.*", "text_hash", "n_chars", "pieces")


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _digest_in_order(separator: bytes):
    """One row a key: its state and its digest so far; holds one Arrow batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _blocks()
        held, md5, kind = None, None, None

        def closed(rows: list[tuple]) -> pa.RecordBatch:
            keys, states, digests = zip(*rows, strict=True) if rows else ((), (), ())
            columns = [pa.array(keys, kind), pa.array(states, pa.binary()), pa.array(digests, pa.string())]
            return pa.RecordBatch.from_arrays(columns, ["key", "state", "text_hash"])

        for batch in batches:
            kind, done = batch.schema.field("key").type, []
            keys, data, states = (batch.column(name) for name in ("key", "data", "state"))
            for i in range(batch.num_rows):
                key, state = keys[i].as_py(), states[i].as_py()
                if md5 is None or key != held:
                    if md5 is not None:
                        done.append((held, md5.state, md5.hexdigest()))
                    held, md5 = key, Md5(state, blocks)
                    if state is not None:
                        continue
                else:
                    md5.update(separator)
                md5.update(data[i].as_py())
            yield closed(done)
        if md5 is not None:
            yield closed([(held, md5.state, md5.hexdigest())])

    return run
