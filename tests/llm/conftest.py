from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Names that the operators use themselves, as extra columns of the input.
CLASHES = [
    "size", "w", "pos", "seed", "span", "fp", "root", "component_id", "kept_id", "text_key", "shard", "slot", "law",
    "o_shard", "shard_sub", "copy", "copies", "target", "taken", "mix_key", "found", "item_id", "score", "label",
    "nth", "bad_id", "c_id", "in_text", "source_size", "text_crc32", "grown_shard", "key", "tab", "cut_source",
]


@pytest.fixture(scope="session")
def sf() -> str:
    return SF


@pytest.fixture
def docs_of(spark):
    """A documents table from (doc_id, text[, lang[, source]]) rows."""

    def make(*rows, clash: bool = False):
        full = [(*r, *[None] * (4 - len(r)), None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        if clash:
            from pyspark.sql import functions as F

            df = df.withColumns({c: F.lit(f"own {c}") for c in CLASHES})
        return df

    return make
