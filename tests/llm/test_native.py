"""License scan, chat formatting, mixing, decontamination: edge cases on small tables."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from folioforge.llm import chat, decontam, license, mixing


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# --- license scan


def scan(docs):
    return license.document_licenses(license.license_spans(docs, license.BASE | license.OWN))


def test_license_places_and_labels(docs_of):
    docs = docs_of(
        (1, "The MIT License. mit-license, MIT\nLicense!"),
        (2, "Licensed under the Apache License, Version 2.0."),
        (3, "licensed under the very apache license version 2 0"),
        (4, "gnu public general license"),
        (5, None),
        (6, ""),
        (7, "cc"),
        (None, "cc by"),
    )
    got = {r["doc_id"]: r.asDict() for r in scan(docs).collect()}
    assert (got[1]["n_words"], got[1]["n_base"], got[1]["first_word"], got[1]["last_word"]) == (7, 3, 1, 5)
    assert got[1]["base_labels"] == "mit"
    assert got[2]["labels"] == "apache,apache-notice" and got[2]["score"] == 1.0
    assert got[3]["labels"] == "apache,apache-notice"  # one word slipped in
    assert got[4]["n_base"] == 0 and got[4]["base_labels"] == "" and got[4]["labels"] == ""
    for empty in (5, 6):
        assert (got[empty]["n_words"], got[empty]["n_base"], got[empty]["first_word"], got[empty]["score"]) == (0, 0, None, 0.0)
    assert got[7]["n_words"] == 1 and got[None]["base_labels"] == "cc-by"


def test_license_repeated_rows_empty_table_and_long_text(docs_of):
    again = docs_of((1, "mit license"), (1, "mit license"), (1, "other"), clash=True)
    assert rows(scan(again), "doc_id", "n_words", "n_base") == [(1, 1, 0), (1, 2, 1)]
    assert scan(again.limit(0)).count() == 0
    long = docs_of((1, "word " * 200_000 + "cc by"))
    assert rows(scan(long), "n_words", "first_word") == [(200_002, 200_000)]


def test_license_refuses_short_templates(docs_of):
    with pytest.raises(ValueError, match="shorter"):
        license.license_spans(docs_of((1, "x")), {"one": "word"})


def test_license_adjacent_phrases_count_each(docs_of):
    got = scan(docs_of((1, "cc by cc by cc by"))).first()
    assert (got["n_base"], got["first_word"], got["last_word"]) == (3, 0, 4)


# --- chat


def events(spark, *log):
    return spark.createDataFrame(log, "conv_id long, seq long, message_id string, kind string, role string, text string")


def test_fold_deltas_edits_and_regenerations(spark):
    log = events(
        spark,
        (1, 0, "a", "message", "user", "hi"),
        (1, 1, "b", "message", "assistant", None),
        (1, 2, "b", "delta", None, "he"),
        (1, 3, "b", "delta", None, "llo"),
        (1, 4, "c", "message", "user", "gone later"),
        (1, 5, "b", "regenerate", None, None),
        (1, 6, "b", "delta", None, "good "),
        (1, 7, "b", "delta", None, "day"),
        (1, 8, "d", "message", "user", "typo"),
        (1, 9, "d", "edit", None, "fixed"),
        (1, 10, "e", "delta", "assistant", "never opened"),
    )
    folded = chat.fold_events(log).orderBy("turn")
    assert [tuple(r) for r in folded.select("turn", "message_id", "role", "text").collect()] == [
        (0, "a", "user", "hi"),
        (1, "b", "assistant", "good day"),
        (2, "d", "user", "fixed"),
        (3, "e", "assistant", "never opened"),
    ]


def turns(spark, *log):
    return spark.createDataFrame(log, "conv_id long, turn long, role string, text string")


@pytest.mark.parametrize("text", ["", None, "\\", "<|", "<\\|", "\\<|im_end|>", chat.INJECTION, "<|im_start|>", "a\nb\\\\|", "日本\U0001f600"])
@pytest.mark.parametrize("role", ["assistant", "user", "od<|im_sep|>d\n\\", "", None])
def test_round_trip(spark, text, role):
    table = turns(spark, (7, 0, "user", "x"), (7, 1, role, text), (7, 2, "assistant", "y"))
    got = chat.read_back(chat.render(chat.fold_events(chat.events_from_turns(table)))).first()
    said = [("user", "x"), (role or "", text or ""), ("assistant", "y")]
    whole = "".join(f"{r}\n{t}\n" for r, t in said)
    loss = "".join(t for r, t in said if r == "assistant")
    assert got["n_turns"] == 3
    assert got["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
    assert (got["loss_chars"], got["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_ties_nulls_and_empty(spark):
    table = turns(spark, (1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "user", "z"), (None, 0, "user", "n"))
    done = chat.render(chat.fold_events(chat.events_from_turns(table.withColumn("line", F.lit(1)))))
    text = {r["conv_id"]: r["formatted"] for r in done.collect()}
    assert re.findall(r"<\|im_sep\|>(.*?)<\|im_end", text[1]) == ["z", "a", "a", "b"]
    assert len(text) == 2 and done.where("size(loss_mask) > 0").count() == 0
    assert chat.read_back(chat.render(chat.fold_events(chat.events_from_turns(table.limit(0))))).count() == 0


# --- mixing


def water(sizes, weights, share, most):
    """Share by weight, stop at the limit, share the excess again until none is above."""
    left, targets = sum(sizes) * share, {}
    open_ = set(range(len(sizes)))
    while open_:
        level = left / sum(weights[i] for i in open_)
        over = {i for i in open_ if level * weights[i] > most * sizes[i]}
        if not over:
            targets |= {i: level * weights[i] for i in open_}
            break
        for i in over:
            targets[i] = most * sizes[i]
            left -= targets[i]
        open_ -= over
    return targets


def test_targets_by_resharing(spark):
    sizes = [10, 500, 40, 1000, 1, 0, 77]
    names = ["a", "b", "c", "d", "e", "f", None]
    table = spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(table).collect()}
    want = water(sizes, [5, 2, 1, 5, 2, 1, 5], 1.5, 2)
    assert got == pytest.approx({names[i]: t for i, t in want.items()})


def mix_rows(docs):
    sized = mixing.measured(docs)
    return mixing.mix(sized, mixing.source_cuts(sized))


def test_mix_epochs_then_smallest_keys(docs_of):
    rnd = random.Random(3)
    docs = docs_of(
        *[(i, "w " * rnd.randint(0, 40), None, rnd.choice(["a", "a", "a", "b", "c", None])) for i in range(600)],
        (1000, None, None, "a"),
        (1001, " \n ", None, "b"),
    )
    got = mix_rows(docs).collect()
    assert len(got) == 602
    by_source = {}
    for r in got:
        assert r["taken"] == r["copies"] * r["size"] and r["taken"] <= 2 * r["size"]
        by_source.setdefault(r["source"], []).append(r)
    for own in by_source.values():
        assert sum(r["size"] for r in own) == own[0]["source_size"]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 40
        assert len({r["copies"] for r in own if r["size"]}) <= 2
    again = mix_rows(docs.repartition(7))
    assert rows(again, "doc_id", "taken") == sorted([(r["doc_id"], r["taken"]) for r in got], key=repr)


def test_mix_buckets_do_not_matter(docs_of):
    docs = docs_of(*[(i, "w " * (i % 13 + 1), None, "ab"[i % 3 > 0]) for i in range(300)])
    sized = mixing.measured(docs)
    took = [rows(mixing.mix(sized, mixing.source_cuts(sized, buckets=b), buckets=b), "doc_id", "taken") for b in (1, 7, 4096)]
    assert took[0] == took[1] == took[2]


@pytest.mark.parametrize("weight", [0.01, 0.36, 1.0])
def test_no_bucket_is_crowded_whatever_the_weights(spark, weight):
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("w w").alias("text"), F.lit("a").alias("source"))
    keys = mixing.measured(docs, weight=F.lit(weight))
    crowd = keys.groupBy(mixing.key_bucket(mixing.BUCKETS)).count().agg(F.max("count")).first()[0]
    assert crowd < 40  # expected at the peak: 10


def test_mixed_documents_keep_columns(docs_of):
    docs = docs_of(*[(i, "w " * 5, "en", "a") for i in range(40)], *[(100 + i, "w " * 5, "en", "b") for i in range(40)], clash=True)
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    assert got.count() == 120  # 150 % of the words, in whole copies of equal size
    assert got.where("size != 'own size'").count() == 0
    assert mixing.mixed_documents(docs.limit(0)).count() == 0
    only = mixing.mixed_documents(docs_of((1, None), (2, "")))
    assert only.count() == 0  # nothing has a word


def test_share_beyond_all_epochs_is_refused(spark):
    with pytest.raises(ValueError, match="epochs"):
        mixing.source_targets(spark.createDataFrame([("a", 1)], "source string, source_size long"), share=(5, 2))


# --- decontamination


ITEM = " ".join(f"word{i}" for i in range(30))


def swapped(text, *places):
    return " ".join("other" if i in places else w for i, w in enumerate(text.split()))


def test_leaks_with_substitutions(spark, docs_of):
    items = spark.createDataFrame([(5, ITEM), (6, "too short"), (7, None), (5, ITEM)], "item_id long, text string")
    filler = " ".join(f"f{i}" for i in range(50))
    docs = docs_of(
        (1, f"{filler}. {ITEM.upper()}! {filler}"),
        (2, f"{filler} {swapped(ITEM, 3, 9, 15, 21, 27)} {filler}"),
        (3, f"{filler} {' '.join(ITEM.split()[:9])} {filler}"),
        (4, filler),
        (5, None),
        (6, ""),
        (7, f"{ITEM} {filler} {ITEM}"),
        (8, " ".join(ITEM.split()[8:26])),
        (None, ITEM),
        (9, "too short"),
        clash=True,
    )
    got = {r["doc_id"]: r for r in decontam.contaminated(docs, items).collect()}
    assert set(got) == {1, 2, 7, 8, None}
    assert (got[1]["first_word"], got[1]["overlap"]) == (50, 1.0)
    assert got[2]["equal_words"] == 25 and got[7]["first_word"] == 0 and got[8]["first_word"] == -8
    left = decontam.decontaminated(docs, items)
    assert left.columns == docs.columns
    assert rows(left, "doc_id") == sorted([(3,), (4,), (5,), (6,), (9,)], key=repr)
    assert decontam.decontaminated(docs.limit(0), items).count() == 0
    assert decontam.decontaminated(docs, items.limit(0)).count() == 10


def test_leaks_of_several_stretches(spark, docs_of):
    """A second copied part, or one stray seed, does not hide a copied stretch."""
    long = " ".join(f"item{i}" for i in range(120))
    items = spark.createDataFrame([(5, long), (6, " ".join(long.split()[:59]).replace("item", "unit"))], "item_id long, text string")
    filler = " ".join(f"f{i}" for i in range(20))
    unit = " ".join(f"unit{i}" for i in range(59))
    docs = docs_of(
        (1, f"{filler} {swapped(long, *range(25, 120))}"),
        (2, f"{filler} {swapped(long, *range(25, 95))} {filler}"),
        (3, swapped(unit, *range(14, 59))),
        (4, swapped(unit, *range(14, 50))),
        (5, swapped(long, *range(20, 80), *range(89, 120))),
        (6, swapped(long, *range(9, 70), *range(79, 120))),
    )
    assert rows(decontam.contaminated(docs, items), "doc_id", "item_id") == [(1, 5), (2, 5), (3, 6), (4, 6), (5, 5)]


def test_accepted_substitutions_leave_a_seed():
    """Every way to keep half of an item, but one of twelve words, leaves a window."""
    ones = [[j for j, bit in enumerate(m) if bit == "1"] for m in decontam.MASKS]
    seeded = lambda kept, n: any({i + j for j in o} <= kept for o in ones for i in range(n))
    missed = [
        kept
        for n in range(decontam.ITEM_WORDS, 18)
        for kept in map(set, itertools.combinations(range(n), (n + 1) // 2))
        if not seeded(kept, n)
    ]
    assert missed == [{0, 1, 5, 6, 10, 11}]
    assert all(seeded(set(kept), 18) for kept in itertools.combinations(range(18), 13))


def test_leaks_with_every_third_word_replaced(spark, docs_of):
    texts = {n: " ".join(f"i{n}w{k}" for k in range(n)) for n in (9, 16, 30, 59)}
    items = spark.createDataFrame(list(texts.items()), "item_id long, text string")
    docs = docs_of(*[(n, f"so {swapped(t, *range(2, n, 3))} on") for n, t in texts.items()])
    got = {(r["doc_id"], r["item_id"]): (r["first_word"], r["equal_words"]) for r in decontam.contaminated(docs, items).collect()}
    assert got == {(n, n): (1, n - n // 3) for n in texts}


def test_leaks_of_repeated_rows(spark, docs_of):
    items = spark.createDataFrame([(5, ITEM)], "item_id long, text string")
    docs = docs_of((1, ITEM), (1, ITEM), (1, "clean " * 20))
    assert rows(decontam.contaminated(docs, items), "doc_id", "item_id") == [(1, 5)]
    assert rows(decontam.decontaminated(docs, items), "text") == [("clean " * 20,)]


def test_masks_of_unequal_length_are_refused(docs_of):
    with pytest.raises(ValueError, match="length"):
        decontam.seeds(docs_of((1, "x")).withColumn("w", F.array(F.lit("x"))), ("101", "1101"))


def test_needed_hits_by_enumeration():
    least = decontam.least_hits(decontam.MASKS, 14)
    ones = [[j for j, bit in enumerate(m) if bit == "1"] for m in decontam.MASKS]
    for n in range(1, 13):
        for k in range(n + 1):
            fewest = min(
                sum(all(p + j in s for j in m) for m in ones for p in range(n))
                for s in map(set, itertools.combinations(range(n), k))
            )
            assert least[n][k] == fewest, (n, k)
    needed = decontam.needed_hits()
    assert [needed[n] for n in (9, 15, 17, 18, 60)] == [1, 2, 3, 1, 8] and needed[12] == 0


def test_decontamination_equals_its_sql_on_split_copies(spark, docs_of):
    """Runs of one item far apart, at the text's end, in mixed order, and near the limits."""
    rnd = random.Random(8)
    item = [[f"i{n}w{j}" if j % 7 else "of" for j in range(n)] for n in (9, 13, 17, 18, 40, 120)]
    other = lambda n: [f"x{rnd.randrange(10**6)}" for _ in range(n)]
    long = item[-1]
    docs = [long[:25] + other(70) + long[95:], other(5) + long[:14] + other(97) + long[111:], long[60:], long[-13:], long[:12]]
    for _ in range(120):
        words = list(rnd.choice(item))
        for j in range(len(words)):
            if rnd.random() < rnd.choice([0.2, 0.45, 0.55]):
                words[j] = f"y{j}"
        docs.append(other(rnd.randrange(4)) + words + other(rnd.randrange(3)))
    documents = docs_of(*[(i, " ".join(w)) for i, w in enumerate(docs)], (900, None), (901, ""))
    items = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(item)] + [(7, None), (8, "a b c")], "item_id long, text string")
    db = duckdb.connect()
    db.register("documents", documents.toPandas())
    db.register("benchmark", items.toPandas())
    want = sorted(tuple(r) for r in db.sql(decontam.DECONTAM_SQL).fetchall())
    got = rows(decontam.contaminated(documents, items), "doc_id", "item_id", "first_word", "item_words", "equal_words", "overlap")
    assert sorted(got) == want
    assert {(0, 5), (2, 5), (3, 5)} <= {r[:2] for r in want} and (4, 5) not in {r[:2] for r in want} and len(want) > 40
