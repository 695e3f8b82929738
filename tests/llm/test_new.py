"""Conversation repair, context mixing and importance resampling: brute force, edge cases."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioforge.llm import common, importance, repair, scoring

# --- conversation repair

AFTER = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def brute_repair(symbols):
    """Cheapest edits by search over whole edit strings, cost first, then ASCII."""
    queue = [(0, "", 0, "")]
    while queue:
        cost, edits, at, state = heapq.heappop(queue)
        if at == len(symbols) and state in ("", "a"):
            return cost, edits
        if len(edits) > len(symbols) + 4:
            continue
        due = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
        heapq.heappush(queue, (cost + 3, edits + "I", at, due))
        if at < len(symbols):
            symbol = symbols[at]
            heapq.heappush(queue, (cost + 4, edits + "D", at + 1, state))
            if symbol != "D":
                extra = 3 if symbol.isupper() else 0
                heapq.heappush(queue, (cost + extra + 3, edits + "R", at + 1, due))
                if (state, symbol.lower()) in AFTER:
                    heapq.heappush(queue, (cost + extra, edits + "K", at + 1, AFTER[state, symbol.lower()]))
    raise AssertionError


def by_blocks(symbols, spacing):
    """The operator's own steps, block by block, without Spark."""
    blocks = [{"block": i, "text": symbols[i : i + spacing]} for i in range(0, len(symbols), spacing)]
    for b in blocks:
        b["matrix"] = repair.cost_matrix(b["text"])
    folded = repair._fold_back(blocks)
    ends = {c["block"]: tuple(c["ends"]) for c in folded["checkpoints"]}
    for b in blocks:
        walked = [repair.walk(b["text"], ends[b["block"]], s, b is blocks[-1]) for s in range(4)]
        b["exits"], b["edits"] = [w[0] for w in walked], [w[1] for w in walked]
    entry = {e["block"]: e["entry"] for e in repair._fold_on(blocks)}
    return folded["cost"], "".join(b["edits"][entry[b["block"]]] for b in blocks)


def test_repair_equals_brute_force_on_all_short_conversations():
    for length in range(1, 4):
        for symbols in itertools.product("DsuaoSUAO", repeat=length):
            want = brute_repair(symbols)
            assert by_blocks("".join(symbols), 1) == want, symbols
            assert by_blocks("".join(symbols), 100) == want, symbols


@pytest.mark.parametrize("spacing", [1, 2, 3, 7])
def test_repair_does_not_depend_on_the_spacing(spacing):
    rnd = random.Random(spacing)
    for _ in range(60):
        symbols = "".join(rnd.choices("DsuaoSUAO", k=rnd.randint(4, 40)))
        assert by_blocks(symbols, spacing) == by_blocks(symbols, 1000)
        if len(symbols) < 8:
            assert by_blocks(symbols, spacing) == brute_repair(symbols)


CONVERSATIONS = "conv_id long, turn long, role string, text string"


def repaired(spark, rows, spacing=repair.SPACING, clash=False):
    df = spark.createDataFrame(rows, CONVERSATIONS)
    if clash:
        df = df.withColumns({c: F.lit(f"own {c}") for c in ("pos", "block", "edits", "cost", "said", "fault", "n", "root")})
    found, messages = repair.repaired(df, spacing)
    said = {}
    for r in sorted(messages.collect(), key=lambda r: (r["conv_id"] is not None, r["conv_id"], r["place"])):
        said.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    digests = {r[0]: r[1] for r in repair.message_digests(messages).collect()}
    for conv, texts in said.items():
        assert digests[conv] == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in texts).encode()).hexdigest()
    assert set(digests) == set(said)
    return {r["conv_id"]: r.asDict() for r in found.collect()}, said


def test_repair_of_odd_conversations(spark):
    rows = [
        (1, 0, "user", "A question?"), (1, 1, "assistant", "An answer."),
        (2, None, "system", "Be kind."), (2, 0, "user", "Hi."), (2, 3, "user", "Hi."), (2, 7, "assistant", "No end"),
        (None, 5, None, None), (None, 5, "tool", " x. \n"),
        (4, None, "assistant", ""), (4, None, "assistant", "\t"),
        (5, 1, "", "Empty role."),
    ]
    found, said = repaired(spark, rows, clash=True)
    assert found[1]["audit"] == "KK" and found[1]["cost"] == 0 and found[1]["gaps"] == 0
    assert said[1] == [("user", "A question?"), ("assistant", "An answer.")]
    assert (found[2]["gaps"], found[2]["duplicate"], found[2]["truncated"], found[2]["illegal"]) == (5, 1, 1, 1)
    assert (found[2]["audit"], found[2]["cost"]) == ("KKDK", 7)
    assert said[2] == [("system", "Be kind."), ("user", "Hi."), ("assistant", "No end")]
    assert (found[None]["blank"], found[None]["gaps"], found[None]["illegal"]) == (1, 0, 1)
    assert (found[None]["audit"], found[None]["cost"]) == ("DD", 8)
    assert (found[4]["audit"], found[4]["gaps"], found[4]["blank"]) == ("DD", 0, 2) and 4 not in said
    assert (found[5]["audit"], found[5]["cost"]) == ("D", 4)
    assert repaired(spark, []) == ({}, {})


@pytest.mark.parametrize("spacing", [1, 3])
def test_repair_of_a_long_conversation_in_blocks(spark, spacing):
    rnd = random.Random(spacing)
    rows = [
        (conv, t, rnd.choice(["user", "assistant", "system", "tool"]), rnd.choice(["One.", "Two", "", f"Own {t}!", f"{t}"]))
        for conv in (0, 9)
        for t in range(60)
    ]
    assert repaired(spark, rows, spacing) == repaired(spark, rows)
    seen, symbols = set(), ""
    for _, _, role, text in rows[:60]:
        if not text.strip() or (role, text) in seen:
            symbols += "D"
        else:
            letter = role[0] if role[0] in "sua" else "o"
            symbols += letter if text[-1] in ".!?" else letter.upper()
        seen.add((role, text))
    cost, audit = by_blocks(symbols, 1000)
    got = repaired(spark, rows, spacing)[0][0]
    assert (got["cost"], got["audit"]) == (cost, audit)


def test_blocks_widen_with_the_square_root(spark):
    rows = [(1, t, "user", f"{t}.") for t in range(50)]
    numbered = repair.numbered(spark.createDataFrame(rows, CONVERSATIONS))
    sizes = repair.with_blocks(numbered, 2).groupBy("block").count()
    assert sizes.agg(F.max("count")).first()[0] <= 8


# --- importance resampling


def plain_counts(text, buckets, longest):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    runs = [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
    return words, Counter(zlib.crc32(r.encode()) % buckets for r in runs)


def plain_importance(docs, target, buckets, longest, share, least):
    counted = [(d, *plain_counts(t, buckets, longest)) for d, t in docs]
    s, t = Counter(), Counter()
    for _, _, c in counted:
        s.update(c)
    for text in target:
        t.update(plain_counts(text, buckets, longest)[1])
    rows = []
    for d, words, c in counted:
        total = sum(
            n * math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
            for b, n in c.items()
        )
        weight = total // c.total() if c else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([d, len(words), c.total(), weight, score, None])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0], r[2]))
    for rank, row in enumerate(able[: share[0] * len(able) // share[1]]):
        row[5] = rank + 1
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize(("buckets", "longest"), [(10_000, 1), (64, 2), (7, 3)])
def test_importance_equals_brute_force(spark, docs_of, buckets, longest):
    rnd = random.Random(buckets)
    words = ["Alpha", "beta", "éa", "x1", "GAMMA", "delta", "Ü", "of", "the"]
    docs = [(i, " ".join(rnd.choices(words, k=rnd.randint(0, 40)))) for i in range(60)]
    docs += [(60, None), (61, ""), (62, "-- !"), (63, "the " * 70_000), (None, "alpha beta " * 9), (5, docs[5][1])]
    target = ["alpha beta éa alpha", None, "Ü!", "gamma-x1"]
    df = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resampled(
        docs_of(*docs, clash=True), df, ("size", "score", "n_chars"), longest, buckets, share=(1, 3), least_words=3
    )
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank", "size", "n_chars"]
    rows = got.collect()
    assert all(r["size"] == "own size" for r in rows)
    want = plain_importance(docs, target, buckets, longest, (1, 3), 3)
    assert sorted((tuple(r)[:6] for r in rows), key=repr) == want


def test_importance_counts_a_batch_in_slices(spark, docs_of, monkeypatch):
    texts = ["a b c", None, "", "d " * 40, "e f", "g", "a a"]
    batch = pa.RecordBatch.from_pydict({"raw": pa.array([t and t.encode() for t in texts], pa.binary())})
    slices = list(common.by_bytes(batch, "raw", 6))
    assert [s.column("raw").to_pylist() for s in slices] == [[b"a b c", None, b""], [b"d " * 40], [b"e f", b"g"], [b"a a"]]
    assert list(common.by_bytes(batch.slice(0, 0), "raw", 6)) == []

    seen = []
    counted = importance.hashed_features
    monkeypatch.setattr(importance, "COUNTED_BYTES", 6)
    monkeypatch.setattr(importance, "hashed_features", lambda raw, *rest: seen.append(len(raw)) or counted(raw, *rest))
    docs = docs_of((1, "a"))
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, run, schema: run)
    run = importance.with_features(docs)
    ids = pa.array(range(7), pa.int64())
    own = pa.StructArray.from_arrays([pa.nulls(7, pa.int64())], ["none"])
    out = list(run(iter([pa.RecordBatch.from_arrays([own, ids, batch.column("raw")], ["own", "doc_id", "raw"])])))
    assert seen == [3, 1, 2, 1]
    assert [n for b in out for n in b.column("n_features").to_pylist()] == [3, 0, 0, 40, 2, 1, 2]


def test_importance_of_empty_tables(spark, docs_of):
    target = spark.createDataFrame([("a b",)], "text string")
    assert importance.resampled(docs_of((1, "a")).limit(0), target).collect() == []
    docs = docs_of((1, "a b"), (2, None))
    got = importance.resampled(docs, target.limit(0), share=(1, 1), least_words=0).collect()
    assert sorted((r["doc_id"], r["weight"]) for r in got) == [
        (r[0], r[3]) for r in plain_importance([(1, "a b"), (2, None)], [], 10_000, 1, (1, 1), 0)
    ]
    assert sorted(r["rank"] for r in got) == [1, 2]


def test_sliced_sums_are_exact():
    rng = np.random.default_rng(3)
    for low, high in ((-5000, 9000), (-3, 0), (0, 1), (0, 4000), (-(1 << 20), -1)):
        gain = rng.integers(low, high, 200, endpoint=True)
        counts = rng.integers(0, 1 << 18, (5, 200)) * (rng.random((5, 200)) < 0.2)
        row, place = np.nonzero(counts)
        got = importance.sliced_sums(5, row, place, counts[row, place], importance.gain_planes(gain), 200)
        assert (got == counts @ gain).all()


# --- language-model scores


def plain_bits(text, model):
    """The model as plain loops: one bit after another, blocks by their rule."""
    tree, orders = model.tree, scoring.ORDERS
    weights = [[float(x) for x in row] for row in model.weights]
    padded = bytes(8) + text
    cost = 0.0
    for low, high in scoring.block_bounds(len(text) + 1):
        grads, counts = [[0.0] * len(row) for row in weights], [0] * len(weights)
        for p in range(low, high):
            leaf = scoring.END if p == len(text) else int(tree.leaf[text[p]])
            cost += tree.escaped if leaf == scoring.ESCAPE else 0
            slots = []
            for order in orders:
                number = int.from_bytes(padded[p + 8 - order : p + 8][::-1], "little")
                slots.append(((number + 1) * int(scoring._FACTORS[order]) % (1 << 64)) >> (64 - scoring.SLOTS.bit_length() + 1))
            for d in range(tree.depth[leaf]):
                node, bit = int(tree.node[d, leaf]), int(tree.bit[d, leaf])
                x = [float(model.odds[c, s * scoring.LEAVES + node]) for c, s in enumerate(slots)] + [1.0]
                one = 1 / (1 + math.exp(-sum(a * b for a, b in zip(weights[d], x, strict=True))))
                cost -= math.log(one if bit else 1 - one)
                counts[d] += 1
                for i, v in enumerate(x):
                    grads[d][i] += (bit - one) * v
        for d, row in enumerate(weights):
            if counts[d]:
                for i in range(len(row)):
                    row[i] += scoring.RATE / (counts[d] + scoring.DAMPING) * grads[d][i]
    return cost


@pytest.fixture(scope="module")
def small_model():
    rnd = random.Random(9)
    texts = [" ".join(rnd.choices(["alpha", "beta", "été", "of", "the"], k=60)).encode() for _ in range(40)]
    tree = scoring.build_tree(texts[:10])
    leaf, starts, _ = scoring.coded([scoring._padded(t) for t in texts], [True] * len(texts), tree)
    size = scoring.SLOTS * scoring.LEAVES
    leaves = np.stack([np.bincount(s + leaf, minlength=size) for s in starts]).reshape(-1, scoring.SLOTS, scoring.LEAVES)
    return texts, leaves, scoring.fit_model(texts[:10], leaves, tree)


def test_context_mixing_equals_plain_loops(small_model):
    texts, _, model = small_model
    odd = [b"", b"z", "Ωß".encode(), texts[0], texts[1] * 9, b"\0" * 300, bytes(range(256)) * 3]
    got = scoring.coding_costs(odd, model, model.odds.astype(np.float32))
    for text, cost in zip(odd, got, strict=True):
        assert cost == pytest.approx(plain_bits(text, model), rel=2e-4), text[:20]
    alone = [scoring.coding_costs([t], model, model.odds.astype(np.float32))[0] for t in odd]
    assert alone == pytest.approx(list(got), rel=1e-6)


def test_next_bytes_and_end_share_one_probability(small_model):
    """Summed over all texts of at most one byte, with the rest of each one's mass."""
    _, _, model = small_model
    costs = scoring.coding_costs([b"", *[bytes([b]) for b in range(256)]], model, model.odds.astype(np.float32))
    # the end after one byte, from its plain cost: the byte alone is what is left of the whole
    left = []
    for b in range(256):
        slots = [((number + 1) * int(scoring._FACTORS[o]) % (1 << 64)) >> (65 - scoring.SLOTS.bit_length())
                 for o in scoring.ORDERS for number in [b]]
        cost = 0.0
        for d in range(model.tree.depth[scoring.END]):
            node, bit = int(model.tree.node[d, scoring.END]), int(model.tree.bit[d, scoring.END])
            x = [float(model.odds[c, s * scoring.LEAVES + node]) for c, s in enumerate(slots)] + [1.0]
            one = 1 / (1 + math.exp(-sum(float(w) * v for w, v in zip(model.weights[d], x, strict=True))))
            cost -= math.log(one if bit else 1 - one)
        left.append(math.exp(cost - costs[1 + b]))
    assert math.exp(-costs[0]) + sum(left) == pytest.approx(1, rel=1e-3)


def test_alphabet_follows_all_training_texts(spark, docs_of):
    """Bytes far into long texts and of every document count, and nothing is drawn."""
    docs = [(i, "a" * 5000 + chr(0x100 + i % 700)) for i in range(900)] + [(901, None), (902, "")]
    seen, texts = scoring.byte_counts(docs_of(*docs))
    want = Counter(b for _, t in docs for b in (t or "").encode())
    assert texts == 902 and {b: n for b, n in enumerate(seen.tolist()) if n} == dict(want)
    assert not hasattr(scoring, "labelled_sample")


def test_scores_equal_plain_counts(spark, docs_of):
    rnd = random.Random(4)
    words = ["Alpha", "beta", "ÉTÉ", "of", "the", "a\x85b", "-"]
    docs = [(i, " ".join(rnd.choices(words, k=rnd.randint(0, 30)))) for i in range(80)]
    docs += [(80, None), (81, ""), (82, " \t\n"), (83, "the " * 60_000), (None, "beta unseen"), (7, docs[7][1]), (7, "other text")]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    lower = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    seen = Counter()
    for d, t in docs:
        if not held(d):
            seen.update([*lower(t), " "])
    total = seen.total() + 0.1 * (len(seen) + 1)
    want = sorted(
        (repr(d), len(lower(t)) + 1, sum(w in seen for w in [*lower(t), " "]), seen.total(),
         round(sum(math.log10((seen[w] + 0.1) / total) for w in [*lower(t), " "]), 6))
        for d, t in docs
    )
    not_held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(10)) != 0
    got = scoring.language_scores(docs_of(*docs, clash=True), not_held).collect()
    assert sorted((repr(r[0]), r[1], r[2], r[3], round(r[4], 6)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    by_id = {r["doc_id"]: r["score"] for r in got}
    assert by_id[80] == by_id[81] > by_id[82]


def test_rare_tokens_go_through_the_join(spark, docs_of, monkeypatch):
    docs = [(i, f"w{i % 7} common common w{i}") for i in range(60)]
    every = lambda: sorted((r[0], r[2], round(r[4], 9)) for r in scoring.language_scores(docs_of(*docs), F.lit(True)).collect())
    want = every()
    monkeypatch.setattr(scoring, "FREQUENT", 2)
    assert every() == want
    monkeypatch.setattr(scoring, "FREQUENT_BYTES", -1)
    assert every() == want


def test_scores_without_training_rows(spark, docs_of):
    docs = docs_of((1, "a b"), (2, None))
    got = {r["doc_id"]: r for r in scoring.language_scores(docs, F.lit(False)).collect()}
    assert (got[1]["n_tokens"], got[1]["n_known"], got[1]["train_tokens"], got[1]["base_score"]) == (3, 0, 0, 0.0)
    assert got[1]["score"] < got[2]["score"] < 0
    assert scoring.language_scores(docs.limit(0), F.lit(True)).collect() == []


def test_model_beats_bytes_without_context(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(10)) == 0
    scores = scoring.language_scores(docs, ~held).join(docs, "doc_id").where(held)
    bits, size = scores.agg(F.sum("score"), F.sum(F.octet_length("text"))).first()
    assert -bits / math.log10(2) / size < 2.9


def test_scoring_counts_tokens_straight(docs_of, monkeypatch):
    texts = [b"B a a", None, b"", b"a c"]
    tree, docs, ran = scoring.build_tree([t or b"" for t in texts]), docs_of((1, "a")), []

    def run_here(df, run, schema):
        monkeypatch.setattr(scoring, "tokens_of", None)  # no counter of its own for a text
        batch = pa.RecordBatch.from_pydict({"raw": pa.array(texts, pa.binary())})
        ran.extend(row for out in run(iter([batch])) for row in out.to_pylist())
        return df.select(F.lit(b"").alias("token"), F.lit(1).alias("cell"), F.lit(1).alias("n"))

    monkeypatch.setattr(type(docs), "mapInArrow", run_here)
    scoring.gathered(docs, tree)
    assert {r["token"]: r["n"] for r in ran if r["cell"] < 0} == {b"": 4, b"a": 3, b"b": 1, b"c": 1}
    assert sum(r["n"] for r in ran if r["cell"] >= 0) == len(scoring.ORDERS) * (5 + 0 + 0 + 3 + 4)

    # the slots of a place, taken by the integers of the bytes before it
    text = b"Some text, \xc3\xa4 and more."
    _, starts, _ = scoring.coded([scoring._padded(text)], [True], tree)
    for back, start in zip(scoring.ORDERS, starts, strict=True):
        before = [int.from_bytes((bytes(8) + text)[8 + i - back : 8 + i]) for i in range(len(text) + 1)]
        slots = [((b + 1) * int(scoring._FACTORS[back]) % (1 << 64)) >> (65 - scoring.SLOTS.bit_length()) for b in before]
        assert start.tolist() == [s * scoring.LEAVES for s in slots]


def test_bits_of_all_depths_are_worked_out_together(small_model, monkeypatch):
    """One pass a group of places, not one a depth, and the same whatever the groups are."""
    texts, _, model = small_model
    assert (np.round(model.odds * 16.0) == model.odds * 16.0).all() and model.tree.node.shape[0] > 2
    some, passes, exp = [*texts, b"", texts[0] * 40], [], np.exp
    monkeypatch.setattr(np, "exp", lambda *args, **more: passes.append(1) or exp(*args, **more))
    odds = model.odds.astype(np.float32)
    want = scoring.coding_costs(some, model, odds)
    assert len(passes) == len(scoring.block_bounds(max(map(len, some)) + 1))
    monkeypatch.setattr(scoring, "PLACES", 700)
    assert scoring.coding_costs(some, model, odds) == pytest.approx(list(want), rel=1e-6)
    assert len(passes) > 20


def test_stretches_hold_the_odds_of_every_way(small_model):
    _, _, model = small_model
    tree, slot = model.tree, 12345
    assert model.along is model.along and all(a.odds.itemsize == 4 for a in model.along)
    for leaf in range(scoring.LEAVES):
        for d in range(tree.node.shape[0]):
            a, j = model.along[d // scoring.STRETCH], d % scoring.STRETCH
            sign = 0 if d >= tree.depth[leaf] else 1 - 2 * int(tree.bit[d, leaf])
            assert a.bias[[a.way[leaf]]].view(np.int8)[j] == sign * scoring.STEPS
            for c in range(len(scoring.ORDERS)):
                got = a.odds[c, [slot * a.ways + a.way[leaf]]].view(np.int8)[j] / scoring.STEPS
                assert got == sign * float(model.odds[c, slot * scoring.LEAVES + tree.node[d, leaf]])


def test_words_are_counted_by_arrow_as_python_splits_them():
    texts = [b" a\x1cb\x85c\xa0D \x0b\x0ce\tf\n", b"", None, b" ", b"\xff\xfe A\xc3\x84 a A\xc3\x84", b"D d\0 d"]
    word, n = scoring.counted_words([pa.array(texts[:3], pa.binary()), pa.array(texts, pa.binary()).slice(3)])
    want = Counter(w for t in texts for w in (t or b"").translate(scoring._LOWER).split())
    assert word.type == pa.binary() and dict(zip(word.to_pylist(), n.to_pylist(), strict=True)) == want
    assert [len(a) for a in scoring.counted_words([])] == [0, 0]


def test_weights_are_learned_from_every_training_place(docs_of, monkeypatch):
    """A Newton step by plain loops: each place is predicted from the counts of all others."""
    rnd = random.Random(2)
    texts = [" ".join(rnd.choices(["alpha", "beta", "été", "of"], k=rnd.randint(0, 25))) for _ in range(30)] + [None, "", "of " * 90]
    sent = []
    scored = scoring.scored
    monkeypatch.setattr(scoring, "scored", lambda *args: sent.append(args[-1].value) or scored(*args))
    monkeypatch.setattr(scoring, "PLACES", 100)  # the longest texts are cut
    docs = [(i, t) for i, t in enumerate(texts)] + [(99, "held out " * 50)]
    scoring.language_scores(docs_of(*docs), F.col("doc_id") != 99)

    model, raw = sent[0], [(t or "").encode() for t in texts]
    tree = model.tree
    leaf, starts, _ = scoring.coded([scoring._padded(t) for t in raw], [True] * len(raw), tree)
    counts = Counter()
    seen = [
        (d, [(c, int(s[i]) + int(tree.node[d, x])) for c, s in enumerate(starts)], int(tree.bit[d, x]))
        for i, x in enumerate(leaf.tolist())
        for d in range(tree.depth[x])
    ]
    for _, cells, bit in seen:
        counts.update((*cell, bit) for cell in cells)
    want = scoring.first_weights(tree).astype(float)
    grads, curves = np.zeros(want.shape), np.zeros((*want.shape, want.shape[1]))
    for d, cells, bit in seen:
        ones_zeros = [(counts[*cell, 1] - bit + 0.4, counts[*cell, 0] - (1 - bit) + 0.4) for cell in cells]
        x = np.array([round(16 * max(-8, min(8, math.log(a / b)))) for a, b in ones_zeros] + [16])
        x = np.clip(x, -127, 127) / 16
        one = 1 / (1 + math.exp(-want[d] @ x))
        grads[d] += (one - bit) * x
        curves[d] += one * (1 - one) * np.outer(x, x)
    for d in range(len(want)):
        want[d] -= np.linalg.solve(curves[d] + scoring.HOLD * np.eye(4), grads[d])
    assert np.abs(want - scoring.first_weights(tree)).max() > 0.1
    assert model.weights == pytest.approx(np.clip(want, -2, 2), abs=2e-3)
