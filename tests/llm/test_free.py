"""SimHash, sharding, classifiers, language, rules: brute force, held-out rows, edge cases."""

from __future__ import annotations

import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from folioforge.llm import language, quality, rules, sampling, sharding, simhash, toxicity


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# --- simhash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a b c", "a b c d", "A b c d É x y", "x y " * 9000, "\x1f a \x85 b"])
def test_fingerprint(text):
    assert simhash.fingerprint_of(text) % (1 << 64) == plain_fingerprint(text)


def test_masks_cover_every_pair_within_the_radius():
    masks = [m % (1 << 64) for m in simhash.covering_masks(4)]
    assert len(masks) == 31
    rnd = random.Random(1)
    for _ in range(3000):
        flips = sum(1 << b for b in rnd.sample(range(64), 4))
        assert any(flips & m == 0 for m in masks)


def brute_components(fps, radius=4):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in root:
        for b in root:
            if (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    groups = {}
    for f in root:
        groups.setdefault(find(f), set()).add(f)
    return sorted(sorted(g) for g in groups.values() if len(g) > 1)


def near_cluster(rnd, size, flips):
    out = [rnd.getrandbits(64)]
    while len(out) < size:
        out.append(rnd.choice(out) ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, flips))))
    return out


@pytest.mark.parametrize("bucket", [1, 2, 5, 4096])
def test_components_equal_brute_force(spark, bucket):
    rnd = random.Random(bucket)
    fps = {f for n, k in ((60, 4), (25, 2), (10, 7), (3, 4)) for f in near_cluster(rnd, n, k)}
    fps |= {rnd.getrandbits(64) for _ in range(80)} | {0, (1 << 64) - 1}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    links = simhash.fingerprint_links(spark.createDataFrame(signed, "fp long"), bucket=bucket)
    assert all(((r["a"] ^ r["b"]) % (1 << 64)).bit_count() <= 4 or bucket > 1 for r in links.collect())
    groups = {}
    for r in simhash.components(links).collect():
        groups.setdefault(r["root"], set()).add(r["node"] % (1 << 64))
    assert sorted(sorted(g) for g in groups.values()) == brute_components(fps)


def test_near_duplicates_edge_cases(docs_of):
    text = " ".join(f"w{i}" for i in range(400))
    docs = docs_of(
        (5, text), (3, text.upper()), (9, text + " "), (9, text + " "), (1, None), (2, ""), (7, "alone here"), (None, "no id"), clash=True
    )
    got = simhash.near_duplicates(docs)
    assert rows(got, "doc_id", "component_id") == sorted(
        [(5, 3), (3, 3), (9, 3), (9, 3), (1, 1), (2, 1), (7, 7), (None, None)], key=repr
    )
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert rows(kept, "doc_id") == sorted([(3,), (1,), (7,), (None,)], key=repr)
    assert kept.where("fp != 'own fp'").count() == 0
    assert simhash.one_of_each(docs.limit(0)).count() == 0


def test_one_row_stays_of_repeated_rows(docs_of):
    a, b = "first text of some words", "another text that differs a lot"
    docs = docs_of((1, a), (1, a), (1, b), (2, b))
    assert rows(simhash.one_of_each(docs), "doc_id", "text") == sorted([(1, a), (1, b)])


def test_odd_radius_has_no_ball(spark):
    rows_ = spark.createDataFrame([(1,), (2,), (3,)], "fp long")
    with pytest.raises(ValueError, match="even"):
        simhash.fingerprint_links(rows_, radius=3, bucket=1)


# --- sharding


def plain_shard(doc_id, shards):
    def score(i):
        seed = xxhash.xxh64_intdigest(struct.pack("<q", doc_id), 42)
        h = xxhash.xxh64_intdigest(struct.pack("<i", i), seed)
        return -1 / math.log(((h >> 11) + 0.5) / (1 << 53))

    return max(range(shards), key=score)


def test_shards_equal_brute_force(docs_of):
    docs = docs_of(*[(i * 37 - 400, f"text {i}") for i in range(300)], clash=True)
    got = sharding.shard_documents(docs).collect()
    for r in got:
        assert r["shard"] == plain_shard(r["doc_id"], 40)
        assert r["grown_shard"] == plain_shard(r["doc_id"], 41)
        assert r["grown_shard"] in (r["shard"], 40)
        assert (r["size"], r["text_crc32"]) == (len(r["text"].encode()) + 16, zlib.crc32(r["text"].encode()))
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(docs.columns) <= set(got[0].asDict())


def test_shard_weights_and_edge_cases(docs_of):
    docs = docs_of(*[(i, "x") for i in range(4000)])
    counts = Counter(r["shard"] for r in sharding.placed(docs, (1.0, 3.0)).select("shard").collect())
    assert 0.7 < counts[1] / 4000 < 0.8
    odd = sharding.shard_documents(docs_of((None, None), (None, ""), (1, "a"), (1, "a"), (1, "é")))
    assert rows(odd, "size", "text_crc32") == sorted([(16, 0), (16, 0), (17, zlib.crc32(b"a")), (17, zlib.crc32(b"a")), (18, zlib.crc32("é".encode()))])
    assert odd.select("shard", "slot").distinct().count() == 5
    assert sharding.shard_documents(docs.limit(0)).count() == 0


# --- sampling and classifiers


def test_sample_is_bounded_and_skips_unusable_rows(spark, docs_of):
    docs = docs_of(*[(i, "t" * (i % 90)) for i in range(900)], (None, "x"), (5, None))
    labels = spark.createDataFrame([(i, i % 2) for i in range(900)] + [(None, 1), (7, None)], "doc_id long, y int")
    sample, totals = sampling.labelled_sample(docs, labels, "y", F.col("doc_id") % 10 != 0, 50, 20)
    assert totals == {0: 360, 1: 450} and 40 < len(sample) <= 200
    assert max(len(t) for t, _ in sample) == 20
    assert sampling.labelled_sample(docs, labels.limit(0), "y", F.lit(True), 50, 20) == ([], {})


def accuracy(df, spark, sf, label):
    got = df.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    y, score = got[label], got["score"].rank()
    auc = (score[y == 1].mean() - (y.sum() + 1) / 2) / (len(y) - y.sum())
    return auc, (got["predicted"] == y).mean()


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    auc, right = accuracy(quality.quality(spark, sf), spark, sf, "quality")
    assert auc > 0.97 and right > 0.96


TOXIC_TEXT = "\n".join(["you utter scum, get lost", "what a moron you are", "the weather is fine today"] * 9)


def plain_toxicity(text, model):
    """The score by its definition: every window by itself, each with compressors of its own."""
    raw = re.sub("[A-Z]", lambda m: m.group().lower(), text or "").encode()
    saved, at = [], 0
    while at == 0 or at < len(raw) - (toxicity.WINDOW - toxicity.STEP):
        window = raw[at : at + toxicity.WINDOW]
        ordinary, toxic = toxicity._compressors(model.ordinary, model.toxic)
        saved.append(len(ordinary.compress(window)) - len(toxic.compress(window)))
        at += toxicity.STEP
    largest = (sorted(saved, reverse=True) + [0, 0])[:3]
    shares = [sum(s >= level for s in saved) / len(saved) for level in toxicity.LEVELS]
    counts = [min(6, sum(s >= level for s in saved)) for level in toxicity.LEVELS]
    values = [*largest, sum(saved) / len(saved), *shares, *counts, math.log(len(saved))]
    z = model.weights[-1]
    for value, mean, scale, weight in zip(values, model.mean, model.scale, model.weights[:-1], strict=True):
        z += (value - mean) / scale * weight
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def test_toxicity_is_the_plain_comparison_of_windows(spark):
    rng = random.Random(5)
    vocabulary = [f"word{i}" for i in range(300)]
    text = lambda y: " ".join(rng.choice([*vocabulary, *["scum", "moron"] * 20 * y]) for _ in range(60))
    model = toxicity.fit_toxicity([(text(y), y) for y in (0, 1) for _ in range(60)], {0: 60, 1: 60})
    assert b"scum" in model.toxic[: -len(model.ordinary)] and model.toxic.endswith(model.ordinary)
    texts = [None, "", "a", "SCUM " * 30, TOXIC_TEXT, TOXIC_TEXT * 40, "é😀" * 50, *[text(y) for y in (0, 1) for _ in range(5)]]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: r.s for r in df.select("i", toxicity.toxicity_score(F.col("text"), model).alias("s")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(plain_toxicity(t, model), abs=1e-9)


def test_few_samples_are_a_dictionary_as_they_are():
    assert toxicity._trained([], 2000, k=toxicity.SEGMENT, d=toxicity.MATCH) == b""
    assert toxicity._trained([b" scum "], 2000, k=toxicity.SEGMENT, d=toxicity.MATCH) == b" scum "


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    auc, right = accuracy(toxicity.toxicity(spark, sf), spark, sf, "toxic")
    assert auc > 0.92 and right > 0.94


def test_language_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = language.language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert got.where("held_out").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


def small_model():
    good = [(f"the ordinary line number {i} of plain words", 1) for i in range(60)]
    bad = [(f"$$$ ### {i} *** &&& !!! ###", 0) for i in range(60)]
    return quality.fit_quality(good + bad, {0: 60, 1: 60})


ODD_TEXTS = [None, "", " ", "x", "日本語", "word " * 60_000, "a" * 511, "a" * 512, "a" * 513]


def test_scores_of_odd_texts(docs_of):
    docs = docs_of(*enumerate(ODD_TEXTS), (None, "x"), clash=True)
    got = docs.select("doc_id", quality.quality_score(F.col("text"), small_model()).alias("q"))
    assert all(0 <= r["q"] <= 1 for r in got.collect()) and got.count() == len(ODD_TEXTS) + 1
    toxic = toxicity.fit_toxicity(
        [(f"plain words number {i} of a page", 0) for i in range(80)] + [(f"you {i} vile fool of {i} a page", 1) for i in range(80)], {0: 80, 1: 80}
    )
    scores = docs.select(toxicity.toxicity_score(F.col("text"), toxic).alias("s")).collect()
    assert all(0 <= r["s"] <= 1 for r in scores)
    assert docs.limit(0).select(toxicity.toxicity_score(F.col("text"), toxic)).count() == 0


def test_without_labels_nothing_is_rejected():
    assert quality.fit_quality([], {}) is None and quality.fit_quality([("a", 1)] * 9, {1: 9}) is None
    assert toxicity.fit_toxicity([], {}) is None and toxicity.fit_toxicity([("a", 0)], {0: 1}) is None


def test_chunks_cover_the_whole_text():
    for n in (0, 1, 511, 512, 513, 960, 961, 5000):
        chunks = quality.chunks_of("a" * n)
        assert (chunks == ord("a")).any() == (n > 0) and chunks.shape[1] == quality.CHUNK
        covered = (len(chunks) - 1) * quality.STEP + quality.CHUNK
        assert covered >= n and (len(chunks) == 1 or (chunks[-1] != 0).all())


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    model = quality._start(rng)
    for k in quality._TRAINED:
        setattr(model, k, getattr(model, k).astype(np.float64))
    chunks = rng.integers(1, 255, (4, quality.CHUNK)).astype(np.uint8)
    y, weight = np.array([1.0, 0, 1, 0]), np.ones(4)

    def loss():
        p = 1 / (1 + np.exp(-quality.chunk_values(model, chunks)))
        return -(np.log(np.where(y == 1, p, 1 - p))).mean()

    found = quality._gradients(model, chunks, y, weight)
    for k in ("filters", "hidden", "out", "shift"):
        at = np.unravel_index(np.abs(found[k]).argmax(), found[k].shape)
        array, keep = getattr(model, k), getattr(model, k)[at]
        array[at] = keep + 1e-5
        up = loss()
        array[at] = keep - 1e-5
        down = loss()
        array[at] = keep
        assert (up - down) / 2e-5 == pytest.approx(found[k][at], rel=1e-2)


# --- language


def plain_distance(text, profile_text):
    def order(t):
        kept = b" " + b" ".join(re.sub(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]", b" ", t.lower().encode()).split()) + b" "
        grams = Counter(kept[i : i + n] for n in (1, 2, 3) for i in range(len(kept) - n + 1))
        return sorted(grams, key=lambda g: (-grams[g], int.from_bytes(g)))[: language.PROFILE]

    mine, theirs = order(text), {g: i for i, g in enumerate(order(profile_text))}
    return sum(abs(theirs[g] - i) if g in theirs else language.PROFILE for i, g in enumerate(mine))


def test_distances_equal_brute_force():
    one, two = "the cat sat on the mat and the dog", "le chat était sur la maison où l'été"
    profiles = language.fit_profiles([(one, "en"), (two, "fr")])
    for text in ("the dog", "été là", "zzz", "The  CAT, the\ncat"):
        assert language.distances(text, profiles).tolist() == [plain_distance(text, one), plain_distance(text, two)]


def test_language_of_odd_texts(docs_of):
    profiles = language.fit_profiles([("the cat and the dog", "en"), ("der Hund und die Katze", "de"), ("12", "xx")])
    assert profiles.languages == ["de", "en"]
    docs = docs_of(
        (1, None), (2, ""), (3, "123 !?"), (4, "und der"), (5, "the " * 50_000),
        (6, "½ 12"), (7, "x² Ⅷ"), (8, "²Ⅷ"), clash=True,
    )
    got = docs.select("doc_id", language.language_of(F.col("text"), profiles).alias("f")).select("doc_id", "f.lang_pred", "f.score")
    found = [r["lang_pred"] for r in got.orderBy("doc_id").collect()]
    assert found[:6] == ["und", "und", "und", "de", "en", "und"]
    assert found[6] in ("de", "en") and found[7] == "und"  # a letter beside numerals; numerals alone
    assert all(0 <= r["score"] <= 1 for r in got.collect())
    assert language.fit_profiles([]) is None
    assert docs.select(language.language_of(F.col("text"), None).alias("f")).where("f.lang_pred != 'und'").count() == 0


# --- rules


def plain_repeats(words):
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    return len({i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)})


def test_repeated_words_equal_brute_force():
    rnd = random.Random(8)
    for _ in range(300):
        words = [rnd.choice([b"a", b"b", b"c"]) for _ in range(rnd.randint(0, 60))]
        assert rules.repeated_words(words) == plain_repeats(words)
    assert rules.repeated_words([b"x"] * 30_000) == 30_000


def test_verdict_does_not_depend_on_the_order(docs_of):
    docs = docs_of(
        (1, None), (2, ""), (3, "word " * 30), (4, " ".join(f"w{i}" for i in range(30))), (5, "same line\n" * 40),
        (6, " ".join(f"#{i}$*" for i in range(30))), (7, " ".join(f"w{i}!" for i in range(30))), (8, "w" * 40_000), clash=True,
    )
    for order in (list(rules.RULES), list(rules.RULES)[::-1]):
        got = docs.select("doc_id", rules.judged(F.col("text"), order).alias("j")).where("j.kept")
        assert rows(got, "doc_id") == [(4,)]
        full = docs.select("doc_id", rules.reported(F.col("text"), order).alias("r")).select("doc_id", "r.*")
        assert rows(full.where("kept"), "doc_id") == [(4,)]
        assert rows(full.where("doc_id = 5"), "n_words", "n_dup_lines", "n_repeat_words", "base_failed") == [(80, 39, 80, True)]


def test_order_puts_rejections_per_cost_first():
    slow = rules.Rule("slow", lambda p: sum(range(20_000)) >= 0 and len(p.text) > 3)
    quick = rules.Rule("quick", lambda p: len(p.text) > 3)
    never = rules.Rule("never", lambda p: False)
    assert [r.name for r in rules.cascade_order(["long text"] * 20, [never, slow, quick])] == ["quick", "slow", "never"]
    assert [r.name for r in rules.cascade_order([], [never, slow])] == ["never", "slow"]
    page = rules.Page("x")
    assert rules.first_failed(page, rules.RULES) == "few_words" and "n_repeat_words" not in page.__dict__
