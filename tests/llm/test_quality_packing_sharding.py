import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from scenelake.llm import packing, quality, sharding
from tests.llm.docs import AWKWARD, prose, table

W = r"[^\x20\x09-\x0D]+"


def expected(x):
    w = re.findall(W, x)
    c = Counter(zip(w, w[1:], w[2:], strict=False))
    cover = set()
    for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)):
        if c[g] > 1:
            cover |= {i, i + 1, i + 2}
    lines = [s for s in x.split("\n") if re.search(W, s)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), len(lines) - len(set(lines)), len(cover))


def test_quality_statistics_match_brute_force(spark):
    texts = [*AWKWARD, "a b c a b c a b", "x y z\nx y z\nx y z", "a a a a", "# | <b> & $5 % *", *(prose(i, 40 + i) for i in range(20))]
    rows = quality.digest(quality.judge(table(spark, texts))).collect()
    for r in rows:
        want = expected(texts[r["doc_id"]] or "")
        assert tuple(r[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    assert len(rows) == len(texts)


def test_weak_supervision_keeps_prose_and_drops_junk(spark):
    good = [prose(i, 300) for i in range(60)]
    shouting = [prose(i, 200).upper().replace(" ", "!! ") for i in range(100, 104)]
    symbols = [prose(i, 200).replace(" ", "### ") for i in range(200, 204)]
    kept = {r["doc_id"]: r["quality"]["kept"] for r in quality.judge(table(spark, good + shouting + symbols)).collect()}
    assert all(kept[i] for i in range(60)) and not any(kept[i] for i in range(60, 68))
    assert quality.judge(table(spark, ["x"]).where("false")).count() == 0


def test_a_table_that_is_mostly_junk_is_told_as_such(spark):
    good = [prose(i, 300) for i in range(40)]
    junk = [prose(i, 120).upper().replace(" ", "!! ") for i in range(100, 160)] + [prose(i, 120).replace(" ", " | ") for i in range(200, 260)] + [prose(i, 120).replace(" ", " ### ") for i in range(300, 360)]
    kept = {r["doc_id"]: r["quality"]["kept"] for r in quality.judge(table(spark, good + junk)).collect()}
    assert all(kept[i] for i in range(40)) and not any(kept[i] for i in range(40, 220))
    none = {r["doc_id"]: r["quality"]["kept"] for r in quality.judge(table(spark, junk)).collect()}
    assert not any(none.values())


def plain_posteriors(patterns, spec):
    """The same expectation-maximisation over one row per document, in logarithms."""
    m = len(patterns[0])
    prior, good, bad = spec.prior, [spec.good_accuracy[0]] * m, [spec.bad_accuracy[0]] * m

    def post(p):
        a = np.log(prior) + sum(np.log(g if v > 0 else 1 - g) for v, g in zip(p, good, strict=True) if v)
        b = np.log(1 - prior) + sum(np.log(1 - h if v > 0 else h) for v, h in zip(p, bad, strict=True) if v)
        return float(np.exp(a - np.logaddexp(a, b)))

    for _ in range(spec.rounds):
        w = np.array([post(p) for p in patterns])
        v = np.array(patterns)
        g = (spec.strength * spec.good_accuracy[0] + ((v > 0) * w[:, None]).sum(0)) / (spec.strength + ((v != 0) * w[:, None]).sum(0))
        b = (spec.strength * spec.bad_accuracy[0] + ((v < 0) * (1 - w)[:, None]).sum(0)) / (spec.strength + ((v != 0) * (1 - w)[:, None]).sum(0))
        good = np.clip(g, *spec.good_accuracy[1:]).tolist()
        bad = np.minimum(np.maximum(np.maximum(b, spec.bad_accuracy[1]), spec.least_ratio * (1 - np.array(good))), spec.bad_accuracy[2]).tolist()
        prior = min(0.99, max(spec.least_prior, float(w.mean())))
    return [post(p) for p in patterns]


def test_posteriors_and_verdicts_match_brute_force(spark):
    texts = [*AWKWARD, *(prose(i, 60 + 5 * i) for i in range(60)), *(prose(i, 150).upper() for i in range(70, 76)), *(prose(i, 90).replace(" ", " | ") for i in range(80, 88)), *(prose(i, 80) + " a b c" * 40 for i in range(90, 95))]
    docs = table(spark, texts)
    voted = {r["doc_id"]: tuple(r["v"]) for r in quality.measure(docs).select("doc_id", quality.votes().alias("v")).collect()}
    spec = quality.QualitySpec()
    want = plain_posteriors([voted[i] for i in range(len(texts))], spec)
    rows = quality.digest(quality.judge(docs)).collect()
    for r in rows:
        assert abs(r["posterior"] - want[r["doc_id"]]) < 1e-9
        assert r["kept"] == (not r["base_failed"] and want[r["doc_id"]] >= spec.least_posterior)
    assert 10 < sum(r["kept"] for r in rows) < len(rows)


def test_repeats_are_exact_even_when_hashes_meet(spark):
    texts = [*AWKWARD, "a b c a b c a b", "x y z\nx y z\nx y z", "a a a a", *(prose(i, 40 + 9 * i) for i in range(20)), *(" ".join("abcd"[(j * j + i) % 7 % 4] for j in range(200)) for i in range(9))]
    for room in (1 << 62, 3000, 1):  # the last: all windows of a text have one hash
        for r in quality.measure(table(spark, texts), room=room).select("doc_id", "quality.n_repeat_words").collect():
            assert r["n_repeat_words"] == expected(texts[r["doc_id"]] or "")[4]


def test_judged_columns_keep_their_values(spark):
    clash = {"_w": "w", "_row": "r", "_votes": "v", "_t": "t", "base_failed": "b", "posterior": "p", "_q": "q"}
    docs = table(spark, [prose(1, 80), None]).withColumns({k: F.lit(v) for k, v in clash.items()}).withColumn("QUALITY", F.lit("mine"))
    rows = quality.judge(docs).collect()
    assert all(r[k] == v for r in rows for k, v in clash.items()) and all(r["kept"] is None for r in rows)
    assert "QUALITY" not in rows[0].asDict() and {r["quality"]["kept"] for r in rows} == {True, False}
    assert {r["QUALITY"] for r in quality.judge(docs, out="verdict").collect()} == {"mine"}


def test_vocabulary_is_counted_over_whole_texts(spark):
    clean, tail = [f"w{i}" for i in range(400)], [f"t{i * i % 7}" for i in range(2000)]
    texts = [" ".join(w) for w in (clean, clean + tail, tail + clean, *((clean + tail)[:n] for n in (1, 399, 401, 799, 800, 801, 1000)))]
    at = [n for n, *_ in quality.RULES].index("vocabulary")
    rows = {r["doc_id"]: r for r in quality.measure(table(spark, texts)).select("doc_id", "quality.n_distinct_words", quality.votes()[at].alias("vote")).collect()}
    for i, t in enumerate(texts):
        w = t.split()
        starts = [min(k, max(len(w) - 400, 0)) for k in range(0, len(w), 400)]
        assert abs(rows[i]["n_distinct_words"] - sum(len(set(w[k : k + 400])) for k in starts) / len(starts)) < 1e-9
    assert [rows[i]["vote"] for i in range(3)] == [1, 0, 0]


def test_pieces_equal_the_tokenizers_library(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer_path())
    tok.encode_special_tokens = True
    texts = [*AWKWARD, "don't  stop   \n\n now 　 x", "１２３ ½ Ⅳ", "é \U0001f600‍"]
    rows = packing.token_pieces(table(spark, texts)).collect()
    for i, t in enumerate(texts):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        mine = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == i)
        at = 0
        for piece, start, length, crc in mine:
            assert start == at and crc == zlib.crc32(ids[at : at + length].tobytes())
            assert length == 1024 or piece == 0
            at += length
        assert at == len(ids)


def test_packing_is_gapless_and_tight(spark):
    docs = table(spark, AWKWARD + [prose(i, 5 + i * 7 % 400) for i in range(300)])
    for spec in (packing.PackSpec(), packing.PackSpec(rule="dot"), packing.PackSpec(documents=3, attention=600_000, tokens=1024, rank_bucket_rows=20)):
        pieces = packing.token_pieces(docs) if spec.attention > 1024 * 1023 else packing.token_pieces(docs, size=700)
        rows = packing.pack(pieces, spec).collect()
        bins = {}
        for r in rows:
            bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for items in bins.values():
            at = 0
            for offset, length in sorted(items):
                assert offset == at
                at += length
            assert at <= spec.tokens and len(items) <= spec.documents and sum(n * n for _, n in items) <= spec.attention
        if spec.documents > 3:
            assert len(bins) <= -(-sum(r["length"] for r in rows) // 1024) + 2
    assert packing.pack(packing.token_pieces(docs.where("false"))).count() == 0


def test_short_documents_fill_one_sequence(spark):
    docs = table(spark, [None] * 1024)
    assert packing.pack(packing.token_pieces(docs)).select("sequence_id").distinct().count() == 1


def test_repeated_rows_are_ranked_in_bounded_runs(spark):
    docs = table(spark, ["same text"] * 3000, ids=[7] * 3000)
    rows = packing.pack(packing.token_pieces(docs), packing.PackSpec(rank_bucket_rows=50)).collect()
    length = rows[0]["length"]
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 3000
    assert len({r["sequence_id"] for r in rows}) == -(-3000 // (1024 // length))


def test_sequences_come_near_the_least_possible():
    """Against the bound that no packing of pieces over a half can pass, and the sum of the lengths."""
    r = np.random.default_rng(3)
    for _ in range(30):
        lengths = r.integers(1, 1025, 4000) if r.random() < 0.5 else np.minimum(1024, r.geometric(1 / 200, 4000))
        counts = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True), strict=True)}
        plan = packing.plan_bins(counts, packing.PackSpec())
        used = Counter()
        for length, _, n, first, _ in plan:
            for s in range(first, first + n):
                used[s] += length
        least = max(-(-int(lengths.sum()) // 1024), int((lengths > 512).sum()))
        assert sum(used.values()) == lengths.sum() and max(used.values()) <= 1024
        assert len(used) <= 1.02 * least + 2


def test_shards_equal_brute_force(spark):
    texts = [*AWKWARD, *(prose(i % 50, 5 + i * 13 % 90) for i in range(900))]
    ids = random.Random(5).sample(range(-10_000, 10_000), len(texts))
    for spec in (sharding.ShardSpec(), sharding.ShardSpec(shards=7, ranges_per_shard=3, rows_per_range=20, rounds=1)):
        rows = {r["doc_id"]: r for r in sharding.range_shards(sharding.sized(table(spark, texts, ids=ids).repartition(5)), spec).collect()}
        total, at, slots = sum(len((t or "").encode()) + 16 for t in texts), 0, Counter()
        for i, t in sorted(zip(ids, texts, strict=True)):
            raw = (t or "").encode()
            size = len(raw) + 16
            shard = min(int((at + size / 2) * spec.shards / total), spec.shards - 1)
            assert (rows[i]["size"], rows[i]["text_crc32"], rows[i]["shard"], rows[i]["slot"]) == (size, zlib.crc32(raw), shard, slots[shard])
            at += size
            slots[shard] += 1


def test_shards_are_even_and_slots_gapless(spark):
    texts = AWKWARD + [prose(i % 50, 20 + i % 30) for i in range(700)]
    ids = [None, None, *([7] * 200), *range(len(texts) - 202)]
    rows = sharding.range_shards(sharding.sized(table(spark, texts, ids=ids))).collect()
    assert len(rows) == len(texts)
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    assert all(sorted(x["slot"] for x in v) == list(range(len(v))) for v in by.values())
    biggest = max(r["size"] for r in rows)
    mean = sum(r["size"] for r in rows) / 40
    assert all(abs(sum(x["size"] for x in v) - mean) <= 2 * biggest for v in by.values())
    assert sharding.range_shards(sharding.sized(table(spark, ["x"]).where("false"))).count() == 0
