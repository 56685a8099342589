import hashlib
import math
import random
import time
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from scenelake.llm import fingerprint, langid, neardup
from scenelake.llm.common import fold_of
from scenelake.operators.graph import connected_components
from tests.llm.docs import AWKWARD, prose, table


def shingle_set(x):
    w = (x or "").encode().lower().split()
    k = min(5, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def edits(text, share, seed):
    r = random.Random(seed)
    return " ".join(f"edit{r.randint(0, 10**9)}" if r.random() < share else w for w in text.split(" "))


def near_corpus():
    base = [prose(i, 120) for i in range(12)]
    passage = prose(77, 60)
    texts = [*AWKWARD, *base, *(f"{passage} {prose(300 + i, 40)}" for i in range(30))]
    for i in range(60):
        texts.append(edits(base[0], 0.03 * (i % 4), i))
    for i in range(1, 8):
        texts += [base[i].upper(), edits(base[i], 0.02, i)]
    return texts


def brute_components(ids, texts):
    sets = [shingle_set(t) for t in texts]
    parent = list(range(len(ids)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if a and sets[j] and 100 * n >= 75 * (len(a) + len(sets[j]) - n):
                x, y = sorted((find(i), find(j)), key=lambda k: ids[k])
                parent[y] = x
    return {d: (len(s), ids[find(i)]) for i, (d, s) in enumerate(zip(ids, sets, strict=True))}


def test_near_duplicates_equal_brute_force(spark):
    texts = near_corpus()
    ids = random.Random(3).sample(range(1000), len(texts))
    want = brute_components(ids, texts)
    # whole groups; blocks with many anchors; blocks with hardly any, whose strays are held against all
    for spec in (neardup.NearDupSpec(), neardup.NearDupSpec(block=10), neardup.NearDupSpec(block=7, block_shingles=300, anchors=1)):
        rows = neardup.near_duplicates(table(spark, texts, ids=ids), spec).collect()
        assert len(rows) == len(texts)
        for r in rows:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_dealt_groups_lose_no_link(spark):
    """Members of a group in a chain: neighbours link, others don't, so only complete comparison connects it."""
    sets = [np.unique(np.arange(i, i + 14, dtype=np.uint64)).tobytes() for i in range(0, 300, 2)]
    rows = [(1 if i < 100 else 2, i, sets[i]) for i in range(len(sets))]
    members = spark.createDataFrame([(g, i, 150, 9) for g, i, _ in rows], "g long, node long, n long, blocks int")
    payload = spark.createDataFrame([(i, bytearray(b)) for _, i, b in rows], "node long, data binary")
    for anchors in (0, 1, 20):
        edges = neardup.group_forest(members, payload, neardup.ShingleSets, neardup.NearDupSpec(block=16, anchors=anchors))
        got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
        assert got == {i: 0 if i < 100 else 100 for i in range(150)}


def test_many_near_copies_and_a_stray_take_seconds():
    rng = np.random.default_rng(2)
    core = rng.integers(0, 1 << 62, 300, dtype=np.uint64)
    sets = [np.unique(np.append(core, rng.integers(0, 1 << 62, 6, dtype=np.uint64))) for _ in range(8192)]
    sets.append(np.unique(np.append(core[:100], rng.integers(0, 1 << 62, 200, dtype=np.uint64))))
    link = neardup.ShingleSets([s.tobytes() for s in sets], neardup.NearDupSpec())
    began = time.time()
    src, dst = neardup.spanning(len(sets), link.linked, link.shrink)
    assert time.time() - began < 20
    assert len(dst) == 8191
    assert 8192 not in set(src) | set(dst)


def test_survivors_are_one_row_of_each_class(spark):
    texts = [prose(1, 50), prose(1, 50), prose(2, 50), prose(2, 50), prose(3, 50), prose(3, 50).upper(), None, None, "", prose(4, 50)]
    ids = [None, None, 6, 6, 3, 3, None, None, 8, None]
    docs = table(spark, texts, ids=ids).withColumns({"_id": F.lit("a"), "_TEXT_HASH": F.lit(1), "kept": F.lit(None).cast("boolean"), "component_id": F.lit(2)})
    out = neardup.survivors(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert all((r["_id"], r["_TEXT_HASH"], r["kept"], r["component_id"]) == ("a", 1, None, 2) for r in rows)
    got = sorted((r["doc_id"] or 0, (r["text"] or "").lower()) for r in rows)
    assert got == sorted([(0, prose(1, 50).lower()), (6, prose(2, 50).lower()), (3, prose(3, 50).lower()), (0, ""), (8, ""), (0, prose(4, 50).lower())])
    assert neardup.survivors(docs.where("false")).count() == 0


def test_near_duplicates_with_null_and_repeated_ids(spark):
    texts = [prose(1, 50), prose(1, 50), prose(2, 50), prose(2, 50), None]
    rows = neardup.near_duplicates(table(spark, texts, ids=[None, 5, 6, 6, None])).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["component_id"]) for r in rows if r["n_shingles"]) == [(False, 5, 5), (False, 6, 6), (False, 6, 6), (True, 0, 5)]
    assert neardup.near_duplicates(table(spark, ["x"]).where("false")).count() == 0


def test_components_of_a_long_path_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(50, 50), (61, 60), (60, 61), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 50: 50, 60: 60, 61: 60}


def plain_fingerprint(text):
    """One-permutation MinHash bin by bin, from sets of word tuples: 128 bins, empty ones filled from random bins in turn."""
    words = [xxhash.xxh3_64_intdigest(w) for w in (text or "").encode().lower().split()]
    if not words:
        return None
    mask = (1 << 64) - 1
    a, b = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F

    def mix(h):
        h = ((h ^ h >> 32) * b) & mask
        h = ((h ^ h >> 29) * a) & mask
        return h ^ h >> 32

    k = min(5, len(words))
    bins = {}
    for i in range(len(words) - k + 1):
        h = mix((words[i] + k) & mask)
        for w in words[i + 1 : i + k]:
            h = mix((h * a + w) & mask)
        bins[h >> 57] = min(bins.get(h >> 57, mask), h)
    ask = np.random.default_rng(7).integers(0, 128, (64 * 128, 128))
    return [(bins[j] if j in bins else next(bins[int(d)] for d in ask[:, j] if int(d) in bins)) & 255 for j in range(128)]


def plain_likeness(x, y):
    if x is None or y is None:
        return float(x is y)
    share = sum(p == q for p, q in zip(x, y, strict=True)) / 128
    return min(1.0, max(0.0, (share - 1 / 256) / (1 - 1 / 256)))


def test_edited_pairs_equal_brute_force(spark):
    texts = [*AWKWARD, *(prose(i, 30 + i) for i in range(60))]
    ids = random.Random(4).sample(range(10000), len(texts))
    rows = {r["doc_id"]: r for r in fingerprint.edited_pairs(table(spark, texts, ids=ids)).collect()}
    assert len(rows) == len(texts)
    order = sorted(zip(ids, texts, strict=True), key=lambda x: -x[0])
    for i, (d, t) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        k = len(t) // 3
        edited = t[: len(t) - k] + after[:k]
        assert rows[d]["n_chars"] == len(t) and rows[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        own, other, near = plain_fingerprint(t), plain_fingerprint(edited), plain_fingerprint(after)
        assert rows[d]["fingerprint"] == bytes(own or b"").hex() and rows[d]["edited_fingerprint"] == bytes(other or b"").hex()
        assert abs(rows[d]["near_edited"] - plain_likeness(own, other)) < 1e-12 and abs(rows[d]["near_next"] - plain_likeness(own, near)) < 1e-12
    one = fingerprint.edited_pairs(table(spark, ["a b c d e f g"], ids=[3])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert fingerprint.edited_pairs(table(spark, ["x"]).where("false")).count() == 0


def test_a_common_id_is_divided_and_every_row_meets_its_next(spark):
    texts = [f"{i} " + prose(i % 40, 12) for i in range(400)] + ["same"] * 200
    ids = [*range(60), *[7] * 440, *[None] * 20, *range(1000, 1080)]
    rows = fingerprint.neighbours(table(spark, texts, ids=ids)).collect()
    assert sum(not r["_ahead"] for r in rows) == 600
    sizes = Counter(r["_bucket"] for r in rows if not r["_ahead"])
    assert len(sizes) == 5 and max(sizes.values()) <= 200  # in 4 partitions; one id has 441 rows
    out = fingerprint.edited_pairs(table(spark, texts, ids=ids)).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(ids)
    # each range goes from its first row through its last to the first of the range after it, and the last back to the first
    chains = {}
    for r in rows:
        chains.setdefault(r["_bucket"], []).append(r)
    order = sorted(chains, reverse=True)
    for here, after in zip(order, [*order[1:], order[0]], strict=True):
        own = [r for r in chains[here] if not r["_ahead"]]
        assert [r["_id"] for r in own] == sorted((r["_id"] for r in own), reverse=True)
        follower = next(r for r in chains[here] if r["_ahead"])
        head = next(r for r in chains[after] if not r["_ahead"])
        assert (follower["_id"], follower["text"]) == (head["_id"], head["text"])


def test_likeness_estimates_similarity():
    r = np.random.default_rng(1)
    errors = []
    for j in (0.2, 0.5, 0.9):
        for _ in range(40):
            n = 600
            common = int(2 * n * j / (1 + j))
            x = r.integers(0, 1 << 63, 2 * n, dtype=np.uint64) * np.uint64(2)
            a, b = np.unique(x[:n]), np.unique(np.append(x[:common], x[n : 2 * n - common]))
            errors.append(fingerprint.likeness(fingerprint.packed(a, fingerprint.FingerprintSpec()), fingerprint.packed(b, fingerprint.FingerprintSpec())) - j)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.07
    tiny = np.array([5], np.uint64)
    assert fingerprint.likeness(fingerprint.packed(tiny, fingerprint.FingerprintSpec()), fingerprint.packed(tiny, fingerprint.FingerprintSpec())) == 1.0


def plain_grams(text, spec):
    """Hashed n-grams of one text, character by character, as a count of feature numbers."""
    c = " " + text.lower() + " " * spec.order
    c = "".join(x if x.isalpha() else " " for x in c)
    out, mask = Counter(), (1 << 32) - 1
    for n in range(1, spec.order + 1):
        for i in range(len(c) - n + 1):
            h = 0
            for k in range(1, n + 1):
                h = ((h ^ ord(c[i + k - 1])) * 0x9E3779B1 + k) & mask
                h ^= h >> 15
            out[(h * 0x85EBCA77 & mask) >> (32 - spec.bits)] += 1
    return out


def plain_ftrl(rows, texts, spec):
    """FTRL-proximal with dictionaries: ``rows`` (label, part, text) in order, IDF over ``texts``. Returns a scorer of texts."""
    df = Counter(f for t in texts for f in plain_grams(t, spec))
    idf = lambda f: math.log((1 + len(texts)) / (1 + df[f])) + 1
    labels = sorted({r[0] for r in rows})
    z, n = {}, {}

    def vector(t, cast=True):
        g = plain_grams(t, spec)
        total = sum(g.values())
        return [(f, float(np.float32(c / total) if cast else c / total) * idf(f) * spec.scale) for f, c in sorted(g.items())] + [(-1, 1.0)]

    def weight(f, j):
        zf = z.get((f, j), 0.0)
        if abs(zf) <= spec.l1:
            return 0.0
        return -(zf - math.copysign(spec.l1, zf)) / ((spec.beta + math.sqrt(n.get((f, j), 0.0))) / spec.alpha + spec.l2)

    def logits(x):
        return [sum(v * weight(f, j) for f, v in x) for j in range(len(labels))]

    def softmax(a):
        e = [math.exp(v - max(a)) for v in a]
        return [v / sum(e) for v in e]

    learnt = [i for i, r in enumerate(rows) if r[1]] or list(range(len(rows)))
    rng = np.random.default_rng(spec.seed)
    for _ in range(spec.epochs):
        for i in rng.permutation(learnt):
            x = vector(rows[i][2])
            p = softmax(logits(x))
            for j, lab in enumerate(labels):
                grad = p[j] - (lab == rows[i][0])
                for f, v in x:
                    g, w, old = v * grad, weight(f, j), n.get((f, j), 0.0)
                    z[f, j] = z.get((f, j), 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / spec.alpha * w
                    n[f, j] = old + g * g
    return labels, lambda t: logits(vector(t, cast=False))


LANGS = {"aa": ["kato", "loma", "sivu", "talo", "joki"], "bb": ["straat", "gracht", "schip", "water", "brood"], "cc": ["плот", "река", "дом", "лес", "вода"]}


def small_languages():
    r = random.Random(6)
    texts, langs = [], []
    for i in range(60):
        lang = list(LANGS)[i % 3]
        texts.append(" ".join(r.choice(LANGS[lang] + ["la", "de"]) for _ in range(r.randint(2, 7))) + r.choice(["", "!", " 7"]))
        langs.append(lang)
    return texts, langs


def test_features_and_model_equal_plain_ftrl(spark):
    texts, langs = small_languages()
    spec = langid.LangIdSpec(bits=10)
    for t in ("", "a", "Ab1 c", "плот x"):
        g = np.concatenate(langid.grams([t, "zz"], spec)[0])
        feats, starts, _ = langid.grams(["yy", t, "zz"], spec)
        mid = np.concatenate([f[starts[1] : starts[2]] for f in feats])
        assert Counter(mid[mid < 1 << spec.bits].tolist()) == plain_grams(t, spec)
        assert len(g) == 3 * (len(t) + 4 + 2 + 4)
    docs = table(spark, texts, langs)
    model = langid.fit(docs, spec)
    sample = langid.counted(langid.sample_rows(langid.labelled_rows(docs, F.lit(True), "doc_id", "text", "lang"), {k: 20 for k in LANGS}, spec), spec).toPandas().sort_values(["label", "key"])
    key_of = {r["key"]: r["text"] for r in langid.labelled_rows(docs, F.lit(True), "doc_id", "text", "lang").collect()}
    rows = [(a, b, key_of[c]) for a, b, c in zip(sample["label"], sample["part"], sample["key"], strict=True)]
    labels, scorer = plain_ftrl(rows, texts, spec)
    assert tuple(labels) == model.languages
    for row in langid.identify(docs, model).collect():
        logits = np.array(scorer(row["text"])) / model.temperature
        p = np.exp(logits - logits.max())
        p /= p.sum()
        assert row["lang_pred"] == labels[int(p.argmax())] and abs(row["lang_score"] - p.max()) < 1e-4


def test_language_score_depends_on_the_text_alone(spark):
    texts, langs = small_languages()
    docs = table(spark, texts, langs)
    first = langid.fit(docs)
    again = langid.fit(docs.orderBy(F.col("doc_id").desc()).repartition(3))
    assert first.temperature == again.temperature and (first.table == again.table).all()
    score = lambda df: {r["doc_id"]: (r["lang_pred"], r["lang_score"]) for r in langid.identify(df, first).collect()}
    whole = score(docs)
    other = score(docs.repartition(7).orderBy(F.col("doc_id").desc()))
    alone = {k: v for i in (0, 7, 31) for k, v in score(docs.where(F.col("doc_id") == i).coalesce(1)).items()}
    for got in (other, alone):
        assert all(got[k][0] == whole[k][0] and abs(got[k][1] - whole[k][1]) < 1e-12 for k in got)


def test_language_sample_is_bounded_under_repeated_rows(spark):
    texts, langs = small_languages()
    texts, langs = texts + [texts[0]] * 3000, langs + ["aa"] * 3000
    docs = table(spark, texts, langs, ids=[*range(60), *[None] * 3000])
    labelled = langid.labelled_rows(docs, F.lit(True), "doc_id", "text", "lang")
    spec = langid.LangIdSpec()
    assert langid.sample_rows(labelled, {"aa": 1, "bb": 1, "cc": 1}, spec).count() == 61
    clash = docs.withColumns({"LANG_PRED": F.lit("p"), "lang_score": F.lit("s"), "key": F.lit("k"), "part": F.lit("q")})
    rows = langid.identify(clash.limit(9), langid.fit(clash), pred="own", score_col="sure").collect()
    assert all((r["LANG_PRED"], r["lang_score"], r["key"], r["part"]) == ("p", "s", "k", "q") and r["own"] in LANGS for r in rows)
    assert "LANG_PRED" not in langid.identify(clash, langid.fit(clash)).columns


def test_language_id_on_held_out_rows(spark):
    r = random.Random(6)
    vocab = {"aa": ["kato", "loma", "sivu", "talo", "joki"], "bb": ["straat", "gracht", "schip", "water", "brood"], "cc": ["плот", "река", "дом", "лес", "вода"]}
    texts, langs = [], []
    for i in range(240):
        lang = list(vocab)[i % 3]
        texts.append(" ".join(r.choice(vocab[lang]) for _ in range(r.randint(3, 60))))
        langs.append(lang)
    texts += [None, "", "123 !!", "42 kato talo joki"]
    langs += [None, "aa", None, None]
    docs = table(spark, texts, langs)
    held = fold_of("doc_id", 4) == 2
    model = langid.fit(docs, langid.LangIdSpec(sample_per_language=60), learn=~held)
    rows = langid.identify(docs, model).collect()
    assert len(rows) == len(texts) and rows[0]["spans"] == "x"
    assert all(x["lang_pred"] == langs[x["doc_id"]] for x in rows if x["doc_id"] < 240)
    assert [(x["lang_pred"], x["lang_score"]) for x in rows if 240 <= x["doc_id"] < 243] == [("und", 0.0)] * 3
    assert all(0 <= x["lang_score"] <= 1 for x in rows) and rows[243]["lang_pred"] == "aa"
    nothing = langid.fit(docs.where("false"))
    assert {x["lang_pred"] for x in langid.identify(docs, nothing).collect()} == {"und"}


def test_finished_shuffles_do_not_stay(spark):
    held = spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses()
    docs = table(spark, [prose(i % 9, 80) for i in range(40)] + AWKWARD)
    neardup.let_go(spark)
    time.sleep(1)
    before = held.size()
    rest = neardup.survivors(docs)
    until = time.time() + 10
    while held.size() > before + 8 and time.time() < until:  # 12 where nothing is let go
        time.sleep(0.2)
    assert held.size() <= before + 8
    assert rest.count() < 40
