import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np

from scenelake.llm import ngram
from tests.llm.docs import AWKWARD, prose, table


def tokens(t):
    return [*(t or "").encode().lower().split(), b"</end>"]


def fold(i):
    return zlib.crc32(str(i).encode()) % 10


def test_counts_and_scores_equal_brute_force(spark):
    texts = [*AWKWARD, *(prose(i % 37, 20 + i % 50) for i in range(300))]
    spec = ngram.LmSpec(unit_tokens=700)
    rows = {r["doc_id"]: r for r in ngram.score(table(spark, texts), spec).collect()}
    assert len(rows) == len(texts)
    learn = [i for i in range(len(texts)) if fold(i)]
    c = Counter(w for i in learn for w in tokens(texts[i]))
    n, v = sum(c.values()), len(c)

    def model(docs):
        one, two = Counter(), Counter()
        for i in docs:
            t = tokens(texts[i])
            one.update(t)
            two.update(zip([b"</end>", *t], t, strict=False))
        return one, two

    one, two = model([i for i in learn if fold(i) != 1])
    total, types = sum(one.values()), len(one)
    cells = Counter()
    levels = 40 * spec.grain + 2
    level = lambda p: 1 + min(math.floor(-spec.grain * math.log2(p)), levels - 2) if p > 0 else 0
    bucket = lambda x: min(1 + int(math.log2(x)), spec.top_bucket) if x else 0
    for i in learn:
        if fold(i) == 1:
            t = tokens(texts[i])
            for a, b in zip([b"</end>", *t], t, strict=False):
                p2 = two[a, b] / one[a] if one[a] else 0.0
                cells[(bucket(one[a]) * levels + level(p2)) * levels + level(one[b] / total)] += 1
    weights = ngram.mixture(list(cells.items()), types, spec)
    one, two = model(learn)
    for i, t in enumerate(texts):
        toks = tokens(t)
        r = rows[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (fold(i) == 0, len(toks), sum(c[w] > 0 for w in toks), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in toks), rel_tol=1e-9)
        want = 0.0
        for a, b in zip([b"</end>", *toks], toks, strict=False):
            w = weights[bucket(one[a])]
            want += math.log10(w[0] * (two[a, b] / one[a] if one[a] else 0.0) + w[1] * one[b] / n + w[2] / (v + 1))
        assert math.isclose(r["score"], want, rel_tol=1e-6) and math.isclose(r["mean_score"] * len(toks), r["score"], rel_tol=1e-9)
    held = [i for i in rows if rows[i]["held_out"] and len(tokens(texts[i])) > 5]
    assert sum(rows[i]["score"] for i in held) > sum(rows[i]["base_score"] for i in held)


def test_weights_are_a_mixture_and_probabilities_sum_to_one():
    w = ngram.mixture([(3 * 322 * 322 + 9 * 322 + 50, 100), (70, 5)], 10)
    assert np.allclose(w.sum(axis=1), 1) and (w > 0).all()


def test_empty_and_only_held_out(spark):
    docs = table(spark, ["a b", None])
    assert ngram.score(docs.where("false")).count() == 0
    held = next(i for i in range(100) if fold(i) == 0)
    r = ngram.score(table(spark, ["a b"], ids=[held])).first()
    assert (r["held_out"], r["n_known"], r["train_tokens"]) == (True, 0, 0) and r["base_score"] == 0.0


def test_squeezed_arrays_come_back():
    r = random.Random(1)
    k = np.unique(np.array([r.randrange(1 << 64) for _ in range(999)], np.uint64))
    assert (ngram._expand_keys(ngram._squeeze_keys(k)) == k).all()


def test_a_unit_is_scored_in_stretches_of_whole_documents():
    rng = np.random.default_rng(5)
    lengths = [1, 2, 400_000, 1, *[300] * 2000, 7]
    keys = np.unique(np.append(rng.integers(1, 1 << 62, 50_000, dtype=np.uint64), ngram.END))
    place = rng.integers(0, len(keys), sum(lengths)).astype("<i4")
    place[np.cumsum(lengths) - 1] = np.searchsorted(keys, ngram.END)
    at = ngram._stretches(lengths)
    assert [d for docs, _ in at for d in range(len(lengths))[docs]] == list(range(len(lengths)))
    assert all(sum(lengths[docs]) == t.stop - t.start for docs, t in at)
    assert all(t.stop - t.start < (1 << 17) + 300 for docs, t in at if 2 not in range(len(lengths))[docs])
    _, two = np.unique(ngram._bigrams(keys, place), return_inverse=True)
    counts = {1: np.arange(len(keys), dtype="<u8"), 2: np.arange(two.max() + 1, dtype="<u8") % 7}
    unit = {"keys": ngram._squeeze_keys(keys), "stream": ngram._squeeze(place), "lengths": lengths}
    tracemalloc.start()
    got = [[own.sum(), before.sum(), both.sum()] for _, own, before, both in ngram._parts_of(unit, counts)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 * len(place)  # bytes a token
    own = counts[1][place].astype(float)
    before = np.append(counts[1][np.searchsorted(keys, ngram.END)], own[:-1])
    assert np.allclose(np.sum(got, axis=0), [own.sum(), before.sum(), counts[2][two].sum()], rtol=1e-12)
