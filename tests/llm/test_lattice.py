import zlib
from collections import Counter

import numpy as np

from scenelake.llm import lattice
from tests.llm.docs import AWKWARD, prose, table

MODEL = lattice.pieces(lattice.default_model_path())


def all_paths(text):
    """Every segmentation of a short text, with its log-probability."""
    paths = raw_paths(text)
    z = np.logaddexp.reduce(list(paths.values()))
    return {k: v - z for k, v in paths.items()}


def raw_paths(text):
    """Every segmentation of a short text, with its log-weight."""
    t = lattice.SPACE + text.replace(" ", lattice.SPACE)
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=lattice.default_model_path())
    weight = {sp.id_to_piece(i): (i, -np.log(min(-sp.get_score(i), 32000) + 8)) for i in range(259, 32000)}

    def walk(at):
        if at == len(t):
            yield (), 0.0
        for end in range(at + 1, len(t) + 1):
            if t[at:end] in weight:
                i, w = weight[t[at:end]]
                for rest, v in walk(end):
                    yield (i, *rest), w + v

    return dict(walk(0))


def test_samples_follow_sequential_sampling_without_replacement():
    n, text = 3000, "of the"
    want = all_paths(text)
    drawn = lattice.sample_batch(np.arange(n, dtype=np.uint64) * np.uint64(977) + np.uint64(5), [text] * n, MODEL, lattice.SampleSpec(samples=3))
    first, second, mass = Counter(), Counter(), 0.0
    for rows in drawn:
        keys = [tuple(r[0].tolist()) for r in rows]
        assert len(set(keys)) == len(keys) == 3
        assert all(abs(r[1] - want[k]) < 1e-9 for k, r in zip(keys, rows, strict=True))
        assert rows[0][2] >= rows[1][2] >= rows[2][2]
        first[keys[0]] += 1
        second[keys[1]] += 1
        mass += sum(np.exp(r[1] - r[3]) for r in rows)
    for k, v in want.items():
        p1 = np.exp(v)
        p2 = sum(np.exp(u) * p1 / (1 - np.exp(u)) for j, u in want.items() if j != k)
        assert abs(first[k] / n - p1) < 0.03 and abs(second[k] / n - p2) < 0.03
    assert abs(mass / n - 1) < 0.02  # inclusion scores make the estimate of the total unbiased


def test_sharp_weights_lose_no_sample():
    """With piece weights to the power 20 the second segmentation is far less likely than a double tells beside the first."""
    for alpha, text in ((20.0, "of the"), (5.0, "of the"), (60.0, "at"), (20.0, "to be or not")):
        sharp = {k: v * alpha for k, v in raw_paths(text).items()}
        z = np.logaddexp.reduce(list(sharp.values()))
        best = sorted(sharp, key=sharp.get, reverse=True)
        for seed in range(20):
            rows = lattice.sample_batch(np.array([seed], np.uint64), [text], MODEL, lattice.SampleSpec(samples=4, alpha=alpha))[0]
            keys = [tuple(r[0].tolist()) for r in rows]
            assert len(set(keys)) == len(keys) == 4
            assert all(abs(r[1] - (sharp[k] - z)) < 1e-6 * max(1.0, abs(r[1])) for k, r in zip(keys, rows, strict=True))
            if alpha >= 20:  # gaps between the best are far wider than Gumbel noise
                assert keys[0] == best[0]
            assert all(r[3] <= 0 for r in rows) and rows[0][2] >= rows[1][2] >= rows[2][2] >= rows[3][2]


def test_few_segmentations_are_all_given():
    rows = lattice.sample_batch(np.array([1], np.uint64), ["a"], MODEL, lattice.SampleSpec(samples=9))[0]
    assert len(rows) == len(all_paths("a")) and all(r[3] == 0.0 for r in rows)
    assert abs(sum(np.exp(r[1]) for r in rows) - 1) < 1e-9


def test_round_trip_distinct_and_seeded_by_key(spark):
    texts = [*AWKWARD, "▁ literal ▁▁ and   spaces \u0000 ", *(prose(i, 60) for i in range(20))]
    docs = table(spark, texts)
    spec = lattice.SampleSpec(samples=3, batch_chars=2000)
    enc = lattice.sample_segmentations(docs, spec)
    rows = lattice.decode(enc).collect()
    by = {}
    for r in rows:
        assert r["text"] == (texts[r["doc_id"]] or "")
        by.setdefault(r["doc_id"], []).append(tuple(r["ids"]))
    assert set(by) == set(range(len(texts))) and all(len(set(v)) == len(v) for v in by.values())
    again = {(r["doc_id"], r["sample"]): tuple(r["ids"]) for r in lattice.sample_segmentations(docs.repartition(3), spec.__class__(samples=3)).collect()}
    assert all(again[r["doc_id"], r["sample"]] == tuple(r["ids"]) for r in rows)
    digest = lattice.sample_segmentations(docs, spec, digest=True).collect()
    assert all(r["round_trip"] for r in digest) and len(digest) == len(rows)
    assert lattice.sample_segmentations(docs.where("false")).count() == 0


def test_single_and_array_draws_agree():
    seeds = np.array([3, 1 << 63, (1 << 64) - 1], np.uint64)
    at = np.array([0, 7, 100_000])
    assert lattice._uniform(seeds, 2001, at).tolist() == [lattice._uniform_one(int(s), 2001, int(a)) for s, a in zip(seeds, at, strict=True)]


def test_branches_look_only_at_places_with_mass(monkeypatch):
    """Other edges are summed at the places whose prefix has mass, not at a round number of places of every path."""
    asked, of_edges = [], lattice.Lattice.log_rest
    monkeypatch.setattr(lattice.Lattice, "log_rest", lambda lat, edges: (asked.append(len(edges)), of_edges(lat, edges))[1])
    texts, spec = [prose(i, 400) for i in range(30)], lattice.SampleSpec(samples=1)
    drawn = lattice.sample_batch(np.arange(30, dtype=np.uint64), texts, MODEL, spec)
    places = sum(len(r[0]) for rows in drawn for r in rows)
    assert 0 < sum(asked) < 0.5 * places


def test_samples_of_odd_texts_stay_as_they_were():
    """Ids drawn by the version that kept edges in the order of the text."""
    texts = ["of the", "▁ literal ▁▁ and   spaces \u0000 ", "x" * 3000 + " to be", "漢字 😀é\n\n the", " \n ", "", prose(3, 300)]
    seeds = np.arange(len(texts), dtype=np.uint64) * np.uint64(977) + np.uint64(5)
    want = {
        1.0: [
            [2121439505, 3641061668, 1133787067], [3835254867, 2828163830, 2641362973], [1472909109, 1309638852, 1436383386],
            [1241598709, 712159906, 2272969374], [448757381, 4185656235], [0], [1399933515, 3402736753, 483428244]
        ],
        20.0: [
            [2121439505, 3641061668, 1133787067], [3835254867, 2684927297, 2828163830], [3197310473, 2963714536, 3259154709],
            [1241598709, 712159906, 2272969374], [448757381, 4185656235], [0], [2374319361, 3652299684, 3023329741]
        ]
    }
    for alpha, sums in want.items():
        rows = lattice.sample_batch(seeds, texts, MODEL, lattice.SampleSpec(samples=3, alpha=alpha))
        assert [[zlib.crc32(r[0].astype("<u4").tobytes()) for r in own] for own in rows] == sums
