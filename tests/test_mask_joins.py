"""Joins of mask pixels: no exploded table goes through the driver, and hits counted by pixel equal the hits."""

import os
from collections import Counter

import pytest

import __spark_entry__ as entry
from scenelake.operators import masks, visibility

SF = "/root/testdata/sf0.001"


def broadcasts(df):
    """The subtrees of the physical plan that are broadcast."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [next((k for k, c in enumerate(x) if c.isalpha()), 0) for x in lines]
    for at, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((k for k in range(at + 1, len(lines)) if depth[k] <= depth[at]), len(lines))
            yield "\n".join(lines[at:end])


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", [
    "a19_cluster_families",
    "p29_decisions",
    "a19_best_frames",
    "a19_cluster_hits",
    "r4_ranked_clusters",
    "f7_valid_votes",
    "j19_background_support",
    "j3_frame_votes",
    "k8_mask_sink",
    "j18_vote_instances",
    "j2_mask_hits",
    "j3_votes_of_files",
    "j6_track_hits",
])
def test_pixels_are_never_broadcast(spark, name):
    exploded = ("Generate explode(sequence(", "Generate posexplode(px")  # boxes; images
    assert not [b for b in broadcasts(entry.queries()[name](spark, SF)) if any(e in b for e in exploded)]


@pytest.fixture(scope="module")
def seen(spark):
    rows = [(0, g, bool(g % 7), None if g % 5 == 0 else g % 3, None if g % 5 == 0 else g % 2) for g in range(60)]
    return spark.createDataFrame(rows, "frame_index int, gaussian_index long, valid boolean, px int, py int")


@pytest.fixture(scope="module")
def pixels(spark):
    rows = [(0, 1, 0, 0), (0, 1, 1, 1), (0, 2, 1, 1), (0, 2, 2, 0), (0, 3, 9, 9), (1, 1, 0, 0)]
    return spark.createDataFrame(rows, "frame_index int, instance_id int, x int, y int")


def test_counts_by_pixel_are_counts_of_hits(spark, seen, pixels):
    group = lambda g: None if g % 4 == 3 else g % 4
    ids = spark.createDataFrame([(g, group(g)) for g in range(60)], "gaussian_index long, owner int")
    hits = visibility.mask_hits(seen, pixels).collect()
    want = Counter((group(r["gaussian_index"]), r["frame_index"], r["instance_id"]) for r in hits)
    got = visibility.mask_counts(seen.join(ids, "gaussian_index"), pixels, "owner").collect()
    assert want and {(r["owner"], r["frame_index"], r["instance_id"]): r["hits"] for r in got} == want
    assert len(got) == len(want)


def test_cluster_hits_count_points_without_a_pixel_as_visible(spark, seen, pixels):
    clusters = spark.createDataFrame([(g, g % 2 - (g > 50)) for g in range(60)], "gaussian_index long, cluster_id int")
    inst = spark.createDataFrame([(0, 1, "chair", 0.5), (0, 2, "table", 1.0)], "frame_index int, instance_id int, label string, score double")
    got = masks.cluster_hits(seen, clusters, pixels, inst, min_visible=1, min_hits=1, min_ratio=0.0).collect()
    owner = {g: g % 2 - (g > 50) for g in range(60)}
    ok = [r for r in seen.collect() if r["valid"] and owner[r["gaussian_index"]] >= 0]
    visible = Counter(owner[r["gaussian_index"]] for r in ok)
    places = {1: {(0, 0), (1, 1)}, 2: {(1, 1), (2, 0)}}
    hits = Counter((owner[r["gaussian_index"]], i) for r in ok for i, p in places.items() if (r["px"], r["py"]) in p)
    assert {(r["cluster_id"], r["instance_id"]): (r["hits"], r["visible"]) for r in got} == {
        k: (n, visible[k[0]]) for k, n in hits.items()
    }


def test_votes_of_masks_are_votes_of_hits(spark, seen, pixels):
    inst = spark.createDataFrame([(0, 1, 0.3), (0, 2, None), (1, 1, 1.0)], "frame_index int, instance_id int, score double")
    alpha = spark.createDataFrame([(g, g / 60) for g in range(50)], "gaussian_index long, alpha double")
    good = spark.createDataFrame([(g, 1 / (g + 1), g != 8) for g in range(55)], "gaussian_index long, quality double, valid boolean")
    for kw in ({}, {"opacity": alpha}, {"opacity": alpha, "quality": good}):
        want = visibility.frame_votes(visibility.mask_hits(seen, pixels), inst, **kw)
        got = visibility.mask_votes(seen, pixels, inst, **kw)
        assert got.columns == want.columns and got.count() and sorted(got.collect()) == sorted(want.collect())


def test_background_by_covered_pixels(spark, seen, pixels):
    both = (visibility.background_support(seen, h(seen, pixels)) for h in (visibility.covered, visibility.mask_hits))
    got, want = (sorted(map(tuple, b.collect())) for b in both)
    assert got and got == want


def test_votes_of_instances_by_counts(spark, seen, pixels):
    ids = spark.createDataFrame([(g, g % 4 - 1) for g in range(0, 60, 2)], "gaussian_index long, object_id long")
    want = masks.vote_instances(visibility.mask_hits(seen, pixels), ids, min_count=2)
    counts = visibility.mask_counts(seen.join(ids, "gaussian_index", "left"), pixels, "object_id")
    got = masks.vote_counts(counts, min_count=2)
    hits = Counter((r["frame_index"], r["instance_id"]) for r in visibility.mask_hits(seen, pixels).collect())
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert {(r["frame_index"], r["instance_id"]): round(r["count"] / r["ratio"]) for r in got.collect()} == hits


def test_track_hits_of_points_seen_twice(spark, pixels):
    rows = [(0, 5, 0.0, 0.0), (0, 5, 1.0, 1.0), (0, 5, 2.9, 2.2), (0, 6, 2.0, 2.0), (0, 6, 2.0, 2.0), (0, -1, 2.0, 2.0), (1, 5, 0.0, 1.0)]
    tracks = spark.createDataFrame(rows, "frame_index int, point3d_id long, x double, y double")
    got = masks.track_hits(tracks, pixels.union(pixels), (4, 4), (2, 2)).collect()  # a pixel listed twice counts once
    assert sorted(map(tuple, got)) == [(0, 1, 5), (0, 1, 6), (0, 2, 5), (0, 2, 6), (1, 1, 5)]


def test_points_at_the_same_places_meet_the_masks_once(spark, pixels):
    rows = [(0, g, 0.0, float(g % 2)) for g in range(20, 30)] + [(1, g, 1.0, 0.0) for g in range(20, 26)]
    rows += [(0, g, x, x) for g in (7, 8) for x in (0.0, 1.0, 2.0)] + [(0, 9, 2.0, 2.0), (0, -1, 2.0, 2.0)]
    tracks = spark.createDataFrame(rows, "frame_index int, point3d_id long, x double, y double")
    twice = pixels.union(pixels)
    single = masks.track_hits(tracks, twice, (4, 4), (2, 2))
    sets = masks.place_hits(masks.track_places(tracks, (4, 4), (2, 2)), twice)
    support = Counter((r["frame_index"], r["instance_id"]) for r in single.collect())
    got = sets.collect()
    for k, n in support.items():
        assert sum(r["points"] for r in got if (r["frame_index"], r["instance_id"]) == k) == n
    assert {r["point3d_id"] for r in got} == {7, 9, 20, 26} and len(got) < sum(support.values())
    kept = pixels.select("frame_index", "instance_id").distinct().selectExpr("*", "0 as category")
    for least in (1, 3, 7):
        found = [
            sorted(map(tuple, masks.track_masks(kept, h, min_points=least, min_shared=2, min_ratio=0.1, min_masks=2).collect()))
            for h in (single, sets)
        ]
        assert found[0] and found[0] == found[1]
