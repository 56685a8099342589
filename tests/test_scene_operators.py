import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenelake.functions import color as C
from scenelake.functions import geometry as G
from scenelake.functions import labels as L
from scenelake.operators import editing, evaluation, learning, masks, quality, sampling, spatial, visibility, voting

VOTES = "frame_index int, instance_id int, gaussian_index long, weight float"
IDENTITY = (1.0, 0, 0, 0, 1, 0, 0, 0, 1)


def points(spark, rows):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "gaussian_index long, x float, y float, z float")


def by_index(df, column, key="gaussian_index"):
    return [r[column] for r in df.orderBy(key).collect()]


def test_votes_merge_and_link(spark):
    v = spark.createDataFrame([(0, 0, 2, 0.5), (0, 0, 2, 0.25), (0, 0, 3, 1.0), (1, 1, 3, 1.5)], VOTES)
    assert [(r["gaussian_index"], r["weight"]) for r in voting.aggregate_votes(v).where("frame_index = 0").orderBy("gaussian_index").collect()] == [(2, 0.75), (3, 1.0)]
    v = spark.createDataFrame([(f, 0, g, 1.0) for f, g in zip((0, 0, 0, 1, 1, 1), (1, 2, 3, 2, 3, 4), strict=True)], VOTES)
    inst = voting.local_instances(v)
    edges = voting.instance_overlap(v, inst, min_shared=2, min_ratio=0.5)
    assert edges.count() == 1 and by_index(voting.global_objects(inst, edges), "object_id", "local_index") == [0, 0]
    families = inst.withColumn("label_family", F.when(F.col("local_index") == 0, "seat").otherwise("media"))
    assert voting.instance_overlap(v, families, min_shared=2, min_ratio=0.5, same_family=True).count() == 0
    assert by_index(voting.global_objects(inst, edges.where("false"), F.col("local_index") == 0), "object_id", "local_index") == [0, -1]


def test_grouping(spark):
    v = spark.createDataFrame([(f, i, g, 1.0) for f, i, g in zip((0, 0, 1, 1, 2, 2), (0, 0, 0, 0, 1, 1), (0, 1, 0, 1, 3, 4), strict=True)], VOTES)
    inst = voting.local_instances(v)
    obj = voting.global_objects(inst, voting.instance_overlap(v, inst, min_shared=2, min_ratio=0.5))
    p = points(spark, [(i, 0, 0) for i in range(5)])
    ids = voting.assign_objects(v, obj, p)
    got = by_index(ids, "object_id")
    assert got[0] == got[1] != got[3] and got[2] == -1
    summary = voting.group_summary(ids, p, v, obj).orderBy("object_id").collect()
    assert len(summary) == 2 and summary[0]["support_frames"] == [0, 1] and summary[0]["total_vote_weight"] == 4.0 and summary[0]["centroid_x"] == 0.5
    assert voting.vote_summary(v, p).first().asDict() == {"instance_count": 3, "covered_count": 4, "vote_count": 6, "coverage_ratio": 0.8}
    assert voting.vote_summary(v.where("false"), p.where("false")).first()["coverage_ratio"] == 0.0


def test_majority_takes_first_seen_of_equals(spark):
    d = spark.createDataFrame([(0, "b", 0), (0, "a", 1), (0, None, 2), (0, None, 3)], "object_id int, label string, local_index int")
    assert voting.majority(d, "object_id", "label", "local_index").first()["label"] == "b"


def test_labels(spark):
    texts = ["cabinet shelf bookshelf", "television tv", "chair stool ottoman", "chair table", "tv stand", "bedside lamp", "large chair", "coffee table", "window", None]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "gaussian_index long, label string")
    assert by_index(d.withColumn("f", L.family("label")), "f") == ["storage", "media", "seat", "seat", "media", "bed", "seat", "table", None, None]
    specs = [("chair", "chair"), ("table", "table")]
    assert by_index(d.withColumn("c", L.category_index("label", specs)), "c")[6:] == [0, 1, None, None]
    with pytest.raises(ValueError):
        L.instance_key("other")
    assert L.resolve_classes(["sofa", 1], {0: "sofa", 1: "tv"}) == [0, 1]
    with pytest.raises(ValueError):
        L.resolve_classes(["x"], {0: "sofa"})


FRAME = "frame_index int, " + ", ".join(f"{c} double" for c in visibility.POSE)
CAM = visibility.Camera(100, 100, 50, 50, 100, 100)


def test_projection_and_gates(spark):
    f = spark.createDataFrame([(0, *map(float, IDENTITY), 0.0, 0.0, 0.0)], FRAME)
    p = visibility.project_points(points(spark, [(0, 0, 2), (1, 0, 2), (0, 0, -1), (0, 0, 0)]), f, CAM, valid_only=False).orderBy("gaussian_index").collect()
    assert [(r["u"], r["v"], r["valid"]) for r in p][:2] == [(50, 50, True), (100, 50, False)] and not p[2]["valid"] and not p[3]["valid"]
    rows = [(0, i, u, v, d, True, int(u), int(v)) for i, (u, v, d) in enumerate([(1.2, 1.2, 1.0), (1.4, 1.4, 1.02), (2.2, 1.2, 2.0), (2.4, 1.4, 2.2)])]
    q = spark.createDataFrame(rows, "frame_index int, gaussian_index long, u float, v float, depth float, valid boolean, px int, py int")
    assert sorted(r["gaussian_index"] for r in visibility.front_surface(q, 0.05).collect()) == [0, 1, 2]
    rows = [(0, i, float(i), 0.5, d, True, i, 0) for i, d in enumerate([1.0, 3.0] * 3)]
    q = spark.createDataFrame(rows, q.schema)
    depth = spark.createDataFrame([(0, x, 0, 1.0) for x in range(6)], "frame_index int, px int, py int, d double")
    assert sorted(r["gaussian_index"] for r in visibility.depth_consistent(q, depth).collect()) == [0, 2, 4]
    assert visibility.project_points(points(spark, [(0, 0, 1)]), f, visibility.Camera(1, 1, 0, 0, 9, 9, "OPENCV_FISHEYE", (0.1,))).count() == 1
    with pytest.raises(ValueError):
        visibility.project_points(points(spark, [(0, 0, 1)]), f, visibility.Camera(1, 1, 0, 0, 9, 9, "THIN_PRISM"))


def test_affine_fit_matches_least_squares(spark):
    r = np.random.default_rng(2)
    x = r.uniform(1, 5, 200)
    y = 2 * x + 1 + r.normal(0, 0.01, 200)
    y[:20] += 5
    rows = [(0, float(a), float(b)) for a, b in zip(x, y, strict=True)] + [(1, 3.0, 7.0)] * 40 + [(2, 1.0, 9.0)] * 3
    fit = {q["frame_index"]: q for q in visibility.affine_fit(spark.createDataFrame(rows, "frame_index int, predicted double, target double")).collect()}
    keep = np.ones(200, bool)
    for _ in range(4):
        s, b = np.polyfit(x[keep], y[keep], 1)
        res = np.abs(s * x + b - y)
        keep = res <= np.quantile(res, 0.8)
    assert math.isclose(fit[0]["scale"], s, rel_tol=1e-9) and math.isclose(fit[0]["shift"], b, rel_tol=1e-7)
    assert math.isclose(fit[1]["scale"], 2.1) and math.isclose(fit[1]["shift"], 0.7)
    assert (fit[2]["scale"], fit[2]["shift"], fit[2]["residual"]) == (1.0, 0.0, math.inf)


def test_components(spark):
    p = points(spark, [(0, 0, 0), (0.04, 0, 0), (0.08, 0, 0), (1, 1, 1), (1.04, 1, 1)])
    assert by_index(spatial.point_components(p, 0.05), "component") == [0, 0, 0, 1, 1]
    p = points(spark, [(0, 0, 0), (0.04, 0, 0), (1, 0, 0), (1.04, 0, 0), (5, 0, 0)])
    best = p.select("gaussian_index", F.lit(0).alias("category"))
    assert by_index(spatial.category_instances(best, p, 0.05, min_points=2), "instance_id") == [0, 0, 1, 1, -1]
    ids = spark.createDataFrame([(i, c) for i, c in enumerate((4, 4, 4, 2, 2, 1))], "gaussian_index long, component int")
    assert by_index(spatial.rank_components(ids, min_points=2), "rank") == [0, 0, 0, 1, 1, -1]
    assert by_index(spatial.isolated(points(spark, [(0, 0, 0), (0.02, 0.01, 0), (3, 3, 3)]), 0.1), "isolated") == [False, False, True]
    assert spatial.point_components(p.where("false"), 0.05).count() == 0


def test_category_votes_and_background(spark):
    v = spark.createDataFrame([(0, 0, 0, 0.5), (0, 0, 1, 1.0), (1, 1, 1, 0.25), (1, 1, 2, 0.75)], VOTES)
    cats = spark.createDataFrame([(0, 0, 0), (1, 1, 1)], "frame_index int, instance_id int, category int")
    got = {(r["gaussian_index"], r["category"]): (r["weight"], r["support"]) for r in voting.category_votes(v, cats).collect()}
    assert got == {(0, 0): (0.5, 1), (1, 0): (1.0, 1), (1, 1): (0.25, 1), (2, 1): (0.75, 1)}
    votes = spark.createDataFrame([(i, 0, 9.0, s) for i, s in enumerate((4, 4, 1, 1))], "gaussian_index long, category int, weight double, support long")
    bg = spark.createDataFrame(list(enumerate((1, 1, 9, 9))), "gaussian_index long, background int")
    assert sorted(r["gaussian_index"] for r in spatial.best_category(votes, min_support=1, min_foreground=0.5, background=bg).collect()) == [0, 1]


def cloud(spark):
    rows = [(0, 0.0, 0.0, 0.0, 0.0, 0.0), (1, 0.02, 0.0, 0.0, 0.0, 0.0), (2, 0.0, 0.02, 0.0, 0.0, 0.0), (3, 5.0, 5.0, 5.0, -10.0, 2.0)]
    return spark.createDataFrame([(*r, r[5], r[5]) for r in rows], "gaussian_index long, x double, y double, z double, opacity double, scale_0 double, scale_1 double, scale_2 double")


def test_quality(spark):
    p = cloud(spark)
    assert by_index(quality.prune_mask(p, quality.PruneSpec(scale_percentile=75, radius_percentile=75, voxel_size=0.1)), "keep") == [True, True, True, False]
    q = by_index(quality.quality_scores(p, quality.QualitySpec(voxel_size=0.1)), "quality")
    assert q[3] == 0.0 and q[0] > 0.4
    r = quality.noise_report(p.where("false"), voxel_size=0.1).first()
    assert r["total"] == 0 and r["opacity_p50"] == 0.0
    assert quality.inferred_voxel(p.where("false")) == 1e-3
    t = spark.createDataFrame([(0, 1.0, 1.0), (1, float("nan"), 1.0), (2, 1.0, -9.0)], "gaussian_index long, x double, opacity double")
    assert [r[0] for r in quality.finite_and_visible(t, ["x", "opacity"]).collect()] == [0]
    assert tuple(quality.finite_counts(t, ["x", "opacity"]).first()) == (3, 1, 1, 1)
    with pytest.raises(ValueError):
        quality.filter_sidecar(t.where("gaussian_index < 2"), t.select("gaussian_index", F.lit(True).alias("keep")))


def test_boxes(spark):
    def box(o, e):
        return [[o[0] + dx * e, o[1] + dy * e, o[2] + dz * e] for dx, dy, dz in [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)]]

    flat = [[0.0, 0.0, 0.0]] * 8
    c = spark.createDataFrame([(10, box((0.0, 0, 0), 4.0)), (11, box((1.0, 1, 1), 1.0)), (12, flat)], "object_id int, corners array<array<double>>")
    frames = spatial.box_frames(c)
    assert {r["object_id"]: round(r["volume"], 6) for r in frames.collect()} == {10: 64.0, 11: 1.0}
    assert by_index(spatial.assign_boxes(points(spark, [(1.2,) * 3, (3,) * 3, (5,) * 3]), frames), "object_id") == [11, 10, -1]


def test_evaluation(spark):
    gt, pred = (10, 10, 10, 11, 11, -1), (20, 20, -1, 21, 20, 22)
    ids = spark.createDataFrame([(i, g, p) for i, (g, p) in enumerate(zip(gt, pred, strict=True))], "gaussian_index long, gt int, pred int")
    m = evaluation.greedy_match(evaluation.iou_pairs(ids, 0.1))
    r = evaluation.metrics(ids, m).first()
    assert (r["matches"], r["mean_iou"], r["unmatched_pred"]) == (2, 0.5, 1)
    gt, pred = (10, 10, 11, -1, 12, -1), (20, -1, 21, 22, 20, -1)
    ids = spark.createDataFrame([(i, g, p) for i, (g, p) in enumerate(zip(gt, pred, strict=True))], "gaussian_index long, gt int, pred int")
    m = evaluation.greedy_match(evaluation.iou_pairs(ids, 0.5))
    codes = by_index(evaluation.agreement(ids, m), "code")
    assert codes[1:4] == [2, 1, 3] and codes[5] == 0 and sorted((codes[0], codes[4])) in ([1, 4], [4, 4])
    assert sum(r["n"] for r in evaluation.agreement_counts(evaluation.agreement(ids, m)).collect()) == 6
    none = evaluation.greedy_match(evaluation.iou_pairs(ids.where("false"), 0.1))
    assert none.count() == 0 and evaluation.metrics(ids.where("false"), none).first()["group_recall"] == 0.0


def test_greedy_matching_equals_sequential(spark):
    r = np.random.default_rng(4)
    rows = [(int(g), int(p), int(n), 20, float(n) / 20) for g in range(12) for p in range(12) for n in [r.integers(1, 5)] if r.random() < 0.5]
    taken, used = [], set()
    for g, p, n, *_ in sorted(rows, key=lambda t: (-t[4], -t[2], t[3], t[0], t[1])):
        if ("g", g) not in used and ("p", p) not in used:
            used |= {("g", g), ("p", p)}
            taken.append((g, p, n))
    got = evaluation.greedy_match(spark.createDataFrame(rows, "gt int, pred int, n int, union int, iou double"))
    assert sorted(tuple(x)[:3] for x in got.collect()) == sorted(taken)


def test_masks(spark):
    seed = spark.createDataFrame([(0, 0, 2, 2)], "frame_index int, instance_id int, x int, y int")
    assert masks.dilated(seed, 1, 5, 5).count() == 9 and masks.dilated(seed, 3, 3, 3).count() == 9
    px = spark.createDataFrame([(0, 7, x, y) for x in range(3) for y in range(3)] + [(0, 9, x, y) for x in (2, 3) for y in (2, 3)], seed.schema)
    inst = spark.createDataFrame([(0, 7, 0.2, 0), (0, 9, 0.9, 1)], "frame_index int, instance_id int, score double, position int")
    lab = {(r["x"], r["y"]): r["instance_id"] for r in masks.painted(px, inst).collect()}
    assert lab[2, 2] == 9 and lab[1, 1] == 7 and (0, 3) not in lab
    assert by_index(masks.class_indices(inst), "class_index", "instance_id") == [0, 1]
    hits = spark.createDataFrame([(0, 0, g) for g in (0, 2, 3, 4, 5)], "frame_index int, instance_id int, gaussian_index long")
    ids = spark.createDataFrame(list(enumerate((0, 0, 1, 1, 1, -1))), "gaussian_index long, object_id int")
    r = masks.vote_instances(hits, ids, min_count=2).first()
    assert (r["chosen"], r["count"], r["ratio"]) == (1, 3, 0.6)
    assert masks.vote_instances(hits, ids, min_count=9).first()["chosen"] is None
    with pytest.raises(ValueError):
        masks.gather(px, [0, 3])


def test_decisions(spark):
    fam = spark.createDataFrame([(0, "seat", 6.0), (0, "table", 1.0), (1, "seat", 3.0), (1, None, 2.0)], "cluster_id int, family string, score double")
    tags = spark.createDataFrame([(0, ["panel_like"]), (1, []), (2, [])], "cluster_id int, tags array<string>")
    got = {r["cluster_id"]: (r["accepted"], r["reasons"]) for r in masks.decisions(fam, tags).collect()}
    assert got == {0: (False, ["panel_like_geometry"]), 1: (False, ["mixed_secondary_family"]), 2: (False, ["no_semantic_support"])}


def test_editing(spark):
    t = spark.createDataFrame([(0, 1.0, 0.0, 0.0, 5), (1, 3.0, 0.0, 0.0, 5), (2, 10.0, 0.0, 0.0, 9)], "gaussian_index long, x double, y double, z double, object_id int")
    t = t.withColumns({"rot_0": F.lit(1.0), "rot_1": F.lit(0.0), "rot_2": F.lit(0.0), "rot_3": F.lit(0.0)})
    got = [(round(r["x"], 6) + 0.0, round(r["y"], 6) + 0.0) for r in editing.move_object(t, 5, (0, 0, 0), G.rotation_z(90), "centroid").orderBy("gaussian_index").collect()]
    assert got == [(2.0, -1.0), (2.0, 1.0), (10.0, 0.0)]
    same = editing.move_object(t, 77, (1, 1, 1), G.rotation_z(10), "centroid")
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, t.collect()))
    with pytest.raises(ValueError):
        editing.move_object(t, 5, (math.nan, 0, 0), IDENTITY)
    with pytest.raises(ValueError):
        G.rotation_about((0, 0, 0), 5)
    rows = [(0, 0.0, 0.0, 0.0, 148, 0.9), (1, 0.1, 0.0, 0.0, 1, 0.8), (2, 1.05, 0.0, 0.0, 1, 0.2), (3, 9.0, 9.0, 9.0, 1, 0.5)]
    t = spark.createDataFrame([(*r, r[5], r[5], 1.0, 3.0) for r in rows], "gaussian_index long, x double, y double, z double, object_id int, f_dc_0 double, f_dc_1 double, f_dc_2 double, opacity double, f_rest_0 double")
    fixed = {r["gaussian_index"]: r for r in editing.repair_region(t, 148, (-1, -1, -1), (1, 1, 1), color_blend=1.0, opacity_scale=0.5).collect()}
    assert math.isclose(fixed[1]["f_dc_0"], 0.2) and math.isclose(fixed[1]["opacity"], 1 + math.log(0.5)) and fixed[1]["f_rest_0"] == 0 and fixed[0]["f_dc_0"] == 0.9 and fixed[3]["f_rest_0"] == 3.0
    with pytest.raises(ValueError):
        editing.merge_categories([("a", t), ("b", t.drop("f_rest_0"))], {})


def test_quaternions_match_rotations():
    r = np.random.default_rng(1)
    for _ in range(50):
        m = G.rotation_about(r.normal(size=3), r.uniform(0, 360))
        w, x, y, z = G.quaternion_of(m)
        back = [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y), 2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x), 2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]
        assert np.allclose(back, m)


def test_colours(spark):
    d = spark.range(-1, 40).select(F.col("id").cast("int").alias("gaussian_index"))
    import colorsys

    got = by_index(d.withColumn("c", C.golden_color("gaussian_index")), "c")
    assert got[0] == [0, 0, 0]
    for i in range(40):
        want = [int(v * 255) for v in colorsys.hsv_to_rgb(i * 0.61803398875 % 1.0, 0.75, 1.0)]
        assert all(abs(a - b) <= 1 for a, b in zip(got[i + 1], want, strict=True))
    assert len(C.class_colors(12)) == 12 and C.class_colors(3)[0] == (0.90, 0.18, 0.18)
    assert math.isclose(spark.range(1).select(C.rgb_to_sh(F.lit(1.0))).first()[0], 1.7724538, rel_tol=1e-7)
    with pytest.raises(ValueError):
        C.highlight(d, F.lit(True), (1, 0, 0), dim_scale=0)


def test_losses(spark):
    labels = spark.createDataFrame([(c,) for c in (0,) * 6 + (1,)], "class_index int")
    w = by_index(learning.class_weights(labels, spark.createDataFrame([(0,), (1,), (2,)], "class_index int")), "weight", "class_index")
    assert w[1] > w[0] and w[2] == 1.0
    rows = spark.createDataFrame([([2.0, 0.0], 0), ([0.0, 1.0], 0), ([9.0, 9.0], -1)], "logits array<double>, label int")
    r = learning.focal_cross_entropy(rows).first()
    assert r["valid"] == 2 and math.isclose(r["loss"], (math.log(1 + math.exp(-2)) + math.log(1 + math.exp(1))) / 2)
    e = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0])], "gaussian_index long, embedding array<double>")
    assert by_index(learning.classify(e, [[2.0, 0], [0, 1]], [0.0, 0.0]), "class_index") == [0, 0]
    assert learning.spatial_consistency(spark.createDataFrame([(0, 1)], "i long, j long"), e).first()["loss"] == 0.5


def test_frame_resolution(spark):
    frames = spark.createDataFrame([(0, "images/a.png"), (1, "images/b.png"), (2, "images/c.png")], "frame_index int, file_path string")
    images = spark.createDataFrame([("./images/a.png", 9), ("x/b.png", 9), ("none.png", 2), ("none.png", 7)], "path string, position int")
    assert [r["frame_index"] for r in masks.resolve_frames(images, frames).collect()] in ([0, 1, 2, None],) or {(r["path"], r["position"], r["frame_index"]) for r in masks.resolve_frames(images, frames).collect()} == {("./images/a.png", 9, 0), ("x/b.png", 9, 1), ("none.png", 2, 2), ("none.png", 7, None)}


def test_numbers_and_percentiles_without_one_task(spark):
    from scenelake.operators.ranking import numbered, percentiles

    r = np.random.default_rng(8)
    rows = [(int(i), float(v), int(i % 3)) for i, v in enumerate(r.permutation(500))]
    d = spark.createDataFrame(rows, "i int, v double, k int").repartition(7)
    got = {x["i"]: x["n"] for x in numbered(d, ["v"], "n").collect()}
    assert got == {i: int(v) for i, v, _ in rows}
    got = {x["i"]: x["n"] for x in numbered(d, [F.desc("v")], "n", ["k"]).collect()}
    for k in range(3):
        assert [i for i, _, kk in sorted(rows, key=lambda t: -t[1]) if kk == k] == sorted((i for i, _, kk in rows if kk == k), key=got.get)
    assert numbered(d.where("false"), ["v"], "n").count() == 0
    for values in (r.normal(size=3001), np.repeat([1.0, 2.0, 5.0], [1000, 1, 999]), np.array([3.0]), np.zeros(40)):
        t = spark.createDataFrame([(float(x),) for x in values] + [(None,)], "v double")
        qs = {f"q{i}": ("v", q) for i, q in enumerate((0, 0.001, 0.25, 0.5, 0.995, 1))}
        for accuracy in (100, 10_000):
            found = percentiles(t, qs, accuracy)
            assert all(found[k] == np.quantile(values, q) for k, (_, q) in qs.items())
    assert percentiles(t.where("false"), {"a": ("v", 0.5)}) == {"a": None}


def test_matching_runs_to_the_end_however_many_rounds(spark):
    """A ladder of pairs, each blocked by the one before, so that a round finds one match."""
    n = 12
    rows = [(k // 2 + k % 2, k // 2, 100 - k, 200, (100 - k) / 200) for k in range(2 * n)]
    pairs = spark.createDataFrame(rows, "gt int, pred int, n int, `union` int, iou double")
    got = {(r["gt"], r["pred"]) for r in evaluation.greedy_match(pairs, merge=3).collect()}
    used_g, used_p, want = set(), set(), set()
    for g, p, *_ in rows:
        if g not in used_g and p not in used_p:
            want.add((g, p))
            used_g.add(g)
            used_p.add(p)
    assert got == want
    assert evaluation.greedy_match(pairs.where("false")).count() == 0


def test_nearest_of_all_points_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    xyz = np.concatenate([rng.normal(size=(120, 3)), 0.01 * rng.normal(size=(60, 3)) + 4, [[50.0, 0, 0], [50.0, 0, 0], [-30.0, 9, 2]]])
    pts = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "gaussian_index long, x double, y double, z double")
    d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(-1))
    for sample in (None, 10_000):
        got = {}
        for r in spatial.nearest(pts, 4, sample=sample).collect():
            got.setdefault(r["i"], []).append((r["rank"], r["j"]))
        for i in range(len(xyz)):
            want = sorted((float(d[i, j]), j) for j in range(len(xyz)) if j != i)[:4]
            assert [j for _, j in sorted(got[i])] == [j for _, j in want]
    one = pts.where("gaussian_index = 0")
    assert spatial.nearest(one, 4, sample=None).count() == 0
    assert spatial.nearest(pts.withColumns({c: F.lit(1.0) for c in "xyz"}), 1, sample=None).count() == len(xyz)


def test_a_context_sample_keeps_half_for_the_selected(spark):
    rows = spark.range(100).select(F.col("id").alias("gaussian_index"))
    count = lambda on, budget: {r["selected"]: r["count"] for r in sampling.context_sample(rows, on, budget).groupBy("selected").count().collect()}
    assert count(F.col("gaussian_index") < 40, 20) == {True: 10, False: 10}
    assert count(F.col("gaussian_index") < 4, 20) == {True: 4, False: 16}
    assert count(F.col("gaussian_index") < 40, 1) == {True: 1}
    assert count(F.col("gaussian_index") < 40, 100) == {True: 40, False: 60}
    assert sampling.sampled(rows, 7).collect() == sampling.sampled(rows.repartition(5), 7).collect()


def test_voxels_far_apart_are_told_apart(spark):
    far = [(i, s * 2.0e7, 0.0, 0.0) for i, s in enumerate((1, -1))] + [(2, 2.0e7 + 1, 0.0, 0.0)]
    pts = spark.createDataFrame(far, "gaussian_index long, x double, y double, z double")
    got = {r["gaussian_index"]: r["component"] for r in spatial.point_components(pts, 1.0).collect()}
    assert got[1] == 0 and got[0] == got[2] == 1


def test_masks_share_points_by_sets_of_masks(spark):
    rows = [(m, c, p) for c in (0, 1) for p in range(30) for m in range(6) if (p * (m + 2) + c) % 3]
    got = {(r["lhs"], r["rhs"]): r["shared"] for r in voting.mask_pairs(spark.createDataFrame(rows, "mask_index int, category int, point3d_id long")).collect()}
    want = {}
    for a, c, p in rows:
        for b, k, q in rows:
            if (c, p) == (k, q) and a < b:
                want[a, b] = want.get((a, b), 0) + 1
    assert got == want
