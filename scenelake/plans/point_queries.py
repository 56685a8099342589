"""Registered queries of the remaining point, join and sampling operators, each beside its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenelake.functions import color as C
from scenelake.functions import geometry as G
from scenelake.functions import labels as L
from scenelake.operators import editing, evaluation, learning, masks, quality, sampling, spatial, visibility, voting
from scenelake.operators.ranking import numbered
from scenelake.plans import adapt as A
from scenelake.plans.mask_queries import _CATEGORY, _CHITS, _LOGITS, _SCORE, _cluster_hits, _owned
from scenelake.plans.scene_queries import _CODES, _projected, _round, query

# Geometry


@query(
    "p1_camera_coordinates",
    "SELECT f.frame_index, p.gaussian_index, ROUND(x + t0, 9) AS cx, ROUND(y + t1, 9) AS cy, z + t2 AS cz FROM points p CROSS JOIN frames f",
    "points", "frames"
)
def _(s):
    pair = s.points.crossJoin(s.frames)
    cam = G.world_to_camera("x", "y", "z", [F.col(c) for c in visibility.POSE[:9]], [F.col(c) for c in visibility.POSE[9:]])
    return pair.select("frame_index", "gaussian_index", _round(cam[0], 9).alias("cx"), _round(cam[1], 9).alias("cy"), cam[2].alias("cz"))


@query("p2_pinhole", "SELECT gaussian_index, ROUND(100 * (x / z) + 50, 6) AS u, ROUND(80 * (y / z) + 40, 6) AS v FROM points", "points")
def _(s):
    u, v = G.project((F.col("x"), F.col("y"), F.col("z")), "PINHOLE", 100, 80, 50, 40, ())
    return s.points.select("gaussian_index", _round(u).alias("u"), _round(v).alias("v"))


@query("p6_pixels", "SELECT frame_index, gaussian_index, CAST(FLOOR(u) AS BIGINT) AS px, CAST(FLOOR(v) AS BIGINT) AS py FROM proj", "proj")
def _(s):
    return _projected(s).select("frame_index", "gaussian_index", G.pixel("u").alias("px"), G.pixel("v").alias("py"))


@query("p7_pixel_ids", "SELECT frame_index, gaussian_index, py * 100 + px AS pixel FROM proj WHERE px < 100 AND py < 100", "proj")
def _(s):
    return _projected(s).where("px is not null").select("frame_index", "gaussian_index", G.pixel_id("px", "py", 100).alias("pixel"))


@query("p11_norms", """SELECT gaussian_index, ROUND(SQRT(EXP(2 * scale_0) + EXP(2 * scale_1) + EXP(2 * scale_2)), 9) AS size, ROUND(SQRT(POW(x - mx, 2) + POW(y - my, 2) + POW(z - mz, 2)), 9) AS radius FROM points
 CROSS JOIN (SELECT MEDIAN(x) AS mx, MEDIAN(y) AS my, MEDIAN(z) AS mz FROM points)""", "points")
def _(s):
    return quality.with_radius(s.points).select(
        "gaussian_index", _round(quality.scale_size(), 9).alias("size"), _round("radius", 9).alias("radius")
    )


@query(
    "p13_box_shares",
    "SELECT instance_id, ROUND(area / 10000.0, 9) AS ratio, (x0 + x1) / 200.0 AS cx, (y0 + y1) / 200.0 AS cy FROM instances", "instances"
)
def _(s):
    centre = lambda a, b, n: (F.col(a) + F.col(b)).cast("double") / 2 / F.col(n)
    return s.instances.select(
        "instance_id", _round(G.area_ratio("area", "width", "height"), 9).alias("ratio"), centre("x0", "x1", "width").alias("cx"),
        centre("y0", "y1", "height").alias("cy")
    )


@query(
    "p16_rigid",
    "SELECT gaussian_index, ROUND(-(y - 2) + 1 + 0.5, 9) AS x, ROUND((x - 1) + 2 - 1.5, 9) AS y, ROUND(z + 2, 9) AS z FROM points", "points"
)
def _(s):
    moved = G.rigid("x", "y", "z", G.rotation_z(90), (0.5, -1.5, 2), (1, 2, 3))
    return s.points.select("gaussian_index", *[(_round(m, 9) + 0.0).alias(c) for m, c in zip(moved, "xyz", strict=True)])


@query("p17_rotations", "SELECT gaussian_index, ROUND(z, 9) AS x, ROUND(x, 9) AS y, ROUND(y, 9) AS z FROM points", "points")
def _(s):
    """A third of a turn about the diagonal takes x to y, y to z and z to x."""
    moved = G.rigid("x", "y", "z", G.rotation_about((1, 1, 1), 120), (0, 0, 0), (0, 0, 0))
    return s.points.select("gaussian_index", *[(_round(m, 9) + 0.0).alias(c) for m, c in zip(moved, "xyz", strict=True)])


@query(
    "p23_category_colors",
    "SELECT gaussian_index, category, ROUND((CASE category WHEN 'chair' THEN 0.15 WHEN 'table' THEN 0.2 ELSE 0.95 END - 0.5) / 0.28209479177387814, 6) AS f_dc_0, ROUND((CASE category WHEN 'chair' THEN 0.7 WHEN 'table' THEN 0.42 ELSE 0.95 END - 0.5) / 0.28209479177387814, 6) AS f_dc_1 FROM (SELECT gaussian_index, CASE gaussian_index % 3 WHEN 0 THEN 'chair' WHEN 1 THEN 'table' ELSE 'lamp' END AS category FROM points)",
    "points"
)
def _(s):
    parts = [
        (n, s.points.where(F.col("gaussian_index") % 3 == k).withColumn("category", F.lit(n)))
        for k, n in enumerate(("chair", "table", "lamp"))
    ]
    out = editing.merge_categories(parts, {"chair": (0.15, 0.7, 0.25), "table": (0.2, 0.42, 0.95)})
    return out.select("gaussian_index", "category", _round("f_dc_0").alias("f_dc_0"), _round("f_dc_1").alias("f_dc_1"))


@query(
    "p24_export_layout",
    "SELECT x, y, z, CAST(0 AS FLOAT) AS nx, CAST(0 AS FLOAT) AS ny, CAST(0 AS FLOAT) AS nz, f_dc_0, f_dc_1, f_dc_2, f_dc_0 + 1 AS f_rest_0, f_dc_1 + 2 AS f_rest_1, opacity, scale_0, scale_1, scale_2, rot_0, rot_1, rot_2, rot_3 FROM points",
    "points"
)
def _(s):
    rest = s.points.drop("f_rest_0").withColumn("f_rest", F.array(F.col("f_dc_0") + 1, F.col("f_dc_1") + 2))
    return editing.export_layout(rest)


@query(
    "p24_export_colors",
    "SELECT x, y, z, CAST(0 AS FLOAT) AS nx, CAST(0 AS FLOAT) AS ny, CAST(0 AS FLOAT) AS nz, CAST(FLOOR(LEAST(GREATEST(f_dc_0 * 0.28209479177387814 + 0.5, 0), 1) * 255) AS INT) AS red, CAST(FLOOR(LEAST(GREATEST(f_dc_1 * 0.28209479177387814 + 0.5, 0), 1) * 255) AS INT) AS green, CAST(FLOOR(LEAST(GREATEST(f_dc_2 * 0.28209479177387814 + 0.5, 0), 1) * 255) AS INT) AS blue, opacity, scale_0, scale_1, scale_2, rot_0, rot_1, rot_2, rot_3 FROM points",
    "points"
)
def _(s):
    return editing.export_layout(s.points, rgb=True)


@query("p32_class_resolution", "SELECT place, class_index FROM (VALUES (0, 2), (1, 0), (2, 1)) t(place, class_index)")
def _(s):
    ids = L.resolve_classes(["sofa", "0", 1], {0: "class_0", 1: "chair", 2: "sofa"})
    return s.spark.createDataFrame(list(enumerate(ids)), "place int, class_index int")


@query(
    "p34_overlay",
    "SELECT gaussian_index, CAST(FLOOR(0.55 * (gaussian_index % 256) + 0.45 * g) AS INT) AS blended, g AS label_green FROM (SELECT gaussian_index, 64 + (((gaussian_index % 9) * 1103515245 + 12345) & 2147483647) // 128 % 128 AS g FROM points)",
    "points"
)
def _(s):
    """A grey image of byte values with a colour of each label laid over it."""
    green = C.hashed_color(F.col("gaussian_index") % 9)[1]
    return s.points.select(
        "gaussian_index", C.blend_bytes(F.col("gaussian_index") % 256, green, 0.45).alias("blended"), green.alias("label_green")
    )


@query(
    "p34_bytes", "SELECT gaussian_index, CAST(ROUND_EVEN(LEAST(GREATEST(f_dc_1 - 0.1, 0), 1) * 255, 0) AS INT) AS byte FROM points",
    "points"
)
def _(s):
    return s.points.select("gaussian_index", C.rounded_byte(F.col("f_dc_1") - 0.1).alias("byte"))


# Filters


@query(
    "f7_valid_votes",
    "SELECT h.frame_index, h.instance_id, h.gaussian_index, CAST(i.score * (p.f_dc_0 + 0.1) AS FLOAT) AS weight FROM hits h JOIN instances i USING (frame_index, instance_id) JOIN points p USING (gaussian_index) WHERE p.opacity >= -3",
    "hits", "instances", "points"
)
def _(s):
    scores = s.points.select("gaussian_index", (F.col("f_dc_0") + 0.1).alias("quality"), (F.col("opacity") >= -3).alias("valid"))
    return visibility.mask_votes(_projected(s), s.mask_pixels, s.instances, quality=scores)


@query(
    "f10_box_filter", "SELECT gaussian_index FROM points WHERE x BETWEEN -2 AND 2 AND y BETWEEN -1 AND 3 AND z BETWEEN 2 AND 6", "points"
)
def _(s):
    return s.points.where(editing.in_box((-2, -1, 2), (2, 3, 6))).select("gaussian_index")


_CLASSES = f"SELECT gaussian_index, CASE WHEN p >= q AND p >= r THEN 0 WHEN q >= r THEN 1 ELSE 2 END AS class_index, GREATEST(EXP(p), EXP(q), EXP(r)) / (EXP(p) + EXP(q) + EXP(r)) AS confidence FROM (SELECT gaussian_index, a + 2 * b AS p, b - c + 0.5 AS q, 3 * c - 0.5 AS r FROM ({_LOGITS}))"


def _classified(s: A.Scene) -> DataFrame:
    emb = s.cloud.select("gaussian_index", F.array(*[F.col(c).cast("double") for c in "xyz"]).alias("embedding"))
    return learning.classify(emb, [[1, 2, 0], [0, 1, -1], [0, 0, 3]], [0.0, 0.5, -0.5])


@query(
    "f14_confident_classes", f"SELECT gaussian_index, class_index FROM ({_CLASSES}) WHERE confidence >= 0.5 AND class_index IN (0, 1)",
    "cloud"
)
def _(s):
    return _classified(s).where((F.col("confidence") >= 0.5) & F.col("class_index").isin(0, 1)).select("gaussian_index", "class_index")


# Joins


@query(
    "j1_point_frames",
    "SELECT f.frame_index, p.gaussian_index, z > 0 AND u >= 0 AND u < 100 AND v >= 0 AND v < 100 AS valid FROM (SELECT f.frame_index, p.gaussian_index, p.z, 100 * ((p.x + f.t0) / p.z) + 50 AS u, 100 * ((p.y + f.t1) / p.z) + 50 AS v FROM points p CROSS JOIN frames f) p JOIN frames f USING (frame_index)",
    "points", "frames"
)
def _(s):
    return visibility.project_points(s.points, s.frames, A.CAMERA, valid_only=False).select("frame_index", "gaussian_index", "valid")


@query("j7_voxel_adjacency", """SELECT a.n AS src, b.n AS dst FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY vx, vy, vz) - 1 AS n FROM (SELECT DISTINCT vx, vy, vz FROM vox)) a JOIN (SELECT *, ROW_NUMBER() OVER (ORDER BY vx, vy, vz) - 1 AS n FROM (SELECT DISTINCT vx, vy, vz FROM vox)) b
 ON ABS(a.vx - b.vx) <= 1 AND ABS(a.vy - b.vy) <= 1 AND ABS(a.vz - b.vz) <= 1 AND a.n < b.n""", "vox")
def _(s):
    voxels = spatial.voxels_of(s.cloud, 0.1).select(*spatial.VOXEL).distinct()
    return spatial.adjacent(numbered(voxels, list(spatial.VOXEL), "node"))


@query(
    "j14_lookups",
    "SELECT i.gaussian_index, b.label, CAST(CASE ABS(i.gt) % 8 WHEN 0 THEN 0.95 WHEN 1 THEN 0.15 WHEN 2 THEN 0.20 WHEN 3 THEN 0.98 WHEN 4 THEN 0.75 WHEN 5 THEN 0.10 WHEN 6 THEN 0.95 ELSE 0.60 END AS DOUBLE) AS red, b.ex * b.ey * b.ez AS volume FROM ids i LEFT JOIN boxes b ON b.object_id = i.gt",
    "ids", "boxes"
)
def _(s):
    """Label, box and palette colour of each point's object; null where the object has none."""
    box = spatial.box_frames(s.box_corners).select("object_id", "volume").join(s.boxes.select("object_id", "label"), "object_id")
    return s.ids.join(box.withColumnRenamed("object_id", "gt"), "gt", "left").select(
        "gaussian_index", "label", C.palette("gt")[0].alias("red"), "volume"
    )


@query("j20_matched_pairs", f"SELECT gaussian_index FROM ({_CODES}) WHERE code = 1", "matches", "ids")
def _(s):
    matches = evaluation.greedy_match(evaluation.iou_pairs(s.ids, 0.5))
    return evaluation.agreement(s.ids, matches).where("code = 1").select("gaussian_index")


# Aggregates, order, sampling, sets


@query(
    "a18_identity_stats",
    f"SELECT class_index AS instance_id, COUNT(*) AS gaussian_count, ROUND(AVG(confidence), 6) AS confidence_mean, ROUND(MIN(confidence), 6) AS confidence_min, ROUND(MAX(confidence), 6) AS confidence_max FROM ({_CLASSES}) GROUP BY 1",
    "cloud"
)
def _(s):
    out = spatial.instance_stats(_classified(s).withColumnRenamed("class_index", "instance_id"), ["confidence"])
    return out.select(
        "instance_id", "gaussian_count", *[_round(f"confidence_{k}").alias(f"confidence_{k}") for k in ("mean", "min", "max")]
    )


@query("r4_ranked_clusters", f"""SELECT cluster_id, ROUND(best, 6) AS best, n AS gaussian_count, ROW_NUMBER() OVER (ORDER BY best DESC NULLS LAST, n DESC, cluster_id) AS rank FROM (SELECT gaussian_index % 9 AS cluster_id, COUNT(*) AS n FROM points GROUP BY 1) c
 LEFT JOIN (SELECT cluster_id, MAX(score) AS best FROM (SELECT cluster_id, family, SUM(weight) AS score FROM ({_CHITS}) GROUP BY 1, 2) GROUP BY 1) b USING (cluster_id)""", "hits", "proj", "instances", "points")
def _(s):
    sizes = s.points.groupBy((F.col("gaussian_index") % 9).alias("cluster_id")).agg(F.count("*").alias("gaussian_count"))
    return masks.ranked_clusters(masks.cluster_scores(_cluster_hits(s), "family"), sizes).withColumn("best", _round("best"))


_DRAWN = "SELECT gaussian_index, selected FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY selected ORDER BY md5(CAST(gaussian_index AS VARCHAR) || ':42'), gaussian_index) AS r, COUNT(*) OVER () AS n, COUNT(*) FILTER (WHERE selected) OVER () AS on_ FROM (SELECT gaussian_index, gaussian_index % 5 = 2 AS selected FROM points))"


@query("r5_context_sample", f"{_DRAWN} WHERE n <= 60 OR r <= CASE WHEN selected THEN LEAST(on_, 30) ELSE 60 - LEAST(on_, 30) END", "points")
def _(s):
    owned = _owned(s).select("gaussian_index", "object_id")
    return sampling.context_sample(owned, F.col("object_id") == 2, 60).select("gaussian_index", "selected")


@query(
    "r1_sample_per_group",
    "SELECT label, gaussian_index FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY label ORDER BY md5(CAST(gaussian_index AS VARCHAR) || ':42'), gaussian_index) AS r FROM cloud) WHERE r <= 4",
    "cloud"
)
def _(s):
    return sampling.sampled(s.cloud, 4, by=["label"]).select("label", "gaussian_index")


@query("u2_concatenated_votes", "SELECT * FROM votes", "votes")
def _(s):
    """Votes of each third of the frames, put together again."""
    return reduce(DataFrame.unionAll, [s.votes.where(F.col("frame_index") % 3 == k) for k in range(3)])


@query(
    "u4_distinct_pairs",
    "SELECT frame_index, instance_id, COUNT(*) AS n, ROW_NUMBER() OVER (ORDER BY frame_index, instance_id) - 1 AS code FROM votes GROUP BY 1, 2",
    "votes"
)
def _(s):
    return numbered(s.votes.groupBy("frame_index", "instance_id").agg(F.count("*").alias("n")), ["frame_index", "instance_id"], "code")


_TRACK_HITS = "SELECT DISTINCT m.frame_index, m.instance_id, p.gaussian_index AS point3d_id FROM proj p JOIN mask_pixels m ON m.frame_index = p.frame_index AND m.x = CAST(FLOOR(CAST(p.px AS DOUBLE) * 50 / 100) AS INT) AND m.y = CAST(FLOOR(CAST(p.py AS DOUBLE) * 50 / 100) AS INT) WHERE p.px < 100 AND p.py < 100"


@query("x4_track_masks", f"""SELECT * FROM (WITH RECURSIVE k AS (SELECT frame_index, instance_id, {_CATEGORY} AS category, ROW_NUMBER() OVER (ORDER BY frame_index, instance_id) - 1 AS mask_index FROM instances WHERE {_CATEGORY} IS NOT NULL AND {_SCORE} >= 0.25 AND area / 10000.0 BETWEEN 0.001 AND 0.45),
 t AS (SELECT k.mask_index, k.category, h.point3d_id, COUNT(*) OVER (PARTITION BY k.mask_index) AS support FROM ({_TRACK_HITS}) h JOIN k USING (frame_index, instance_id)), size AS (SELECT mask_index, category, support FROM t WHERE support >= 5 GROUP BY ALL),
 e AS (SELECT lhs, rhs FROM (SELECT a.mask_index AS lhs, b.mask_index AS rhs, COUNT(*) AS shared, MIN(LEAST(a.support, b.support)) AS low FROM t a JOIN t b ON a.category = b.category AND a.point3d_id = b.point3d_id AND a.mask_index < b.mask_index WHERE a.support >= 5 AND b.support >= 5 GROUP BY ALL) WHERE shared >= 4 AND shared / low >= 0.1),
 r AS (SELECT mask_index AS node, mask_index AS other FROM size UNION SELECT r.node, CASE WHEN e.lhs = r.other THEN e.rhs ELSE e.lhs END FROM r JOIN e ON e.lhs = r.other OR e.rhs = r.other),
 c AS (SELECT node, MIN(other) AS root FROM r GROUP BY 1), g AS (SELECT root, MIN(category) AS category, COUNT(*) AS masks, SUM(support) AS total, MIN(mask_index) AS first FROM size JOIN c ON c.node = size.mask_index GROUP BY 1 HAVING COUNT(*) >= 2),
 n AS (SELECT root, category, ROW_NUMBER() OVER (ORDER BY masks DESC, total DESC, first) - 1 AS group_id FROM g), q AS (SELECT root, group_id, ROW_NUMBER() OVER (PARTITION BY category ORDER BY group_id) AS rank FROM n)
 SELECT k.frame_index, k.instance_id, k.mask_index, k.category, COALESCE(q.group_id, -1) AS group_id, q.rank FROM size JOIN k USING (mask_index) JOIN c ON c.node = size.mask_index LEFT JOIN q USING (root))""", "proj", "mask_pixels", "instances")
def _(s):
    """Masks of one object by shared reconstructed points: points seen in frames stand for the tracks."""
    kept = masks.category_filter(s.instances).select("frame_index", "instance_id", "category")
    tracks = _projected(s).where("px is not null").select(
        "frame_index", F.col("gaussian_index").alias("point3d_id"), F.col("px").alias("x"), F.col("py").alias("y")
    )
    pixels = s.mask_pixels.join(kept.select("frame_index", "instance_id"), ["frame_index", "instance_id"], "left_semi")
    hits = masks.place_hits(masks.track_places(tracks, (100, 100), (50, 50)), pixels)
    return masks.track_masks(kept, hits, min_points=5, min_shared=4, min_ratio=0.1, min_masks=2)


@query(
    "x9_gathered_labels",
    "SELECT frame_index, x, y, instance_id FROM (SELECT m.*, ROW_NUMBER() OVER (PARTITION BY m.frame_index, x, y ORDER BY i.score DESC, i.position DESC) AS r FROM mask_pixels m JOIN instances i USING (frame_index, instance_id)) WHERE r = 1 AND frame_index IN (1, 3)",
    "mask_pixels", "instances"
)
def _(s):
    return masks.gather(masks.painted(s.mask_pixels, s.instances), [1, 3])


@query(
    "j5_pairs_of_votes",
    "SELECT a.instance_id + 8 * a.frame_index AS lhs, b.instance_id + 8 * b.frame_index AS rhs, COUNT(*) AS shared FROM agg_votes a JOIN agg_votes b ON a.gaussian_index = b.gaussian_index AND a.instance_id + 8 * a.frame_index < b.instance_id + 8 * b.frame_index GROUP BY ALL HAVING COUNT(*) >= 3",
    "agg_votes"
)
def _(s):
    """Pairs of all instances of all frames that share three points or more."""
    own = voting.aggregate_votes(s.votes).select(
        (F.col("instance_id") + 8 * F.col("frame_index")).alias("mask_index"), F.lit(0).alias("category"),
        F.col("gaussian_index").alias("point3d_id")
    )
    return voting.mask_pairs(own, min_shared=3)
