"""Registered queries of the mask, label, colour, editing and loss operators, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenelake.functions import color as C
from scenelake.functions import geometry as G
from scenelake.functions import labels as L
from scenelake.operators import editing, learning, masks, quality, sampling, visibility
from scenelake.plans import adapt as A
from scenelake.plans.scene_queries import _projected, _round, query

_SCORE = "COALESCE(detection_score, score, 0)"
_FAMILY = """CASE WHEN lower(label) LIKE '%chair%' OR lower(label) LIKE '%sofa%' THEN 'seat' WHEN lower(label) LIKE '%table%' THEN 'table' WHEN lower(label) LIKE '%cabinet%' THEN 'storage' WHEN lower(label) LIKE '%tv%' THEN 'media' WHEN lower(label) LIKE '%bed%' THEN 'bed' END"""
_CATEGORY = """CASE WHEN lower(label) LIKE '%tv%' THEN 0 WHEN lower(label) LIKE '%chair%' THEN 1 WHEN lower(label) LIKE '%table%' THEN 2 WHEN lower(label) LIKE '%sofa%' THEN 3 WHEN lower(label) LIKE '%cabinet%' THEN 4 END"""
_FURNITURE = "regexp_matches(lower(label), 'tv|chair|table|sofa|cabinet|lamp')"
_AREA = "area / 10000.0 BETWEEN 0.001 AND 0.45"


@query("p14_candidate_score", f"SELECT frame_index, instance_id, {_SCORE} AS score FROM instances", "instances")
def _(s):
    return s.instances.select("frame_index", "instance_id", L.candidate_score("detection_score", "score").alias("score"))


@query("p25_label_family", f"SELECT instance_id, {_FAMILY} AS family FROM instances", "instances")
def _(s):
    return s.instances.select("instance_id", L.family("label").alias("family"))


@query("p26_category", f"SELECT instance_id, {_CATEGORY} AS category FROM instances", "instances")
def _(s):
    return s.instances.select("instance_id", L.category_index("label").alias("category"))


@query(
    "p27_instance_keys", "SELECT instance_id, label AS by_label, printf('%05d:%04d', frame_index, instance_id) AS by_local FROM instances",
    "instances"
)
def _(s):
    return s.instances.select("instance_id", L.instance_key("label").alias("by_label"), L.instance_key("local-instance").alias("by_local"))


@query(
    "p30_names",
    "SELECT frame_index, 'frame_' || lpad(CAST(frame_index AS VARCHAR), 5, '0') AS frame, 'mask_' || lpad(CAST(frame_index AS VARCHAR), 4, '0') || '.png' AS mask, 'tv_' || lpad(CAST(frame_index + 1 AS VARCHAR), 2, '0') AS class_name FROM frames",
    "frames"
)
def _(s):
    return s.frames.select(
        "frame_index", L.frame_name("frame_index").alias("frame"), L.mask_name("frame_index").alias("mask"),
        L.class_name("tv", F.col("frame_index") + 1).alias("class_name")
    )


@query(
    "p31_paths",
    "SELECT frame_index, regexp_replace('.//' || file_path, '^[./]+', '') AS path, regexp_extract(file_path, '[^/]+$') AS base, regexp_replace(regexp_extract(file_path, '[^/]+$'), '[.][^.]*$', '') AS stem FROM frames",
    "frames"
)
def _(s):
    return s.frames.select(
        "frame_index", L.normal_path(F.concat(F.lit(".//"), "file_path")).alias("path"), L.base_name("file_path").alias("base"),
        L.stem("file_path").alias("stem")
    )


@query(
    "p28_geometry_tags",
    """SELECT object_id, CASE WHEN SQRT(ex * ex + ey * ey + ez * ez) >= 0.7 AND LEAST(ex, ey, ez) / GREATEST(ex, ey, ez) <= 0.45 AND (ex + ey + ez - LEAST(ex, ey, ez) - GREATEST(ex, ey, ez)) / GREATEST(ex, ey, ez) <= 0.75 THEN 'panel_like' ELSE '' END AS tags FROM boxes""",
    "boxes"
)
def _(s):
    diag = G.norm(F.col("ex"), F.col("ey"), F.col("ez"))
    return s.boxes.select("object_id", F.array_join(L.geometry_tags("ex", "ey", "ez", diag), ",").alias("tags"))


@query("f1_area_filter", "SELECT instance_id FROM instances WHERE area / 10000.0 BETWEEN 0.015 AND 0.04", "instances")
def _(s):
    return masks.area_filter(s.instances, 0.015, 0.04).select("instance_id")


@query(
    "f2_proposal_filter",
    f"SELECT instance_id, {_SCORE} AS score, {_FAMILY} AS label_family FROM instances WHERE {_FURNITURE} AND {_SCORE} >= 0.25 AND {_AREA}",
    "instances"
)
def _(s):
    return masks.proposal_filter(s.instances).select("instance_id", "score", "label_family")


@query(
    "f3_category_filter",
    f"SELECT instance_id, {_CATEGORY} AS category, {_SCORE} AS score FROM instances WHERE {_CATEGORY} IS NOT NULL AND {_SCORE} >= 0.25 AND {_AREA}",
    "instances"
)
def _(s):
    return masks.category_filter(s.instances).select("instance_id", "category", "score")


@query(
    "f4_discovered_filter",
    f"SELECT instance_id, {_CATEGORY} AS category FROM instances WHERE {_CATEGORY} IN (1, 3) AND {_SCORE} >= 0.25 AND {_AREA}", "instances"
)
def _(s):
    known = s.spark.createDataFrame([(1,), (3,)], "category int")
    return masks.category_filter(s.instances, discovered=known).select("instance_id", "category")


@query(
    "f5_single_object",
    f"SELECT instance_id FROM instances WHERE lower(label) LIKE '%chair%' AND {_SCORE} >= 0.1 AND (x0 + x1) / 200.0 BETWEEN 0.2 AND 0.8 AND (y0 + y1) / 200.0 BETWEEN 0.1 AND 0.9",
    "instances"
)
def _(s):
    return masks.single_object_filter(s.instances, "chair", min_score=0.1, window=(0.2, 0.8, 0.1, 0.9)).select("instance_id")


@query("f15_frame_stride", "SELECT frame_index FROM frames WHERE frame_index % 2 = 0 AND frame_index < 4", "frames")
def _(s):
    return s.frames.where("frame_index % 2 = 0 and frame_index < 4").select("frame_index")


@query(
    "w8_top_masks",
    f"SELECT frame_index, instance_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY frame_index ORDER BY {_SCORE} DESC, area DESC, position) AS r FROM instances) WHERE r <= 3",
    "instances"
)
def _(s):
    return masks.top_per(s.instances, ["frame_index"], 3).select("frame_index", "instance_id")


@query(
    "w9_rank_in_category",
    f"SELECT instance_id, category, ROW_NUMBER() OVER (PARTITION BY category ORDER BY instance_id) AS rank FROM (SELECT instance_id, {_CATEGORY} AS category FROM instances) WHERE category IS NOT NULL",
    "instances"
)
def _(s):
    from pyspark.sql import Window

    c = s.instances.select("instance_id", L.category_index("label").alias("category")).where("category is not null")
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("category").orderBy("instance_id")))


@query(
    "r2_by_area",
    "SELECT frame_index, position, ROW_NUMBER() OVER (PARTITION BY frame_index ORDER BY area DESC, position) - 1 AS instance_id FROM instances",
    "instances"
)
def _(s):
    return masks.by_area(s.instances).select("frame_index", "position", "instance_id")


@query(
    "a23_mask_bounds",
    "SELECT frame_index, instance_id, COUNT(*) AS area, MIN(x) AS x0, MIN(y) AS y0, MAX(x) + 1 AS x1, MAX(y) + 1 AS y1 FROM mask_pixels GROUP BY 1, 2",
    "mask_pixels"
)
def _(s):
    return masks.bounds(s.mask_pixels)


@query(
    "a24_mask_bounds_inclusive",
    "SELECT frame_index, instance_id, COUNT(*) AS area, MIN(x) AS x0, MIN(y) AS y0, MAX(x) AS x1, MAX(y) AS y1 FROM mask_pixels GROUP BY 1, 2",
    "mask_pixels"
)
def _(s):
    return masks.bounds(s.mask_pixels, exclusive=False)


_PAINTED = "SELECT frame_index, x, y, instance_id FROM (SELECT m.*, ROW_NUMBER() OVER (PARTITION BY m.frame_index, x, y ORDER BY i.score DESC, i.position DESC) AS r FROM mask_pixels m JOIN instances i USING (frame_index, instance_id)) WHERE r = 1"


@query("w11_painted", _PAINTED, "mask_pixels", "instances")
def _(s):
    return masks.painted(s.mask_pixels, s.instances)


@query(
    "w11_class_indices",
    "SELECT frame_index, instance_id, ROW_NUMBER() OVER (PARTITION BY frame_index ORDER BY score, position) - 1 AS class_index FROM instances",
    "instances"
)
def _(s):
    return masks.class_indices(s.instances)


@query(
    "a31_vocabulary",
    "SELECT label AS raw, ROW_NUMBER() OVER (ORDER BY label) - 1 AS class_index FROM (SELECT DISTINCT label FROM instances WHERE label IS NOT NULL AND score >= 0.3)",
    "instances"
)
def _(s):
    return masks.vocabulary(s.instances, "label", 0.3)


@query(
    "w12_remap",
    f"SELECT frame_index, x, y, class_index FROM ({_PAINTED}) JOIN (SELECT raw, ROW_NUMBER() OVER (ORDER BY raw) - 1 AS class_index FROM (SELECT DISTINCT instance_id AS raw FROM instances WHERE score >= 0.3)) ON raw = instance_id",
    "mask_pixels", "instances"
)
def _(s):
    return masks.remap(masks.painted(s.mask_pixels, s.instances), masks.vocabulary(s.instances, "instance_id", 0.3))


@query(
    "x8_resize",
    f"""SELECT p.frame_index, tx AS x, ty AS y, p.instance_id AS class_index FROM ({_PAINTED}) p JOIN (SELECT t AS tx, t * 100 // 40 AS sx FROM (SELECT UNNEST(generate_series(0, 39)) AS t)) a ON a.sx = p.x JOIN (SELECT t AS ty, t * 100 // 60 AS sy FROM (SELECT UNNEST(generate_series(0, 59)) AS t)) b ON b.sy = p.y""",
    "mask_pixels", "instances"
)
def _(s):
    painted = masks.painted(s.mask_pixels, s.instances).withColumnRenamed("instance_id", "class_index")
    return masks.resized(painted, (100, 100), (40, 60))


_SEEDS = "SELECT DISTINCT p.frame_index, p.gaussian_index % 7 AS instance_id, p.px AS x, p.py AS y FROM proj p WHERE p.px < 100 AND p.py < 100"
_GROWN = f"SELECT DISTINCT frame_index, instance_id, x + dx AS x, y + dy AS y FROM ({_SEEDS}) CROSS JOIN (SELECT UNNEST(generate_series(-2, 2)) AS dx) CROSS JOIN (SELECT UNNEST(generate_series(-2, 2)) AS dy) WHERE x + dx BETWEEN 0 AND 99 AND y + dy BETWEEN 0 AND 99"


def _seeds(s: A.Scene) -> DataFrame:
    p = _projected(s).where("px is not null")
    return p.select("frame_index", (F.col("gaussian_index") % 7).alias("instance_id"), F.col("px").alias("x"), F.col("py").alias("y"))


@query("x1_dilate", _GROWN, "proj")
def _(s):
    return masks.dilated(_seeds(s), 2, 100, 100)


@query(
    "x2_projected_masks",
    f"SELECT g.* FROM ({_GROWN}) g JOIN (SELECT frame_index, instance_id FROM ({_GROWN}) GROUP BY 1, 2 HAVING COUNT(*) >= 2000) k USING (frame_index, instance_id)",
    "proj"
)
def _(s):
    ids = s.points.select("gaussian_index", (F.col("gaussian_index") % 7).alias("instance_id"))
    return masks.projected_masks(_projected(s), ids, 100, 100, radius=2, min_pixels=2000)


@query(
    "u5_background",
    "SELECT frame_index, 0 AS instance_id, 'background' AS label, CAST(0 AS DOUBLE) AS score, 10000 AS area, 0 AS x0, 0 AS y0, 99 AS x1, 99 AS y1 FROM frames",
    "frames"
)
def _(s):
    return masks.background_rows(s.frames, 100, 100)


@query("j18_vote_instances", """SELECT t.frame_index, t.instance_id, CASE WHEN COALESCE(n, 0) >= 3 AND COALESCE(n, 0) / total >= 0.2 THEN chosen END AS chosen, COALESCE(n, 0) AS count, ROUND(COALESCE(n, 0) / total, 6) AS ratio FROM (SELECT frame_index, instance_id, COUNT(*) AS total FROM hits GROUP BY 1, 2) t
 LEFT JOIN (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY frame_index, instance_id ORDER BY n DESC, chosen) AS r FROM (SELECT frame_index, instance_id, gaussian_index % 6 AS chosen, COUNT(*) AS n FROM hits WHERE gaussian_index % 6 < 4 GROUP BY 1, 2, 3)) WHERE r = 1) b USING (frame_index, instance_id)""", "hits")
def _(s):
    ids = s.points.select(
        "gaussian_index", F.when(F.col("gaussian_index") % 6 < 4, F.col("gaussian_index") % 6).otherwise(-1).alias("object_id")
    )
    owned = _projected(s).join(ids.hint("merge"), "gaussian_index", "left")
    return masks.vote_counts(
        visibility.mask_counts(owned, s.mask_pixels, "object_id"), min_ratio=0.2, min_count=3
    ).withColumn("ratio", _round("ratio"))


@query(
    "j6_track_hits",
    "SELECT DISTINCT m.frame_index, m.instance_id, p.gaussian_index AS point3d_id FROM proj p JOIN mask_pixels m ON m.frame_index = p.frame_index AND m.x = CAST(FLOOR(CAST(p.px AS DOUBLE) * 50 / 100) AS INT) AND m.y = CAST(FLOOR(CAST(p.py AS DOUBLE) * 50 / 100) AS INT) WHERE p.px < 100 AND p.py < 100",
    "proj", "mask_pixels"
)
def _(s):
    tracks = _projected(s).where("px is not null").select(
        "frame_index", F.col("gaussian_index").alias("point3d_id"), F.col("px").alias("x"), F.col("py").alias("y")
    )
    return masks.track_hits(tracks, s.mask_pixels, (100, 100), (50, 50))


@query(
    "x6_multiclass",
    f"SELECT c.class_id, i.frame_index, i.instance_id, {_SCORE} AS score FROM instances i CROSS JOIN (VALUES (1, 'chair'), (2, 'table|desk')) c(class_id, pattern) WHERE regexp_matches(lower(i.label), c.pattern) AND {_SCORE} >= 0.1",
    "instances"
)
def _(s):
    cats = s.spark.createDataFrame([(1, "chair"), (2, "table|desk")], "class_id int, pattern string")
    return masks.multiclass(s.instances, cats, min_score=0.1).select("class_id", "frame_index", "instance_id", "score")


@query(
    "x5_global_ids",
    f"SELECT instance_id, global_key, DENSE_RANK() OVER (ORDER BY global_key) - 1 AS global_id FROM (SELECT instance_id, COALESCE({_FAMILY}, 'unknown') AS global_key FROM instances WHERE score >= 0.2)",
    "instances"
)
def _(s):
    return masks.global_ids(s.instances, min_score=0.2).select("instance_id", "global_key", "global_id")


@query(
    "x7_best_single",
    f"SELECT frame_index, instance_id, score FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY frame_index ORDER BY {_SCORE} DESC, area DESC, position) AS r FROM instances WHERE lower(label) LIKE '%sofa%') WHERE r = 1",
    "instances"
)
def _(s):
    return masks.top_per(
        masks.single_object_filter(s.instances, "sofa|couch"), ["frame_index"], 1
    ).select("frame_index", "instance_id", "score")


_CHITS = f"""SELECT h.cluster_id, h.frame_index, h.instance_id, i.label, {_FAMILY} AS family, s.visible, h.hits, h.hits / s.visible * i.score AS weight FROM (SELECT gaussian_index % 9 AS cluster_id, frame_index, instance_id, COUNT(*) AS hits FROM hits GROUP BY ALL) h
 JOIN (SELECT gaussian_index % 9 AS cluster_id, frame_index, COUNT(*) AS visible FROM proj GROUP BY ALL) s USING (cluster_id, frame_index) JOIN instances i ON i.frame_index = h.frame_index AND i.instance_id = h.instance_id WHERE s.visible >= 16 AND h.hits >= 4 AND h.hits / s.visible >= 0.02"""


def _cluster_hits(s: A.Scene) -> DataFrame:
    clusters = s.points.select("gaussian_index", (F.col("gaussian_index") % 9).alias("cluster_id"))
    return masks.cluster_hits(_projected(s), clusters, s.mask_pixels, s.instances, min_hits=4)


@query(
    "a19_cluster_hits",
    f"SELECT cluster_id, frame_index, instance_id, label, family, visible, hits, ROUND(weight, 6) AS weight FROM ({_CHITS})", "hits",
    "proj", "instances"
)
def _(s):
    return _cluster_hits(s).withColumn("weight", _round("weight"))


@query(
    "a19_cluster_families",
    f"SELECT cluster_id, family, ROUND(SUM(weight), 6) AS score, COUNT(DISTINCT frame_index) AS frames FROM ({_CHITS}) GROUP BY 1, 2",
    "hits", "proj", "instances"
)
def _(s):
    return masks.cluster_scores(_cluster_hits(s), "family").withColumn("score", _round("score"))


@query(
    "a19_best_frames",
    f"""SELECT cluster_id, frame_index, label FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY cluster_id ORDER BY weight DESC, frame_index) AS r2 FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY cluster_id, frame_index ORDER BY weight DESC, instance_id) AS r FROM ({_CHITS})) WHERE r = 1) WHERE r2 <= 3""",
    "hits", "proj", "instances"
)
def _(s):
    return masks.best_frames(_cluster_hits(s), 3).select("cluster_id", "frame_index", "label")


@query("p29_decisions", f"""SELECT cluster_id, ROUND(best / total, 6) AS purity, ROUND(COALESCE(second, 0) / best, 6) AS secondary, best / total >= 0.6 AND COALESCE(second, 0) / best <= 0.4 AS accepted, concat_ws(',', CASE WHEN best / total < 0.6 THEN 'low_family_purity' END, CASE WHEN COALESCE(second, 0) / best > 0.4 THEN 'mixed_secondary_family' END) AS reasons
 FROM (SELECT cluster_id, SUM(score) AS total, MAX(score) AS best, MAX(score) FILTER (WHERE r = 2) AS second FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY cluster_id ORDER BY score DESC) AS r FROM (SELECT cluster_id, family, SUM(weight) AS score FROM ({_CHITS}) GROUP BY 1, 2)) GROUP BY 1)""", "hits", "proj", "instances")
def _(s):
    fam = masks.cluster_scores(_cluster_hits(s), "family")
    tags = fam.select("cluster_id").distinct().withColumn("tags", F.array().cast("array<string>"))
    out = masks.decisions(fam, tags)
    return out.select(
        "cluster_id", _round("purity").alias("purity"), _round("secondary").alias("secondary"), "accepted",
        F.array_join("reasons", ",").alias("reasons")
    )


@query("j15_frame_resolution", "SELECT frame_index AS position, frame_index FROM frames", "frames")
def _(s):
    images = s.frames.select(
        F.when(F.col("frame_index") == 0, F.concat(F.lit("./"), "file_path")).when(
            F.col("frame_index") == 1, F.concat(F.lit("other/"), L.base_name("file_path"))
        ).otherwise("nowhere.png").alias("path"),
        F.col("frame_index").alias("position")
    )
    return masks.resolve_frames(images, s.frames).select("position", "frame_index")


@query(
    "j13_label_metadata",
    "SELECT v.frame_index, v.instance_id, i.label FROM (SELECT DISTINCT frame_index % 5 AS frame_index, instance_id FROM votes) v LEFT JOIN instances i USING (frame_index, instance_id)",
    "votes", "instances"
)
def _(s):
    v = s.votes.select((F.col("frame_index") % 5).alias("frame_index"), "instance_id").distinct()
    return v.join(s.instances.select("frame_index", "instance_id", "label"), ["frame_index", "instance_id"], "left")


@query(
    "j17_membership",
    "SELECT gaussian_index FROM points WHERE gaussian_index IN (SELECT gaussian_index FROM votes WHERE frame_index = 3) AND gaussian_index NOT IN (SELECT gaussian_index FROM votes WHERE frame_index = 4)",
    "points", "votes"
)
def _(s):
    three, four = (s.votes.where(F.col("frame_index") == f).select("gaussian_index") for f in (3, 4))
    return s.points.select("gaussian_index").join(three, "gaussian_index", "left_semi").join(four, "gaussian_index", "left_anti")


@query(
    "a20_class_counts",
    "SELECT c.class_index, COUNT(o.label) AS n FROM (SELECT UNNEST(generate_series(0, 14)) AS class_index) c LEFT JOIN cloud o ON o.label = c.class_index GROUP BY 1",
    "cloud"
)
def _(s):
    classes = s.spark.range(15).select(F.col("id").cast("int").alias("class_index"))
    return learning.class_counts(s.cloud, classes, "label")


@query(
    "a21_label_histogram", "SELECT label, COUNT(*) AS n FROM instances WHERE label IS NOT NULL GROUP BY 1 ORDER BY n DESC, label LIMIT 5",
    "instances"
)
def _(s):
    return s.instances.where("label is not null").groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(5)


# Colour


@query("p8_sigmoid", "SELECT gaussian_index, ROUND(1 / (1 + EXP(-opacity)), 9) AS alpha FROM points", "points")
def _(s):
    return s.points.select("gaussian_index", _round(C.sigmoid("opacity"), 9).alias("alpha"))


@query(
    "p9_harmonics",
    "SELECT gaussian_index, ROUND((f_dc_0 - 0.5) / 0.28209479177387814, 9) AS sh, CAST(FLOOR(LEAST(GREATEST(f_dc_1 * 0.28209479177387814 + 0.5, 0), 1) * 255) AS INT) AS byte FROM points",
    "points"
)
def _(s):
    return s.points.select("gaussian_index", _round(C.rgb_to_sh("f_dc_0"), 9).alias("sh"), C.sh_to_byte("f_dc_1").alias("byte"))


@query(
    "p21_hashed_color",
    "SELECT object_id, CASE WHEN object_id < 0 THEN 96 ELSE 64 + (k & 127) END AS r, CASE WHEN object_id < 0 THEN 96 ELSE 64 + ((k >> 7) & 127) END AS g, CASE WHEN object_id < 0 THEN 96 ELSE 64 + ((k >> 14) & 127) END AS b FROM (SELECT object_id, (CAST(object_id AS BIGINT) * 1103515245 + 12345) & 2147483647 AS k FROM (SELECT DISTINCT gt AS object_id FROM ids) WHERE object_id >= 0 UNION ALL SELECT -1, 0)",
    "ids"
)
def _(s):
    c = C.hashed_color("object_id")
    return s.ids.select(F.col("gt").alias("object_id")).distinct().select("object_id", c[0].alias("r"), c[1].alias("g"), c[2].alias("b"))


@query(
    "p21_palette",
    "SELECT gt AS object_id, CAST(CASE ABS(gt) % 8 WHEN 0 THEN 0.95 WHEN 1 THEN 0.15 WHEN 2 THEN 0.20 WHEN 3 THEN 0.98 WHEN 4 THEN 0.75 WHEN 5 THEN 0.10 WHEN 6 THEN 0.95 ELSE 0.60 END AS DOUBLE) AS r FROM (SELECT DISTINCT gt FROM ids)",
    "ids"
)
def _(s):
    return s.ids.select(F.col("gt").alias("object_id")).distinct().select("object_id", C.palette("object_id")[0].alias("r"))


@query(
    "p20_highlight",
    "SELECT gaussian_index, ROUND(CASE WHEN gaussian_index % 3 = 0 THEN 0.5 * f_dc_0 + 0.5 * (1 - 0.5) / 0.28209479177387814 ELSE f_dc_0 END, 6) AS f_dc_0, CASE WHEN gaussian_index % 3 = 0 THEN 0 ELSE f_rest_0 END AS f_rest_0, ROUND(opacity + CASE WHEN gaussian_index % 3 = 0 THEN LN(2) ELSE LN(0.25) END, 6) AS opacity FROM points",
    "points"
)
def _(s):
    out = C.highlight(s.points, F.col("gaussian_index") % 3 == 0, (1.0, 0.0, 0.0), alpha=0.5, dim_scale=0.25, selected_scale=2.0)
    return out.select("gaussian_index", _round("f_dc_0").alias("f_dc_0"), "f_rest_0", _round("opacity").alias("opacity"))


@query(
    "p22_confident_recolor",
    "SELECT gaussian_index, ROUND(CASE WHEN f_dc_1 >= 0.5 AND gaussian_index % 4 IN (1, 2) THEN (CASE gaussian_index % 4 WHEN 1 THEN 0.15 ELSE 0.20 END - 0.5) / 0.28209479177387814 ELSE f_dc_0 END, 6) AS f_dc_0, ROUND(opacity + CASE WHEN f_dc_1 >= 0.5 AND gaussian_index % 4 IN (1, 2) THEN 0 ELSE LN(0.5) END, 6) AS opacity FROM points",
    "points"
)
def _(s):
    cls = F.col("gaussian_index") % 4
    chosen = (F.col("f_dc_1") >= 0.5) & cls.isin(1, 2)
    out = C.highlight(s.points, chosen, C.palette(cls, C.CLASS_PALETTE[:4]), dim_scale=0.5)
    return out.select("gaussian_index", _round("f_dc_0").alias("f_dc_0"), _round("opacity").alias("opacity"))


@query(
    "p33_depth_preview",
    "SELECT frame_index, px, py, CAST(FLOOR((LEAST(GREATEST(d, lo), hi) - lo) / (hi - lo) * 65535) AS INT) AS v FROM depth_map JOIN (SELECT frame_index, QUANTILE_CONT(d, 0.01) AS lo, QUANTILE_CONT(d, 0.99) AS hi FROM depth_map GROUP BY 1) USING (frame_index)",
    "depth_map"
)
def _(s):
    q = s.depth.groupBy("frame_index").agg(F.percentile("d", F.lit(0.01)).alias("lo"), F.percentile("d", F.lit(0.99)).alias("hi"))
    return s.depth.join(q, "frame_index").select("frame_index", "px", "py", C.to_uint16("d", F.col("lo"), F.col("hi")).alias("v"))


@query(
    "a32_depth_summary", "SELECT frame_index, MIN(d) AS least, MAX(d) AS most, MEDIAN(d) AS middle FROM depth_map GROUP BY 1", "depth_map"
)
def _(s):
    d = s.depth.where(~F.isnan("d"))
    return d.groupBy("frame_index").agg(F.min("d").alias("least"), F.max("d").alias("most"), F.median("d").alias("middle"))


@query(
    "p12_boxes",
    "SELECT instance_id, ROUND(LEAST(GREATEST((score - 0.05) * 100, 0), 100), 6) AS x0, ROUND(LEAST(GREATEST((score + 0.05) * 100, 0), 100), 6) AS x1, ROUND(area / GREATEST(CAST(width AS DOUBLE) * height, 1), 6) AS ratio FROM instances",
    "instances"
)
def _(s):
    box = G.box_xyxy("score", "score", F.lit(0.1), F.lit(0.1), 100, 100)
    return s.instances.select(
        "instance_id", _round(box[0]).alias("x0"), _round(box[2]).alias("x1"),
        _round(G.area_ratio("area", "width", "height")).alias("ratio")
    )


@query("p15_occupancy_pixels", "SELECT object_id, (5 - ox) / 0.5 AS px, (oy + 5) / 0.5 AS py FROM boxes", "boxes")
def _(s):
    px, py = G.occupancy_pixel("ox", "oy", 5, -5, 0.5)
    return s.boxes.select("object_id", px.alias("px"), py.alias("py"))


# Editing


_TABLE = "SELECT *, CAST(gaussian_index % 5 AS INT) AS object_id FROM points"


def _owned(s: A.Scene) -> DataFrame:
    return s.points.withColumn("object_id", (F.col("gaussian_index") % 5).cast("int"))


@query(
    "p18_move_object",
    f"SELECT gaussian_index, ROUND(CASE WHEN object_id = 2 THEN -y + 1 ELSE x END, 6) AS x, ROUND(CASE WHEN object_id = 2 THEN x + 2 ELSE y END, 6) AS y, ROUND(CASE WHEN object_id = 2 THEN SQRT(0.5) ELSE rot_0 END, 6) AS rot_0, ROUND(CASE WHEN object_id = 2 THEN SQRT(0.5) ELSE rot_3 END, 6) AS rot_3 FROM ({_TABLE})",
    "points"
)
def _(s):
    out = editing.move_object(_owned(s), 2, (1, 2, 0), G.rotation_z(90))
    return out.select("gaussian_index", *[(_round(c) + 0.0).alias(c) for c in ("x", "y", "rot_0", "rot_3")])


@query(
    "p19_move_about_centroid",
    f"SELECT gaussian_index, ROUND(CASE WHEN object_id = 3 THEN -(y - my) + mx ELSE x END, 5) AS x, ROUND(CASE WHEN object_id = 3 THEN (x - mx) + my ELSE y END, 5) AS y FROM ({_TABLE}) CROSS JOIN (SELECT AVG(x) AS mx, AVG(y) AS my FROM points WHERE gaussian_index % 5 = 3)",
    "points"
)
def _(s):
    out = editing.move_object(_owned(s), 3, (0, 0, 0), G.rotation_z(90), "centroid")
    return out.select("gaussian_index", *[(_round(c, 5) + 0.0).alias(c) for c in ("x", "y")])


@query("a26_repair_region", f"""SELECT gaussian_index, ROUND(CASE WHEN inside THEN 0.15 * f_dc_0 + 0.85 * m ELSE f_dc_0 END, 6) AS f_dc_0, ROUND(CASE WHEN inside THEN opacity + LN(0.85) ELSE opacity END, 6) AS opacity, CASE WHEN inside THEN 0 ELSE f_rest_0 END AS f_rest_0
 FROM (SELECT *, object_id <> 1 AND x BETWEEN -2 AND 2 AND y BETWEEN -2 AND 2 AND z BETWEEN 2 AND 6 AS inside FROM ({_TABLE})) CROSS JOIN (SELECT MEDIAN(f_dc_0) AS m FROM ({_TABLE}) WHERE object_id <> 1 AND x BETWEEN -3 AND 3 AND y BETWEEN -3 AND 3 AND z BETWEEN 1 AND 7 AND NOT (x BETWEEN -2 AND 2 AND y BETWEEN -2 AND 2 AND z BETWEEN 2 AND 6))""", "points")
def _(s):
    out = editing.repair_region(_owned(s), 1, (-2, -2, 2), (2, 2, 6), margin=1.0)
    return out.select("gaussian_index", _round("f_dc_0").alias("f_dc_0"), _round("opacity").alias("opacity"), "f_rest_0")


@query("a25_placement", """SELECT COUNT(*) FILTER (WHERE value = 255) AS free_pixels, COUNT(*) FILTER (WHERE value = 0) AS occupied_pixels, COUNT(*) FILTER (WHERE value = 127) AS unknown_pixels, 0 AS outside_pixels,
 ROUND(COUNT(*) FILTER (WHERE value = 0) / COUNT(*), 6) AS occupied_fraction, ROUND(COUNT(*) FILTER (WHERE value = 127) / COUNT(*), 6) AS unknown_fraction, COUNT(*) FILTER (WHERE value = 0) / COUNT(*) <= 0.05 AND COUNT(*) FILTER (WHERE value = 127) / COUNT(*) <= 0.25 AS valid
 FROM (SELECT px, py, CASE WHEN (px + py) % 9 = 0 THEN 127 WHEN (px * py) % 31 = 1 THEN 0 ELSE 255 END AS value FROM depth_map WHERE frame_index = 0 AND px BETWEEN 20 AND 40 AND py BETWEEN 30 AND 60)""", "depth_map")
def _(s):
    value = F.when((F.col("px") + F.col("py")) % 9 == 0, 127).when((F.col("px") * F.col("py")) % 31 == 1, 0).otherwise(255)
    occ = s.depth.where("frame_index = 0").select("px", "py", value.alias("value"))
    corners = [(60, 30, 0), (80, 30, 0), (80, 60, 0), (60, 60, 0), (60, 30, 1), (80, 30, 1), (80, 60, 1), (60, 60, 1)]
    out = editing.placement(occ, corners, upper_x=100, lower_y=0, scale=1)
    return out.withColumns({c: _round(c) for c in ("occupied_fraction", "unknown_fraction")})


@query(
    "u1_merge_categories",
    "SELECT gaussian_index, category, ROUND((CASE category WHEN 'chair' THEN 0.15 ELSE 0.95 END - 0.5) / 0.28209479177387814, 6) AS f_dc_0 FROM (SELECT gaussian_index, 'chair' AS category FROM points WHERE gaussian_index % 2 = 0 UNION ALL SELECT gaussian_index, 'other' FROM points WHERE gaussian_index % 2 = 1)",
    "points"
)
def _(s):
    parts = [
        (n, s.points.where(F.col("gaussian_index") % 2 == k).withColumn("category", F.lit(n))) for k, n in ((0, "chair"), (1, "other"))
    ]
    parts.append(("none", s.points.where("false").withColumn("category", F.lit("none"))))
    return editing.merge_categories(parts, {"chair": (0.15, 0.7, 0.25)}).select(
        "gaussian_index", "category", _round("f_dc_0").alias("f_dc_0")
    )


@query("k9_sidecar_filter", "SELECT gaussian_index, f_dc_0 FROM points WHERE opacity >= -3", "points")
def _(s):
    keep = s.points.select("gaussian_index", (F.col("opacity") >= -3).alias("keep"))
    return quality.filter_sidecar(s.points.select("gaussian_index", "f_dc_0"), keep)


@query(
    "k11_column_summary",
    "SELECT MIN(x) AS min_x, MAX(x) AS max_x, MIN(opacity) AS min_opacity, MAX(opacity) AS max_opacity, COUNT(*) AS n FROM points", "points"
)
def _(s):
    return s.points.agg(
        *[f(c).alias(f"{n}_{c}") for c in ("x", "opacity") for n, f in (("min", F.min), ("max", F.max))], F.count("*").alias("n")
    )


# Losses and classification


_COUNTED = "SELECT k.class_index, COUNT(o.label) AS n, (SELECT AVG(n) FROM (SELECT COUNT(*) AS n FROM cloud WHERE label BETWEEN 0 AND 11 GROUP BY label)) AS m FROM (SELECT UNNEST(generate_series(0, 11)) AS class_index) k LEFT JOIN cloud o ON o.label = k.class_index GROUP BY 1"
_WEIGHED = f"SELECT class_index, n, SQRT(m / (n + 1e-6)) AS w FROM ({_COUNTED})"


@query(
    "a27_class_weights",
    f"SELECT class_index, n, ROUND(CASE WHEN n > 0 THEN w / (SELECT AVG(w) FROM ({_WEIGHED}) WHERE n > 0) ELSE 1 END, 6) AS weight FROM ({_WEIGHED})",
    "cloud"
)
def _(s):
    labels = s.cloud.select(F.col("label").alias("class_index"))
    classes = s.spark.range(12).select(F.col("id").cast("int").alias("class_index"))
    return learning.class_weights(labels, classes, 0.5).withColumn("weight", _round("weight"))


_LOGITS = "SELECT gaussian_index, label % 3 AS label, CAST(x AS DOUBLE) AS a, CAST(y AS DOUBLE) AS b, CAST(z AS DOUBLE) AS c, label AS raw FROM cloud"


def _logits(s: A.Scene) -> DataFrame:
    return s.cloud.select(
        "gaussian_index", F.when(F.col("label") < 9, F.col("label") % 3).otherwise(-1).alias("label"),
        F.array(*[F.col(c).cast("double") for c in "xyz"]).alias("logits")
    )


@query(
    "a28_focal_loss",
    f"SELECT ROUND(AVG(-lp * POW(1 - EXP(lp), 2)), 6) AS loss, COUNT(*) AS valid FROM (SELECT CASE label WHEN 0 THEN a WHEN 1 THEN b ELSE c END - LN(EXP(a) + EXP(b) + EXP(c)) AS lp FROM ({_LOGITS}) WHERE raw < 9)",
    "cloud"
)
def _(s):
    return learning.focal_cross_entropy(_logits(s), gamma=2.0).withColumn("loss", _round("loss"))


@query(
    "a29_spatial_loss",
    """SELECT ROUND(AVG((POW(a.x - b.x, 2) + POW(a.y - b.y, 2) + POW(a.z - b.z, 2)) / 3), 6) AS loss FROM (SELECT gaussian_index, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z FROM cloud) a JOIN (SELECT gaussian_index, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z FROM cloud) b ON b.gaussian_index = a.gaussian_index + 1""",
    "cloud"
)
def _(s):
    pairs = s.cloud.select(F.col("gaussian_index").alias("i"), (F.col("gaussian_index") + 1).alias("j"))
    return learning.spatial_consistency(
        pairs, s.cloud.select("gaussian_index", F.array(*[F.col(c).cast("double") for c in "xyz"]).alias("embedding"))
    ).withColumn("loss", _round("loss"))


@query(
    "a30_classify",
    f"SELECT gaussian_index, CASE WHEN p >= q AND p >= r THEN 0 WHEN q >= r THEN 1 ELSE 2 END AS class_index, ROUND(GREATEST(EXP(p), EXP(q), EXP(r)) / (EXP(p) + EXP(q) + EXP(r)), 6) AS confidence FROM (SELECT gaussian_index, a + 2 * b AS p, b - c + 0.5 AS q, 3 * c - 0.5 AS r FROM ({_LOGITS}))",
    "cloud"
)
def _(s):
    emb = s.cloud.select("gaussian_index", F.array(*[F.col(c).cast("double") for c in "xyz"]).alias("embedding"))
    out = learning.classify(emb, [[1, 2, 0], [0, 1, -1], [0, 0, 3]], [0.0, 0.5, -0.5])
    return out.select("gaussian_index", "class_index", _round("confidence").alias("confidence"))


@query("a34_identity_loss", f"""SELECT ROUND(ce, 6) AS cross_entropy, valid, ROUND(sp, 6) AS spatial, ROUND(ce + 0.5 * sp, 6) AS total FROM (SELECT AVG(-(CASE label WHEN 0 THEN a WHEN 1 THEN b ELSE c END - LN(EXP(a) + EXP(b) + EXP(c)))) AS ce, COUNT(*) AS valid FROM ({_LOGITS}) WHERE raw < 9)
 CROSS JOIN (SELECT AVG((POW(a.x - b.x, 2) + POW(a.y - b.y, 2) + POW(a.z - b.z, 2)) / 3) AS sp FROM (SELECT gaussian_index, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z FROM cloud) a JOIN (SELECT gaussian_index, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z FROM cloud) b ON b.gaussian_index = a.gaussian_index + 1)""", "cloud")
def _(s):
    pairs = s.cloud.select(F.col("gaussian_index").alias("i"), (F.col("gaussian_index") + 1).alias("j"))
    emb = s.cloud.select("gaussian_index", F.array(*[F.col(c).cast("double") for c in "xyz"]).alias("embedding"))
    out = learning.identity_loss(_logits(s), None, pairs, emb, spatial_weight=0.5)
    return out.withColumns({c: _round(c) for c in ("cross_entropy", "spatial", "total")})


@query("u3_pixel_union", "SELECT DISTINCT frame_index, x, y FROM mask_pixels", "mask_pixels")
def _(s):
    return s.mask_pixels.select("frame_index", "x", "y").distinct()


@query(
    "r1_seeded_sample",
    "SELECT gaussian_index FROM points ORDER BY md5(CAST(gaussian_index AS VARCHAR) || ':42'), gaussian_index LIMIT 100", "points"
)
def _(s):
    return sampling.sampled(s.points.select("gaussian_index"), 100)


_KEPT_HITS = f"SELECT h.* FROM hits h JOIN (SELECT frame_index, instance_id FROM instances WHERE {_CATEGORY} IS NOT NULL AND {_SCORE} >= 0.25 AND {_AREA}) k USING (frame_index, instance_id)"


@query("x3_reassign_masks", f"""SELECT t.frame_index, t.instance_id, b.chosen FROM (SELECT frame_index, instance_id, COUNT(*) AS total FROM ({_KEPT_HITS}) GROUP BY 1, 2) t
 JOIN (SELECT *, ROW_NUMBER() OVER (PARTITION BY frame_index, instance_id ORDER BY n DESC, chosen) AS r FROM (SELECT frame_index, instance_id, gaussian_index % 6 AS chosen, COUNT(*) AS n FROM ({_KEPT_HITS}) GROUP BY 1, 2, 3)) b USING (frame_index, instance_id) WHERE r = 1 AND n >= 3 AND n / total >= 0.2""", "hits", "instances")
def _(s):
    """Masks renamed to the discovered instance that most of their points belong to, after the category filter."""
    kept = masks.category_filter(s.instances)
    pixels = s.mask_pixels.join(kept.select("frame_index", "instance_id"), ["frame_index", "instance_id"], "left_semi")
    ids = s.points.select("gaussian_index", (F.col("gaussian_index") % 6).alias("object_id"))
    owned = _projected(s).join(ids.hint("merge"), "gaussian_index", "left")
    chosen = masks.vote_counts(visibility.mask_counts(owned, pixels, "object_id"), min_count=3).where("chosen is not null")
    return chosen.select("frame_index", "instance_id", "chosen")


