"""Registered queries of the scene operators, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenelake.functions import color as C
from scenelake.functions import geometry as G
from scenelake.functions import labels as L
from scenelake.operators import evaluation, quality, spatial, visibility, voting
from scenelake.plans import adapt as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Common table expressions of the oracles, in order of use.
_VIEWS = {
    "votes": A.VOTES, "points": A.POINTS, "cloud": A.CLOUD, "frames": A.FRAMES, "instances": A.INSTANCES, "ids": A.IDS, "boxes": A.BOXES,
    "mask_pixels": "SELECT frame_index, instance_id, x, UNNEST(generate_series(y0, y1 - 1)) AS y FROM (SELECT frame_index, instance_id, y0, y1, UNNEST(generate_series(x0, x1 - 1)) AS x FROM instances)",
    "agg_votes": "SELECT frame_index, instance_id, gaussian_index, SUM(weight) AS weight FROM votes GROUP BY ALL",
    "locals": "SELECT frame_index, instance_id, COUNT(*) AS support_size, ROW_NUMBER() OVER (ORDER BY frame_index, instance_id) - 1 AS local_index FROM agg_votes GROUP BY frame_index, instance_id",
    "overlap": """SELECT a.local_index AS lhs, b.local_index AS rhs, COUNT(*) AS shared, MIN(LEAST(a.support_size, b.support_size)) AS low FROM
 (SELECT v.*, l.local_index, l.support_size FROM agg_votes v JOIN locals l USING (frame_index, instance_id)) a JOIN
 (SELECT v.*, l.local_index, l.support_size FROM agg_votes v JOIN locals l USING (frame_index, instance_id)) b
 ON a.gaussian_index = b.gaussian_index AND b.frame_index = a.frame_index + 1 GROUP BY 1, 2""",
    "edges": "SELECT lhs, rhs, shared, shared / low AS overlap_ratio FROM overlap WHERE shared >= 20 AND shared / low >= 0.13",
    "reach": "SELECT local_index AS node, local_index AS other FROM locals UNION SELECT r.node, CASE WHEN e.lhs = r.other THEN e.rhs ELSE e.lhs END FROM reach r JOIN edges e ON e.lhs = r.other OR e.rhs = r.other",
    "objects": "SELECT l.*, c.root, DENSE_RANK() OVER (ORDER BY c.root) - 1 AS object_id FROM locals l JOIN (SELECT node, MIN(other) AS root FROM reach GROUP BY node) c ON c.node = l.local_index",
    "object_votes": "SELECT v.gaussian_index, o.object_id, SUM(v.weight) AS weight FROM votes v JOIN objects o USING (frame_index, instance_id) GROUP BY ALL",
    "assigned": "SELECT p.gaussian_index, COALESCE(b.object_id, -1) AS object_id FROM points p LEFT JOIN (SELECT gaussian_index, object_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY gaussian_index ORDER BY weight DESC, object_id) AS r FROM object_votes) WHERE r = 1 AND weight > 0.0001) b USING (gaussian_index)",
    "proj": """SELECT frame_index, gaussian_index, CAST(u AS FLOAT) AS u, CAST(v AS FLOAT) AS v, CAST(d AS FLOAT) AS depth, CAST(FLOOR(CAST(u AS FLOAT)) AS INT) AS px, CAST(FLOOR(CAST(v AS FLOAT)) AS INT) AS py FROM
 (SELECT f.frame_index, p.gaussian_index, 100 * ((p.x + f.t0) / p.z) + 50 AS u, 100 * ((p.y + f.t1) / p.z) + 50 AS v, p.z AS d FROM points p CROSS JOIN frames f) WHERE d > 0 AND u >= 0 AND u < 100 AND v >= 0 AND v < 100""",
    "front": "SELECT frame_index, px, py, MIN(depth) AS front FROM proj WHERE px < 100 AND py < 100 GROUP BY ALL",
    "depth_map": "SELECT f.frame_index, a.px, b.py, CAST(1 + (a.px * 3 + b.py * 7 + f.frame_index) % 40 AS DOUBLE) / 8 AS d FROM frames f CROSS JOIN (SELECT UNNEST(generate_series(0, 99)) AS px) a CROSS JOIN (SELECT UNNEST(generate_series(0, 99)) AS py) b",
    "hits": "SELECT p.frame_index, m.instance_id, p.gaussian_index FROM proj p JOIN mask_pixels m ON m.frame_index = p.frame_index AND m.x = p.px AND m.y = p.py",
    "vox": "SELECT gaussian_index, CAST(FLOOR(CAST(x AS FLOAT) / CAST(0.1 AS FLOAT)) AS INT) AS vx, CAST(FLOOR(CAST(y AS FLOAT) / CAST(0.1 AS FLOAT)) AS INT) AS vy, CAST(FLOOR(CAST(z AS FLOAT) / CAST(0.1 AS FLOAT)) AS INT) AS vz, label, x, y, z FROM cloud",
    "contingency": "SELECT gt, pred, COUNT(*) AS n FROM ids WHERE gt >= 0 AND pred >= 0 GROUP BY ALL",
    "pairs": """SELECT c.gt, c.pred, c.n, g.n + p.n - c.n AS u, c.n / (g.n + p.n - c.n) AS iou FROM contingency c JOIN (SELECT gt, COUNT(*) AS n FROM ids WHERE gt >= 0 GROUP BY 1) g USING (gt)
 JOIN (SELECT pred, COUNT(*) AS n FROM ids WHERE pred >= 0 GROUP BY 1) p USING (pred)""",
    "matches": "SELECT * FROM pairs WHERE iou > 0.5",
}
_NEEDS = {
    "mask_pixels": ("instances",), "agg_votes": ("votes",), "locals": ("agg_votes",), "overlap": (
        "locals", "agg_votes"
    ), "edges": ("overlap",), "reach": ("edges", "locals"), "objects": ("reach", "locals"),
    "object_votes": ("votes", "objects"), "assigned": (
        "points", "object_votes"
    ), "proj": ("points", "frames"), "front": ("proj",), "depth_map": ("frames",), "hits": ("proj", "mask_pixels"), "vox": ("cloud",),
    "contingency": ("ids",), "pairs": ("contingency", "ids"), "matches": ("pairs",),
}


def _with(sql: str, *views: str) -> str:
    need: set[str] = set()

    def add(v: str) -> None:
        for n in _NEEDS.get(v, ()):
            add(n)
        need.add(v)

    for v in views:
        add(v)
    ctes = ", ".join(f"{k} AS ({A.for_duckdb(v)})" for k, v in _VIEWS.items() if k in need)
    return f"WITH RECURSIVE {ctes} {sql}" if ctes else sql


def query(name: str, sql: str | None = None, *views: str):
    """Register a function of a scene under ``name`` with its SQL over the named views."""

    def put(f: Callable[[A.Scene], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(A.Scene(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = _with(sql, *views)
        return f

    return put


def _round(c, n: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


def _objects(s: A.Scene) -> DataFrame:
    """Local instances with object ids."""
    inst = voting.local_instances(s.votes)
    return voting.global_objects(inst, voting.instance_overlap(s.votes, inst, max_frame_gap=1, min_shared=20, min_ratio=0.13))


def _projected(s: A.Scene) -> DataFrame:
    return visibility.project_points(s.points, s.frames, A.CAMERA)


# Votes, association, grouping


@query("a1_vote_aggregate", "SELECT * FROM agg_votes", "agg_votes")
def _(s):
    return voting.aggregate_votes(s.votes)


@query("a1_local_instances", "SELECT frame_index, instance_id, support_size, local_index FROM locals", "locals")
def _(s):
    return voting.local_instances(s.votes)


@query(
    "f6_candidate_support", "SELECT frame_index, instance_id, support_size, local_index FROM locals WHERE support_size BETWEEN 150 AND 200",
    "locals"
)
def _(s):
    return voting.candidates(voting.local_instances(s.votes), 150, 200)


@query("j4_instance_overlap", "SELECT lhs, rhs, shared, ROUND(overlap_ratio, 6) AS overlap_ratio FROM edges", "edges")
def _(s):
    inst = voting.local_instances(s.votes)
    return voting.instance_overlap(
        s.votes, inst, max_frame_gap=1, min_shared=20, min_ratio=0.13
    ).withColumn("overlap_ratio", _round("overlap_ratio"))


@query("g1_global_objects", "SELECT frame_index, instance_id, support_size, local_index, object_id FROM objects", "objects")
def _(s):
    return _objects(s)


@query("a3_assign_objects", "SELECT * FROM assigned", "assigned")
def _(s):
    return voting.assign_objects(s.votes, _objects(s), s.points)


@query("a4_group_summary", """SELECT g.*, e.support_frames, e.instance_count, w.total_vote_weight FROM
 (SELECT object_id, COUNT(*) AS gaussian_count, ROUND(AVG(x), 6) AS centroid_x, ROUND(AVG(y), 6) AS centroid_y, ROUND(AVG(z), 6) AS centroid_z, MIN(x) AS min_x, MIN(y) AS min_y, MIN(z) AS min_z, MAX(x) AS max_x, MAX(y) AS max_y, MAX(z) AS max_z
  FROM assigned JOIN points USING (gaussian_index) WHERE object_id >= 0 GROUP BY 1) g
 LEFT JOIN (SELECT object_id, string_agg(DISTINCT lpad(CAST(frame_index AS VARCHAR), 3, '0'), ',' ORDER BY lpad(CAST(frame_index AS VARCHAR), 3, '0')) AS support_frames, COUNT(*) AS instance_count FROM objects GROUP BY 1) e USING (object_id)
 LEFT JOIN (SELECT object_id, SUM(weight) AS total_vote_weight FROM object_votes GROUP BY 1) w USING (object_id)""", "assigned", "objects")
def _(s):
    obj = _objects(s)
    out = voting.group_summary(voting.assign_objects(s.votes, obj, s.points), s.points, s.votes, obj)
    names = F.array_join(F.transform("support_frames", lambda f: F.lpad(f.cast("string"), 3, "0")), ",")
    return out.withColumns(
        {
            "support_frames": names, "total_vote_weight": F.col("total_vote_weight").cast("decimal(38,2)"),
            **{f"centroid_{c}": _round(f"centroid_{c}") for c in "xyz"}
        }
    )


_LABELLED = "SELECT o.*, CASE CAST(local_index % 4 AS INT) WHEN 0 THEN 'chair' WHEN 1 THEN 'desk' WHEN 2 THEN 'sofa' ELSE NULL END AS label FROM objects o"


def _labelled(s: A.Scene) -> DataFrame:
    k = F.col("local_index") % 4
    label = F.when(k == 0, "chair").when(k == 1, "desk").when(k == 2, "sofa")
    return _objects(s).withColumn("label", label).withColumn("label_family", L.family("label"))


@query("a11_object_proposals", f"""WITH lab AS ({_LABELLED}), fam AS (SELECT *, CASE WHEN label IN ('chair', 'sofa') THEN 'seat' WHEN label = 'desk' THEN 'table' END AS label_family FROM lab),
 l1 AS (SELECT object_id, label FROM (SELECT object_id, label, ROW_NUMBER() OVER (PARTITION BY object_id ORDER BY COUNT(*) DESC, MIN(local_index)) AS r FROM fam WHERE label IS NOT NULL GROUP BY 1, 2) WHERE r = 1),
 l2 AS (SELECT object_id, label_family FROM (SELECT object_id, label_family, ROW_NUMBER() OVER (PARTITION BY object_id ORDER BY COUNT(*) DESC, MIN(local_index)) AS r FROM fam WHERE label_family IS NOT NULL GROUP BY 1, 2) WHERE r = 1)
 SELECT g.object_id, g.gaussian_count, f.frame_count, f.instance_count, l1.label, l2.label_family FROM (SELECT object_id, COUNT(*) AS gaussian_count FROM assigned WHERE object_id >= 0 GROUP BY 1) g
 LEFT JOIN (SELECT object_id, COUNT(DISTINCT frame_index) AS frame_count, COUNT(*) AS instance_count FROM fam GROUP BY 1) f USING (object_id) LEFT JOIN l1 USING (object_id) LEFT JOIN l2 USING (object_id)""".replace("WITH lab", "SELECT * FROM (WITH lab", 1) + ")", "assigned", "objects")
def _(s):
    obj = _labelled(s)
    return voting.proposals(voting.assign_objects(s.votes, obj, s.points), s.points, s.votes, obj).select(
        "object_id", "gaussian_count", "frame_count", "instance_count", "label", "label_family"
    )


@query("r3_top_proposals", """SELECT object_id, gaussian_count, frame_count, rank FROM (SELECT g.object_id, g.gaussian_count, f.frame_count, ROW_NUMBER() OVER (ORDER BY g.gaussian_count DESC, f.frame_count DESC, g.object_id) AS rank FROM
 (SELECT object_id, COUNT(*) AS gaussian_count FROM assigned WHERE object_id >= 0 GROUP BY 1) g JOIN (SELECT object_id, COUNT(DISTINCT frame_index) AS frame_count FROM objects GROUP BY 1) f USING (object_id) WHERE g.gaussian_count >= 3 AND f.frame_count >= 2) WHERE rank <= 10""", "assigned", "objects")
def _(s):
    obj = _labelled(s)
    return voting.top_proposals(
        voting.proposals(voting.assign_objects(s.votes, obj, s.points), s.points, s.votes, obj), 10, 3, 2
    ).select("object_id", "gaussian_count", "frame_count", "rank")


@query("k5_vote_summary", """SELECT (SELECT COUNT(*) FROM (SELECT DISTINCT frame_index, instance_id FROM votes)) AS instance_count, COUNT(DISTINCT gaussian_index) AS covered_count, COUNT(*) AS vote_count,
 ROUND(COUNT(DISTINCT gaussian_index) / (SELECT COUNT(*) FROM points), 6) AS coverage_ratio FROM votes""", "votes", "points")
def _(s):
    return voting.vote_summary(s.votes, s.points).withColumn("coverage_ratio", _round("coverage_ratio"))


@query(
    "a2_category_votes",
    "SELECT gaussian_index, instance_id % 5 AS category, SUM(weight) AS weight, COUNT(*) AS support FROM votes GROUP BY ALL", "votes"
)
def _(s):
    cats = s.votes.select("frame_index", "instance_id").distinct().withColumn("category", F.col("instance_id") % 5)
    return voting.category_votes(s.votes, cats)


@query("w7_best_category", """SELECT gaussian_index, category, weight, support FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY gaussian_index ORDER BY weight DESC, category) AS r FROM
 (SELECT gaussian_index, instance_id % 5 AS category, SUM(weight) AS weight, COUNT(*) AS support FROM votes GROUP BY ALL)) WHERE r = 1 AND weight >= 0.5 AND support >= 2""", "votes")
def _(s):
    cats = s.votes.select("frame_index", "instance_id").distinct().withColumn("category", F.col("instance_id") % 5)
    return spatial.best_category(voting.category_votes(s.votes, cats))


@query("f11_select_groups", """SELECT object_id, n FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY n DESC, object_id) AS r2 FROM (SELECT object_id, n, ROW_NUMBER() OVER (ORDER BY n DESC, object_id) AS r FROM
 (SELECT gt AS object_id, COUNT(*) AS n FROM ids WHERE gt >= 0 GROUP BY 1)) WHERE r > 2 AND n >= 5 AND object_id NOT IN (3, 4)) WHERE r2 <= 6""", "ids")
def _(s):
    sizes = s.ids.where("gt >= 0").groupBy(F.col("gt").alias("object_id")).agg(F.count("*").alias("n"))
    return voting.select_groups(sizes, skip_largest=2, min_size=5, exclude=[3, 4], top_k=6)


@query(
    "a22_object_support", "SELECT object_id, SUM(support_size) AS support, COUNT(DISTINCT frame_index) AS frames FROM objects GROUP BY 1",
    "objects"
)
def _(s):
    return _objects(s).groupBy("object_id").agg(F.sum("support_size").alias("support"), F.count_distinct("frame_index").alias("frames"))


_TRACKS = "SELECT DISTINCT instance_id + 8 * (frame_index % 6) AS mask_index, instance_id % 3 AS category, gaussian_index AS point3d_id FROM votes"


@query(
    "j5_mask_pairs",
    f"""SELECT a.mask_index AS lhs, b.mask_index AS rhs, COUNT(*) AS shared FROM ({_TRACKS}) a JOIN ({_TRACKS}) b ON a.category = b.category AND a.point3d_id = b.point3d_id AND a.mask_index < b.mask_index GROUP BY ALL""",
    "votes"
)
def _(s):
    return voting.mask_pairs(_tracks(s))


def _tracks(s: A.Scene) -> DataFrame:
    return s.votes.select(
        (F.col("instance_id") + 8 * (F.col("frame_index") % 6)).alias("mask_index"), (F.col("instance_id") % 3).alias("category"),
        F.col("gaussian_index").alias("point3d_id")
    ).distinct()


@query("g3_track_groups", f"""SELECT * FROM (WITH RECURSIVE t AS ({_TRACKS}), size AS (SELECT mask_index, category, COUNT(*) AS support FROM t GROUP BY ALL),
 e AS (SELECT lhs, rhs FROM (SELECT a.mask_index AS lhs, b.mask_index AS rhs, COUNT(*) AS shared FROM t a JOIN t b ON a.category = b.category AND a.point3d_id = b.point3d_id AND a.mask_index < b.mask_index GROUP BY ALL) p
  JOIN size x ON x.mask_index = p.lhs JOIN size y ON y.mask_index = p.rhs WHERE shared >= 4 AND shared / LEAST(x.support, y.support) >= 0.2),
 r AS (SELECT mask_index AS node, mask_index AS other FROM size UNION SELECT r.node, CASE WHEN e.lhs = r.other THEN e.rhs ELSE e.lhs END FROM r JOIN e ON e.lhs = r.other OR e.rhs = r.other),
 c AS (SELECT node, MIN(other) AS root FROM r GROUP BY 1), g AS (SELECT root, COUNT(*) AS masks, SUM(support) AS total, MIN(mask_index) AS first FROM size JOIN c ON c.node = size.mask_index GROUP BY 1 HAVING COUNT(*) >= 2),
 n AS (SELECT root, ROW_NUMBER() OVER (ORDER BY masks DESC, total DESC, first) - 1 AS group_id FROM g)
 SELECT s.mask_index, s.category, COALESCE(n.group_id, -1) AS group_id FROM size s JOIN c ON c.node = s.mask_index LEFT JOIN n USING (root))""", "votes")
def _(s):
    return voting.track_groups(_tracks(s), min_shared=4, min_ratio=0.2, min_masks=2)


# Projection and visibility


@query(
    "p5_projection",
    "SELECT frame_index, gaussian_index, u, v, depth, CASE WHEN px < 100 AND py < 100 THEN px END AS px, CASE WHEN px < 100 AND py < 100 THEN py END AS py FROM proj",
    "proj"
)
def _(s):
    return _projected(s).select("frame_index", "gaussian_index", "u", "v", "depth", "px", "py")


@query("p3_fisheye", """SELECT gaussian_index, ROUND(100 * xx * s + 50, 4) AS u, ROUND(100 * yy * s + 50, 4) AS v FROM (SELECT *, CASE WHEN r > 1e-8 THEN th * (1 + 0.1 * th * th + 0.01 * th * th * th * th) / r ELSE 1 END AS s FROM
 (SELECT *, ATAN(r) AS th FROM (SELECT *, SQRT(xx * xx + yy * yy) AS r FROM (SELECT gaussian_index, x / z AS xx, y / z AS yy FROM points))))""", "points")
def _(s):
    u, v = G.project((F.col("x"), F.col("y"), F.col("z")), "OPENCV_FISHEYE", 100, 100, 50, 50, (0.1, 0.01))
    return s.points.select("gaussian_index", _round(u, 4).alias("u"), _round(v, 4).alias("v"))


@query("p4_radial", """SELECT gaussian_index, ROUND(100 * (xx * rad + 0.001 * 2 * xx * yy + 0.002 * (r2 + 2 * xx * xx)) + 50, 4) AS u, ROUND(100 * (yy * rad + 0.001 * (r2 + 2 * yy * yy) + 0.002 * 2 * xx * yy) + 50, 4) AS v FROM
 (SELECT *, (1 + 0.1 * r2 + 0.02 * r2 * r2 + 0.003 * r2 * r2 * r2) / (1 + 0.01 * r2) AS rad FROM (SELECT *, xx * xx + yy * yy AS r2 FROM (SELECT gaussian_index, x / z AS xx, y / z AS yy FROM points)))""", "points")
def _(s):
    u, v = G.project((F.col("x"), F.col("y"), F.col("z")), "OPENCV", 100, 100, 50, 50, (0.1, 0.02, 0.001, 0.002, 0.003, 0.01))
    return s.points.select("gaussian_index", _round(u, 4).alias("u"), _round(v, 4).alias("v"))


@query(
    "w1_front_surface",
    "SELECT p.frame_index, p.gaussian_index FROM proj p JOIN front f USING (frame_index, px, py) WHERE p.depth <= f.front + CAST(0.5 AS FLOAT)",
    "front"
)
def _(s):
    return visibility.front_surface(_projected(s), 0.5).select("frame_index", "gaussian_index")


@query("w2_front_depth", "SELECT frame_index, px, py, front FROM front", "front")
def _(s):
    return visibility.front_depth(_projected(s))


@query(
    "w3_front_visible",
    "SELECT p.frame_index, p.gaussian_index FROM proj p JOIN front f USING (frame_index, px, py) WHERE p.depth <= f.front + GREATEST(0.25, ABS(CAST(f.front AS DOUBLE)) * 0.125)",
    "front"
)
def _(s):
    p = _projected(s)
    return visibility.front_visible(p, p, margin_ratio=0.125, min_margin=0.25).select("frame_index", "gaussian_index")


@query(
    "w4_front_samples",
    "SELECT frame_index, px, py, gaussian_index FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY frame_index, px, py ORDER BY depth, gaussian_index) AS r FROM proj WHERE px < 100 AND py < 100) WHERE r = 1",
    "proj"
)
def _(s):
    return visibility.front_samples(_projected(s)).select("frame_index", "px", "py", "gaussian_index")


@query(
    "w6_behind_surface",
    """SELECT p.frame_index, p.gaussian_index, CAST(p.depth AS DOUBLE) > d.d + GREATEST(0.05, d.d * 0.25) AS behind FROM proj p JOIN depth_map d USING (frame_index, px, py)""",
    "proj", "depth_map"
)
def _(s):
    fits = s.frames.select("frame_index", F.lit(1.0).alias("scale"), F.lit(0.0).alias("shift"))
    return visibility.depth_behind(
        _projected(s), s.depth, fits, ratio=0.25, min_margin=0.05
    ).select("frame_index", "gaussian_index", "behind")


@query("f13_depth_outliers", """SELECT gaussian_index, observed, behind_count, ROUND(behind_count / observed, 6) AS behind_ratio FROM (SELECT gaussian_index, COUNT(*) AS observed, COUNT(*) FILTER (WHERE behind) AS behind_count FROM
 (SELECT p.gaussian_index, CAST(p.depth AS DOUBLE) > d.d + GREATEST(0.05, d.d * 0.25) AS behind FROM proj p JOIN depth_map d USING (frame_index, px, py)) GROUP BY 1) WHERE observed >= 3 AND behind_count / observed >= 0.6""", "proj", "depth_map")
def _(s):
    fits = s.frames.select("frame_index", F.lit(1.0).alias("scale"), F.lit(0.0).alias("shift"))
    return visibility.depth_outliers(
        visibility.depth_behind(_projected(s), s.depth, fits, ratio=0.25, min_margin=0.05)
    ).withColumn("behind_ratio", _round("behind_ratio"))


def _fit_sql(rounded: bool = True) -> str:
    """Four rounds of trimmed least squares, unrolled."""
    ctes = [
        "b0 AS (SELECT p.frame_index, d.d AS x, CAST(p.depth AS DOUBLE) AS y, TRUE AS keep FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY frame_index, px, py ORDER BY depth, gaussian_index) AS r FROM proj WHERE px < 100 AND py < 100) p JOIN depth_map d USING (frame_index, px, py) WHERE r = 1)"
    ]
    for i in range(4):
        ctes.append(
            f"f{i} AS (SELECT frame_index, COUNT(*) AS n, REGR_SLOPE(y, x) FILTER (WHERE keep) AS s, REGR_INTERCEPT(y, x) FILTER (WHERE keep) AS t FROM b{i} GROUP BY 1)"
        )
        ctes.append(
            f"e{i} AS (SELECT b.frame_index, x, y, f.s, f.t, f.n, ABS(f.s * x + f.t - y) AS res FROM b{i} b JOIN f{i} f USING (frame_index))"
        )
        ctes.append(f"q{i} AS (SELECT frame_index, QUANTILE_CONT(res, 0.8) AS q, MEDIAN(res) AS m FROM e{i} GROUP BY 1)")
        ctes.append(f"b{i + 1} AS (SELECT e.frame_index, x, y, res <= q AS keep FROM e{i} e JOIN q{i} USING (frame_index))")
    if not rounded:
        return f"WITH {', '.join(ctes)} SELECT frame_index, n, s, t FROM f3"
    return f"SELECT * FROM (WITH {', '.join(ctes)} SELECT frame_index, ROUND(CASE WHEN n < 32 THEN 1 ELSE s END, 5) AS scale, ROUND(CASE WHEN n < 32 THEN 0 ELSE t END, 5) AS shift FROM f3)"


@query("a33_affine_fit", _fit_sql(), "proj", "depth_map")
def _(s):
    front = visibility.front_samples(_projected(s)).join(s.depth, ["frame_index", "px", "py"]).select(
        "frame_index", F.col("d").alias("predicted"), F.col("depth").alias("target")
    )
    return visibility.affine_fit(front).select("frame_index", _round("scale", 5).alias("scale"), _round("shift", 5).alias("shift"))


@query("w5_depth_consistent", f"""SELECT frame_index, gaussian_index FROM (SELECT p.frame_index, p.gaussian_index, CAST(p.depth AS DOUBLE) AS depth, f.scale * d.d + f.shift AS aligned FROM proj p JOIN depth_map d USING (frame_index, px, py) JOIN
 (SELECT frame_index, CASE WHEN n < 32 THEN 1 ELSE s END AS scale, CASE WHEN n < 32 THEN 0 ELSE t END AS shift FROM ({_fit_sql(rounded=False)})) f USING (frame_index)) WHERE NOT depth > aligned + GREATEST(0.05, ABS(aligned) * 0.18)""", "proj", "depth_map")
def _(s):
    return visibility.depth_consistent(_projected(s), s.depth).select("frame_index", "gaussian_index")


@query(
    "a9_visible_counts",
    "SELECT p.gaussian_index, COUNT(q.frame_index) AS visible, (SELECT COUNT(*) FROM frames) AS in_front FROM points p LEFT JOIN proj q USING (gaussian_index) GROUP BY 1",
    "proj"
)
def _(s):
    return visibility.visible_counts(visibility.project_points(s.points, s.frames, A.CAMERA, valid_only=False), s.points)


@query(
    "j11_camera_distance",
    "SELECT gaussian_index, ROUND(MIN(SQRT((x + t0) * (x + t0) + (y + t1) * (y + t1) + z * z)), 6) AS camera_distance FROM points CROSS JOIN frames GROUP BY 1",
    "points", "frames"
)
def _(s):
    return visibility.camera_distance(s.points, s.frames).withColumn("camera_distance", _round("camera_distance"))


@query("w10_best_frame", """SELECT object_id, frame_index, n AS visible FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY object_id ORDER BY n DESC, frame_index) AS r FROM (SELECT o.object_id, f.frame_index, COUNT(p.gaussian_index) AS n FROM
 (SELECT DISTINCT gaussian_index % 30 AS object_id FROM points) o CROSS JOIN frames f LEFT JOIN proj p ON p.frame_index = f.frame_index AND p.gaussian_index % 30 = o.object_id GROUP BY 1, 2)) WHERE r = 1""", "proj")
def _(s):
    return visibility.best_frame(
        _projected(s), s.points.select("gaussian_index", (F.col("gaussian_index") % 30).alias("object_id")), s.frames
    )


@query("j2_mask_hits", "SELECT * FROM hits", "hits")
def _(s):
    return visibility.mask_hits(_projected(s), s.mask_pixels)


@query(
    "j3_frame_votes",
    """SELECT h.frame_index, h.instance_id, h.gaussian_index, ROUND(CAST(i.score / (1 + EXP(-p.opacity)) AS FLOAT), 4) AS weight FROM hits h JOIN instances i USING (frame_index, instance_id) JOIN points p USING (gaussian_index)""",
    "hits", "instances", "points"
)
def _(s):
    alpha = s.points.select("gaussian_index", C.sigmoid("opacity").alias("alpha"))
    return visibility.mask_votes(_projected(s), s.mask_pixels, s.instances, opacity=alpha).withColumn("weight", _round("weight", 4))


@query(
    "j19_background_support",
    "SELECT gaussian_index, COUNT(*) AS background FROM (SELECT p.frame_index, p.gaussian_index FROM proj p WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.frame_index = p.frame_index AND h.gaussian_index = p.gaussian_index)) GROUP BY 1",
    "hits"
)
def _(s):
    p = _projected(s)
    return visibility.background_support(p, visibility.covered(p, s.mask_pixels))


# Space


@query("p10_voxel_keys", "SELECT gaussian_index, vx, vy, vz FROM vox", "vox")
def _(s):
    return spatial.voxels_of(s.cloud, 0.1).select("gaussian_index", "vx", "vy", "vz")


@query(
    "j8_isolated",
    "SELECT a.gaussian_index, COUNT(*) AS neighbours, COUNT(*) < 3 AS isolated FROM vox a JOIN vox b ON ABS(a.vx - b.vx) <= 1 AND ABS(a.vy - b.vy) <= 1 AND ABS(a.vz - b.vz) <= 1 GROUP BY 1",
    "vox"
)
def _(s):
    return spatial.isolated(s.cloud, 0.1, 3)


_COMPONENTS = """v AS (SELECT vx, vy, vz, COUNT(*) AS n FROM vox GROUP BY ALL HAVING COUNT(*) >= 2), r AS (SELECT vx, vy, vz, vx AS wx, vy AS wy, vz AS wz FROM v UNION
 SELECT r.vx, r.vy, r.vz, v.vx, v.vy, v.vz FROM r JOIN v ON ABS(r.wx - v.vx) <= 1 AND ABS(r.wy - v.vy) <= 1 AND ABS(r.wz - v.vz) <= 1),
 c AS (SELECT vx, vy, vz, MIN(CAST(wx + 1000 AS BIGINT) * 100000000 + (wy + 1000) * 10000 + wz + 1000) AS root FROM r GROUP BY ALL),
 comp AS (SELECT x.gaussian_index, COALESCE(d.id, -1) AS component FROM vox x LEFT JOIN (SELECT vx, vy, vz, DENSE_RANK() OVER (ORDER BY root) - 1 AS id FROM c) d USING (vx, vy, vz))"""


@query("g2_point_components", f"SELECT * FROM (WITH RECURSIVE {_COMPONENTS} SELECT gaussian_index, component FROM comp)", "vox")
def _(s):
    return spatial.point_components(s.cloud, 0.1, min_voxel_count=2)


_RANKED = f"""WITH RECURSIVE {_COMPONENTS}, k AS (SELECT component, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, component) - 1 AS rank FROM comp WHERE component >= 0 GROUP BY 1 HAVING COUNT(*) >= 3)"""


@query(
    "a13_ranked_components",
    f"SELECT * FROM ({_RANKED} SELECT gaussian_index, comp.component, COALESCE(rank, -1) AS rank FROM comp LEFT JOIN k USING (component))",
    "vox"
)
def _(s):
    return spatial.rank_components(
        spatial.point_components(s.cloud, 0.1, min_voxel_count=2), min_points=3
    ).select("gaussian_index", "component", "rank")


_SUMMARY = "COUNT(*) AS gaussian_count, COUNT(DISTINCT CAST(vx + 1000 AS BIGINT) * 100000000 + (vy + 1000) * 10000 + vz) AS voxel_count, ROUND(AVG(CAST(x AS DOUBLE)), 6) AS centroid_x, MIN(x) AS min_x, MAX(z) AS max_z, ROUND(SQRT(POW(CAST(MAX(x) AS DOUBLE) - CAST(MIN(x) AS DOUBLE), 2) + POW(CAST(MAX(y) AS DOUBLE) - CAST(MIN(y) AS DOUBLE), 2) + POW(CAST(MAX(z) AS DOUBLE) - CAST(MIN(z) AS DOUBLE), 2)), 6) AS bbox_diag"


@query("a5_cluster_summary", f"SELECT label AS component, {_SUMMARY} FROM vox GROUP BY 1", "vox")
def _(s):
    out = spatial.cluster_summary(s.cloud.select("gaussian_index", F.col("label").alias("component")), s.cloud, 0.1)
    return out.select(
        "component", "gaussian_count", "voxel_count", _round("centroid_x").alias("centroid_x"), "min_x", "max_z",
        _round("bbox_diag").alias("bbox_diag")
    )


@query(
    "f16_diagonal_cutoff",
    "SELECT gaussian_index, CASE WHEN d > 1.1 THEN -1 ELSE label END AS component FROM vox JOIN (SELECT label, SQRT(POW(CAST(MAX(x) AS DOUBLE) - MIN(x), 2) + POW(CAST(MAX(y) AS DOUBLE) - MIN(y), 2) + POW(CAST(MAX(z) AS DOUBLE) - MIN(z), 2)) AS d FROM vox GROUP BY 1) USING (label)",
    "vox"
)
def _(s):
    ids = s.cloud.select("gaussian_index", F.col("label").alias("component"))
    return spatial.within_diagonal(ids, spatial.cluster_summary(ids, s.cloud, 0.1), 1.1).select("gaussian_index", "component")


_BY_LABEL = """v AS (SELECT label, vx, vy, vz, COUNT(*) AS n FROM vox GROUP BY ALL), r AS (SELECT label, vx, vy, vz, vx AS wx, vy AS wy, vz AS wz FROM v UNION
 SELECT r.label, r.vx, r.vy, r.vz, v.vx, v.vy, v.vz FROM r JOIN v ON r.label = v.label AND ABS(r.wx - v.vx) <= 1 AND ABS(r.wy - v.vy) <= 1 AND ABS(r.wz - v.vz) <= 1),
 c AS (SELECT label, vx, vy, vz, MIN(CAST(wx + 1000 AS BIGINT) * 100000000 + (wy + 1000) * 10000 + wz + 1000) AS root FROM r GROUP BY ALL),
 p AS (SELECT x.gaussian_index, x.label, c.root FROM vox x JOIN c USING (label, vx, vy, vz)),
 k AS (SELECT label, root, ROW_NUMBER() OVER (PARTITION BY label ORDER BY COUNT(*) DESC, root) - 1 AS rank FROM p GROUP BY 1, 2 HAVING COUNT(*) >= 2),
 n AS (SELECT label, root, ROW_NUMBER() OVER (ORDER BY label, rank) - 1 AS instance_id FROM k WHERE rank < 3)"""


@query(
    "g4_category_instances",
    f"SELECT * FROM (WITH RECURSIVE {_BY_LABEL} SELECT x.gaussian_index, CASE WHEN n.instance_id IS NULL THEN NULL ELSE x.label END AS category, COALESCE(n.instance_id, -1) AS instance_id FROM p x LEFT JOIN n USING (label, root))",
    "vox"
)
def _(s):
    return spatial.category_instances(
        s.cloud.select("gaussian_index", F.col("label").alias("category")), s.cloud, 0.1, min_points=2, top_k=3
    )


@query(
    "g5_identity_instances",
    f"SELECT * FROM (WITH RECURSIVE {_BY_LABEL} SELECT n.instance_id, COUNT(*) AS gaussian_count FROM p x JOIN n USING (label, root) GROUP BY 1)",
    "vox"
)
def _(s):
    best = s.cloud.select("gaussian_index", F.col("label").alias("class_index"))
    named = spatial.category_instances(best, s.cloud, 0.1, min_points=2, top_k=3, key="class_index")
    return spatial.instance_stats(named, []).select("instance_id", "gaussian_count")


@query(
    "a17_instance_stats",
    "SELECT label AS instance_id, COUNT(*) AS gaussian_count, ROUND(SUM(CAST(x AS DOUBLE)), 4) AS v_sum, ROUND(AVG(CAST(x AS DOUBLE)), 6) AS v_mean, CAST(MIN(x) AS DOUBLE) AS v_min, CAST(MAX(x) AS DOUBLE) AS v_max FROM cloud GROUP BY 1",
    "cloud"
)
def _(s):
    out = spatial.instance_stats(
        s.cloud.select("gaussian_index", F.col("label").alias("instance_id"), F.col("x").cast("double").alias("v")), ["v"]
    )
    return out.withColumns({"v_sum": _round("v_sum", 4), "v_mean": _round("v_mean")})


_IN_BOX = """SELECT p.gaussian_index, b.object_id, b.ex * b.ey * b.ez AS volume FROM points p JOIN boxes b ON (p.x - ox) / ex BETWEEN -1e-4 AND 1 + 1e-4 AND (p.z - oz) / ez BETWEEN -1e-4 AND 1 + 1e-4
 AND ((p.y - oy) - skew * (p.x - ox) / ex) / ey BETWEEN -1e-4 AND 1 + 1e-4"""


@query("j9_points_in_boxes", f"SELECT gaussian_index, object_id FROM ({_IN_BOX})", "points", "boxes")
def _(s):
    return spatial.points_in_boxes(s.points, spatial.box_frames(s.box_corners)).select("gaussian_index", "object_id")


@query(
    "j10_assign_boxes",
    f"SELECT p.gaussian_index, COALESCE(b.object_id, -1) AS object_id FROM points p LEFT JOIN (SELECT gaussian_index, object_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY gaussian_index ORDER BY volume, object_id) AS r FROM ({_IN_BOX})) WHERE r = 1) b USING (gaussian_index)",
    "points", "boxes"
)
def _(s):
    return spatial.assign_boxes(s.points, spatial.box_frames(s.box_corners))


@query("j16_nearest", """SELECT i, j, rank, ROUND(distance, 6) AS distance FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY i ORDER BY distance, j) AS rank FROM (SELECT a.gaussian_index AS i, b.gaussian_index AS j,
 SQRT(POW(CAST(a.x AS DOUBLE) - CAST(b.x AS DOUBLE), 2) + POW(CAST(a.y AS DOUBLE) - CAST(b.y AS DOUBLE), 2) + POW(CAST(a.z AS DOUBLE) - CAST(b.z AS DOUBLE), 2)) AS distance FROM cloud a JOIN cloud b ON a.gaussian_index <> b.gaussian_index)) WHERE rank <= 3""", "cloud")
def _(s):
    return spatial.nearest(s.cloud, 3, sample=None).withColumn("distance", _round("distance"))


# Quality


_SIZE = "SQRT(EXP(2 * scale_0) + EXP(2 * scale_1) + EXP(2 * scale_2))"
_MEASURED = f"""m AS (SELECT *, {_SIZE} AS size, SQRT(POW(x - (SELECT MEDIAN(x) FROM points), 2) + POW(y - (SELECT MEDIAN(y) FROM points), 2) + POW(z - (SELECT MEDIAN(z) FROM points), 2)) AS radius,
 CAST(FLOOR(CAST(x AS FLOAT) / CAST(0.5 AS FLOAT)) AS INT) AS vx, CAST(FLOOR(CAST(y AS FLOAT) / CAST(0.5 AS FLOAT)) AS INT) AS vy, CAST(FLOOR(CAST(z AS FLOAT) / CAST(0.5 AS FLOAT)) AS INT) AS vz FROM points),
 g AS (SELECT vx, vy, vz, COUNT(*) AS n FROM m GROUP BY ALL), lone AS (SELECT a.vx, a.vy, a.vz, SUM(b.n) < 2 AS isolated FROM g a JOIN g b ON ABS(a.vx - b.vx) <= 1 AND ABS(a.vy - b.vy) <= 1 AND ABS(a.vz - b.vz) <= 1 GROUP BY ALL),
 t AS (SELECT m.*, lone.isolated, (SELECT QUANTILE_CONT(size, 0.9) FROM m) AS sc, (SELECT QUANTILE_CONT(radius, 0.9) FROM m) AS rc FROM m JOIN lone USING (vx, vy, vz))"""
# The size cutoff lies on equal values, which two engines may round apart by a bit; both compare after rounding.


@query(
    "f8_prune_mask",
    f"SELECT * FROM (WITH {_MEASURED} SELECT gaussian_index, opacity >= -5 AND radius <= rc AND NOT isolated AS keep FROM t)", "points"
)
def _(s):
    return quality.prune_mask(s.points, quality.PruneSpec(radius_percentile=90, voxel_size=0.5, radius_outlier=True, extreme_scale=False))


@query("a8_quality_scores", f"""SELECT * FROM (WITH {_MEASURED} SELECT gaussian_index, ROUND(LEAST(GREATEST((1 / (1 + EXP(-opacity)) - 0.05) / 0.95, 0), 1) * CASE WHEN isolated THEN 0.2 ELSE 1 END * CASE WHEN radius > rc THEN 0.5 ELSE 1 END, 6) AS quality,
 1 / (1 + EXP(-opacity)) < 0.05 AS low_opacity, isolated, radius > rc AS radius_outlier FROM t)""", "points")
def _(s):
    spec = quality.QualitySpec(radius_percentile=90, scale_percentile=100, voxel_size=0.5)
    return quality.quality_scores(s.points, spec).select(
        "gaussian_index", _round("quality").alias("quality"), "low_opacity", "isolated", "radius_outlier"
    )


@query(
    "a7_noise_report",
    f"SELECT * FROM (WITH {_MEASURED} SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE opacity < -5) AS low_opacity, COUNT(*) FILTER (WHERE isolated) AS isolated, ROUND(QUANTILE_CONT(opacity, 0.5), 6) AS opacity_p50, ROUND(QUANTILE_CONT(opacity, 0.9), 6) AS opacity_p90, ROUND(QUANTILE_CONT(size, 0.99), 6) AS size_p99 FROM t)",
    "points"
)
def _(s):
    out = quality.noise_report(s.points, voxel_size=0.5)
    return out.select("total", "low_opacity", "isolated", *[_round(c).alias(c) for c in ("opacity_p50", "opacity_p90", "size_p99")])


@query(
    "a6_percentiles",
    "SELECT ROUND(QUANTILE_CONT(x, 0.5), 6) AS p50, ROUND(QUANTILE_CONT(x, 0.9), 6) AS p90, ROUND(QUANTILE_CONT(x, 0.995), 6) AS p99_5 FROM (SELECT CAST(x AS DOUBLE) AS x FROM cloud)",
    "cloud"
)
def _(s):
    q = quality.quantiles(s.cloud.withColumn("x", F.col("x").cast("double")), "x", (50, 90, 99.5))
    return q.select(*[_round(c).alias(c) for c in q.columns])


@query(
    "a10_inferred_voxel",
    f"""SELECT ROUND(GREATEST(SQRT(POW(MAX(x) - MIN(x), 2) + POW(MAX(y) - MIN(y), 2) + POW(MAX(z) - MIN(z), 2)) / 256, 4 * (SELECT MEDIAN(s) FROM (SELECT EXP(scale_0) AS s FROM points UNION ALL SELECT EXP(scale_1) FROM points UNION ALL SELECT EXP(scale_2) FROM points)), 0.001), 6) AS voxel_size FROM points""",
    "points"
)
def _(s):
    return s.spark.createDataFrame(
        [(quality.inferred_voxel(s.points),)], "voxel_size double"
    ).select(_round("voxel_size").alias("voxel_size"))


@query("f9_finite_visible", "SELECT gaussian_index FROM points WHERE opacity >= -5.5373", "points")
def _(s):
    return quality.finite_and_visible(s.points, ["x", "y", "z", "opacity", "scale_0"]).select("gaussian_index")


@query(
    "f9_finite_counts",
    "SELECT COUNT(*) AS total, 0 AS non_finite, COUNT(*) FILTER (WHERE opacity < -5.5373) AS low_opacity, COUNT(*) FILTER (WHERE opacity >= -5.5373) AS kept FROM points",
    "points"
)
def _(s):
    return quality.finite_counts(s.points, ["x", "y", "z", "opacity", "scale_0"]).withColumn("non_finite", F.col("non_finite").cast("int"))


@query("f12_scene_bounds", f"""SELECT * FROM (WITH {_MEASURED}, d AS (SELECT gaussian_index, MIN(SQRT((x + t0) * (x + t0) + (y + t1) * (y + t1) + z * z)) AS cd FROM points CROSS JOIN frames GROUP BY 1), n AS (SELECT gaussian_index, COUNT(*) AS k FROM proj GROUP BY 1),
 j AS (SELECT t.*, d.cd, COALESCE(n.k, 0) AS k FROM t JOIN d USING (gaussian_index) LEFT JOIN n USING (gaussian_index)) SELECT gaussian_index, k < 2 AND (radius > (SELECT QUANTILE_CONT(radius, 0.9) FROM j) OR cd > (SELECT QUANTILE_CONT(cd, 0.9) FROM j)) OR opacity < -5 OR isolated AS removed FROM j)""", "points", "frames", "proj")
def _(s):
    keep = quality.prune_mask(s.points, quality.PruneSpec(voxel_size=0.5, extreme_scale=False))
    counts = visibility.visible_counts(_projected(s), s.points)
    return quality.scene_bounds(
        s.points, counts, visibility.camera_distance(s.points, s.frames), keep, radius_percentile=90, distance_percentile=90
    )


# Evaluation


@query("a12_contingency", "SELECT * FROM contingency", "contingency")
def _(s):
    return evaluation.contingency(s.ids)


@query("m1_iou_pairs", "SELECT gt, pred, n, u AS \"union\", ROUND(iou, 6) AS iou FROM pairs WHERE iou >= 0.01", "pairs")
def _(s):
    return evaluation.iou_pairs(s.ids, 0.01).withColumn("iou", _round("iou"))


@query("m2_greedy_match", "SELECT gt, pred, n FROM matches", "matches")
def _(s):
    return evaluation.greedy_match(evaluation.iou_pairs(s.ids, 0.5)).select("gt", "pred", "n")


@query("a14_group_metrics", """SELECT gg AS gt_groups, pg AS pred_groups, m.k AS matches, ROUND(m.iou, 6) AS mean_iou, m.n AS matched_points, gg - m.k AS unmatched_gt, pg - m.k AS unmatched_pred, ROUND(m.k / gg, 6) AS group_recall, ROUND(m.k / pg, 6) AS group_precision, ROUND(m.n / gp, 6) AS point_recall, ROUND(m.n / pp, 6) AS point_precision
 FROM (SELECT COUNT(DISTINCT gt) FILTER (WHERE gt >= 0) AS gg, COUNT(DISTINCT pred) FILTER (WHERE pred >= 0) AS pg, COUNT(*) FILTER (WHERE gt >= 0) AS gp, COUNT(*) FILTER (WHERE pred >= 0) AS pp FROM ids), (SELECT COUNT(*) AS k, AVG(iou) AS iou, CAST(SUM(n) AS BIGINT) AS n FROM matches) m""", "matches", "ids")
def _(s):
    out = evaluation.metrics(s.ids, evaluation.greedy_match(evaluation.iou_pairs(s.ids, 0.5)))
    return out.withColumns({c: _round(c) for c in ("mean_iou", "group_recall", "group_precision", "point_recall", "point_precision")})


@query(
    "a15_label_metrics",
    "SELECT g.gt % 4 AS label, COUNT(*) AS gt_groups, COUNT(m.iou) AS matched_groups, ROUND(COALESCE(AVG(m.iou), 0), 6) AS mean_iou FROM (SELECT DISTINCT gt FROM ids WHERE gt >= 0) g LEFT JOIN matches m USING (gt) GROUP BY 1",
    "matches", "ids"
)
def _(s):
    labels = s.ids.where("gt >= 0").select("gt").distinct().withColumn("label", F.col("gt") % 4)
    return evaluation.label_metrics(
        labels, evaluation.greedy_match(evaluation.iou_pairs(s.ids, 0.5))
    ).withColumn("mean_iou", _round("mean_iou"))


_CODES = "SELECT i.gaussian_index, CASE WHEN i.gt >= 0 AND i.pred >= 0 THEN CASE WHEN m.n IS NULL THEN 4 ELSE 1 END WHEN i.gt >= 0 THEN 2 WHEN i.pred >= 0 THEN 3 ELSE 0 END AS code FROM ids i LEFT JOIN matches m ON m.gt = i.gt AND m.pred = i.pred"


@query("a16_agreement", _CODES, "matches", "ids")
def _(s):
    return evaluation.agreement(s.ids, evaluation.greedy_match(evaluation.iou_pairs(s.ids, 0.5)))


@query(
    "a16_agreement_counts",
    f"SELECT n.code, n.name, COUNT(c.code) AS n FROM (VALUES (0, 'both_unknown'), (1, 'matched'), (2, 'gt_only'), (3, 'pred_only'), (4, 'mismatched')) n(code, name) LEFT JOIN ({_CODES}) c USING (code) GROUP BY 1, 2",
    "matches", "ids"
)
def _(s):
    return evaluation.agreement_counts(evaluation.agreement(s.ids, evaluation.greedy_match(evaluation.iou_pairs(s.ids, 0.5))))
