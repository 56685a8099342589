"""Registered queries of the scans and sinks: rows go out through a sink, come back through a scan, and must equal plain SQL.

Files are written below the checkpoint folder, which the driver and all executors share; the native formats are read with
plain file calls, so that folder has to be on a mounted path.
"""

from __future__ import annotations

import json
import os
import struct
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import functions as F

from scenelake.functions import color as C
from scenelake.functions import labels as L
from scenelake.operators import evaluation, masks, quality, visibility, voting
from scenelake.operators.ranking import numbered
from scenelake.plans import adapt as A
from scenelake.plans.lineage import few_or_merge, shared_path
from scenelake.plans.scene_queries import _CODES, _labelled, _objects, _round, query
from scenelake.sources import arrays, ply, scenes


def _folder(s: A.Scene, name: str) -> str:
    """A new folder for the query, on a mounted path."""
    at = urlparse(shared_path(s.spark, name))
    if at.scheme not in ("", "file"):
        raise ValueError("native formats need a checkpoint folder on a mounted path")
    os.makedirs(at.path)
    return at.path


# PLY

_PROPERTIES = [("float", "x"), ("double", "y"), ("float", "z"), ("short", "tag"), ("uchar", "red"), ("int", "owner"), ("uint", "serial")]
_ROWS = "SELECT ROW_NUMBER() OVER (ORDER BY gaussian_index) - 1 AS gaussian_index, CAST(x AS FLOAT) AS x, y, CAST(z AS FLOAT) AS z, CAST(gaussian_index % 300 AS SMALLINT) AS tag, CAST(gaussian_index % 256 AS SMALLINT) AS red, CAST(gaussian_index AS INT) AS owner, CAST(4000000000 + gaussian_index AS BIGINT) AS serial FROM points"


def _written(s: A.Scene, properties=_PROPERTIES) -> str:
    i = F.col("gaussian_index")
    table = s.points.select(
        "gaussian_index", "x", "y", "z", (i % 300).cast("short").alias("tag"), (i % 256).cast("short").alias("red"),
        i.cast("int").alias("owner"), (i + 4_000_000_000).alias("serial")
    )
    path = f"{_folder(s, 'ply')}/points.ply"
    ply.write_ply(table, path, properties)
    return path


@query(
    "s1_ply_header",
    "SELECT place, type, name, (SELECT COUNT(*) FROM points) AS vertices FROM (VALUES (0, 'float', 'x'), (1, 'double', 'y'), (2, 'float', 'z'), (3, 'short', 'tag'), (4, 'uchar', 'red'), (5, 'int', 'owner'), (6, 'uint', 'serial')) t(place, type, name)",
    "points"
)
def _(s):
    head = ply.read_header(_written(s))
    return s.spark.createDataFrame(
        [(i, t, n, head.count) for i, (t, n) in enumerate(head.properties)], "place int, type string, name string, vertices long"
    )


@query("s2_ply_scan", _ROWS, "points")
def _(s):
    return ply.read_ply(s.spark, _written(s), rows=500)


@query(
    "s3_ply_cloud",
    "SELECT ROW_NUMBER() OVER (ORDER BY gaussian_index) - 1 AS gaussian_index, CAST(x AS FLOAT) AS x, CAST(y AS FLOAT) AS y, CAST(z AS FLOAT) AS z, CAST(NULL AS FLOAT) AS opacity, CAST(NULL AS FLOAT) AS scale_0 FROM points",
    "points"
)
def _(s):
    return ply.cloud(ply.read_ply(s.spark, _written(s), whole=True)).select("gaussian_index", "x", "y", "z", "opacity", "scale_0")


@query(
    "k1_ply_table",
    f"SELECT ROW_NUMBER() OVER (ORDER BY gaussian_index) - 1 AS gaussian_index, x, y, z, tag, red, owner, serial FROM ({_ROWS}) WHERE owner % 2 = 0",
    "points"
)
def _(s):
    """Half of a file's rows written again with its own header types, in row order."""
    path = _written(s)
    head, kept = ply.read_header(path), ply.read_ply(s.spark, path).where("owner % 2 = 0")
    again = f"{_folder(s, 'ply')}/kept.ply"
    ply.write_ply(kept.orderBy(F.desc("gaussian_index")), again, list(head.properties))
    return ply.read_ply(s.spark, again)


@query(
    "k2_ply_tensors",
    "SELECT place, type, name FROM (VALUES (0, 'float', 'x'), (1, 'uchar', 'red'), (2, 'uchar', 'green'), (3, 'double', 'opacity')) t(place, type, name)"
)
def _(s):
    """Colours go out as bytes, the rest in the type of the column."""
    table = s.points.select(
        "gaussian_index", F.col("x").cast("float").alias("x"), C.sh_to_byte("f_dc_0").alias("red"), C.sh_to_byte("f_dc_1").alias("green"),
        "opacity"
    )
    path = f"{_folder(s, 'ply')}/colours.ply"
    ply.write_ply(table, path)
    return s.spark.createDataFrame([(i, *p) for i, p in enumerate(ply.read_header(path).properties)], "place int, type string, name string")


@query(
    "k3_ply_text",
    "SELECT printf('%.6f %.6f %.6f %d %d %d', x, y, z, gaussian_index % 256, gaussian_index % 7, 9) AS line FROM points UNION ALL SELECT 'element vertex ' || COUNT(*) FROM points",
    "points"
)
def _(s):
    path = f"{_folder(s, 'ply')}/points.ply"
    i = F.col("gaussian_index")
    ply.write_ascii(
        s.points.select("gaussian_index", "x", "y", "z", (i % 256).alias("red"), (i % 7).alias("green"), F.lit(9).alias("blue")), path
    )
    return s.spark.read.text(f"file://{path}").select(F.col("value").alias("line")).where("line rlike '^[-0-9]|^element'")


# Side files


@query(
    "s9_npy_sidecar",
    "SELECT ROW_NUMBER() OVER (ORDER BY gaussian_index) - 1 AS gaussian_index, CAST(gaussian_index % 5 - 1 AS INT) AS object_id FROM points",
    "points"
)
def _(s):
    path = f"{_folder(s, 'npy')}/ids.npy"
    arrays.write_npy(s.points.select("gaussian_index", (F.col("gaussian_index") % 5 - 1).alias("v")), path, "v")
    return arrays.read_npy(s.spark, path, "object_id")


@query(
    "j12_sidecar_join",
    "SELECT row AS gaussian_index, CAST(x AS FLOAT) AS x, CAST(f_dc_0 AS FLOAT) AS quality FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY gaussian_index) - 1 AS row FROM points) WHERE f_dc_0 >= 0.5",
    "points"
)
def _(s):
    """A quality file beside a point file, joined on the row number."""
    path = f"{_folder(s, 'npy')}/quality.npy"
    arrays.write_npy(s.points, path, "f_dc_0", dtype="<f4")
    points = ply.read_ply(s.spark, _written(s)).select("gaussian_index", "x")
    return points.join(arrays.read_npy(s.spark, path, "quality"), "gaussian_index").where("quality >= 0.5")


@query(
    "s8_votes_npz",
    "SELECT CAST(f AS INT) AS frame_index, CAST(i AS INT) AS instance_id, CAST(g AS BIGINT) AS gaussian_index, CAST(w AS FLOAT) AS weight FROM (VALUES (0, 0, 2, 0.5), (0, 0, 2, 0.25), (0, 0, 3, 1), (1, 1, 3, 1.5)) t(f, i, g, w)"
)
def _(s):
    path = f"{_folder(s, 'npz')}/votes.npz"
    np.savez(
        path, frame_indices=np.array([0, 0, 0, 1]), instance_ids=np.array([0, 0, 0, 1]), gaussian_indices=np.array([2, 2, 3, 3]),
        weights=np.array([0.5, 0.25, 1, 1.5], np.float32)
    )
    return arrays.read_votes(s.spark, f"file://{path}")


@query("k4_votes_sink", "SELECT * FROM agg_votes", "agg_votes")
def _(s):
    path = f"file://{_folder(s, 'votes')}/votes"
    voting.aggregate_votes(s.votes).write.parquet(path)
    return arrays.read_votes(s.spark, path)


@query("k6_association_edges", "SELECT lhs, rhs, shared, ROUND(overlap_ratio, 9) AS overlap_ratio FROM edges", "edges")
def _(s):
    path = f"file://{_folder(s, 'edges')}/edges"
    inst = voting.local_instances(s.votes)
    voting.instance_overlap(s.votes, inst, max_frame_gap=1, min_shared=20, min_ratio=0.13).write.parquet(path)
    return arrays.read_edges(s.spark, path).withColumn("overlap_ratio", _round("overlap_ratio", 9))


@query("k6_association_manifest", "SELECT local_index, frame_index, instance_id, support_size, object_id FROM objects", "objects")
def _(s):
    path = f"{_folder(s, 'objects')}/objects.json"
    scenes.write_json(_objects(s), path, "instances", total=1)
    doc = s.spark.read.option("multiLine", True).schema(
        "instances array<struct<local_index:int,frame_index:int,instance_id:int,support_size:int,object_id:int>>, total int"
    ).json(f"file://{path}")
    return doc.where("total = 1").select(F.explode("instances").alias("i")).select("i.*")


# Summaries


@query(
    "k7_group_summary",
    "SELECT o.object_id, g.n AS gaussian_count, f.frames AS frame_count FROM (SELECT DISTINCT object_id FROM objects) o JOIN (SELECT object_id, COUNT(*) AS n FROM assigned WHERE object_id >= 0 GROUP BY 1) g USING (object_id) JOIN (SELECT object_id, COUNT(DISTINCT frame_index) AS frames FROM objects GROUP BY 1) f USING (object_id)",
    "assigned", "objects"
)
def _(s):
    path = f"{_folder(s, 'groups')}/gaussian_groups.json"
    obj = _objects(s)
    out = voting.group_summary(voting.assign_objects(s.votes, obj, s.points), s.points, s.votes, obj)
    triple = lambda p: F.array(*[F.col(f"{p}_{c}").cast("double") for c in "xyz"])
    out = out.select(
        "object_id", "gaussian_count", triple("centroid").alias("centroid_xyz"), triple("min").alias("bbox_min_xyz"),
        triple("max").alias("bbox_max_xyz"), "support_frames", F.col("total_vote_weight").cast("double").alias("total_vote_weight")
    )
    scenes.write_json(out, path, "groups")
    return scenes.read_groups(s.spark, f"file://{path}").select(
        "object_id", "gaussian_count", F.size("support_frames").alias("frame_count")
    )


@query(
    "s14_group_labels",
    "SELECT gt AS object_id, CASE WHEN gt % 3 = 0 THEN NULL ELSE 'label ' || gt END AS label, COUNT(*) AS gaussian_count FROM ids WHERE gt >= 0 GROUP BY gt",
    "ids"
)
def _(s):
    """Groups in either spelling of their id: even ones under the one, odd ones under the other."""
    path = f"{_folder(s, 'groups')}/groups.json"
    g = s.ids.where("gt >= 0").groupBy("gt").agg(F.count("*").alias("gaussian_count"))
    even = F.col("gt") % 2 == 0
    scenes.write_json(
        g.select(
            F.when(even, F.col("gt")).alias("object_id"), F.when(~even, F.col("gt")).alias("global_object_id"),
            F.when(F.col("gt") % 3 != 0, F.concat(F.lit("label "), F.col("gt"))).alias("label"), "gaussian_count"
        ),
        path, "groups"
    )
    return scenes.read_groups(s.spark, f"file://{path}").select("object_id", "label", "gaussian_count")


@query(
    "s15_class_names",
    "SELECT k AS class_index, CASE WHEN n_name IS NULL THEN 'class_' || k ELSE n_name END AS name FROM (SELECT UNNEST(generate_series(0, 29)) AS k) LEFT JOIN (SELECT object_id, label AS n_name FROM boxes WHERE object_id % 2 = 0) ON object_id = k",
    "boxes"
)
def _(s):
    path = f"{_folder(s, 'classes')}/classes.json"
    scenes.write_json(
        s.boxes.where("object_id % 2 = 0").select(F.col("object_id").alias("class_id"), F.col("label").alias("name")), path, "classes"
    )
    return scenes.read_class_names(s.spark, f"file://{path}", 30)


@query(
    "s16_instance_records",
    "SELECT label AS instance_id, 'kind' || label % 3 AS category, COUNT(*) AS gaussian_count, 'kind' || label % 3 || printf('_%02d', label // 3 + 1) AS class_name FROM cloud GROUP BY label",
    "cloud"
)
def _(s):
    path = f"{_folder(s, 'records')}/instances.json"
    c = s.cloud.groupBy(F.col("label").alias("instance_id")).agg(F.count("*").alias("gaussian_count"))
    scenes.write_json(
        c.select(
            "instance_id", F.concat(F.lit("kind"), F.col("instance_id") % 3).alias("category"),
            F.floor(F.col("instance_id") / 3).cast("int").alias("rank_in_category"), "gaussian_count"
        ),
        path, "instances"
    )
    return scenes.read_instance_records(s.spark, f"file://{path}").select("instance_id", "category", "gaussian_count", "class_name")


@query(
    "k10_metrics",
    f"SELECT COUNT(*) FILTER (WHERE code = 1) AS matched, COUNT(*) FILTER (WHERE code = 4) AS mismatched, COUNT(*) AS total FROM ({_CODES})",
    "matches", "ids"
)
def _(s):
    path = f"{_folder(s, 'metrics')}/metrics.json"
    codes = evaluation.agreement(s.ids, evaluation.greedy_match(evaluation.iou_pairs(s.ids, 0.5)))
    scenes.write_json(
        codes.agg(
            F.count_if(F.col("code") == 1).alias("matched"), F.count_if(F.col("code") == 4).alias("mismatched"), F.count("*").alias("total")
        ),
        path
    )
    return s.spark.read.schema("matched long, mismatched long, total long").option("multiLine", True).json(f"file://{path}")


@query(
    "k12_largest_groups", "SELECT gt AS object_id, COUNT(*) AS n FROM ids WHERE gt >= 0 GROUP BY 1 ORDER BY n DESC, object_id LIMIT 5",
    "ids"
)
def _(s):
    """The head of an inspection report."""
    return voting.select_groups(s.ids.where("gt >= 0").groupBy(F.col("gt").alias("object_id")).agg(F.count("*").alias("n")), top_k=5)


@query(
    "k12_point_report",
    "SELECT COUNT(*) AS points, COUNT(*) FILTER (WHERE opacity < -5) AS faint, ROUND(MEDIAN(opacity), 6) AS opacity_p50 FROM points",
    "points"
)
def _(s):
    mid = quality.quantiles(s.points, "opacity", (50,)).select(_round("p50").alias("opacity_p50"))
    return s.points.agg(F.count("*").alias("points"), F.count_if(F.col("opacity") < -5).alias("faint")).crossJoin(mid)


# Scenes and masks

_IDENTITY = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]


@query(
    "s10_transforms",
    "SELECT frame_index, file_path, ROUND(r00, 9) AS r00, ROUND(r01, 9) AS r01, ROUND(t0, 9) AS t0, ROUND(t1, 9) AS t1, 100.0 AS fl_x, 100 AS width FROM frames",
    "frames"
)
def _(s):
    """Poses go out as camera-to-world matrices and come back inverted."""
    path = f"{_folder(s, 'scene')}/transforms.json"
    rows = s.frames.orderBy("frame_index").collect()  # a scene's frames
    poses = [[[*_IDENTITY[0], -r["t0"]], [*_IDENTITY[1], -r["t1"]], [*_IDENTITY[2], -r["t2"]], [0.0, 0.0, 0.0, 1.0]] for r in rows]
    with open(path, "w") as f:
        json.dump(
            {
                "fl_x": 100, "fl_y": 100, "cx": 50, "cy": 50, "w": 100, "h": 100,
                "frames": [{"file_path": r["file_path"], "transform_matrix": m} for r, m in zip(rows, poses, strict=True)]
            },
            f
        )
    frames, camera = scenes.read_transforms(s.spark, f"file://{path}")
    return frames.select(
        "frame_index", "file_path", *[(_round(c, 9) + 0.0).alias(c) for c in ("r00", "r01", "t0", "t1")], F.lit(camera.fl_x).alias("fl_x"),
        F.lit(camera.width).alias("width")
    )


def _images_bin(s: A.Scene) -> str:
    """A sparse model of two images and one camera, in the published binary layout."""
    folder = _folder(s, "sparse")
    images = [(2, "b/frame_2.png", [(1.5, 2.5, 11), (3.0, 4.0, -1)]), (1, "b/frame_1.png", [(0.5, 0.25, 7), (8.0, 9.0, 11), (2.0, 2.0, 5)])]
    body = b"".join(
        struct.pack(
            "<I7dI", i, 1, 0, 0, 0, 0.5 * i, 0, 2, 1
        ) + name.encode() + b"\0" + struct.pack("<Q", len(pts)) + b"".join(struct.pack("<ddq", *p) for p in pts)
        for i, name, pts in images
    )
    with open(f"{folder}/images.bin", "wb") as f:
        f.write(struct.pack("<Q", len(images)) + body)
    with open(f"{folder}/cameras.bin", "wb") as f:
        f.write(struct.pack("<Q", 1) + struct.pack("<IiQQ", 1, 1, 201, 100) + struct.pack("<4d", 80, 90, 100, 50))
    return folder


@query(
    "s10_colmap_scene",
    "SELECT frame_index, file_path, t0, t2, 40.0 AS fl_x, 100 AS width FROM (VALUES (0, 'b/frame_1.png', 0.5, 2.0), (1, 'b/frame_2.png', 1.0, 2.0)) t(frame_index, file_path, t0, t2)"
)
def _(s):
    frames, camera = scenes.read_colmap_scene(s.spark, f"file://{_images_bin(s)}", 2)
    return frames.select("frame_index", "file_path", "t0", "t2", F.lit(camera.fl_x).alias("fl_x"), F.lit(camera.width).alias("width"))


@query(
    "s11_colmap_tracks",
    "SELECT frame_stem, x, y, point3d_id FROM (VALUES ('frame_2', 1.5, 2.5, 11), ('frame_1', 0.5, 0.25, 7), ('frame_1', 8.0, 9.0, 11), ('frame_1', 2.0, 2.0, 5)) t(frame_stem, x, y, point3d_id)"
)
def _(s):
    return scenes.read_colmap_tracks(s.spark, f"file://{_images_bin(s)}/images.bin")


@query(
    "s12_annotations",
    "SELECT CASE WHEN object_id % 4 = 0 THEN NULL ELSE object_id END AS object_id, label, ox, oy, oz, ox + ex AS far_x FROM boxes", "boxes"
)
def _(s):
    """Boxes as a bare list in the second spelling; an empty id is null."""
    path = f"{_folder(s, 'annotations')}/labels.json"
    rows = s.box_corners.orderBy("object_id").collect()  # one row an annotated object
    with open(path, "w") as f:
        json.dump(
            [
                {
                    "ins_id": "" if r["object_id"] % 4 == 0 else str(r["object_id"]), "label": r["label"],
                    "bounding_box": [dict(zip("xyz", c, strict=True)) for c in r["corners"]]
                }
                for r in rows
            ],
            f
        )
    a = scenes.read_annotations(s.spark, f"file://{path}")
    return a.select(
        "object_id", "label", *[F.col("corners")[0][i].alias(f"o{c}") for i, c in enumerate("xyz")], F.col("corners")[1][0].alias("far_x")
    )


@query(
    "s13_occupancy",
    "SELECT px, py, CASE WHEN (px + 2 * py) % 5 = 0 THEN 127 ELSE 0 END AS value, 0.5 AS scale FROM (SELECT UNNEST(generate_series(0, 29)) AS px) CROSS JOIN (SELECT UNNEST(generate_series(0, 19)) AS py)"
)
def _(s):
    folder = _folder(s, "occupancy")
    with open(f"{folder}/occupancy.png", "wb") as f:
        f.write(scenes.grey_png(30, 20, [(x, y) for x in range(30) for y in range(20) if (x + 2 * y) % 5 == 0], 127))
    with open(f"{folder}/occupancy.json", "w") as f:
        json.dump({"scale": 0.5, "upper": [5, 5], "lower": [-5, -5]}, f)
    pixels, meta = scenes.read_occupancy(s.spark, f"file://{folder}/occupancy.png", f"file://{folder}/occupancy.json")
    return pixels.withColumn("scale", F.lit(meta["scale"]))


def _mask_folder(s: A.Scene) -> str:
    """The masks of all instances as images and manifests."""
    folder = _folder(s, "masks")
    boxes = masks.bounds(s.mask_pixels).join(
        s.instances.select("frame_index", "instance_id", "label", "score"), ["frame_index", "instance_id"]
    )
    frames = s.frames.select("frame_index", F.col("file_path").alias("image_path"))
    scenes.write_masks(s.mask_pixels, boxes.join(frames, "frame_index"), folder, 110, 110)
    return folder


_PLACE = "(SELECT frame_index, instance_id, label, score, ROW_NUMBER() OVER (PARTITION BY frame_index ORDER BY instance_id) - 1 AS position FROM instances)"


@query(
    "s4_mask_scan",
    f"SELECT printf('frame_%05d', m.frame_index) AS frame_stem, printf('mask_%04d.png', i.position) AS mask_name, m.x, m.y FROM mask_pixels m JOIN {_PLACE} i USING (frame_index, instance_id)",
    "mask_pixels", "instances"
)
def _(s):
    return scenes.read_mask_pixels(s.spark, f"file://{_mask_folder(s)}")


@query("k8_mask_sink", "SELECT frame_index, instance_id, COUNT(*) AS pixels FROM mask_pixels GROUP BY 1, 2", "mask_pixels")
def _(s):
    """Pixels of every mask image by the instance that its manifest gives it."""
    folder = _mask_folder(s)
    named = scenes.read_manifests(s.spark, f"file://{folder}").select(
        "frame_stem", F.col("mask_path").alias("mask_name"), "frame_index", "instance_id"
    )
    drawn = scenes.read_mask_pixels(s.spark, f"file://{folder}").groupBy("frame_stem", "mask_name").agg(F.count("*").alias("pixels"))
    return drawn.join(few_or_merge(named), ["frame_stem", "mask_name"]).groupBy("frame_index", "instance_id").agg(F.sum("pixels").alias("pixels"))


_MANIFEST = f"SELECT printf('frame_%05d', i.frame_index) AS frame_stem, DENSE_RANK() OVER (ORDER BY i.frame_index) - 1 AS frame_ordinal, i.frame_index, i.position, i.instance_id, i.label, i.score, p.n AS area, p.x0, p.y1 FROM {_PLACE} i JOIN (SELECT frame_index, instance_id, COUNT(*) AS n, MIN(x) AS x0, MAX(y) + 1 AS y1 FROM mask_pixels GROUP BY 1, 2) p USING (frame_index, instance_id)"


@query("s5_manifest_scan", _MANIFEST, "mask_pixels", "instances")
def _(s):
    out = scenes.read_manifests(s.spark, f"file://{_mask_folder(s)}")
    return out.select("frame_stem", "frame_ordinal", "frame_index", "position", "instance_id", "label", "score", "area", "x0", "y1")


@query("s6_manifest_discovery", f"SELECT DISTINCT frame_ordinal, frame_stem FROM ({_MANIFEST})", "mask_pixels", "instances")
def _(s):
    return scenes.read_manifests(
        s.spark, f"file://{_mask_folder(s)}", "frame_*/instances.json"
    ).select("frame_ordinal", "frame_stem").distinct()


@query(
    "s7_manifest_keys",
    "SELECT absent, TRUE AS refused FROM (VALUES ('frame_index'), ('image_path'), ('image_size'), ('instances')) t(absent) UNION ALL SELECT 'none', FALSE"
)
def _(s):
    """Whether a manifest without one of its keys is refused."""
    whole = {"frame_index": 1, "image_path": "a.png", "image_size": [4, 4], "instances": []}
    out = []
    for absent in [*whole, "none"]:
        folder = _folder(s, "manifest")
        os.makedirs(f"{folder}/f")
        with open(f"{folder}/f/instances.json", "w") as f:
            json.dump({k: v for k, v in whole.items() if k != absent}, f)
        try:
            scenes.read_manifests(s.spark, f"file://{folder}")
            out.append((absent, False))
        except ValueError:
            out.append((absent, True))
    return s.spark.createDataFrame(out, "absent string, refused boolean")


@query(
    "s17_image_list",
    "SELECT printf('mask_%04d', i.position) AS stem, ROW_NUMBER() OVER (ORDER BY i.position) - 1 AS frame_index FROM " + _PLACE + " i WHERE frame_index = 2 AND position < 7 AND position <> 3",
    "instances"
)
def _(s):
    """The first images of a folder by name, less those that are done."""
    done = s.spark.createDataFrame([("mask_0003",)], "stem string")
    listed = scenes.list_images(s.spark, f"file://{_mask_folder(s)}/frame_00002", 7, done).select("stem")
    return numbered(listed, ["stem"], "frame_index")


@query(
    "s18_frame_ordinal",
    "SELECT 'frame_00003' AS frame_stem, 3 AS ordinal, (SELECT label FROM instances WHERE frame_index = 3 ORDER BY instance_id LIMIT 1) AS label",
    "instances"
)
def _(s):
    found = scenes.read_manifests(s.spark, f"file://{_mask_folder(s)}")
    first = found.where("frame_stem = 'frame_00003' and position = 0")
    return first.select("frame_stem", F.lit(scenes.frame_ordinal(found, "frame_00003")).alias("ordinal"), "label")


@query(
    "s19_frame_selection",
    "SELECT frame_stem, place FROM (VALUES ('frame_00004', 0), ('frame_00001', 1)) t(frame_stem, place) UNION ALL SELECT DISTINCT printf('all_%05d', frame_index), frame_index FROM instances WHERE frame_index < 3",
    "instances"
)
def _(s):
    """Frames given by name in that order, and the first three of all."""
    found = scenes.read_manifests(s.spark, f"file://{_mask_folder(s)}")
    named = scenes.select_frames(found, ["frame_00004", "frame_00001", "frame_00000"], 2)
    return named.union(scenes.select_frames(found, limit=3).withColumn("frame_stem", F.regexp_replace("frame_stem", "frame", "all")))


@query(
    "j3_votes_of_files",
    "SELECT h.frame_index, h.instance_id, h.gaussian_index, CAST(i.score AS FLOAT) AS weight FROM hits h JOIN instances i USING (frame_index, instance_id)",
    "hits", "instances"
)
def _(s):
    """Votes from mask files: manifests and images read, points projected, hits weighed by score."""
    folder = f"file://{_mask_folder(s)}"
    inst = scenes.read_manifests(s.spark, folder)
    named = inst.select("frame_stem", F.col("mask_path").alias("mask_name"), "frame_index", "instance_id")
    pixels = scenes.read_mask_pixels(s.spark, folder).join(few_or_merge(named), ["frame_stem", "mask_name"])
    seen = visibility.project_points(s.points, s.frames, A.CAMERA)
    return visibility.mask_votes(seen, pixels, inst)


@query("a11_labelled_objects", "SELECT object_id, COUNT(*) AS instances FROM objects GROUP BY 1", "objects")
def _(s):
    path = f"file://{_folder(s, 'labelled')}/objects"
    _labelled(s).select("object_id", "instance_id", L.frame_name("frame_index").alias("frame")).write.parquet(path)
    return s.spark.read.parquet(path).groupBy("object_id").agg(F.count("frame").alias("instances"))



_SHOWN = "SELECT frame_index, x, y, 64 + (k & 127) AS red, 64 + ((k >> 14) & 127) AS blue FROM (SELECT m.*, (CAST(m.instance_id AS BIGINT) * 1103515245 + 12345) & 2147483647 AS k, ROW_NUMBER() OVER (PARTITION BY m.frame_index, x, y ORDER BY i.score DESC, i.position DESC) AS r FROM mask_pixels m JOIN instances i USING (frame_index, instance_id)) WHERE r = 1"


@query("k13_overlays", f"""SELECT printf('overlay_%05d.png', d.frame_index) AS file, d.px AS x, d.py AS y, CAST(CASE WHEN s.red IS NULL THEN (d.px + d.py) % 256 ELSE FLOOR(0.55 * ((d.px + d.py) % 256) + 0.45 * s.red) END AS INT) AS red,
 CAST(CASE WHEN s.red IS NULL THEN d.px * 2 ELSE FLOOR(0.55 * (d.px * 2) + 0.45 * s.blue) END AS INT) AS blue FROM depth_map d LEFT JOIN ({_SHOWN}) s ON s.frame_index = d.frame_index AND s.x = d.px AND s.y = d.py""", "depth_map", "mask_pixels", "instances")
def _(s):
    """Masks in the colours of their instances over a picture, as image files read back."""
    folder = _folder(s, "overlays")
    base = s.depth.select(
        "frame_index", F.col("px").alias("x"), F.col("py").alias("y"), ((F.col("px") + F.col("py")) % 256).alias("red"),
        F.lit(0).alias("green"), (F.col("px") * 2).alias("blue")
    )
    scenes.write_overlays(masks.overlay(masks.painted(s.mask_pixels, s.instances), C.hashed_color("instance_id"), base), folder, 100, 100)
    return scenes.read_color_pixels(s.spark, f"file://{folder}").select("file", "x", "y", "red", "blue")
