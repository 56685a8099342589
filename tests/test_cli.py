"""Flows from files to files on a small made-up scene."""

import json
import struct

import numpy as np
import pytest

from scenelake import cli
from scenelake.sources import ply, scenes

PROPS = [("float", c) for c in ("x", "y", "z", "opacity", "scale_0", "scale_1", "scale_2", "rot_0", "rot_1", "rot_2", "rot_3", "f_dc_0", "f_dc_1", "f_dc_2", "f_rest_0")]


@pytest.fixture(scope="module")
def scene(spark, tmp_path_factory):
    """Two blobs of points before three cameras, each under a mask of its own in every frame."""
    root = tmp_path_factory.mktemp("scene")
    r = np.random.default_rng(3)
    xyz = np.concatenate([r.normal((-0.6, 0, 2), 0.03, (60, 3)), r.normal((0.6, 0, 2), 0.03, (40, 3))]).astype(np.float32)
    table = np.zeros(100, np.dtype([(n, "<f4") for _, n in PROPS]))
    table["x"], table["y"], table["z"], table["rot_0"], table["opacity"] = *xyz.T, 1, 2
    for k in range(3):
        table[f"scale_{k}"] = -4
    head = "\n".join(["ply", "format binary_little_endian 1.0", "element vertex 100", *(f"property {t} {n}" for t, n in PROPS), "end_header"]) + "\n"
    (root / "a.ply").write_bytes(head.encode() + table.tobytes())
    frames = []
    for i in range(3):
        m = np.eye(4)
        m[1, 3] = 0.02 * i
        frames.append({"file_path": f"images/f{i}.png", "transform_matrix": m.tolist()})
        folder = root / "masks" / f"frame_{i:05d}"
        folder.mkdir(parents=True)
        for k, (x0, label) in enumerate(((5, "large chair"), (60, "television tv"))):
            (folder / f"mask_{k:04d}.png").write_bytes(scenes.grey_png(100, 100, [(x, y) for x in range(x0, x0 + 35) for y in range(30, 70)]))
        body = {"frame_index": i, "image_path": f"f{i}.png", "image_size": [100, 100], "instances": [{"instance_id": k, "bbox_xyxy": [x0, 30, x0 + 35, 70], "score": 0.9, "area": 1400, "mask_path": f"mask_{k:04d}.png", "label": lab} for k, (x0, lab) in enumerate(((5, "large chair"), (60, "television tv")))]}
        (folder / "instances.json").write_text(json.dumps(body))
    (root / "transforms.json").write_text(json.dumps({"fl_x": 100, "fl_y": 100, "cx": 50, "cy": 50, "w": 100, "h": 100, "camera_model": "PINHOLE", "frames": frames}))
    return root


def run(scene, name, **options):
    argv = [name]
    for k, v in options.items():
        flag = "--" + k.replace("_", "-")
        argv += [flag] if v is True else [flag, *map(str, v if isinstance(v, (list, tuple)) else [v])]
    cli.main(argv)


def test_lift_associate_group_evaluate(spark, scene):
    base = {"dataset_root": scene, "ply_path": scene / "a.ply", "masks_root": scene / "masks"}
    run(scene, "lift-masks", **base, output_root=scene / "lift", use_opacity_weight=True)
    assert json.loads((scene / "lift/vote_summary.json").read_text())["covered_count"] == 100
    run(scene, "associate-instances", vote_evidence=scene / "lift/votes", output_root=scene / "assoc", masks_root=scene / "masks", require_same_label_family=True)
    run(scene, "build-groups", vote_evidence=scene / "lift/votes", instances=scene / "assoc/instances", ply_path=scene / "a.ply", output_root=scene / "groups") if (scene / "groups").mkdir() is None else None
    ids = np.load(scene / "groups/gaussian_object_ids.npy")
    assert (ids[:60] == ids[0]).all() and (ids[60:] == ids[60]).all() and ids[0] != ids[60]
    groups = json.loads((scene / "groups/gaussian_groups.json").read_text())["groups"]
    assert sorted(g["gaussian_count"] for g in groups) == [40, 60]
    np.save(scene / "gt.npy", np.array([7] * 60 + [8] * 40, np.int32))
    run(scene, "evaluate-groups", gt_object_ids=scene / "gt.npy", pred_object_ids=scene / "groups/gaussian_object_ids.npy", output_json=scene / "m.json")
    assert json.loads((scene / "m.json").read_text())["mean_iou"] == 1.0
    run(scene, "compare-groups", ply_path=scene / "a.ply", gt_object_ids=scene / "gt.npy", pred_object_ids=scene / "groups/gaussian_object_ids.npy", output_path=scene / "cmp.ply", output_json=scene / "cmp.json")
    assert {c["name"]: c["n"] for c in json.loads((scene / "cmp.json").read_text())["classes"]}["matched"] == 100
    run(scene, "best-frames", dataset_root=scene, ply_path=scene / "a.ply", object_ids=scene / "gt.npy", output_json=scene / "bf.json")
    assert {(f["object_id"], f["visible"]) for f in json.loads((scene / "bf.json").read_text())["frames"]} == {(7, 60), (8, 40)}


def test_discover_and_reproject(spark, scene):
    base = {"dataset_root": scene, "ply_path": scene / "a.ply", "masks_root": scene / "masks"}
    run(scene, "discover-proposals", **base, output_root=scene / "prop", min_shared_gaussians=10, min_support_size=10, min_proposal_gaussians=20)
    props = json.loads((scene / "prop/object_proposals.json").read_text())["proposals"]
    assert {(p["label"], p["gaussian_count"]) for p in props} == {("large chair", 60), ("television tv", 40)}
    run(scene, "discover-category-instances", **base, output_root=scene / "cat", min_gaussians=10, voxel_size=0.1, min_voxel_count=1)
    inst = json.loads((scene / "cat/category_instances.json").read_text())["instances"]
    assert {i["category_name"] for i in inst} == {"tv", "chair"}
    run(scene, "project-instances", dataset_root=scene, ply_path=scene / "a.ply", instance_ids=scene / "cat/gaussian_instance_ids.npy", output_root=scene / "proj", min_mask_pixels=4)
    got = scenes.read_manifests(spark, str(scene / "proj"))
    assert got.where("label = 'background'").count() == 3 and got.where("label <> 'background'").count() >= 6
    run(scene, "reassign-masks", dataset_root=scene, ply_path=scene / "a.ply", grounded_masks_root=scene / "masks", instance_ids=scene / "cat/gaussian_instance_ids.npy", output_root=scene / "re", min_instance_hit_count=5)
    assert scenes.read_manifests(spark, str(scene / "re")).where("instance_id > 0").count() == 6
    run(scene, "build-clusters", ply_path=scene / "a.ply", output_root=scene / "cl", voxel_size=0.15, min_gaussians=10)
    ids = np.load(scene / "cl/gaussian_cluster_ids.npy")
    assert (ids[:60] == 0).mean() > 0.9 and (ids[60:] == 1).mean() > 0.9
    run(scene, "score-clusters", dataset_root=scene, ply_path=scene / "a.ply", cluster_ids=scene / "cl/gaussian_cluster_ids.npy", masks_root=scene / "masks", output_root=scene / "sc", frame_stride=1)
    assert [c["accepted"] for c in json.loads((scene / "sc/cluster_scores.json").read_text())["clusters"]] == [True, True]


def test_edit_and_clean(spark, scene):
    np.save(scene / "o.npy", np.array([7] * 60 + [8] * 40, np.int32))
    run(scene, "apply-transform", ply_path=scene / "a.ply", object_ids=scene / "o.npy", output_path=scene / "moved.ply", target_object_id=8, translate=(1, 0, 0))
    before, after = (ply.read_ply(spark, str(scene / n)).orderBy("gaussian_index").toPandas() for n in ("a.ply", "moved.ply"))
    assert np.allclose(after["x"][60:], before["x"][60:] + 1, atol=1e-5) and (after["x"][:60] == before["x"][:60]).all() and ply.read_header(str(scene / "moved.ply")).properties == tuple(PROPS)
    run(scene, "prune-noise", ply_path=scene / "a.ply", output_ply=scene / "pruned.ply", sidecar_path=scene / "o.npy", output_sidecar=scene / "o2.npy", radius_percentile=90)
    assert ply.read_header(str(scene / "pruned.ply")).count == len(np.load(scene / "o2.npy")) < 100
    (scene / "q").mkdir()
    run(scene, "build-quality", ply_path=scene / "a.ply", output_root=scene / "q")
    assert len(np.load(scene / "q/gaussian_quality.npy")) == 100
    run(scene, "highlight-groups", ply_path=scene / "a.ply", object_ids=scene / "o.npy", output_path=scene / "hi.ply", skip_largest_n=1, flatten_selected_sh=True)
    shown = ply.read_ply(spark, str(scene / "hi.ply")).orderBy("gaussian_index").toPandas()
    assert (shown["f_dc_0"][:60] == 0).all() and np.allclose(shown["f_dc_0"][60:], 1.7724538)
    run(scene, "scene-manifest", dataset_root=scene, ply_path=scene / "a.ply", output_path=scene / "man.json")
    assert json.loads((scene / "man.json").read_text())["frame_count"] == 3
    run(scene, "group-points", ply_path=scene / "a.ply", object_ids=scene / "o.npy", output_path=scene / "pts.ply")
    assert (scene / "pts.ply").read_text().count("\n") == 110
    run(scene, "group-points", ply_path=scene / "a.ply", object_ids=scene / "o.npy", output_path=scene / "ctx.ply", include_object_ids=[8], show_context=True, max_points=30)
    assert (scene / "ctx.ply").read_text().count("\n") == 40
    run(scene, "group-points", ply_path=scene / "a.ply", object_ids=scene / "o.npy", output_path=scene / "only.ply", include_object_ids=[8])
    assert (scene / "only.ply").read_text().count("\n") == 50
    run(scene, "prepare-single-masks", masks_root=scene / "masks", output_root=scene / "single", label_regex="chair")
    assert spark.read.parquet(str(scene / "single/identity_masks")).count() == 3
    run(scene, "prepare-multiclass-masks", masks_root=scene / "masks", output_root=scene / "multi", category=["seat=chair", "screen=tv"])
    assert spark.read.parquet(str(scene / "multi/identity_masks")).count() == 6
    run(scene, "prepare-identity-masks", masks_root=scene / "masks", output_root=scene / "idm")
    assert spark.read.parquet(str(scene / "idm/identity_masks")).select("global_id").distinct().count() == 2
    run(scene, "diagnose-scene-bounds", ply_path=scene / "a.ply", dataset_root=scene, output_root=scene / "b", frame_stride=1, write_cleaned_ply=True)
    assert ply.read_header(str(scene / "b/cleaned.ply")).count <= 100


def test_overlays_and_track_masks(spark, scene):
    run(scene, "overlay-masks", masks_root=scene / "masks", output_root=scene / "plain", frame_stems=["frame_00002", "frame_00000"], limit=1)
    px = scenes.read_color_pixels(spark, str(scene / "plain"))
    assert {r["file"] for r in px.select("file").distinct().collect()} == {"overlay_00002.png"}
    assert px.count() == 100 * 100 and px.where("red + green + blue > 0").count() == 2 * 35 * 40
    grey = spark.range(100).selectExpr("cast(id as int) x").crossJoin(spark.range(100).selectExpr("cast(id as int) y")).selectExpr("0 frame_index", "x", "y", "200 red", "200 green", "200 blue")
    scenes.write_overlays(grey, str(scene / "pictures"), 100, 100, "f")
    (scene / "pictures/f_00000.png").rename(scene / "pictures/f0.png")
    run(scene, "overlay-masks", masks_root=scene / "masks", output_root=scene / "over", images_root=scene / "pictures", alpha=0.5)
    px = scenes.read_color_pixels(spark, str(scene / "over"))
    assert {r["red"] for r in px.where("x < 5").select("red").distinct().collect()} == {200}
    assert px.where("x between 5 and 39 and y between 30 and 69").select("red", "green", "blue").distinct().count() == 1
    body = b""
    for i in range(3):
        pts = [(10 + k, 40, k) for k in range(12)] + [(70 + k, 50, 100 + k) for k in range(12)] + [(2, 2, 999)]
        body += struct.pack("<I7dI", i + 1, 1, 0, 0, 0, 0, 0, 0, 1) + f"frame_{i:05d}.png".encode() + b"\0" + struct.pack("<Q", len(pts)) + b"".join(struct.pack("<ddq", *p) for p in pts)
    (scene / "colmap/sparse/0").mkdir(parents=True)
    (scene / "colmap/sparse/0/images.bin").write_bytes(struct.pack("<Q", 3) + body)
    run(scene, "discover-track-masks", dataset_root=scene, grounded_masks_root=scene / "masks", output_root=scene / "tracks", colmap_image_width=100, colmap_image_height=100)
    rows = spark.read.parquet(str(scene / "tracks/mask_groups")).collect()
    assert {(r["instance_id"], r["class_name"]) for r in rows} == {(0, "chair_01"), (1, "tv_01")} and len(rows) == 6
