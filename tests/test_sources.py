import json
import struct

import numpy as np
import pytest

from scenelake.operators import masks
from scenelake.sources import arrays, ply, scenes


def write_sample(path, rows, props):
    dtype = np.dtype([(n, ply.SCALARS[t][0]) for t, n in props])
    head = "\n".join(["ply", "format binary_little_endian 1.0", "comment made by hand", f"element vertex {len(rows)}", *(f"property {t} {n}" for t, n in props), "end_header"]) + "\n"
    path.write_bytes(head.encode() + np.array(rows, dtype).tobytes())


PROPS = [("float", "x"), ("float", "y"), ("double", "z"), ("uchar", "red"), ("uint", "tag"), ("float", "opacity")]


def test_ply_round_trip_keeps_types_and_order(spark, tmp_path):
    rows = [(i, i + 0.5, -i, i % 256, 4_000_000_000 + i, 0.1 * i) for i in range(50)]
    write_sample(tmp_path / "a.ply", rows, PROPS)
    df = ply.read_ply(spark, str(tmp_path / "a.ply"), rows=7)
    assert df.rdd.getNumPartitions() == 8 and df.schema["tag"].dataType.simpleString() == "bigint"
    got = [tuple(r)[1:5] for r in df.orderBy("gaussian_index").collect()]
    assert got == [r[:4] for r in rows]
    whole = ply.read_ply(spark, str(tmp_path / "a.ply"), whole=True)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, df.collect()))
    ply.write_ply(df.orderBy("tag", ascending=False), str(tmp_path / "b.ply"), PROPS)
    assert ply.read_header(str(tmp_path / "b.ply")).properties == tuple(PROPS)
    assert (tmp_path / "b.ply").read_bytes().split(b"end_header\n")[1] == (tmp_path / "a.ply").read_bytes().split(b"end_header\n")[1]
    c = ply.cloud(df)
    assert c.columns[:4] == ["gaussian_index", "x", "y", "z"] and c.where("scale_0 is not null").count() == 0


@pytest.mark.parametrize("text", ["plx\nend_header\n", "ply\nformat ascii 1.0\nelement vertex 1\nend_header\n", "ply\nformat binary_little_endian 1.0\nend_header\n", "ply\nformat binary_little_endian 1.0\nelement vertex 1\nproperty list uchar int f\nend_header\n", "ply\nformat binary_little_endian 1.0\n"])
def test_bad_headers_are_refused(text):
    with pytest.raises(ValueError):
        ply.parse_header(text.encode())


def test_ascii_ply(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.0, 2.0, 3.0, 4, 5, 6), (0, 0.0, 0.0, 0.0, 1, 2, 3)], "gaussian_index long, x double, y double, z double, red int, green int, blue int")
    ply.write_ascii(df, str(tmp_path / "a.ply"))
    assert (tmp_path / "a.ply").read_text().splitlines()[-2:] == ["0.000000 0.000000 0.000000 1 2 3", "1.000000 2.000000 3.000000 4 5 6"]


def test_values_that_a_file_type_cannot_hold_are_refused(spark, tmp_path):
    df = spark.createDataFrame([(0, 1 << 31, 300, 0.5), (1, 7, 8, 1.0)], "gaussian_index long, big long, red int, v double")
    with pytest.raises(Exception, match="cannot hold"):
        ply.write_ply(df.select("gaussian_index", "big"), str(tmp_path / "a.ply"))
    with pytest.raises(Exception, match="cannot hold"):
        ply.write_ply(df.select("gaussian_index", "red"), str(tmp_path / "b.ply"))
    with pytest.raises(Exception, match="cannot hold"):
        arrays.write_npy(df, str(tmp_path / "c.npy"), "v")
    assert not list(tmp_path.glob("*.ply")) and not list(tmp_path.glob("*.npy"))
    ply.write_ply(df.where("gaussian_index = 1").select("gaussian_index", "big", "red"), str(tmp_path / "d.ply"))
    assert ply.read_header(str(tmp_path / "d.ply")).properties == (("int", "big"), ("uchar", "red"))


def test_frames_are_selected_in_order(spark):
    m = spark.createDataFrame([(f"f{i}",) for i in (3, 1, 2, 1, 0)], "frame_stem string")
    assert sorted(map(tuple, scenes.select_frames(m, limit=3).collect())) == [("f0", 0), ("f1", 1), ("f2", 2)]
    assert sorted(map(tuple, scenes.select_frames(m, ["f2", "f0"]).collect())) == [("f0", 1), ("f2", 0)]
    with pytest.raises(ValueError, match="f9"):
        scenes.select_frames(m, ["f2", "f9"])


def test_instance_records_need_a_list(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"instances": [{"instance_id": 4, "category": "chair"}, {"instance_id": 5, "category": "chair", "rank_in_category": 0}]}))
    assert sorted(r["class_name"] for r in scenes.read_instance_records(spark, str(tmp_path / "r.json")).collect()) == ["chair_01", "chair_05"]
    (tmp_path / "n.json").write_text("{}")
    with pytest.raises(ValueError):
        scenes.read_instance_records(spark, str(tmp_path / "n.json"))


def test_numpy_side_files(spark, tmp_path):
    np.save(tmp_path / "ids.npy", np.array([5, -1, 7], np.int32))
    np.save(tmp_path / "p.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    assert [tuple(r) for r in arrays.read_npy(spark, str(tmp_path / "ids.npy"), "object_id").orderBy("gaussian_index").collect()] == [(0, 5), (1, -1), (2, 7)]
    assert [r[1] for r in arrays.read_npy(spark, str(tmp_path / "p.npy")).orderBy("gaussian_index").collect()] == [[0, 1], [2, 3], [4, 5]]
    d = arrays.read_depth(spark, str(tmp_path / "p.npy"), 4)
    assert {tuple(r) for r in d.select("frame_index", "px", "py", "d").collect()} == {(4, x, y, 2.0 * y + x) for y in range(3) for x in range(2)}
    np.savez(tmp_path / "v.npz", frame_indices=np.array([0, 1]), instance_ids=np.array([2, 3]), gaussian_indices=np.array([9, 8]), weights=np.array([0.5, 1.0]))
    assert [tuple(r) for r in arrays.read_votes(spark, str(tmp_path / "v.npz")).collect()] == [(0, 2, 9, 0.5), (1, 3, 8, 1.0)]
    arrays.write_npy(spark.createDataFrame([(1, 20), (0, 10)], "gaussian_index long, v int"), str(tmp_path / "o.npy"), "v")
    assert np.load(tmp_path / "o.npy").tolist() == [10, 20]


def test_transforms(spark, tmp_path):
    pose = [[0.0, -1, 0, 3], [1, 0, 0, 4], [0, 0, 1, 5], [0, 0, 0, 1]]
    doc = {"fl_x": 100, "fl_y": 100, "cx": 50, "cy": 50, "w": 100, "h": 100, "camera_model": "PINHOLE", "frames": [{"file_path": "images/a.png", "transform_matrix": np.eye(4).tolist()}, {"file_path": "images/b.png", "transform_matrix": pose}]}
    (tmp_path / "transforms.json").write_text(json.dumps(doc))
    frames, camera = scenes.read_transforms(spark, str(tmp_path / "transforms.json"))
    assert (camera.fl_x, camera.width, camera.model) == (100.0, 100, "PINHOLE")
    rows = frames.orderBy("frame_index").collect()
    inv = np.linalg.inv(np.array(pose))
    assert np.allclose([rows[1][f"r{i}{j}"] for i in range(3) for j in range(3)], inv[:3, :3].ravel()) and np.allclose([rows[1][f"t{i}"] for i in range(3)], inv[:3, 3])
    assert [rows[0][f"t{i}"] for i in range(3)] == [0, 0, 0]


def test_colmap(spark, tmp_path):
    points = struct.pack("<ddq", 1.5, 2.5, 11) + struct.pack("<ddq", 3.0, 4.0, -1)
    image = struct.pack("<I7dI", 1, 1, 0, 0, 0, 0.5, 0, 2, 1) + b"dir/frame_1.png\0" + struct.pack("<Q", 2) + points
    (tmp_path / "images.bin").write_bytes(struct.pack("<Q", 1) + image)
    (tmp_path / "cameras.bin").write_bytes(struct.pack("<Q", 1) + struct.pack("<IiQQ", 1, 1, 201, 100) + struct.pack("<4d", 80, 90, 100, 50))
    assert [tuple(r) for r in scenes.read_colmap_tracks(spark, str(tmp_path / "images.bin")).collect()] == [("frame_1", 1.5, 2.5, 11)]
    frames, camera = scenes.read_colmap_scene(spark, str(tmp_path), 2)
    assert (camera.fl_x, camera.fl_y, camera.width, camera.height) == (40.0, 45.0, 100, 50)
    r = frames.first()
    assert (r["r00"], r["r01"], r["t0"], r["t2"]) == (1.0, 0.0, 0.5, 2.0)


def test_masks_and_manifests_round_trip(spark, tmp_path):
    px = spark.createDataFrame([(0, 3, x, y) for x in (1, 2) for y in (4, 5, 6)] + [(2, 1, 0, 0)], "frame_index int, instance_id int, x int, y int")
    inst = masks.bounds(px).join(spark.createDataFrame([(0, 3, "a.png", "chair", 0.5), (2, 1, "b.png", None, 0.25)], "frame_index int, instance_id int, image_path string, label string, score double"), ["frame_index", "instance_id"])
    scenes.write_masks(px, inst, str(tmp_path / "m"), 8, 8)
    got = scenes.read_manifests(spark, str(tmp_path / "m"))
    rows = {r["frame_index"]: r for r in got.collect()}
    assert (rows[0]["area"], rows[0]["x0"], rows[0]["x1"], rows[0]["label"], rows[0]["frame_ordinal"], rows[2]["frame_ordinal"], rows[2]["label"]) == (6, 1, 3, "chair", 0, 1, None)
    assert scenes.frame_ordinal(got, "frame_00002") == 1
    with pytest.raises(ValueError):
        scenes.frame_ordinal(got, "nowhere")
    back = scenes.read_mask_pixels(spark, str(tmp_path / "m"))
    assert {tuple(r) for r in back.select("frame_stem", "x", "y").collect()} == {("frame_00000", x, y) for x in (1, 2) for y in (4, 5, 6)} | {("frame_00002", 0, 0)}
    (tmp_path / "bad" / "f").mkdir(parents=True)
    (tmp_path / "bad" / "f" / "instances.json").write_text('{"frame_index": 1}')
    with pytest.raises(ValueError):
        scenes.read_manifests(spark, str(tmp_path / "bad"))


def test_annotations_groups_occupancy(spark, tmp_path):
    corner = [[0.0, 0, 0]] * 8
    (tmp_path / "a.json").write_text(json.dumps({"objects": [{"instance_id": 4, "label": "cup", "bbox": corner}]}))
    (tmp_path / "b.json").write_text(json.dumps([{"ins_id": "7", "label": "tv", "bounding_box": [{"x": 1, "y": 2, "z": 3}] * 8}, {"ins_id": "", "label": "none"}]))
    assert [tuple(r)[:2] for r in scenes.read_annotations(spark, str(tmp_path / "a.json")).collect()] == [(4, "cup")]
    b = scenes.read_annotations(spark, str(tmp_path / "b.json")).orderBy("position").collect()
    assert [(r["object_id"], r["label"]) for r in b] == [(7, "tv"), (None, "none")] and b[0]["corners"][0] == [1.0, 2.0, 3.0]
    (tmp_path / "g.json").write_text(json.dumps({"groups": [{"global_object_id": 3, "object_id": 5, "gaussian_count": 9}, {"global_object_id": 2}]}))
    assert [r["object_id"] for r in scenes.read_groups(spark, str(tmp_path / "g.json")).collect()] == [5, 2]
    assert [r["object_id"] for r in scenes.read_groups(spark, str(tmp_path / "g.json"), "global_object_id").collect()] == [3, 2]
    (tmp_path / "o.png").write_bytes(scenes.grey_png(3, 2, [(2, 1)], 127))
    (tmp_path / "o.json").write_text(json.dumps({"scale": 0.5, "upper": [1, 2], "lower": [0, 0]}))
    px, meta = scenes.read_occupancy(spark, str(tmp_path / "o.png"), str(tmp_path / "o.json"))
    assert meta["scale"] == 0.5 and {tuple(r) for r in px.where("value > 0").collect()} == {(2, 1, 127)} and px.count() == 6
    (tmp_path / "c.json").write_text(json.dumps({"classes": [{"class_id": 1, "name": "sofa"}]}))
    assert [tuple(r) for r in scenes.read_class_names(spark, str(tmp_path / "c.json"), 3).orderBy("class_index").collect()] == [(0, "class_0"), (1, "sofa"), (2, "class_2")]
    with pytest.raises(FileNotFoundError):
        scenes.check_annotated_scene(str(tmp_path))
    scenes.write_json(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "w.json"), "rows", total=1)
    assert json.loads((tmp_path / "w.json").read_text()) == {"total": 1, "rows": [{"a": 1, "b": None}]}
    assert [r["stem"] for r in scenes.list_images(spark, str(tmp_path)).collect()] == ["o"]
