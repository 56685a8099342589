"""Scenes, mask manifests, images and annotations."""

from __future__ import annotations

import json
import os
import struct
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scenelake.functions import geometry as G
from scenelake.functions import labels as L
from scenelake.operators.ranking import numbered
from scenelake.operators.visibility import Camera

TRANSFORMS = "fl_x double, fl_y double, cx double, cy double, w int, h int, camera_model string, k1 double, k2 double, k3 double, k4 double, p1 double, p2 double, frames array<struct<file_path:string,transform_matrix:array<array<double>>>>"
INSTANCE = "struct<instance_id:int,bbox_xyxy:array<int>,score:double,area:int,mask_path:string,label:string,detection_bbox_xyxy:array<int>,detection_score:double>"
MANIFEST = f"frame_index int, image_path string, image_size array<int>, instances array<{INSTANCE}>"
GROUPS = "groups array<struct<global_object_id:int,object_id:int,label:string,gaussian_count:bigint,centroid_xyz:array<double>,bbox_min_xyz:array<double>,bbox_max_xyz:array<double>,support_frames:array<int>,total_vote_weight:double>>"


RECORDS = "instances array<struct<instance_id:int,category:string,category_index:int,rank_in_category:int,gaussian_count:bigint,vote_sum:double,support_mean:double,confidence_mean:double,centroid_xyz:array<double>,bbox_min_xyz:array<double>,bbox_max_xyz:array<double>>>"


def read_transforms(spark: SparkSession, path: str) -> tuple[DataFrame, Camera]:
    """Frames (frame_index, file_path, pose columns world to camera) and the camera of a transforms.json.

    The frame index is the place in the list. Poses are kept as they stand: x right, y down, z forward.
    """
    doc = spark.read.schema(TRANSFORMS).option("multiLine", True).json(path)
    c = doc.drop("frames").first()  # one document
    if c is None or c["fl_x"] is None:
        raise ValueError(f"{path} holds no camera")
    model = (c["camera_model"] or "PINHOLE").upper()
    names = ("k1", "k2", "k3", "k4") if model == "OPENCV_FISHEYE" else ("k1", "k2", "p1", "p2", "k3", "k4")
    camera = Camera(
        c["fl_x"], c["fl_y"], c["cx"], c["cy"], c["w"], c["h"], model, tuple(c[k] or 0.0 for k in names) if model != "PINHOLE" else ()
    )
    f = doc.select(F.posexplode("frames").alias("frame_index", "f")).select(
        "frame_index", F.col("f.file_path").alias("file_path"), F.col("f.transform_matrix").alias("m")
    )
    return f.select("frame_index", "file_path", *inverse_pose(F.col("m"))), camera


def inverse_pose(m: Column) -> list[Column]:
    """Pose columns of the inverse of a 4x4 camera-to-world matrix column."""
    column = lambda j: tuple(m[i][j] for i in range(3))
    zero = (F.lit(0.0),) * 3
    inv, _ = G.inverse_basis(zero, column(0), column(1), column(2))
    t = [m[i][3] for i in range(3)]
    shift = [-(inv[3 * r] * t[0] + inv[3 * r + 1] * t[1] + inv[3 * r + 2] * t[2]) for r in range(3)]
    return [e.alias(f"r{i // 3}{i % 3}") for i, e in enumerate(inv)] + [(e + 0.0).alias(f"t{i}") for i, e in enumerate(shift)]


#: Parameters of a COLMAP camera by model number: name and count, as published.
COLMAP_MODELS = {
    0: ("SIMPLE_PINHOLE", 3), 1: ("PINHOLE", 4), 2: ("SIMPLE_RADIAL", 4), 3: ("RADIAL", 5), 4: ("OPENCV", 8), 5: ("OPENCV_FISHEYE", 8)
}


def _colmap_images(raw: bytes):
    """(image id, quaternion, translation, camera id, name, points) of a binary images file."""
    (n,), at = struct.unpack_from("<Q", raw), 8
    for _ in range(n):
        image, *rest, camera = struct.unpack_from("<I7dI", raw, at)
        at += struct.calcsize("<I7dI")
        end = raw.index(b"\0", at)
        name = raw[at:end].decode()
        (k,) = struct.unpack_from("<Q", raw, end + 1)
        at = end + 9
        yield image, rest[:4], rest[4:], camera, name, raw[at : at + 24 * k]
        at += 24 * k


def read_colmap_tracks(spark: SparkSession, path: str) -> DataFrame:
    """(frame_stem, x, y, point3d_id) of 2D observations that belong to a 3D point."""
    import numpy as np

    def run(batches):
        kind = np.dtype([("x", "<f8"), ("y", "<f8"), ("id", "<i8")])
        for b in batches:
            for raw in b.column(0).to_pylist():
                for _, _, _, _, name, points in _colmap_images(raw):
                    p = np.frombuffer(points, kind)
                    p = p[p["id"] >= 0]
                    stem = os.path.splitext(os.path.basename(name))[0]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([stem] * len(p), pa.string()), pa.array(p["x"].copy()), pa.array(p["y"].copy()),
                            pa.array(p["id"].copy())
                        ],
                        ["frame_stem", "x", "y", "point3d_id"]
                    )

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(
        run, "frame_stem string, x double, y double, point3d_id long"
    )


def read_colmap_scene(spark: SparkSession, folder: str, downscale: int = 1, rounding: str = "floor") -> tuple[DataFrame, Camera]:
    """Frames in name order and the first camera of a sparse model (images.bin, cameras.bin), scaled down."""
    import math

    def run(batches):
        for b in batches:
            for raw in b.column(0).to_pylist():
                rows = [(name, *q, *t) for _, q, t, _, name, _ in _colmap_images(raw)]
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["file_path", "qw", "qx", "qy", "qz", "t0", "t1", "t2"])

    im = spark.read.format("binaryFile").load(f"{folder}/images.bin").select("content").mapInArrow(
        run, "file_path string, qw double, qx double, qy double, qz double, t0 double, t1 double, t2 double"
    )
    w, x, y, z = (F.col(c) for c in ("qw", "qx", "qy", "qz"))
    rot = [
        1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y), 2 * (x * y + w * z), 1 - 2 * (x * x + z * z),
        2 * (y * z - w * x), 2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)
    ]
    frames = numbered(im, ["file_path"], "frame_index").select(
        F.col("frame_index").cast("int").alias("frame_index"), "file_path", *[e.alias(f"r{i // 3}{i % 3}") for i, e in enumerate(rot)],
        "t0", "t1", "t2"
    )
    raw = bytes(spark.read.format("binaryFile").load(f"{folder}/cameras.bin").first()["content"])
    _, model, width, height = struct.unpack_from("<IiQQ", raw, 8)
    name, n = COLMAP_MODELS[model]
    p = list(struct.unpack_from(f"<{n}d", raw, 32))
    if name in ("SIMPLE_PINHOLE", "SIMPLE_RADIAL", "RADIAL"):
        p = [p[0], *p]
    step = {"floor": math.floor, "round": round, "ceil": math.ceil}[rounding]
    fx, fy, cx, cy, *dist = p
    kind = {"SIMPLE_PINHOLE": "PINHOLE", "SIMPLE_RADIAL": "OPENCV", "RADIAL": "OPENCV"}.get(name, name)
    return frames, Camera(
        fx / downscale, fy / downscale, cx / downscale, cy / downscale, step(width / downscale), step(height / downscale), kind, tuple(dist)
    )


def read_manifests(spark: SparkSession, root: str, pattern: str = "*/instances.json") -> DataFrame:
    """One row per mask with its frame and manifest place; no manifest or a missing required key is an error.

    Columns of the mask operators, with frame_stem (the folder) and frame_ordinal (its place among all, by name).
    """
    docs = spark.read.schema(MANIFEST).option("multiLine", True).json(f"{root}/{pattern}").withColumn("_file", F.col("_metadata.file_path"))
    bad = docs.where(
        "frame_index is null or image_path is null or image_size is null or instances is null"
    ).select("_file").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0][0]} lacks a required key")
    docs = docs.withColumn("frame_stem", F.element_at(F.split("_file", "/"), -2))
    order = docs.select("frame_stem").distinct()
    order = numbered(order, ["frame_stem"], "frame_ordinal").withColumn("frame_ordinal", F.col("frame_ordinal").cast("int"))
    flat = docs.join(order, "frame_stem").select(
        "frame_stem", "frame_ordinal", "frame_index", "image_path", F.col("image_size")[0].alias("width"),
        F.col("image_size")[1].alias("height"), F.posexplode("instances").alias("position", "i")
    )
    box = [F.col("i.bbox_xyxy")[k].alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))]
    return flat.select(
        "frame_stem", "frame_ordinal", "frame_index", "image_path", "width", "height", "position", "i.instance_id", "i.label", "i.score",
        "i.detection_score", "i.area", "i.mask_path", *box
    )


def frame_ordinal(frames: DataFrame, stem: str) -> int:
    """Place of a frame folder among all by name; an unknown one is an error."""
    row = frames.where(F.col("frame_stem") == stem).select("frame_ordinal").first()
    if row is None:
        raise ValueError(f"no frame {stem!r}")
    return row[0]


def select_frames(manifests: DataFrame, stems: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """(frame_stem, place): the frames to draw, in the order given or else by name, the first ``limit``.

    A stem that no manifest has is an error. Stems given by hand come as literals.
    """
    every = manifests.select("frame_stem").distinct()
    if stems:
        wanted = manifests.sparkSession.createDataFrame([(s, i) for i, s in enumerate(stems)], "frame_stem string, place int")
        found = {r[0] for r in wanted.join(every, "frame_stem", "left_semi").collect()}  # at most those asked for
        if missing := [s for s in stems if s not in found]:
            raise ValueError(f"no frames {missing}")
    else:
        wanted = numbered(every, ["frame_stem"], "place").withColumn("place", F.col("place").cast("int"))
    return wanted if limit is None else wanted.where(F.col("place") < limit)


def read_mask_pixels(spark: SparkSession, root: str, pattern: str = "*/mask_*.png") -> DataFrame:
    """(frame_stem, mask_name, x, y) of the non-zero pixels of grey images, by Spark's image reader."""
    im = spark.read.format("image").load(f"{root}/{pattern}").select("image.*")
    bytes_ = im.select("origin", "width", "nChannels", F.split(F.hex("data"), "(?<=\\G..)").alias("px"))
    flat = bytes_.select("origin", "width", "nChannels", F.posexplode("px").alias("at", "v")).where("v <> '00' and v <> ''")
    place = F.floor(F.col("at") / F.col("nChannels")).cast("int")
    return flat.select(
        F.element_at(F.split("origin", "/"), -2).alias("frame_stem"), L.base_name("origin").alias("mask_name"),
        (place % F.col("width")).alias("x"), F.floor(place / F.col("width")).cast("int").alias("y")
    ).distinct()


def read_occupancy(spark: SparkSession, image: str, metadata: str) -> tuple[DataFrame, dict]:
    """(px, py, value) and the metadata (scale, upper, lower) of an occupancy map."""
    im = spark.read.format("image").load(image).select("image.*").select("width", F.split(F.hex("data"), "(?<=\\G..)").alias("px"))
    flat = im.select("width", F.posexplode("px").alias("at", "v")).where("v <> ''")
    pixels = flat.select(
        (F.col("at") % F.col("width")).alias("px"), F.floor(F.col("at") / F.col("width")).cast("int").alias("py"),
        F.conv("v", 16, 10).cast("int").alias("value")
    )
    meta = spark.read.schema("scale double, upper array<double>, lower array<double>").option("multiLine", True).json(metadata).first()
    return pixels, meta.asDict()


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(object_id, label, corners, position) of a labels.json: an "objects" document or a bare list, either spelling."""
    one = "struct<instance_id:int,ins_id:string,label:string,bbox:array<array<double>>,bounding_box:array<struct<x:double,y:double,z:double>>>"
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("t"))
    kind = F.when(
        F.col("t").startswith("["), F.from_json("t", f"array<{one}>")
    ).otherwise(F.from_json("t", f"struct<objects:array<{one}>>")["objects"])
    o = text.select(F.posexplode(kind).alias("position", "o"))
    corners = F.coalesce("o.bbox", F.transform("o.bounding_box", lambda p: F.array(p["x"], p["y"], p["z"])))
    return o.select(
        F.coalesce("o.instance_id", F.expr("try_cast(nullif(o.ins_id, '') as int)")).alias("object_id"), F.col("o.label").alias("label"),
        corners.alias("corners"), "position"
    )


SCENE_FILES = ("3dgs_compressed.ply", "labels.json", "occupancy.png", "occupancy.json", "structure.json")


def check_annotated_scene(root: str) -> None:
    """All files of an annotated scene must be there; the error names the missing."""
    if missing := [f for f in SCENE_FILES if not os.path.exists(f"{root}/{f}")]:
        raise FileNotFoundError(f"{root} lacks {', '.join(missing)}")


def read_structure(spark: SparkSession, path: str) -> DataFrame:
    """(room_count, wall_count)."""
    s = spark.read.schema("rooms array<string>, walls array<string>").option("multiLine", True).json(path)
    return s.select(F.coalesce(F.size("rooms"), F.lit(0)).alias("room_count"), F.coalesce(F.size("walls"), F.lit(0)).alias("wall_count"))


def read_groups(spark: SparkSession, path: str, prefer: str = "object_id") -> DataFrame:
    """Group records with object_id by either spelling, the preferred one first; -1 if both are absent."""
    g = spark.read.schema(GROUPS).option("multiLine", True).json(path).select(F.explode("groups").alias("g")).select("g.*")
    other = "global_object_id" if prefer == "object_id" else "object_id"
    return g.withColumn("object_id", L.group_object_id(prefer, other)).drop("global_object_id")


def read_instance_records(spark: SparkSession, path: str) -> DataFrame:
    """Discovered instances of a summary, with class_name: the category and the place in it from 1, two digits.

    The place is rank_in_category, or the instance's number where there is none. No list of instances is an error.
    """
    doc = spark.read.schema(RECORDS).option("multiLine", True).json(path)
    if doc.where("instances is not null").isEmpty():
        raise ValueError(f"{path} holds no list of instances")
    out = doc.select(F.explode("instances").alias("i")).select("i.*")
    return out.withColumn("class_name", L.class_name(F.col("category"), F.coalesce("rank_in_category", "instance_id") + 1))


def read_class_names(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """(class_index, name) of a classes.json: a list of {class_id or id, name}; absent ids up to ``n`` are class_<id>."""
    doc = spark.read.schema("classes array<struct<class_id:int,id:int,name:string>>").option("multiLine", True).json(path)
    got = doc.select(F.explode("classes").alias("c")).select(
        F.coalesce("c.class_id", "c.id").alias("class_index"), F.col("c.name").alias("name")
    )
    if n is None:
        return got
    every = spark.range(n).select(F.col("id").cast("int").alias("class_index"))
    return every.join(got, "class_index", "left").withColumn("name", F.coalesce("name", F.concat(F.lit("class_"), "class_index")))


def list_images(spark: SparkSession, folder: str, limit: int | None = None, done: DataFrame | None = None) -> DataFrame:
    """(path, stem, frame_index) of the images of a folder by name, the first ``limit``; without stems in ``done``."""
    f = spark.read.format("binaryFile").load(folder).select("path").withColumn("stem", L.stem("path")).where(
        F.lower("path").rlike(r"\.(png|jpe?g)$")
    )
    f = numbered(f, ["path"], "frame_index").withColumn("frame_index", F.col("frame_index").cast("int"))
    f = f if limit is None else f.where(F.col("frame_index") < limit)
    return f if done is None else f.join(done.select("stem"), "stem", "left_anti")


def write_json(df: DataFrame, path: str, name: str | None = None, **fields) -> None:
    """Rows as one JSON document {name: [...], **fields}, or a single row as an object, for summaries of bounded size."""
    rows = [json.loads(v) for (v,) in df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).toLocalIterator()]
    body = {**fields, name: rows} if name else {**rows[0], **fields}
    with open(path, "w") as f:
        json.dump(body, f, indent=2)


def _png(width: int, height: int, kind: int, rows: list[bytes]) -> bytes:
    """An 8-bit PNG of colour type ``kind`` from its rows of samples."""
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    head = struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(
        b"IDAT", zlib.compress(b"".join(b"\0" + bytes(r) for r in rows))
    ) + chunk(b"IEND", b"")


def grey_png(width: int, height: int, pixels: list[tuple[int, int]], value: int = 255) -> bytes:
    """An 8-bit grey PNG with the given pixels set."""
    rows = [bytearray(width) for _ in range(height)]
    for x, y in pixels:
        rows[y][x] = value
    return _png(width, height, 0, rows)


def read_color_pixels(spark: SparkSession, path: str) -> DataFrame:
    """(file, x, y, red, green, blue) of every pixel of colour images, by Spark's image reader."""
    im = spark.read.format("image").load(path).select("image.*").where("nChannels = 3")
    flat = im.select(
        L.base_name("origin").alias("file"), "width", F.posexplode(F.split(F.hex("data"), "(?<=\\G.{6})")).alias("at", "v")
    ).where("v <> ''")
    byte = lambda k: F.conv(F.substring("v", k, 2), 16, 10).cast("int")
    return flat.select(
        "file", (F.col("at") % F.col("width")).alias("x"), F.floor(F.col("at") / F.col("width")).cast("int").alias("y"),
        byte(5).alias("red"), byte(3).alias("green"), byte(1).alias("blue")
    )


def write_overlays(pixels: DataFrame, root: str, width: int, height: int, name: str = "overlay") -> None:
    """One colour image a frame from (frame_index, x, y, red, green, blue), black elsewhere, written by the executors.

    A frame's pixels are a task's unit: at most the image.
    """
    import numpy as np

    def run(key, table):
        frame = key[0].as_py()
        image = np.zeros((height, width, 3), np.uint8)
        x, y = (np.asarray(table.column(c)) for c in ("x", "y"))
        for k, c in enumerate(("red", "green", "blue")):
            image[y, x, k] = np.asarray(table.column(c))
        os.makedirs(root, exist_ok=True)
        with open(f"{root}/{name}_{frame:05d}.png", "wb") as f:
            f.write(_png(width, height, 2, [r.tobytes() for r in image]))
        return pa.table({"frame_index": pa.array([frame], pa.int32())})

    cols = [F.col(c).cast("int").alias(c) for c in ("frame_index", "x", "y", "red", "green", "blue")]
    pixels.select(*cols).groupBy("frame_index").applyInArrow(run, "frame_index int").count()


def write_masks(mask_pixels: DataFrame, instances: DataFrame, root: str, width: int, height: int) -> None:
    """Frame folders with mask PNGs and an instances.json each, written by the executors to a shared path.

    instances: frame_index, instance_id, image_path, label, score, area and the box; one frame is a task's unit, and
    its masks together have at most the image's pixels times its instances.
    """
    def run(key, table):
        frame = key[0].as_py()
        folder = f"{root}/frame_{frame:05d}"
        os.makedirs(folder, exist_ok=True)
        listed = []
        for k, r in enumerate(sorted(table.to_pylist(), key=lambda r: r["instance_id"])):
            name = f"mask_{k:04d}.png"
            with open(f"{folder}/{name}", "wb") as f:
                f.write(grey_png(width, height, list(zip(r["xs"], r["ys"], strict=True))))
            listed.append(
                {
                    "instance_id": r["instance_id"], "bbox_xyxy": [r["x0"], r["y0"], r["x1"], r["y1"]], "score": r["score"],
                    "area": r["area"], "mask_path": name, "label": r["label"]
                }
            )
        with open(f"{folder}/instances.json", "w") as f:
            json.dump(
                {
                    "frame_index": frame, "image_path": table.column("image_path")[0].as_py(), "image_size": [width, height],
                    "instances": listed
                },
                f, indent=2
            )
        return pa.table({"frame_index": pa.array([frame], pa.int32()), "masks": pa.array([len(listed)], pa.int32())})

    px = mask_pixels.groupBy("frame_index", "instance_id").agg(F.collect_list("x").alias("xs"), F.collect_list("y").alias("ys"))
    rows = instances.join(px, ["frame_index", "instance_id"]).select(
        "frame_index", "instance_id", "image_path", "label", "score", "area", "x0", "y0", "x1", "y1", "xs", "ys"
    )
    rows.groupBy("frame_index").applyInArrow(run, "frame_index int, masks int").count()
