"""Projection of points into frames and the visibility gates on it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenelake.functions import geometry as G
from scenelake.operators.sampling import sampled
from scenelake.plans.lineage import broadcast_small, cut, few_or_merge


@dataclass(frozen=True)
class Camera:
    fl_x: float
    fl_y: float
    cx: float
    cy: float
    width: int
    height: int
    model: str = "PINHOLE"
    distortion: Sequence[float] = ()


POSE = tuple(f"r{i}{j}" for i in range(3) for j in range(3)) + ("t0", "t1", "t2")


def project_points(points: DataFrame, frames: DataFrame, camera: Camera, *, valid_only: bool = True) -> DataFrame:
    """Every point in every frame: u, v, depth (FLOAT), valid and whole pixels px, py.

    Frames are the small side of the nested loop: a scene has hundreds, points by the million. Up to 100,000 are
    broadcast, and rows out of view go at once. Validity is decided before the cast to FLOAT.
    """
    pair = points.select("gaussian_index", "x", "y", "z").crossJoin(broadcast_small(frames.select("frame_index", *POSE)))
    cam = G.world_to_camera("x", "y", "z", [F.col(c) for c in POSE[:9]], [F.col(c) for c in POSE[9:]])
    u, v = G.project(cam, camera.model, camera.fl_x, camera.fl_y, camera.cx, camera.cy, camera.distortion)
    wide = pair.select("frame_index", "gaussian_index", u.alias("_u"), v.alias("_v"), cam[2].alias("_d"))
    ok = G.in_view(F.col("_u"), F.col("_v"), F.col("_d"), camera.width, camera.height)
    out = wide.where(ok) if valid_only else wide
    out = out.select(
        "frame_index", "gaussian_index", F.col("_u").cast("float").alias("u"), F.col("_v").cast("float").alias("v"),
        F.col("_d").cast("float").alias("depth"), ok.alias("valid")
    )
    px, py = G.pixel("u"), G.pixel("v")
    inside = F.col("valid") & (px < camera.width) & (py < camera.height)
    return out.withColumns({"px": F.when(inside, px.cast("int")), "py": F.when(inside, py.cast("int"))})


def front_depth(projected: DataFrame) -> DataFrame:
    """(frame_index, px, py, front): least depth of the valid points of a pixel."""
    return projected.where("valid and px is not null").groupBy("frame_index", "px", "py").agg(F.min("depth").alias("front"))


def front_surface(projected: DataFrame, margin: float = 0.03) -> DataFrame:
    """Valid points at most ``margin`` behind the front of their pixel.

    A partial minimum per pixel joined back, in place of a window that would sort every point.
    """
    front = front_depth(projected)
    return projected.where("valid").join(front, ["frame_index", "px", "py"]).where(
        F.col("depth") <= F.col("front") + F.lit(margin)
    ).drop("front")


def front_visible(subset: DataFrame, projected: DataFrame, *, margin_ratio: float = 0.05, min_margin: float = 0.03) -> DataFrame:
    """Points of ``subset`` near the front of the full scene, with a margin relative to its depth."""
    near = F.col("depth") <= F.col("front") + F.greatest(F.lit(min_margin), F.abs("front") * margin_ratio)
    return subset.where("valid").join(front_depth(projected), ["frame_index", "px", "py"]).where(near).drop("front")


def front_samples(projected: DataFrame, max_per_frame: int | None = None, seed: int = 42) -> DataFrame:
    """The first point of each pixel by depth, then index; at most so many a frame, in order of the draw."""
    best = projected.where("valid and px is not null").groupBy("frame_index", "px", "py").agg(
        F.min(F.struct("depth", "gaussian_index")).alias("b")
    )
    out = best.select("frame_index", "px", "py", F.col("b.depth").alias("depth"), F.col("b.gaussian_index").alias("gaussian_index"))
    if max_per_frame is None:
        return out
    return sampled(out, max_per_frame, by=["frame_index"], seed=seed)


def affine_fit(pairs: DataFrame, *, trim: float = 0.8, rounds: int = 4, least: int = 32, key: str = "frame_index") -> DataFrame:
    """(key, scale, shift, residual) of target ~ scale * predicted + shift, refitted on the residuals within a quantile.

    pairs: key, predicted, target. Under ``least`` finite rows the fit is (1, 0) with an infinite residual. A
    predicted constant c gives the least-norm answer. Every round judges all rows; a group that keeps too few stops.
    """
    trim = min(1.0, max(0.1, trim))
    rows = cut(
        pairs.where(G.finite("predicted") & G.finite("target")).select(
            key, F.col("predicted").cast("double").alias("x"), F.col("target").cast("double").alias("y")
        )
    )
    state = rows.withColumns({"keep": F.lit(True)})
    fit = None
    for _ in range(rounds):
        kept = state.groupBy(key).agg(
            F.count("*").alias("n"),
            F.count_if("keep").alias("k"),
            F.regr_slope(F.when(F.col("keep"), F.col("y")), F.when(F.col("keep"), F.col("x"))).alias("s"),
            F.regr_intercept(F.when(F.col("keep"), F.col("y")), F.when(F.col("keep"), F.col("x"))).alias("b"),
            F.avg(F.when(F.col("keep"), F.col("x"))).alias("mx"),
            F.avg(F.when(F.col("keep"), F.col("y"))).alias("my"),
        )
        flat = F.col("mx") * F.col("mx") + 1
        now = kept.select(
            key, "n", "k", F.coalesce("s", F.col("mx") * F.col("my") / flat).alias("scale"),
            F.coalesce("b", F.col("my") / flat).alias("shift")
        )
        if fit is not None:  # a group that kept too few keeps its last fit
            old = fit.select(key, F.col("scale").alias("_s"), F.col("shift").alias("_b"))
            stop = F.col("k") < least
            now = now.join(old, key).select(
                key, "n", "k", F.when(stop, F.col("_s")).otherwise(F.col("scale")).alias("scale"),
                F.when(stop, F.col("_b")).otherwise(F.col("shift")).alias("shift")
            )
        fit = cut(now)  # one row a frame; each round is used twice
        judged = rows.join(fit, key).withColumn("res", F.abs(F.col("scale") * F.col("x") + F.col("shift") - F.col("y")))
        limit = judged.groupBy(key).agg(F.percentile("res", F.lit(trim)).alias("limit"), F.median("res").alias("residual"))
        state = judged.join(limit, key).select(key, "x", "y", (F.col("res") <= F.col("limit")).alias("keep"))
        fit = fit.join(limit.select(key, "residual"), key)
    few = F.col("n") < least
    return fit.select(
        key, F.when(few, 1.0).otherwise(F.col("scale")).alias("scale"), F.when(few, 0.0).otherwise(F.col("shift")).alias("shift"),
        F.when(few, float("inf")).otherwise(F.col("residual")).alias("residual")
    )


def depth_behind(projected: DataFrame, depth: DataFrame, fits: DataFrame, *, ratio: float = 0.18, min_margin: float = 0.05) -> DataFrame:
    """Valid points on a depth map with aligned (its fitted depth there) and behind (deeper than that plus a margin).

    depth: frame_index, px, py, d. Frames without a fit count as (1, 0).
    """
    at = projected.where("valid").join(
        depth.select("frame_index", "px", "py", "d"), ["frame_index", "px", "py"]
    ).join(fits.select("frame_index", "scale", "shift"), "frame_index", "left")
    aligned = F.coalesce("scale", F.lit(1.0)) * F.col("d") + F.coalesce("shift", F.lit(0.0))
    limit = aligned + F.greatest(F.lit(min_margin), F.abs(aligned) * ratio)
    return at.select(*projected.columns, aligned.alias("aligned"), (F.col("depth") > limit).alias("behind"))


def depth_consistent(
    projected: DataFrame, depth: DataFrame, *, max_samples: int = 30_000, trim: float = 0.8, ratio: float = 0.18, min_margin: float = 0.05
) -> DataFrame:
    """Valid points that are not behind the fitted depth map of their frame."""
    front = front_samples(projected, max_samples).join(depth, ["frame_index", "px", "py"]).select(
        "frame_index", F.col("d").alias("predicted"), F.col("depth").alias("target")
    )
    return depth_behind(
        projected, depth, affine_fit(front, trim=trim), ratio=ratio, min_margin=min_margin
    ).where("not behind").drop("aligned", "behind")


def depth_outliers(behind: DataFrame, *, min_observed: int = 3, threshold: float = 0.6) -> DataFrame:
    """(gaussian_index, observed, behind_count, behind_ratio) of points mostly behind the depth maps."""
    n = behind.groupBy("gaussian_index").agg(F.count("*").alias("observed"), F.count_if("behind").alias("behind_count"))
    ratio = F.col("behind_count") / F.col("observed")
    return n.withColumn("behind_ratio", ratio).where((F.col("observed") >= min_observed) & (ratio >= threshold))


def visible_counts(projected: DataFrame, points: DataFrame) -> DataFrame:
    """(gaussian_index, visible, in_front) of every point; ``projected`` must hold invalid rows too for in_front."""
    n = projected.groupBy("gaussian_index").agg(F.count_if("valid").alias("visible"), F.count_if(F.col("depth") > 0).alias("in_front"))
    return points.select("gaussian_index").join(n, "gaussian_index", "left").fillna(0, ["visible", "in_front"])


def camera_distance(points: DataFrame, frames: DataFrame) -> DataFrame:
    """(gaussian_index, camera_distance): distance to the nearest camera centre -R^T t, frames broadcast if few."""
    centre = [-(F.col(f"r0{i}") * F.col("t0") + F.col(f"r1{i}") * F.col("t1") + F.col(f"r2{i}") * F.col("t2")) for i in range(3)]
    c = frames.select(*[e.alias(f"c{i}") for i, e in enumerate(centre)])
    d = G.norm(*(F.col(p).cast("double") - F.col(f"c{i}") for i, p in enumerate("xyz")))
    return points.select("gaussian_index", "x", "y", "z").crossJoin(broadcast_small(c)).groupBy("gaussian_index").agg(
        F.min(d).alias("camera_distance")
    )


def best_frame(projected: DataFrame, ids: DataFrame, frames: DataFrame) -> DataFrame:
    """(object_id, frame_index, visible): the frame that sees most of an object, the earliest of equals, 0 allowed."""
    seen = projected.where("valid").join(
        ids.where("object_id >= 0"), "gaussian_index"
    ).groupBy("object_id", "frame_index").agg(F.count("*").alias("n"))
    grid = ids.where("object_id >= 0").select("object_id").distinct().crossJoin(broadcast_small(frames.select("frame_index")))
    full = grid.join(seen, ["object_id", "frame_index"], "left").fillna(0, ["n"])
    best = full.groupBy("object_id").agg(F.max(F.struct("n", (-F.col("frame_index")).alias("f"))).alias("b"))
    return best.select("object_id", (-F.col("b.f")).alias("frame_index"), F.col("b.n").alias("visible"))


def on_masks(rows: DataFrame, mask_pixels: DataFrame) -> DataFrame:
    """``rows`` of points or pixels (frame_index, px, py) once for each mask that holds their pixel.

    A merge join by hint: pixels are exploded from boxes or images of a few bytes, and the planner, which takes them
    for as small, would send them all through the driver.
    """
    on = mask_pixels.withColumnsRenamed({"x": "px", "y": "py"})
    return rows.join(on.hint("merge"), ["frame_index", "px", "py"])


def mask_hits(projected: DataFrame, mask_pixels: DataFrame) -> DataFrame:
    """(frame_index, instance_id, gaussian_index): valid points on a mask's pixels."""
    seen = projected.where("valid and px is not null").select("frame_index", "px", "py", "gaussian_index")
    return on_masks(seen, mask_pixels.select("frame_index", "instance_id", "x", "y")).select(
        "frame_index", "instance_id", "gaussian_index"
    )


def mask_counts(owned: DataFrame, mask_pixels: DataFrame, by: str) -> DataFrame:
    """(by, frame_index, instance_id, hits): how many valid points of each group are on each mask.

    owned: projected points with the group ``by``, which may be null. Points of one group and pixel are counted before
    they meet the masks, so the work follows groups, pixels and masks, not the hits.
    """
    n = owned.where("valid and px is not null").groupBy(by, "frame_index", "px", "py").agg(F.count("*").alias("n"))
    return on_masks(n, mask_pixels.select("frame_index", "instance_id", "x", "y")).groupBy(
        by, "frame_index", "instance_id"
    ).agg(F.sum("n").alias("hits"))


def frame_votes(hits: DataFrame, instances: DataFrame, *, opacity: DataFrame | None = None, quality: DataFrame | None = None) -> DataFrame:
    """Votes of mask hits: score, times opacity alpha and point quality where given. Invalid points (valid false) have no vote.

    Inner joins drop frames without a manifest and points without a row in ``quality``.
    """
    w = F.coalesce("score", F.lit(0.0))
    out = hits.join(instances.select("frame_index", "instance_id", "score"), ["frame_index", "instance_id"])
    if opacity is not None:
        out = out.join(opacity.select("gaussian_index", "alpha"), "gaussian_index")
        w = w * F.col("alpha")
    if quality is not None:
        q = quality.where("valid") if "valid" in quality.columns else quality
        out = out.join(q.select("gaussian_index", "quality"), "gaussian_index")
        w = w * F.col("quality")
    return out.select("frame_index", "instance_id", "gaussian_index", w.cast("float").alias("weight"))


def mask_votes(
    projected: DataFrame, mask_pixels: DataFrame, instances: DataFrame, *, opacity: DataFrame | None = None, quality: DataFrame | None = None
) -> DataFrame:
    """``frame_votes`` of ``mask_hits``, with the factors joined to masks and points before these meet.

    A point hits many masks, and hits are far more than points and pixels: they are put out as they arise, never shuffled.
    """
    seen, w = projected.where("valid and px is not null").select("frame_index", "px", "py", "gaussian_index"), F.coalesce("score", F.lit(0.0))
    if opacity is not None:
        seen = seen.join(opacity.select("gaussian_index", "alpha").hint("merge"), "gaussian_index")
        w = w * F.col("alpha")
    if quality is not None:
        q = quality.where("valid") if "valid" in quality.columns else quality
        seen = seen.join(q.select("gaussian_index", "quality").hint("merge"), "gaussian_index")
        w = w * F.col("quality")
    scored = mask_pixels.select("frame_index", "instance_id", "x", "y").join(
        few_or_merge(instances.select("frame_index", "instance_id", "score")), ["frame_index", "instance_id"]
    )
    return on_masks(seen, scored).select("frame_index", "instance_id", "gaussian_index", w.cast("float").alias("weight"))


def covered(projected: DataFrame, mask_pixels: DataFrame) -> DataFrame:
    """(frame_index, gaussian_index): valid points on the pixels of any mask, once for all masks there."""
    pix = mask_pixels.select("frame_index", F.col("x").alias("px"), F.col("y").alias("py")).distinct()
    return projected.where("valid and px is not null").join(pix.hint("merge"), ["frame_index", "px", "py"], "left_semi").select(
        "frame_index", "gaussian_index"
    )


def background_support(projected: DataFrame, hits: DataFrame) -> DataFrame:
    """(gaussian_index, background): frames that see a point outside all masks. hits: from ``covered``, or ``mask_hits``."""
    return projected.where("valid").join(
        hits.select("frame_index", "gaussian_index").distinct().hint("merge"), ["frame_index", "gaussian_index"], "left_anti"
    ).groupBy("gaussian_index").agg(F.count("*").alias("background"))
