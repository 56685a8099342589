"""Command line: each command reads files, runs one flow of operators and writes its results.

    python -m scenelake.cli COMMAND --option value ...

Options are the arguments of the functions below: without a default they are required, a false default makes a flag, tuples take
several values. Tables are written as Parquet folders beside the JSON summaries; point tables as PLY.
"""

from __future__ import annotations

import argparse
import inspect
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenelake.functions import color as C
from scenelake.functions import geometry as G
from scenelake.functions import labels as L
from scenelake.operators import editing, evaluation, learning, masks, quality, sampling, spatial, visibility, voting
from scenelake.plans.lineage import few_or_merge
from scenelake.sources import arrays, ply, scenes

COMMANDS: dict = {}
CATEGORY_NAMES = tuple(n for n, _ in L.CATEGORIES)


def command(f):
    COMMANDS[f.__name__.replace("_", "-")] = f
    return f


def _scene(spark, root, scene_format="nerfstudio", downscale_factor=1, downscale_rounding_mode="floor", colmap_path="colmap/sparse/0"):
    """Frames and camera of a data set in either format."""
    if scene_format == "nerfstudio":
        return scenes.read_transforms(spark, f"{root}/transforms.json")
    if scene_format == "colmap":
        return scenes.read_colmap_scene(spark, f"{root}/{colmap_path}", downscale_factor, downscale_rounding_mode)
    raise ValueError(f"unknown scene format {scene_format!r}")


def _masks(spark, root, max_frames=None):
    """Mask instances and their pixels, keyed by frame index."""
    inst = scenes.read_manifests(spark, root)
    if max_frames is not None:
        inst = inst.where(F.col("frame_ordinal") < max_frames)
    names = inst.select("frame_stem", L.base_name("mask_path").alias("mask_name"), "frame_index", "instance_id")
    return inst, scenes.read_mask_pixels(spark, root).join(few_or_merge(names), ["frame_stem", "mask_name"]).select(
        "frame_index", "instance_id", "x", "y"
    )


def _depth(spark, root, frames):
    """Depth maps <root>/<frame stem>/depth.npy of the frames that have one; the frame list is bounded by the capture."""
    out = None
    for r in frames.select("frame_index", L.stem("file_path").alias("stem")).collect():
        path = f"{root}/{r['stem']}/depth.npy"
        if os.path.exists(path):
            d = arrays.read_depth(spark, path, r["frame_index"])
            out = d if out is None else out.unionByName(d)
    return out


def _ids(spark, path, name="object_id"):
    return arrays.read_npy(spark, path, name)


def _labelled_table(spark, ply_path, object_ids):
    return ply.read_ply(spark, ply_path).join(_ids(spark, object_ids), "gaussian_index")


def _write_table(table, source, path):
    """A point table with the properties of the PLY it came from."""
    ply.write_ply(table, path, list(ply.read_header(source).properties))


def _gated(
    projected, depth=None, front_surface_only=False, front_surface_depth_margin=0.03, samples=30_000, trim=0.8, ratio=0.18, margin=0.05
):
    """Both gates judge the ungated points and are then combined."""
    out = projected.where("valid")
    if front_surface_only:
        out = out.join(
            visibility.front_surface(projected, front_surface_depth_margin).select("frame_index", "gaussian_index"),
            ["frame_index", "gaussian_index"], "left_semi"
        )
    if depth is not None:
        covered = depth.select("frame_index").distinct()
        good = visibility.depth_consistent(
            projected, depth, max_samples=samples, trim=trim, ratio=ratio, min_margin=margin
        ).select("frame_index", "gaussian_index")
        free = projected.where("valid").join(covered, "frame_index", "left_anti").select("frame_index", "gaussian_index")
        out = out.join(good.union(free), ["frame_index", "gaussian_index"], "left_semi")
    return out


def _votes(spark, points, frames, camera, inst, pixels, *, opacity=False, quality_scores=None, **gates):
    seen = _gated(
        visibility.project_points(points, frames.join(inst.select("frame_index").distinct(), "frame_index", "left_semi"), camera), **gates
    )
    alpha = points.select("gaussian_index", C.sigmoid("opacity").alias("alpha")) if opacity else None
    return visibility.mask_votes(seen, pixels, inst, opacity=alpha, quality=quality_scores)


@command
def lift_masks(
    spark: SparkSession, *, dataset_root: str, ply_path: str, masks_root: str, output_root: str, max_frames: int | None = None,
    max_gaussians: int | None = None, use_opacity_weight: bool = False, gaussian_quality_path: str | None = None,
    valid_gaussian_mask_path: str | None = None, depth_root: str | None = None, depth_fit_max_points: int = 30_000,
    depth_trim_quantile: float = 0.8, depth_behind_margin_ratio: float = 0.18, depth_behind_min_margin: float = 0.05,
    front_surface_only: bool = False, front_surface_depth_margin: float = 0.03, scene_format: str = "nerfstudio"
) -> None:
    """Votes of 2D masks for points."""
    frames, camera = _scene(spark, dataset_root, scene_format)
    points = ply.cloud(ply.read_ply(spark, ply_path))
    if max_gaussians is not None:
        points = points.where(F.col("gaussian_index") < max_gaussians)
    if valid_gaussian_mask_path:
        points = points.join(arrays.read_npy(spark, valid_gaussian_mask_path).where("value"), "gaussian_index", "left_semi")
    q = arrays.read_npy(spark, gaussian_quality_path, "quality") if gaussian_quality_path else None
    inst, pixels = _masks(spark, masks_root, max_frames)
    depth = _depth(spark, depth_root, frames) if depth_root else None
    votes = _votes(
        spark, points, frames, camera, inst, pixels, opacity=use_opacity_weight, quality_scores=q, depth=depth,
        front_surface_only=front_surface_only, front_surface_depth_margin=front_surface_depth_margin, samples=depth_fit_max_points,
        trim=depth_trim_quantile, ratio=depth_behind_margin_ratio, margin=depth_behind_min_margin
    )
    votes.write.mode("overwrite").parquet(f"{output_root}/votes")
    scenes.write_json(voting.vote_summary(spark.read.parquet(f"{output_root}/votes"), points), f"{output_root}/vote_summary.json")


@command
def associate_instances(
    spark: SparkSession, *, vote_evidence: str, output_root: str, max_frame_gap: int = 1, min_shared_gaussians: int = 32,
    min_overlap_ratio: float = 0.1, min_support_size: int = 1, max_support_size: int | None = None, masks_root: str | None = None,
    require_same_label_family: bool = False
) -> None:
    """Object ids of instances across frames."""
    votes = arrays.read_votes(spark, vote_evidence)
    inst = voting.local_instances(votes)
    if masks_root:
        names = scenes.read_manifests(spark, masks_root).select("frame_index", "instance_id", "label")
        inst = inst.join(names, ["frame_index", "instance_id"], "left").withColumn("label_family", L.family("label"))
    ok = (F.col("support_size") >= min_support_size) & (
        F.lit(True) if max_support_size is None else F.col("support_size") <= max_support_size
    )
    pairs = voting.instance_overlap(
        votes, inst.where(ok), max_frame_gap=max_frame_gap, min_shared=min_shared_gaussians, min_ratio=min_overlap_ratio,
        same_family=require_same_label_family
    )
    pairs.write.mode("overwrite").parquet(f"{output_root}/association_edges")
    voting.global_objects(
        inst, spark.read.parquet(f"{output_root}/association_edges"), ok
    ).write.mode("overwrite").parquet(f"{output_root}/instances")


@command
def build_groups(
    spark: SparkSession, *, vote_evidence: str, instances: str, ply_path: str, output_root: str, min_vote_weight: float = 1e-4
) -> None:
    """Points to objects, and object summaries."""
    votes, inst, points = arrays.read_votes(spark, vote_evidence), spark.read.parquet(instances), ply.cloud(ply.read_ply(spark, ply_path))
    voting.assign_objects(votes, inst, points, min_vote_weight).write.mode("overwrite").parquet(f"{output_root}/object_ids")
    ids = spark.read.parquet(f"{output_root}/object_ids")
    arrays.write_npy(ids, f"{output_root}/gaussian_object_ids.npy", "object_id")
    scenes.write_json(voting.group_summary(ids, points, votes, inst), f"{output_root}/gaussian_groups.json", "groups")


@command
def discover_proposals(
    spark: SparkSession, *, dataset_root: str, ply_path: str, masks_root: str, output_root: str, label_regex: str = L.FURNITURE,
    min_score: float = 0.25, min_area_ratio: float = 0.001, max_area_ratio: float = 0.45, max_frames: int | None = None,
    use_opacity_weight: bool = False, depth_root: str | None = None, front_surface_only: bool = False,
    front_surface_depth_margin: float = 0.03, max_frame_gap: int = 3, min_shared_gaussians: int = 96, min_overlap_ratio: float = 0.08,
    min_support_size: int = 64, max_support_size: int | None = None, min_proposal_gaussians: int = 512, min_proposal_frames: int = 2,
    highlight_top_k: int = 24, dim_opacity_scale: float = 0.35, allow_cross_family: bool = False, scene_format: str = "nerfstudio"
) -> None:
    """Labelled object proposals in one go, and a PLY that shows the largest."""
    frames, camera = _scene(spark, dataset_root, scene_format)
    table = ply.read_ply(spark, ply_path)
    points = ply.cloud(table)
    inst, pixels = _masks(spark, masks_root, max_frames)
    kept = masks.proposal_filter(inst, label_regex, min_score, min_area_ratio, max_area_ratio)
    depth = _depth(spark, depth_root, frames) if depth_root else None
    _votes(
        spark, points, frames, camera, kept, pixels, opacity=use_opacity_weight, depth=depth, front_surface_only=front_surface_only,
        front_surface_depth_margin=front_surface_depth_margin
    ).write.mode("overwrite").parquet(f"{output_root}/votes")
    votes = spark.read.parquet(f"{output_root}/votes")
    local = voting.local_instances(votes).join(
        kept.select("frame_index", "instance_id", "label", "label_family"), ["frame_index", "instance_id"], "left"
    )
    ok = (F.col("support_size") >= min_support_size) & (
        F.lit(True) if max_support_size is None else F.col("support_size") <= max_support_size
    )
    pairs = voting.instance_overlap(
        votes, local.where(ok), max_frame_gap=max_frame_gap, min_shared=min_shared_gaussians, min_ratio=min_overlap_ratio,
        same_family=not allow_cross_family
    )
    voting.global_objects(local, pairs, ok).write.mode("overwrite").parquet(f"{output_root}/instances")
    obj = spark.read.parquet(f"{output_root}/instances")
    voting.assign_objects(votes, obj, points).write.mode("overwrite").parquet(f"{output_root}/object_ids")
    ids = spark.read.parquet(f"{output_root}/object_ids")
    top = voting.top_proposals(voting.proposals(ids, points, votes, obj), highlight_top_k, min_proposal_gaussians, min_proposal_frames)
    scenes.write_json(top, f"{output_root}/object_proposals.json", "proposals")
    shown = ids.join(top.select("object_id", F.lit(True).alias("_on")), "object_id", "left")
    out = C.highlight(
        table.join(shown, "gaussian_index"), F.col("_on"), C.palette("object_id"), dim_scale=dim_opacity_scale
    ).drop("_on", "object_id")
    _write_table(out, ply_path, f"{output_root}/object_proposals.ply")


@command
def discover_category_instances(
    spark: SparkSession, *, dataset_root: str, ply_path: str, masks_root: str, output_root: str,
    include_categories: tuple[str, ...] = CATEGORY_NAMES, min_mask_score: float = 0.25, min_area_ratio: float = 0.001,
    max_area_ratio: float = 0.45, max_frames: int | None = None, use_opacity_weight: bool = False, depth_root: str | None = None,
    front_surface_only: bool = False, front_surface_depth_margin: float = 0.03, min_vote_weight: float = 0.5, min_support_count: int = 2,
    min_foreground_ratio: float = 0.0, voxel_size: float = 0.035, min_voxel_count: int = 2, min_gaussians: int = 500,
    max_instances_per_category: int = 0, scene_format: str = "nerfstudio"
) -> None:
    """Category instances without training: votes by category, thresholds, voxel components."""
    frames, camera = _scene(spark, dataset_root, scene_format)
    points = ply.cloud(ply.read_ply(spark, ply_path))
    inst, pixels = _masks(spark, masks_root, max_frames)
    specs = [s for s in L.CATEGORIES if s[0] in include_categories]
    kept = masks.category_filter(inst, specs, min_mask_score, min_area_ratio, max_area_ratio)
    gates = {
        "depth": _depth(spark, depth_root, frames) if depth_root else None, "front_surface_only": front_surface_only,
        "front_surface_depth_margin": front_surface_depth_margin
    }
    votes = voting.category_votes(_votes(spark, points, frames, camera, kept, pixels, opacity=use_opacity_weight, **gates), kept)
    background = None
    if min_foreground_ratio > 0:
        seen = _gated(visibility.project_points(points, frames, camera), **gates)
        background = visibility.background_support(
            seen,
            visibility.mask_hits(seen, pixels.join(kept.select("frame_index", "instance_id"), ["frame_index", "instance_id"], "left_semi"))
        )
    best = spatial.best_category(
        votes, min_weight=min_vote_weight, min_support=min_support_count, min_foreground=min_foreground_ratio, background=background
    )
    named = spatial.category_instances(
        best, points, voxel_size, min_voxel_count=min_voxel_count, min_points=min_gaussians, top_k=max_instances_per_category
    )
    named.write.mode("overwrite").parquet(f"{output_root}/instances")
    named = spark.read.parquet(f"{output_root}/instances")
    arrays.write_npy(named, f"{output_root}/gaussian_instance_ids.npy", "instance_id")
    stats = spatial.instance_stats(
        named.join(best.select("gaussian_index", "weight", "support"), "gaussian_index", "left"), ["weight", "support"]
    )
    names = named.where("instance_id >= 0").select("instance_id", "category").distinct().withColumn(
        "category_name", F.element_at(F.array(*[F.lit(n) for n, _ in specs]), F.col("category") + 1)
    )
    scenes.write_json(
        stats.join(names, "instance_id").join(voting.object_geometry(named, points, "instance_id").drop("gaussian_count"), "instance_id"),
        f"{output_root}/category_instances.json", "instances"
    )


@command
def build_clusters(
    spark: SparkSession, *, ply_path: str, output_root: str, voxel_size: float = 0.04, min_voxel_count: int = 1, min_gaussians: int = 100,
    max_gaussians: int | None = None, max_bbox_diag: float | None = None
) -> None:
    """Voxel components of all points by size."""
    points = ply.cloud(ply.read_ply(spark, ply_path))
    ranked = spatial.rank_components(
        spatial.point_components(points, voxel_size, min_voxel_count=min_voxel_count), min_points=min_gaussians, max_points=max_gaussians
    )
    ids = ranked.select("gaussian_index", F.col("rank").alias("component"))
    if max_bbox_diag is not None:
        cut = spatial.within_diagonal(ids, spatial.cluster_summary(ids, points, voxel_size), max_bbox_diag)
        ids = spatial.rank_components(cut).select("gaussian_index", F.col("rank").alias("component"))
    ids.write.mode("overwrite").parquet(f"{output_root}/cluster_ids")
    ids = spark.read.parquet(f"{output_root}/cluster_ids")
    arrays.write_npy(ids, f"{output_root}/gaussian_cluster_ids.npy", "component")
    scenes.write_json(spatial.cluster_summary(ids, points, voxel_size), f"{output_root}/clusters.json", "clusters")


@command
def score_clusters(
    spark: SparkSession, *, dataset_root: str, ply_path: str, cluster_ids: str, masks_root: str, output_root: str, frame_stride: int = 4,
    max_points_per_cluster: int = 5000, min_visible_points: int = 16, min_hit_points: int = 8, min_hit_ratio: float = 0.02,
    visibility_gate: bool = False, visibility_margin_ratio: float = 0.05, visibility_min_margin: float = 0.03,
    candidate_min_family_purity: float = 0.6, candidate_max_secondary_family_ratio: float = 0.4, panel_min_diag: float = 0.7,
    panel_min_axis_ratio: float = 0.45, panel_mid_axis_ratio: float = 0.75, scene_format: str = "nerfstudio"
) -> None:
    """Labels and plausibility of clusters from the masks that cover them."""
    from pyspark.sql import Window

    frames, camera = _scene(spark, dataset_root, scene_format)
    frames = frames.where(F.col("frame_index") % frame_stride == 0)
    points = ply.cloud(ply.read_ply(spark, ply_path))
    clusters = _ids(spark, cluster_ids, "cluster_id").where("cluster_id >= 0")
    draw = Window.partitionBy("cluster_id").orderBy(F.xxhash64("gaussian_index", F.lit(42)), "gaussian_index")
    some = clusters.withColumn("_r", F.row_number().over(draw)).where(F.col("_r") <= max_points_per_cluster).drop("_r")
    seen = visibility.project_points(points.join(some, "gaussian_index", "left_semi"), frames, camera)
    if visibility_gate:
        seen = visibility.front_visible(
            seen, visibility.project_points(points, frames, camera), margin_ratio=visibility_margin_ratio, min_margin=visibility_min_margin
        )
    inst, pixels = _masks(spark, masks_root)
    masks.cluster_hits(
        seen, some, pixels, inst, min_visible=min_visible_points, min_hits=min_hit_points, min_ratio=min_hit_ratio
    ).write.mode("overwrite").parquet(f"{output_root}/cluster_hits")
    hits = spark.read.parquet(f"{output_root}/cluster_hits")
    fam = masks.cluster_scores(hits, "family")
    box = voting.object_geometry(clusters, points, "cluster_id")
    d = [F.col(f"max_{c}") - F.col(f"min_{c}") for c in "xyz"]
    tags = box.select(
        "cluster_id",
        L.geometry_tags(
            *d, G.norm(*(e.cast("double") for e in d)), min_diag=panel_min_diag, min_axis=panel_min_axis_ratio,
            mid_axis=panel_mid_axis_ratio
        ).alias("tags")
    )
    out = masks.decisions(fam, tags, min_purity=candidate_min_family_purity, max_secondary=candidate_max_secondary_family_ratio)
    ranked = masks.ranked_clusters(fam, box)
    scenes.write_json(out.join(ranked, "cluster_id").orderBy("rank").drop("rank"), f"{output_root}/cluster_scores.json", "clusters")


@command
def build_quality(
    spark: SparkSession, *, ply_path: str, output_root: str, opacity_alpha_floor: float = 0.05, opacity_logit_threshold: float = -5.0,
    scale_norm_percentile: float = 99.5, radius_percentile: float = 99.9, voxel_size: float | None = None,
    isolated_min_neighbor_count: int = 2, keep_isolated: bool = False, keep_low_opacity: bool = False, keep_extreme_scales: bool = False,
    remove_radius_outliers: bool = False
) -> None:
    """Quality scores, valid mask and noise report."""
    points = ply.cloud(ply.read_ply(spark, ply_path))
    size = voxel_size or quality.inferred_voxel(points)
    q = quality.quality_scores(
        points, quality.QualitySpec(opacity_alpha_floor, scale_norm_percentile, radius_percentile, size, isolated_min_neighbor_count)
    )
    k = quality.prune_mask(
        points,
        quality.PruneSpec(
            opacity_logit_threshold, scale_norm_percentile, radius_percentile, 1.0, size, isolated_min_neighbor_count, not keep_low_opacity,
            not keep_extreme_scales, not keep_isolated, remove_radius_outliers
        )
    )
    arrays.write_npy(q, f"{output_root}/gaussian_quality.npy", "quality", dtype="<f4")
    arrays.write_npy(k, f"{output_root}/valid_gaussian_mask.npy", "keep", dtype="?")
    scenes.write_json(
        quality.noise_report(
            points, opacity_logit=opacity_logit_threshold, scale_percentile=scale_norm_percentile, voxel_size=size,
            min_neighbours=isolated_min_neighbor_count
        ),
        f"{output_root}/quality_report.json"
    )


@command
def prune_noise(
    spark: SparkSession, *, ply_path: str, output_ply: str, sidecar_path: str | None = None, output_sidecar: str | None = None,
    opacity_logit_threshold: float = -5.0, scale_norm_percentile: float = 99.5, radius_percentile: float = 99.9,
    radius_multiplier: float = 1.0, voxel_size: float | None = None, isolated_min_neighbor_count: int = 2,
    keep_radius_outliers: bool = False, keep_isolated: bool = False, keep_low_opacity: bool = False, keep_extreme_scales: bool = False
) -> None:
    """The point table without noise, and a side file cut alike."""
    table = ply.read_ply(spark, ply_path)
    keep = quality.prune_mask(
        ply.cloud(table),
        quality.PruneSpec(
            opacity_logit_threshold, scale_norm_percentile, radius_percentile, radius_multiplier, voxel_size, isolated_min_neighbor_count,
            not keep_low_opacity, not keep_extreme_scales, not keep_isolated, not keep_radius_outliers
        )
    )
    _write_table(table.join(keep.where("keep"), "gaussian_index", "left_semi"), ply_path, output_ply)
    if sidecar_path and output_sidecar:
        arrays.write_npy(quality.filter_sidecar(_ids(spark, sidecar_path), keep), output_sidecar, "object_id")


@command
def diagnose_noise(
    spark: SparkSession, *, ply_path: str, output_json: str, opacity_logit_threshold: float = -5.0, scale_norm_percentile: float = 99.5,
    voxel_size: float | None = None, isolated_min_neighbor_count: int = 2
) -> None:
    """Counts and quantiles of suspicious points."""
    scenes.write_json(
        quality.noise_report(
            ply.cloud(ply.read_ply(spark, ply_path)), opacity_logit=opacity_logit_threshold, scale_percentile=scale_norm_percentile,
            voxel_size=voxel_size, min_neighbours=isolated_min_neighbor_count
        ),
        output_json
    )


@command
def diagnose_scene_bounds(
    spark: SparkSession, *, ply_path: str, dataset_root: str, output_root: str, frame_stride: int = 4, min_visible_frames: int = 2,
    radius_percentile: float = 99.5, camera_distance_percentile: float = 99.5, disable_noise_prune: bool = False,
    opacity_logit_threshold: float = -5.0, scale_norm_percentile: float = 99.5, keep_isolated: bool = False,
    write_cleaned_ply: bool = False, scene_format: str = "nerfstudio"
) -> None:
    """Points far out that hardly any camera sees."""
    frames, camera = _scene(spark, dataset_root, scene_format)
    table = ply.read_ply(spark, ply_path)
    points = ply.cloud(table)
    some = frames.where(F.col("frame_index") % frame_stride == 0)
    keep = quality.prune_mask(
        points, quality.PruneSpec(opacity_logit=opacity_logit_threshold, scale_percentile=scale_norm_percentile, isolated=not keep_isolated)
    )
    counts = visibility.visible_counts(visibility.project_points(points, some, camera), points)
    out = quality.scene_bounds(
        points, counts, visibility.camera_distance(points, frames), keep, min_visible=min_visible_frames,
        radius_percentile=radius_percentile, distance_percentile=camera_distance_percentile, noise=not disable_noise_prune
    )
    out.write.mode("overwrite").parquet(f"{output_root}/removed")
    if write_cleaned_ply:
        gone = spark.read.parquet(f"{output_root}/removed").where("removed")
        _write_table(table.join(gone, "gaussian_index", "left_anti"), ply_path, f"{output_root}/cleaned.ply")


@command
def diagnose_depth(
    spark: SparkSession, *, ply_path: str, dataset_root: str, depth_root: str, output_root: str, frame_stride: int = 8,
    limit_frames: int | None = None, fit_max_points: int = 30_000, trim_quantile: float = 0.8, behind_margin_ratio: float = 0.2,
    behind_min_margin: float = 0.05, min_observed_frames: int = 3, behind_ratio_threshold: float = 0.6, write_cleaned_ply: bool = False,
    scene_format: str = "nerfstudio"
) -> None:
    """Points that lie behind the depth maps of most frames."""
    frames, camera = _scene(spark, dataset_root, scene_format)
    frames = frames.where(F.col("frame_index") % frame_stride == 0)
    if limit_frames is not None:
        frames = frames.where(F.col("frame_index") < limit_frames * frame_stride)
    table = ply.read_ply(spark, ply_path)
    depth = _depth(spark, depth_root, frames)
    seen = visibility.project_points(ply.cloud(table), frames, camera)
    front = visibility.front_samples(seen, fit_max_points).join(depth, ["frame_index", "px", "py"]).select(
        "frame_index", F.col("d").alias("predicted"), F.col("depth").alias("target")
    )
    behind = visibility.depth_behind(
        seen, depth, visibility.affine_fit(front, trim=trim_quantile), ratio=behind_margin_ratio, min_margin=behind_min_margin
    )
    visibility.depth_outliers(
        behind, min_observed=min_observed_frames, threshold=behind_ratio_threshold
    ).write.mode("overwrite").parquet(f"{output_root}/inconsistent")
    if write_cleaned_ply:
        _write_table(
            table.join(spark.read.parquet(f"{output_root}/inconsistent"), "gaussian_index", "left_anti"), ply_path,
            f"{output_root}/cleaned.ply"
        )


@command
def evaluate_groups(
    spark: SparkSession, *, gt_object_ids: str, pred_object_ids: str, output_json: str, gt_groups_json: str | None = None,
    min_iou: float = 0.1
) -> None:
    """Matching metrics, overall and by label."""
    ids = _ids(spark, gt_object_ids, "gt").join(_ids(spark, pred_object_ids, "pred"), "gaussian_index")
    m = evaluation.greedy_match(evaluation.iou_pairs(ids, min_iou))
    extra = {}
    if gt_groups_json:
        labels = scenes.read_groups(spark, gt_groups_json).select(F.col("object_id").alias("gt"), "label")
        extra["per_label"] = [r.asDict() for r in evaluation.label_metrics(labels, m).orderBy("label").collect()]  # one row a label
    scenes.write_json(evaluation.metrics(ids, m), output_json, **extra)


@command
def compare_groups(
    spark: SparkSession, *, ply_path: str, gt_object_ids: str, pred_object_ids: str, output_path: str, output_json: str | None = None,
    min_iou: float = 0.5, background_opacity_scale: float = 0.35
) -> None:
    """A PLY coloured by agreement."""
    ids = _ids(spark, gt_object_ids, "gt").join(_ids(spark, pred_object_ids, "pred"), "gaussian_index")
    codes = evaluation.agreement(ids, evaluation.greedy_match(evaluation.iou_pairs(ids, min_iou)))
    out = C.highlight(
        ply.read_ply(spark, ply_path).join(codes, "gaussian_index"), F.col("code") > 0, C.palette("code"),
        dim_scale=background_opacity_scale
    ).drop("code")
    _write_table(out, ply_path, output_path)
    if output_json:
        scenes.write_json(evaluation.agreement_counts(codes), output_json, "classes")


@command
def build_annotated_groups(
    spark: SparkSession, *, scene_root: str, output_root: str, ply_path: str | None = None, epsilon: float = 1e-4
) -> None:
    """Points to annotated boxes."""
    points = ply.cloud(ply.read_ply(spark, ply_path or f"{scene_root}/3dgs_compressed.ply"))
    notes = scenes.read_annotations(spark, f"{scene_root}/labels.json").where("object_id is not null")
    ids = spatial.assign_boxes(points, spatial.box_frames(notes), epsilon)
    ids.write.mode("overwrite").parquet(f"{output_root}/object_ids")
    ids = spark.read.parquet(f"{output_root}/object_ids")
    arrays.write_npy(ids, f"{output_root}/gaussian_object_ids.npy", "object_id")
    scenes.write_json(
        voting.object_geometry(ids, points).join(notes.select("object_id", "label").distinct(), "object_id", "left"),
        f"{output_root}/gaussian_groups.json", "groups"
    )


@command
def inspect_annotated_scene(spark: SparkSession, *, scene_root: str, output_json: str, top_k_labels: int = 10) -> None:
    """Object, room and wall counts and the most common labels."""
    scenes.check_annotated_scene(scene_root)
    notes = scenes.read_annotations(spark, f"{scene_root}/labels.json")
    top = notes.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(top_k_labels)
    one = notes.agg(
        F.count("*").alias("objects"), F.count("corners").alias("with_box")
    ).crossJoin(scenes.read_structure(spark, f"{scene_root}/structure.json"))
    scenes.write_json(one, output_json, labels=[r.asDict() for r in top.collect()])


@command
def apply_transform(
    spark: SparkSession, *, ply_path: str, object_ids: str, output_path: str, target_object_id: int,
    translate: tuple[float, ...] = (0.0, 0.0, 0.0), rotate_axis: tuple[float, ...] = (0.0, 0.0, 1.0), rotate_degrees: float = 0.0,
    pivot_mode: str = "centroid"
) -> None:
    """Move one object."""
    out = editing.move_object(
        _labelled_table(spark, ply_path, object_ids), target_object_id, translate, G.rotation_about(rotate_axis, rotate_degrees),
        "centroid" if pivot_mode == "centroid" else None
    )
    _write_table(out.drop("object_id"), ply_path, output_path)


@command
def cleanup_region(
    spark: SparkSession, *, ply_path: str, object_ids: str, groups_json: str, target_object_id: int, output_path: str, mode: str = "blend",
    shell_margin: float = 0.12, color_blend: float = 0.85, opacity_scale: float = 0.85, keep_high_order_sh: bool = False
) -> None:
    """Repair the place an object left."""
    g = scenes.read_groups(spark, groups_json).where(F.col("object_id") == target_object_id).first()
    if g is None:
        raise ValueError(f"no group {target_object_id}")
    out = editing.repair_region(
        _labelled_table(spark, ply_path, object_ids), target_object_id, g["bbox_min_xyz"], g["bbox_max_xyz"], mode=mode,
        margin=shell_margin, color_blend=color_blend, opacity_scale=opacity_scale, keep_harmonics=keep_high_order_sh
    )
    _write_table(out.drop("object_id"), ply_path, output_path)


@command
def validate_placement(
    spark: SparkSession, *, scene_root: str, target_object_id: int, output_json: str, translate: tuple[float, ...] = (0.0, 0.0, 0.0),
    rotate_degrees: float = 0.0, max_occupied_fraction: float = 0.05, max_unknown_fraction: float = 0.25
) -> None:
    """Whether a moved object stands on free floor."""
    note = scenes.read_annotations(spark, f"{scene_root}/labels.json").where(
        F.col("object_id") == target_object_id
    ).orderBy(F.desc("position")).first()
    if note is None or note["corners"] is None:
        raise ValueError(f"object {target_object_id} has no box")
    px, meta = scenes.read_occupancy(spark, f"{scene_root}/occupancy.png", f"{scene_root}/occupancy.json")
    out = editing.placement(
        px, note["corners"], upper_x=meta["upper"][0], lower_y=meta["lower"][1], scale=meta["scale"], translation=translate,
        rotation=G.rotation_z(rotate_degrees), max_occupied=max_occupied_fraction, max_unknown=max_unknown_fraction
    )
    scenes.write_json(out, output_json, object_id=target_object_id, label=note["label"])


@command
def highlight_groups(
    spark: SparkSession, *, ply_path: str, object_ids: str, output_path: str, groups_json: str | None = None, skip_largest_n: int = 0,
    min_group_size: int = 0, include_labels: tuple[str, ...] = (), include_object_ids: tuple[int, ...] = (),
    exclude_object_ids: tuple[int, ...] = (), multi_color: bool = False, highlight_rgb: tuple[float, ...] = (1.0, 0.0, 0.0),
    blend: float = 1.0, dim_opacity_scale: float = 1.0, selected_opacity_scale: float = 1.0, flatten_selected_sh: bool = False
) -> None:
    """A PLY with chosen objects recoloured; labels are filtered before ranking by size."""
    table = _labelled_table(spark, ply_path, object_ids)
    sizes = table.where("object_id >= 0").groupBy("object_id").agg(F.count("*").alias("n"))
    if include_labels:
        known = scenes.read_groups(spark, groups_json, "global_object_id").where(F.col("label").isin(list(include_labels)))
        sizes = sizes.join(known, "object_id", "left_semi")
    kept = voting.select_groups(
        sizes, skip_largest=skip_largest_n, min_size=min_group_size, include=list(include_object_ids), exclude=list(exclude_object_ids)
    )
    j = table.join(kept.select("object_id", F.lit(True).alias("_on")), "object_id", "left")
    rgb = C.palette("object_id") if multi_color else highlight_rgb
    out = C.highlight(
        j, F.col("_on"), rgb, alpha=blend, dim_scale=dim_opacity_scale, selected_scale=selected_opacity_scale, flatten=flatten_selected_sh
    )
    _write_table(out.drop("_on", "object_id"), ply_path, output_path)


@command
def highlight_vote_instance(
    spark: SparkSession, *, ply_path: str, vote_evidence: str, output_path: str, instance_id: int, frame_index: int,
    highlight_rgb: tuple[float, ...] = (1.0, 0.0, 0.0), dim_opacity_scale: float = 0.25, selected_opacity_scale: float = 1.5,
    flatten_selected_sh: bool = False
) -> None:
    """A PLY that shows what one mask voted for."""
    on = arrays.read_votes(spark, vote_evidence).where(
        (F.col("frame_index") == frame_index) & (F.col("instance_id") == instance_id)
    ).select("gaussian_index").distinct().withColumn("_on", F.lit(True))
    out = C.highlight(
        ply.read_ply(spark, ply_path).join(on, "gaussian_index", "left"), F.col("_on"), highlight_rgb, dim_scale=dim_opacity_scale,
        selected_scale=selected_opacity_scale, flatten=flatten_selected_sh
    )
    _write_table(out.drop("_on"), ply_path, output_path)


@command
def export_instances(
    spark: SparkSession, *, ply_path: str, identity_ids: str, probabilities: str, output_dir: str, include_classes: tuple[int, ...],
    min_confidence: float = 0.85, voxel_size: float = 0.05, min_voxel_count: int = 1, min_gaussians: int = 500,
    max_instances_per_class: int = 0
) -> None:
    """Confident classes split into instances."""
    points = ply.cloud(ply.read_ply(spark, ply_path))
    j = _ids(spark, identity_ids, "class_index").join(
        arrays.read_npy(spark, probabilities, "p"), "gaussian_index"
    ).withColumn("confidence", F.element_at("p", F.col("class_index") + 1))
    best = j.where(
        (F.col("confidence") >= min_confidence) & F.col("class_index").isin(list(include_classes))
    ).select("gaussian_index", "class_index", "confidence")
    named = spatial.category_instances(
        best.drop("confidence"), points, voxel_size, min_voxel_count=min_voxel_count, min_points=min_gaussians,
        top_k=max_instances_per_class, key="class_index"
    )
    named.write.mode("overwrite").parquet(f"{output_dir}/instances")
    named = spark.read.parquet(f"{output_dir}/instances")
    arrays.write_npy(named, f"{output_dir}/gaussian_instance_ids.npy", "instance_id")
    scenes.write_json(
        spatial.instance_stats(named.join(best.drop("class_index"), "gaussian_index", "left"), ["confidence"]),
        f"{output_dir}/identity_instances.json", "instances"
    )


@command
def classify_identities(spark: SparkSession, *, embeddings: str, head: str, bias: str, output_root: str) -> None:
    """Classes of embeddings by a linear head stored as .npy."""
    import numpy as np

    out = learning.classify(arrays.read_npy(spark, embeddings, "embedding"), np.load(head).tolist(), np.load(bias).tolist())
    out.write.mode("overwrite").parquet(f"{output_root}/classes")
    arrays.write_npy(spark.read.parquet(f"{output_root}/classes"), f"{output_root}/gaussian_identity_ids.npy", "class_index")


@command
def project_instances(
    spark: SparkSession, *, dataset_root: str, ply_path: str, instance_ids: str, output_root: str, max_frames: int | None = None,
    front_surface_only: bool = False, front_surface_depth_margin: float = 0.03, dilation_radius: int = 4, min_mask_pixels: int = 64,
    background_id: int = 0, instance_score: float = 1.0, include_empty_background_frames: bool = False, scene_format: str = "nerfstudio"
) -> None:
    """Masks of discovered instances drawn into the frames, with a background mask for each."""
    frames, camera = _scene(spark, dataset_root, scene_format)
    frames = frames if max_frames is None else frames.where(F.col("frame_index") < max_frames)
    seen = _gated(
        visibility.project_points(ply.cloud(ply.read_ply(spark, ply_path)), frames, camera), None, front_surface_only,
        front_surface_depth_margin
    )
    px = masks.projected_masks(
        seen, _ids(spark, instance_ids, "instance_id"), camera.width, camera.height, radius=dilation_radius, min_pixels=min_mask_pixels
    ).withColumn("instance_id", (F.col("instance_id") + 1).cast("int"))
    _write_with_background(px, frames, camera, output_root, background_id, instance_score, include_empty_background_frames)


def _write_with_background(
    px: DataFrame, frames: DataFrame, camera, output_root: str, background_id: int, score: float, all_frames: bool
) -> None:
    used = frames if all_frames else frames.join(px.select("frame_index").distinct(), "frame_index", "left_semi")
    whole = used.select(
        "frame_index", F.lit(background_id).alias("instance_id"), F.explode(F.sequence(F.lit(0), F.lit(camera.width - 1))).alias("x")
    ).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(camera.height - 1))))
    every = px.unionByName(whole)
    boxes = masks.bounds(every, exclusive=False).withColumns(
        {
            "score": F.when(F.col("instance_id") == background_id, 0.0).otherwise(score),
            "label": F.when(F.col("instance_id") == background_id, F.lit("background")).otherwise(L.class_name("instance", "instance_id"))
        }
    )
    scenes.write_masks(
        every, boxes.join(frames.select("frame_index", F.col("file_path").alias("image_path")), "frame_index"), output_root, camera.width,
        camera.height
    )


@command
def reassign_masks(
    spark: SparkSession, *, dataset_root: str, ply_path: str, grounded_masks_root: str, instance_ids: str, output_root: str,
    include_categories: tuple[str, ...] = CATEGORY_NAMES, min_mask_score: float = 0.25, min_area_ratio: float = 0.001,
    max_area_ratio: float = 0.45, min_instance_hit_ratio: float = 0.2, min_instance_hit_count: int = 32, front_surface_only: bool = False,
    front_surface_depth_margin: float = 0.03, depth_root: str | None = None, max_frames: int | None = None, background_id: int = 0,
    include_empty_background_frames: bool = False, scene_format: str = "nerfstudio"
) -> None:
    """Detected masks renamed to the discovered instance that holds most of their points."""
    frames, camera = _scene(spark, dataset_root, scene_format)
    inst, pixels = _masks(spark, grounded_masks_root, max_frames)
    kept = masks.category_filter(
        inst, [s for s in L.CATEGORIES if s[0] in include_categories], min_mask_score, min_area_ratio, max_area_ratio
    )
    seen = _gated(
        visibility.project_points(ply.cloud(ply.read_ply(spark, ply_path)), frames, camera),
        _depth(spark, depth_root, frames) if depth_root else None, front_surface_only, front_surface_depth_margin
    )
    hits = visibility.mask_hits(seen, pixels.join(kept.select("frame_index", "instance_id"), ["frame_index", "instance_id"], "left_semi"))
    chosen = masks.vote_instances(
        hits, _ids(spark, instance_ids, "object_id"), min_ratio=min_instance_hit_ratio, min_count=min_instance_hit_count
    ).where("chosen is not null")
    px = pixels.join(chosen, ["frame_index", "instance_id"]).select(
        "frame_index", (F.col("chosen") + 1).cast("int").alias("instance_id"), "x", "y"
    ).distinct()
    _write_with_background(px, frames, camera, output_root, background_id, 1.0, include_empty_background_frames)


@command
def discover_track_masks(
    spark: SparkSession, *, dataset_root: str, grounded_masks_root: str, output_root: str, colmap_image_width: int,
    colmap_image_height: int, colmap_images_bin: str = "colmap/sparse/0/images.bin", include_categories: tuple[str, ...] = CATEGORY_NAMES,
    min_mask_score: float = 0.25, min_area_ratio: float = 0.001, max_area_ratio: float = 0.45, min_track_points: int = 8,
    min_shared_points: int = 4, min_overlap_ratio: float = 0.08, min_group_masks: int = 3
) -> None:
    """Groups of masks that share reconstructed points."""
    inst, pixels = _masks(spark, grounded_masks_root)
    kept = masks.category_filter(
        inst, [s for s in L.CATEGORIES if s[0] in include_categories], min_mask_score, min_area_ratio, max_area_ratio
    )
    size = kept.select("width", "height").first()
    tracks = scenes.read_colmap_tracks(spark, f"{dataset_root}/{colmap_images_bin}").join(
        inst.select("frame_stem", "frame_index").distinct(), "frame_stem"
    )
    hits = masks.track_hits(
        tracks, pixels.join(kept.select("frame_index", "instance_id"), ["frame_index", "instance_id"], "left_semi"),
        (colmap_image_width, colmap_image_height), (size["width"], size["height"])
    )
    out = masks.track_masks(
        kept, hits, min_points=min_track_points, min_shared=min_shared_points, min_ratio=min_overlap_ratio, min_masks=min_group_masks
    )
    names = F.array(*[F.lit(n) for n, _ in L.CATEGORIES if n in include_categories])
    out = out.withColumn("class_name", F.when(F.col("rank").isNotNull(), L.class_name(F.element_at(names, F.col("category") + 1), "rank")))
    out.write.mode("overwrite").parquet(f"{output_root}/mask_groups")


@command
def overlay_masks(
    spark: SparkSession, *, masks_root: str, output_root: str, images_root: str | None = None, frame_stems: tuple[str, ...] = (),
    limit: int | None = None, alpha: float = 0.45
) -> None:
    """Masks in the colours of their instances, over the frames' pictures where there are some of the same size."""
    found = scenes.read_manifests(spark, masks_root)
    chosen = scenes.select_frames(found, list(frame_stems) or None, limit).select("frame_stem")
    inst, pixels = _masks(spark, masks_root)
    inst = inst.join(chosen, "frame_stem", "left_semi")
    shown = masks.painted(pixels.join(inst.select("frame_index").distinct(), "frame_index", "left_semi"), inst)
    base = None
    if images_root:
        names = inst.select(L.base_name("image_path").alias("file"), "frame_index").distinct()
        base = scenes.read_color_pixels(spark, images_root).join(names, "file").drop("file")
    size = inst.select("width", "height").first()
    scenes.write_overlays(masks.overlay(shown, C.hashed_color("instance_id"), base, alpha), output_root, size["width"], size["height"])


@command
def prepare_identity_masks(
    spark: SparkSession, *, masks_root: str, output_root: str, id_mode: str = "label-family", min_score: float = 0.0,
    drop_null_family: bool = False, max_instances_per_frame: int | None = None
) -> None:
    """Global ids of masks by label family, label or number."""
    inst = scenes.read_manifests(spark, masks_root)
    if max_instances_per_frame is not None:
        inst = masks.top_per(inst, ["frame_index"], max_instances_per_frame)
    masks.global_ids(
        inst, id_mode, min_score=min_score, drop_null=drop_null_family
    ).write.mode("overwrite").parquet(f"{output_root}/identity_masks")


@command
def prepare_multiclass_masks(
    spark: SparkSession, *, masks_root: str, output_root: str, category: tuple[str, ...], min_score: float = 0.0,
    min_area_ratio: float = 0.0, max_area_ratio: float = 1.0, max_instances_per_category_per_frame: int | None = None
) -> None:
    """Masks by category (name=pattern ...); ids follow the order given, from 1."""
    cats = spark.createDataFrame(
        [(i + 1, *c.split("=", 1)) for i, c in enumerate(category)], "class_id int, class_name string, pattern string"
    )
    inst = masks.area_filter(scenes.read_manifests(spark, masks_root), min_area_ratio, max_area_ratio)
    masks.multiclass(
        inst, cats, min_score=min_score, per_frame=max_instances_per_category_per_frame
    ).write.mode("overwrite").parquet(f"{output_root}/identity_masks")


@command
def prepare_single_masks(
    spark: SparkSession, *, masks_root: str, output_root: str, label_regex: str, min_score: float = 0.0, min_area_ratio: float = 0.0,
    max_area_ratio: float = 1.0, source_frame_regex: str | None = None, bbox_center_x_min: float = 0.0, bbox_center_x_max: float = 1.0,
    bbox_center_y_min: float = 0.0, bbox_center_y_max: float = 1.0, keep_all_per_frame: bool = False
) -> None:
    """Masks of one object."""
    out = masks.single_object_filter(
        scenes.read_manifests(spark, masks_root), label_regex, min_score=min_score, least=min_area_ratio, most=max_area_ratio,
        window=(bbox_center_x_min, bbox_center_x_max, bbox_center_y_min, bbox_center_y_max), frame_pattern=source_frame_regex
    )
    (out if keep_all_per_frame else masks.top_per(out, ["frame_index"], 1)).write.mode("overwrite").parquet(f"{output_root}/identity_masks")


@command
def scene_manifest(spark: SparkSession, *, dataset_root: str, ply_path: str, output_path: str, scene_format: str = "nerfstudio") -> None:
    """Range of every vertex property, counts of points and frames."""
    frames, camera = _scene(spark, dataset_root, scene_format)
    table = ply.read_ply(spark, ply_path)
    names = [c for c in table.columns if c != "gaussian_index"]
    one = table.agg(
        F.count("*").alias("gaussian_count"), *[f(c).alias(f"{n}_{c}") for c in names for n, f in (("min", F.min), ("max", F.max))]
    )
    scenes.write_json(
        one, output_path, frame_count=frames.count(), camera_model=camera.model,
        types={f.name: f.dataType.simpleString() for f in table.schema.fields}
    )


@command
def best_frames(
    spark: SparkSession, *, dataset_root: str, ply_path: str, object_ids: str, output_json: str, top_k: int | None = None,
    skip_largest_n: int = 0, min_group_size: int = 0, include_object_ids: tuple[int, ...] = (), exclude_object_ids: tuple[int, ...] = (),
    scene_format: str = "nerfstudio"
) -> None:
    """The frame that sees most of each chosen object."""
    frames, camera = _scene(spark, dataset_root, scene_format)
    ids = _ids(spark, object_ids)
    sizes = ids.where("object_id >= 0").groupBy("object_id").agg(F.count("*").alias("n"))
    kept = voting.select_groups(
        sizes, skip_largest=skip_largest_n, min_size=min_group_size, include=list(include_object_ids), exclude=list(exclude_object_ids),
        top_k=top_k
    )
    own = ids.join(kept, "object_id", "left_semi")
    seen = visibility.project_points(ply.cloud(ply.read_ply(spark, ply_path)).join(own, "gaussian_index", "left_semi"), frames, camera)
    scenes.write_json(visibility.best_frame(seen, own, frames), output_json, "frames")


@command
def group_points(
    spark: SparkSession, *, ply_path: str, object_ids: str, output_path: str, drop_unknown: bool = False,
    include_object_ids: tuple[int, ...] = (), show_context: bool = False, max_points: int | None = None
) -> None:
    """An ASCII PLY of points coloured by object; with context the points of other objects too, up to half of the budget for the chosen."""
    t = _labelled_table(spark, ply_path, object_ids)
    chosen = F.col("object_id").isin(list(include_object_ids)) if include_object_ids else F.lit(True)
    chosen = chosen & (F.col("object_id") >= 0) if drop_unknown else chosen
    if not show_context:
        t = t.where(chosen)
    if max_points is not None:
        t = sampling.context_sample(t, chosen, max_points) if show_context else sampling.sampled(t, max_points)
    c = C.hashed_color("object_id")
    ply.write_ascii(t.select("gaussian_index", "x", "y", "z", c[0].alias("red"), c[1].alias("green"), c[2].alias("blue")), output_path)


@command
def merge_exports(spark: SparkSession, *, output_path: str, category: tuple[str, ...], min_selected: int = 1) -> None:
    """One PLY of categories, each name=ply=mask.npy, in its colour."""
    parts, source = [], None
    for c in category:
        name, path, keep = c.split("=")
        source = source or path
        parts.append((name, ply.read_ply(spark, path).join(arrays.read_npy(spark, keep).where("value"), "gaussian_index", "left_semi")))
    palette = dict(zip(CATEGORY_NAMES, C.CLASS_PALETTE, strict=False))
    out = editing.merge_categories(parts, palette, min_selected).withColumn("gaussian_index", F.monotonically_increasing_id())
    _write_table(out, source, output_path)


@command
def inspect_groups(spark: SparkSession, *, groups_json: str, output_json: str, top_k: int = 10) -> None:
    """The largest groups."""
    scenes.write_json(
        scenes.read_groups(spark, groups_json).select(
            "object_id", "label", "gaussian_count"
        ).orderBy(F.desc("gaussian_count"), "object_id").limit(top_k),
        output_json, "groups"
    )


@command
def inspect_association(spark: SparkSession, *, instances: str, output_json: str, top_k: int = 10) -> None:
    """The objects with most support."""
    s = spark.read.parquet(instances).where("object_id >= 0").groupBy("object_id").agg(
        F.sum("support_size").alias("support"), F.count_distinct("frame_index").alias("frames")
    )
    scenes.write_json(s.orderBy(F.desc("support"), "object_id").limit(top_k), output_json, "objects")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="scenelake", description=__doc__)
    subs = top.add_subparsers(dest="command", required=True)
    for name, f in COMMANDS.items():
        sub = subs.add_parser(name, help=(f.__doc__ or "").strip().splitlines()[0])
        for p in list(inspect.signature(f).parameters.values())[1:]:
            flag, needed = "--" + p.name.replace("_", "-"), p.default is inspect.Parameter.empty
            kind = str(p.annotation)
            of = float if "float" in kind else int if "int" in kind else str
            if kind == "bool":
                sub.add_argument(flag, action="store_true")
            elif kind.startswith("tuple"):
                sub.add_argument(flag, nargs="+", type=of, required=needed, default=None if needed else p.default)
            else:
                sub.add_argument(flag, type=of, required=needed, default=None if needed else p.default)
    return top


def main(argv: list[str] | None = None) -> None:
    args = vars(parser().parse_args(argv))
    f = COMMANDS[args.pop("command")]
    for key in ("output_root", "output_dir"):
        if args.get(key):
            os.makedirs(args[key], exist_ok=True)
    f(SparkSession.builder.getOrCreate(), **args)


if __name__ == "__main__":
    main()
