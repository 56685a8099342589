"""Filtering, ranking, scoring and rewriting of 2D masks.

instances: frame_index, instance_id, label, score, detection_score, area, width, height, x0, y0, x1, y1, position.
mask_pixels: frame_index, instance_id, x, y.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenelake.functions import color as C
from scenelake.functions import geometry as G
from scenelake.functions import labels as L
from scenelake.operators import visibility
from scenelake.operators.ranking import numbered
from scenelake.operators.voting import KEYS, track_groups
from scenelake.plans.lineage import broadcast_small, cut


def area_filter(instances: DataFrame, least: float, most: float) -> DataFrame:
    """Inclusive bounds on the share of the image that a mask covers."""
    if not 0 <= least <= most:
        raise ValueError("area bounds must be ordered and not negative")
    return instances.where(G.area_ratio("area", "width", "height").between(least, most))


def proposal_filter(
    instances: DataFrame, pattern: str = L.FURNITURE, min_score: float = 0.25, least: float = 0.001, most: float = 0.45
) -> DataFrame:
    """Labels that match, good enough candidates of allowed area; score becomes the candidate score; label_family added."""
    s = L.candidate_score("detection_score", "score")
    kept = area_filter(instances.where(L.matches("label", pattern)).where(s >= min_score), least, most)
    return kept.withColumns({"score": s, "label_family": L.family("label")})


def category_filter(
    instances: DataFrame, specs: Sequence[tuple[str, str]] = L.CATEGORIES, min_score: float = 0.25, least: float = 0.001,
    most: float = 0.45, discovered: DataFrame | None = None
) -> DataFrame:
    """Masks of a known category; with ``discovered`` (category) only of those that have instances."""
    s = L.candidate_score("detection_score", "score")
    out = area_filter(
        instances.withColumn("category", L.category_index("label", specs)).where(F.col("category").isNotNull() & (s >= min_score)), least,
        most
    ).withColumn("score", s)
    return out if discovered is None else out.join(discovered.select("category").distinct(), "category", "left_semi")


def single_object_filter(
    instances: DataFrame, pattern: str, *, min_score: float = 0.0, least: float = 0.0, most: float = 1.0,
    window: tuple[float, float, float, float] = (0.0, 1.0, 0.0, 1.0), frame_pattern: str | None = None
) -> DataFrame:
    """Masks of one object by label, score, area and centre of the box in shares of the image."""
    cx = (F.col("x0") + F.col("x1")).cast("double") / 2 / F.greatest(F.col("width"), F.lit(1))
    cy = (F.col("y0") + F.col("y1")).cast("double") / 2 / F.greatest(F.col("height"), F.lit(1))
    out = area_filter(
        instances.where(L.matches("label", pattern) & (L.candidate_score("detection_score", "score") >= min_score)), least, most
    )
    out = out.where(cx.between(window[0], window[1]) & cy.between(window[2], window[3]))
    return out if frame_pattern is None else out.where(F.col("frame_stem").rlike(frame_pattern))


def top_per(instances: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """The best k of each key by candidate score, then area, then position."""
    order = Window.partitionBy(*keys).orderBy(
        L.candidate_score("detection_score", "score").desc(), F.desc("area"), "position", "instance_id"
    )
    return instances.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def by_area(instances: DataFrame) -> DataFrame:
    """``instances`` with instance_id renumbered per frame by area descending."""
    order = Window.partitionBy("frame_index").orderBy(F.desc("area"), "position")
    return instances.withColumn("instance_id", F.row_number().over(order) - 1)


def bounds(mask_pixels: DataFrame, *, exclusive: bool = True) -> DataFrame:
    """(frame, instance, area, x0, y0, x1, y1) from pixels; the far corner is one past the last pixel if exclusive."""
    add = 1 if exclusive else 0
    return mask_pixels.groupBy(*KEYS).agg(
        F.count("*").alias("area"), F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + add).alias("x1"),
        (F.max("y") + add).alias("y1")
    )


def painted(mask_pixels: DataFrame, instances: DataFrame) -> DataFrame:
    """(frame_index, x, y, instance_id): of overlapping masks the highest score shows, of equal ones the later."""
    j = mask_pixels.join(instances.select(*KEYS, "score", "position"), list(KEYS))
    best = j.groupBy("frame_index", "x", "y").agg(F.max(F.struct("score", "position", "instance_id")).alias("b"))
    return best.select("frame_index", "x", "y", F.col("b.instance_id").alias("instance_id"))


def overlay(label_pixels: DataFrame, color: Column, base: DataFrame | None = None, alpha: float = 0.45) -> DataFrame:
    """(frame_index, x, y, red, green, blue): label pixels in ``color`` (an array of bytes), laid over ``base`` where there is one.

    base: frame_index, x, y, red, green, blue; its pixels without a label stay as they are.
    """
    names = ("red", "green", "blue")
    drawn = label_pixels.select("frame_index", "x", "y", color.alias("_c"))
    if base is None:
        return drawn.select("frame_index", "x", "y", *[F.col("_c")[i].cast("int").alias(n) for i, n in enumerate(names)])
    j = base.join(drawn, ["frame_index", "x", "y"], "left")
    return j.select(
        "frame_index", "x", "y",
        *[
            F.when(F.col("_c").isNull(), F.col(n)).otherwise(C.blend_bytes(n, F.col("_c")[i], alpha)).cast("int").alias(n)
            for i, n in enumerate(names)
        ]
    )


def class_indices(instances: DataFrame) -> DataFrame:
    """(frame_index, instance_id, class_index): order of first appearance by ascending score, then position."""
    order = Window.partitionBy("frame_index").orderBy("score", "position")
    return instances.select("frame_index", "instance_id", (F.row_number().over(order) - 1).alias("class_index"))


def vocabulary(instances: DataFrame, column: str = "instance_id", min_score: float = 0.0) -> DataFrame:
    """(raw, class_index): distinct ids or labels of good enough masks in sorted order, counted from 0."""
    ids = instances.where(
        F.coalesce("score", F.lit(0.0)) >= min_score
    ).where(F.col(column).isNotNull()).select(F.col(column).alias("raw")).distinct()
    return numbered(ids, ["raw"], "class_index").withColumn("class_index", F.col("class_index").cast("int"))


def remap(label_pixels: DataFrame, vocab: DataFrame) -> DataFrame:
    """Label pixels in scene classes; those of unknown raw ids go, which means ignore."""
    return label_pixels.join(vocab, label_pixels["instance_id"] == vocab["raw"]).select("frame_index", "x", "y", "class_index")


def resized(label_pixels: DataFrame, size: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """Nearest-neighbour resize of (width, height): target pixel t reads source floor(t * in / out)."""
    spark = label_pixels.sparkSession
    axis = lambda name, n_in, n_out: spark.range(n_out).select(F.col("id").cast("int").alias(f"t{name}"), F.floor(F.col("id") * n_in / n_out).cast("int").alias(name))
    wide = label_pixels.join(F.broadcast(axis("x", size[0], target[0])), "x").join(F.broadcast(axis("y", size[1], target[1])), "y")
    return wide.select(
        "frame_index", F.col("tx").alias("x"), F.col("ty").alias("y"), F.greatest("class_index", F.lit(-1)).alias("class_index")
    )


def dilated(pixels: DataFrame, radius: int, width: int, height: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Square dilation of distinct pixels, cut off at the image's edges."""
    step = lambda: F.explode(F.sequence(F.lit(-radius), F.lit(radius)))
    grown = pixels.select(*keys, "x", "y").distinct().withColumn("_dx", step()).withColumn("_dy", step())
    out = grown.select(*keys, (F.col("x") + F.col("_dx")).alias("x"), (F.col("y") + F.col("_dy")).alias("y")).distinct()
    return out.where((F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < height))


def projected_masks(projected: DataFrame, ids: DataFrame, width: int, height: int, *, radius: int = 4, min_pixels: int = 64) -> DataFrame:
    """mask_pixels of discovered instances drawn from their visible points, small masks dropped."""
    seeds = projected.where("valid and px is not null").join(ids.where("instance_id >= 0"), "gaussian_index").select(
        "frame_index", "instance_id", F.col("px").alias("x"), F.col("py").alias("y")
    )
    grown = dilated(seeds, radius, width, height)
    big = grown.groupBy(*KEYS).agg(F.count("*").alias("n")).where(F.col("n") >= min_pixels)
    return grown.join(big.select(*KEYS), list(KEYS), "left_semi")


def background_rows(frames: DataFrame, width: int, height: int, background_id: int = 0, score: float = 0.0) -> DataFrame:
    """One full-frame background instance per frame, inclusive box."""
    return frames.select(
        "frame_index", F.lit(background_id).alias("instance_id"), F.lit("background").alias("label"), F.lit(float(score)).alias("score"),
        F.lit(width * height).alias("area"), F.lit(0).alias("x0"), F.lit(0).alias("y0"), F.lit(width - 1).alias("x1"),
        F.lit(height - 1).alias("y1")
    )


def vote_instances(
    hits: DataFrame, ids: DataFrame, *, min_ratio: float = 0.2, min_count: int = 32, allowed: DataFrame | None = None
) -> DataFrame:
    """(frame, mask, chosen, count, ratio): the discovered instance most of a mask's points belong to, null if too weak.

    Ratios are over all hits of the mask. ``allowed``: instances that a category may choose from.
    """
    counts = hits.join(ids.hint("merge"), "gaussian_index", "left").groupBy(*KEYS, "object_id").agg(F.count("*").alias("hits"))
    return vote_counts(counts, min_ratio=min_ratio, min_count=min_count, allowed=allowed)


def vote_counts(
    counts: DataFrame, *, min_ratio: float = 0.2, min_count: int = 32, allowed: DataFrame | None = None
) -> DataFrame:
    """``vote_instances`` from the hits of each mask by instance: counts of frame, mask, object_id (null: none), hits."""
    total = counts.groupBy(*KEYS).agg(F.sum("hits").alias("total"))
    known = counts.where("object_id >= 0").withColumnRenamed("object_id", "chosen")
    if allowed is not None:
        known = known.join(allowed.select(F.col("object_id").alias("chosen")), "chosen", "left_semi")
    n = known.groupBy(*KEYS, "chosen").agg(F.sum("hits").alias("n"))
    best = n.groupBy(*KEYS).agg(F.max(F.struct("n", (-F.col("chosen")).alias("c"))).alias("b"))
    out = total.join(best, list(KEYS), "left").select(
        *KEYS, (-F.col("b.c")).alias("chosen"), F.coalesce("b.n", F.lit(0)).alias("count"),
        (F.coalesce("b.n", F.lit(0)) / F.col("total")).alias("ratio")
    )
    ok = (F.col("count") >= min_count) & (F.col("ratio") >= min_ratio)
    return out.withColumn("chosen", F.when(ok, F.col("chosen")))


def track_hits(tracks: DataFrame, mask_pixels: DataFrame, source: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """(frame, instance, point3d_id): distinct track points on each mask after scaling to the mask's size.

    A point at one place of a frame meets a mask once; only those at several places are held against each other after
    the join, whose rows are far more than points and pixels.
    """
    x, y = (F.floor(F.col(c).cast("double") * t / s).cast("int").alias(c) for c, s, t in zip("xy", source, target, strict=True))
    at = tracks.where("point3d_id >= 0").select("frame_index", "point3d_id", x.alias("px"), y.alias("py"))
    places = at.groupBy("frame_index", "point3d_id").agg(F.collect_set(F.struct("px", "py")).alias("places"))
    place = lambda many: places.where(F.size("places") > 1 if many else F.size("places") == 1).select(
        "frame_index", "point3d_id", F.inline("places")
    )
    pix = mask_pixels.select(*KEYS, "x", "y").repartition("frame_index", "x", "y").distinct()
    once, again = (visibility.on_masks(place(many), pix).select(*KEYS, "point3d_id") for many in (False, True))
    return once.union(again.distinct())


def track_places(tracks: DataFrame, source: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """(point3d_id, points, frame_index, px, py): the places of track points after scaling to the mask's size, each distinct
    set of places once, under the smallest of its points, with the number of these.

    Points seen at the same places of the same frames are on the same masks, and there are many once pixels are coarse.
    """
    x, y = (F.floor(F.col(c).cast("double") * t / s).cast("int").alias(f"p{c}") for c, s, t in zip("xy", source, target, strict=True))
    at = tracks.where("point3d_id >= 0").select("point3d_id", F.struct("frame_index", x, y).alias("at"))
    places = at.groupBy("point3d_id").agg(F.sort_array(F.collect_set("at")).alias("places"))
    sets = places.groupBy("places").agg(F.min("point3d_id").alias("point3d_id"), F.count("*").alias("points"))
    return sets.select("point3d_id", "points", F.inline("places"))


def place_hits(places: DataFrame, mask_pixels: DataFrame) -> DataFrame:
    """(frame_index, instance_id, point3d_id, points): ``track_hits`` of whole sets of places, from ``track_places``."""
    pix = mask_pixels.select(*KEYS, "x", "y")
    return visibility.on_masks(places, pix).select(*KEYS, "point3d_id", "points").distinct()


def multiclass(instances: DataFrame, categories: DataFrame, *, min_score: float = 0.0, per_frame: int | None = None) -> DataFrame:
    """Masks once for each category they match (categories: class_id, pattern), best ``per_frame`` of each.

    The category list is given by hand; it is broadcast as long as it is short.
    """
    s = L.candidate_score("detection_score", "score")
    out = instances.crossJoin(broadcast_small(categories)).where(
        F.expr("label rlike concat('(?i)(', pattern, ')')")
    ).where(s >= min_score).withColumn("score", s)
    return out if per_frame is None else top_per(out, ["frame_index", "class_id"], per_frame)


def global_ids(instances: DataFrame, mode: str = "label-family", *, min_score: float = 0.0, drop_null: bool = False) -> DataFrame:
    """``instances`` with global_id: the place of their key among all keys in sorted order; null keys count last unless dropped."""
    keyed = instances.where(F.coalesce("score", F.lit(0.0)) >= min_score).withColumn("_key", L.instance_key(mode))
    keyed = keyed.where("_key is not null") if drop_null else keyed.withColumn("_key", F.coalesce("_key", F.lit("unknown")))
    ids = numbered(keyed.select("_key").distinct(), ["_key"], "global_id").withColumn("global_id", F.col("global_id").cast("int"))
    return keyed.join(ids, "_key").withColumnRenamed("_key", "global_key")


def cluster_hits(
    projected: DataFrame, clusters: DataFrame, mask_pixels: DataFrame, instances: DataFrame, *, min_visible: int = 16, min_hits: int = 8,
    min_ratio: float = 0.02
) -> DataFrame:
    """(cluster_id, frame_index, instance_id, label, family, visible, hits, weight) of masks that cover a cluster."""
    own = projected.where("valid").join(clusters.where("cluster_id >= 0").hint("merge"), "gaussian_index")  # as many rows as points
    seen = own.groupBy("cluster_id", "frame_index").agg(F.count("*").alias("visible")).where(F.col("visible") >= min_visible)
    hits = visibility.mask_counts(own, mask_pixels, "cluster_id")
    ratio = F.col("hits") / F.col("visible")
    j = hits.join(seen, ["cluster_id", "frame_index"]).where((F.col("hits") >= min_hits) & (ratio >= min_ratio))
    j = j.join(instances.select(*KEYS, "label", "score"), list(KEYS))
    return j.select(
        "cluster_id", *KEYS, "label", L.family("label").alias("family"), "visible", "hits",
        (ratio * F.coalesce("score", F.lit(0.0))).alias("weight")
    )


def cluster_scores(hits: DataFrame, by: str = "label") -> DataFrame:
    """(cluster_id, label or family, score, frames); a null family is a bucket of its own."""
    return hits.groupBy("cluster_id", by).agg(F.sum("weight").alias("score"), F.count_distinct("frame_index").alias("frames"))


def best_frames(hits: DataFrame, k: int = 8) -> DataFrame:
    """(cluster_id, frame_index, label, weight): each frame's heaviest mask, the first of equals; the best k frames."""
    top = hits.groupBy("cluster_id", "frame_index").agg(F.max(F.struct("weight", (-F.col("instance_id")).alias("i"), "label")).alias("b"))
    flat = top.select("cluster_id", "frame_index", F.col("b.label").alias("label"), F.col("b.weight").alias("weight"))
    order = Window.partitionBy("cluster_id").orderBy(F.desc("weight"), "frame_index")
    return flat.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def decisions(family_scores: DataFrame, tags: DataFrame, *, min_purity: float = 0.6, max_secondary: float = 0.4) -> DataFrame:
    """(cluster_id, accepted, reasons, purity, secondary) of every cluster in ``tags`` (cluster_id, tags)."""
    order = Window.partitionBy("cluster_id").orderBy(F.desc("score"))
    r = family_scores.withColumn("_r", F.row_number().over(order))
    s = r.groupBy("cluster_id").agg(
        F.sum(F.greatest("score", F.lit(0.0))).alias("total"), F.max(F.when(F.col("_r") == 1, F.col("score"))).alias("best"),
        F.max(F.when(F.col("_r") == 2, F.col("score"))).alias("second")
    )
    j = tags.join(s, "cluster_id", "left")
    supported = F.coalesce(F.col("total") > 0, F.lit(False))
    purity = F.when(supported, F.col("best") / F.col("total")).otherwise(0.0)
    second = F.when(supported & (F.col("best") > 0), F.coalesce("second", F.lit(0.0)) / F.col("best")).otherwise(0.0)
    no = F.lit(None).cast("string")
    reasons = F.when(
        supported,
        F.array_compact(
            F.array(
                F.when(purity < min_purity, "low_family_purity").otherwise(no),
                F.when(second > max_secondary, "mixed_secondary_family").otherwise(no),
                F.when(F.array_contains("tags", "panel_like"), "panel_like_geometry").otherwise(no)
            )
        ),
    ).otherwise(F.array(F.lit("no_semantic_support")))
    return j.select(
        "cluster_id", (F.size(reasons) == 0).alias("accepted"), reasons.alias("reasons"), purity.alias("purity"), second.alias("secondary")
    )


def ranked_clusters(scores: DataFrame, sizes: DataFrame) -> DataFrame:
    """(cluster_id, best, gaussian_count, rank): by the best score, then size, descending; clusters without a score last.

    scores: cluster_id, score. sizes: cluster_id, gaussian_count.
    """
    best = scores.groupBy("cluster_id").agg(F.max("score").alias("best"))
    j = sizes.select("cluster_id", "gaussian_count").join(best, "cluster_id", "left")
    out = numbered(j, [F.desc_nulls_last("best"), F.desc("gaussian_count"), "cluster_id"], "rank")
    return out.select("cluster_id", "best", "gaussian_count", (F.col("rank") + 1).alias("rank"))


def track_masks(
    kept: DataFrame, hits: DataFrame, *, min_points: int = 8, min_shared: int = 4, min_ratio: float = 0.08, min_masks: int = 3
) -> DataFrame:
    """(frame_index, instance_id, mask_index, category, group_id, rank): masks of one object by the 3D points they share.

    kept: frame_index, instance_id, category. hits: frame_index, instance_id, point3d_id, and points where a row stands for
    so many points. Masks are numbered by frame and number; those with too few points are left out. group_id is -1 in
    small groups, which have no rank; rank counts the groups of a category from 1.
    """
    index = cut(numbered(kept.select(*KEYS, "category"), list(KEYS), "mask_index"))
    hits = cut(hits.select(*KEYS, "point3d_id", F.col("points") if "points" in hits.columns else F.lit(1).cast("long").alias("points")))
    enough = hits.groupBy(*KEYS).agg(F.sum("points").alias("n")).where(F.col("n") >= min_points).select(*KEYS)
    tracks = hits.join(enough, list(KEYS), "left_semi").join(index, list(KEYS)).select("mask_index", "category", "point3d_id", "points")
    groups = track_groups(tracks, min_shared=min_shared, min_ratio=min_ratio, min_masks=min_masks).drop("category")
    out = cut(index.join(groups, "mask_index"))
    names = numbered(out.where("group_id >= 0").select("category", "group_id").distinct(), ["group_id"], "rank", ["category"])
    return out.join(
        names.select("group_id", (F.col("rank") + 1).alias("rank")), "group_id", "left"
    ).select(*KEYS, "mask_index", "category", "group_id", "rank")


def resolve_frames(images: DataFrame, frames: DataFrame) -> DataFrame:
    """``images`` (path, position) with frame_index by exact path, else by base name, else by position; null if none fits.

    frames: file_path, frame_index; both paths are normalised first.
    """
    f = frames.select(L.normal_path("file_path").alias("_p"), F.col("frame_index").alias("_i"))
    exact = f.groupBy("_p").agg(F.max("_i").alias("_exact"))
    base = f.groupBy(L.base_name("_p").alias("_b")).agg(F.max("_i").alias("_base"))
    index = f.select(F.col("_i").alias("_k"), F.col("_i").alias("_index")).distinct()
    j = images.withColumn("_p", L.normal_path("path")).withColumn("_b", L.base_name("_p"))
    j = j.join(exact, "_p", "left").join(base, "_b", "left").join(index, F.col("position") == F.col("_k"), "left")
    return j.select(*images.columns, F.coalesce("_exact", "_base", "_index").alias("frame_index"))


def gather(label_pixels: DataFrame, frame_ids: Sequence[int]) -> DataFrame:
    """Label pixels of the wanted frames; a missing frame is an error."""
    got = label_pixels.where(F.col("frame_index").isin(list(frame_ids)))
    there = {r[0] for r in got.select("frame_index").distinct().collect()}  # at most the frames asked for
    if missing := sorted(set(frame_ids) - there):
        raise ValueError(f"no labels for frames {missing}")
    return got
