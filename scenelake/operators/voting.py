"""From projected points and masks to votes, and from votes to objects.

votes: (frame_index, instance_id, gaussian_index, weight). An id of -1 stands for unknown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.operators.graph import connected_components
from scenelake.operators.ranking import numbered
from scenelake.plans.lineage import cut

KEYS = ("frame_index", "instance_id")


def aggregate_votes(votes: DataFrame) -> DataFrame:
    """One row per (frame, instance, point) with the summed weight."""
    return votes.groupBy(*KEYS, "gaussian_index").agg(F.sum("weight").alias("weight"))


def local_instances(votes: DataFrame) -> DataFrame:
    """(frame_index, instance_id, local_index, support_size) in order of frame and instance."""
    return numbered(votes.groupBy(*KEYS).agg(F.count_distinct("gaussian_index").alias("support_size")), list(KEYS), "local_index")


def candidates(instances: DataFrame, least: int = 1, most: int | None = None) -> DataFrame:
    """Instances whose support is within bounds."""
    keep = F.col("support_size") >= least
    return instances.where(keep if most is None else keep & (F.col("support_size") <= most))


def instance_overlap(
    votes: DataFrame, instances: DataFrame, *, max_frame_gap: int = 1, min_shared: int = 32, min_ratio: float = 0.1,
    same_family: bool = False
) -> DataFrame:
    """(lhs, rhs, shared, overlap_ratio) of instances of frames at most ``max_frame_gap`` apart that share points.

    The band on frames becomes an equality by listing the later frames, so the join hashes on (point, frame).
    ``instances`` may hold candidates only and, for ``same_family``, a column label_family.
    """
    own = aggregate_votes(votes).select(*KEYS, "gaussian_index").join(instances.select(*KEYS, "local_index"), list(KEYS))
    left = own.select(
        "gaussian_index", F.col("local_index").alias("lhs"),
        F.explode(F.sequence(F.col("frame_index") + 1, F.col("frame_index") + max_frame_gap)).alias("frame_index")
    )
    right = own.select("gaussian_index", "frame_index", F.col("local_index").alias("rhs"))
    shared = left.join(
        right, ["gaussian_index", "frame_index"]
    ).groupBy("lhs", "rhs").agg(F.count("*").alias("shared")).where(F.col("shared") >= min_shared)
    side = lambda name: instances.select(F.col("local_index").alias(name), F.col("support_size").alias(f"_n_{name}"), *([F.col("label_family").alias(f"_f_{name}")] if same_family else []))
    pairs = shared.join(side("lhs"), "lhs").join(side("rhs"), "rhs").withColumn(
        "overlap_ratio", F.col("shared") / F.least("_n_lhs", "_n_rhs")
    )
    keep = F.col("overlap_ratio") >= min_ratio
    if same_family:
        keep = keep & (F.col("_f_lhs") == F.col("_f_rhs"))
    return pairs.where(keep).select("lhs", "rhs", "shared", "overlap_ratio")


def global_objects(instances: DataFrame, pairs: DataFrame, candidate: Column | None = None) -> DataFrame:
    """``instances`` with object_id: dense ids of components in order of their smallest local_index; -1 off candidates."""
    parts = connected_components(pairs, "lhs", "rhs")
    named = instances.join(parts.withColumnRenamed("node", "local_index"), "local_index", "left")
    ok = F.lit(True) if candidate is None else candidate
    root = F.when(ok, F.coalesce("component", F.col("local_index").cast("long")))
    named = named.withColumn("_root", root)
    ids = numbered(named.where("_root is not null").select("_root").distinct(), ["_root"], "object_id")
    # one row an instance, used by several branches of most summaries
    return cut(
        named.join(ids, "_root", "left").withColumn("object_id", F.coalesce("object_id", F.lit(-1))).select(*instances.columns, "object_id")
    )


def argmax(df: DataFrame, key: str, value: str, choice: str) -> DataFrame:
    """(key, choice, value): the largest value of each key, of equal ones the smallest choice."""
    best = df.groupBy(key).agg(F.max(F.struct(F.col(value).alias("v"), (-F.col(choice)).alias("c"))).alias("b"))
    return best.select(key, (-F.col("b.c")).alias(choice), F.col("b.v").alias(value))


def assign_objects(votes: DataFrame, instances: DataFrame, points: DataFrame, min_weight: float = 1e-4) -> DataFrame:
    """(gaussian_index, object_id) of every point: its heaviest object; -1 without votes or at most ``min_weight``."""
    per = votes.join(
        instances.where("object_id >= 0").select(*KEYS, "object_id"), list(KEYS)
    ).groupBy("gaussian_index", "object_id").agg(F.sum("weight").alias("weight"))
    best = argmax(per, "gaussian_index", "weight", "object_id").where(F.col("weight") > F.lit(min_weight))
    return points.select("gaussian_index").join(
        best.select("gaussian_index", "object_id"), "gaussian_index", "left"
    ).withColumn("object_id", F.coalesce("object_id", F.lit(-1)))


def object_geometry(ids: DataFrame, points: DataFrame, key: str = "object_id") -> DataFrame:
    """Count, centroid and bounds of the points of each object >= 0."""
    aggs = [F.count("*").alias("gaussian_count")]
    for c in "xyz":
        aggs += [F.avg(F.col(c).cast("double")).alias(f"centroid_{c}"), F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
    return ids.where(F.col(key) >= 0).join(points.select("gaussian_index", "x", "y", "z"), "gaussian_index").groupBy(key).agg(*aggs)


def object_evidence(votes: DataFrame, instances: DataFrame) -> DataFrame:
    """Support frames, instance count and total vote weight of each object, over all its instances' votes."""
    held = instances.where("object_id >= 0")
    weights = votes.join(held.select(*KEYS, "object_id"), list(KEYS)).groupBy("object_id").agg(F.sum("weight").alias("total_vote_weight"))
    frames = held.groupBy("object_id").agg(
        F.array_sort(F.collect_set("frame_index")).alias("support_frames"), F.count("*").alias("instance_count")
    )
    return frames.join(weights, "object_id", "left")


def group_summary(ids: DataFrame, points: DataFrame, votes: DataFrame, instances: DataFrame) -> DataFrame:
    """Geometry of the assigned points with the evidence of the object's instances."""
    return object_geometry(ids, points).join(object_evidence(votes, instances), "object_id", "left")


def majority(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value): the most common value, nulls aside; of equal ones that seen first by ``order``."""
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    best = counts.groupBy(key).agg(F.max(F.struct(F.col("n"), (-F.col("first")).alias("first"), F.col(value).alias("v"))).alias("b"))
    return best.select(key, F.col("b.v").alias(value))


def proposals(ids: DataFrame, points: DataFrame, votes: DataFrame, instances: DataFrame) -> DataFrame:
    """Group summary with majority label and family; ``instances`` has label and label_family."""
    held = instances.where("object_id >= 0")
    out = group_summary(ids, points, votes, instances).withColumn("frame_count", F.size("support_frames"))
    for c in ("label", "label_family"):
        out = out.join(majority(held, "object_id", c, "local_index"), "object_id", "left")
    return out


def top_proposals(summary: DataFrame, k: int = 0, min_points: int = 0, min_frames: int = 0) -> DataFrame:
    """Largest proposals by points, then frames, then id; ``k`` 0 keeps all."""
    kept = summary.where((F.col("gaussian_count") >= min_points) & (F.col("frame_count") >= min_frames))
    ranked = numbered(kept, [F.desc("gaussian_count"), F.desc("frame_count"), "object_id"], "rank").withColumn("rank", F.col("rank") + 1)
    return ranked.where(F.col("rank") <= k) if k else ranked


def vote_summary(votes: DataFrame, points: DataFrame) -> DataFrame:
    """One row: instances, points covered, coverage ratio (0 without points), votes."""
    s = votes.agg(
        F.count_distinct(F.struct(*KEYS)).alias("instance_count"), F.count_distinct("gaussian_index").alias("covered_count"),
        F.count("*").alias("vote_count")
    )
    n = points.agg(F.count("*").alias("_n"))
    return s.crossJoin(n).select(
        "instance_count", "covered_count", "vote_count",
        F.when(F.col("_n") > 0, F.col("covered_count") / F.col("_n")).otherwise(0.0).alias("coverage_ratio")
    )


def category_votes(votes: DataFrame, categories: DataFrame) -> DataFrame:
    """(gaussian_index, category, weight, support): summed weight and number of votes by category of the instance."""
    return votes.join(categories.select(*KEYS, "category"), list(KEYS)).groupBy("gaussian_index", "category").agg(
        F.sum("weight").alias("weight"), F.count("*").alias("support")
    )


def select_groups(
    sizes: DataFrame, *, skip_largest: int = 0, min_size: int = 0, include: list[int] | None = None, exclude: list[int] | None = None,
    top_k: int | None = None, id_col: str = "object_id", size_col: str = "n"
) -> DataFrame:
    """Ids by size: skip the largest, then bound the size, then in- and exclude, then take the top k."""
    order = [F.desc(size_col), id_col]
    s = numbered(sizes, order, "_r") if skip_largest else sizes.withColumn("_r", F.lit(0))
    s = s.where((F.col("_r") >= skip_largest) & (F.col(size_col) >= min_size))
    if include:
        s = s.where(F.col(id_col).isin(include))
    if exclude:
        s = s.where(~F.col(id_col).isin(exclude))
    return s.drop("_r") if top_k is None else s.drop("_r").orderBy(*order).limit(top_k)


def _weighed(tracks: DataFrame) -> DataFrame:
    """``tracks`` with points, 1 where a row stands for its own point alone."""
    return tracks if "points" in tracks.columns else tracks.withColumn("points", F.lit(1).cast("long"))


def mask_pairs(tracks: DataFrame, *, min_shared: int = 1) -> DataFrame:
    """(lhs, rhs, shared): masks of one category, lhs < rhs, that share so many 3D points at least.

    tracks: distinct (mask_index, category, point3d_id), and points where a row stands for so many. Points that the same
    masks of a category see are counted first: their number, not theirs times the pairs, goes through the pairs of that
    set of masks.
    """
    seen = _weighed(tracks).groupBy("category", "point3d_id").agg(
        F.array_sort(F.collect_set("mask_index")).alias("masks"), F.max("points").alias("points")
    ).where(F.size("masks") > 1)
    sets = seen.groupBy("masks").agg(F.sum("points").alias("n"))
    lhs = sets.select("n", "masks", F.posexplode("masks").alias("_at", "lhs"))
    pairs = lhs.select("n", "lhs", F.explode(F.expr("slice(masks, _at + 2, size(masks))")).alias("rhs"))
    return pairs.groupBy("lhs", "rhs").agg(F.sum("n").alias("shared")).where(F.col("shared") >= min_shared)


def track_groups(tracks: DataFrame, *, min_shared: int = 4, min_ratio: float = 0.08, min_masks: int = 3) -> DataFrame:
    """(mask_index, category, group_id): masks of one category linked by shared 3D points; -1 in small groups.

    tracks: (mask_index, category, point3d_id), and points where a row stands for so many. Groups are numbered by mask
    count, then total support, both descending, then first mask.
    """
    t = cut(_weighed(tracks.where("point3d_id >= 0")).distinct())
    size = t.groupBy("mask_index", "category").agg(F.sum("points").alias("support"))
    shared = mask_pairs(t, min_shared=min_shared)
    n = lambda c: size.select(F.col("mask_index").alias(c), F.col("support").alias(f"_{c}"))
    edges = shared.join(n("lhs"), "lhs").join(n("rhs"), "rhs").where(F.col("shared") / F.least("_lhs", "_rhs") >= min_ratio)
    parts = connected_components(edges, "lhs", "rhs")
    named = size.join(
        parts.withColumnRenamed("node", "mask_index"), "mask_index", "left"
    ).withColumn("root", F.coalesce("component", F.col("mask_index").cast("long")))
    groups = named.groupBy("root").agg(
        F.count("*").alias("masks"), F.sum("support").alias("total"), F.min("mask_index").alias("first")
    ).where(F.col("masks") >= min_masks)
    groups = numbered(groups, [F.desc("masks"), F.desc("total"), "first"], "group_id")
    return named.join(groups.select("root", "group_id"), "root", "left").select(
        "mask_index", "category", F.coalesce("group_id", F.lit(-1)).alias("group_id")
    )
