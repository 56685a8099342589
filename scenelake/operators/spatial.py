"""Voxel grids, components of points, oriented boxes and nearest neighbours."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenelake.functions import geometry as G
from scenelake.operators.graph import connected_components
from scenelake.operators.ranking import numbered
from scenelake.operators.sampling import sampled
from scenelake.plans.lineage import broadcast_small, cut

VOXEL = ("vx", "vy", "vz")


def voxels_of(points: DataFrame, size: float) -> DataFrame:
    return points.withColumns({v: G.voxel(c, size) for v, c in zip(VOXEL, "xyz", strict=True)})


def _neighbours(voxels: DataFrame, offsets: list[tuple[int, int, int]], keep: list[str]) -> DataFrame:
    """Each voxel once per offset, moved by it."""
    moves = F.array(*[F.struct(*[F.lit(d).alias(f"d{i}") for i, d in enumerate(o)]) for o in offsets])
    moved = voxels.select(*keep, *VOXEL, F.explode(moves).alias("o"))
    return moved.select(*keep, *[(F.col(v) + F.col(f"o.d{i}")).alias(v) for i, v in enumerate(VOXEL)])


def isolated(points: DataFrame, size: float, least: int = 2) -> DataFrame:
    """(gaussian_index, neighbours, isolated): points in the 27 cells round a point's own, itself included.

    Counts are made per voxel, so the work follows the number of voxels.
    """
    at = voxels_of(points, size).select("gaussian_index", *VOXEL)
    full = at.groupBy(*VOXEL).agg(F.count("*").alias("n"))
    around = _neighbours(full, list(product((-1, 0, 1), repeat=3)), ["n"]).groupBy(*VOXEL).agg(F.sum("n").alias("neighbours"))
    return at.join(around, list(VOXEL)).select("gaussian_index", "neighbours", (F.col("neighbours") < least).alias("isolated"))


def adjacent(voxels: DataFrame, extra: list[str] | None = None, node: str = "node") -> DataFrame:
    """(src, dst): pairs of voxels that touch, by face, edge or corner, each once: along the 13 forward offsets."""
    extra = extra or []
    forward = [o for o in product((-1, 0, 1), repeat=3) if o > (0, 0, 0)]
    near = _neighbours(voxels, forward, [*extra, node]).withColumnRenamed(node, "src")
    return near.join(voxels.select(*extra, *VOXEL, F.col(node).alias("dst")), [*extra, *VOXEL]).select("src", "dst")


def point_components(points: DataFrame, size: float, *, min_voxel_count: int = 1, by: str | None = None) -> DataFrame:
    """(gaussian_index[, by], component): 26-connected components of voxels with enough points, -1 off them.

    Components are numbered from 0 in order of their lexicographically first voxel, within each value of
    ``by``. Voxels, not points, form the graph; each links along the 13 forward offsets. A voxel is known by its place in
    that order, so no two are taken for one.
    """
    extra = [by] if by else []
    at = voxels_of(points, size).select("gaussian_index", *extra, *VOXEL)
    full = at.groupBy(*extra, *VOXEL).agg(F.count("*").alias("n")).where(F.col("n") >= min_voxel_count)
    full = numbered(full, [*extra, *VOXEL], "node")
    parts = connected_components(adjacent(full, extra))
    named = full.join(parts, "node", "left").withColumn("root", F.coalesce("component", "node"))
    ids = numbered(named.select(*extra, "root").distinct(), ["root"], "id", extra)
    voxel_ids = named.join(ids.select("root", "id"), "root").select(*extra, *VOXEL, "id")
    return at.join(voxel_ids, [*extra, *VOXEL], "left").select("gaussian_index", *extra, F.coalesce("id", F.lit(-1)).alias("component"))


def rank_components(
    ids: DataFrame, *, min_points: int = 1, max_points: int | None = None, by: str | None = None, id_col: str = "component", top_k: int = 0
) -> DataFrame:
    """``ids`` with rank: components of allowed size renumbered by size descending, then old id; others -1."""
    extra = [by] if by else []
    n = ids.where(F.col(id_col) >= 0).groupBy(*extra, id_col).agg(F.count("*").alias("_n"))
    ok = F.col("_n") >= min_points
    n = n.where(ok if max_points is None else ok & (F.col("_n") <= max_points))
    n = numbered(n, [F.desc("_n"), id_col], "rank", extra)
    if top_k:
        n = n.where(F.col("rank") < top_k)
    return ids.join(n.drop("_n"), [*extra, id_col], "left").withColumn("rank", F.coalesce("rank", F.lit(-1)))


def cluster_summary(ids: DataFrame, points: DataFrame, size: float, id_col: str = "component") -> DataFrame:
    """Count, centroid, bounds, diagonal and distinct voxels of each component >= 0."""
    j = ids.where(F.col(id_col) >= 0).join(voxels_of(points, size), "gaussian_index")
    aggs = [F.count("*").alias("gaussian_count"), F.count_distinct(*VOXEL).alias("voxel_count")]
    for c in "xyz":
        aggs += [F.avg(F.col(c).cast("double")).alias(f"centroid_{c}"), F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
    s = j.groupBy(id_col).agg(*aggs)
    return s.withColumn("bbox_diag", G.norm(*(F.col(f"max_{c}").cast("double") - F.col(f"min_{c}").cast("double") for c in "xyz")))


def within_diagonal(ids: DataFrame, summary: DataFrame, most: float, id_col: str = "component") -> DataFrame:
    """``ids`` with components of too long a diagonal set to -1, to be ranked again."""
    big = summary.where(F.col("bbox_diag") > most).select(id_col)
    return ids.join(big.withColumn("_big", F.lit(True)), id_col, "left").withColumn(
        id_col, F.when(F.col("_big"), -1).otherwise(F.col(id_col))
    ).drop("_big")


def category_instances(
    best: DataFrame, points: DataFrame, size: float, *, min_voxel_count: int = 1, min_points: int = 1, top_k: int = 0, key: str = "category"
) -> DataFrame:
    """(gaussian_index, key, instance_id): components inside each category, numbered by (category, size rank); -1 for none.

    best: gaussian_index and the point's category, null or negative for none.
    """
    chosen = best.where(F.col(key) >= 0).join(points.select("gaussian_index", "x", "y", "z"), "gaussian_index")
    ranked = rank_components(
        point_components(chosen, size, min_voxel_count=min_voxel_count, by=key), by=key, min_points=min_points, top_k=top_k
    )
    ids = numbered(ranked.where("rank >= 0").select(key, "rank").distinct(), [key, "rank"], "instance_id")
    named = ranked.where("rank >= 0").join(ids, [key, "rank"]).select("gaussian_index", F.col(key), "instance_id")
    return points.select("gaussian_index").join(named, "gaussian_index", "left").withColumn(
        "instance_id", F.coalesce("instance_id", F.lit(-1))
    )


def best_category(
    votes: DataFrame, *, min_weight: float = 0.5, min_support: int = 2, min_foreground: float = 0.0, background: DataFrame | None = None
) -> DataFrame:
    """(gaussian_index, category, weight, support) of the heaviest category that passes all thresholds."""
    best = votes.groupBy("gaussian_index").agg(F.max(F.struct("weight", (-F.col("category")).alias("c"), "support")).alias("b"))
    best = best.select(
        "gaussian_index", (-F.col("b.c")).alias("category"), F.col("b.weight").alias("weight"), F.col("b.support").alias("support")
    )
    if background is not None:
        best = best.join(background, "gaussian_index", "left")
        seen = F.col("support") + F.coalesce("background", F.lit(0))
        best = best.where(F.when(seen > 0, F.col("support") / seen).otherwise(1.0) >= min_foreground)
    return best.where(
        (F.col("weight") >= min_weight) & (F.col("support") >= min_support)
    ).select("gaussian_index", "category", "weight", "support")


def instance_stats(named: DataFrame, values: list[str], id_col: str = "instance_id") -> DataFrame:
    """Count and mean, least, largest and summed value of each instance >= 0."""
    aggs = [F.count("*").alias("gaussian_count")]
    for v in values:
        aggs += [F.sum(v).alias(f"{v}_sum"), F.avg(v).alias(f"{v}_mean"), F.min(v).alias(f"{v}_min"), F.max(v).alias(f"{v}_max")]
    return named.where(F.col(id_col) >= 0).groupBy(id_col).agg(*aggs)


def box_frames(corners: DataFrame) -> DataFrame:
    """Boxes with origin, inverse basis and volume from an array of 8 corners; degenerate or non-finite ones go.

    Basis: corners 1, 3 and 4 less corner 0. Of repeated ids the last by ``position`` counts, if there is one.
    """
    if "position" in corners.columns:
        last = corners.groupBy("object_id").agg(F.max("position").alias("position"))
        corners = corners.join(last, ["object_id", "position"], "left_semi")
    c = lambda k: tuple(F.col("corners")[k][i] for i in range(3))
    inv, det = G.inverse_basis(c(0), c(1), c(3), c(4))
    ok = (F.size("corners") == 8) & F.forall(
        "corners", lambda p: (F.size(p) == 3) & F.forall(p, lambda v: ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    )
    shaped = corners.where(F.coalesce(ok, F.lit(False)))
    return shaped.where(F.abs(det) > 1e-8).select(
        "object_id", F.abs(det).alias("volume"), *[F.col("corners")[0][i].cast("double").alias(f"o{i}") for i in range(3)],
        *[e.alias(f"b{i // 3}{i % 3}") for i, e in enumerate(inv)]
    )


def points_in_boxes(points: DataFrame, boxes: DataFrame, epsilon: float = 1e-4) -> DataFrame:
    """(gaussian_index, object_id, volume) of every point in every box it lies in; annotations are broadcast if they are few."""
    p = [F.col(a).cast("double") - F.col(f"o{i}") for i, a in enumerate("xyz")]
    local: list[Column] = [F.col(f"b{r}0") * p[0] + F.col(f"b{r}1") * p[1] + F.col(f"b{r}2") * p[2] for r in range(3)]
    inside = F.lit(True)
    for v in local:
        inside = inside & v.between(-epsilon, 1 + epsilon)
    return points.select("gaussian_index", "x", "y", "z").join(broadcast_small(boxes), inside).select(
        "gaussian_index", "object_id", "volume"
    )


def assign_boxes(points: DataFrame, boxes: DataFrame, epsilon: float = 1e-4) -> DataFrame:
    """(gaussian_index, object_id): the smallest box by (volume, id) that holds the point, else -1."""
    best = points_in_boxes(points, boxes, epsilon).groupBy("gaussian_index").agg(F.min(F.struct("volume", "object_id")).alias("b"))
    return points.select("gaussian_index").join(
        best.select("gaussian_index", F.col("b.object_id").alias("object_id")), "gaussian_index", "left"
    ).withColumn("object_id", F.coalesce("object_id", F.lit(-1)))


def nearest(points: DataFrame, k: int = 8, *, sample: int | None = 4096, seed: int = 42) -> DataFrame:
    """(i, j, rank, distance): the k nearest others of each point, of equal distances the smaller index first.

    With ``sample``, among as many points in order of the draw, each against each. With None, among all: a point looks for
    others in the 27 cells round its own; it is done once its k-th is no farther than a cell is wide, for what
    lies outside is farther. The others go on with cells twice as wide, until one cell holds everything.
    """
    at = points.select("gaussian_index", *[F.col(c).cast("double").alias(c) for c in "xyz"])
    if sample is not None:
        picked = cut(sampled(at, sample, seed=seed))
        return _first(_pairs(picked, broadcast_small(picked, sample), F.lit(True)), k)
    at = cut(at)
    span = at.agg(F.count("*").alias("n"), *[f(c).alias(f"{m}{c}") for c in "xyz" for m, f in (("lo", F.min), ("hi", F.max))]).first()
    if span["n"] < 2:
        return _first(_pairs(at, at, F.lit(False)), k)
    extent = max(span[f"hi{c}"] - span[f"lo{c}"] for c in "xyz")
    width = extent / max(1.0, (span["n"] / k) ** (1 / 3)) or 1.0
    open_, done = at, []
    while True:
        cell = lambda c, w=width: F.floor((F.col(c) - F.lit(span[f"lo{c}"])) / F.lit(w))
        gridded = at.select("*", *[cell(c).alias(v) for v, c in zip(VOXEL, "xyz", strict=True)])
        asked = open_.select("*", *[cell(c).alias(v) for v, c in zip(VOXEL, "xyz", strict=True)])
        asked = _neighbours(asked, list(product((-1, 0, 1), repeat=3)), ["gaussian_index", *"xyz"])
        same = F.lit(True)
        for v in VOXEL:
            same = same & (F.col(f"a.{v}") == F.col(f"b.{v}"))
        got = _first(_pairs(asked, gridded, same), k)
        if width > extent:  # every cell is a neighbour of every other
            return reduce(DataFrame.union, [*done, got])
        got = cut(got)
        whole = cut(got.where((F.col("rank") == k) & (F.col("distance") <= width)).select("i"))
        done.append(got.join(whole, "i", "left_semi"))
        open_ = cut(open_.join(whole, F.col("gaussian_index") == F.col("i"), "left_anti"))
        if open_.isEmpty():
            return reduce(DataFrame.union, done)
        width *= 2


def _pairs(a: DataFrame, b: DataFrame, on: Column) -> DataFrame:
    d = G.norm(*(F.col(f"a.{c}") - F.col(f"b.{c}") for c in "xyz"))
    met = a.alias("a").join(b.alias("b"), on & (F.col("a.gaussian_index") != F.col("b.gaussian_index")))
    return met.select(F.col("a.gaussian_index").alias("i"), F.col("b.gaussian_index").alias("j"), d.alias("distance"))


def _first(pairs: DataFrame, k: int) -> DataFrame:
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy("distance", "j")))
    return ranked.where(F.col("rank") <= k).select("i", "j", "rank", "distance")
