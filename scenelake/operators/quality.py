"""Noise, quality and pruning of points.

points: gaussian_index, x, y, z, opacity (logit), scale_0..2 (logarithms). Cutoffs are exact percentiles with linear
interpolation; a handful of numbers reaches the driver and goes back as literals.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.functions import geometry as G
from scenelake.functions.color import sigmoid
from scenelake.operators.ranking import percentiles
from scenelake.operators.spatial import isolated


@dataclass(frozen=True)
class PruneSpec:
    opacity_logit: float = -5.0
    scale_percentile: float = 99.5
    radius_percentile: float = 99.9
    radius_multiplier: float = 1.0
    voxel_size: float | None = None
    min_neighbours: int = 2
    low_opacity: bool = True
    extreme_scale: bool = True
    isolated: bool = True
    radius_outlier: bool = False


@dataclass(frozen=True)
class QualitySpec:
    alpha_floor: float = 0.05
    scale_percentile: float = 99.5
    radius_percentile: float = 99.9
    voxel_size: float | None = None
    min_neighbours: int = 2
    isolated_quality: float = 0.2
    extreme_scale_quality: float = 0.35
    radius_outlier_quality: float = 0.5


def scale_size() -> Column:
    return G.scale_norm("scale_0", "scale_1", "scale_2")


def inferred_voxel(points: DataFrame) -> float:
    """Largest of the diagonal / 256, four median linear scales and 0.001: one row to the driver."""
    box = points.agg(*[(F.max(c).cast("double") - F.min(c).cast("double")).alias(c) for c in "xyz"]).first()
    diag = sum((box[c] or 0.0) ** 2 for c in "xyz") ** 0.5
    three = points.select(F.explode(F.array(*[F.exp(F.col(f"scale_{i}").cast("double")) for i in range(3)])).alias("s"))
    med = percentiles(three, {"m": ("s", 0.5)})["m"] or 0.0
    return max(diag / 256, 4 * med, 1e-3)


def with_radius(points: DataFrame) -> DataFrame:
    """``points`` with radius, the distance to the per-axis median."""
    mid = percentiles(points, {c: (c, 0.5) for c in "xyz"})
    return points.withColumn("radius", G.norm(*(F.col(c).cast("double") - F.lit(mid[c]).cast("double") for c in "xyz")))


def measured(
    points: DataFrame, *, scale_percentile: float, radius_percentile: float, voxel_size: float | None, min_neighbours: int
) -> DataFrame:
    """``points`` with size, radius, both cutoffs, and isolated."""
    base = with_radius(points).withColumn("size", scale_size())
    cut = percentiles(base, {"size_cutoff": ("size", scale_percentile / 100), "radius_cutoff": ("radius", radius_percentile / 100)})
    lone = isolated(points, voxel_size or inferred_voxel(points), min_neighbours).select("gaussian_index", "isolated")
    return base.withColumns({k: F.lit(v).cast("double") for k, v in cut.items()}).join(lone, "gaussian_index")


def prune_mask(points: DataFrame, spec: PruneSpec = PruneSpec()) -> DataFrame:
    """(gaussian_index, keep): every switched-on test passes."""
    m = measured(
        points, scale_percentile=spec.scale_percentile, radius_percentile=spec.radius_percentile, voxel_size=spec.voxel_size,
        min_neighbours=spec.min_neighbours
    )
    keep = F.lit(True)
    for on, test in (
        (spec.low_opacity, F.col("opacity") >= spec.opacity_logit),
        (spec.extreme_scale, F.col("size") <= F.col("size_cutoff")),
        (spec.radius_outlier, F.col("radius") <= F.col("radius_cutoff") * spec.radius_multiplier),
        (spec.isolated, ~F.col("isolated")),
    ):
        keep = keep & test if on else keep
    return m.select("gaussian_index", keep.alias("keep"))


def quality_scores(points: DataFrame, spec: QualitySpec = QualitySpec()) -> DataFrame:
    """(gaussian_index, quality, low_opacity, isolated, extreme_scale, radius_outlier)."""
    m = measured(
        points, scale_percentile=spec.scale_percentile, radius_percentile=spec.radius_percentile, voxel_size=spec.voxel_size,
        min_neighbours=spec.min_neighbours
    )
    floor = max(spec.alpha_floor, 1e-6)
    alpha = sigmoid("opacity")
    extreme, far = F.col("size") > F.col("size_cutoff"), F.col("radius") > F.col("radius_cutoff")
    q = G.clip((alpha - floor) / (1 - floor), 0.0, 1.0)
    for flag, factor in (
        (F.col("isolated"), spec.isolated_quality), (extreme, spec.extreme_scale_quality), (far, spec.radius_outlier_quality)
    ):
        q = q * F.when(flag, factor).otherwise(1.0)
    return m.select(
        "gaussian_index", G.clip(q, 0.0, 1.0).alias("quality"), (alpha < floor).alias("low_opacity"), "isolated",
        extreme.alias("extreme_scale"), far.alias("radius_outlier")
    )


def noise_report(
    points: DataFrame, *, opacity_logit: float = -5.0, scale_percentile: float = 99.5, voxel_size: float | None = None,
    min_neighbours: int = 2
) -> DataFrame:
    """One row of counts and quantiles; zeros for an empty table."""
    m = measured(
        points, scale_percentile=scale_percentile, radius_percentile=100.0, voxel_size=voxel_size or (inferred_voxel(points)),
        min_neighbours=min_neighbours
    )
    qs = {f"{c}_p{str(q).replace('.', '_')}": (c, q / 100) for c in ("opacity", "size") for q in (50, 90, 99, 99.9)}
    found = percentiles(m, qs)
    return m.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("opacity") < opacity_logit).alias("low_opacity"),
        F.count_if("isolated").alias("isolated"),
        F.count_if(F.col("size") > F.col("size_cutoff")).alias("extreme_scale"),
        *[F.lit(v or 0.0).alias(k) for k, v in found.items()],
    )


def quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> DataFrame:
    """One row of exact percentiles, e.g. p50, p99_5."""
    found = percentiles(df, {f"p{str(s).replace('.', '_')}": (column, s / 100) for s in shares})
    return df.sparkSession.createDataFrame([tuple(found.values())], ", ".join(f"{k} double" for k in found))


def finite_and_visible(table: DataFrame, columns: Sequence[str], opacity_logit: float = -5.5373) -> DataFrame:
    """Rows whose columns are all finite and whose opacity reaches the bound."""
    ok = F.col("opacity") >= opacity_logit
    for c in columns:
        ok = ok & G.finite(c)
    return table.where(ok)


def finite_counts(table: DataFrame, columns: Sequence[str], opacity_logit: float = -5.5373) -> DataFrame:
    """One row: total, non_finite, low_opacity (finite ones), kept."""
    fin = F.lit(True)
    for c in columns:
        fin = fin & G.finite(c)
    low = fin & (F.col("opacity") < opacity_logit)
    return table.agg(
        F.count("*").alias("total"), F.count_if(~fin).alias("non_finite"), F.count_if(low).alias("low_opacity"),
        F.count_if(fin & ~low).alias("kept")
    )


def scene_bounds(
    points: DataFrame, visible: DataFrame, distance: DataFrame, keep: DataFrame, *, min_visible: int = 2, radius_percentile: float = 99.5,
    distance_percentile: float = 99.5, noise: bool = True
) -> DataFrame:
    """(gaussian_index, removed): seen in too few frames and far out or far from any camera, or noise."""
    j = with_radius(points).join(
        visible.select("gaussian_index", "visible"), "gaussian_index"
    ).join(distance, "gaussian_index").join(keep.select("gaussian_index", "keep"), "gaussian_index")
    cut = percentiles(j, {"r": ("radius", radius_percentile / 100), "d": ("camera_distance", distance_percentile / 100)})
    far = (F.col("radius") > F.lit(cut["r"]).cast("double")) | (F.col("camera_distance") > F.lit(cut["d"]).cast("double"))
    gone = (F.col("visible") < min_visible) & far
    return j.select("gaussian_index", (gone | ~F.col("keep") if noise else gone).alias("removed"))


def filter_sidecar(sidecar: DataFrame, keep: DataFrame) -> DataFrame:
    """Sidecar rows of kept points; lengths must agree."""
    n, m = sidecar.count(), keep.count()
    if n != m:
        raise ValueError(f"the sidecar has {n} rows, the mask {m}")
    return sidecar.join(keep.where("keep"), "gaussian_index", "left_semi")
