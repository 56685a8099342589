"""Edits of the point table: moves, repairs, placement checks, merges."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.functions import color as C
from scenelake.functions import geometry as G

ROTATION = ("rot_0", "rot_1", "rot_2", "rot_3")


def move_object(
    table: DataFrame, target: int, translation: Sequence[float], rotation: Sequence[float], pivot: Sequence[float] | str | None = None
) -> DataFrame:
    """Rotate and shift the points of one object_id; quaternions are turned along and normalised.

    pivot: None for the origin, "centroid" for the object's mean (one broadcast row), or a point. A missing object
    changes nothing; NaN in the transform is an error.
    """
    if any(math.isnan(v) for v in (*translation, *rotation)):
        raise ValueError("the transform holds NaN")
    on = F.coalesce(F.col("object_id") == target, F.lit(False))
    if pivot == "centroid":
        mean = table.where(on).agg(*[F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0)).alias(f"_p{c}") for c in "xyz"])
        table = table.crossJoin(F.broadcast(mean))
        centre = [F.col(f"_p{c}") for c in "xyz"]
    else:
        centre = pivot or (0.0, 0.0, 0.0)
    moved = G.rigid("x", "y", "z", rotation, translation, centre)
    turned = G.quaternion_times(G.quaternion_of(rotation), ROTATION)
    new = dict(zip(("x", "y", "z", *ROTATION), (*moved, *turned), strict=True))
    kinds = {f.name: f.dataType for f in table.schema.fields}
    return table.withColumns({k: F.when(on, v).otherwise(F.col(k)).cast(kinds[k]) for k, v in new.items()}).drop("_px", "_py", "_pz")


def in_box(low: Sequence[float], high: Sequence[float], margin: float = 0.0) -> Column:
    """Whether x, y, z lie in an axis-aligned box grown by ``margin``, its faces included."""
    x, y, z = (F.col(c).between(lo - margin, hi + margin) for c, lo, hi in zip("xyz", low, high, strict=True))
    return x & y & z


def repair_region(
    table: DataFrame, target: int, low: Sequence[float], high: Sequence[float], *, mode: str = "blend", margin: float = 0.12,
    color_blend: float = 0.85, opacity_scale: float = 0.85, keep_harmonics: bool = False
) -> DataFrame:
    """Blend what stands inside a removed object's box with the median colour of the shell round it.

    Inner: rows of other objects in the box. Shell: other rows in the box grown by ``margin``, inner ones aside. Modes:
    "blend" colours and fades, "fade" only fades. Nothing changes if the inner set is empty, or the shell in blend mode.
    """
    if mode not in ("blend", "fade"):
        raise ValueError("mode must be 'blend' or 'fade'")
    other = F.coalesce(F.col("object_id") != target, F.lit(True))
    inside = in_box(low, high)
    inner, shell = other & inside, other & in_box(low, high, margin) & ~inside
    dc = ("f_dc_0", "f_dc_1", "f_dc_2")
    tone = table.agg(
        F.count_if(shell).alias("_shell"), *[F.median(F.when(shell, F.col(c).cast("double"))).alias(f"_m{i}") for i, c in enumerate(dc)]
    )
    j = table.crossJoin(F.broadcast(tone))
    act = inner & (F.col("_shell") > 0) if mode == "blend" else inner
    new = {"opacity": F.when(act, F.col("opacity") + math.log(opacity_scale)).otherwise(F.col("opacity"))}
    if mode == "blend":
        new |= {c: F.when(act, (1 - color_blend) * F.col(c) + color_blend * F.col(f"_m{i}")).otherwise(F.col(c)) for i, c in enumerate(dc)}
        if not keep_harmonics:
            new |= {c: F.when(act, 0.0).otherwise(F.col(c)) for c in table.columns if c.startswith("f_rest_")}
    kinds = {f.name: f.dataType for f in table.schema.fields}
    return j.withColumns({k: v.cast(kinds[k]) for k, v in new.items()}).select(*table.columns)


def placement(
    occupancy: DataFrame, corners: Sequence[Sequence[float]], *, upper_x: float, lower_y: float, scale: float,
    translation: Sequence[float] = (0, 0, 0), rotation: Sequence[float] = (1, 0, 0, 0, 1, 0, 0, 0, 1), max_occupied: float = 0.05,
    max_unknown: float = 0.25
) -> DataFrame:
    """One row: free, occupied, unknown pixels under the bottom face of a moved box, their shares and validity.

    occupancy: px, py, value (255 free, 0 occupied, 127 unknown). A pixel counts if its centre is in the convex
    footprint or within half a pixel of its outline. No pixel: invalid, with shares 1.
    """
    pivot = [sum(c[i] for c in corners) / len(corners) for i in range(3)]
    foot = []
    for c in corners[:4]:
        p = [c[i] - pivot[i] for i in range(3)]
        m = [sum(rotation[3 * r + i] * p[i] for i in range(3)) + pivot[r] + translation[r] for r in range(3)]
        foot.append(((upper_x - m[0]) / scale, (m[1] - lower_y) / scale))
    area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(foot, foot[1:] + foot[:1], strict=True))
    sign = 1.0 if area >= 0 else -1.0
    xs, ys = [p[0] for p in foot], [p[1] for p in foot]
    inside = F.col("px").between(
        math.floor(min(xs) - 0.5), math.ceil(max(xs) + 0.5)
    ) & F.col("py").between(math.floor(min(ys) - 0.5), math.ceil(max(ys) + 0.5))
    for (ax, ay), (bx, by) in zip(foot, foot[1:] + foot[:1], strict=True):
        length = math.hypot(bx - ax, by - ay)
        if length:
            inside = inside & (sign * ((bx - ax) * (F.col("py") - ay) - (by - ay) * (F.col("px") - ax)) / length >= -0.5)
    n = occupancy.where(inside).agg(
        F.count("*").alias("n"), F.count_if(F.col("value") == 255).alias("free_pixels"),
        F.count_if(F.col("value") == 0).alias("occupied_pixels"), F.count_if(F.col("value") == 127).alias("unknown_pixels")
    )
    share = lambda c: F.when(F.col("n") > 0, F.col(c) / F.col("n")).otherwise(1.0)
    valid = (F.col("n") > 0) & (share("occupied_pixels") <= max_occupied) & (share("unknown_pixels") <= max_unknown)
    return n.select(
        "free_pixels", "occupied_pixels", "unknown_pixels", F.lit(0).alias("outside_pixels"),
        share("occupied_pixels").alias("occupied_fraction"), share("unknown_pixels").alias("unknown_fraction"), valid.alias("valid")
    )


def merge_categories(parts: Sequence[tuple[str, DataFrame]], palette: dict[str, Sequence[float]], min_selected: int = 1) -> DataFrame:
    """Union of category tables of one schema, each in its colour (near white by default); small ones are skipped."""
    first = parts[0][1]
    out = None
    for name, table in parts:
        if [(f.name, f.dataType) for f in table.schema.fields] != [(f.name, f.dataType) for f in first.schema.fields]:
            raise ValueError(f"the table of {name!r} has another schema")
        if table.limit(min_selected).count() < min_selected:
            continue
        painted = C.highlight(table, F.lit(True), palette.get(name, C.CATEGORY_DEFAULT))
        out = painted if out is None else out.unionAll(painted)
    return first.where("false") if out is None else out


def export_layout(table: DataFrame, rest: str | None = "f_rest", rgb: bool = False) -> DataFrame:
    """Columns in export order: position, zero normals, colours (or bytes), flattened harmonics, opacity, scales, rotation."""
    cols = [F.col(c) for c in "xyz"] + [F.lit(0.0).cast("float").alias(c) for c in ("nx", "ny", "nz")]
    if rgb:
        cols += [C.sh_to_byte(f"f_dc_{i}").alias(n) for i, n in enumerate(("red", "green", "blue"))]
    else:
        cols += [F.col(f"f_dc_{i}") for i in range(3)]
        if rest and rest in table.columns:
            n = table.select(F.max(F.size(rest))).first()[0] or 0
            cols += [F.element_at(rest, i + 1).alias(f"f_rest_{i}") for i in range(n)]
    cols += [F.col(c) for c in ("opacity", "scale_0", "scale_1", "scale_2", *ROTATION)]
    return table.select(*cols)
