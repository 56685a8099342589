"""Column builders for colours and opacity."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.functions.geometry import clip

SH_C0 = 0.28209479177387814
#: Bright palettes; fixed values.
PROPOSAL_PALETTE = (
    (0.95, 0.20, 0.20), (0.15, 0.75, 0.25), (0.20, 0.45, 0.95), (0.98, 0.70, 0.18), (0.75, 0.22, 0.85), (0.10, 0.78, 0.78),
    (0.95, 0.45, 0.65), (0.60, 0.85, 0.18)
)
INSTANCE_PALETTE = (
    (0.95, 0.20, 0.20), (0.10, 0.78, 0.78), (0.18, 0.50, 0.95), (0.98, 0.70, 0.15), (0.75, 0.22, 0.88), (0.20, 0.82, 0.30),
    (0.95, 0.45, 0.65), (0.55, 0.85, 0.18)
)
CLASS_PALETTE = (
    (0.90, 0.18, 0.18), (0.15, 0.70, 0.25), (0.20, 0.42, 0.95), (0.98, 0.68, 0.15), (0.72, 0.22, 0.88), (0.08, 0.72, 0.72),
    (0.95, 0.42, 0.62), (0.58, 0.80, 0.16)
)
GOLDEN = 0.61803398875
CATEGORY_DEFAULT = (0.95, 0.95, 0.95)


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sigmoid(c: Column | str) -> Column:
    return 1 / (1 + F.exp(-_c(c).cast("double")))


def rgb_to_sh(c: Column | str) -> Column:
    return (_c(c).cast("double") - 0.5) / SH_C0


def sh_to_byte(c: Column | str) -> Column:
    return F.floor(clip(_c(c).cast("double") * SH_C0 + 0.5, 0.0, 1.0) * 255).cast("int")


def to_byte(c: Column | str) -> Column:
    return F.floor(clip(_c(c).cast("double"), 0.0, 1.0) * 255).cast("int")


def rounded_byte(c: Column | str) -> Column:
    """A share from 0 to 1 as the nearest byte, halves to the even one."""
    return F.rint(clip(_c(c).cast("double"), 0.0, 1.0) * 255).cast("int")


def blend_bytes(a: Column | str, b: Column | str, alpha: float) -> Column:
    """Byte colours blended, alpha held to 0..1, cut to whole bytes."""
    return F.floor(clip(blend(_c(a).cast("double"), _c(b).cast("double"), min(1.0, max(0.0, alpha))), 0.0, 255.0)).cast("int")


def blend(a: Column | str, b: Column | str, alpha: float) -> Column:
    """(1 - alpha) a + alpha b."""
    return (1 - alpha) * _c(a) + alpha * _c(b)


def palette(idx: Column | str, table: Sequence[Sequence[float]] = PROPOSAL_PALETTE) -> Column:
    """array(r, g, b) of the palette entry abs(id) modulo its length."""
    rows = F.array(*[F.array(*[F.lit(float(v)) for v in rgb]) for rgb in table])
    return F.element_at(rows, (F.abs(_c(idx)) % len(table) + 1).cast("int"))


def hashed_color(idx: Column | str) -> Column:
    """array of bytes 64..191 from a linear congruential step on the id; grey for negative ids."""
    i = _c(idx).cast("long")
    seed = (i * 1103515245 + 12345).bitwiseAND(0x7FFFFFFF)
    rgb = F.array(*[(F.shiftright(seed, s).bitwiseAND(0x7F) + 64).cast("int") for s in (0, 7, 14)])
    return F.when(i < 0, F.array(*[F.lit(96)] * 3)).otherwise(rgb)


def golden_color(idx: Column | str, saturation: float = 0.75, value: float = 1.0) -> Column:
    """array of bytes: hues a golden ratio apart; black for negative ids."""
    i = _c(idx).cast("double")
    h = (i * GOLDEN) % 1.0 * 6
    channels = []
    for shift in (5, 3, 1):  # the usual closed form of hue, saturation, value to red, green, blue
        k = (F.lit(float(shift)) + h) % 6.0
        channels.append(F.floor((value - value * saturation * clip(F.least(k, 4.0 - k), 0.0, 1.0)) * 255 + 1e-9).cast("int"))
    return F.when(_c(idx) < 0, F.array(*[F.lit(0)] * 3)).otherwise(F.array(*channels))


def class_colors(n: int) -> list[tuple[float, float, float]]:
    """Colours of ``n`` classes: the palette, then pale hues a golden ratio apart."""
    out = [tuple(c) for c in CLASS_PALETTE[:n]]
    for i in range(len(out), n):
        h = i * GOLDEN % 1.0 * 6
        ramp = 0.70 * (1 - abs((h - int(h)) % 2.0 - 1.0))
        place = {0: (0, 1), 1: (1, 0), 2: (1, 2), 3: (2, 1), 4: (2, 0), 5: (0, 2)}[int(h) % 6]
        rgb = [0.0, 0.0, 0.0]
        rgb[place[0]], rgb[place[1]] = 0.70, ramp
        out.append(tuple(v + 0.25 for v in rgb))
    return out


def highlight(
    table: DataFrame, selected: Column, rgb: Sequence[float] | Column, *, alpha: float = 1.0, dim_scale: float = 1.0,
    selected_scale: float = 1.0, flatten: bool = True
) -> DataFrame:
    """Recolour selected rows, flatten their higher harmonics and shift opacities by ln(scale).

    ``rgb`` is a constant or a column with an array. Rows and column order stay; scales must be positive.
    """
    if dim_scale <= 0 or selected_scale <= 0:
        raise ValueError("opacity scales must be positive")
    selected = F.coalesce(selected, F.lit(False))
    target = rgb if isinstance(rgb, Column) else F.array(*[F.lit(float(v)) for v in rgb])
    new = {}
    for i, name in enumerate(("f_dc_0", "f_dc_1", "f_dc_2")):
        new[name] = F.when(selected, blend(name, rgb_to_sh(target[i]), alpha)).otherwise(F.col(name)).cast(table.schema[name].dataType)
    if flatten:
        for name in table.columns:
            if name.startswith("f_rest_"):
                new[name] = F.when(selected, F.lit(0.0)).otherwise(F.col(name)).cast(table.schema[name].dataType)
    if "opacity" in table.columns:
        shift = F.when(selected, math.log(selected_scale)).otherwise(math.log(dim_scale))
        new["opacity"] = (F.col("opacity") + shift).cast(table.schema["opacity"].dataType)
    return table.withColumns(new)


def to_uint16(c: Column | str, low: Column, high: Column) -> Column:
    """Depth preview: clip to [low, high] and stretch to 0..65535; all 0 if the two are equal."""
    share = F.when(high > low, (clip_between(_c(c).cast("double"), low, high) - low) / (high - low)).otherwise(0.0)
    return F.floor(share * 65535).cast("int")


def clip_between(c: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(c, low), high)
