"""Column builders of camera and solid geometry. Inputs and results are DOUBLE unless said otherwise."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

CAMERA_MODELS = ("PINHOLE", "OPENCV_FISHEYE", "OPENCV")


def _d(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def finite(c: Column | str) -> Column:
    """Neither NaN nor infinite; false for null."""
    c = _d(c)
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def world_to_camera(x, y, z, rotation: Sequence[Column | float], translation: Sequence[Column | float]) -> tuple[Column, Column, Column]:
    """R p + t, R row by row."""
    p = [_d(c) for c in (x, y, z)]
    r = [v if isinstance(v, Column) else F.lit(float(v)) for v in rotation]
    t = [v if isinstance(v, Column) else F.lit(float(v)) for v in translation]
    return tuple(r[3 * i] * p[0] + r[3 * i + 1] * p[1] + r[3 * i + 2] * p[2] + t[i] for i in range(3))


def _poly(base: Column, coefs: Sequence[float], powers: Column) -> Column:
    """base + c0 p + c1 p^2 + ..., powers multiplied up in order."""
    out, term = base, None
    for c in coefs:
        term = powers if term is None else term * powers
        if c:
            out = out + F.lit(float(c)) * term
    return out


def project(
    camera: tuple[Column, Column, Column], model: str, fl_x, fl_y, cx, cy, distortion: Sequence[float] = ()
) -> tuple[Column, Column]:
    """Pixel (u, v) of camera-frame points; null where the depth is 0. Missing distortion coefficients are 0."""
    model = model.upper()
    if model not in CAMERA_MODELS:
        raise ValueError(f"camera model {model!r} is not one of {CAMERA_MODELS}")
    x, y = F.try_divide(camera[0], camera[2]), F.try_divide(camera[1], camera[2])
    k = [*map(float, distortion), *[0.0] * 8]
    if model == "OPENCV_FISHEYE":
        r = F.sqrt(x * x + y * y)
        theta = F.atan(r)
        scale = F.when(r > 1e-8, F.try_divide(theta * _poly(F.lit(1.0), k[:4], theta * theta), r)).otherwise(1.0)
        x, y = x * scale, y * scale
    elif model == "OPENCV":
        k1, k2, p1, p2, k3, k4, k5, k6 = k[:8]
        r2 = x * x + y * y
        radial = F.try_divide(_poly(F.lit(1.0), (k1, k2, k3), r2), _poly(F.lit(1.0), (k4, k5, k6), r2))
        cross = 2.0 * x * y
        x, y = x * radial + p1 * cross + p2 * (r2 + 2.0 * x * x), y * radial + p1 * (r2 + 2.0 * y * y) + p2 * cross
    return F.lit(float(fl_x)) * x + F.lit(float(cx)), F.lit(float(fl_y)) * y + F.lit(float(cy))


def in_view(u: Column, v: Column, depth: Column, width: int, height: int) -> Column:
    """Positive depth, finite, inside the image."""
    return finite(u) & finite(v) & (depth > 0) & (u >= 0) & (u < width) & (v >= 0) & (v < height)


def pixel(c: Column | str) -> Column:
    """Whole pixel of a coordinate that is stored as FLOAT; the rounding may reach the image's edge, so check again."""
    return F.floor((F.col(c) if isinstance(c, str) else c).cast("float").cast("double"))


def pixel_id(x, y, width: int) -> Column:
    return F.col(y) * F.lit(width) + F.col(x) if isinstance(x, str) else y * F.lit(width) + x


def voxel(c: Column | str, size: float) -> Column:
    """floor(x / size) computed in 32-bit floats."""
    ratio = (F.col(c) if isinstance(c, str) else c).cast("float").cast("double") / F.lit(float(size)).cast("float").cast("double")
    return F.floor(ratio.cast("float").cast("double")).cast("int")


def norm(*cols: Column) -> Column:
    total = cols[0] * cols[0]
    for c in cols[1:]:
        total = total + c * c
    return F.sqrt(total)


def scale_norm(s0, s1, s2) -> Column:
    """Length of the linear scales, which are stored as logarithms."""
    return norm(*(F.exp(_d(s)) for s in (s0, s1, s2)))


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def box_xyxy(cx, cy, w, h, width: int, height: int) -> tuple[Column, Column, Column, Column]:
    """Corners of a centre-size box given in shares of the image, clipped to it."""
    cx, cy, w, h = (_d(c) for c in (cx, cy, w, h))
    return (
        clip((cx - w / 2) * width, 0.0, float(width)),
        clip((cy - h / 2) * height, 0.0, float(height)),
        clip((cx + w / 2) * width, 0.0, float(width)),
        clip((cy + h / 2) * height, 0.0, float(height)),
    )


def area_ratio(area, width, height) -> Column:
    return _d(area) / F.greatest(_d(width) * _d(height), F.lit(1.0))


def occupancy_pixel(x, y, upper_x: float, lower_y: float, scale: float) -> tuple[Column, Column]:
    """World x, y on the occupancy image: x runs backwards from the upper bound."""
    return (F.lit(float(upper_x)) - _d(x)) / F.lit(float(scale)), (_d(y) - F.lit(float(lower_y))) / F.lit(float(scale))


def rigid(
    x, y, z, rotation: Sequence[float], translation: Sequence[float], pivot: Sequence[Column | float]
) -> tuple[Column, Column, Column]:
    """R (p - pivot) + pivot + t."""
    pv = [v if isinstance(v, Column) else F.lit(float(v)) for v in pivot]
    p = [_d(c) - v for c, v in zip((x, y, z), pv, strict=True)]
    moved = world_to_camera(*p, rotation, translation)
    return tuple(m + v for m, v in zip(moved, pv, strict=True))


def rotation_about(axis: Sequence[float], degrees: float) -> list[float]:
    """Row-major 3x3 rotation about an axis through the origin (Rodrigues); a zero axis is an error."""
    n = math.sqrt(sum(a * a for a in axis))
    if n <= 0:
        raise ValueError("the rotation axis must not be zero")
    x, y, z = (a / n for a in axis)
    a = math.radians(degrees)
    c, s, d = math.cos(a), math.sin(a), 1 - math.cos(a)
    return [
        c + x * x * d, x * y * d - z * s, x * z * d + y * s, y * x * d + z * s, c + y * y * d, y * z * d - x * s, z * x * d - y * s,
        z * y * d + x * s, c + z * z * d
    ]


def rotation_z(degrees: float) -> list[float]:
    return rotation_about((0, 0, 1), degrees)


def quaternion_of(m: Sequence[float]) -> list[float]:
    """Unit quaternion (w, x, y, z) of a row-major rotation, from its largest diagonal combination."""
    t = [m[0] + m[4] + m[8], m[0] - m[4] - m[8], m[4] - m[0] - m[8], m[8] - m[0] - m[4]]
    k = 0 if t[0] > 0 else max((1, 2, 3), key=lambda i: t[i])
    s = 2 * math.sqrt(1 + t[k])
    skew = [m[7] - m[5], m[2] - m[6], m[3] - m[1]]
    even = {(1, 2): m[1] + m[3], (1, 3): m[2] + m[6], (2, 3): m[5] + m[7]}
    q = [0.0] * 4
    q[k] = s / 4
    for j in range(4):
        if j != k:
            q[j] = (skew[max(j, k) - 1] if 0 in (j, k) else even[min(j, k), max(j, k)]) / s
    length = math.sqrt(sum(v * v for v in q))
    return [v / length for v in q]


def quaternion_times(q: Sequence[float], cols: Sequence[Column | str]) -> list[Column]:
    """Normalised Hamilton product of a constant quaternion and quaternion columns, both (w, x, y, z)."""
    w1, x1, y1, z1 = q
    w2, x2, y2, z2 = (_d(c) for c in cols)
    out = [
        w1 * w2 - x1 * x2 - y1 * y2 - z1 * z2,
        w1 * x2 + x1 * w2 + y1 * z2 - z1 * y2,
        w1 * y2 - x1 * z2 + y1 * w2 + z1 * x2,
        w1 * z2 + x1 * y2 - y1 * x2 + z1 * w2,
    ]
    length = F.greatest(norm(*out), F.lit(1e-12))
    return [c / length for c in out]


def inverse_basis(o, a, b, c) -> tuple[list[Column], Column]:
    """Row-major inverse of the matrix with columns a - o, b - o, c - o (3-tuples of columns), and its determinant."""
    u, v, w = ([_d(p[i]) - _d(o[i]) for i in range(3)] for p in (a, b, c))
    cross = lambda p, q: [p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]]
    vw, wu, uv = cross(v, w), cross(w, u), cross(u, v)
    det = u[0] * vw[0] + u[1] * vw[1] + u[2] * vw[2]
    return [F.try_divide(e, det) for row in (vw, wu, uv) for e in row], det
