"""Column builders on labels, ids and paths."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Families by keyword, first match wins; fixed values.
FAMILIES = (
    ("seat", ("chair", "stool", "ottoman", "sofa", "couch")),
    ("table", ("table", "desk", "nightstand")),
    ("storage", ("cabinet", "shelf", "bookshelf", "wardrobe", "drawer", "dresser")),
    ("media", ("television", "tv", "speaker")),
    ("bed", ("bed",)),
    ("lighting", ("lamp",)),
)
#: Categories by pattern, first match wins; fixed values.
CATEGORIES = (
    ("tv", r"television|tv"),
    ("chair", r"chair|armchair|stool|ottoman"),
    ("table", r"table|desk|nightstand"),
    ("sofa", r"sofa|couch"),
    ("storage", r"cabinet|shelf|bookshelf|wardrobe|drawer|dresser"),
)
#: Labels that proposals are made from; fixed value.
FURNITURE = r"sofa|couch|chair|armchair|stool|ottoman|table|desk|nightstand|television|tv|speaker|cabinet|shelf|bookshelf|wardrobe|drawer|dresser|bed|lamp|plant"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def family(label: Column | str, families: Sequence[tuple[str, Sequence[str]]] = FAMILIES) -> Column:
    """First family one of whose keywords the lower-cased label contains, else null."""
    low = F.lower(_c(label))
    hits = [F.when(reduce(lambda a, b: a | b, (low.contains(k) for k in keys)), F.lit(name)) for name, keys in families]
    return F.coalesce(*hits)


def category_index(label: Column | str, specs: Sequence[tuple[str, str]] = CATEGORIES) -> Column:
    """Place of the first category whose pattern is found in the label, whatever the case, else null."""
    return F.coalesce(*[F.when(_c(label).rlike(f"(?i)({p})"), F.lit(i)) for i, (_, p) in enumerate(specs)])


def matches(label: Column | str, pattern: str) -> Column:
    return F.coalesce(_c(label).rlike(f"(?i)({pattern})"), F.lit(False))


def candidate_score(detection, score) -> Column:
    return F.coalesce(_c(detection), _c(score), F.lit(0.0))


def instance_key(mode: str, *, label="label", frame="frame_index", instance="instance_id") -> Column:
    """Identity of an instance by label family, label, or frame and number."""
    if mode == "label-family":
        return family(label)
    if mode == "label":
        return _c(label)
    if mode == "local-instance":
        return F.format_string("%05d:%04d", _c(frame).cast("long"), _c(instance).cast("long"))
    raise ValueError(f"unknown mode {mode!r}")


def class_name(prefix: str | Column, number: Column | str) -> Column:
    """prefix_NN."""
    p = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.concat(p, F.format_string("_%02d", _c(number).cast("long")))


def frame_name(index: Column | str) -> Column:
    return F.format_string("frame_%05d", _c(index).cast("long"))


def mask_name(index: Column | str) -> Column:
    return F.format_string("mask_%04d.png", _c(index).cast("long"))


def normal_path(path: Column | str) -> Column:
    """Forward slashes, without leading dots and slashes (characters, not a prefix)."""
    return F.regexp_replace(F.translate(_c(path), "\\", "/"), r"^[./]+", "")


def base_name(path: Column | str) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def stem(path: Column | str) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def group_object_id(first: str = "object_id", second: str = "global_object_id") -> Column:
    """Either spelling of a group's id; -1 if both are null."""
    return F.coalesce(_c(first), _c(second), F.lit(-1))


def resolve_classes(wanted: Sequence[str | int], names: dict[int, str]) -> list[int]:
    """Class ids of names or numbers; an unknown one is an error."""
    by_name = {v: k for k, v in names.items()}
    out = []
    for w in wanted:
        if str(w) in by_name:
            out.append(by_name[str(w)])
        elif str(w).isdigit() and int(w) in names:
            out.append(int(w))
        else:
            raise ValueError(f"unknown class {w!r}")
    return out


def geometry_tags(dx, dy, dz, diag, *, min_diag: float = 0.7, min_axis: float = 0.45, mid_axis: float = 0.75) -> Column:
    """["panel_like"] for a large flat box, else no tag."""
    d = F.array_sort(F.array(*(_c(v).cast("double") for v in (dx, dy, dz))))
    flat = (d[2] > 0) & (_c(diag) >= min_diag) & (F.try_divide(d[0], d[2]) <= min_axis) & (F.try_divide(d[1], d[2]) <= mid_axis)
    return F.when(F.coalesce(flat, F.lit(False)), F.array(F.lit("panel_like"))).otherwise(F.array().cast("array<string>"))
