"""Global row numbers and exact percentiles without bringing a table into one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenelake.plans.lineage import cut

_ROW_BITS = 33  # of monotonically_increasing_id: the partition's number stands above them


def numbered(df: DataFrame, order: list, name: str, by: list[str] | None = None) -> DataFrame:
    """``df`` with ``name``: the row's place from 0 in the given order, within each value of ``by`` if given.

    Rows are dealt by range, sorted and materialised; a row's place is its place in its partition plus the rows of
    the partitions before. Only one count a partition is ranked in one task. The order should be total.
    """
    keys = [F.col(k) for k in by or []] + [F.col(o) if isinstance(o, str) else o for o in order]
    sorted_ = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys)).withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftrightunsigned("_at", _ROW_BITS)
    place = F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1)
    sizes = sorted_.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # one row a partition
    out = sorted_.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + place)
    if by:
        first = out.groupBy(*by).agg(F.min(name).alias("_first"))
        out = out.join(first, by).withColumn(name, F.col(name) - F.col("_first"))
    return out.select(*df.columns, name)


def percentiles(df: DataFrame, wanted: dict[str, tuple[Column | str, float]], accuracy: int = 10_000) -> dict[str, float | None]:
    """Exact percentiles (share from 0 to 1) with linear interpolation, as numbers; null values aside, null for no value.

    A sketch brackets each percentile within a few ten-thousandths of the rows; exact counts below the bracket and of each
    value in it give the two order statistics. No task sorts or holds the column.
    """
    cols = {k: (F.col(c) if isinstance(c, str) else c).cast("double") for k, (c, _) in wanted.items()}
    slack = 4.0 / accuracy
    aggs = []
    for k, (_, q) in wanted.items():
        aggs += [
            F.count(cols[k]).alias(f"n_{k}"),
            F.percentile_approx(cols[k], [max(0.0, q - slack), min(1.0, q + slack)], accuracy).alias(f"b_{k}"),
            F.min(cols[k]).alias(f"lo_{k}"), F.max(cols[k]).alias(f"hi_{k}")
        ]
    got = df.agg(*aggs).first().asDict()
    ranges = {}
    for k, (_, q) in wanted.items():
        if got[f"n_{k}"]:
            lo, hi = got[f"b_{k}"]
            few = got[f"n_{k}"] <= accuracy  # then the slack is under a row, and the whole range is small
            ranges[k] = (got[f"lo_{k}"] if few or q <= slack else lo, got[f"hi_{k}"] if few or q >= 1 - slack else hi)
    if not ranges:
        return dict.fromkeys(wanted)
    below = df.agg(*[F.count_if(cols[k] < lo).alias(k) for k, (lo, _) in ranges.items()]).first().asDict()
    items = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.when(cols[k].between(*r), cols[k]).alias("v")) for k, r in ranges.items()]))
    inside = df.select(items.alias("i")).select("i.k", "i.v").where("v is not null").groupBy("k", "v").agg(F.count("*").alias("n"))
    upto = inside.withColumn("to", F.sum("n").over(Window.partitionBy("k").orderBy("v")))
    need = []
    for k in ranges:
        at = wanted[k][1] * (got[f"n_{k}"] - 1)
        need += [(k, math.floor(at) - below[k], 0), (k, math.ceil(at) - below[k], 1)]
    asked = df.sparkSession.createDataFrame(need, "k string, place long, side int")
    hit = upto.join(F.broadcast(asked), "k").where((F.col("to") > F.col("place")) & (F.col("to") - F.col("n") <= F.col("place")))
    value = {(r["k"], r["side"]): r["v"] for r in hit.collect()}  # two rows a percentile
    out: dict[str, float | None] = dict.fromkeys(wanted)
    for k in ranges:
        at = wanted[k][1] * (got[f"n_{k}"] - 1)
        a, b, t = value[k, 0], value[k, 1], at - math.floor(at)
        out[k] = a + (b - a) * t if t < 0.5 else b - (b - a) * (1 - t)
    return out
