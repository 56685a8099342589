"""Seeded samples that any engine can repeat."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw_key(key: str = "gaussian_index", seed: int = 42) -> Column:
    """The order of the draw: the MD5 of "key:seed" in hexadecimal."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def sampled(rows: DataFrame, n: int, *, by: Sequence[str] = (), key: str = "gaussian_index", seed: int = 42) -> DataFrame:
    """At most ``n`` rows, of each value of ``by`` if given: the first in order of the draw."""
    if not by:
        return rows.orderBy(draw_key(key, seed), key).limit(n)
    order = Window.partitionBy(*by).orderBy(draw_key(key, seed), key)
    return rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")


def context_sample(rows: DataFrame, selected: Column, budget: int, *, key: str = "gaussian_index", seed: int = 42) -> DataFrame:
    """``rows`` with ``selected``, thinned to ``budget``: up to half of it for selected rows, the rest for others.

    All stay if they are no more than the budget. One row of selected ones is kept however small the budget is.
    """
    marked = rows.withColumn("selected", F.coalesce(selected, F.lit(False)))
    n = marked.agg(F.count("*").alias("all"), F.count_if("selected").alias("on")).first()
    if n["all"] <= budget:
        return marked
    on = min(n["on"], max(1, budget // 2))
    return sampled(marked.where("selected"), on, key=key, seed=seed).union(
        sampled(marked.where("not selected"), max(0, budget - on), key=key, seed=seed)
    )
