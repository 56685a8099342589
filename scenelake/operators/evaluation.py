"""Comparison of predicted with true groups. ids: gaussian_index, gt, pred; negative ids are unknown."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenelake.plans.lineage import cut

AGREEMENT = ("both_unknown", "matched", "gt_only", "pred_only", "mismatched")


def contingency(ids: DataFrame) -> DataFrame:
    """(gt, pred, n) where both are known."""
    return ids.where("gt >= 0 and pred >= 0").groupBy("gt", "pred").agg(F.count("*").alias("n"))


def marginal(ids: DataFrame, side: str) -> DataFrame:
    return ids.where(F.col(side) >= 0).groupBy(side).agg(F.count("*").alias(f"n_{side}"))


def iou_pairs(ids: DataFrame, min_iou: float = 0.1) -> DataFrame:
    """(gt, pred, n, union, iou) of pairs with enough overlap."""
    j = contingency(ids).join(marginal(ids, "gt"), "gt").join(marginal(ids, "pred"), "pred")
    union = F.col("n_gt") + F.col("n_pred") - F.col("n")
    return j.select("gt", "pred", "n", union.alias("union"), (F.col("n") / union).alias("iou")).where(F.col("iou") >= min_iou)


def greedy_match(pairs: DataFrame, *, merge: int = 16) -> DataFrame:
    """One-to-one greedy matching in order of iou and n descending, union, gt and pred ascending.

    A round takes every pair that comes first for both its sides, which greedy would take too, and drops
    all pairs of the sides used; it ends when no pair is left, however many rounds that takes. The matches of every
    ``merge`` rounds are materialised as one table. Without pairs there is no match.
    """
    order = F.struct((-F.col("iou")).alias("a"), (-F.col("n")).alias("b"), "union", "gt", "pred")
    left, taken = cut(pairs.withColumn("_o", order)), []
    while not taken or not left.isEmpty():
        g = left.groupBy("gt").agg(F.min("_o").alias("_g"))
        p = left.groupBy("pred").agg(F.min("_o").alias("_p"))
        ranked = left.join(g, "gt").join(p, "pred")
        now = cut(ranked.where((F.col("_o") == F.col("_g")) & (F.col("_o") == F.col("_p"))).select("gt", "pred", "n", "union", "iou"))
        taken.append(now)
        if len(taken) == merge:
            taken = [cut(reduce(DataFrame.union, taken))]
        left = cut(left.join(now.select("gt"), "gt", "left_anti").join(now.select("pred"), "pred", "left_anti"))
    return reduce(DataFrame.union, taken)


def metrics(ids: DataFrame, matches: DataFrame) -> DataFrame:
    """One row of group and point level recall, precision and mean IoU; ratios with nothing below are 0."""
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    counts = ids.agg(
        F.count_if(F.col("gt") >= 0).alias("gt_points"), F.count_if(F.col("pred") >= 0).alias("pred_points"),
        F.count_distinct(F.when(F.col("gt") >= 0, F.col("gt"))).alias("gt_groups"),
        F.count_distinct(F.when(F.col("pred") >= 0, F.col("pred"))).alias("pred_groups")
    )
    m = matches.agg(
        F.count("*").alias("matches"), F.coalesce(F.sum("n"), F.lit(0)).alias("matched_points"),
        F.coalesce(F.avg("iou"), F.lit(0.0)).alias("mean_iou")
    )
    j = counts.crossJoin(m)
    return j.select(
        "gt_groups", "pred_groups", "matches", "mean_iou", "matched_points",
        (F.col("gt_groups") - F.col("matches")).alias("unmatched_gt"),
        (F.col("pred_groups") - F.col("matches")).alias("unmatched_pred"),
        ratio("matches", "gt_groups").alias("group_recall"),
        ratio("matches", "pred_groups").alias("group_precision"),
        ratio("matched_points", "gt_points").alias("point_recall"),
        ratio("matched_points", "pred_points").alias("point_precision"),
    )


def label_metrics(labels: DataFrame, matches: DataFrame) -> DataFrame:
    """(label, gt_groups, matched_groups, mean_iou) over labels: gt, label."""
    j = labels.join(matches.select("gt", "iou"), "gt", "left")
    return j.groupBy("label").agg(
        F.count("*").alias("gt_groups"), F.count("iou").alias("matched_groups"), F.coalesce(F.avg("iou"), F.lit(0.0)).alias("mean_iou")
    )


def agreement(ids: DataFrame, matches: DataFrame) -> DataFrame:
    """(gaussian_index, code): 0 neither known, 1 a matched pair, 2 only true, 3 only predicted, 4 another pair."""
    hit = matches.select("gt", "pred", F.lit(True).alias("_hit"))
    j = ids.join(hit, ["gt", "pred"], "left")
    g, p = F.col("gt") >= 0, F.col("pred") >= 0
    return j.select("gaussian_index", F.when(g & p, F.when(F.col("_hit"), 1).otherwise(4)).when(g, 2).when(p, 3).otherwise(0).alias("code"))


def agreement_counts(codes: DataFrame) -> DataFrame:
    """(code, name, n) of all five classes."""
    names = codes.sparkSession.createDataFrame(list(enumerate(AGREEMENT)), "code int, name string")
    return names.join(codes.groupBy("code").agg(F.count("*").alias("n")), "code", "left").fillna(0, ["n"])
