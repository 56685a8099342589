"""The relational algebra of identity losses and classification; no training happens here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def class_weights(labels: DataFrame, classes: DataFrame, power: float = 1.0) -> DataFrame:
    """(class_index, n, weight): (mean present count / (n + 1e-6)) ** power, scaled to mean 1 over present classes; absent 1."""
    n = classes.join(labels.groupBy("class_index").agg(F.count("*").alias("n")), "class_index", "left").fillna(0, ["n"])
    every = Window.partitionBy(F.lit(0))  # one row a class
    present = F.col("n") > 0
    raw = n.withColumn("_m", F.avg(F.when(present, F.col("n"))).over(every)).withColumn(
        "_w", F.when(present, F.pow(F.col("_m") / (F.col("n") + 1e-6), F.lit(power)))
    )
    return raw.withColumn("_a", F.avg("_w").over(every)).select(
        "class_index", "n", F.when(present, F.col("_w") / F.col("_a")).otherwise(1.0).alias("weight")
    )


def softmax_of(logits: Column) -> Column:
    """Softmax of an array, shifted by its maximum."""
    e = F.transform(logits, lambda v: F.exp(v - F.array_max(logits)))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def focal_cross_entropy(rows: DataFrame, weights: DataFrame | None = None, gamma: float = 0.0) -> DataFrame:
    """(loss, valid): mean of w * -log(p_t) * (1 - p_t) ** gamma over rows with a label >= 0; plain mean, 0 without rows.

    rows: logits (array), label. weights: class_index, weight, at most one row a class.
    """
    ok = rows.where("label >= 0")
    j = ok.withColumn("_w", F.lit(1.0)) if weights is None else ok.join(
        weights.select(F.col("class_index").alias("label"), F.col("weight").alias("_w")), "label", "left"
    )
    top = F.array_max("logits")
    log_p = F.element_at("logits", F.col("label") + 1) - top - F.log(
        F.aggregate(F.transform("logits", lambda v: F.exp(v - F.array_max("logits"))), F.lit(0.0), lambda a, b: a + b)
    )
    loss = -F.coalesce("_w", F.lit(1.0)) * log_p * F.pow(1 - F.exp(log_p), F.lit(gamma))
    return j.agg(F.coalesce(F.avg(loss), F.lit(0.0)).alias("loss"), F.count("*").alias("valid"))


def squared_distance(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, v: s + v)


def spatial_consistency(neighbours: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(loss): mean squared distance, per component, of embeddings (gaussian_index, embedding) over neighbour pairs (i, j)."""
    side = lambda k, name: embeddings.select(F.col("gaussian_index").alias(k), F.col("embedding").alias(name))
    j = neighbours.select("i", "j").join(side("i", "_a"), "i").join(side("j", "_b"), "j")
    return j.agg(F.coalesce(F.avg(squared_distance("_a", "_b") / F.size("_a")), F.lit(0.0)).alias("loss"))


def identity_loss(
    rows: DataFrame, weights: DataFrame | None, neighbours: DataFrame, embeddings: DataFrame, *, gamma: float = 0.0,
    spatial_weight: float = 0.0
) -> DataFrame:
    """One row: cross_entropy, spatial, total, valid."""
    ce = focal_cross_entropy(rows, weights, gamma).withColumnRenamed("loss", "cross_entropy")
    sp = spatial_consistency(neighbours, embeddings).withColumnRenamed("loss", "spatial")
    return ce.crossJoin(sp).withColumn("total", F.col("cross_entropy") + spatial_weight * F.col("spatial"))


def classify(embeddings: DataFrame, head: list[list[float]], bias: list[float]) -> DataFrame:
    """(gaussian_index, class_index, confidence, probabilities) of a linear head, one row of weights a class; ties go to the lower class."""
    logits = F.array(
        *[
            F.aggregate(
                F.zip_with("embedding", F.array(*[F.lit(float(v)) for v in row]), lambda a, b: a.cast("double") * b), F.lit(float(b0)),
                lambda s, v: s + v
            )
            for row, b0 in zip(head, bias, strict=True)
        ]
    )
    p = embeddings.select("gaussian_index", logits.alias("_l")).select("gaussian_index", softmax_of(F.col("_l")).alias("probabilities"))
    best = F.array_max("probabilities")
    return p.select(
        "gaussian_index", (F.array_position("probabilities", best) - 1).cast("int").alias("class_index"), best.alias("confidence"),
        "probabilities"
    )


def class_counts(rows: DataFrame, classes: DataFrame, column: str = "class_index") -> DataFrame:
    """(class_index, n) of every class, 0 included."""
    n = rows.groupBy(F.col(column).alias("class_index")).agg(F.count("*").alias("n"))
    return classes.select("class_index").join(n, "class_index", "left").fillna(0, ["n"])
