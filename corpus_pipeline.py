"""The text pipeline: five stages from raw documents to packed token sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenelake.llm import langid, neardup, packing, quality, secrets
from scenelake.llm.common import fresh
from scenelake.plans.lineage import dropped, shared_path

#: Documents whose language is less certain than this go.
LEAST_LANGUAGE_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: no letter, or a calibrated score under the bound.

    The model is fitted on the labelled rows of ``docs``; with no label at all nothing can be told and all stay.
    """
    model = langid.fit(docs)
    if not model.languages:
        return docs
    pred, score = fresh(docs.columns, "lang_pred"), fresh(docs.columns, "lang_score")
    found = langid.identify(docs, model, pred=pred, score_col=score)
    return found.where((F.col(pred) != langid.UNDETERMINED) & (F.col(score) >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the base rule or whose posterior quality is low."""
    out = fresh(docs.columns, "quality")
    return quality.judge(docs, out=out).where(F.col(f"{out}.kept")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep just one row of each near-duplicate class: the first by id (null last), then by a hash of the text."""
    return neardup.survivors(docs)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret by its kind in brackets; n_chars follows the text. No document goes."""
    out = fresh(docs.columns, "secret_spans")
    found = secrets.scan(docs, out=out)
    changed = F.size(out) > 0
    found = found.withColumn("text", F.when(changed, secrets.redact(F.col("text"), F.col(out))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:  # from the new text as a column: the same lambda twice in one projection goes wrong
        found = found.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return found.select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the token sequences of all documents; one row per piece."""
    return packing.pack(packing.token_pieces(docs))


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secret_redaction", secret_redaction),
    ("best_fit_packing", best_fit_packing),
]

#: Regression weights, signatures and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, with a Parquet table between each two in the shared folder.

    A table is deleted as soon as the next stage's is written; the last stage has its input materialised in pieces.
    """
    folder = shared_path(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{folder}/{k}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                dropped(spark, before)
            before = path
    dropped(spark, folder)
    return docs
