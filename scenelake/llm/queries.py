"""The registered queries of the text operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenelake.llm import fingerprint, langid, lattice, neardup, ngram, packing, pii, quality, secrets, sharding
from scenelake.llm.common import fold_of, read_table


def op1_gumbel_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.sample_segmentations(read_table(spark, sf_dir, "documents"), digest=True)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.digest(secrets.scan(docs))


def op3_minhash_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op4_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.scan(read_table(spark, sf_dir, "documents")))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(read_table(spark, sf_dir, "documents")))


def op6_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.score(read_table(spark, sf_dir, "documents"))


def op7_one_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_pairs(read_table(spark, sf_dir, "documents"))


def op8_splitter_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.range_shards(sharding.sized(read_table(spark, sf_dir, "documents")))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op9_sparse_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold_of("doc_id", 4) == 2
    model = langid.fit(docs, learn=~held_out)
    return langid.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score")
    )


def op10_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.digest(quality.judge(docs, keep=("doc_id",)))


QUERIES = {
    f.__name__: f
    for f in (
        op1_gumbel_lattice,
        op2_secret_scan,
        op3_minhash_postings,
        op4_pii_anchors,
        op5_best_fit_packing,
        op6_deleted_interpolation,
        op7_one_permutation,
        op8_splitter_shards,
        op9_sparse_langid,
        op10_weak_quality,
    )
}

#: Near-duplicates by brute force: shingle sets, sizes of all non-empty intersections, closure of the links.
_OP3_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s
 FROM (SELECT doc_id, w, UNNEST(generate_series(1, GREATEST(len(w) - 4, 1))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, COUNT(*) AS n FROM shingles GROUP BY 1),
links AS (SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, COUNT(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
 JOIN sizes m ON m.doc_id = p.a JOIN sizes k ON k.doc_id = p.b WHERE 100 * c >= 75 * (m.n + k.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, COALESCE(s.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT a, MIN(b) AS component_id FROM reach GROUP BY 1) c ON c.a = d.doc_id
"""

ORACLE_SQL: dict[str, str] = {"op3_minhash_postings": _OP3_SQL}
