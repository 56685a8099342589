"""Document fingerprints by one-permutation MinHash."""

from __future__ import annotations

import hashlib
from collections import Counter
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenelake.llm.common import WordHash, even_keys, shingles, shuffle_width, word_hashes

_LEAST = -(1 << 63)
#: numbers of a range that an id of its own can be divided in
_OWN = 1 << 20


@dataclass(frozen=True)
class FingerprintSpec:
    #: 2 ** bin_bits bins, each stored as its low ``bits`` bits (8 or 16)
    bin_bits: int = 7
    bits: int = 8
    #: words of a shingle
    width: int = 5
    seed: int = 7


@cache
def _donors(bin_bits: int, seed: int) -> np.ndarray:
    """For each bin the order in which it asks other bins for a value: row a is attempt a, a random bin for each."""
    k = 1 << bin_bits
    return np.random.default_rng(seed).integers(0, k, (64 * k, k))


def densified(sorted_hashes: np.ndarray, spec: FingerprintSpec) -> np.ndarray | None:
    """The minimum of each bin, empty bins filled; None for the empty set.

    The top bits of a hash are its bin, so a sorted set is split into bins by one search and the first of
    each is its minimum. An empty bin copies the first non-empty one among the random bins it asks in turn,
    the same for every set: optimal densification.
    """
    if not len(sorted_hashes):
        return None
    k = 1 << spec.bin_bits
    shift = np.uint64(64 - spec.bin_bits)
    at = np.searchsorted(sorted_hashes, np.arange(k, dtype=np.uint64) << shift)
    safe = np.minimum(at, len(sorted_hashes) - 1)
    values = sorted_hashes[safe]
    full = (at < len(sorted_hashes)) & ((values >> shift) == np.arange(k, dtype=np.uint64))
    empty = np.flatnonzero(~full)
    donors = _donors(spec.bin_bits, spec.seed)
    attempt = 0
    while len(empty):
        ask = donors[attempt % len(donors)][empty]
        ok = full[ask]
        values[empty[ok]] = values[ask[ok]]
        empty, attempt = empty[~ok], attempt + 1
    return values


def packed(sorted_hashes: np.ndarray, spec: FingerprintSpec) -> bytes:
    """Low-order bits of the bins, packed; no byte for the empty set."""
    values = densified(sorted_hashes, spec)
    return b"" if values is None else values.astype({8: np.uint8, 16: np.uint16}[spec.bits]).tobytes()


def likeness(a: bytes, b: bytes, spec: FingerprintSpec = FingerprintSpec()) -> float:
    """Estimated Jaccard similarity of two sets: the share of equal bins, less what low bits share by chance.

    Two empty sets are alike (1), an empty and another one are not (0).
    """
    if not a or not b:
        return float(a == b)
    kind = {8: np.uint8, 16: np.uint16}[spec.bits]
    share = float((np.frombuffer(a, kind) == np.frombuffer(b, kind)).mean())
    chance = 2.0**-spec.bits
    return min(1.0, max(0.0, (share - chance) / (1 - chance)))


def fingerprints(
    docs: DataFrame, spec: FingerprintSpec = FingerprintSpec(), *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id and fingerprint (hex) of every whole text: its 5-word shingles, hashed and binned once.

    A null text counts as empty, and the empty set's fingerprint is the empty string; equal texts have
    equal fingerprints. One row per input row.
    """

    def run(batches):
        words = WordHash()
        for b in batches:
            texts = b.column(1).cast(pa.binary()).fill_null(b"").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([packed(shingles(word_hashes(words, t), spec.width), spec).hex() for t in texts])],
                ["doc_id", "fingerprint"]
            )

    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")
    ).mapInArrow(run, "doc_id long, fingerprint string")


def neighbours(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_bucket, _ahead, _id, doc_id, text): ranges of descending id, each followed by the next document after it.

    Ranges come from quantiles of the id; an id that is several quantiles at once has so many ranges of its own, by a hash
    of the row's number. The first row of a range is sent to the range before it as well (``_ahead`` 1), and the first of
    all to the last range, so each range finds every next document in itself. One shuffle of the texts; partitions are
    sorted. Ties on id go by a hash of the text, or of the row's number for such an id; a null id is least. Repeated rows
    follow one another. An empty table gives none.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST)).alias("_id"), F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    parts = max(1, shuffle_width(spark))
    got = rows.agg(F.percentile_approx("_id", [i / parts for i in range(1, parts)] or [0.5], 100 * parts).alias("q")).first()["q"]
    times = Counter(got or []) if parts > 1 else Counter()
    splits, hot = sorted(times), {v: n for v, n in times.items() if n > 1}
    tie, bucket = F.xxhash64("text"), _place(F.col("_id"), splits).cast("long") * _OWN
    if hot:
        rows = rows.withColumn("_row", F.monotonically_increasing_id())
        tie = F.when(F.col("_id").isin(sorted(hot)), F.xxhash64("_row")).otherwise(tie)
    rows = rows.withColumn("_tie", tie).drop("_row")
    if hot:  # within the range that such an id begins: its rows by descending tie, then the larger ids
        at = (_place(F.col("_id"), splits) + 1).cast("int")
        n = F.element_at(F.array(*[F.lit(hot.get(v, 0)) for v in (None, *splits)]), at)
        first = F.element_at(F.array(*[F.lit(v) for v in (_LEAST, *splits)]), at)
        share = F.col("_tie").cast("double") / 2.0**64 + 0.5
        bucket = bucket + F.when(n == 0, 0).when(F.col("_id") == first, F.greatest(n - 1 - F.floor(share * n), F.lit(0))).otherwise(n)
    rows = rows.withColumn("_own", bucket.cast("long"))
    # one row a range
    tops = {
        r["_own"]: (r["m"][0], ~r["m"][1])
        for r in rows.groupBy("_own").agg(F.max(F.struct("_id", F.bitwise_not("_tie").alias("t"))).alias("m")).collect()
    }
    order = sorted(tops)
    ahead: dict[tuple[int, int], list[int]] = {}
    for lower, upper in zip(order, order[1:], strict=False):
        ahead.setdefault(tops[lower], []).append(upper)
    if order:
        ahead.setdefault(tops[order[-1]], []).append(order[0])
    # at most one row a range
    sent = spark.createDataFrame([(*k, v) for k, v in ahead.items()] or [(0, 0, [])], "_id long, _tie long, _more array<long>")
    # where a range goes: a partition of its own, or any for the further ranges of an id of its own
    keys = F.array(*[F.lit(r["dest"]) for r in even_keys(spark, parts).orderBy("slot").collect()])
    dest = F.element_at(keys, (F.shiftright("_bucket", 20) + 1).cast("int")) + F.col("_bucket").bitwiseAND(_OWN - 1) * (1 << 40)
    both = rows.join(F.broadcast(sent), ["_id", "_tie"], "left")
    wanted = F.concat(
        F.array(F.struct(F.col("_own").alias("b"), F.lit(0).alias("a"))),
        F.coalesce(
            F.transform("_more", lambda x: F.struct(x.alias("b"), F.lit(1).alias("a"))), F.array().cast("array<struct<b:bigint,a:int>>")
        )
    )
    out = both.select(F.explode(wanted).alias("w"), "_id", "doc_id", "text", "_tie").select(
        F.col("w.b").alias("_bucket"), F.col("w.a").alias("_ahead"), "_id", "doc_id", "text", "_tie"
    )
    out = out.withColumn("_dest", dest).repartition(parts, "_dest").drop("_dest")
    return out.sortWithinPartitions("_bucket", "_ahead", F.col("_id").desc(), "_tie", "text").drop("_tie")


def _place(value, splits: list[int]):
    """Number of splits at or below ``value``, by a coarse and a fine step."""
    if not splits:
        return F.lit(0)
    step = max(1, int(len(splits) ** 0.5))
    coarse = F.array(*[F.lit(s) for s in splits[step - 1 :: step]]) if len(splits) >= step else F.array().cast("array<bigint>")
    at = F.size(F.filter(coarse, lambda s: s <= value)) * step
    fine = F.slice(F.array(*[F.lit(s) for s in splits]), at + 1, F.lit(step))
    return (at + F.size(F.filter(fine, lambda s: s <= value))).cast("int")


def edited_pairs(
    docs: DataFrame, spec: FingerprintSpec = FingerprintSpec(), *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Each document against its edited text and against the next document in descending id.

    The edited text has its last third of code points replaced by as many from the start of the next
    document (all of it if it is shorter). A single document is its own next; a null text counts as empty, repeated rows
    follow one another, and an empty table gives no row. Columns other than the two are not read.
    """

    def run(batches):
        words = WordHash()
        prev = None  # (bucket, doc_id, text, fingerprint)
        out: list[tuple] = []

        def of(text: str) -> bytes:
            return packed(shingles(word_hashes(words, text.encode("utf-8", "surrogatepass")), spec.width), spec)

        def row(doc_id, text, fp, next_text, next_fp):
            n = len(text)
            edited = text[: n - n // 3] + next_text[: n // 3]
            edited_fp = of(edited)
            return (
                doc_id, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), fp.hex(), edited_fp.hex(),
                likeness(fp, edited_fp, spec), likeness(fp, next_fp, spec)
            )

        def flush():
            cols = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(c, t)
                    for c, t in zip(
                        cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True
                    )
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
            )

        for b in batches:
            for bucket, ahead, doc_id, text in zip(
                b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True
            ):
                same = prev is not None and prev[0] == bucket
                if ahead and not same:
                    continue  # the open document of this range has met its next one already
                fp = of(text)
                if same:
                    out.append(row(prev[1], prev[2], prev[3], text, fp))
                prev = None if ahead else (bucket, doc_id, text, fp)
            if out:
                yield flush()

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return neighbours(docs, id_col=id_col, text_col=text_col).select("_bucket", "_ahead", "doc_id", "text").mapInArrow(run, schema)
