"""Range sharding by sampled splitters."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scenelake.llm.common import cut

_LEAST = -(1 << 63)


@dataclass(frozen=True)
class ShardSpec:
    shards: int = 40
    #: ranges per shard that the splitters aim at
    ranges_per_shard: int = 16
    #: rows of a range, which one task sorts, that there are more ranges beyond
    rows_per_range: int = 2_000_000
    #: weighted samples drawn per range, on average; they come to the driver, two numbers each
    samples_per_range: int = 20
    #: a range over this multiple of the mean size is subdivided by further samples from it alone
    overfull: float = 1.5
    rounds: int = 3
    seed: int = 8


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 16), text_crc32, and tie, a number that tells repeated rows apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.monotonically_increasing_id().alias("tie")
    )


def range_shards(rows: DataFrame, spec: ShardSpec = ShardSpec()) -> DataFrame:
    """Put rows (doc_id, size, text_crc32, tie) in key order into ``spec.shards`` shards of near-equal bytes.

    1. A sample with chances in proportion to size gives quantiles of the key (doc_id, then tie) as
       splitters; its expected size is fixed by the number of ranges. 2. Exact bytes per range show overfull
       ranges, which are sampled again on their own and subdivided; the tie lets even one repeated id be
       split. 3. Exact running bytes over ranges, then within each range, give a record's place in the
       whole, hence its shard and its slot. Shards differ by at most one record's size from even. A
       null doc_id sorts first; repeated rows get slots of their own; an empty table gives no row.
    """
    spark = rows.sparkSession
    rows = cut(rows.withColumn("_key", F.coalesce("doc_id", F.lit(_LEAST))))
    total = rows.agg(F.sum("size").alias("s"), F.count("*").alias("n")).first()
    if not total["n"]:
        return rows.select("doc_id", "size", "text_crc32", F.lit(None).cast("int").alias("shard"), F.lit(None).cast("long").alias("slot"))
    whole = int(total["s"])
    ranges = max(spec.shards * spec.ranges_per_shard, -(-int(total["n"]) // spec.rows_per_range))
    per_range = whole / ranges

    def draw(df: DataFrame, rate: float, seed: int) -> list[tuple[int, int]]:
        chance = F.pmod(F.xxhash64("_key", "tie", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
        return [(r[0], r[1]) for r in df.where(chance < F.col("size") * F.lit(rate)).select("_key", "tie").collect()]

    sample = sorted(draw(rows, spec.samples_per_range / per_range, spec.seed))
    step = spec.samples_per_range
    splitters = sorted(set(sample[step::step]))
    for turn in range(spec.rounds):
        ranged = _ranged(rows, splitters)
        sizes = ranged.groupBy("_range").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()
        over = [r["_range"] for r in sizes if r["s"] > spec.overfull * per_range and r["n"] > 1]
        if not over:
            break
        extra = sorted(draw(ranged.where(F.col("_range").isin(over)), 4 * spec.samples_per_range / per_range, spec.seed + turn + 1))
        splitters = sorted(set(splitters) | set(extra[step::step]))
    ranged = cut(_ranged(rows, splitters))
    sizes = sorted(
        (r["_range"], r["s"], r["n"]) for r in ranged.groupBy("_range").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()
    )
    before, records, at, n = [], [], 0, 0
    for k, s, c in sizes:
        before.append((k, at, n))
        at, n = at + s, n + c
    offsets = F.broadcast(spark.createDataFrame(before, "_range int, _bytes long, _rows long"))  # one row a range: bounded by the sample
    inside = Window.partitionBy("_range").orderBy("_key", "tie")
    placed = ranged.join(offsets, "_range").withColumns({
        "_start": F.col("_bytes") + F.sum("size").over(inside) - F.col("size"),
        "_rank": F.col("_rows") + F.row_number().over(inside) - 1,
    })
    middle = F.col("_start") + F.col("size") / 2
    placed = placed.withColumn("shard", F.least(F.floor(middle * spec.shards / F.lit(float(whole))), F.lit(spec.shards - 1)).cast("int"))
    placed = cut(placed.select("doc_id", "size", "text_crc32", "shard", "_rank"))
    firsts = placed.groupBy("shard").agg(F.min("_rank").alias("_first"))  # one row a shard
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("_rank") - F.col("_first")).alias("slot")
    )


def _ranged(rows: DataFrame, splitters: list[tuple[int, int]]) -> DataFrame:
    """Adds _range, the number of splitters at or below the row's (key, tie)."""
    keys, ties = (np.array([s[i] for s in splitters], np.int64) for i in (0, 1))
    names = rows.columns

    def run(batches):
        for b in batches:
            key, tie = (np.asarray(b.column(b.schema.get_field_index(c))) for c in ("_key", "tie"))
            lo, hi = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            at = hi.copy()
            for k in np.unique(lo[lo < hi]):  # the key of some splitters: their ties decide
                same = np.flatnonzero((lo == k) & (lo < hi))
                at[same] = k + np.searchsorted(ties[k : hi[same[0]]], tie[same], "right")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32))], [*names, "_range"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, schema + ", _range int")
