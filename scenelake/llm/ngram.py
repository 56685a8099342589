"""Language-model scores by deleted interpolation of n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scenelake.llm.common import WordHash, cut, even_keys, fold_of, give_back, mix, shuffle_width, sliced, word_hashes

#: Key of the end of a text, which is also the context of the next text's first word.
END = np.uint64(0xE4D0E4D0E4D0E4D1)


@dataclass(frozen=True)
class LmSpec:
    #: documents with crc32(id) mod ``folds`` = 0 are never learnt from; those with 1 are deleted from the counts
    #: while the mixture weights are estimated on them, and counted again in the final model
    folds: int = 10
    #: tokens of a unit, the piece of the corpus that one task handles at a time
    unit_tokens: int = 1_500_000
    #: tokens of the corpus for each shard of the n-grams: what one task counts at a time holds about as many
    shard_tokens: int = 1_000_000
    #: context-frequency buckets: none, then one for each power of two up to this
    top_bucket: int = 24
    #: expectation-maximisation
    rounds: int = 40
    start: tuple[float, float, float] = (0.4, 0.4, 0.2)
    strength: float = 5.0
    #: steps per factor of two at which probabilities are binned for the estimation
    grain: int = 8
    least_weight: float = 1e-6
    #: additive constant of the base model
    add: float = 0.1


def _squeeze(a: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _expand(blob: bytes, dtype: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(dtype)


def _squeeze_keys(keys: np.ndarray) -> bytes:
    return _squeeze(np.diff(keys, prepend=np.uint64(0)))


def _expand_keys(blob: bytes) -> np.ndarray:
    return np.cumsum(_expand(blob, "<u8"), dtype=np.uint64)


STREAMS = "unit long, doc_ids array<long>, parts array<int>, lengths array<int>, keys binary, stream binary"


def streams(docs: DataFrame, spec: LmSpec = LmSpec(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenised texts in units: ids, parts (0 held out, 1 deleted, 2 learnt) and lengths of the
    documents, the sorted 64-bit keys of the unit's words and the token stream as places among them.

    A unit holds deleted documents only (odd number) or none (even). Each document ends in END; a null text
    is END alone. Unit numbers come from the task and its order, so the result is to be materialised once.
    """

    def run(batches):
        from pyspark import TaskContext

        words = WordHash()
        made = 0
        task = TaskContext.get().partitionId()
        open_units = {0: ([], [], [], []), 1: ([], [], [], [])}

        def flush(odd: int):
            nonlocal made
            ids, parts, lengths, tokens = open_units[odd]
            keys, place = np.unique(np.concatenate(tokens), return_inverse=True)
            row = pa.RecordBatch.from_arrays(
                [
                    pa.array([((task << 24 | made) << 1) | odd], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
                    pa.array([parts], pa.list_(pa.int32())), pa.array([lengths], pa.list_(pa.int32())),
                    pa.array([_squeeze_keys(keys)], pa.binary()), pa.array([_squeeze(place.astype("<i4"))], pa.binary())
                ],
                ["unit", "doc_ids", "parts", "lengths", "keys", "stream"],
            )
            made += 1
            open_units[odd] = ([], [], [], [])
            return row

        held = {0: 0, 1: 0}
        for b in sliced(batches, 1024):
            texts = b.column(2).cast(pa.binary()).fill_null(b"").to_pylist()
            for doc, part, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts, strict=True):
                odd = int(part == 1)
                t = np.append(word_hashes(words, text), END)
                for col, v in zip(open_units[odd], (doc, part, len(t), t), strict=True):
                    col.append(v)
                held[odd] += len(t)
                if held[odd] >= spec.unit_tokens:
                    held[odd] = 0
                    yield flush(odd)
                    give_back()
        for odd in (0, 1):
            if open_units[odd][0]:
                yield flush(odd)
        give_back()

    fold = fold_of(id_col, spec.folds)
    part = F.when(fold == 0, 0).when(fold == 1, 1).otherwise(2)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), part.alias("part"), F.col(text_col).alias("text")
    ).mapInArrow(run, STREAMS)


def _bigrams(keys: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Key of (previous, own) of each token of a stream; END goes before the first. 56 bits tell pairs apart, which
    are sent the most: the low byte is clear and costs nothing."""
    words = keys[place]
    before = np.append(END, words[:-1])
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + words) & ~np.uint64(0xFF)


def requests(units: DataFrame, shards: int, spec: LmSpec = LmSpec()) -> DataFrame:
    """(dest, shard, order, unit, keys, learnt, deleted): a unit's distinct n-grams of each order, with its own counts.

    The top bits of a key are its shard, so one sorted list is cut into shards; dest deals one shard to a partition.
    """
    dest = dict(map(tuple, even_keys(units.sparkSession, shards).collect()))  # one row a shard
    bits = np.uint64(64 - (shards - 1).bit_length())
    bounds = (np.arange(1, shards, dtype=np.uint64) << bits) if shards > 1 else np.empty(0, np.uint64)

    def run(batches):
        for b in sliced(batches, 1):
            for r in b.to_pylist():
                keys, place = _expand_keys(r["keys"]), _expand(r["stream"], "<i4")
                part = np.repeat(np.array(r["parts"]), np.array(r["lengths"]))
                two, two_place = np.unique(_bigrams(keys, place), return_inverse=True)
                for order, k, at in ((1, keys, place), (2, two, two_place)):
                    learnt = np.bincount(at[part == 2], minlength=len(k)).astype("<u4")
                    deleted = np.bincount(at[part == 1], minlength=len(k)).astype("<u4")
                    edge = np.concatenate([[0], np.searchsorted(k, bounds), [len(k)]])
                    rows = [
                        (dest[s], s, order, r["unit"], _squeeze_keys(k[lo:hi]), _squeeze(learnt[lo:hi]), _squeeze(deleted[lo:hi]))
                        for s, (lo, hi) in enumerate(zip(edge, edge[1:], strict=False)) if hi > lo
                    ]
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(c, t)
                            for c, t in zip(
                                cols, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True
                            )
                        ],
                        ["dest", "shard", "order", "unit", "keys", "learnt", "deleted"]
                    )
                del keys, place, part, two, two_place, k, at, learnt, deleted, rows, cols
                give_back()

    return units.mapInArrow(run, "dest long, shard int, order int, unit long, keys binary, learnt binary, deleted binary")


@dataclass(frozen=True)
class Places:
    """Where units are brought together with their replies: ``width`` partitions, and for each unit a slot of its own if
    ``each``, the most units that a task made, is not 0."""

    width: int
    each: int

    def slot(self) -> Column:
        """A unit's number holds the task that made it, and its order there."""
        return (F.shiftright("unit", 25) * self.each + F.shiftright("unit", 1).bitwiseAND((1 << 24) - 1)).cast("int")

    def slot_of(self, unit: int) -> int:
        return (unit >> 25) * self.each + (unit >> 1 & (1 << 24) - 1)

    def dest(self, spark: SparkSession) -> list[int]:
        """For each slot a number that goes to a partition of its own; none if units have no slots."""
        return [r["dest"] for r in even_keys(spark, self.width).orderBy("slot").collect()] if self.each else []


def places(units: DataFrame) -> tuple[Places, int]:
    """The places of ``units`` and their tokens. A slot for each unit unless tasks made very different numbers of them."""
    tokens = F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n))
    r = units.agg(
        F.count("*").alias("n"), F.max(F.shiftright("unit", 25)).alias("task"),
        F.max(F.shiftright("unit", 1).bitwiseAND((1 << 24) - 1)).alias("made"), F.coalesce(tokens, F.lit(0)).alias("tokens")
    ).first()
    least = shuffle_width(units.sparkSession)
    if not r["n"]:
        return Places(least, 0), 0
    slots = (r["task"] + 1) * (r["made"] + 1)
    return Places(max(least, slots), r["made"] + 1) if slots <= max(least, 4 * r["n"]) else Places(max(least, r["n"]), 0), r["tokens"]


REPLIES = "dest long, unit long, order int, shard int, counts binary, without binary"


def replies(asked: DataFrame, shards: int, where: Places) -> DataFrame:
    """Corpus counts for every request, in the order of its keys: in all learnt and deleted documents, and,
    for units of deleted documents, without the deleted ones. Rows with unit -1 hold a shard's totals. dest deals a
    unit's replies to its place.
    """
    dest = where.dest(asked.sparkSession)

    def run(batches):
        held, key = [], None

        def answer():
            got = [(_expand_keys(r["keys"]), r) for r in held]
            keys, at = np.unique(np.concatenate([k for k, _ in got]), return_inverse=True)
            learnt = np.bincount(at, np.concatenate([_expand(r["learnt"], "<u4") for _, r in got]), len(keys)).astype(np.int64)
            deleted = np.bincount(at, np.concatenate([_expand(r["deleted"], "<u4") for _, r in got]), len(keys)).astype(np.int64)
            both = learnt + deleted
            rows, lo = [], 0
            for k, r in got:
                own = at[lo : lo + len(k)]
                lo += len(k)
                rows.append(
                    (
                        dest[where.slot_of(r["unit"])] if dest else r["unit"], r["unit"], key[1], key[0], _squeeze(both[own].astype("<u8")),
                        _squeeze(learnt[own].astype("<u8")) if r["unit"] & 1 else None
                    )
                )
            if key[1] == 1:
                totals = np.array([both.sum(), (both > 0).sum(), learnt.sum(), (learnt > 0).sum()], "<i8")
                rows.append((0, -1, 1, key[0], totals.tobytes(), None))
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(c, t)
                    for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)
                ],
                ["dest", "unit", "order", "shard", "counts", "without"]
            )

        for b in sliced(batches, 64):
            for r in b.to_pylist():
                if held and (r["shard"], r["order"]) != key:
                    yield answer()
                    held = []
                key = (r["shard"], r["order"])
                held.append(r)
        if held:
            yield answer()
        held = []
        give_back()

    return asked.repartition(shards, "dest").sortWithinPartitions("shard", "order").drop("dest").mapInArrow(run, REPLIES)


def _with_counts(units: DataFrame, answered: DataFrame, at: Places, per_unit, schema: str) -> DataFrame:
    """Bring each unit and its replies together and yield ``per_unit(unit row, {order: counts}, {order: counts without})``."""
    if at.each:  # as many rows as partitions, joined to the few of the units; the replies have theirs
        units = units.withColumn("slot", at.slot()).join(F.broadcast(even_keys(units.sparkSession, at.width)), "slot")
    else:
        units = units.withColumn("dest", F.col("unit"))
    left = units.select("dest", "unit", F.lit(0).alias("order"), F.lit(0).alias("shard"), "doc_ids", "parts", "lengths", "keys", "stream")
    # fewer, longer tasks: each opens a file for every partition
    answered = answered.coalesce(shuffle_width(units.sparkSession))
    right = answered.select(
        "dest", "unit", "order", "shard", F.lit(None).cast("array<long>").alias("doc_ids"), F.lit(None).cast("array<int>").alias("parts"),
        F.lit(None).cast("array<int>").alias("lengths"), F.col("counts").alias("keys"), F.col("without").alias("stream")
    )

    def run(batches):
        unit, counts, without = None, {}, {}

        def done():
            join = lambda d: {k: np.concatenate(d.pop(k)) for k in list(d)}
            return per_unit(unit, join(counts), join(without))

        for b in sliced(batches, 64):
            for r in b.to_pylist():
                if r["order"] == 0:
                    if unit is not None:
                        yield done()
                        give_back()
                    unit, counts, without = r, {}, {}
                    continue
                counts.setdefault(r["order"], []).append(_expand(r["keys"], "<u8"))
                if r["stream"] is not None:
                    without.setdefault(r["order"], []).append(_expand(r["stream"], "<u8"))
        if unit is not None:
            yield done()
        unit = None
        give_back()

    dealt = left.unionByName(right).repartition(at.width, "dest").sortWithinPartitions("unit", "order", "shard")
    return dealt.drop("dest").mapInArrow(run, schema)


def _stretches(lengths: list[int], most: int = 1 << 17) -> list[tuple[slice, slice]]:
    """Documents, and their tokens, in stretches of whole documents: about ``most`` tokens each, or one longer document."""
    ends = np.cumsum(lengths, dtype=np.int64)
    docs = np.unique(np.concatenate([[0], np.searchsorted(ends, np.arange(most, ends[-1], most)) + 1, [len(ends)]]))
    tokens = np.append(0, ends)[docs]
    cuts = lambda at: [slice(lo, hi) for lo, hi in zip(at.tolist(), at[1:].tolist(), strict=False)]
    return list(zip(cuts(docs), cuts(tokens), strict=True))


def _parts_of(unit: dict, counts: dict[int, np.ndarray]):
    """For each of ``_stretches`` of the unit's documents: these, and counts of each token, of its context, and of both in
    sequence. A unit's places are held as a whole, what is worked out from them only for a stretch."""
    keys, place = _expand_keys(unit["keys"]), _expand(unit["stream"], "<i4")
    two_place = np.unique(_bigrams(keys, place), return_inverse=True)[1].astype(np.int32)
    last = np.searchsorted(keys, END)
    for docs, at in _stretches(unit["lengths"]):
        own = counts[1][place[at]].astype(np.float64)
        before = np.append(float(counts[1][last]), own[:-1])  # a stretch begins behind the end of a text
        yield docs, own, before, counts[2][two_place[at]].astype(np.float64)


def _bucket(context: np.ndarray, spec: LmSpec) -> np.ndarray:
    return np.where(context > 0, np.minimum(1 + np.floor(np.log2(np.maximum(context, 1))), spec.top_bucket), 0).astype(np.int64)


def _levels(spec: LmSpec) -> int:
    return 40 * spec.grain + 2


def deleted_histogram(units: DataFrame, answered: DataFrame, at: Places, tokens: int, spec: LmSpec) -> list[tuple[int, int]]:
    """(cell, n) over the deleted documents' tokens: context bucket, binned bigram and unigram probability by counts
    without those documents. The number of cells is fixed by the spec.
    """
    levels = _levels(spec)

    def level(p: np.ndarray) -> np.ndarray:
        """0 for none, else 1 + binned -log2."""
        return np.where(p > 0, 1 + np.minimum(np.floor(-spec.grain * np.log2(np.maximum(p, 1e-300))), levels - 2), 0).astype(np.int64)

    def per_unit(unit, _, without):
        cells = []
        for _, own, before, both in _parts_of(unit, without):
            two = np.where(before > 0, both / np.maximum(before, 1), 0.0)
            cells.append((_bucket(before, spec) * levels + level(two)) * levels + level(own / max(tokens, 1)))
        u, n = np.unique(np.concatenate(cells), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(n, pa.int64())], ["cell", "n"])

    odd = F.col("unit").bitwiseAND(1) == 1
    cells = _with_counts(units.where(odd), answered.where(odd & (F.col("unit") >= 0)), at, per_unit, "cell long, n long")
    return [(r["cell"], r["n"]) for r in cells.groupBy("cell").agg(F.sum("n").alias("n")).collect()]


def mixture(cells: list[tuple[int, int]], types: int, spec: LmSpec = LmSpec()) -> np.ndarray:
    """Weights (bucket, [bigram, unigram, uniform]) by expectation-maximisation; each row sums to one."""
    weights = np.tile(np.array(spec.start), (spec.top_bucket + 1, 1))
    if cells:
        levels = _levels(spec)
        cell, n = (np.array(x) for x in zip(*sorted(cells), strict=True))
        bucket, two, one = cell // levels // levels, cell // levels % levels, cell % levels
        value = lambda v: np.where(v > 0, 2.0 ** (-(v - 0.5) / spec.grain), 0.0)
        p = np.stack([value(two), value(one), np.full(len(n), 1.0 / (types + 1))], axis=1)
        for _ in range(spec.rounds):
            share = weights[bucket] * p
            share *= (n / share.sum(axis=1))[:, None]
            mass = np.tile(np.array(spec.start) * spec.strength, (spec.top_bucket + 1, 1))
            for j in range(3):
                mass[:, j] += np.bincount(bucket, share[:, j], spec.top_bucket + 1)
            weights = mass / mass.sum(axis=1, keepdims=True)
    weights = np.maximum(weights, spec.least_weight)
    return weights / weights.sum(axis=1, keepdims=True)


def score(docs: DataFrame, spec: LmSpec = LmSpec(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, mean_score (a token's) of every whole text.

    Words are known by 64-bit hashes. Every distinct word and word pair of a unit is asked for at the
    shard that counts it over the whole corpus, and the answer returns to the unit. score is the sum of
    log10(w2 c(v w) / c(v) + w1 c(w) / N + w0 / (V + 1)), the weights by the bucket of c(v), estimated on
    deleted documents. One row per input row, repeated rows alike; a null text is its end alone, an empty table gives no
    row; without learnt documents all counts are 0. Units and shards are as many as the tokens call for, so what a task
    holds does not grow with the input. Columns other than the two are not read.
    """
    units = cut(streams(docs, spec, id_col=id_col, text_col=text_col))
    at, size = places(units)
    shards = 1 << (max(shuffle_width(docs.sparkSession), -(-size // spec.shard_tokens)) - 1).bit_length()
    answered = cut(replies(requests(units, shards, spec), shards, at))
    sums = [np.frombuffer(bytes(r["counts"]), "<i8") for r in answered.where("unit = -1").select("counts").collect()]  # one row a shard
    tokens, types, tokens_without, types_without = (int(x) for x in np.sum(sums, axis=0)) if sums else (0, 0, 0, 0)
    weights = mixture(deleted_histogram(units, answered, at, tokens_without, spec), types_without, spec)

    def per_unit(unit, counts, _):
        sums = []
        for docs, own, before, both in _parts_of(unit, counts):
            w = weights[_bucket(before, spec)]
            two = np.where(before > 0, both / np.maximum(before, 1), 0.0)
            p = w[:, 0] * two + w[:, 1] * (own / max(tokens, 1)) + w[:, 2] / (types + 1)
            base = np.log10((own + spec.add) / (tokens + spec.add * (types + 1)))
            starts = np.append(0, np.cumsum(unit["lengths"][docs])[:-1])
            sums.append([np.add.reduceat(v, starts) for v in ((own > 0).astype(np.int64), base, np.log10(p))])
        known, base, total = (np.concatenate(v) for v in zip(*sums, strict=True))
        lengths = np.array(unit["lengths"])
        cols = [
            pa.array(unit["doc_ids"], pa.int64()),
            pa.array(np.array(unit["parts"]) == 0),
            pa.array(lengths, pa.int64()),
            pa.array(known),
            pa.array(np.full(len(lengths), tokens), pa.int64()),
            pa.array(base),
            pa.array(total),
            pa.array(total / lengths),
        ]
        return pa.RecordBatch.from_arrays(
            cols, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "mean_score"]
        )

    return _with_counts(
        units, answered.where("unit >= 0"), at, per_unit,
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, mean_score double"
    )
