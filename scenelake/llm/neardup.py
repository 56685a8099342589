"""MinHash near-duplicates by an inverted join over signature coordinates."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenelake.llm.common import WordHash, cut, fresh, shingles, shuffle_width, sliced, utf8_column, word_hashes
from scenelake.operators.graph import connected_components
from scenelake.plans.lineage import let_go

_LAST = (1 << 63) - 1


@dataclass(frozen=True)
class NearDupSpec:
    #: similarity in per cent; words of a shingle
    percent: int = 75
    width: int = 5
    #: coordinates of a signature, and matches asked of a pair. At similarity 0.75 the number of matches of
    #: 64 has mean 48 and deviation 3.5, so a threshold of 32 misses a linked pair with a chance of 3e-6.
    coordinates: int = 64
    matches: int = 32
    #: members of a posting list or cluster, and shingles of a cluster, that one task compares at a time; larger groups
    #: are dealt into blocks
    block: int = 8192
    block_shingles: int = 2_000_000
    #: expected number of a dealt group's members that every block gets besides its own
    anchors: int = 64
    #: bits a text of the filter that picks the texts to read again, and bounds of its size (powers of two)
    filter_bits_per_text: int = 8
    filter_bits: tuple[int, int] = (16, 28)
    seed: int = 3


def _multipliers(spec: NearDupSpec) -> np.ndarray:
    return np.random.default_rng(spec.seed).integers(1, 1 << 63, spec.coordinates, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def features(docs: DataFrame, spec: NearDupSpec = NearDupSpec(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, n_shingles, node (64-bit hash of the shingle set; null for an empty set) and sig (64 32-bit minima)."""

    def run(batches):
        words, mult = WordHash(), _multipliers(spec)[:, None]
        for b in sliced(batches, 1024):
            ns, nodes, sigs = [], [], []
            for t in utf8_column(b.column(2)):
                s = shingles(word_hashes(words, t), spec.width)
                ns.append(len(s))
                nodes.append(_node(s))
                sigs.append(_signature(s, mult))
            cols = [b.column(0), b.column(1), pa.array(ns, pa.int64()), pa.array(nodes, pa.int64()), pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text_hash", "n_shingles", "node", "sig"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, node long, sig binary")


def _node(s: np.ndarray) -> int | None:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())))) if len(s) else None


def _signature(s: np.ndarray, mult: np.ndarray) -> bytes | None:
    if not len(s):
        return None
    sig = np.full(len(mult), np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(s), 4096):
        sig = np.minimum(sig, (s[None, at : at + 4096] * mult).min(axis=1))
    return (sig >> np.uint64(32)).astype("<u4").tobytes()


def postings(reps: DataFrame, spec: NearDupSpec = NearDupSpec()) -> DataFrame:
    """(g, n, node): the prefix of every signature's coordinate-value pairs g, rarest first; n documents have the pair.

    Two signatures with ``matches`` common pairs share one among the ``coordinates - matches + 1`` rarest of
    either. Pairs that only one document has come first and post to nobody, so they only shorten the rest.
    """

    def run(batches):
        salt = (np.arange(1, spec.coordinates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
        for b in sliced(batches, 4096):
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), "<u4").reshape(b.num_rows, -1).astype(np.uint64)
            key = (sig + salt) * np.uint64(0xC2B2AE3D27D4EB4F)
            key = ((key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.ravel()), pa.array(np.repeat(np.asarray(b.column(0)), spec.coordinates))], ["key", "node"]
            )

    pairs = reps.select("node", "sig").mapInArrow(run, "key long, node long")
    # joined on the key's complement, so that both sides have a shuffle of their own and adaptive execution can split a hot key
    other = F.bitwise_not("key").alias("other")
    shared = pairs.groupBy("key").agg(F.count("*").alias("df")).where("df > 1").select(other, "df")
    met = pairs.select("node", other).join(shared, "other").select("node", "df", F.bitwise_not("other").alias("key"))
    met = met.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("own"))  # at most 64 a node
    take = F.size("own") - (spec.matches - 1)
    return met.where(take > 0).select(
        "node", F.explode(F.slice("own", F.lit(1), take)).alias("p")
    ).select(F.col("p.key").alias("g"), F.col("p.df").alias("n"), "node")


def _groups(batches, key_cols: int):
    """Runs of rows with equal first ``key_cols`` columns, over batch borders: (key, list of record batches)."""
    held, held_key = [], None
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([np.asarray(b.column(i)) for i in range(key_cols)], axis=1)
        starts = np.append(0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1)
        for lo, hi in zip(starts, np.append(starts[1:], len(keys)), strict=True):
            k = tuple(keys[lo])
            if held and k != held_key:
                yield held_key, held
                held = []
            held_key = k
            held.append(b.slice(lo, hi - lo))
    if held:
        yield held_key, held


def _column(parts: list, i: int) -> list:
    return [v for p in parts for v in p.column(i).to_pylist()]


def spanning(n: int, linked, shrink=None) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest, searched breadth first: ``linked(u, rest)`` tells which of ``rest`` link to ``u``.

    A member is compared with those not yet reached, so a group of near copies takes far fewer comparisons than pairs.
    ``shrink(rest)`` is told whenever so many are reached that only half of those it was told last are left.
    """
    rest = np.arange(n)
    told = n
    src, dst = [], []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            if shrink and 2 * len(rest) < told:
                shrink(rest)
                told = len(rest)
            u = queue.pop()
            hit = linked(u, rest)
            got = rest[hit]
            if len(got):
                src.append(np.full(len(got), u))
                dst.append(got)
                queue.extend(got.tolist())
                rest = rest[~hit]
    none = np.empty(0, np.int64)
    return (np.concatenate(src), np.concatenate(dst)) if src else (none, none)


class Signatures:
    """Which members of a group match in ``matches`` coordinates of their signatures."""

    def __init__(self, blobs: list[bytes], spec: NearDupSpec):
        self.sig = np.frombuffer(b"".join(blobs), "<u4").reshape(len(blobs), -1)
        self.least = spec.matches

    shrink = None

    def linked(self, u: int, rest: np.ndarray) -> np.ndarray:
        return (self.sig[rest] == self.sig[u]).sum(axis=1) >= self.least


class ShingleSets:
    """Which members of a group link by their full sets. Sizes of intersections come from an inverted index of the
    shingles, kept over the members that are still asked for."""

    def __init__(self, blobs: list[bytes], spec: NearDupSpec):
        sets = [np.frombuffer(b, np.uint64) for b in blobs]
        self.percent = spec.percent
        self.size = np.array([len(s) for s in sets])
        self.owner = np.repeat(np.arange(len(sets)), self.size)
        items, self.code = np.unique(np.concatenate(sets), return_inverse=True)
        self.items = len(items)
        self.at = np.append(0, np.cumsum(self.size))
        self.place = np.empty(len(sets), np.int64)
        self.shrink(np.arange(len(sets)))

    def shrink(self, rest: np.ndarray) -> None:
        self.place[:] = -1
        self.place[rest] = np.arange(len(rest))
        self.held = len(rest)
        place = self.place[self.owner]
        code, place = self.code[place >= 0], place[place >= 0]
        self.by_item = place[np.argsort(code, kind="stable")]
        n = np.bincount(code, minlength=self.items)
        self.ends = np.cumsum(n)
        self.starts = self.ends - n

    def linked(self, u: int, rest: np.ndarray) -> np.ndarray:
        own = self.code[self.at[u] : self.at[u + 1]]
        lo, n = self.starts[own], self.ends[own] - self.starts[own]
        pick = np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        common = np.bincount(self.by_item[pick], minlength=self.held)[self.place[rest]]
        return 100 * common >= self.percent * (self.size[u] + self.size[rest] - common)


def group_forest(members: DataFrame, payload: DataFrame, kind: type, spec: NearDupSpec = NearDupSpec()) -> DataFrame:
    """(src, dst): edges that connect, within each group, just what the links between its members connect.

    ``members`` (g, node, n, blocks): n members or more in ``blocks`` blocks; ``payload`` (node, data); ``kind`` tells
    links. A group of one block is searched as a whole. A larger one is dealt into blocks by a hash of the node, and
    every block also gets the group's anchors, a few members drawn by hash. Whatever near copies there are meet in the
    anchors, so that most groups are connected by then. What is still apart from the largest part of its group is held
    against all members of other parts, block by block: no link is lost, and the work grows with the square of a group only
    as far as its members have no link to one another.
    """
    width = shuffle_width(members.sparkSession)
    members = cut(members)
    own = F.pmod(F.xxhash64("node", F.lit(11)), F.col("blocks")).cast("int")
    drawn = F.pmod(F.xxhash64("node", F.lit(13)), F.lit(1 << 30)) * F.col("n") < F.lit(spec.anchors << 30)
    at = F.when((F.col("blocks") > 1) & drawn, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))
    rows = members.select("g", "node", F.explode(at).alias("block"))

    def search(batches):
        for _, parts in _groups(batches, 2):
            nodes, first = np.unique(np.concatenate([np.asarray(p.column(2)) for p in parts]), return_index=True)
            if len(nodes) < 2:
                continue
            blobs = _column(parts, 3)
            link = kind([blobs[i] for i in first], spec)
            src, dst = spanning(len(nodes), link.linked, link.shrink)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[src]), pa.array(nodes[dst])], ["src", "dst"])

    met = rows.join(payload, "node").select("g", F.col("block").cast("long").alias("block"), "node", "data")
    met = met.repartition(width, "g", "block").sortWithinPartitions("g", "block")
    edges = cut(met.mapInArrow(search, "src long, dst long"))
    dealt = members.where("blocks > 1")
    if dealt.isEmpty():
        return edges
    # The rest has to do with large groups only. Tables of one row a group are cut before they are joined back, so that
    # adaptive execution can split the large groups' side.
    parts = connected_components(edges)
    placed = cut(dealt.join(parts, "node", "left").select("g", "node", "blocks", F.coalesce("component", "node").alias("part")))
    sizes = placed.groupBy("g", "part").agg(F.count("*").alias("n"))
    most = cut(
        sizes.groupBy("g").agg(
            F.max_by("part", F.struct("n", "part")).alias("most"), (F.sum("n") - F.max("n")).alias("strays")
        ).where("strays > 0")
    )
    if most.isEmpty():
        return edges
    # strays are rarely as many as a block; theirs is bounded by members alone, as a block of members is by either
    stray_blocks = F.ceil(F.col("strays") / F.least(F.lit(spec.block), F.ceil(F.col("n") / F.col("blocks")))).cast("int")
    open_ = placed.join(most.join(cut(dealt.groupBy("g").agg(F.max("n").alias("n"))), "g"), "g").select(
        "g", "node", "part", "blocks", own.alias("own"), (F.col("part") != F.col("most")).alias("stray"), stray_blocks.alias("sb")
    )
    stray_own = F.pmod(F.xxhash64("node", F.lit(17)), F.col("sb")).cast("int")
    pair = lambda i, j, asks: F.struct(i.cast("long").alias("i"), j.cast("long").alias("j"), F.lit(asks).alias("asks"))
    meets = F.transform(F.sequence(F.lit(0), F.col("sb") - 1), lambda i: pair(i, F.col("own"), 0))
    asks = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: pair(F.col("_sown"), j, 1))
    none = F.array().cast("array<struct<i:bigint,j:bigint,asks:int>>")
    open_ = open_.withColumn("_sown", stray_own).select(
        "g", "node", "part", F.explode(F.concat(meets, F.when(F.col("stray"), asks).otherwise(none))).alias("at")
    )
    open_ = open_.select("g", F.col("at.i").alias("i"), F.col("at.j").alias("j"), "node", "part", F.col("at.asks").alias("asks"))

    def across(batches):
        for _, chunk in _groups(batches, 3):
            nodes, part, asks = (np.concatenate([np.asarray(p.column(c)) for p in chunk]) for c in (3, 4, 5))
            members_at = np.flatnonzero(asks == 0)
            if not len(members_at):
                continue
            link = kind(_column(chunk, 6), spec)
            src, dst = [], []
            for u in np.flatnonzero(asks == 1):
                rest = members_at[part[members_at] != part[u]]
                hit = rest[link.linked(u, rest)]
                _, one = np.unique(part[hit], return_index=True)  # one edge to each part is enough
                src.append(np.full(len(one), nodes[u]))
                dst.append(nodes[hit[one]])
            if src:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(src), pa.int64()), pa.array(np.concatenate(dst), pa.int64())], ["src", "dst"]
                )

    met = open_.join(payload, "node").select("g", "i", "j", "node", "part", "asks", "data")
    met = met.repartition(width, "g", "i", "j").sortWithinPartitions("g", "i", "j")
    return edges.union(cut(met.mapInArrow(across, "src long, dst long")))


def loose_edges(posted: DataFrame, reps: DataFrame, spec: NearDupSpec = NearDupSpec()) -> DataFrame:
    """(src, dst): edges that connect what pairs of one posting list with ``matches`` or more equal coordinates connect."""
    members = posted.select("g", "node", "n", F.ceil(F.col("n") / spec.block).cast("int").alias("blocks"))
    return group_forest(members, reps.select("node", F.col("sig").alias("data")), Signatures, spec)


def wanted_filter(ids: DataFrame, bits: int) -> np.ndarray:
    """A filter of ``2 ** bits`` bits over doc_id; ids that are not in it need no second reading."""
    at = F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits)) + 1  # bitmaps count from 1
    maps = ids.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("b")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("m")
    )
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in maps.toLocalIterator():  # at most 2 ** bits bits
        lo = (r["b"] - 1) * 4096
        out[lo : lo + len(r["m"])] |= np.frombuffer(bytes(r["m"]), np.uint8)
    return out


def shingle_sets(docs: DataFrame, ids: DataFrame, n_ids: int, spec: NearDupSpec, id_col: str, text_col: str) -> DataFrame:
    """(node, data): the full shingle sets of the texts whose id passes the filter over the ``n_ids`` rows of ``ids``."""
    low, high = spec.filter_bits
    bits = min(high, max(low, (spec.filter_bits_per_text * n_ids).bit_length()))
    wanted = wanted_filter(ids, bits)

    def run(batches):
        words = WordHash()
        for b in sliced(batches, 1024):
            at = np.asarray(b.column(0))
            hit = np.flatnonzero((wanted[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
            if not len(hit):
                continue
            texts = utf8_column(b.column(1).take(pa.array(hit)))
            sets = [s for s in (shingles(word_hashes(words, t), spec.width) for t in texts) if len(s)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_node(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "data"]
            )

    at = F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(1 << bits))
    return docs.select(at.alias("at"), F.col(text_col).alias("text")).mapInArrow(run, "node long, data binary")


def confirmed_edges(sets: DataFrame, clustered: DataFrame, spec: NearDupSpec = NearDupSpec()) -> DataFrame:
    """(src, dst): edges that connect what exact links connect within each cluster of loosely linked documents.

    ``clustered`` (node, component, n_shingles).
    """
    blocks = F.ceil(F.greatest(F.count("*") / spec.block, F.sum("n_shingles") / spec.block_shingles)).cast("int")
    sizes = cut(clustered.groupBy("component").agg(F.count("*").alias("n"), blocks.alias("blocks")))
    members = clustered.join(sizes, "component").select(F.col("component").alias("g"), "node", "n", "blocks")
    return group_forest(members, sets, ShingleSets, spec)


def _classes(docs: DataFrame, spec: NearDupSpec, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, n_shingles, node) of every row; (node, least) of every shingle set, least being the (id, text
    hash) of the first row of its class, a null id as the largest.

    Rows with equal shingle sets are one node. Rare coordinate-value pairs of the MinHash signatures are posted, pairs
    that meet in a posting list and match in ``matches`` coordinates form loose clusters, and within a cluster links are
    confirmed on the full sets.
    """
    base = cut(features(docs, spec, id_col=id_col, text_col=text_col))
    key = F.struct(F.coalesce("doc_id", F.lit(_LAST)).alias("id"), "text_hash")
    reps = cut(
        base.where("node is not null").groupBy("node").agg(
            F.min(key).alias("rep"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles")
        )
    )
    labels = connected_components(loose_edges(postings(reps, spec), reps, spec))
    let_go(docs.sparkSession)  # the postings, most of what is shuffled
    clustered = cut(labels.join(reps.select("node", "rep", "n_shingles"), "node"))
    ids = clustered.select(F.when(F.col("rep.id") != _LAST, F.col("rep.id")).alias("doc_id"))
    sets = shingle_sets(docs, ids, clustered.count(), spec, id_col, text_col)
    parts = connected_components(confirmed_edges(sets, clustered, spec))
    linked = parts.join(reps.select("node", "rep"), "node")
    least = cut(linked.groupBy("component").agg(F.min("rep").alias("least")))
    smallest = linked.join(least, "component").select("node", "least")
    # cut, so that adaptive execution can split the rows of a set that many rows have when they are joined to this
    whole = cut(reps.select("node", "rep").join(smallest, "node", "left").select("node", F.coalesce("least", "rep").alias("least")))
    return base.drop("sig"), whole


def near_duplicates(docs: DataFrame, spec: NearDupSpec = NearDupSpec(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    component_id is the smallest id reachable over links; kept marks it. Rows without words link with nothing. A null id
    counts as the largest; repeated rows of one id share its set's component and are all kept or all not. An empty
    table gives none; columns other than the two are not read.
    """
    base, classes = _classes(docs, spec, id_col, text_col)
    let_go(docs.sparkSession)
    out = base.join(classes.select("node", F.col("least.id").alias("least")), "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).when(F.col("least") != _LAST, F.col("least"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def survivors(docs: DataFrame, spec: NearDupSpec = NearDupSpec(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with just one row of each near-duplicate class: the first by id, a null id last, then by a hash of the text.

    Of rows that repeat id and text one stays; a text without words is a class with its id. All columns are returned as
    they were, whatever their names. The whole rows are shuffled once, after repeated ones have met in each task.
    """
    base, classes = _classes(docs, spec, id_col, text_col)
    let_go(docs.sparkSession)  # before the whole rows are shuffled
    wordless = base.where("node is null").select(F.coalesce("doc_id", F.lit(_LAST)).alias("id"), "doc_id", "text_hash")
    first = classes.select("least").distinct().select(
        F.col("least.id").alias("id"), F.when(F.col("least.id") != _LAST, F.col("least.id")).alias("doc_id"),
        F.col("least.text_hash").alias("text_hash")
    )
    keys = first.union(wordless)
    id_, unknown, text_hash = (fresh(docs.columns, c) for c in ("_id", "_unknown", "_text_hash"))
    keyed = docs.withColumns(
        {id_: F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)), unknown: F.col(id_col).isNull(), text_hash: F.xxhash64(text_col)}
    )
    wanted = keys.select(F.col("id").alias(id_), F.col("doc_id").isNull().alias(unknown), F.col("text_hash").alias(text_hash))
    return keyed.dropDuplicates([id_, unknown, text_hash]).join(wanted, [id_, unknown, text_hash], "left_semi").select(*docs.columns)
