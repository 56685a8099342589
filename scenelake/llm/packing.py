"""Best-fit packing of token sequences under several capacities at once."""

from __future__ import annotations

import base64
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scenelake.llm.common import cut, sliced, text_or_empty

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@dataclass(frozen=True)
class PackSpec:
    """Capacities of a bin. Attention cost of a piece is the square of its length.

    By default only the tokens can run out, so that sequences are as few as can be: the other two shape the choice of
    bins by what is left of them. Lower values bind.
    """

    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024
    #: weights of the residual token, document and attention capacities in the norm, each as a share of its capacity
    weights: tuple[float, float, float] = (1.0, 0.05, 0.25)
    rule: str = "norm"  # or "dot"
    #: rows in a row that are ranked together within a length
    rank_bucket_rows: int = 10_000


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_pieces(
    docs: DataFrame, *, tokenizer: str | None = None, end_id: int = 2, size: int = 1024, id_col: str = "doc_id", text_col: str = "text",
    keep_ids: bool = False
) -> DataFrame:
    """Tokenise each text, append ``end_id`` and cut sequences over ``size`` into pieces of ``size``.

    The first piece takes the remainder, so every other piece is full. A null or empty text is the end
    id alone; strings of special tokens inside a text are ordinary text. One row per piece: doc_id,
    piece, start (ids of the document before it), length, ids_crc32 (of its little-endian 32-bit ids),
    and ids with ``keep_ids``. Repeated rows give repeated pieces; a null id stays null.
    """
    path = tokenizer or default_tokenizer_path()
    schema = PIECES + (", ids array<int>" if keep_ids else "")

    def run(batches):
        encode = _encoder(path)
        for b in sliced(batches, 256):
            out: list[list] = [[], [], [], [], [], []]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text), end_id).astype("<u4")
                first = len(ids) % size or size
                lo, piece = 0, 0
                while lo < len(ids):
                    hi = lo + (first if piece == 0 else size)
                    part = ids[lo:hi]
                    for col, v in zip(
                        out, (doc, piece, lo, len(part), zlib.crc32(part.tobytes()), part.astype(np.int32) if keep_ids else None),
                        strict=True
                    ):
                        col.append(v)
                    lo, piece = hi, piece + 1
            cols = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(c, pa.int64()) for c in out[2:5])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                cols, names = [*cols, pa.array(out[5], pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, schema)


def _encoder(path: str):
    """text -> token ids of the byte-level vocabulary at ``path``.

    The ``tokenizers`` file also lies beside it as tiktoken ranks, the same ids at four times the
    speed (tests hold both against each other); without that file the ``tokenizers`` library is used.
    """
    import os

    ranks_path = path.removesuffix(".json") + ".tiktoken"
    if path.endswith(".json") and os.path.exists(ranks_path):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return enc.encode_ordinary
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    return lambda text: tok.encode(text, add_special_tokens=False).ids


def plan_bins(counts: dict[int, int], spec: PackSpec) -> list[tuple[int, int, int, int, int]]:
    """Vector best fit over a histogram of lengths, longest first.

    Bins in the same state (residual tokens, documents, attention) form a class that is placed as one,
    so the work depends on the number of lengths and states, not of pieces. A piece goes to the
    class that satisfies every constraint and whose weighted residual norm after placing is least
    (rule "norm"), or whose weighted dot product of residual and demand is largest (rule "dot").
    Returns intervals (length, first rank, count, first sequence, offset): the pieces of that length
    with ranks from first rank on go to consecutive sequences at that offset.
    """
    if spec.rule not in ("norm", "dot"):
        raise ValueError("rule must be 'norm' or 'dot'")
    cap = np.array([spec.tokens, spec.documents, spec.attention], float)
    weight = np.array(spec.weights, float)
    classes: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
    out, made = [], 0
    for length in sorted(counts, reverse=True):
        if length > spec.tokens or length * length > spec.attention or spec.documents < 1:
            raise ValueError(f"a piece of {length} tokens fits no bin")
        demand = np.array([length, 1, length * length], np.int64)
        left, rank = counts[length], 0
        states = [s for s in classes if s[0] >= length and s[1] >= 1 and s[2] >= demand[2]]
        while left and states:
            at = np.array(states, np.int64)
            if spec.rule == "norm":
                pick = int(np.argmin((weight * ((at - demand) / cap) ** 2).sum(axis=1)))
            else:
                pick = int(np.argmax((weight * (at / cap) * (demand / cap)).sum(axis=1)))
            state = states[pick]
            after = tuple(int(x) for x in np.array(state) - demand)
            spans = classes[state]
            while spans and left:
                first, n = spans.pop()
                take = min(n, left)
                out.append((length, rank, take, first, spec.tokens - state[0]))
                classes.setdefault(after, []).append((first, take))
                if take < n:
                    spans.append((first + take, n - take))
                rank, left = rank + take, left - take
            if not spans:
                del classes[state]
                states.pop(pick)
            if after[0] >= length and after[1] >= 1 and after[2] >= demand[2] and after not in states and after in classes:
                states.append(after)
        if left:
            per = min(spec.tokens // length, spec.documents, spec.attention // int(demand[2]))
            whole, rest = divmod(left, per)
            for bins, each in ((whole, per), (1 if rest else 0, rest)):
                for j in range(each if bins else 0):
                    out.append((length, rank, bins, made, j * length))
                    rank += bins
                if bins:
                    state = (spec.tokens - each * length, spec.documents - each, spec.attention - each * int(demand[2]))
                    classes.setdefault(state, []).append((made, bins))
                    made += bins
    return out


def pack(pieces: DataFrame, spec: PackSpec = PackSpec()) -> DataFrame:
    """Assign every piece a sequence_id and an offset, gapless from 0 in each sequence.

    Needs columns length, doc_id and piece and returns all columns of ``pieces`` and the two. The
    histogram over lengths (at most ``spec.tokens`` rows) comes to the driver, is packed there by
    :func:`plan_bins`, and its intervals go back to rank within length. Ranks come from a count per (run of
    ``rank_bucket_rows`` rows, length), so neither a common length nor a repeated row has to meet in one task. Which
    sequence a piece goes to depends on the order of the rows; how many there are does not. Null ids and repeated
    rows are placed like any other; an empty input gives none.
    """
    spark = pieces.sparkSession
    pieces = cut(pieces)
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return pieces.withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")})
    intervals = plan_bins(counts, spec)
    # the pieces are materialised: their numbers stay the same when a task runs again
    keyed = pieces.withColumn("_row", F.monotonically_increasing_id()).withColumn("_bucket", F.expr(f"_row div {spec.rank_bucket_rows}"))
    sizes = keyed.groupBy("_bucket", "length").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("_n")).drop("_n")
    ranked = keyed.withColumn("_in", F.row_number().over(Window.partitionBy("_bucket", "length").orderBy("_row")) - 1)
    ranked = ranked.join(before, ["_bucket", "length"]).withColumn("_rank", F.col("_before") + F.col("_in"))
    # The intervals are few: their number depends on the lengths and bin states, not on the pieces.
    table: dict[int, np.ndarray] = {}
    for length, rank, n, first, offset in sorted(intervals):
        if n:
            table.setdefault(length, []).append((rank, first, offset))
    table = {k: np.array(v, np.int64) for k, v in table.items()}
    names = pieces.columns

    def place(batches):
        for b in batches:
            rank, length = (np.asarray(b.column(b.schema.get_field_index(c))) for c in ("_rank", "length"))
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for k in np.unique(length):
                rows, t = np.flatnonzero(length == k), table[int(k)]
                at = np.searchsorted(t[:, 0], rank[rows], side="right") - 1
                seq[rows], off[rows] = t[at, 1] + rank[rows] - t[at, 0], t[at, 2]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(b.schema.get_field_index(c)) for c in names), pa.array(seq), pa.array(off)], [*names, "sequence_id", "offset"]
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.select(*names, "_rank").mapInArrow(place, schema + ", sequence_id long, offset long")
