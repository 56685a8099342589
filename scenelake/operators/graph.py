"""Connected components on edge DataFrames."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenelake.plans.lineage import cut


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of every node of the edges ``u``-``v``; root is the smallest node of its component.

    Roots are hooked under smaller roots and paths are halved until nothing moves, all edges at a time.
    """
    nodes, code = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = code[: len(u)], code[len(u) :]
    parent = np.arange(len(nodes))
    while len(a):
        a, b = parent[a], parent[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            above = parent[parent]
            if (above == parent).all():
                break
            parent = above
    return nodes, nodes[parent]


def _contracted(limit: int):
    """A task's edges (u, v) as stars. At most about three times ``limit`` rows are held at a time; what the stars of a
    chunk do not fit in goes out, so a node may come more than once."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            return stars(*(np.concatenate([h[i] for h in held]) for i in (0, 1)))

        def batch(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for b in batches:
            if not b.num_rows:
                continue
            held.append((np.asarray(b.column(0)), np.asarray(b.column(1))))
            rows += b.num_rows
            if rows > 2 * limit:
                held = [merged()]
                rows = len(held[0][0])
                if rows > limit:
                    yield batch(*held[0])
                    held, rows = [], 0
        if held:
            yield batch(*merged())

    return run


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", *, rows_per_task: int = 1_000_000) -> DataFrame:
    """(node, component) of every node that has an edge; component is the smallest node id it reaches.

    Each round every task contracts its part of the edges to stars. With as few edges as one task may hold that is the
    answer. Otherwise each node takes the smallest of the roots it was given, its other roots are linked to that one, and
    every link goes on to its lower end's own choice, until nothing moves. A round is one shuffle by node, one join whose hot
    nodes adaptive execution splits, and one cut in the shared checkpoint folder; edges are dealt to tasks by
    their number, not by the session's shuffle width. Rounds are not limited: each that is not the last lowers the sum of
    the links' lower ends. Loops and repeated edges are harmless; rows with a null end are ignored.
    """
    schema, kind = "u long, v long", edges.select(F.greatest(src, dst)).schema[0].dataType
    ends = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull())
    e = cut(ends.select(F.greatest(src, dst).cast("long").alias("u"), F.least(src, dst).cast("long").alias("v")))
    rows, moved = e.count(), True
    while moved:
        tasks = -(-rows // rows_per_task)
        near = e.coalesce(max(1, tasks)).mapInArrow(_contracted(rows_per_task), schema)
        if tasks <= 1:
            e = cut(near)
            break
        # every node has a row, roots one to themselves; from here on the smallest comes first
        near = near.groupBy("u").agg(F.sort_array(F.collect_set("v")).alias("near"))
        own = near.select("u", F.col("near")[0].alias("m"))
        links = near.select("u", F.explode("near").alias("v"), F.col("near")[0].alias("m"))
        extra = F.col("v") != F.col("m")
        links = links.select(F.when(extra, F.col("v")).otherwise(F.col("u")).alias("a"), F.col("m").alias("b"), extra.alias("extra"))
        hop = links.join(own.select(F.col("u").alias("b"), F.col("m").alias("to")), "b")
        e = cut(hop.select(F.col("a").alias("u"), F.col("to").alias("v"), (F.col("extra") | (F.col("to") != F.col("b"))).alias("moved")))
        rows, moved = e.agg(F.count("*"), F.coalesce(F.max("moved"), F.lit(False))).first()
        e = e.drop("moved")
    return e.select(F.col("u").cast(kind).alias("node"), F.col("v").cast(kind).alias("component"))
