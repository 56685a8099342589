import random

import numpy as np
import pytest

from scenelake.operators.graph import connected_components, stars


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            lo, hi = sorted((find(a), find(b)))
            parent[hi] = lo
    return {x: find(x) for x in list(parent)}


def cases():
    rnd = random.Random(4)
    order = rnd.sample(range(400), 400)
    return {
        "path": [(i, i + 1) for i in range(400)],
        "shuffled path": list(zip(order, order[1:], strict=False)),
        "star of the least": [(7, i) for i in range(8, 300)],
        "star of the largest": [(999, i) for i in range(300)],
        "random": [(rnd.randrange(-300, 300), rnd.randrange(-300, 300)) for _ in range(350)],
        "loops, repeats and nulls": [(5, 5), (6, 6), (6, 7), (6, 7), (None, 3), (4, None), (8, 8), (1 << 62, -(1 << 62))],
        "none": [],
    }


@pytest.mark.parametrize("name", cases())
def test_components_equal_brute_force_in_one_task_and_in_many(spark, name):
    edges = cases()[name]
    df = spark.createDataFrame(edges, "src long, dst long")
    for rows_per_task in (1_000_000, 40):
        rows = connected_components(df, rows_per_task=rows_per_task).collect()
        assert len(rows) == len({r["node"] for r in rows})
        assert {r["node"]: r["component"] for r in rows} == brute(edges)


def test_stars_of_a_long_path_are_whole():
    order = np.random.default_rng(1).permutation(100_000)
    nodes, roots = stars(order[:-1], order[1:])
    assert len(nodes) == 100_000
    assert not roots.any()
