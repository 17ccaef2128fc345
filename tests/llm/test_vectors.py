import math
import random

import pytest

from tests.llm.cases import same_as_sql
from vintagerisk.llm import vector_file


def brute_force(rows, queries, k):
    def clean(rows):
        fine = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
        return list({(i, tuple(math.floor(1024 * x) for x in v)) for i, v in fine})

    out = []
    for q, v in clean(queries):
        scores = sorted((-min(max(sum(a * b for a, b in zip(v, w, strict=True)), 1 - 2**63), 2**63 - 1), i) for i, w in clean(rows) if i != q and len(w) == len(v))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def vectors(n, dim, seed, levels=None):
    r = random.Random(seed)
    draw = (lambda: r.choice(levels)) if levels else (lambda: r.gauss(0, 0.2))
    return [(i, [draw() for _ in range(dim)]) for i in range(n)]


def searched(spark, rows, asked, **more):
    full = lambda x: spark.createDataFrame([(i, v, 0, 1) for i, v in x], "vec_id long, embedding array<double>, v int, query int")
    return sorted(tuple(r) for r in vector_file.search(full(rows).repartition(3), full(asked), **more).collect())


@pytest.mark.parametrize("levels", [None, [0.0, 0.5], [-1.0, 0.001, 1.0]])
def test_equals_brute_force(spark, levels):
    rows = vectors(700, 12, 1, levels)
    asked = [r for r in rows if r[0] % 100 == 0]
    assert searched(spark, rows, asked, k=10, block=3) == brute_force(rows, asked, 10)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.1, 0.2]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (None, [1.0, 1.0]), (6, [0.1]), (7, [0.5]), (8, []), (9, []), (10, [0.3, 0.3]), (10, [0.3, 0.3]), (10, [0.9, 0.1]), (1, [0.1, 0.2])]
    assert searched(spark, rows, rows, k=4) == brute_force(rows, rows, 4)


def test_one_vector_shared_by_most_rows(spark):
    rows = [(i, [0.25, -0.5, 0.125]) for i in range(300)] + [(300 + i, [0.25, -0.5, 0.125 + i / 64]) for i in range(20)]
    asked = [r for r in rows if r[0] % 100 == 0]
    assert searched(spark, rows, asked, k=5) == brute_force(rows, asked, 5)


def test_huge_components_stay_exact(spark):
    rows = [(i, [(-1) ** i * 3.0e12 + i, 1e10 * i, 7.0]) for i in range(12)] + [(50, [0.0, 0.0, 0.0])]
    assert searched(spark, rows, rows[:4] + rows[-1:], k=3) == brute_force(rows, rows[:4] + rows[-1:], 3)


def test_no_rows(spark):
    assert searched(spark, [], []) == [] and searched(spark, [(1, [1.0])], [(1, [1.0])]) == []


def test_few_exact_vectors_are_read(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    v = np.floor(rng.normal(0, 200, (4000, 32)))
    low, step = int(v.min()), int(v.max() - v.min()) // 256 + 1
    block = vector_file.Block(np.arange(5), np.arange(5), v[:5], low, step)
    lower = block.lower((v - low) // step)
    exact = v[:5] @ v.T
    assert (lower <= exact).all() and (exact <= lower + block.slack[:, None]).all()
    reach = -np.sort(-lower, 1)[:, 9]
    assert (lower + block.slack[:, None] >= reach[:, None]).mean() < 0.05


def test_query_op9(spark):
    same_as_sql(spark, "op9_vector_file_search", "/root/testdata/sf0.01")
