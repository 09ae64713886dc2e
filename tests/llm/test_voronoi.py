import math
import random

import numpy as np
import pytest

from nearsieve.llm import voronoi


def plain(rows, k=5, every=50):
    kept = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(256 * float(x)) for x in v]))
    out = []
    for q, v in {i: min(x for j, x in kept if j == i) for i, _ in kept if i % every == 0}.items():
        near = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in kept if i != q)[:k]
        out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(near)]
    return sorted(out)


def search(spark, rows, **how):
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, v string")
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in voronoi.top_k(table, **how).collect())


def test_equals_brute_force(spark, monkeypatch):
    r = random.Random(3)
    centres = [[r.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [c + r.gauss(0, 0.1) for c in r.choice(centres)]) for i in range(600)]
    rows += [(1000 + i, [0.5] * 6) for i in range(40)]  # ties
    rows += [(2000, None), (2001, [1.0, None]), (2002, [float("nan")]), (2003, [float("inf")] * 6), (2004, []), (None, [1.0] * 6), (2005, [9.0]), (2050, [0.0] * 6), (50, rows[50][1])]
    assert search(spark, rows) == plain(rows)
    monkeypatch.setattr(voronoi, "QUERIES", 2)  # many groups and blocks
    monkeypatch.setattr(voronoi, "ROWS", 50)
    assert search(spark, rows, pivots=7) == plain(rows)


def test_few_and_no_rows(spark):
    assert search(spark, []) == []
    assert search(spark, [(7, [1.0]), (9, [2.0])]) == []
    assert search(spark, [(50, [1.0]), (9, [-2.0])]) == plain([(50, [1.0]), (9, [-2.0])])
    assert search(spark, [(50, [1.0])]) == []


def test_all_finite_vectors_take_part(spark):
    rows = [(50, [1e9, 1.0]), (51, [1.0, -2.0]), (52, []), (53, [-1e4, 0.5]), (54, [3e4, 3.5]), (100, []), (150, [2.5])]
    assert search(spark, rows) == plain(rows)
    with pytest.raises(Exception, match="int too (large|big)"):
        search(spark, [(50, [7e6] * 64), (51, [2e9] * 64)])


def test_cells_that_need_the_same_rows_are_one_group():
    rows = {c: 100 for c in range(6)}
    everything, asks = {a: set(rows) for a in range(6)}, {a: 10 for a in range(6)}
    assert [sorted(g) for g in voronoi.grouped(everything, asks, rows, 1000)] == [list(range(6))]
    assert sorted(len(g) for g in voronoi.grouped(everything, asks, rows, 30)) == [3, 3]
    assert sorted(map(sorted, voronoi.grouped({0: {0, 1}, 1: {0, 1}, 2: {4}, 3: {4, 5}}, asks, rows, 1000))) == [[0, 1], [2, 3]]
    placed = voronoi.dealt_blocks({0: 10, 1: 20, 2: 250, 3: 90, 4: 5, 5: 6}, 100)
    assert placed == {0: (0, 1), 1: (0, 1), 2: (1, 3), 3: (4, 1), 4: (4, 1), 5: (5, 1)}


def test_far_cells_are_not_sent():
    pivots = np.array([[0.0, 0.0], [100.0, 0.0]])
    reach = voronoi.bounds(pivots, {0: 1.0}, {0: [0.0, 1.0, 1.0], 1: [0.0, 0.0, 0.0]}, 3)
    assert reach == {0: 2.0}  # less than the 98 that rows of the other cell are away
    assert voronoi.bounds(pivots, {0: 1.0}, {0: [0.0]}, 3)[0] == float("inf")


def test_large_products_stay_exact():
    q, x = np.array([[2.0**30, 1.0]]), np.array([[2.0**30, 1.0]])
    assert voronoi.scores(q, x)[0, 0] == 2**60 + 1
