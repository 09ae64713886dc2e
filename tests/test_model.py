"""Hashing, index and sketch against small models in plain Python."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearsieve.config import MASK, ORDERS, KnnConfig
from nearsieve.functions.u32 import mul
from nearsieve.operators import doph, index, query, sketch

SMALL = KnnConfig(hashes=2, tables=3, address_bits=6, reservoir=3, top_k=4, sketch_bits=2, seed=5)


def plain_addresses(features, cfg):
    c, sig = cfg.constants, {}
    for x in features:
        h = x * c["feature"] & MASK
        h = (h ^ h >> 13) * 0x85EBCA6B & MASK
        cur = ((h * x & MASK) << 5 & MASK) >> (32 - cfg.address_bits)
        b = min(cur // cfg.width, cfg.bins - 1)
        sig[b] = min(cur, sig.get(b, MASK))
    full = []
    for b in range(cfg.bins):
        full.append(sig[b] if b in sig else next((sig[j] for j in cfg.donors[b] if j in sig), MASK))
    out = []
    for t in range(cfg.tables):
        total = 0
        for k in range(cfg.hashes):
            s, r = full[cfg.hashes * t + k], c["bins"][cfg.hashes * t + k]
            x = s * r & MASK
            total += ((x ^ x >> 13) ^ r) * s & MASK
        out.append(((total & MASK) << 2 & MASK) >> (32 - cfg.address_bits))
    return out


def long_form(spark, sets):
    return spark.createDataFrame([(i, x) for i, s in sets.items() for x in s], "id long, idx long")


def test_mul_wraps(spark):
    r = random.Random(1)
    edges = [0, 1, 65535, 65536, MASK - 1, MASK]
    pairs = [(a, b) for a in edges for b in edges] + [(r.getrandbits(32), r.getrandbits(32)) for _ in range(500)]
    rows = spark.createDataFrame(pairs, "a long, b long").select("a", "b", mul(F.col("a"), F.col("b")).alias("m")).collect()
    assert all(x.m == x.a * x.b & MASK for x in rows)


@pytest.mark.parametrize("cfg", [SMALL, ORDERS])
def test_addresses_equal_the_model(spark, cfg):
    r = random.Random(2)
    sets = {i: {r.randint(1, 2**32 - 1) for _ in range(r.randint(1, 12))} for i in range(60)} | {60: {5}, 61: set(range(1, 3000))}
    got = defaultdict(dict)
    for x in doph.addressed(long_form(spark, sets), cfg).collect():
        got[x.id][x.tbl] = x.bucket
    assert {i: [b[t] for t in range(cfg.tables)] for i, b in got.items()} == {i: plain_addresses(s, cfg) for i, s in sets.items()}


def test_equal_sets_share_addresses_in_any_order(spark):
    rows = spark.createDataFrame([(1, 2), (1, 9), (1, 4), (2, 9), (2, 4), (2, 2), (2, 2)], "id long, idx long")
    by = defaultdict(set)
    for x in doph.addressed(rows.repartition(3), SMALL).collect():
        by[x.id].add((x.tbl, x.bucket))
    assert by[1] == by[2] and len(by[1]) == 3


def test_all_empty_signature():
    assert doph.densified(np.full((2, SMALL.bins), -1), SMALL).tolist() == [[MASK] * SMALL.bins] * 2


def test_overfull_buckets_keep_a_fixed_sample(spark):
    rows = long_form(spark, {i: {7, 8} for i in range(8)})
    a = {tuple(x) for x in index.reservoirs(doph.addressed(rows, SMALL), SMALL).collect()}
    b = {tuple(x) for x in index.reservoirs(doph.addressed(rows.repartition(5), SMALL), SMALL).collect()}
    assert a == b and {x[4] for x in a} == {8} and all(sum(y[0] == t for y in a) == 3 for t in range(3))
    addr = doph.addressed(rows, SMALL)
    first = index.reservoirs(addr.filter("id < 5"), SMALL)
    assert {tuple(x) for x in index.merge_index(first, addr.filter("id >= 5"), SMALL).collect()} == a


def test_ranks_ties_and_missing_candidates(spark):
    rows = spark.createDataFrame([(1, 0, 0, i) for i in (9, 3, 0, 3, 9, 0, 5)], "qid long, tbl int, slot int, id long")
    found = query.top_by_count(rows, 2).collect()
    assert [(x.rank, x.id, x.n) for x in sorted(found, key=lambda x: x.rank)] == [(0, 0, 2), (1, 3, 2)]
    assert query.top_by_count(rows.limit(0), 2).count() == 0
    assert query.top_by_count(rows, 10).count() == 4


def plain_sketch(stream, cells):
    out = {}
    for x in stream:
        hh, n = out.get(cells[x], (x, 0))
        n = n + (1 if hh == x else -1) if n > 0 else 0
        out[cells[x]] = (x, 1) if n == 0 else (hh, n)
    return out


def test_sketch_equals_the_model(spark):
    r = random.Random(3)
    stream = [min(r.randint(0, 12), r.randint(0, 12)) for _ in range(200)]
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(stream)], "qid long, slot int, id long").repartition(4)
    got = defaultdict(dict)
    for x in sketch.sketch(rows, SMALL, ["qid"], ["slot"]).collect():
        got[x.row][x.cell] = (x.hh, x.cnt)
    for row, m in enumerate(SMALL.constants["rows"]):
        assert got[row] == plain_sketch(stream, {x: ((x + 1) * m & MASK) >> (32 - SMALL.sketch_bits) for x in stream})


def test_merge_contract(spark):
    cases = [((1, 3), (1, 2), (1, 5)), ((1, 3), (2, 2), (1, 1)), ((1, 2), (2, 3), (2, 1)), ((1, 2), (2, 2), (2, 0))]
    rows = [(q, p, 0, 0, *c[p]) for q, c in enumerate(cases) for p in (0, 1)]
    cells = spark.createDataFrame(rows, "qid long, part long, row int, cell long, hh long, cnt long")
    for merged in (sketch.linear_merge(cells, ["qid"]), sketch.tree_merge(cells, ["qid"], 2)):
        assert {x.qid: (x.hh, x.cnt) for x in merged.collect()} == {q: c[2] for q, c in enumerate(cases)}


def test_configurations_are_checked():
    for bad in ({"hashes": 1, "tables": 1}, {"hashes": 8, "tables": 8, "address_bits": 4}, {"reservoir": 0}):
        with pytest.raises(ValueError):
            KnnConfig(**bad)
