"""Exact joins with pruning against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import graph, metric, search

# ---- similarity ---------------------------------------------------------------------------------


def clustered(n, dims, centres, spread, seed):
    r = np.random.default_rng(seed)
    c = r.normal(size=(centres, dims))
    return (c[r.integers(0, centres, n)] + r.normal(size=(n, dims)) * spread).astype(np.float32)


def all_pairs(x, least):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(u @ u.T >= least, 1))
    return set(zip(a.tolist(), b.tolist()))


CASES = [(400, 8, 12, 0.15, 0.9), (400, 8, 400, 1.0, 0.8), (300, 3, 5, 0.02, 0.99), (300, 16, 3, 0.05, 0.95), (200, 4, 1, 0.0, 1.0 - 1e-9), (150, 6, 10, 0.5, -0.2)]


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("cell", [7, 60])
def test_similarity_join_is_exact(spark, case, cell):
    *shape, least = case
    x = clustered(*shape, seed=3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>")
    got = search.similar_pairs(df, least, cell=cell, sample=200).collect()
    assert len(got) == len({(r.a, r.b) for r in got})  # each pair once
    assert {(r.a, r.b) for r in got} == all_pairs(x, least)


def test_similarity_join_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, None]), (8, [1.0]), (9, [2.0]), (10, [])]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    assert {(r.a, r.b) for r in search.similar_pairs(df, 0.9).collect()} == {(1, 2), (8, 9)}
    assert search.similar_pairs(df.limit(0), 0.9).count() == 0


def test_cells_are_skipped(spark):
    """Of clustered vectors, nearly all pairs of cells are never compared; of even ones, all are."""
    share = {}
    for name, (n, dims, centres, spread) in {"clustered": (2000, 16, 40, 0.05), "even": (2000, 16, 2000, 1.0)}.items():
        x = clustered(n, dims, centres, spread, seed=8)
        unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(unit)], "id long, v array<double>")
        p = metric.pivots(df, n, 50, 1000)
        angle = np.arccos(np.clip(unit @ p.T, -1, 1))
        own = angle.argmin(1)
        radius = np.array([angle[own == c, c].max(initial=0) for c in range(len(p))])
        goes = metric.targets(unit, own, p, radius, np.arccos(0.9))
        met = {(c, t) for c, row in zip(own.tolist(), goes) for t in np.flatnonzero(row).tolist()}
        share[name] = len(met) / (len(p) * (len(p) - 1) / 2)
        assert (goes.sum(1) <= len(p) - 1).all()
    assert share["clustered"] < 0.1 < share["even"]


def test_plan_routes_rows_by_bounds(spark):
    df = spark.createDataFrame([(i, [1.0, i / 100]) for i in range(50)], "id long, embedding array<double>")
    plan = search.similar_pairs(df, 0.9, cell=10)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan


# ---- overlap --------------------------------------------------------------------------------------


def sets_of(n, seed, hub, long):
    r = random.Random(seed)
    out = {}
    for t in range(n):
        s = {r.randrange(60) for _ in range(r.randint(1, 6))}
        if hub:
            s |= {1000, 1001}
        if long and t % 15 == 0:
            s |= {r.randrange(60) for _ in range(45)}
        out[t] = s
    return out


@pytest.mark.parametrize("least", [1, 2, 3, 5])
@pytest.mark.parametrize("shape", [(False, False), (True, False), (True, True)])
def test_overlap_join_is_exact(spark, least, shape):
    sets = sets_of(120, least, *shape)
    rows = [(t, i) for t, s in sets.items() for i in s] * 2 + [(None, 3), (4, None)]
    df = spark.createDataFrame(rows, "thought_id long, entity_id long").withColumn("n", F.lit(1))
    got = {(r.a, r.b, r.shared) for r in graph.overlap_pairs(df, least).collect()}
    assert got == {(a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= least}
    assert graph.overlap_pairs(df.limit(0), least).count() == 0


def test_hub_items_are_not_expanded(spark):
    """An item that every set holds makes no candidates: sets meet by rare pairs of items only."""
    n = 3000
    rows = [(t, i) for t in range(n) for i in (10_000, 10_001 + t % 2, t // 2)]  # a hub, two half hubs, and one shared by two
    df = spark.createDataFrame(rows, "thought_id long, entity_id long")
    got = graph.overlap_pairs(df.where("entity_id < 10000 OR entity_id = 10000"), 2)
    assert got.count() == n // 2
    sizes = df.where("entity_id <> 10001 AND entity_id <> 10002").groupBy("entity_id").count().agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0]
    assert sizes > 4_000_000  # what a join on single items would put out
