"""The stored vector index against scans of all vectors."""

import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import search, vector_index

ROWS = "id long, embedding array<float>, label int, serial_id long"


def frame(spark, x, start=0):
    return spark.createDataFrame([(start + i, v.tolist(), i % 3, start + i) for i, v in enumerate(x)], ROWS).repartition(3)


def clustered(n, dims, centres, spread, seed):
    r = np.random.default_rng(seed)
    c = r.normal(size=(centres, dims))
    return (c[r.integers(0, centres, n)] + r.normal(size=(n, dims)) * spread).astype(np.float32)


@pytest.fixture(scope="module")
def indexes(spark):
    out = {}
    for name, x in {"clustered": clustered(1500, 16, 30, 0.1, 1), "even": clustered(1000, 10, 1000, 1.0, 2), "odd": np.repeat(clustered(60, 3, 60, 1.0, 3), 5, 0)}.items():
        df = frame(spark, x)
        out[name] = (x, df, vector_index.build_index(df, tempfile.mkdtemp(prefix="spark-") + "/index", attributes=("label",)))
    return out


def rows(df):
    return [(r[0], round(r[1], 9)) for r in df.collect()]


def scan(df, q, most, threshold, strict=True):
    return rows(search.match(df, q, threshold, most, strict=strict).select("serial_id", "similarity"))


@pytest.mark.parametrize("name", ["clustered", "even", "odd"])
@pytest.mark.parametrize("most,threshold", [(10, 0.2), (3, 0.95), (40, -1.0)])
def test_exact_search_equals_scan(indexes, name, most, threshold):
    x, df, index = indexes[name]
    for q in (x[7].tolist(), np.random.default_rng(4).normal(size=x.shape[1]).tolist()):
        found, visited = index.search(q, most, threshold)
        assert rows(found) == scan(df, q, most, threshold)
        assert visited <= len(index.size)


def test_lists_are_skipped_and_pruned(indexes):
    x, df, index = indexes["clustered"]
    _, visited = index.search(x[7].tolist(), 5, 0.9)
    assert len(index.size) > 30 and visited < len(index.size) / 3
    plan = index._scored([3, 5], np.ones(16) / 4, 0.0, 5, None)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "list#" in plan.split("PartitionFilters", 1)[1].split("]", 1)[0]
    assert "embedding" not in plan  # codes only


def test_conditions_within_lists(indexes):
    x, df, index = indexes["clustered"]
    q = x[7].tolist()
    found, _ = index.search(q, 8, 0.1, where=F.col("label") == 2)
    assert rows(found) == scan(df.where("label = 2"), q, 8, 0.1)


def test_probes_go_on_until_enough_is_found(indexes):
    x, df, index = indexes["even"]
    found, visited = index.search(x[3].tolist(), 10, -1.0, probes=1)
    assert found.count() == 10 and visited < len(index.size)
    found, visited = index.search(x[3].tolist(), 2000, -1.0, probes=1)
    assert found.count() == 1000 and visited == len(index.size)


def test_recall_of_probes(indexes):
    """A sixth of the lists finds at least 0.95 of the ten nearest of even vectors' neighbours; all of clustered ones'."""
    for name, probes, least in (("clustered", 4, 0.99), ("even", 30, 0.95)):
        x, _, index = indexes[name]
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        got = []
        for i in range(0, 250, 50):
            want = set(np.argsort(-(u @ u[i]), kind="stable")[:10].tolist())
            found, _ = index.search(x[i].tolist(), 10, -1.0, probes=probes)
            got.append(len(want & {r.id for r in found.collect()}) / 10)
        assert np.mean(got) >= least, (name, np.mean(got), len(index.size))


def test_segments_are_appended(spark, indexes):
    x, df, _ = indexes["clustered"]
    path = tempfile.mkdtemp(prefix="spark-") + "/index"
    index = vector_index.build_index(df.where("id < 1000"), path, attributes=("label",))
    index = index.append(df.where("id >= 1000"), attributes=("label",))
    assert index.segments == (0, 1) and vector_index.open_index(spark, path).size.sum() == 1500
    q = x[1200].tolist()
    assert rows(index.search(q, 12, 0.3)[0]) == scan(df, q, 12, 0.3)


def test_odd_rows_and_queries(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, [1.0, 0.0], 0, 1), (2, [1.0, 0.0], 0, 2), (3, None, 0, 3), (4, [0.0, 0.0], 0, 4), (5, [nan, 1.0], 0, 5), (6, [inf, 1.0], 0, 6), (7, [1.0, None], 0, 7), (8, [1.0], 0, 8), (None, [1.0, 0.0], 0, 9), (10, [-1.0, 0.5], 0, 10)]
    df = spark.createDataFrame(odd, ROWS)
    index = vector_index.build_index(df, tempfile.mkdtemp(prefix="spark-") + "/index")
    assert [r.id for r in index.search([1.0, 0.1], 9, -1.0)[0].collect()] == [1, 2, 10]
    assert index.search([1.0, 0.0], 9, 1.0, strict=False)[0].count() == 2 and index.search([1.0, 0.0], 9, 1.0)[0].count() == 0
    for q in ([0.0, 0.0], [1.0], [nan, 1.0]):
        assert index.search(q, 9, -1.0)[0].count() == 0
    empty = vector_index.build_index(df.limit(0), tempfile.mkdtemp(prefix="spark-") + "/index")
    assert empty.search([1.0, 0.0])[0].count() == 0
