"""A stored index of vectors: lists by nearest centroid, product-quantised residuals, exact re-ranking.

An index is a folder of Parquet tables:

    lists                       segment, list, n, radius (largest angle of a member to the centroid)
    codes/segment=K/list=L      id, code (one byte for each group of components), error, attributes
    vectors/segment=K/list=L    id, embedding
    model                       the centroids, and the codewords of each group of components

Centroids and codewords are fitted on a bounded sample (SAMPLE rows, the smallest hashes of ids); every
row is coded. A search visits lists from the nearest centroid on and reads their codes only. A code
gives the similarity up to the error that is stored with it, so rows that cannot be among the best are
left out without a look at their vectors; the others' vectors are read and compared exactly. It ends
when no list that is left can hold a better row, by the angle between query and centroid less the
radius: then the answer is exact. With ``probes`` it ends after so many lists, if enough rows are found.

Defined cases: rows whose vector is null, zero, not finite or of another length than the index are
not in it (they match nothing); ids must be unique, null ids are left out; equal similarities go by id; an index of
no rows answers with none; a zero query or one of another length matches nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors

#: Rows on which centroids and codewords are fitted.
SAMPLE = 20_000
MOST_LISTS = 4096
#: Components that share a byte, and the codewords of a byte.
GROUP, WORDS = 4, 256
ROUNDS = 8
#: Lists of the first visit; each further visit doubles them.
FIRST_PROBES = 4
#: Rows of a list that one file holds at most, about.
FILE_ROWS = 4_000_000
#: Candidates up to which vectors are read by id.
FEW = 2_000
#: Slack of every bound, for rounding.
EPSILON = 1e-6


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def _matrix(column: pd.Series, dims: int) -> np.ndarray:
    return np.array(column.tolist(), float).reshape(len(column), dims)


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1)[None, :] - 2 * (x @ c.T)).argmin(1)


def _means(x: np.ndarray, k: int, seed: int, unit: bool) -> np.ndarray:
    """k centroids of the rows of a sample by Lloyd's rounds; empty ones stay where they were."""
    c = x[np.random.default_rng(seed).permutation(len(x))[:k]]
    for _ in range(ROUNDS):
        own = _nearest(x, c)
        n = np.bincount(own, minlength=len(c))
        sums = np.stack([np.bincount(own, x[:, i], len(c)) for i in range(x.shape[1])], 1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        if unit:
            norm = np.linalg.norm(c, axis=1, keepdims=True)
            c = np.where(norm > 0, c / np.where(norm > 0, norm, 1), x[: len(c)])
    return c


@dataclass(frozen=True)
class Model:
    """Centroids of the lists, and codewords of each group of components."""

    centroids: np.ndarray
    words: list[np.ndarray]

    @property
    def dims(self) -> int:
        return self.centroids.shape[1]

    def groups(self) -> list[slice]:
        return [slice(i, min(i + GROUP, self.dims)) for i in range(0, self.dims, GROUP)]

    def coded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """list, angle to its centroid, code and error of unit vectors."""
        near = x @ self.centroids.T
        own = near.argmax(1)
        angle = np.arccos(np.clip(near[np.arange(len(x)), own], -1, 1))
        rest = x - self.centroids[own]
        code = np.empty((len(x), len(self.words)), np.uint8)
        for k, (g, w) in enumerate(zip(self.groups(), self.words)):
            code[:, k] = _nearest(rest[:, g], w)
            rest[:, g] -= w[code[:, k]]
        return own, angle, code, np.linalg.norm(rest, axis=1)


def fit(rows: DataFrame, n: int, sample: int = SAMPLE, lists: int | None = None) -> Model:
    """The model of (id, embedding) rows of one length, ``n`` in number."""
    few = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("embedding").collect()
    x = _unit(np.array([r.embedding for r in few], float))
    k = min(lists or max(1, round(2 * math.sqrt(n))), MOST_LISTS, max(1, len(x) // 8))
    c = _means(x, k, 1, True)
    rest = x - c[(x @ c.T).argmax(1)]
    words = [_means(rest[:, i : i + GROUP], min(WORDS, len(x)), 2 + i, False) for i in range(0, x.shape[1], GROUP)]
    return Model(c, words)


def usable(rows: DataFrame, key: str, embedding: str, dims: int) -> DataFrame:
    e = F.col(embedding)
    sound = (F.size(e) == dims) & F.forall(e, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False))) & F.exists(e, lambda v: v != 0)
    return rows.where(F.col(key).isNotNull() & F.coalesce(sound, F.lit(False)))


@dataclass(frozen=True)
class VectorIndex:
    """An index as it was when it was opened; the model and a few numbers a list are in memory."""

    spark: SparkSession
    path: str
    model: Model | None
    segments: tuple[int, ...] = ()
    radius: np.ndarray = field(default_factory=lambda: np.zeros(0))
    size: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def table(self, name: str, lists: list[int]) -> DataFrame:
        """A table's rows of some lists; other folders are not read."""
        return self.spark.read.parquet(f"{self.path}/{name}").where(F.col("segment").isin(*self.segments) & F.col("list").isin(*lists))

    def _scored(self, lists: list[int], q: np.ndarray, floor: float, most: int, where: Column | None) -> DataFrame:
        """id, list, low, high: bounds of the similarity of the lists' rows that may be among the best."""
        rows = self.table("codes", lists)
        rows = (rows if where is None else rows.where(where)).select("id", "list", "code", "error")
        base = self.model.centroids @ q
        tables = np.zeros((len(self.model.words), WORDS))
        for k, (g, w) in enumerate(zip(self.model.groups(), self.model.words)):
            tables[k, : len(w)] = w @ q[g]

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if not len(pdf):
                    continue
                code = np.frombuffer(b"".join(pdf["code"]), np.uint8).reshape(len(pdf), -1)
                about = base[pdf["list"].to_numpy()] + tables[np.arange(code.shape[1])[None, :], code].sum(1)
                error = pdf["error"].to_numpy() + EPSILON
                low, high = about - error, about + error
                least = max(floor, np.partition(low, -most)[-most]) if len(low) >= most else floor
                keep = high >= least
                yield pd.DataFrame({"id": pdf["id"].to_numpy()[keep], "list": pdf["list"].to_numpy()[keep], "low": low[keep], "high": high[keep]})

        return rows.mapInPandas(work, f"id {dict(rows.dtypes)['id']}, list int, low double, high double")

    def _exact(self, lists: list[int], query: Sequence[float], floor: float, strict: bool, threshold: float, most: int, where: Column | None) -> list[tuple]:
        """The best rows of some lists as (similarity, id), at most ``most``."""
        found = self._scored(lists, _unit(np.array(query, float)), floor, most, where).checkpoint()
        lows = [r.low for r in found.orderBy(F.desc("low")).limit(most).select("low").collect()]
        found = found.where(F.col("high") >= max(floor, lows[-1] if len(lows) == most else floor))
        few = found.limit(FEW + 1).select("id", "list").collect()
        rows = self.table("vectors", lists)
        if len(few) <= FEW:
            if not few:
                return []
            rows = rows.where(F.col("list").isin(*{r.list for r in few}) & F.col("id").isin(*[r.id for r in few]))
        else:
            rows = rows.join(found.select("id", "list"), ["id", "list"], "left_semi")
        rows = rows.select("id", vectors.cosine_to(F.col("embedding"), query).alias("s"))
        rows = rows.where(F.col("s") > threshold if strict else F.col("s") >= threshold)
        return [(r.s, r.id) for r in rows.orderBy(F.desc("s"), "id").limit(most).collect()]

    def search(self, query: Sequence[float], most: int = 10, threshold: float = 0.7, where: Column | None = None, strict: bool = True, probes: int | None = None) -> tuple[DataFrame, int]:
        """(id, similarity of the best rows above a threshold (at it too unless strict), best first;
        the number of lists visited). ``where`` is a condition on the attributes, applied within lists."""
        q = np.array(query, float)
        best: list[tuple] = []
        visited = 0
        kind = "bigint"
        if self.model is not None and len(q) == self.model.dims and np.isfinite(q).all() and q.any():
            kind = dict(self.table("codes", [0]).dtypes)["id"]
            angle = np.arccos(np.clip(self.model.centroids @ _unit(q), -1, 1))
            order = [int(i) for i in np.argsort(angle, kind="stable") if self.size[i]]
            reach = np.cos(np.maximum(0, angle - self.radius - EPSILON))
            step = probes or FIRST_PROBES
            while visited < len(order):
                full = len(best) == most
                floor = max(threshold, best[-1][0] if full else threshold) - EPSILON
                left = [i for i in order[visited:] if reach[i] >= floor]
                if not left or (probes and full and visited >= probes):
                    break
                now = [i for i in order[visited : visited + step] if reach[i] >= floor]
                visited += step
                step *= 2
                if now:
                    best = sorted([*best, *self._exact(now, query, floor, strict, threshold, most, where)], key=lambda r: (-r[0], r[1]))[:most]
        rows = [(i, float(s)) for s, i in best]
        return self.spark.createDataFrame(rows, f"id {kind}, similarity double"), min(visited, len(self.size))

    def append(self, rows: DataFrame, key: str = "id", embedding: str = "embedding", attributes: tuple[str, ...] = ()) -> VectorIndex:
        """Add rows of new ids by the model as it is; nothing that is written is written again."""
        return _write(self, rows, key, embedding, attributes, max(self.segments, default=-1) + 1)


def _write(index: VectorIndex, rows: DataFrame, key: str, embedding: str, attributes: tuple[str, ...], segment: int) -> VectorIndex:
    model, spark = index.model, rows.sparkSession
    given = usable(rows, key, embedding, model.dims).select(F.col(key).alias("id"), F.col(embedding).alias("embedding"), *attributes)
    kinds = dict(given.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in given.columns) + ", list int, angle double, code binary, error double"

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                own, angle, code, error = model.coded(_unit(_matrix(pdf["embedding"], model.dims)))
                yield pdf.assign(list=own.astype(np.int32), angle=angle, code=[c.tobytes() for c in code], error=error)

    spread = max(1, -(-given.count() // FILE_ROWS))
    coded = given.mapInPandas(work, schema).repartition("list", F.pmod(F.xxhash64("id"), F.lit(spread))).sortWithinPartitions("list", "id").checkpoint()
    coded.select("id", "code", F.col("error").cast("float").alias("error"), *attributes, "list").write.mode("overwrite").partitionBy("list").parquet(f"{index.path}/codes/segment={segment}")
    coded.select("id", "embedding", "list").write.mode("overwrite").partitionBy("list").parquet(f"{index.path}/vectors/segment={segment}")
    sizes = coded.groupBy("list").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).withColumn("segment", F.lit(segment))
    sizes.coalesce(1).write.mode("append").parquet(f"{index.path}/lists")  # the segment counts from here on
    return open_index(spark, index.path)


def build_index(rows: DataFrame, path: str, key: str = "id", embedding: str = "embedding", attributes: tuple[str, ...] = (), dims: int | None = None, lists: int | None = None, sample: int = SAMPLE) -> VectorIndex:
    """Write a new index to ``path``. Of several lengths of vectors, the most frequent one is indexed, or ``dims``."""
    spark = rows.sparkSession
    if dims is None:
        by = rows.where(F.col(embedding).isNotNull()).groupBy(F.size(embedding).alias("d")).count().orderBy(F.desc("count"), "d").first()
        dims = by.d if by else 0
    given = usable(rows, key, embedding, dims).select(F.col(key).alias("id"), F.col(embedding).alias("embedding"))
    n = given.count() if dims else 0
    if not n:
        return VectorIndex(spark, path, None)
    model = fit(given, n, sample, lists)
    parts = [("centroids", i, c.tolist()) for i, c in enumerate(model.centroids)]
    parts += [(f"words{k}", i, w.tolist()) for k, words in enumerate(model.words) for i, w in enumerate(words)]
    spark.createDataFrame(parts, "part string, number int, v array<double>").coalesce(1).write.parquet(f"{path}/model")
    return _write(VectorIndex(spark, path, model), rows, key, embedding, attributes, 0)


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    parts: dict[str, list] = {}
    for r in spark.read.parquet(f"{path}/model").orderBy("part", "number").collect():  # at most MOST_LISTS and WORDS a group
        parts.setdefault(r.part, []).append(r.v)
    model = Model(np.array(parts["centroids"]), [np.array(parts[f"words{k}"]) for k in range(len(parts) - 1)])
    radius, size, segments = np.zeros(len(model.centroids)), np.zeros(len(model.centroids), np.int64), set()
    for r in spark.read.parquet(f"{path}/lists").collect():  # a row a segment and list
        radius[r.list], size[r.list] = max(radius[r.list], r.radius), size[r.list] + r.n
        segments.add(r.segment)
    return VectorIndex(spark, path, model, tuple(sorted(segments)), radius, size)
