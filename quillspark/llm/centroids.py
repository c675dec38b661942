"""Centroid clustering by Lloyd's rounds on changes only.

Vectors become integers, so sums, means and distances are exact. The state of a round is two tables
in the shared folder: the assignment of every vector, with its distance, and the sums and counts of
every cluster. A round compares a vector only with centroids that changed in the last update; only
a vector whose own centroid moved away from it meets all of them. Vectors that change their owner
are subtracted from the old sums and added to the new ones as signed integers; nothing else is
summed again.

Defined cases: vectors that are null, of another length than ``dims`` or with a component that is
null or not finite are left out; rows that repeat a vec_id are vectors of their own; a null vec_id
comes last among the first centroids; fewer vectors than ``k`` give as many centroids; an empty
table gives an empty result; other columns are ignored. A component of more than BOUND after
rounding raises, since squared distances would leave 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_path, field, scratch_path

SCALE = 256
#: Largest component after rounding.
BOUND = 1 << 26
#: Components up to here have dot products that doubles hold exactly.
EXACT = 1 << 21
NO_OWNER = -1


def rounded(vectors: DataFrame, dims: int) -> DataFrame:
    """vec_id and q, the rounded components, of the vectors that take part."""
    e = F.col("embedding")
    whole = (F.size(e) == dims) & F.forall(e, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))

    def integer(x: Column) -> Column:
        v = F.floor(F.lit(SCALE) * x.cast("double"))
        return F.when(F.abs(v) <= BOUND, v).otherwise(F.raise_error(F.lit("component out of range")).cast("bigint")).cast("int")

    return vectors.where(F.coalesce(whole, F.lit(False))).select("vec_id", F.transform(e, integer).alias("q"))


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``x`` to all rows of ``c``."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= EXACT:
        a, b = x.astype(float), c.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], 1)


def reassign(x: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """New owners and distances, and how many distances were computed.

    A centroid that stayed where it was is no nearer than the owner was, so while the own
    centroid has not gone away from the vector, only changed ones can win; at equal distance the
    smaller number does."""
    moved = changed[np.maximum(owner, 0)] & (owner != NO_OWNER)
    now = distance.copy()
    if moved.any():
        now[moved] = ((x[moved] - centroids[owner[moved]]) ** 2).sum(1)
    everything = (owner == NO_OWNER) | (moved & (now > distance))
    owner, done = owner.copy(), int(moved.sum())
    for rows, among in ((everything, np.arange(len(centroids))), (~everything, np.flatnonzero(changed))):
        if not rows.any() or not len(among):
            continue
        d = distances(x[rows], centroids[among])
        done += d.size
        at = d.argmin(1)
        best, number, own, old = d[np.arange(len(d)), at], among[at], owner[rows], now[rows]
        keep = (own != NO_OWNER) & ((old < best) | ((old == best) & (own < number)))
        now[rows], owner[rows] = np.where(keep, old, best), np.where(keep, own, number)
    return owner, now, done


def _matrix(lists: pa.Array, dims: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _assign(state: DataFrame, centroids: list[list[int]], changed: list[bool], dims: int) -> DataFrame:
    c, flags, kind = np.array(centroids, np.int64).reshape(-1, dims), np.array(changed, bool), field(state, "vec_id", "bigint")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                was = b.column("owner").to_numpy().astype(np.int64)
                owner, d, _ = reassign(_matrix(b.column("q"), dims), was, b.column("distance").to_numpy().astype(np.int64), c, flags)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("q"), pa.array(was, pa.int32()), pa.array(owner, pa.int32()), pa.array(d, pa.int64())], ["vec_id", "q", "was", "owner", "distance"])

    return state.mapInArrow(work, f"vec_id {kind}, q array<int>, was int, owner int, distance bigint")


def transfers(state: DataFrame, dims: int) -> DataFrame:
    """cluster, part, amount: what each partition's movers take from and bring to the sums; part 0
    is the count, part i + 1 component i."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            x = _matrix(b.column("q"), dims)
            for name, sign in (("was", -1), ("owner", 1)):
                of = b.column(name).to_numpy()
                for c in np.unique(of[of != NO_OWNER]).tolist():
                    rows = x[of == c]
                    sums[c] = sums.get(c, 0) + sign * np.concatenate([[len(rows)], rows.sum(0)])
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tolist() for s in sums.values()], pa.list_(pa.int64()))], ["cluster", "amounts"])

    moved = state.where("was <> owner").select("q", "was", "owner").mapInArrow(work, "cluster int, amounts array<bigint>")
    return moved.select("cluster", F.posexplode("amounts").alias("part", "amount"))


def _means(sums: dict[int, list[int]], before: list[list[int]]) -> list[list[int]]:
    return [[s // sums[i][0] for s in sums[i][1:]] if sums.get(i, [0])[0] else old for i, old in enumerate(before)]


def first_centroids(vectors: DataFrame, k: int, seed: str) -> list[list[int]]:
    """The vectors with the smallest hashes of seed and id, in that order; at most ``k``."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [r.q for r in vectors.select(key.alias("h"), "q").orderBy(F.asc_nulls_last("h"), "q").limit(k).collect()]


def cluster(vectors: DataFrame, k: int = 40, dims: int = 64, rounds: int = 5, seed: str = "2") -> DataFrame:
    """vec_id, q, cluster, distance, cluster_inertia, inertia, centroid of every vector after
    ``rounds`` rounds and a last assignment.

    The driver holds k centroids and sums, which the parameters bound; all else stays in tables."""
    spark, paths = vectors.sparkSession, []

    def keep(df: DataFrame, name: str) -> DataFrame:
        paths.append(scratch_path(spark, name))
        df.write.parquet(paths[-1])
        return spark.read.schema(df.schema).parquet(paths[-1])

    state = keep(rounded(vectors, dims), "vectors").withColumns({"owner": F.lit(NO_OWNER), "distance": F.lit(0).cast("bigint")})
    centroids = first_centroids(state, k, seed)
    changed = [True] * len(centroids)
    sums = None
    for number in range(rounds + 1):
        old, paths = paths, []
        state = keep(_assign(state, centroids, changed, dims), "assignments")
        if number < rounds:
            flow = transfers(state, dims)
            flow = flow if sums is None else flow.unionByName(sums)
            sums = keep(flow.groupBy("cluster", "part").agg(F.sum("amount").alias("amount")), "sums")
            found: dict[int, list[int]] = {}
            for r in sums.collect():  # k times dims + 1 numbers
                found.setdefault(r.cluster, [0] * (dims + 1))[r.part] = r.amount
            new = _means(found, centroids)
            changed, centroids = [a != b for a, b in zip(new, centroids)], new
        for path in old:
            drop_path(spark, path)
        if number < rounds and not any(changed):
            break  # nothing would change any more
    per = state.groupBy("owner").agg(F.sum("distance").alias("cluster_inertia"))
    total = per.agg(F.sum("cluster_inertia").alias("inertia"))
    places = spark.createDataFrame(list(enumerate(centroids)), "owner int, centroid array<int>")
    extra = F.broadcast(per.join(F.broadcast(places), "owner").crossJoin(F.broadcast(total)))  # k rows, and one
    return state.join(extra, "owner").select("vec_id", "q", F.col("owner").alias("cluster"), "distance", "cluster_inertia", "inertia", "centroid")


def oracle_sql(k: int = 40, dims: int = 64, rounds: int = 5, seed: str = "2") -> str:
    """The same by full rounds over all vectors and centroids."""
    sql = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
  WHERE len(embedding) = {dims} AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = {dims}),
p AS MATERIALIZED (SELECT r, unnest(range({dims})) AS i, unnest(q) AS v FROM kept),
f AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, q) - 1 AS c, q FROM kept QUALIFY c < {k}),
c0 AS MATERIALIZED (SELECT c, unnest(range({dims})) AS i, unnest(q) AS v FROM f)"""
    for n in range(rounds + 1):
        sql += f""",
d{n} AS (SELECT r, c, CAST(sum((p.v - c{n}.v) * (p.v - c{n}.v)) AS BIGINT) AS d FROM p JOIN c{n} USING (i) GROUP BY r, c),
a{n} AS MATERIALIZED (SELECT r, c, d FROM d{n} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)"""
        if n < rounds:
            sql += f""",
s{n} AS (SELECT c, i, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM p JOIN a{n} USING (r) GROUP BY c, i),
c{n + 1} AS MATERIALIZED (SELECT c, i, CASE WHEN n IS NULL THEN v ELSE (s - ((s % n) + n) % n) // n END AS v FROM c{n} LEFT JOIN s{n} USING (c, i))"""
    return sql + f""",
h AS (SELECT c, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN h USING (c)
"""
