"""Connected components of a link table by alternating star contractions.

Large-star hangs every larger neighbour of a node on the node's smallest neighbour, small-star
does so with the smaller neighbours; repeated until nothing changes, every component is a star on
its smallest node. All state stays in tables in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, scratch_path, sized_join


def _state(df: DataFrame) -> tuple[int, int]:
    got = df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
    return got[0], int(got[1])


def _star(edges: DataFrame, large: bool, paths: list[str]) -> DataFrame:
    spark = edges.sparkSession

    def keep(df: DataFrame) -> DataFrame:
        paths.append(scratch_path(spark, "star"))
        df.write.parquet(paths[-1])
        return spark.read.schema(df.schema).parquet(paths[-1])

    sides = edges.union(edges.select("b", "a")) if large else edges.select(F.greatest("a", "b"), F.least("a", "b"))
    sides = sides.toDF("n", "o")
    least = keep(sides.groupBy("n").agg(F.least(F.min("o"), F.col("n")).alias("m")))
    joined = sized_join(sides, least, ["n"])
    if large:
        new = joined.where("o > n").select(F.col("o").alias("a"), F.col("m").alias("b"))
    else:
        new = joined.where("o <> m").select(F.col("o").alias("a"), F.col("m").alias("b")).union(least.select(F.col("n").alias("a"), F.col("m").alias("b")))
    return keep(new.where("a <> b").distinct())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root for every node that an edge (a, b) touches; root is the smallest reachable node.

    Loops and repeated edges are harmless; an empty table gives an empty result. The loop ends
    when a round leaves the edges as they were; it raises if that takes over ``max_rounds``.
    """
    spark = edges.sparkSession
    kind = dict(edges.dtypes)["a"]
    path = scratch_path(spark, "edges")
    edges.select("a", "b").where("a <> b").distinct().write.parquet(path)
    now = spark.read.schema(f"a {kind}, b {kind}").parquet(path)
    before, old = _state(now), [path]
    for _ in range(max_rounds):
        if not before[0]:
            break
        paths: list[str] = []
        now = _star(_star(now, True, paths), False, paths)
        after = _state(now)
        for p in [*old, *paths[:-1]]:
            drop_path(spark, p)
        old = paths[-1:]
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
