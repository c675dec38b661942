"""Near-duplicate vectors by collision counting over one-dimensional projections.

Vectors are turned by random rotations, so that each coordinate is a projection on a random
direction. For two vectors with cosine t the coordinates differ by a deviation that only depends on
t, which calibrates all of the following at the least cosine to be linked:

- tables: the coordinates of a few projections, each in order, are cut at their medians, which gives
  cells of even sizes wherever the vectors lie. A vector lies in one cell of a table; as a query it
  visits every cell that its window around each coordinate touches;
- collisions: the vectors of a cell are sorted along each of the counted projections. A query's
  window is a run of places in every such order; the orders are counted in which a vector's place
  lies in the run, and pairs that reach the calibrated count go on;
- verification: their cosine is computed in double precision.

The plan is fitted on SAMPLE vectors (drawn by hash) and a partner at exactly the least cosine for
each: medians, the number of tables that finds RECALL of these pairs (closer pairs are found more
surely), and the least count. If MAX_TABLES are not enough, it raises. All vectors are indexed and
all are queries.

Windows of one projection hold a fixed part of all vectors, so counting over whole orders would be
quadratic; cutting keeps cells at about CELL_VECTORS, for which a query visits 1 + P(window meets
the cut) cells more with every doubling: copies grow with a power of about 0.4 of the vectors, work
with one of 1.4. Cells with more vectors are split into blocks, to each of which the cell's queries go, so no
task holds more than a block. Vectors that are equal form a class and are compared once.

A pair may be met in several tables, and from both of its ends. It is counted at its first meeting
in a fixed order, which either end can tell, so only sums and a spanning star of each block's links
leave a task, never pairs.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite components, link
with nothing (n_links 0, their own component); vectors of different lengths do not link, so each
length has a plan of its own; repeated rows link with each other; a null vec_id has a null component unless it
reaches another; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sized_join, staged
from .components import components

LEAST_COSINE = 0.9
RECALL = 0.97
CELL_VECTORS = 4096
#: Vectors of each length on which a plan is fitted, and pairs that are drawn from them.
SAMPLE, PAIRS = 2048, 8192
#: Half-width of the windows at cuts and of the counted windows, in deviations of the difference of
#: two coordinates at the least cosine.
CUT_WINDOW, COUNT_WINDOW = 1.12, 1.8
#: Counted projections, and the part of true pairs whose count must pass.
COUNTED, COUNT_RECALL = 16, 0.995
MAX_TABLES = 24
QUERY_BATCH = 256
SEED = 20240229
LINKS = "num bigint, root bigint, n bigint"


class Plan:
    """Directions, cuts, tables and the least count for a number of vectors like those of a sample."""

    def __init__(self, sample: np.ndarray, vectors: int, least: float = LEAST_COSINE, recall: float = RECALL, cell: int = CELL_VECTORS, seed: int = SEED):
        self.dims, self.least = dims, least = sample.shape[1], least
        self.cuts = max(0, math.ceil(math.log2(max(1, vectors) / cell)))
        self.counted = min(COUNTED, dims)
        rng = np.random.default_rng(seed)
        turns = [np.linalg.qr(rng.standard_normal((dims, dims)))[0] for _ in range(-(-(self.counted + MAX_TABLES * self.cuts) // dims))]
        turned = np.concatenate(turns, axis=1)
        self.count_axes = turned[:, : self.counted]
        cut_axes = turned[:, self.counted : self.counted + MAX_TABLES * self.cuts].reshape(dims, MAX_TABLES, self.cuts)
        spread = math.sqrt(2 - 2 * least) / math.sqrt(dims)
        self.cut_window, self.count_window = CUT_WINDOW * spread, COUNT_WINDOW * spread

        x = np.resize(sample, (PAIRS, dims))
        aside = rng.standard_normal(x.shape)
        aside -= (aside * x).sum(1, keepdims=True) * x
        norm = np.linalg.norm(aside, axis=1, keepdims=True)
        aside = np.divide(aside, norm, out=np.zeros_like(aside), where=norm > 1e-9)
        y = least * x + math.sqrt(1 - least * least) * aside
        count = (np.abs((x - y) @ self.count_axes) <= self.count_window).sum(1)
        self.least_count = int(np.quantile(count, 1 - COUNT_RECALL))
        self.cut_axes, self.medians = cut_axes, np.median(np.tensordot(sample, cut_axes, 1), axis=0)
        x, y = self.coordinates(x), self.coordinates(y)
        met = self.met(x, y) | self.met(y, x)
        share = np.logical_or.accumulate(met, axis=1).mean(0)
        if share[-1] * COUNT_RECALL < recall:
            raise ValueError(f"{MAX_TABLES} tables find {share[-1]:.3f} of the pairs, {recall} are wanted")
        self.tables = int(np.argmax(share * COUNT_RECALL >= recall)) + 1
        self.cut_axes, self.medians = np.ascontiguousarray(cut_axes[:, : self.tables]), self.medians[: self.tables]

    def coordinates(self, unit: np.ndarray) -> np.ndarray:
        """By vector, table and cut: how far from the median."""
        return np.tensordot(unit, self.cut_axes, 1) - self.medians

    def met(self, query: np.ndarray, data: np.ndarray) -> np.ndarray:
        """By pair and table, whether the query's windows reach the cell of the data vector."""
        return (((query < 0) == (data < 0)) | (np.abs(query) <= self.cut_window)).all(2)


def _units(raw: list[bytes] | pa.Array, kind: str) -> np.ndarray:
    v = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _valid(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            out = []
            for value in got.column(1):
                v = None
                if value.is_valid and len(value.values) and not value.values.null_count:
                    v = np.asarray(value.values, kind) + 0.0  # no negative zeros
                    v = v.tobytes() if np.isfinite(v).all() and v.any() else None
                out.append(v)
            yield pa.RecordBatch.from_arrays([got.column(0), pa.array(out, pa.binary())], names=["vec_id", "vec"])

    return run


def _spread(plan: Plan, kind: str, queries: bool):
    """Rows of (table, cell, number, members, vector): one for each table, or for queries one for
    each cell that the windows touch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["tab", "cell", "num", "members", "vec"]
        weights = 1 << np.arange(plan.cuts, dtype=np.int64)
        for got in batches:
            if not got.num_rows:
                continue
            at = plan.coordinates(_units(got.column(2).to_pylist(), kind))
            for t in range(plan.tables):
                rows, cells = np.arange(got.num_rows), ((at[:, t] < 0) * weights).sum(1)
                if queries:
                    for c in range(plan.cuts):
                        near = np.abs(at[rows, t, c]) <= plan.cut_window
                        rows, cells = np.concatenate([rows, rows[near]]), np.concatenate([cells, cells[near] ^ weights[c]])
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), t, np.int32)), pa.array(cells.astype(np.int64)), *[got.column(k).take(take) for k in range(3)]], names=names)

    return run


class _Block:
    """The vectors of a block of a cell, against which queries are run."""

    def __init__(self, plan: Plan, num: np.ndarray, members: np.ndarray, unit: np.ndarray):
        self.plan, self.num, self.members, self.unit = plan, num, members, unit
        self.cuts = plan.coordinates(unit)
        axes = (unit @ plan.count_axes).T
        order = np.argsort(axes, axis=1)
        self.sorted = np.take_along_axis(axes, order, 1)
        self.places = np.empty(axes.shape, np.uint16 if len(num) < 1 << 16 else np.uint32)
        np.put_along_axis(self.places, order, np.broadcast_to(np.arange(len(num), dtype=self.places.dtype), order.shape), 1)

    def links(self, table: int, num: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, data) of the block that meet here first and reach the cosine."""
        plan, cuts = self.plan, self.plan.coordinates(unit)
        hits = np.zeros((len(num), len(self.num)), np.uint8)
        for axis, inorder, places in zip((unit @ plan.count_axes).T, self.sorted, self.places):
            lo = np.searchsorted(inorder, axis - plan.count_window).astype(places.dtype)
            hi = np.searchsorted(inorder, axis + plan.count_window, "right").astype(places.dtype)
            # unsigned: places before the run wrap around to large numbers
            hits += places[None, :] - lo[:, None] < (hi - lo)[:, None]
        q, d = np.nonzero((hits >= plan.least_count) & (num[:, None] != self.num[None, :]))
        keep = np.zeros(len(q), bool)
        for lo in range(0, len(q), 1 << 16):
            a, b = q[lo : lo + (1 << 16)], d[lo : lo + (1 << 16)]
            near = np.einsum("ij,ij->i", unit[a], self.unit[b]) >= plan.least
            a, b = a[near], b[near]
            forth, back = plan.met(cuts[a], self.cuts[b]), plan.met(self.cuts[b], cuts[a])
            before = (forth | back)[:, :table].any(1)
            before |= (num[a] > self.num[b]) & back[:, table]
            keep[np.flatnonzero(near)[~before] + lo] = True
        return q[keep], d[keep]


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from every linked number to the smallest number of its component."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    root = np.arange(len(nodes))
    while True:
        new = root.copy()
        np.minimum.at(new, x, root[y])
        np.minimum.at(new, y, root[x])
        new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def _compared(plan: Plan, kind: str):
    """Rows (num, root, n): with root null, n more links of a number; else an edge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, data, block = None, [], None

        def found(table: int, num: np.ndarray, members: np.ndarray, unit: np.ndarray) -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(num), QUERY_BATCH):
                some = slice(lo, lo + QUERY_BATCH)
                q, d = block.links(table, num[some], unit[some])
                if not len(q):
                    continue
                a, b = num[some][q], block.num[d]
                nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
                more = np.bincount(at, np.concatenate([block.members[d], members[some][q]]), len(nodes)).astype(np.int64)
                x, y = _stars(a, b)
                edge = x != y
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([nodes, x[edge]])), pa.array([None] * len(nodes) + y[edge].tolist(), pa.int64()), pa.array(np.concatenate([more, np.zeros(int(edge.sum()), np.int64)]))],
                    names=["num", "root", "n"],
                )

        for got in batches:  # sorted by table, cell, block; a block's vectors before its queries
            tab, cell, part, side = (got.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            ids = np.stack([tab, cell, part, side], 1).astype(np.int64)
            cuts = np.flatnonzero((np.diff(ids, axis=0) != 0).any(1)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)]):
                if hi == lo:
                    continue
                if key != tuple(ids[lo, :3]):
                    key, data, block = tuple(ids[lo, :3]), [], None
                num, members = (got.column(i).slice(lo, hi - lo).to_numpy(zero_copy_only=False) for i in (4, 5))
                unit = _units(got.column(6).slice(lo, hi - lo).to_pylist(), kind)
                if ids[lo, 3] == 0:
                    data.append((num, members, unit))
                elif data or block is not None:
                    if block is None:
                        block, data = _Block(plan, *map(np.concatenate, zip(*data))), []
                    yield from found(int(key[0]), num, members, unit)

    return run


def _links(classes: DataFrame, plan: Plan, kind: str, cell: int) -> DataFrame:
    """Rows of LINKS among classes of one length."""
    parts = classes.select("num", "members", "vec")
    schema = "tab int, cell bigint, num bigint, members bigint, vec binary"
    held = parts.mapInArrow(_spread(plan, kind, False), schema)
    asked = parts.mapInArrow(_spread(plan, kind, True), schema)
    blocks = staged(held.groupBy("tab", "cell").agg(F.ceil(F.count("*") / (1.5 * cell)).cast("int").alias("blocks")), "blocks")
    held = sized_join(held, blocks, ["tab", "cell"]).withColumn("part", F.pmod(F.xxhash64("num"), F.col("blocks")).cast("int")).withColumn("side", F.lit(0))
    asked = sized_join(asked, blocks, ["tab", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("side", F.lit(1))
    order = ["tab", "cell", "part", "side", "num", "members", "vec"]
    both = held.select(order).union(asked.select(order))
    n = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * plan.tables << min(plan.cuts, 12))
    both = both.repartition(n, "tab", "cell", "part").sortWithinPartitions("tab", "cell", "part", "side")
    return staged(both.mapInArrow(_compared(plan, kind), LINKS), "found")


def near_duplicates(vectors: DataFrame, least: float = LEAST_COSINE, recall: float = RECALL, cell: int = CELL_VECTORS, seed: int = SEED) -> DataFrame:
    """vec_id, n_links (other vectors linked directly) and component_id (smallest vec_id reachable)
    for every row. No pair below ``least`` is linked; of those above, ``recall`` or more is found."""
    spark = vectors.sparkSession
    types = dict(vectors.dtypes)
    kind = "<f4" if types["embedding"] == "array<float>" else "<f8"
    column = F.col("embedding") if kind == "<f4" else F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", column.alias("embedding")).mapInArrow(_valid(kind), f"vec_id {types['vec_id']}, vec binary")
    rows = staged(rows, "vectors")
    key = F.sha2("vec", 256).alias("class")
    classes = rows.select("vec_id", "vec", key).where("class IS NOT NULL").groupBy("class")
    classes = staged(classes.agg(F.min("vec_id").alias("least"), F.count("*").alias("members"), F.min("vec").alias("vec")).withColumn("num", F.monotonically_increasing_id()), "classes")

    found = spark.createDataFrame([], LINKS)
    # a length with a single class has no links but within it
    for size in classes.groupBy(F.octet_length("vec").alias("bytes")).count().where("count > 1").orderBy("bytes").collect():
        same = classes.where(F.octet_length("vec") == size["bytes"])
        sample = [bytes(r.vec) for r in same.orderBy(F.xxhash64("class")).limit(SAMPLE).select("vec").collect()]
        found = found.union(_links(same, Plan(_units(sample, kind), size["count"], least, recall, cell, seed), kind, cell))

    counts = staged(found.where("root IS NULL").groupBy("num").agg(F.sum("n").alias("n")), "counts")
    roots = staged(components(found.where("root IS NOT NULL").select(F.col("num").alias("a"), F.col("root").alias("b"))), "roots")
    named = sized_join(classes.select("class", "num", "least", "members"), roots.withColumnRenamed("node", "num"), ["num"], "left").withColumn("root", F.coalesce("root", "num"))
    named = staged(sized_join(named, counts, ["num"], "left"), "named")
    leasts = staged(named.groupBy("root").agg(F.min("least").alias("component_id")), "leasts")
    named = sized_join(named, leasts, ["root"]).select("class", (F.coalesce("n", F.lit(0)) + F.col("members") - 1).alias("n_links"), "component_id")
    named = staged(named, "classed")
    out = sized_join(rows.select("vec_id", key), named, ["class"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
