"""Exact similarity join of vectors with pruning by the triangle inequality on angles."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAIRS = "a bigint, b bigint, similarity double"
#: Pivots at most; each task holds them.
MOST_PIVOTS = 2048
#: Added to every bound, for rounding.
EPSILON = 1e-7
#: Components of the rows of a region, at most.
MOST_NUMBERS = 1 << 22
#: Rows that are routed, or whose cells are looked up, at once.
ROWS = 2048
#: Similarities that are held at once, and pairs that are sent at once, about.
BLOCK, MOST_PAIRS = 1 << 22, 1 << 19


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), float).reshape(len(column), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def pivots(rows: DataFrame, n: int, cell: int, sample: int) -> np.ndarray:
    """About one pivot for ``cell`` rows: each next one is the row of a bounded sample (the smallest
    hashes of ids) that is farthest from those before."""
    few = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()
    x = _unit(np.array([r.v for r in few]))
    k = max(1, min(len(x), MOST_PIVOTS, math.ceil(n / cell)))
    chosen, nearest = [0], _angles(x, x[:1])[:, 0]
    while len(chosen) < k:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, _angles(x, x[chosen[-1:]])[:, 0])
    return x[chosen]


def assigned(rows: DataFrame, p: np.ndarray) -> DataFrame:
    """id, v as it was, cell (number of the nearest pivot) and angle to it."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                angle = _angles(_unit(_matrix(pdf["v"])), p)
                own = angle.argmin(1)
                yield pdf.assign(cell=own.astype(np.int32), angle=angle[np.arange(len(own)), own])

    return rows.select("id", "v").mapInPandas(work, "id bigint, v array<double>, cell int, angle double")


def targets(unit: np.ndarray, own: np.ndarray, p: np.ndarray, radius: np.ndarray, limit: float) -> np.ndarray:
    """Which cells of higher number may hold partners of each row, as a table of rows and cells.

    A partner y within ``limit`` of x lies in cell j, so angle(x, pivot j) <= limit + angle(y, pivot j)
    <= limit + radius j; and since y is nearer to pivot j than to x's own pivot, angle(x, pivot j) -
    angle(x, own pivot) <= 2 limit."""
    angle = _angles(unit, p)
    near = angle[np.arange(len(own)), own][:, None]
    reach = (angle <= limit + radius[None, :] + EPSILON) & (angle - near <= 2 * limit + EPSILON)
    return reach & (np.arange(len(p))[None, :] > own[:, None])


def regions(size: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(first region, number of regions) of every cell: neighbouring cells share a region up to ``most``
    rows; a larger cell has several to itself, over which its rows are dealt."""
    first, parts, region, held = np.zeros(len(size), np.int64), np.ones(len(size), np.int64), 0, 0
    for c, n in enumerate(size.tolist()):
        parts[c] = max(1, -(-n // most))
        if held and (parts[c] > 1 or held + n > most):
            region, held = region + 1, 0
        first[c] = region
        region, held = (region + int(parts[c]), 0) if parts[c] > 1 else (region, held + n)
    return first, parts


def _home(ids: np.ndarray, cell: np.ndarray, first: np.ndarray, parts: np.ndarray) -> np.ndarray:
    mark = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
    return first[cell] + (mark % parts[cell].astype(np.uint64)).astype(np.int64)


def routed(cells: DataFrame, p: np.ndarray, radius: np.ndarray, first: np.ndarray, parts: np.ndarray, limit: float, visits: np.ndarray | None = None) -> DataFrame:
    """One row for each task (x, y) in which a row is compared: x, y, guest, cell, id, u (its unit
    vector's doubles). Task (r, r) holds region r; in (x, y) guests from x meet the rows of y. Without
    ``visits`` only the number of guests: x, y, n. A batch goes out in pieces, however many its copies."""
    n = int((first + parts).max())
    starts = np.unique(first, return_index=True)[1]  # first cells of those that share a region
    lead = np.repeat(np.arange(len(starts)), parts[starts])  # whose cells a region has

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((n, n), np.int64)
        for pdf in batches:
            for lo in range(0, len(pdf), ROWS):
                some = pdf[lo : lo + ROWS]
                own, ids, unit = some["cell"].to_numpy(), some["id"].to_numpy(), _unit(_matrix(some["v"]))
                home = _home(ids, own, first, parts)
                goes = np.logical_or.reduceat(targets(unit, own, p, radius, limit), starts, axis=1)[:, lead]
                at = np.arange(n)[None, :]
                goes = (goes | (at < (first + parts)[own][:, None])) & (at > home[:, None])  # also to the later parts of its own cell
                if visits is None:
                    np.add.at(total, home, goes)
                    continue
                data = [u.tobytes() for u in unit]
                rows, x, y, guest, held = [], [], [], [], 0
                for r in range(n):
                    for mine, guests in ((home == r, False), ((visits[r] > 0)[home] & (home != r), False), (goes[:, r], True)):
                        k = np.flatnonzero(mine)
                        if len(k):
                            rows.append(k)
                            x.append(home[k] if guests else np.full(len(k), r))
                            y.append(np.full(len(k), r) if guests else home[k])
                            guest.append(np.full(len(k), guests))
                            held += len(k)
                    if held >= ROWS or held and r == n - 1:
                        k = np.concatenate(rows)
                        yield pd.DataFrame({"x": np.concatenate(x).astype(np.int32), "y": np.concatenate(y).astype(np.int32), "guest": np.concatenate(guest), "cell": own[k], "id": ids[k], "u": [data[i] for i in k]})
                        rows, x, y, guest, held = [], [], [], [], 0
        if visits is None:
            x, y = np.nonzero(total)
            yield pd.DataFrame({"x": x.astype(np.int32), "y": y.astype(np.int32), "n": total[x, y]})

    return cells.mapInPandas(work, "x int, y int, n bigint" if visits is None else "x int, y int, guest boolean, cell int, id bigint, u binary")


def _matches(unit: np.ndarray, single: np.ndarray, ids: np.ndarray, x: np.ndarray, y: np.ndarray, least: float, once: bool) -> Iterator[tuple]:
    """a, b, similarity of rows x with rows y, by blocks: single precision finds candidates, with room
    for its rounding, and double precision decides."""
    room = (unit.shape[1] + 8) * 2.0**-23
    step = max(1, BLOCK // max(1, len(y)))
    for lo in range(0, len(x), step):
        own = x[lo : lo + step]
        near = single[own] @ single[y].T >= least - room
        n = np.count_nonzero(near)
        if not n:
            continue
        if n * 64 > near.size:  # many: all of the block
            sim = unit[own] @ unit[y].T
            a, b = np.nonzero(sim >= least)
            s, a, b = sim[a, b], own[a], y[b]
        else:
            a, b = np.nonzero(near)
            a, b = own[a], y[b]
            s = np.einsum("ij,ij->i", unit[a], unit[b])
        keep = s >= least
        if once:
            keep &= ids[a] < ids[b]
        a, b = ids[a[keep]], ids[b[keep]]
        yield np.minimum(a, b), np.maximum(a, b), s[keep]


def _compared(x: int, y: int, pdf: pd.DataFrame, p: np.ndarray, radius: np.ndarray, limit: float, least: float) -> Iterator[tuple]:
    """The pairs of a task."""
    pdf = pdf.sort_values("cell", kind="stable")
    cell, ids, guest = pdf["cell"].to_numpy(), pdf["id"].to_numpy(), pdf["guest"].to_numpy(bool)
    unit = np.frombuffer(b"".join(pdf["u"]), float).reshape(len(pdf), -1)
    single = unit.astype(np.float32)
    own = np.flatnonzero(~guest)
    places = {int(c): own[lo:hi] for c, lo, hi in zip(*_spans(cell[own]))}
    if x == y:
        for k in places.values():
            yield from _matches(unit, single, ids, k, k, least, True)
    come = own if x == y else np.flatnonzero(guest)
    for lo in range(0, len(come), ROWS):
        some = come[lo : lo + ROWS]
        goes = targets(unit[some], cell[some], p, radius, limit)
        if x != y:
            goes[np.arange(len(some)), cell[some]] = True  # other parts of its own cell
        for c, k in places.items():
            yield from _matches(unit, single, ids, some[goes[:, c]], k, least, False)


def _spans(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, start, end) of the runs."""
    values, starts = np.unique(sorted_, return_index=True)
    return values, starts, np.append(starts[1:], len(sorted_))


def join_cells(rows: DataFrame, least: float, n: int, cell: int = 2048, sample: int = 8192) -> DataFrame:
    """a, b, similarity of all pairs of rows (id, v; ids are unique) with cosine of at least ``least``.

    Cells are gathered in regions of at most MOST_NUMBERS components, and a task compares two regions'
    rows, so a row is copied to as many tasks as there are regions, not cells, with rows it may match."""
    limit = math.acos(max(-1.0, min(1.0, least)))
    p = pivots(rows, n, cell, sample)
    cells = assigned(rows, p).checkpoint()
    radius, size = np.zeros(len(p)), np.zeros(len(p), np.int64)
    for r in cells.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect():  # one row a pivot
        radius[r.cell], size[r.cell] = r.radius, r.n
    few = math.ceil(math.sqrt(8 * rows.sparkSession.sparkContext.defaultParallelism))  # regions whose tasks keep all cores busy
    first, parts = regions(size, max(1, min(MOST_NUMBERS // p.shape[1], max(cell, -(-n // few)))))
    visits = np.zeros((int((first + parts).max()),) * 2, np.int64)
    for r in routed(cells, p, radius, first, parts, limit).groupBy("x", "y").agg(F.sum("n").alias("n")).collect():  # one row a pair of regions
        visits[r.x, r.y] = r.n
    tasks = len(visits) + int(np.count_nonzero(visits))
    meets = routed(cells, p, radius, first, parts, limit, visits).repartition(tasks, "x", "y").sortWithinPartitions("x", "y")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for key, pdf in _tasks(batches):
            found, held = [], 0
            for pairs in _compared(*key, pdf, p, radius, limit, least):
                found.append(pairs)
                held += len(pairs[0])
                if held >= MOST_PAIRS:
                    yield _frame(found)
                    found, held = [], 0
            if held:
                yield _frame(found)

    return meets.mapInPandas(work, PAIRS)


def _frame(found: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(dict(zip(("a", "b", "similarity"), map(np.concatenate, zip(*found)))))


def _tasks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple[int, int], pd.DataFrame]]:
    """The rows of each task, which come together."""
    held, key = [], None
    for pdf in batches:
        for own, some in pdf.groupby(["x", "y"], sort=True):
            if held and own != key:
                yield key, pd.concat(held, ignore_index=True)
                held = []
            key = own
            held.append(some)
    if held:
        yield key, pd.concat(held, ignore_index=True)
