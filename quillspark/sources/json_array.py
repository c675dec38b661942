"""One huge JSON array read by many tasks.

A file is cut into byte ranges. A first pass reads every range on its own, for each state in which it
may begin (outside strings, within one, within one after a backslash), and tells in which it ends and
how far brackets open or close. Composed in order, these give every range its true state and depth.
A second pass then cuts the elements at depth one; an element belongs to the range in which the mark
before it lies, and is read on into the next ranges to its end.

Defined cases: an empty file, or an array of nothing, has no element; a byte order mark is ignored;
a file whose top value is no array raises; an array that is cut off gives its whole elements; bytes
that are no UTF-8 are replaced.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPLIT_BYTES = 64 << 20
#: Ranges for each core, about, before they are larger than asked for.
CORE_RANGES = 8
#: Bytes that are looked at at once.
BLOCK = 4 << 20
#: Bytes that are first looked at beyond a range.
REST = 32 << 10
#: Characters of elements after which a batch is sent.
BATCH_CHARS = 8 << 20
OUTSIDE, INSIDE, ESCAPED = 0, 1, 2
_CHANGE = np.isin(np.arange(256), [ord(c) for c in "{["]).astype(np.int64) - np.isin(np.arange(256), [ord(c) for c in "}]"])
_MARK = np.isin(np.arange(256), [ord(c) for c in '"\\{}[],'])


def _opened(path: str):
    """A file on any storage that Arrow knows."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file(re.sub(r"^file:/+", "/", path))
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def structure(block: np.ndarray, state: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(places of brackets and commas outside strings, change of depth at each, state after the block).
    Only the few bytes that may matter are looked at, not what lies between."""
    at = np.flatnonzero(_MARK[block])
    byte = block[at]
    slash = at[byte == 92]
    first = np.flatnonzero(np.diff(slash, prepend=-2) != 1)  # of runs of backslashes
    starts, run = slash[first], np.diff(np.append(first, len(slash)))
    if state == ESCAPED:  # one backslash came before the block
        if len(starts) and starts[0] == 0:
            run[0] += 1
        else:
            starts, run = np.append(0, starts), np.append(1, run)
    ends = starts + run - (starts == 0) * (state == ESCAPED)
    escaped = ends[run % 2 == 1]  # bytes after an odd run
    quotes = at[byte == 34]
    near = np.searchsorted(escaped, quotes)
    quotes = quotes[(escaped[np.minimum(near, len(escaped) - 1)] != quotes) if len(escaped) else slice(None)]
    odd = (len(quotes) + (state != OUTSIDE)) % 2
    end = OUTSIDE if not odd else ESCAPED if len(escaped) and escaped[-1] == len(block) else INSIDE
    mark = at[(byte != 34) & (byte != 92)]
    inside = (np.searchsorted(quotes, mark) + (state != OUTSIDE)) % 2 == 1
    mark = mark[~inside]
    return mark, _CHANGE[block[mark]], end


def _scan(ranges: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in ranges:
        out = []
        for path, start, end in zip(pdf["path"], pdf["start"], pdf["end"]):
            states, depths = [0, 1, 2], [0, 0, 0]
            with _opened(path) as f:
                for at in range(start, end, BLOCK):
                    block = np.frombuffer(f.read_at(min(BLOCK, end - at), at), np.uint8)
                    seen = {now: structure(block, now) for now in set(states)}  # ranges soon end alike
                    depths = [n + int(seen[now][1].sum()) for now, n in zip(states, depths)]
                    states = [seen[now][2] for now in states]
            out.append((path, start, end, states, depths))
        yield pd.DataFrame(out, columns=["path", "start", "end", "states", "depths"])


def plan(spark: SparkSession, files: list[tuple[str, int]], split_bytes: int = SPLIT_BYTES) -> list[list]:
    """Ranges [path, start, end, state, depth] of the files, in order; a few numbers for each range.

    Ranges below SPLIT_BYTES grow with the files, so that there are about CORE_RANGES for each core."""
    whole = sum(n for _, n in files)
    split_bytes = max(split_bytes, min(SPLIT_BYTES, whole // (CORE_RANGES * spark.sparkContext.defaultParallelism)))
    ranges = [(p, lo, min(lo + split_bytes, n)) for p, n in files for lo in range(0, n, split_bytes)]
    if not ranges:
        return []
    rows = spark.createDataFrame(ranges, "path string, start bigint, end bigint").repartition(min(len(ranges), 10_000), "path", "start")
    scanned = {(r.path, r.start): r for r in rows.mapInPandas(_scan, "path string, start bigint, end bigint, states array<int>, depths array<bigint>").collect()}
    out, state, depth = [], OUTSIDE, 0
    for path, start, end in ranges:
        if start == 0:
            state, depth = OUTSIDE, 0
        out.append([path, start, end, state, depth])
        got = scanned[path, start]
        state, depth = got.states[state], depth + got.depths[state]
    return out


def elements(path: str, start: int, end: int, state: int, depth: int) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of the elements whose mark lies in a range that begins in this state and depth."""
    with _opened(path) as f:
        size, at, held, mark, rest = f.size(), start, [], None, min(BLOCK, REST)
        if start == 0 and (head := f.read_at(min(size, 1 << 16), 0).removeprefix(b"\xef\xbb\xbf").lstrip()) and not head.startswith(b"["):
            raise ValueError(f"{path} holds no JSON array")
        while at < size and (at < end or mark is not None):
            if at < end:
                block = np.frombuffer(f.read_at(min(BLOCK, end - at), at), np.uint8)
            else:  # the last element's end
                block, rest = np.frombuffer(f.read_at(min(rest, size - at), at), np.uint8), min(BLOCK, 2 * rest)
            found, change, state = structure(block, state)
            level = np.cumsum(change) + depth
            comma, opens, closes = (block[found] == 44) & (level == 1), (block[found] == 91) & (level == 1), (change < 0) & (level == 0)
            raw, last = block.tobytes(), 0
            ends = set(found[closes].tolist())
            for p in found[comma | opens | closes].tolist():
                if mark is not None:
                    held.append(raw[last:p])
                    yield mark, b"".join(held)
                held, last = [], p + 1
                mark = None if p in ends or at >= end else at + p
                if mark is None and at >= end:
                    return
            if mark is not None:
                held.append(raw[last:])
            depth = int(level[-1]) if len(level) else depth
            at += len(block)


class _Range(InputPartition):
    def __init__(self, place: list):
        super().__init__(tuple(place))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.places = json.loads(options["plan"])

    def partitions(self) -> list[InputPartition]:
        return [_Range(p) for p in self.places]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        names = ["path", "position", "value"]

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([partition.value[0]] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(values, pa.string())], names)

        at, values, chars = [], [], 0
        for mark, raw in elements(*partition.value):
            value = raw.decode("utf-8", "replace").strip()
            if not value:
                continue
            at.append(mark)
            values.append(value)
            chars += len(value)
            if chars >= BATCH_CHARS:
                yield batch()
                at, values, chars = [], [], 0
        if at:
            yield batch()


class JsonArraySource(DataSource):
    """Elements of JSON arrays as text, by the ranges in the option ``plan``."""

    @classmethod
    def name(cls) -> str:
        return "json_array"

    def schema(self) -> str:
        return "path string, position bigint, value string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read(spark: SparkSession, files: list[tuple[str, int]], schema: str | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Elements of the arrays in files (path, bytes): path, position (byte offset of the mark before
    it; in order within a file) and value, or with ``schema`` the fields of the element (null where it
    does not parse). Fields that nothing uses are not parsed."""
    places = plan(spark, files, split_bytes)
    if not places:
        rows = spark.createDataFrame([], "path string, position bigint, value string")
    else:
        spark.dataSource.register(JsonArraySource)
        rows = spark.read.format("json_array").option("plan", json.dumps(places)).load()
    return rows if schema is None else rows.select("path", "position", F.from_json("value", schema).alias("e")).select("path", "position", "e.*")
