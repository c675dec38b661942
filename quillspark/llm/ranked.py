"""Ranked lexical search with variable blocks and block-skipping (WAND).

``build_index`` writes postings by shard and term: each task makes shards of the documents that it
reads, of a bounded number of postings, so no text travels. A second pass, when the corpus counts
are known, turns frequencies into scores without the term's weight and cuts every posting list into
blocks by dynamic programming: the cuts minimise the slack between the postings and their block's
maximum, at a price for each block. ``search`` sends the postings of the queries' terms to their
shards. There a first worst score comes from the documents of the heaviest lists; lists that cannot
reach it together are never walked. The pivot test is made for all documents of the other lists at
once: their own scores, and the maxima of the light lists' blocks that reach over the document. Those
that pass are looked up in the light lists by falling bound, and the search ends when no bound reaches
the worst score kept, so the result is exact. The best of all shards are ranked by item.

Scores are integers (see ``impacts`` and ``weights``). Defined cases: null and empty texts hold no
term and count nowhere; texts of any length are read whole; rows that repeat a doc_id are documents
of their own, rows that repeat an item_id items of their own; equal scores go by ascending doc_id,
null last; items without a known term, and empty tables, give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_path, scratch_path

#: Postings after which a task closes its shard (a document is never divided).
SHARD_POSTINGS = 2_000_000
#: Longest block, and the stretch of a list that is cut by itself.
MAX_BLOCK, SEGMENT = 64, 512
#: What a block costs, in units of slack.
BLOCK_COST = 1_000_000
#: Items that one pass over the index answers; their terms are held by every task.
ITEM_BLOCK = 2_000
#: Bytes of a text that are split at once.
PIECE = 1 << 20

_SEPARATORS = [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
_FOLD = bytes(32 if i in _SEPARATORS else i + 32 if 65 <= i <= 90 else i for i in range(256))
INDEX_SCHEMA = "shard bigint, term string, docs binary, impacts binary, ends binary, tops binary, ids array<bigint>"
_RAW_SCHEMA = "shard bigint, term string, docs binary, tfs binary, lengths binary, ids array<bigint>, n_docs bigint, n_terms bigint"


def term_counts(text: bytes) -> Counter:
    """How often each term occurs in a text (UTF-8): runs of letters, digits and other characters
    beyond ASCII, with A-Z in lower case. No byte of such a character is below 128."""
    folded, found, at = text.translate(_FOLD), Counter(), 0
    while at < len(folded):
        end = folded.find(b" ", at + PIECE)
        end = len(folded) if end < 0 else end
        found.update(folded[at:end].split())
        at = end
    return found


def _binary(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Row i holds the bytes of values[offsets[i]:offsets[i + 1]]."""
    at = (offsets * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(values.tobytes())])


def _flat(rows: pa.Array | pa.ChunkedArray, of: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in a column of binary values, end to end, and where each row begins."""
    rows = rows.combine_chunks() if isinstance(rows, pa.ChunkedArray) else rows
    if isinstance(rows, pa.ChunkedArray):
        rows = pa.concat_arrays(rows.chunks) if rows.num_chunks else pa.array([], pa.binary())
    if not len(rows):
        return np.zeros(0, of), np.zeros(1, np.int64)
    rows = rows.cast(pa.binary())
    at = np.frombuffer(rows.buffers()[1], np.int32, len(rows) + 1, 4 * rows.offset).astype(np.int64)
    size = np.dtype(of).itemsize
    data = np.frombuffer(rows.buffers()[2], of, (at[-1] - at[0]) // size, at[0]) if at[-1] > at[0] else np.zeros(0, of)
    return data, (at - at[0]) // size


def _shards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = count(TaskContext.get().partitionId() << 32)

    def close(vocabulary, ids, lengths, terms, tfs, sizes):
        term, tf = np.concatenate(terms), np.concatenate(tfs)
        doc = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
        order = np.argsort(term, kind="stable")
        offsets = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(vocabulary)))])
        n, shard = len(vocabulary), next(number)
        names = pa.array(list(vocabulary), pa.binary()).cast(pa.string())
        none, long = pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.int64())
        own = np.array(lengths, np.int32)[doc[order]]
        full = [pa.array(np.full(n, shard)), names, _binary(doc[order], offsets), _binary(tf[order], offsets), _binary(own, offsets), none, long, long]
        head = [pa.array([shard]), pa.nulls(1, pa.string()), *[pa.nulls(1, pa.binary())] * 3, pa.array([ids], pa.list_(pa.int64())), pa.array([len(ids)]), pa.array([sum(lengths)])]
        columns = ["shard", "term", "docs", "tfs", "lengths", "ids", "n_docs", "n_terms"]
        yield pa.RecordBatch.from_arrays(head, columns)
        whole = pa.RecordBatch.from_arrays(full, columns)
        for at in range(0, n, 20_000):
            yield whole.slice(at, 20_000)

    def fresh():
        return defaultdict(count().__next__), [], [], [], [], []

    state, held = fresh(), 0
    for b in batches:
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
            found = term_counts(text.as_buffer().to_pybytes()) if text.is_valid else None
            if not found:
                continue
            vocabulary, ids, lengths, terms, tfs, sizes = state
            ids.append(doc_id)
            lengths.append(found.total())
            terms.append(np.fromiter(map(vocabulary.__getitem__, found), np.int32, len(found)))
            tfs.append(np.fromiter(found.values(), np.int32, len(found)))
            sizes.append(len(found))
            held += len(found)
            if held >= SHARD_POSTINGS:
                yield from close(*state)
                state, held = fresh(), 0
    if held:
        yield from close(*state)


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, tokens: int) -> np.ndarray:
    """Scores without the weight: frequency, damped by itself and by the document's length."""
    tf, m = tf.astype(np.int64), 75 + (25 * n.astype(np.int64) * documents) // tokens
    return ((1_000_000_000 * tf) // (1000 * tf + 12 * m)).astype(np.int32)


def weights(df: dict[str, int], documents: int) -> dict[str, int]:
    return {t: math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for t, n in df.items()}


def _cut_group(x: np.ndarray, lengths: np.ndarray, cost: float) -> tuple[np.ndarray, np.ndarray]:
    """(segment, end) of the best blocks of the rows of ``x``, each up to its length."""
    s, n = x.shape
    width = min(MAX_BLOCK, n)
    x = np.ascontiguousarray(x.T)
    before = np.concatenate([np.zeros((1, s)), np.cumsum(x, 0)])
    best, back = np.zeros((n + 1, s)), np.zeros((n + 1, s), np.int32)
    base, top, start = np.full((width, s), np.inf), np.zeros((width, s)), np.zeros(width, np.int64)
    columns = np.arange(s)
    for j in range(1, n + 1):
        slot = (j - 1) % width
        base[slot], top[slot], start[slot] = best[j - 1] + before[j - 1], 0, j - 1
        np.maximum(top, x[j - 1], out=top)
        total = top * (j - start)[:, None]
        total += base
        at = total.argmin(0)
        best[j] = total[at, columns] - before[j] + cost
        back[j] = start[at]
    segments, ends, rows, at = [], [], columns, lengths.copy()
    while len(rows):
        segments.append(rows)
        ends.append(at)
        at = back[at, rows]
        rows, at = rows[at > 0], at[at > 0]
    return np.concatenate(segments), np.concatenate(ends)


def block_ends(score: np.ndarray, offsets: np.ndarray, cost: float = BLOCK_COST) -> np.ndarray:
    """Where blocks end, as places in ``score``, whose lists begin at ``offsets``: the blocks of at
    most MAX_BLOCK postings with the least sum of slack and prices, within each stretch of SEGMENT."""
    sizes = np.diff(offsets)
    parts = -(-sizes // SEGMENT)
    owner = np.repeat(np.arange(len(sizes)), parts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = offsets[:-1][owner] + nth * SEGMENT
    length = np.minimum(offsets[1:][owner] - begin, SEGMENT)
    found = [begin[length == 1] + 1]
    for low in (2 ** np.arange(0, SEGMENT.bit_length())).tolist():
        group = np.flatnonzero((length > low) & (length <= 2 * low))
        for at in range(0, len(group), step := max(64, 65_536 // (2 * low))):
            g = group[at : at + step]
            place = begin[g][:, None] + np.minimum(np.arange(length[g].max()), length[g][:, None] - 1)
            segment, end = _cut_group(score[place].astype(float), length[g], cost)
            found.append(begin[g][segment] + end)
    return np.sort(np.concatenate(found))


def _blocks(documents: int, tokens: int):
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            (tf, offsets), (n, _) = _flat(b.column("tfs"), "<i4"), _flat(b.column("lengths"), "<i4")
            score = impacts(tf, n, documents, tokens)
            ends = block_ends(score, offsets)
            starts = np.concatenate([[0], ends[:-1]])[: len(ends)]
            tops = np.maximum.reduceat(score, starts) if len(ends) else np.zeros(0, np.int32)
            at = np.searchsorted(ends, offsets, side="right")
            owner = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
            local = (ends - offsets[:-1][owner]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("shard"), b.column("term"), b.column("docs"), _binary(score, offsets), _binary(local, at), _binary(tops, at), b.column("ids")], ["shard", "term", "docs", "impacts", "ends", "tops", "ids"])

    return work


class Index:
    """A written index: its path, and the corpus counts that its scores rest on."""

    def __init__(self, spark: SparkSession, path: str, documents: int, tokens: int):
        self.path, self.documents, self.tokens = path, documents, tokens
        self.rows = spark.read.schema(INDEX_SCHEMA).parquet(path)


def build_index(docs: DataFrame, path: str) -> Index:
    """Write the index of all documents (doc_id, text) to ``path``."""
    spark, first = docs.sparkSession, scratch_path(docs.sparkSession, "postings")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows.mapInArrow(_shards, _RAW_SCHEMA).write.parquet(first)
    raw = spark.read.schema(_RAW_SCHEMA).parquet(first)
    n = raw.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("documents"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("tokens")).first()
    raw.mapInArrow(_blocks(n.documents, n.tokens), INDEX_SCHEMA).write.parquet(path)
    drop_path(spark, first)
    return Index(spark, path, n.documents, n.tokens)


def _added(total: np.ndarray, docs: np.ndarray, query: list[tuple[int, int]], lists: dict) -> int:
    """Add the scores that the query's lists give to ``docs`` (ascending); how many were looked up."""
    for i, w in query:
        a, b = lists["list"][i], lists["list"][i + 1]
        own = lists["docs"][a:b]
        at = np.minimum(np.searchsorted(own, docs), len(own) - 1)
        hit = own[at] == docs
        total[hit] += w * lists["impacts"][a:b][at[hit]]
    return len(docs) * len(query)


def _reach(query: list[tuple[int, int]], lists: dict, docs: np.ndarray) -> np.ndarray:
    """For each document the sum of the maxima of the blocks that reach over it, by a sweep over all
    block borders of the query's lists."""
    if not query:
        return np.zeros(len(docs), np.int64)
    b = np.concatenate([np.arange(lists["block"][i], lists["block"][i + 1]) for i, _ in query])
    bound = np.repeat([w for _, w in query], [lists["block"][i + 1] - lists["block"][i] for i, _ in query]) * lists["top"][b]
    border, place = np.unique(np.concatenate([lists["first"][b], lists["last"][b] + 1]), return_inverse=True)
    step = np.zeros(len(border) + 1, np.int64)
    np.add.at(step, place + 1, np.concatenate([bound, -bound]))
    return np.cumsum(step)[np.searchsorted(border, docs, side="right")]


def best_of_shard(query: list[tuple[int, int]], lists: dict, most: int, ids: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(documents, scores) of a shard's best for a query of (list, weight), and how many postings
    were read. ``lists`` holds the postings of all lists end to end, and their blocks."""
    query = sorted(query, key=lambda q: -q[1] * lists["max"][q[0]])
    rest = np.cumsum([0, *(w * lists["max"][i] for i, w in reversed(query))])[::-1]  # what the lists from j on can give at most

    def members(lead):
        return np.concatenate([lists["docs"][lists["list"][i] : lists["list"][i + 1]] for i, _ in lead])

    # a first worst score, from the documents of the lists that can give most
    worst, read, j, seeds = 1, 0, 0, np.zeros(0, np.int64)
    while j < len(query) and len(seeds) < most:
        seeds = np.union1d(seeds, members(query[j : j + 1]))
        j += 1
    if len(seeds) >= most:
        total = np.zeros(len(seeds), np.int64)
        read += _added(total, seeds, query, lists)
        worst = max(1, int(np.partition(total, -most)[-most]))
    # no document outside the leading lists can reach it: the others are looked up for theirs only
    lead = max(1, int(np.argmax(rest < worst)))
    docs, place = np.unique(members(query[:lead]), return_inverse=True)
    total = np.zeros(len(docs), np.int64)
    np.add.at(total, place, np.concatenate([w * lists["impacts"][lists["list"][i] : lists["list"][i + 1]] for i, w in query[:lead]]))
    read += len(place)
    upper = total + _reach(query[lead:], lists, docs)
    order = np.flatnonzero(upper >= worst)
    order = order[np.argsort(-upper[order], kind="stable")]
    found, scores, at, size = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, max(4 * most, 64)
    while at < len(order) and upper[order[at]] >= worst:
        now = np.sort(order[at : at + size])
        now = now[upper[now] >= worst]
        own = total[now]
        read += _added(own, docs[now], query[lead:], lists)
        found, scores = np.concatenate([found, docs[now]]), np.concatenate([scores, own])
        best = np.lexsort((ids[found], ~known[found], -scores))[:most]
        found, scores = found[best], scores[best]
        worst = max(worst, int(scores[-1])) if len(found) == most else worst
        at, size = at + size, 2 * size
    return found[scores > 0], scores[scores > 0], read


def _search_shard(queries, most: int):
    """queries: broadcast list of (item number, {term: weight times repeats})."""

    def work(table: pa.Table) -> pa.Table:
        head = table.filter(table.column("ids").is_valid())
        rows = table.filter(table.column("term").is_valid())
        given = head.column("ids").combine_chunks().flatten() if head.num_rows else pa.array([], pa.int64())
        given = given.combine_chunks() if isinstance(given, pa.ChunkedArray) else given
        known, ids = ~np.asarray(given.is_null()), np.asarray(given.fill_null(0), dtype=np.int64)
        place = {t: i for i, t in enumerate(rows.column("term").to_pylist())}
        (docs, offsets), (score, _) = _flat(rows.column("docs"), "<i4"), _flat(rows.column("impacts"), "<i4")
        (ends, blocks), (tops, _) = _flat(rows.column("ends"), "<i4"), _flat(rows.column("tops"), "<i4")
        ends = ends + np.repeat(offsets[:-1], np.diff(blocks))
        starts = np.concatenate([[0], ends[:-1]])[: len(ends)].astype(np.int64)
        tops = tops.astype(np.int64)
        lists = {"list": offsets, "docs": docs.astype(np.int64), "impacts": score.astype(np.int64), "block": blocks, "top": tops, "first": docs[starts].astype(np.int64), "last": docs[ends - 1].astype(np.int64), "max": np.maximum.reduceat(tops, blocks[:-1]) if len(tops) else tops}
        items, found, scores = [], [], []
        for item, query in queries.value:
            own = [(place[t], w) for t, w in query.items() if w > 0 and t in place]
            if own:
                d, s, _ = best_of_shard(own, lists, most, ids, known)
                items.append(np.full(len(d), item))
                found.append(d)
                scores.append(s)
        d = np.concatenate(found) if found else np.zeros(0, np.int64)
        doc_ids = pa.array(ids[d], pa.int64(), mask=~known[d])
        return pa.table({"item": pa.array(np.concatenate(items) if items else d, pa.int64()), "doc_id": doc_ids, "score": pa.array(np.concatenate(scores) if scores else d, pa.int64())})

    return work


def search(index: Index, items: DataFrame, most: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the best ``most`` documents of every item (item_id, text).

    Items are answered in blocks of about ITEM_BLOCK; only a block's texts and terms reach the
    driver and the tasks."""
    spark = items.sparkSession
    given = items.select("item_id", F.col("text").cast("string").alias("text"))
    parts, out = max(1, -(-given.count() // ITEM_BLOCK)), []
    for part in range(parts):
        of = given if parts == 1 else given.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        rows = [(r.item_id, {t.decode(): n for t, n in term_counts((r.text or "").encode()).items()}) for r in of.collect()]
        terms = spark.createDataFrame([(t,) for t in sorted({t for _, q in rows for t in q})], "term string")
        wanted = index.rows.join(F.broadcast(terms), "term", "left_semi")  # the terms of one block of items
        df = {r.term: r.df for r in wanted.groupBy("term").agg(F.sum(F.length("docs") / 4).cast("bigint").alias("df")).collect()}
        w = weights(df, index.documents)
        queries = spark.sparkContext.broadcast([(i, {t: n * w[t] for t, n in q.items() if t in w}) for i, (_, q) in enumerate(rows)])
        both = wanted.select(index.rows.columns).unionByName(index.rows.where("term IS NULL"))
        best = both.groupBy("shard").applyInArrow(_search_shard(queries, most), "item bigint, doc_id bigint, score bigint")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
        names = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], f"item bigint, item_id {dict(given.dtypes)['item_id']}")
        out.append(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))  # one block of items
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def oracle_sql(most: int = 20) -> str:
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    terms = rf"unnest(regexp_extract_all(translate(text, '{letters}', '{letters.lower()}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
t AS (SELECT r, doc_id, {terms} AS term FROM d),
tf AS MATERIALIZED (SELECT r, doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
n AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY r),
c AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM n),
w AS (SELECT term, CAST(floor(1000 * ln((2.0 * nn + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, c GROUP BY term, nn),
b AS (SELECT row_number() OVER () AS item, item_id, text FROM benchmark),
q AS (SELECT item, item_id, term, count(*) AS k FROM (SELECT item, item_id, {terms} AS term FROM b) GROUP BY ALL),
s AS (SELECT item, item_id, r, doc_id, CAST(sum(k * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll)))) AS BIGINT) AS score
      FROM q JOIN w USING (term) JOIN tf USING (term) JOIN n USING (r), c GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= {most}
"""
