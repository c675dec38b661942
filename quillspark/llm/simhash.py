"""SimHash near-duplicate detection by anchor-point covering.

Fingerprints with at most 3 differing bits differ in at most one bit of one of their two halves.
Of each half, the first 31 bits are covered by the perfect Hamming code of length 31 (covering
radius 1): its code words are the anchors. A fingerprint is sent to every anchor within radius +
threshold = 2 of the half (16 anchors, or 1 if it is an anchor itself), so two linked
fingerprints meet at an anchor, where all 64 bits are compared.

Only different fingerprints are compared; rows with equal ones form a class before. At an anchor
the links' components are found without listing pairs, and only edges to a component's smallest
member leave the task. Anchors with more members than ``hot_anchor`` are split by anchors of the
other half's quarters (Hamming code of length 15), which again lose no link.

Defined cases: null and empty texts have fingerprint zero, linked like any other; repeated rows
are all returned, each with its class; a null doc_id is never a component's smallest one unless
the class has no other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sized_join, staged, tidied
from .components import components

SEED = 42
MAX_BITS = 3
#: Members of an anchor beyond which it is split further.
HOT_ANCHOR = 200_000
#: Shingles hashed at a time, and fingerprints compared with one at a time.
CHUNK = 1 << 16


#: 64-bit words of the wide fingerprint.
WIDE = 4


def _mixed(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes as rows of ``width`` words: the hash itself, then words mixed from it."""
    out = [h]
    for k in range(1, width):
        x = h + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        out.append(x ^ x >> np.uint64(31))
    return np.stack(out, 1)


def fingerprint(text: bytes, words: int = 3) -> int:
    """64-bit SimHash: a bit is set if it is in over half of the shingles' hashes, repeats included."""
    w = text.lower().split()
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    votes = np.zeros(64, np.int64)
    for lo in range(0, n, CHUNK):
        part = w[lo : min(lo + CHUNK, n) + words - 1]
        m = min(CHUNK, n - lo)
        shingles = map(b" ".join, zip(*(part[k : k + m] for k in range(words)))) if len(w) >= words else [b" ".join(w)]
        h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, m)
        votes += np.unpackbits(h[:, None].view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.uint64)[0])


def set_fingerprint(hashes: np.ndarray, width: int = WIDE) -> np.ndarray:
    """SimHash of ``width`` 64-bit words of a set of shingles, in which each counts once, so that it
    tells of the same similarity as the set does."""
    votes = np.zeros(64 * width, np.int64)
    for lo in range(0, len(hashes), CHUNK):
        votes += np.unpackbits(_mixed(hashes[lo : lo + CHUNK], width).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.uint64)


def _prints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            fp = np.zeros(got.num_rows, np.uint64)
            for i in range(got.num_rows):
                value = got.column(1)[i].as_buffer()
                fp[i] = fingerprint(value.to_pybytes(), words) if value is not None else 0
            yield pa.RecordBatch.from_arrays([got.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fp, the signed form of the 64-bit fingerprint, for every row."""
    of = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_prints(words), f"doc_id {of}, fp bigint")


def _syndrome(x: np.ndarray, length: int) -> np.ndarray:
    """XOR of the (1-based) places of the set bits; zero for the Hamming code's words."""
    s = np.zeros(len(x), np.int64)
    for bit in range(length):
        s ^= np.where(x >> bit & 1, bit + 1, 0)
    return s


def anchors(x: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and code words of the Hamming code of this length within 2 bits of each x.

    A word has itself only. Another value has the word one bit away, and one word for each pair
    of places with its syndrome as XOR.
    """
    s = _syndrome(x, length)
    rows = np.arange(len(x))
    one = x ^ np.where(s > 0, np.int64(1) << np.maximum(s - 1, 0), 0)
    out_rows, out = [rows], [one]
    for a in range(1, length + 1):
        b = s ^ a
        keep = (s > 0) & (b > a)
        out_rows.append(rows[keep])
        out.append(x[keep] ^ (np.int64(1) << (a - 1)) ^ (np.int64(1) << (b[keep] - 1)))
    return np.concatenate(out_rows), np.concatenate(out)


def _halves(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u = fp.view(np.uint64)
    return (u & np.uint64(0xFFFFFFFF)).astype(np.int64), (u >> np.uint64(32)).astype(np.int64)


def _first_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for got in batches:
        fp = got.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for half, bits in enumerate(_halves(fp)):
            rows, word = anchors(bits & 0x7FFFFFFF, 31)
            yield pa.RecordBatch.from_arrays([pa.array(word | half << 31), pa.array(fp[rows])], names=["key", "fp"])


def _second_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Split a hot anchor: the other half differs in at most 3 bits, so one of its two 16-bit
    quarters in at most one."""
    for got in batches:
        key, fp = (got.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
        low, high = _halves(fp)
        other = np.where(key >> 31 & 1, low, high)
        for quarter in (0, 1):
            rows, word = anchors(other >> 16 * quarter & 0x7FFF, 15)
            sub = word << 1 | quarter
            yield pa.RecordBatch.from_arrays([pa.array(key[rows] | sub << 32 | np.int64(1) << 62), pa.array(fp[rows])], names=["key", "fp"])


def _linked(fp: np.ndarray, max_bits: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Members of the components among different fingerprints, and their smallest member.

    From each new seed the not yet reached fingerprints are compared with one reached at a time;
    members of a dense family are reached within a few comparisons, so pairs are never listed.
    """
    left, nodes, roots = np.sort(fp), [], []
    while len(left) > 1:
        seed, left = left[0], left[1:]
        group, queue = [seed], [seed]
        while queue and len(left):
            near = np.bitwise_count((left ^ queue.pop()).view(np.uint64)) <= max_bits
            if near.any():
                found = left[near]
                left = left[~near]
                group.extend(found)
                queue.extend(found)
        if len(group) > 1:
            members = np.array(group[1:], np.int64)
            nodes.append(members)
            roots.append(np.full(len(members), seed, np.int64))
    return nodes, roots


def _compare(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = [np.array([], np.int64)], [np.array([], np.int64)]

        def links(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            cuts = np.flatnonzero(np.diff(key, prepend=key[:1] - 1, append=key[-1:] + 1))
            nodes, roots = [], []
            size = np.diff(cuts)
            pair = cuts[:-1][size == 2]
            near = pair[np.bitwise_count((fp[pair] ^ fp[pair + 1]).view(np.uint64)) <= max_bits]
            nodes.append(np.maximum(fp[near], fp[near + 1]))
            roots.append(np.minimum(fp[near], fp[near + 1]))
            for k in np.flatnonzero(size > 2):
                a, b = _linked(fp[cuts[k] : cuts[k + 1]], max_bits)
                nodes += a
                roots += b
            a, b = np.concatenate(nodes), np.concatenate(roots)
            keep = np.unique(np.stack([a, b], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(keep[:, 0]), pa.array(keep[:, 1])], names=["a", "b"])

        for got in batches:  # sorted by key: the last key of a batch may go on in the next
            key, fp = (got.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            if not len(key):
                continue
            if len(keys) > 1 and keys[-1][-1] != key[0]:
                yield links(np.concatenate(keys), np.concatenate(fps))
                keys, fps = keys[:1], fps[:1]
            cut = np.searchsorted(key, key[-1])
            if cut:
                yield links(np.concatenate([*keys, key[:cut]]), np.concatenate([*fps, fp[:cut]]))
                keys, fps = keys[:1], fps[:1]
            keys.append(key[cut:])
            fps.append(fp[cut:])
        if len(keys) > 1:
            yield links(np.concatenate(keys), np.concatenate(fps))

    return run


def links(prints: DataFrame, max_bits: int = MAX_BITS, hot_anchor: int = HOT_ANCHOR) -> DataFrame:
    """Edges (a, b) between different fingerprints (column fp, no repeats) that span the
    components of all links of at most ``max_bits`` (3 at most) bits."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the two halves cover links of at most 3 bits")
    keyed = prints.select("fp").mapInArrow(_first_keys, "key bigint, fp bigint")
    hot = staged(keyed.groupBy("key").count().where(F.col("count") > hot_anchor).select("key"), "hot")
    if hot.limit(1).count():
        spilled = sized_join(keyed, hot, ["key"], "left_semi").mapInArrow(_second_keys, "key bigint, fp bigint")
        keyed = sized_join(keyed, hot, ["key"], "left_anti").union(spilled)
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_compare(max_bits), "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, words: int = 3, max_bits: int = MAX_BITS, hot_anchor: int = HOT_ANCHOR) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable over links) for every row."""
    prints = staged(fingerprints(docs, words), "prints")
    classes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    found = components(links(classes, max_bits, hot_anchor))
    rooted = classes.join(found, classes.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = staged(rooted, "rooted")
    least = staged(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = staged(sized_join(rooted.select("fp", "root"), least, ["root"]).select("fp", "component_id"), "named")
    return sized_join(prints, named, ["fp"]).select("doc_id", "fp", "component_id")


# ---- links by similarity ----------------------------------------------------------------------


def bits_at(similarity: float, width: int = WIDE) -> int:
    """Expected number of differing bits of two shingle sets of this Jaccard similarity: sets of one
    size have the cosine 2 j / (1 + j), and a bit differs with probability angle / pi."""
    return round(64 * width * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def _texts(column: pa.Array) -> Iterator[bytes]:
    for value in column:
        raw = value.as_buffer()
        yield raw.to_pybytes() if raw is not None else b""


def _wide_prints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            fps, sizes, keys = [], [], []
            for t in _texts(got.column(2)):
                hashes = shingle_hashes(t, words)
                fps.append(set_fingerprint(hashes).tobytes())
                sizes.append(len(hashes))
                keys.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([got.column(0), got.column(1), pa.array(fps, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary())], names=["doc_id", "text_hash", "fp", "size", "set"])

    return run


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """Hashes of the different shingles, in order; of a shorter text the whole sequence."""
    w = text.lower().split()
    if not w:
        return np.array([], np.uint64)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(w[i : i + words]), SEED) for i in range(max(1, len(w) - words + 1))), np.uint64))


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            for lo in range(0, got.num_rows, 1024):
                some = got.slice(lo, 1024)
                sets = [shingle_hashes(t, words).view(np.int64) for t in _texts(some.column(1))]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["num", "hashes"])

    return run


def _wide(column: pa.Array) -> np.ndarray:
    raw = column.cast(pa.binary(8 * WIDE))
    at = raw.offset * WIDE
    return np.frombuffer(raw.buffers()[1], np.uint64)[at : at + len(raw) * WIDE].reshape(-1, WIDE)


def _piece_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of the four 16-bit pieces of the first word: code words of length 15 within radius 2,
    at which fingerprints meet that differ in at most two bits of a piece, so all with at most 11
    bits of the word and nearly all with 15."""
    for got in batches:
        word = _wide(got.column(1))[:, 0]
        for piece in range(4):
            rows, code = anchors((word >> np.uint64(16 * piece) & np.uint64(0x7FFF)).astype(np.int64), 15)
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays([pa.array(piece << 15 | code), *(got.column(i).take(take) for i in range(3))], names=["key", "num", "fp", "size"])


def _size_windows(least: float):
    """Split a hot anchor by sizes: two sets of allowed sizes lie in one step or in neighbouring
    ones, and each goes to its own and the next, so no pair is lost."""
    step = math.log(1 / least) * (1 + 1e-9) if least < 1 else 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            key, size = (got.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 3))
            at = np.floor(np.log(np.maximum(size, 1)) / step).astype(np.int64)
            for k in (at, at + 1):
                yield pa.RecordBatch.from_arrays([pa.array(key | (k + 1) << 20), *(got.column(i) for i in (1, 2, 3))], names=["key", "num", "fp", "size"])

    return run


#: Rows a tile of comparisons may have at most.
TILE_ROWS = 1024


def _near_any(fp: np.ndarray, size: np.ndarray, most: int, least: float) -> np.ndarray:
    """Which fingerprints have another one within ``most`` bits whose shingle set is of a size that
    allows the similarity ``least``: the smaller set has at least that share of the larger one.

    Sorted by size, each meets only those up to the largest allowed size, by tiles of a bounded
    number of pairs. Pairs that differ in more than ``most`` bits in two of the words are not looked
    at further."""
    n, order = len(fp), np.argsort(size, kind="stable")
    fp, size, out = fp[order], size[order], np.zeros(n, bool)
    reach = np.searchsorted(least * size, size, "right")
    first, second = (np.ascontiguousarray(fp[:, w]) for w in (0, 1))
    lo = 0
    while lo < n:
        ahead = reach[lo : lo + TILE_ROWS] - lo
        hi = lo + max(1, int(np.searchsorted(ahead * np.arange(1, len(ahead) + 1), CHUNK, "right")))
        end = reach[hi - 1]
        bits = np.bitwise_count(first[lo:hi, None] ^ first[None, lo:end])
        bits += np.bitwise_count(second[lo:hi, None] ^ second[None, lo:end])
        a, b = np.divmod(np.flatnonzero(bits <= most), end - lo)
        a, b = a[a < b] + lo, b[a < b] + lo
        near = (np.bitwise_count(fp[a] ^ fp[b]).sum(1) <= most) & (b < reach[a])
        out[a[near]] = out[b[near]] = True
        lo = hi
    found = np.zeros(n, bool)
    found[order] = out
    return found


#: Spanning forests that an anchor proposes first; no two share an edge.
FORESTS = 3


def _forests(num: np.ndarray, fp: np.ndarray, size: np.ndarray, most: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges of FORESTS shortest spanning forests over distances of at most ``most`` bits between
    sets of allowed sizes, each without the edges of those before: where a nearest member fails the
    check, the next nearest stands in. A forest is grown by the nearest member that is not reached
    yet, so pairs are never listed."""
    if len(num) > 4:
        some = _near_any(fp, size, most, least)
        num, fp, size = num[some], fp[some], size[some]
    a: list[int] = []
    b: list[int] = []
    used: list[list[int]] = [[] for _ in num]
    far = 64 * WIDE + 1
    for _ in range(FORESTS):
        before, at = len(a), 0
        left, by, near = np.arange(1, len(num)), np.zeros(max(0, len(num) - 1), np.int64), np.full(max(0, len(num) - 1), far, np.int32)
        while len(left):
            d = np.bitwise_count(fp[left] ^ fp[at]).sum(1, dtype=np.int32)
            closer = (d < near) & (np.minimum(size[left], size[at]) >= least * np.maximum(size[left], size[at]))
            if used[at]:
                closer &= ~np.isin(left, used[at])
            near[closer], by[closer] = d[closer], at
            k = int(near.argmin())
            if near[k] <= most:
                u, v = int(left[k]), int(by[k])
                a.append(u)
                b.append(v)
            at = left[k]
            left, by, near = np.delete(left, k), np.delete(by, k), np.delete(near, k)
        if len(a) == before:
            break
        for u, v in zip(a[before:], b[before:]):
            used[u].append(v)
            used[v].append(u)
    x, y = num[np.array(a, np.int64)], num[np.array(b, np.int64)]
    return np.minimum(x, y), np.maximum(x, y)


def _compare_wide(most: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        last = None

        def flushed() -> Iterator[pa.RecordBatch]:
            a, b = _forests(*map(np.concatenate, zip(*held)), most, least) if held else ([], [])
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for got in batches:  # sorted by key: the last key of a batch may go on in the next
            key, num, size = (got.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3))
            fp = _wide(got.column(2))
            cuts = np.flatnonzero(np.diff(key)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)]):
                if lo == hi:
                    continue
                if key[lo] != last:
                    yield from flushed()
                    held, last = [], key[lo]
                held.append((num[lo:hi], fp[lo:hi], size[lo:hi]))
        yield from flushed()

    return run


#: Texts of a block, two of which a tile compares.
BLOCK_ROWS = 128


def _tiles(marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks of the texts (num, family, root), and the tiles of two blocks, or of one with itself,
    in which all pairs of a family with different roots meet.

    A root of many texts has blocks of its own, which do not meet each other; the other roots of the
    family share blocks. Families of one root have none."""
    roots = staged(marks.groupBy("family", "root").agg(F.count("*").alias("n")), "roots")
    large = F.col("n") > BLOCK_ROWS
    mixed = roots.groupBy("family").agg(F.count("*").alias("roots"), F.sum(F.when(large, 0).otherwise(F.col("n"))).alias("others")).where("roots > 1")
    parts = F.ceil(F.when(large, F.col("n")).otherwise(F.col("others")) / BLOCK_ROWS)
    own = F.when(large, F.col("root")).otherwise(-1)
    cut = staged(sized_join(roots, staged(mixed, "mixed"), ["family"]).select("family", "root", own.alias("own"), parts.alias("parts")), "cut")
    members = sized_join(marks, cut, ["family", "root"]).withColumn("part", F.pmod(F.xxhash64("num"), "parts")).drop("parts")
    blocks = staged(members.select("family", "own", "part").distinct(), "blocks")
    pairs = blocks.join(blocks.toDF("family", "own2", "part2"), "family").where("struct(own, part) <= struct(own2, part2) and (own <> own2 or own = -1)")
    pairs = staged(pairs.withColumn("tile", F.monotonically_increasing_id()), "tiles")
    second = pairs.where("struct(own, part) <> struct(own2, part2)").select("tile", "family", "own2", "part2", F.lit(1))
    return members, staged(pairs.select("tile", "family", "own", "part", F.lit(0).alias("side")).union(second), "sides")


def _compare_tiles(most: int, least: float):
    def links(num, root, fp, side, hashes) -> pa.RecordBatch:
        x, y = (np.flatnonzero(side == k) for k in (0, 1))
        size = np.array([len(h) for h in hashes])
        if len(y):
            a, b = (k.ravel() for k in np.meshgrid(x, y, indexing="ij"))
        else:
            a, b = np.triu_indices(len(num), 1)
        near = (root[a] != root[b]) & (np.minimum(size[a], size[b]) >= least * np.maximum(size[a], size[b]))
        a, b = a[near], b[near]
        near = np.bitwise_count(fp[a] ^ fp[b]).sum(1) <= most
        found = []
        for i, j in zip(a[near].tolist(), b[near].tolist()):
            both = len(np.intersect1d(hashes[i], hashes[j], assume_unique=True))
            if both >= least * (size[i] + size[j] - both):
                found.append((min(num[i], num[j]), max(num[i], num[j])))
        a, b = zip(*found) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last = None
        for got in batches:  # sorted by tile: the last tile of a batch may go on in the next
            tile, num, root, side = (got.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            fp, hashes = _wide(got.column(4)), [h.values.to_numpy() for h in got.column(5)]
            cuts = (np.flatnonzero(np.diff(tile)) + 1).tolist()
            for lo, hi in zip([0, *cuts], [*cuts, len(tile)]):
                if lo == hi:
                    continue
                if tile[lo] != last:
                    if held:
                        yield links(*map(np.concatenate, zip(*[h[:4] for h in held])), [x for h in held for x in h[4]])
                    held, last = [], tile[lo]
                held.append((num[lo:hi], root[lo:hi], fp[lo:hi], side[lo:hi], hashes[lo:hi]))
        if held:
            yield links(*map(np.concatenate, zip(*[h[:4] for h in held])), [x for h in held for x in h[4]])

    return run


def _links_left(found: DataFrame, roots: DataFrame, classes: DataFrame, sets: DataFrame, most: int, least: float) -> DataFrame:
    """Links between different components (num, root) of the texts that the candidates ``found``
    connect: all pairs of two roots in a family, which is a component of the candidates, are
    compared as the candidates are, and on their sets."""
    family = staged(components(found).toDF("num", "family"), "families")
    marks = sized_join(family, roots, ["num"], "left").select("num", "family", F.coalesce("root", "num").alias("root"))
    members, sides = _tiles(staged(marks, "marks"))
    whole = members.join(classes.select("num", "fp"), "num").join(sets, "num")
    dealt = sized_join(whole, sides, ["family", "own", "part"]).select("tile", "num", "root", "side", "fp", "hashes")
    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "tile").sortWithinPartitions("tile").mapInArrow(tidied(_compare_tiles(most, least)), "a bigint, b bigint").distinct()


def similar_documents(docs: DataFrame, words: int = 5, least: float = 0.8, slack: int = 13, hot_anchor: int = HOT_ANCHOR) -> DataFrame:
    """doc_id and component_id (the smallest doc_id reachable over links) for every row.

    Texts link if the Jaccard similarity of their sets of ``words``-word shingles is ``least`` or
    more. Texts of equal sets form a class before, others link only after a check of their sets,
    whatever their fingerprints. Candidates differ in at most the bits expected at that similarity
    and ``slack`` more (two deviations) of a 256-bit SimHash of the set. A pair meets at an anchor of
    one of four pieces of the first 64 bits, which loses none with up to 11 differing bits there and
    about one in forty at similarity 0.8. Each anchor's candidates are compared within the window of
    set sizes that allow the similarity; anchors with more than ``hot_anchor`` members are split by
    those windows. Neither loses a pair. An anchor proposes the edges of FORESTS spanning forests,
    which are then checked on the shingles themselves: no pair below ``least`` links, and a family of
    n texts makes at most FORESTS * (n - 1) checks an anchor. The forests connect all candidates, so
    what they left out lies within a component of their edges: there every candidate pair of texts
    that are not yet connected is checked too, and no candidate is lost.

    Texts without words are one class. Null ids and repeated rows as in near_duplicates.
    """
    most = bits_at(least) + slack
    of = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string").alias("text"))
    prints = staged(rows.mapInArrow(tidied(_wide_prints(words)), f"doc_id {of}, text_hash bigint, fp binary, size bigint, set binary"), "prints")
    classes = prints.groupBy("set").agg(F.min("doc_id").alias("least"), F.min(F.struct("text_hash", "fp", "size")).alias("text"))
    classes = classes.select("set", "least", "text.text_hash", "text.fp", "text.size", F.monotonically_increasing_id().alias("num"))
    classes = staged(classes, "classes")
    schema = "key bigint, num bigint, fp binary, size bigint"
    keyed = classes.select("num", "fp", "size").mapInArrow(_piece_keys, schema)
    hot = staged(keyed.groupBy("key").count().where(F.col("count") > hot_anchor).select("key"), "hot")
    if hot.limit(1).count():
        split = sized_join(keyed, hot, ["key"], "left_semi").select("key", "num", "fp", "size").mapInArrow(_size_windows(least), schema)
        keyed = sized_join(keyed, hot, ["key"], "left_anti").select("key", "num", "fp", "size").union(split)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = keyed.repartition(n, "key").sortWithinPartitions("key").mapInArrow(tidied(_compare_wide(most, least)), "a bigint, b bigint")
    found = staged(found.distinct(), "candidates")

    ends = staged(found.select(F.explode(F.array("a", "b")).alias("num")).distinct().join(classes.select("num", "text_hash"), "num"), "ends")
    texts = sized_join(rows.select("text_hash", "text"), ends, ["text_hash"]).select("num", "text")
    sets = staged(texts.mapInArrow(tidied(_sets(words)), "num bigint, hashes array<bigint>").groupBy("num").agg(F.first("hashes").alias("hashes")), "sets")
    side = lambda c: sets.select(F.col("num").alias(c), F.col("hashes").alias(f"of_{c}"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    alike = both >= least * (F.size("of_a") + F.size("of_b") - both)
    edges = staged(found.join(side("a"), "a").join(side("b"), "b").where(alike).select("a", "b"), "edges")

    roots = staged(components(edges).withColumnRenamed("node", "num"), "roots")
    more = staged(_links_left(found, roots, classes, sets, most, least), "more")
    if more.limit(1).count():
        roots = staged(components(edges.union(more)).withColumnRenamed("node", "num"), "roots")
    rooted = staged(sized_join(classes, roots, ["num"], "left").select("set", "least", F.coalesce("root", "num").alias("root")), "rooted")
    least_id = staged(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = staged(sized_join(rooted.select("set", "root"), least_id, ["root"]).select("set", "component_id"), "named")
    return sized_join(prints.select("doc_id", "set"), named, ["set"]).select("doc_id", "component_id")
