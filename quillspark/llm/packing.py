"""Sequence packing by power-of-two decomposition.

Every document is cut into pieces whose lengths are powers of two (full ``max_len`` pieces first,
then the binary digits of the rest, largest first). Each piece is a sequence of its own, so no
sequence crosses documents and none needs padding; sequences of equal length form one bucket.

Defined cases: a null or empty text is the end id alone (one piece of length 1); texts of any
length are cut, never truncated; repeated rows are packed once each; rows with a null doc_id are
packed too; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidied

MAX_LEN = 2048
END_ID = 1
#: Entries of a worker's cache of tokenized chunks; beyond it the cache starts anew.
CACHE_ENTRIES = 1_000_000
#: Bytes of ids after which an output batch is sent.
BATCH_BYTES = 16 << 20

#: Normalizer and pre-tokenizer under which words may go to the tokenizer's model as they are.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: The same words of lower-case text up to U+00FF, which NFC leaves as it is.
_LETTERS, _NUMBERS = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾"
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\\t-\\r \x85\xa0{_LETTERS}{_NUMBERS}]+")


def _byte_chars() -> dict[int, str]:
    """The character by which a byte-level vocabulary writes each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}


class _Lookup(dict):
    """A dict that makes what it lacks."""

    def __init__(self, make: Callable):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        self[key] = got = self.make(key)
        return got


def _cuts_as_expected(tokenizer) -> bool:
    rules = [json.loads(x.__getstate__()) if x else None for x in (tokenizer.normalizer, tokenizer.pre_tokenizer)]
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    return rules == [_NORMALIZER, _PRE_TOKENIZER] and not tokenizer.truncation and all(t.startswith("<") for t in special)


def _word_ids(model, byte_chars: dict[int, str], word: str) -> bytes:
    shown = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(byte_chars)
    ids = [t.id for t in model.tokenize(shown)]
    return struct.pack(f"<{len(ids)}I", *ids)


def _chunk_ids(tokenizer, words: _Lookup, plain: bool, chunk: bytes) -> bytes:
    text = chunk.decode("utf-8", "replace")
    if plain and "<" not in text and max(text) < "Ā":
        return b"".join(map(words.__getitem__, _WORDS.findall(text.lower())))
    ids = tokenizer.encode(text, add_special_tokens=False).ids
    return struct.pack(f"<{len(ids)}I", *ids)


class ChunkTokenizer:
    """Token ids of a text as packed little-endian 32-bit numbers.

    The tokenizer drops white space and none of its rules looks across it, so the ids of a text
    are those of its chunks between ASCII white space in order; chunks are cached. Chunks of
    characters up to U+00FF are cut into words as the tokenizer cuts them, and each word goes to the
    tokenizer's model once; others, and those that could hold a special token, go through the whole
    tokenizer. So do all chunks if it does not normalize and cut as expected.
    """

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        self.entries = entries
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.words = _Lookup(partial(_word_ids, tokenizer.model, _byte_chars()))
        self.chunks = _Lookup(partial(_chunk_ids, tokenizer, self.words, _cuts_as_expected(tokenizer)))

    def ids(self, texts: list[bytes]) -> list[bytes]:
        if len(self.chunks) > self.entries or len(self.words) > self.entries:
            self.chunks.clear()
            self.words.clear()
        get = self.chunks.__getitem__
        return [b"".join(map(get, t.split())) for t in texts]


def piece_lengths(n: int, max_len: int = MAX_LEN) -> list[int]:
    """Powers of two that sum to n: as many max_len as fit, then the binary digits of the rest."""
    full, rest = divmod(n, max_len)
    return [max_len] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _binary(data: bytes, lengths: list[int]) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, "<i4")
    np.cumsum(lengths, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _packer(path: str, end_id: int, max_len: int, entries: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, end = ChunkTokenizer(path, entries), np.asarray([end_id], "<u4").tobytes()
        names = ["doc_id", "start", "length", "doc_tokens", "ids"]

        def batch(doc_ids, rows, data):
            at, start, length, total = (np.asarray(x, np.int64) for x in zip(*rows))
            kind = {0: doc_ids.take(pa.array(at)), 1: pa.array(start), 2: pa.array(length), 3: pa.array(total)}
            return pa.RecordBatch.from_arrays([*kind.values(), _binary(b"".join(data), (4 * length).tolist())], names=names)

        for got in batches:
            texts, rows, data, size = got.column(1), [], [], 0
            for lo in range(0, len(texts), 64):
                some = [b"" if x is None else x for x in texts.slice(lo, 64).cast(pa.large_binary()).to_pylist()]
                for k, ids in enumerate(tokenizer.ids(some)):
                    ids += end
                    total, start = len(ids) // 4, 0
                    for n in piece_lengths(total, max_len):
                        rows.append((lo + k, start, n, total))
                        start += n
                    data.append(ids)
                    size += len(ids)
                    if size >= BATCH_BYTES:
                        yield batch(got.column(0), rows, data)
                        rows, data, size = [], [], 0
            if rows:
                yield batch(got.column(0), rows, data)

    return pack


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, max_len: int = MAX_LEN, cache_entries: int = CACHE_ENTRIES) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, doc_tokens, ids (packed little-endian
    unsigned 32-bit), bucket (binary logarithm of the length), sequence_id and offset.

    ``max_len`` is a power of two. Nothing is shuffled: a piece is a sequence, numbered by its
    bucket in the top bits and its place in the job below, so a bucket's ids form one range.
    """
    if max_len & (max_len - 1) or not 1 <= max_len <= 1 << 15:
        raise ValueError("max_len must be a power of two up to 32768")
    of = dict(docs.dtypes)["doc_id"]
    pieces = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        tidied(_packer(tokenizer_path, end_id, max_len, cache_entries)), f"doc_id {of}, start bigint, length bigint, doc_tokens bigint, ids binary"
    )
    bucket = F.length(F.bin("length")) - 1
    return pieces.select(
        "*",
        bucket.alias("bucket"),
        (F.shiftleft(bucket.cast("bigint"), 59) + F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("bigint").alias("offset"),
    )


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write sequences with one folder for each length, the layout a trainer batches from."""
    pieces.write.partitionBy("bucket").parquet(path)
