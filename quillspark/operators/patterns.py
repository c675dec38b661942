"""Which texts hold which patterns: a containment join by an automaton over all patterns."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of the patterns that one automaton holds, about; more patterns are dealt by hash over
#: several automata, each of which reads the texts.
AUTOMATON_CHARS = 2_000_000

_CACHE: dict[str, object] = {}


def _automaton(name: str, patterns: list[str]):
    """The automaton (goto and failure links) of a broadcast list, built once in a worker."""
    if name not in _CACHE:
        import ahocorasick

        found = ahocorasick.Automaton()
        for p in patterns:
            found.add_word(p, p)
        found.make_automaton()
        _CACHE.clear()
        _CACHE[name] = found
    return _CACHE[name]


def held(text: str, automaton, share: float, words: bool) -> list[tuple[str, bool]]:
    """The patterns in a text, each once, with whether one of its places is whole words.

    With ``share``, a pattern that is nowhere whole words counts only if it has at least that share of
    the text's length; with ``words``, not at all."""
    found: dict[str, bool] = {}
    for end, p in automaton.iter(text):
        start = end + 1 - len(p)
        whole = not (start and text[start - 1].isalnum() and p[0].isalnum()) and not (end + 1 < len(text) and text[end + 1].isalnum() and p[-1].isalnum())
        if whole or not (words or len(p) < share * len(text)):
            found[p] = whole or found.get(p, False)
    return list(found.items())


def contained(texts: DataFrame, patterns: DataFrame, key: str = "id", text: str = "text", pattern: str = "pattern", share: float = 0.0, words: bool = False) -> DataFrame:
    """key, pattern, whole: every pattern in every text, once for each row of ``texts``.

    The texts stay where they lie and are read once for each automaton; memory is linear in the
    patterns of one. ``share`` and ``words`` as in ``held``. Null and empty patterns and null texts
    match nothing; equal patterns count once; an empty table gives an empty result."""
    spark = texts.sparkSession
    wanted = patterns.select(F.col(pattern).alias("pattern")).where(F.length("pattern") > 0).distinct()
    chars = wanted.agg(F.coalesce(F.sum(F.char_length("pattern")), F.lit(0))).first()[0]
    parts = max(1, -(-int(chars) // AUTOMATON_CHARS))
    rows = texts.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).where(F.col("text").isNotNull())
    out = None
    for part in range(parts):
        own = wanted if parts == 1 else wanted.where(F.pmod(F.xxhash64("pattern"), F.lit(parts)) == part)
        name = uuid.uuid4().hex
        given = spark.sparkContext.broadcast([r.pattern for r in own.collect()])  # about AUTOMATON_CHARS characters

        def work(batches: Iterator[pa.RecordBatch], given=given, name=name) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(name, given.value) if given.value else None
            for b in batches if automaton is not None else ():
                at, found, whole = [], [], []
                for i, t in enumerate(b.column("text").to_pylist()):
                    for p, w in held(t, automaton, share, words):
                        at.append(i)
                        found.append(p)
                        whole.append(w)
                yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(at, pa.int64())), pa.array(found, pa.string()), pa.array(whole, pa.bool_())], ["key", "pattern", "whole"])

        here = rows.mapInArrow(work, f"key {dict(rows.dtypes)['key']}, pattern string, whole boolean")
        out = here if out is None else out.unionByName(here)
    return out.withColumnRenamed("key", key)
