"""The containment join against all pairs."""

import random
import time

import pytest

from quillspark.operators import graph, patterns


@pytest.mark.parametrize("chars", [2_000_000, 60])
@pytest.mark.parametrize("share,words", [(0.0, False), (0.5, False), (0.0, True)])
def test_containment_join_is_exact(spark, monkeypatch, chars, share, words):
    monkeypatch.setattr(patterns, "AUTOMATON_CHARS", chars)
    r = random.Random(5)
    make = lambda n: "".join(r.choice("ab é1 ") for _ in range(r.randint(0, n)))
    texts = [(i, make(30)) for i in range(60)] + [(3, "ab ab"), (None, "b a"), (99, None)]
    names = [make(5) for _ in range(40)] + ["ab", "ab", "", None, "b a"]
    got = patterns.contained(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(n,) for n in names], "pattern string"), share=share, words=words)

    def whole(t, p):
        at = [i for i in range(len(t)) if t.startswith(p, i)]
        return any(not (i and t[i - 1].isalnum() and p[0].isalnum()) and not (i + len(p) < len(t) and t[i + len(p)].isalnum() and p[-1].isalnum()) for i in at)

    want = sorted((i is None, i or 0, p, whole(t, p)) for i, t in texts if t for p in {n for n in names if n} if p in t and (whole(t, p) or not (words or len(p) < share * len(t))))
    assert sorted((x.id is None, x.id or 0, x.pattern, x.whole) for x in got.collect()) == want and want


def test_empty_tables(spark):
    texts, names = spark.createDataFrame([(1, "ab")], "id long, text string"), spark.createDataFrame([("a",)], "pattern string")
    assert patterns.contained(texts.limit(0), names).count() == 0 and patterns.contained(texts, names.limit(0)).count() == 0


def test_long_and_equal_names_stay_small(spark):
    """A name of many characters, and one that very many topics share."""
    rows = [(i, "shared name") for i in range(20_000)] + [(30_000, "x y" * 20_000), (30_001, "z" * 50_000), (30_002, "shared names")]
    began = time.time()
    got = graph.topic_pairs(spark.createDataFrame(rows, "id long, name string")).collect()
    assert sorted((r.a, r.b) for r in got) == sorted([(0, i) for i in range(1, 20_000)] + [(0, 30_002)])
    assert time.time() - began < 60
