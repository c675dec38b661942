import datetime as dt
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from quillspark.functions import filters, vectors
from quillspark.operators import domains, search
from quillspark.sources import importers
from quillspark.streaming import changes


@pytest.mark.parametrize("sim, old, new, want", [(0.93, 5, 5, "skip"), (0.90, 5, 9, "create_revision"), (0.90, 9, 5, "append_evidence"), (0.80, 5, 5, "add"), (None, 5, 5, "add")])
def test_reconcile(spark, sim, old, new, want):
    df = spark.createDataFrame([(False, False, sim, old, new)], "r boolean, k boolean, s double, o int, n int")
    assert df.select(search.route(*[F.col(c) for c in "rkson"]).alias("v")).first()["v"] == want


def test_memory_score(spark):
    df = spark.createDataFrame([("user_confirmed", True, True, "confirmed", 1.0)], "provenance_status string, can_use_as_instruction boolean, can_use_as_evidence boolean, review_status string, confidence double")
    assert df.select(filters.memory_score({c: F.col(c) for c in df.columns}, F.lit(0.5)).alias("v")).first()["v"] == pytest.approx(1.30)


@pytest.mark.parametrize("q, want", [("cat dog", True), ("cat -dog", False), ('"big cat"', True), ('"cat big"', False), ("fish or dog", True), ("fish", False), ("", False)])
def test_word_query(spark, q, want):
    df = spark.createDataFrame([(["the", "big", "cat", "and", "dog"],)], "t array<string>")
    assert df.select(filters.word_query(q, F.col("t")).alias("v")).first()["v"] is want


def test_containment(spark):
    df = spark.createDataFrame([(("idea", ["a", "b"]),)], "m struct<type:string,topics:array<string>>")
    check = lambda w: df.select(filters.contains(F.col("m"), w).alias("v")).first()["v"]
    assert check({}) and check({"type": "idea"}) and check({"topics": ["b"]})
    assert not check({"topics": ["c"]}) and not check({"type": "task"})


def test_similar_pairs_match_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    m = rng.standard_normal((60, 8))
    m[30:40] = m[:10] + 0.01
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(m)], "id long, embedding array<double>")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if u[i] @ u[j] >= 0.8}
    assert {(r.a, r.b) for r in search.similar_pairs(df, 0.8, cell=16).collect()} == want


def test_cosine_edges(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([1.0, 1.0], [2.0, 2.0]), ([1.0], [1.0, 2.0]), (None, [1.0])], "a array<double>, b array<double>")
    got = [r.v for r in df.select(vectors.cosine(F.col("a"), F.col("b")).alias("v")).collect()]
    assert got[0] is None and got[1] == pytest.approx(1.0) and got[2] is None and got[3] is None


def test_week_overlap(spark):
    d = dt.date
    rows = [(1, d(2024, 1, 1), None, None), (2, d(2024, 1, 20), None, None), (3, d(2023, 1, 1), d(2023, 2, 1), 3), (4, d(2023, 1, 1), d(2024, 1, 9), None)]
    df = spark.createDataFrame(rows, "id int, start_date date, end_date date, day_of_week int")
    assert sorted(r.id for r in domains.week(df, d(2024, 1, 8), d(2024, 1, 14)).collect()) == [1, 3, 4]


def test_match_people(spark):
    people = spark.createDataFrame([(1, "Anna Berg", ["AB"]), (2, "Joanna Lee", [])], "id long, name string, aliases array<string>")
    mentions = spark.createDataFrame([("ab",), ("Anna X",), ("Joa",), ("Zed",)], "mention string")
    assert {r.mention: r.person for r in domains.match_people(mentions, people).collect()} == {"ab": 1, "Anna X": 1, "Joa": 2, "Zed": None}


def test_messages_and_encoding(spark):
    df = spark.createDataFrame([("c", "a", i, f"m{i}") for i in range(4)] + [("d", "a", 0, "x")], "conversation_id string, sender string, ts int, text string")
    got = importers.direct_messages(df).collect()
    assert [(r.conversation_id, r.messages) for r in got] == [("c", 4)] and got[0].content.startswith("a: m0\na: m1")
    bad = spark.createDataFrame([("cafÃ©",), ("plain",)], "c string")
    assert [r.v for r in bad.select(importers.repaired_encoding(F.col("c")).alias("v")).collect()] == ["café", "plain"]


def test_quotes(spark):
    df = spark.createDataFrame([("Hi\n> old\nyes\n\nOn Monday, A wrote:\n> text",)], "c string")
    assert df.select(importers.without_quotes(F.col("c")).alias("v")).first()["v"] == "Hi\nyes"


def _streamed(spark, frames, schema, plan, places=None):
    """Rows of a streaming plan over one file for each frame."""
    folder = tempfile.mkdtemp(prefix="spark-")
    for i, rows in enumerate(frames):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    name = f"out_{abs(hash(folder))}"
    if places is not None:
        places.append(f"{folder}/cp")
    q = plan(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{folder}/cp").trigger(processingTime="1 second").start()
    try:
        until = time.time() + 60  # a stream with timeouts by the clock is never idle
        while sum(p["numInputRows"] for p in q.recentProgress) < sum(map(len, frames)) and time.time() < until and q.isActive:
            time.sleep(0.2)
        time.sleep(0.5)
        assert q.exception() is None
    finally:
        q.stop()
    return spark.table(name).collect()


def test_changes_are_queued_once(spark):
    frames = [[(1, 3, "a b", None), (2, 1, "x", "worker"), (1, 1, "A  b", None), (1, 2, "other", None)], [(1, 4, "a B", None)]]
    got = _streamed(spark, frames, "id long, seq long, content string, generated_by string", changes.changed)
    assert [r.id for r in got] == [1, 1, 1]  # the first, the other one and back again


def test_quiet_ids_leave_the_state(spark):
    """An id without changes in a batch that comes after its time is new again."""
    frames = [[(1, 1, "a", None)], [(2, 1, "a", None)], [(1, 2, "a", None)]]
    schema = "id long, seq long, content string, generated_by string"
    assert len(_streamed(spark, frames, schema, changes.changed)) == 2
    assert len(_streamed(spark, frames, schema, lambda s: changes.changed(s, dt.timedelta(milliseconds=1)))) == 3


def test_newer_updates_pass_however_late(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    frames = [[(1, day(5)), (2, day(1)), (1, day(3))], [(1, day(4)), (2, day(2))], [(1, day(6)), (2, day(2))]]
    got = _streamed(spark, frames, "id long, update_time timestamp", changes.newer)
    assert sorted((r.id, r.update_time.day) for r in got) == [(1, 5), (1, 6), (2, 1), (2, 2)]


def test_rate_limit(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [("k", base + dt.timedelta(seconds=i)) for i in range(31)] + [("k", base + dt.timedelta(seconds=61))]
    got = sorted(_streamed(spark, [rows], "key string, ts timestamp", changes.limited), key=lambda r: r.ts)
    assert [r.allowed for r in got] == [True] * 30 + [False, True]


def test_rate_limit_late_calls_and_idle_keys(spark):
    """Calls behind the watermark are left out; a key whose window has passed keeps no state."""
    base = dt.datetime(2024, 1, 1)
    s = lambda n: base + dt.timedelta(seconds=n)
    frames = [[("a", s(0)), ("b", s(0)), ("a", s(1)), ("a", s(2))], [("b", s(500))], [("a", s(1)), ("b", s(501))], [("b", s(502))]]
    places = []
    got = _streamed(spark, frames, "key string, ts timestamp", lambda x: changes.limited(x, 2, 60), places)
    assert sorted((r.key, r.ts, r.allowed) for r in got) == [("a", s(0), True), ("a", s(1), True), ("a", s(2), False), ("b", s(0), True), ("b", s(500), True), ("b", s(501), True), ("b", s(502), False)]
    kept = spark.read.format("statestore").load(places[0])
    assert {r.k for r in kept.select("key.key").toDF("k").collect()} == {"b"}


def test_rate_limit_of_a_table_is_the_streams(spark):
    import random

    r = random.Random(2)
    base = dt.datetime(2024, 1, 1)
    rows = sorted({(r.choice("ab"), base + dt.timedelta(seconds=r.randrange(300))) for _ in range(150)})
    df = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(rows)], "key string, ts timestamp, id long")
    got = {(x.key, rows[x.id][1]): x.allowed for x in changes.limited_rows(df, 5, 60).collect()}
    streamed = _streamed(spark, [rows], "key string, ts timestamp", lambda s: changes.limited(s, 5, 60))
    assert got == {(x.key, x.ts): x.allowed for x in streamed} and not all(got.values())


def test_session_window_splits_at_the_gap(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [("k", base), ("k", base + dt.timedelta(hours=4)), ("z", base + dt.timedelta(days=3))]
    got = _streamed(spark, [rows, [("z", base + dt.timedelta(days=9))]], "key string, ts timestamp", lambda s: changes.session_counts(s, "ts", "key", "1 second"))
    assert sum(r.key == "k" for r in got) in (0, 2)  # one watermark step may still be open
    assert changes.gap_micros("4 hours") == 4 * 3600 * 1_000_000 - 1
