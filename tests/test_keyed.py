"""The keyed sink: repeated, lost and concurrent batches."""

import datetime as dt
import pathlib
import tempfile
import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.streaming import keyed

SCHEMA = "k long, n long, first long, last long"
FOLD = keyed.totals(("k",), n="sum", first="min", last="max")


def table(spark, schema=SCHEMA, keys=("k",), buckets=8):
    return keyed.KeyedTable(spark, tempfile.mkdtemp(prefix="spark-"), schema, keys, buckets)


def batch(spark, keys, at):
    return spark.createDataFrame([(k, 1, at, at) for k in keys], SCHEMA)


def rows(t):
    return sorted(map(tuple, t.read().collect()), key=str)


def data_files(t):
    return {str(p): p.stat().st_mtime_ns for p in pathlib.Path(t.path, "data").rglob("*.parquet")}


def test_batches_fold_and_repeats_change_nothing(spark):
    t = table(spark)
    assert rows(t) == []
    assert t.merge(batch(spark, [1, 2, 2, None], 5), 0, FOLD) and t.merge(batch(spark, [2, 3, None], 9), 1, FOLD)
    want = rows(t)
    assert want == sorted([(1, 1, 5, 5), (2, 3, 5, 9), (3, 1, 9, 9), (None, 2, 5, 9)], key=str)
    files = data_files(t)
    assert not t.merge(batch(spark, [2, 3], 9), 1, FOLD) and not t.merge(batch(spark, [1], 5), 0, FOLD)
    assert rows(t) == want and data_files(t) == files
    assert t.merge(batch(spark, [1], 1), 0, FOLD, writer="other") and t.merge(batch(spark, [], 1), 2, FOLD)


def test_only_touched_buckets_are_written(spark):
    t = table(spark, buckets=32)
    t.merge(batch(spark, range(5000), 1), 0, FOLD)
    before = t.state()
    files = data_files(t)
    t.merge(batch(spark, [7], 2), 1, FOLD)
    after = t.state()
    changed = [b for b in after.folders if after.folders[b] != before.folders[b]]
    assert len(changed) == 1 and len(before.folders) == 32
    new = data_files(t).keys() - files.keys()
    assert sum(pathlib.Path(p).stat().st_size for p in new) < sum(pathlib.Path(p).stat().st_size for p in files) / 10
    assert t.vacuum() == 1 and t.read().count() == 5000 and t.read().where("n = 2").count() == 1


def test_a_batch_lost_before_its_commit(spark, monkeypatch):
    t = table(spark)
    t.merge(batch(spark, [1, 2], 1), 0, FOLD)

    def lost(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(keyed.KeyedTable, "_commit", lost)
        with pytest.raises(OSError):
            t.merge(batch(spark, [2, 3], 2), 1, FOLD)
    assert rows(t) == [(1, 1, 1, 1), (2, 1, 1, 1)]
    assert t.merge(batch(spark, [2, 3], 2), 1, FOLD) and rows(t) == [(1, 1, 1, 1), (2, 2, 1, 2), (3, 1, 2, 2)]
    assert t.vacuum() > 0 and len(rows(t)) == 3


def test_a_stream_that_is_killed_and_started_again(spark):
    folder, t = tempfile.mkdtemp(prefix="spark-"), table(spark)
    for at in range(4):
        batch(spark, [at, at + 1], at).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    calls = []

    def run(fail):
        handle = t.handle(FOLD)

        def each(df, batch_id):
            calls.append(batch_id)
            handle(df, batch_id)
            if batch_id == fail:  # after the table's commit, before the stream's
                raise RuntimeError("killed")

        q = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in").writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
        try:
            q.awaitTermination()
        except Exception:
            assert fail is not None
        finally:
            q.stop()

    run(1)
    run(None)
    assert calls.count(1) == 2  # the stream repeats the batch; the table knows it
    assert sum(r[1] for r in rows(t)) == 8


QUEUE = "thought_id long, status string, queued_at timestamp, worker string, claimed_at timestamp"


def test_no_entry_goes_to_two_workers(spark):
    t = table(spark, QUEUE, ("thought_id",), 4)
    base = dt.datetime(2024, 1, 1)
    start = spark.createDataFrame([(i, "pending", base + dt.timedelta(seconds=i // 2), None, None) for i in range(40)], QUEUE)
    t.merge(start, 0, keyed.newest(("thought_id",), [F.col("queued_at")]))
    won: dict[str, list] = {}

    def work(name):
        won[name] = [r.thought_id for _ in range(2) for r in keyed.claim(t, name, 6, F.lit(base)).collect()]

    threads = [threading.Thread(target=work, args=(w,)) for w in "abc"]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    taken = Counter(i for ids in won.values() for i in ids)
    assert set(taken.values()) == {1} and sorted(taken) == list(range(36))
    done = spark.createDataFrame([(i, "complete") for i in range(40)], "thought_id long, outcome string")
    assert {r.thought_id for r in keyed.settle(t, "a", done).collect()} == set(won["a"])
    assert t.read().where("status = 'complete'").count() == 12 and t.read().where("status = 'pending'").count() == 4
    assert keyed.settle(t, "a", done).count() == 0


def test_a_taken_commit_is_refused(spark):
    t = table(spark)
    t._commit(keyed.State(0, {}, {}))
    with pytest.raises(keyed.Conflict):
        t._commit(keyed.State(0, {}, {"x": 1}))
