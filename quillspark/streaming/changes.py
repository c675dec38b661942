"""Change-driven work as Structured Streaming."""

from __future__ import annotations

import datetime as dt
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text


#: How long an id that does not change stays in the state.
REMEMBERED = dt.timedelta(days=90)


def changed(stream: DataFrame, remembered: dt.timedelta = REMEMBERED) -> DataFrame:
    """Changes (id, seq, content, generated_by) that need extraction: not generated, and with another
    fingerprint than the id's last one, which is kept as state. Changes of a batch count in the order
    of ``seq``. An id that was quiet for ``remembered`` is forgotten, and its next change counts as new."""
    rows = stream.where("generated_by IS NULL").select("id", "seq", text.fingerprint(F.col("content"), "md5").alias("print"))
    quiet = max(1, int(remembered.total_seconds() * 1000))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            state.remove()
        else:
            last = state.get[0] if state.exists else None
            for p in pd.concat(list(batches)).sort_values("seq")["print"]:
                if p != last:
                    out.append((key[0], p))
                    last = p
            state.update((last,))
            state.setTimeoutDuration(quiet)
        yield pd.DataFrame(out, columns=["id", "print"])

    kind = dict(stream.dtypes)["id"]
    return rows.groupBy("id").applyInPandasWithState(step, f"id {kind}, print string", "print string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def newer(stream: DataFrame, remembered: dt.timedelta = REMEMBERED) -> DataFrame:
    """The newest update (id, update_time) of each id in a batch, if it is newer than all that were
    passed on before, however late it comes; ids stay known for ``remembered`` after their last one."""
    rows = stream.select("id", F.unix_micros(F.col("update_time").cast("timestamp")).alias("at"))
    quiet = max(1, int(remembered.total_seconds() * 1000))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            state.remove()
        else:
            best = max(int(b["at"].max()) for b in batches)
            if not state.exists or best > state.get[0]:
                out.append((key[0], best))
                state.update((best,))
            state.setTimeoutDuration(quiet)
        yield pd.DataFrame(out, columns=["id", "at"])

    kind = dict(stream.dtypes)["id"]
    found = rows.groupBy("id").applyInPandasWithState(step, f"id {kind}, at bigint", "at bigint", "append", GroupStateTimeout.ProcessingTimeTimeout)
    return found.select("id", F.timestamp_micros("at").alias("update_time"))


def limited(stream: DataFrame, calls: int = 30, seconds: int = 60, late: str = "10 seconds") -> DataFrame:
    """Calls (key, ts) with whether a sliding-window limit allows them; only allowed ones count.

    Calls of a batch count in the order of their times; those behind the watermark (``late`` behind the
    newest) are left out. The state of a key is the times of its allowed calls within the window, oldest first; it
    leaves when the watermark has passed the last one's window."""
    window = pd.Timedelta(seconds=seconds)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms")
        stamps, allowed = pd.concat(list(batches))["ts"].sort_values() if not state.hasTimedOut else pd.Series([], dtype="datetime64[ns]"), []
        stamps = stamps[stamps > mark]
        times = deque(pd.Timestamp(t, unit="us") for t in state.get[0]) if state.exists else deque()
        for ts in stamps:
            while times and times[0] <= ts - window:
                times.popleft()
            allowed.append(len(times) < calls)
            if allowed[-1]:
                times.append(ts)
        if times and times[-1] + window > mark:
            state.update(([t.value // 1000 for t in times],))
            state.setTimeoutTimestamp((times[-1] + window).value // 1_000_000)
        else:
            state.remove()
        yield pd.DataFrame({"key": pd.Series([key[0]] * len(allowed), dtype=object), "ts": stamps.to_numpy(), "allowed": pd.Series(allowed, dtype=bool)})

    rows = stream.withWatermark("ts", late)
    return rows.groupBy("key").applyInPandasWithState(step, "key string, ts timestamp, allowed boolean", "times array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


def limited_rows(calls_: DataFrame, calls: int = 30, seconds: int = 60) -> DataFrame:
    """The same rule on a table of calls (key, ts, id; ties by id): a call is allowed if fewer than ``calls`` allowed
    ones lie within the window before it. The allowed times are folded in order, one key a group."""
    rows = F.array_sort(F.collect_list(F.struct("ts", "id")))
    micros = seconds * 1_000_000

    def step(s: Column, c: Column) -> Column:
        now = F.unix_micros(c["ts"].cast("timestamp"))
        recent = F.filter(s["times"], lambda t: t > now - micros)
        ok = F.size(recent) < calls
        return F.struct(F.when(ok, F.array_append(recent, now)).otherwise(recent).alias("times"), F.array_append(s["out"], ok).alias("out"))

    none = F.struct(F.array().cast("array<bigint>").alias("times"), F.array().cast("array<boolean>").alias("out"))
    each = calls_.groupBy("key").agg(rows.alias("c")).withColumn("allowed", F.aggregate("c", none, step, lambda s: s["out"]))
    return each.select("key", F.inline(F.arrays_zip("c", "allowed"))).select("key", F.col("c.id").alias("id"), "allowed")


def windowed_counts(stream: DataFrame, ts: str, key: str, late: str, size: str, slide: str | None = None) -> DataFrame:
    """Counts in tumbling or sliding windows; rows later than ``late`` are left out."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, size, slide or size), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n")


def session_counts(stream: DataFrame, ts: str, key: str, late: str, gap: str = "4 hours") -> DataFrame:
    """Sessions that end after a gap. Spark joins rows exactly a gap apart, so a microsecond less is
    used: a full gap splits."""
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, f"{gap_micros(gap)} microseconds"), key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def gap_micros(gap: str) -> int:
    """A microsecond less than a number of hours, minutes or seconds."""
    n, unit = gap.split()
    return int(n) * {"hour": 3600, "minute": 60, "second": 1}[unit.rstrip("s")] * 1_000_000 - 1


def fresh(stream: DataFrame, key: str, ts: str, late: str) -> DataFrame:
    """Rows whose key was not seen within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def process(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, every: str = "10 seconds"):
    """Work off a queue in micro-batches; a batch that fails is tried again from the checkpoint."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


# ---- the queue as tables: what a batch of the stream does ---------------------------------------


def claimed(queue: DataFrame, n: int) -> DataFrame:
    """The ``n`` entries (thought_id, status, queued_at, attempt_count) that wait longest."""
    return queue.where("status = 'pending'").orderBy("queued_at", "thought_id").limit(n)


def settled(queue: DataFrame, outcomes: DataFrame, most: int = 3) -> DataFrame:
    """The queue after claimed entries (thought_id, ok, error) were worked on: done, or pending again
    with an attempt more, or failed at the last attempt."""
    rows = queue.join(outcomes.select("thought_id", "ok", "error"), "thought_id", "left")
    tries = F.coalesce("attempt_count", F.lit(0)) + F.when(F.col("ok").isNotNull() & ~F.col("ok"), 1).otherwise(0)
    status = F.when(F.col("ok").isNull(), F.col("status")).when(F.col("ok"), "complete").when(tries >= most, "failed").otherwise("pending")
    return rows.select("thought_id", status.alias("status"), tries.alias("attempt_count"), "queued_at", F.when(~F.col("ok"), F.col("error")).alias("last_error"))


def dirty_entities(queue: DataFrame, links: DataFrame, done: DataFrame, least: int = 3) -> DataFrame:
    """Entities of the thoughts done whose pages are to be written again: with enough links, and only
    once no entry of the queue waits."""
    waiting = F.broadcast(queue.agg(F.count_if(F.col("status") == "pending").alias("waiting")))  # one row
    touched = links.join(done.select("thought_id").distinct(), "thought_id", "left_semi").select("entity_id").distinct()
    n = links.join(touched, "entity_id", "left_semi").groupBy("entity_id").agg(F.count("*").alias("links")).where(F.col("links") >= least)
    return n.crossJoin(waiting).where("waiting = 0").select("entity_id", "links")


def unprocessed(rows: DataFrame, log: DataFrame) -> DataFrame:
    """Rows (id, update_time) that the log does not hold, or holds with an older time."""
    old = log.select("id", F.col("update_time").alias("known"))
    return rows.join(old, "id", "left").where(F.col("known").isNull() | (F.col("update_time") > F.col("known"))).drop("known")
