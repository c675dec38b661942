"""A keyed table that micro-batches change in place: only the buckets that a batch touches are written.

Layout of the folder: ``data/<attempt>/bucket=B`` holds the rows of a bucket as one attempt wrote them;
``commits/<number>`` names, for every bucket, the attempt that counts, and for every writer the last
batch that is in. A change writes new data first and then one commit file, whose number can be taken
only once: of two writers that started from the same commit one is refused, reads the new state and
tries again. So a batch that is lost before its commit leaves no trace that anyone reads, a batch that is repeated
after it changes nothing, and an entry that two workers want goes to one of them.

Defined cases: an empty batch is committed without data; keys may be null (nulls are equal); rows that
repeat a key within a batch are the fold's to join; a new table is empty.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of the table by key: fold(old rows of the touched buckets, batch) gives their new rows.
Fold = Callable[[DataFrame, DataFrame], DataFrame]


class Conflict(RuntimeError):
    """Another writer has taken the next commit."""


@dataclass(frozen=True)
class State:
    """What a commit says: its number, the folder of each bucket, each writer's last batch."""

    number: int
    folders: dict[int, str]
    batches: dict[str, int]


@dataclass(frozen=True)
class KeyedTable:
    spark: SparkSession
    path: str
    schema: str
    keys: tuple[str, ...]
    buckets: int = 16

    # ---- commits ----

    def _fs(self):
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        return jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()), jpath

    def state(self) -> State:
        """The latest commit; one small file is read."""
        fs, folder = self._fs()
        if not fs.exists(folder):
            return State(-1, {}, {})
        number = max((int(f.getPath().getName()) for f in fs.listStatus(folder) if f.getPath().getName().isdigit()), default=-1)
        if number < 0:
            return State(-1, {}, {})
        stream = fs.open(self.spark._jvm.org.apache.hadoop.fs.Path(folder, str(number)))
        try:
            got = json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()
        return State(number, {int(k): v for k, v in got["folders"].items()}, got["batches"])

    def _commit(self, state: State) -> None:
        fs, folder = self._fs()
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs.mkdirs(folder)
        draft, final = path(folder, f"_{uuid.uuid4().hex}"), path(folder, str(state.number))
        stream = fs.create(draft, False)
        stream.write(bytearray(json.dumps({"folders": state.folders, "batches": state.batches}).encode()))
        stream.close()
        try:
            if fs.getScheme() == "file":  # a local rename would replace a file, a link does not
                os.link(draft.toUri().getPath(), final.toUri().getPath())
            elif fs.exists(final) or not fs.rename(draft, final):
                raise FileExistsError
        except FileExistsError:
            raise Conflict(f"commit {state.number} is taken") from None
        finally:
            fs.delete(draft, False)

    # ---- rows ----

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def read(self, state: State | None = None, only: list[int] | None = None) -> DataFrame:
        """The rows as of a commit (the latest), or those of some buckets."""
        state = self.state() if state is None else state
        folders = [f"{self.path}/{v}" for k, v in sorted(state.folders.items()) if only is None or k in only]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def _replaced(self, state: State, rows: DataFrame, touched: list[int], batches: dict[str, int]) -> State:
        """Write the new rows of the touched buckets and commit them."""
        if not touched:
            new = State(state.number + 1, state.folders, batches)
        else:
            attempt = f"data/{uuid.uuid4().hex}"
            rows.withColumn("bucket", self._bucket()).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{attempt}")
            fs, _ = self._fs()
            there = [k for k in touched if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{attempt}/bucket={k}"))]
            kept = {k: v for k, v in state.folders.items() if k not in touched}
            new = State(state.number + 1, kept | {k: f"{attempt}/bucket={k}" for k in there}, batches)
        self._commit(new)
        return new

    def merge(self, batch: DataFrame, batch_id: int, fold: Fold, writer: str = "stream", attempts: int = 20) -> bool:
        """Fold a batch in; False if the writer's batch is in already. Batch numbers of a writer rise."""
        for _ in range(attempts):
            state = self.state()
            if state.batches.get(writer, -1) >= batch_id:
                return False
            touched = sorted(r.b for r in batch.select(self._bucket().alias("b")).distinct().collect())  # at most ``buckets``
            try:
                self._replaced(state, fold(self.read(state, touched), batch), touched, state.batches | {writer: batch_id})
                return True
            except Conflict:
                continue
        raise Conflict(f"batch {batch_id} of {writer} was refused {attempts} times")

    def update(self, change: Callable[[DataFrame], DataFrame], attempts: int = 20) -> DataFrame:
        """Replace rows by key with those that ``change`` makes of the table as it is, and give these.
        Where another writer came first, ``change`` is asked again with the new state, so a condition
        on the old rows (a status, say) holds for what is replaced."""
        for _ in range(attempts):
            state = self.state()
            new = change(self.read(state)).checkpoint()
            touched = sorted(r.b for r in new.select(self._bucket().alias("b")).distinct().collect())  # at most ``buckets``
            old = self.read(state, touched)
            same = [old[k].eqNullSafe(new[k]) for k in self.keys]
            try:
                self._replaced(state, old.join(new, same, "left_anti").unionByName(new), touched, state.batches)
                return new
            except Conflict:
                continue
        raise Conflict(f"the change was refused {attempts} times")

    def handle(self, fold: Fold, writer: str = "stream") -> Callable[[DataFrame, int], None]:
        """What foreachBatch calls."""

        def run(batch: DataFrame, batch_id: int) -> None:
            self.merge(batch.persist(), batch_id, fold, writer)
            batch.unpersist()

        return run

    def vacuum(self) -> int:
        """Delete data that the latest commit does not name, and older commits; how many folders went.
        Only while nobody writes or reads older states."""
        state, (fs, folder) = self.state(), self._fs()
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        named, gone = set(state.folders.values()), 0
        data = path(f"{self.path}/data")
        for attempt in fs.listStatus(data) if fs.exists(data) else ():
            for part in fs.listStatus(attempt.getPath()):
                name = f"data/{attempt.getPath().getName()}/{part.getPath().getName()}"
                if part.isDirectory() and name not in named:
                    fs.delete(part.getPath(), True)
                    gone += 1
        for f in fs.listStatus(folder) if fs.exists(folder) else ():
            if f.getPath().getName() != str(state.number):
                fs.delete(f.getPath(), False)
        return gone


def newest(keys: tuple[str, ...], order: list[Column]) -> Fold:
    """The last row of each key by an order, old rows and the batch's alike."""

    def fold(old: DataFrame, batch: DataFrame) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(*[c.desc_nulls_last() for c in order])
        return old.unionByName(batch.select(old.columns)).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")

    return fold


def totals(keys: tuple[str, ...], **how: str) -> Fold:
    """Columns summed, or the least or largest, by key (sum, min, max): what a batch brings is folded
    before it meets the old rows."""

    def fold(old: DataFrame, batch: DataFrame) -> DataFrame:
        each = [getattr(F, f)(c).cast(dict(old.dtypes)[c]).alias(c) for c, f in how.items()]
        part = batch.groupBy(*keys).agg(*each).select(old.columns)
        return old.unionByName(part).groupBy(*keys).agg(*each).select(old.columns)

    return fold


def claim(queue: KeyedTable, worker: str, n: int, at: Column) -> DataFrame:
    """Give a worker the ``n`` pending entries (thought_id, status, queued_at, worker, claimed_at) that
    wait longest; no entry goes to two workers."""

    def take(rows: DataFrame) -> DataFrame:
        few = rows.where("status = 'pending'").orderBy("queued_at", "thought_id").limit(n)
        return few.withColumns({"status": F.lit("processing"), "worker": F.lit(worker), "claimed_at": at}).select(rows.columns)

    return queue.update(take)


def settle(queue: KeyedTable, worker: str, done: DataFrame) -> DataFrame:
    """Set entries (thought_id, outcome) that the worker still holds to their outcome."""

    def put(rows: DataFrame) -> DataFrame:
        own = rows.where((F.col("status") == "processing") & (F.col("worker") == worker))
        return own.join(done.select("thought_id", "outcome"), "thought_id").withColumn("status", F.col("outcome")).select(rows.columns)

    return queue.update(put)
