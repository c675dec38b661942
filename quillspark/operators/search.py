"""Retrieval: vector, keyword and hybrid search, recall and ingest reconciliation."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, vectors
from ..functions.filters import Json, contains, differs, equal_if, in_scope, memory_score, within_hours, word_query
from . import graph, metric


def match(thoughts: DataFrame, query: Sequence[float], threshold: float = 0.7, most: int = 10, where: Json = None, strict: bool = True) -> DataFrame:
    """The most similar rows above a threshold (at it too unless strict), ties by id."""
    rows = thoughts if where is None else thoughts.where(contains(F.col("metadata"), where))
    rows = rows.withColumn("similarity", vectors.cosine_to(F.col("embedding"), query))
    rows = rows.where(F.col("similarity") > threshold if strict else F.col("similarity") >= threshold)
    return rows.orderBy(F.desc("similarity"), "serial_id").limit(most)


def match_recent(thoughts: DataFrame, query: Sequence[float], as_of: datetime, threshold: float = 0.7, most: int = 10, weight: float = 0.15, half_life_days: float = 90.0) -> DataFrame:
    """As match, ranked by similarity mixed with recency; the threshold is on the similarity."""
    rows = thoughts.withColumn("similarity", vectors.cosine_to(F.col("embedding"), query)).where(F.col("similarity") >= threshold)
    return rows.withColumn("score", vectors.recency_blend(F.col("similarity"), F.col("created_at"), F.lit(as_of), weight, half_life_days)).orderBy(F.desc("score"), "serial_id").limit(most)


def search_text(thoughts: DataFrame, query: str, most: int = 25, offset: int = 0) -> DataFrame:
    """Rows whose tokens fit the query; where those are fewer than a page, rows with the query as a
    substring too. Ranked by cover density, importance and quality; with the total.

    Texts are read and split once; the ranked rows that are stored hold no text."""
    rows = thoughts.where(differs(F.col("sensitivity_tier"), "restricted"))
    words = [w for w in dict.fromkeys(re.findall(r"[^\W_]+", query.lower())) if w != "or"]
    # bound once: several expressions use the tokens
    rows = rows.withColumn("tokens", text.tokens(F.coalesce("content", F.lit("")))).withColumn("part", F.coalesce(F.col("content").ilike(f"%{query}%"), F.lit(False)))
    rows = rows.withColumn("hit", word_query(query, F.col("tokens"))).where(F.col("hit") | F.col("part"))
    density = text.cover_density(F.col("tokens"), words)
    rank = F.greatest(F.when(F.col("hit"), density).otherwise(0.0), F.when(F.col("part"), 0.35).otherwise(0.0)) + F.coalesce("importance", F.lit(5)) / 20.0 + F.coalesce(F.col("quality_score").cast("double"), F.lit(0.5)) / 500.0
    found = rows.select("serial_id", "hit", rank.alias("rank")).checkpoint()
    sums = found.agg(F.count_if("hit").alias("hits"), F.count("*").alias("all")).first()
    if sums["hits"] >= most + offset:
        found = found.where("hit")
    total = sums["hits"] if sums["hits"] >= most + offset else sums["all"]
    return found.select("serial_id", "rank", F.lit(total).cast("bigint").alias("total")).orderBy(F.desc("rank"), "serial_id").offset(offset).limit(most)


def hybrid(thoughts: DataFrame, query: str, embedding: Sequence[float] | None, most: int = 20, classification: str | None = None, threshold: float = 0.15) -> DataFrame:
    """Rows by vector similarity, or where there is no vector for the query those that hold it as a
    substring (newest first); with the mode."""
    rows = thoughts if classification is None else thoughts.where(F.col("classification") == classification)
    if embedding is not None:
        return match(rows, embedding, threshold, most).withColumn("mode", F.lit("semantic"))
    found = rows.where(F.col("content").ilike(f"%{query}%"))
    return found.orderBy(F.desc("created_at"), F.desc("serial_id")).limit(most).withColumn("similarity", F.lit(None).cast("double")).withColumn("mode", F.lit("text"))


def page(rows: DataFrame, order: list[Column], number: int, per_page: int) -> DataFrame:
    """A page (from 1) of the rows, with the total of all."""
    total = F.broadcast(rows.agg(F.count("*").alias("total")))  # one row
    per_page = max(1, min(per_page, 30_000))
    return rows.orderBy(*order).offset((max(1, number) - 1) * per_page).limit(per_page).crossJoin(total)


def duplicate_in_source(thoughts: DataFrame, query: Sequence[float], source: str, threshold: float = 0.92) -> DataFrame:
    """The most similar row of the same source, if it is similar enough."""
    return match(thoughts.where(F.col("source_type") == source), query, threshold, 1, strict=False)


def match_memories(memories: DataFrame, query: Sequence[float], workspace: str, project: str | None = None, threshold: float = 0.25, most: int = 20) -> DataFrame:
    """The most similar memories of a workspace (and project)."""
    rows = memories.where(F.col("workspace_id") == workspace)
    rows = rows if project is None else rows.where(F.col("project_id") == project)
    return match(rows.withColumn("serial_id", F.col("id")), query, threshold, most)


def memory_list(memories: DataFrame, workspace: str, most: int = 50, task_prefix: str | None = None, **equal: str | None) -> DataFrame:
    """Memories of a workspace, newest first, by the columns given and a prefix of the task."""
    rows = memories.where(F.col("workspace_id") == workspace)
    for column, value in equal.items():
        rows = rows.where(equal_if(F.col(column), value))
    if task_prefix:
        rows = rows.where(F.col("task_id").startswith(task_prefix))
    return rows.orderBy(F.desc("created_at"), "id").limit(max(1, min(most, 200)))


def review_queue(memories: DataFrame, workspace: str, project: str | None = None) -> DataFrame:
    return memory_list(memories, workspace, 100, project_id=project, review_status="pending")


def recall_trace(traces: DataFrame, items: DataFrame, memories: DataFrame, request_id) -> DataFrame:
    """The items of one recall in order of rank, with their memories."""
    own = traces.where(F.col("request_id") == request_id).select("trace_id", "request_id")
    return items.join(F.broadcast(own.limit(1)), "trace_id").join(memories.withColumnRenamed("id", "memory_id"), "memory_id", "left").orderBy("rank", "memory_id")  # one trace


# ---- reports ----------------------------------------------------------------------------------

#: Sources that capture without being asked.
AUTOMATIC_SOURCES = ("mcp-fieldy-auto", "mcp-fieldy-pending", "mcp-plaud")


def capture_review(thoughts: DataFrame, as_of: datetime, hours: int = 24, most: int = 50, sources: tuple[str, ...] = AUTOMATIC_SOURCES) -> DataFrame:
    """What was captured automatically in the last hours, newest first."""
    rows = thoughts.where(within_hours(F.col("created_at"), as_of, hours) & F.col("source_type").isin(*sources))
    return rows.orderBy(F.desc("created_at"), F.desc("serial_id")).limit(most)


def action_items(thoughts: DataFrame, as_of: datetime, hours: int = 168, most: int = 30, classification: str | None = None) -> DataFrame:
    """Action items of the newest thoughts that have any, one a row, in order."""
    rows = thoughts.where(within_hours(F.col("created_at"), as_of, hours) & F.coalesce(F.size("action_items") > 0, F.lit(False)))
    rows = rows if classification is None else rows.where(F.col("classification") == classification)
    few = rows.orderBy(F.desc("created_at"), F.desc("serial_id")).limit(most)
    return few.select("serial_id", "created_at", F.posexplode("action_items").alias("nth", "item"))


def pending_review(thoughts: DataFrame, most: int = 50) -> DataFrame:
    return thoughts.where("review_status = 'pending_review'").orderBy(F.desc("created_at"), F.desc("serial_id")).limit(most)


def context_brief(thoughts: DataFrame, links: DataFrame, entities: DataFrame, pages: DataFrame, as_of: datetime, hours: int = 48, classification: str | None = None) -> DataFrame:
    """What a session starts from, as rows (section, rank, key, label): open cards, recent captures,
    entities of those, action items and the pages written last."""
    rows = thoughts if classification is None else thoughts.where(F.col("classification") == classification)
    fresh = rows.where(within_hours(F.col("created_at"), as_of, hours))
    newest = [F.desc("created_at"), F.desc("serial_id")]

    def section(df: DataFrame, name: str, order: list[Column], n: int, key: str, label: Column) -> DataFrame:
        few = df.orderBy(*order).limit(n)
        return few.select(F.lit(name).alias("section"), F.row_number().over(Window.orderBy(*order)).alias("rank"), F.col(key).cast("string").alias("key"), label.alias("label"))  # a few rows

    short = F.substring("content", 1, 100)
    cards = section(rows.where(F.col("status").isin("active", "planning") & F.col("type").isin("task", "idea")), "cards", [F.desc("importance"), F.desc("serial_id")], 15, "serial_id", short)
    recent = section(fresh, "recent", newest, 8, "serial_id", short)
    mentioned = graph.recent_entities(links, fresh.withColumn("id", F.col("serial_id")), entities)
    named = section(mentioned, "entities", [F.desc("n"), F.asc("entity_id")], 6, "entity_id", F.col("name"))
    todo = action_items(fresh, as_of, hours, 20)
    todo = section(todo, "actions", [*newest, F.asc("nth")], 10, "serial_id", F.col("item"))
    wiki = section(pages, "pages", [F.desc("generated_at"), F.asc("slug")], 4, "slug", F.col("title"))
    return cards.union(recent).union(named).union(todo).union(wiki)


def search_entities(entities: DataFrame, query: str, pages: DataFrame | None = None, most: int = 100) -> DataFrame:
    """Entities whose name or an alias holds the query; with ``pages`` only those without a page."""
    like = f"%{query}%"
    rows = entities.where(F.col("name").ilike(like) | F.exists("aliases", lambda a: a.ilike(like)))
    if pages is not None:
        rows = rows.join(pages.select(F.col("entity_id").alias("id")), "id", "left_anti")
    return rows.orderBy("name", "id").limit(most)


def similar_pairs(vectors_: DataFrame, least: float, cell: int = 2048, sample: int = 8192) -> DataFrame:
    """All pairs of rows (id, embedding) with cosine of at least ``least``, as a, b, similarity.

    Exact join with metric pruning. Pivots are rows of a bounded sample, about one for ``cell`` rows;
    a row belongs to the cell of its nearest pivot. Angles obey the triangle inequality, so a row can
    have partners in another cell only if its angle to that pivot, less the cell's radius, is within
    the threshold's angle, and if it is not too far beyond the border between both pivots. Rows meet
    those cells of higher number only; each cell compares its own rows, and its visitors with them.
    Cells travel together in regions, and a task compares two of them; large cells are several. Ids must be unique. Rows whose vector is null,
    zero or not finite match nothing; vectors of different lengths do not match each other.

    Pruning depends on the data: clustered vectors skip most pairs of cells, evenly spread ones in many
    dimensions none; then every row meets every cell, as any exact join must."""
    e = F.col("embedding")
    sound = F.forall(e, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.exists(e, lambda x: x != 0)
    rows = vectors_.where(F.coalesce(sound, F.lit(False))).select(F.col("id").cast("bigint").alias("id"), F.transform(e, lambda x: x.cast("double")).alias("v"), F.size(e).alias("dims"))
    found = None
    for dims, n in sorted((r.dims, r["count"]) for r in rows.groupBy("dims").count().collect()):  # the few lengths of the vectors
        pairs = metric.join_cells(rows.where(F.col("dims") == dims).select("id", "v"), least, n, cell, sample)
        found = pairs if found is None else found.unionByName(pairs)
    return vectors_.sparkSession.createDataFrame([], metric.PAIRS) if found is None else found


def recall(memories: DataFrame, query: Sequence[float], scope: dict, most: int = 10, threshold: float = 0.25) -> DataFrame:
    """Memories in scope by recall rank: candidates are the most similar ones, at least twenty; where
    none is similar, the newest hundred."""
    candidates = memories.withColumn("similarity", vectors.cosine_to(F.col("embedding"), query))
    near = candidates.where(F.col("similarity") > threshold).orderBy(F.desc("similarity"), "id").limit(max(20, 4 * most))
    if not near.limit(1).count():
        near = memories.orderBy(F.desc("created_at"), "id").limit(100).withColumn("similarity", F.lit(0.0))
    row = {c: F.col(c) for c in memories.columns}
    ranked = near.where(in_scope(row, **scope)).withColumn("score", memory_score(row, F.col("similarity")))
    return ranked.orderBy(F.desc("score"), "id").limit(most)


def reconcile(items: DataFrame, known: DataFrame, skip: float = 0.92, near: float = 0.85) -> DataFrame:
    """item and action for each ingested item (item, content, similarity and length of its best match):
    duplicates within the batch and known fingerprints are skipped, then similarity decides. Texts
    are fingerprinted where they lie and do not travel."""
    rows = items.select("item", text.fingerprint(F.col("content")).alias("fingerprint"), F.char_length("content").alias("length"), "similarity", "match_length")
    old = known.select(F.col("fingerprint"), F.lit(True).alias("known")).distinct()
    rows = rows.withColumn("first", F.min("item").over(Window.partitionBy("fingerprint"))).join(old, "fingerprint", "left")
    return rows.select("item", route(F.col("item") != F.col("first"), F.coalesce("known", F.lit(False)), F.col("similarity"), F.col("match_length"), F.col("length"), skip, near).alias("action"))


def route(repeated: Column, known: Column, similarity: Column, old_length: Column, new_length: Column, skip: float = 0.92, near: float = 0.85) -> Column:
    return (
        F.when(repeated, "skip").when(known, "skip").when(similarity > skip, "skip")
        .when((similarity >= near) & (old_length >= new_length), "append_evidence").when(similarity >= near, "create_revision").otherwise("add")
    )


def quality_gate(content: Column, importance: Column, least: int = 30, important: int = 3) -> Column:
    """Why an item is not ingested, or null."""
    return F.when(F.char_length(text.trimmed(content)) < least, "too_short").when(importance < important, "low_importance")


def memory_rows(payloads: DataFrame) -> DataFrame:
    """Rows of a write-back: lists by kind become typed memories with key and hash."""
    #: Payload list -> memory type and prefix.
    kinds = [("decisions", "decision", ""), ("outputs", "output", ""), ("lessons", "lesson", ""), ("constraints", "constraint", ""), ("unresolved_questions", "open_question", ""), ("next_steps", "work_log", "Next step: "), ("failures", "failure", "")]

    def typed(column: str, kind: str, prefix: str) -> Column:
        return F.transform(F.coalesce(F.col(column), F.array().cast("array<string>")), lambda v: F.struct(F.lit(kind).alias("memory_type"), F.concat(F.lit(prefix), v).alias("content")))

    lists = [typed(*k) for k in kinds if k[0] in payloads.columns]
    rows = payloads.select("base_key", F.posexplode(F.concat(*lists)).alias("index", "m")).select("base_key", "index", "m.*")
    return rows.withColumn("idempotency_key", F.concat_ws(":", "base_key", "index")).withColumn("content_hash", F.sha2(F.concat_ws(":", "memory_type", "content"), 256))
