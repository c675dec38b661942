"""The write side: keyed upserts as folds over ordered events, merges and maintained views.

Tables are snapshots; every function returns the new snapshot. Map merges are shallow, new keys win.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import graph

#: Relations without a direction.
SYMMETRIC = ("co_occurs_with", "related_to", "collaborates_with", "integrates_with", "alternative_to", "knew", "friend_of", "family_of")


def merged(old: Column, new: Column) -> Column:
    """Shallow merge of two maps: keys of ``new`` win; a null map is empty."""
    kept = F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k))
    return F.when(new.isNull(), old).when(old.isNull(), new).otherwise(F.map_concat(kept, new))


def upsert_thoughts(events: DataFrame) -> DataFrame:
    """Fold of upserts (seq, content, metadata map, embedding, at) by content fingerprint: content
    and creation of the first, metadata merged in order, the last embedding that is not null."""
    rows = events.withColumn("fingerprint", text.fingerprint(F.col("content")))
    last = F.max_by(F.col("embedding"), F.when(F.col("embedding").isNotNull(), F.col("seq")))
    out = rows.groupBy("fingerprint").agg(F.min_by("content", "seq").alias("content"), F.count("metadata").alias("maps"), last.alias("embedding"), F.min("at").alias("created_at"), F.max("at").alias("updated_at"), F.count("*").alias("writes"))
    # the last value of every key: writes meet by content and key, and only what is left makes a map
    keys = rows.select("fingerprint", "seq", F.explode("metadata")).groupBy("fingerprint", "key").agg(F.max_by("value", F.struct("seq")).alias("value"))
    maps = keys.groupBy("fingerprint").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("metadata"))
    none = F.create_map().cast(dict(events.dtypes)["metadata"])
    metadata = F.when(F.col("maps") > 0, F.coalesce("metadata", none)).alias("metadata")
    return out.join(maps, "fingerprint", "left").select("fingerprint", "content", metadata, "embedding", "created_at", "updated_at", "writes")


def fold_typed_edges(events: DataFrame) -> DataFrame:
    """Fold of edge writes by (from, to, relation): support adds up, the greatest confidence, an
    open end stays open, the earliest start, the last version."""
    until = F.when(F.count_if(F.col("valid_until").isNull()) > 0, None).otherwise(F.max("valid_until"))
    return events.groupBy("from_id", "to_id", "relation").agg(F.sum("support").alias("support"), F.max("confidence").alias("confidence"), until.alias("valid_until"), F.min("valid_from").alias("valid_from"), F.max_by("version", "seq").alias("version"))


def fold_entity_edges(events: DataFrame, symmetric: tuple[str, ...] = SYMMETRIC) -> DataFrame:
    """Edges counted by their normal form: symmetric relations are ordered by id."""
    even = F.col("relation").isin(*symmetric)
    a = F.when(even, F.least("from_id", "to_id")).otherwise(F.col("from_id"))
    b = F.when(even, F.greatest("from_id", "to_id")).otherwise(F.col("to_id"))
    return events.where("from_id <> to_id").groupBy(a.alias("from_id"), b.alias("to_id"), "relation").agg(F.count("*").alias("support"), F.max("confidence").alias("confidence"))


def fold_entities(mentions: DataFrame) -> DataFrame:
    """Entities by type and normal name: the first spelling, all spellings, first and last time."""
    rows = mentions.withColumn("normalized_name", text.normal_name(F.col("name")))
    return rows.groupBy("entity_type", "normalized_name").agg(F.min_by("name", F.struct("at", "name")).alias("canonical_name"), F.array_sort(F.collect_set("name")).alias("aliases"), F.min("at").alias("first_seen_at"), F.max("at").alias("last_seen_at"))


def resolve_entities(mentions: DataFrame, entities: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """mention, entity_id by the first rule that fits: exact alias, alias in lower case, normal name
    of any type, normal name without a generic ending; null for new ones. Blocked names go."""
    generic = r" (inc|llc|ltd|corp|co|company|app|project|team|group)$"
    norm = text.normal_name(F.col("name"))
    rows = mentions.select("mention", "name", norm.alias("norm"), F.regexp_replace(norm, generic, "").alias("bare"))
    if blocked is not None:
        rows = rows.join(blocked.select(F.lower("name").alias("norm")), "norm", "left_anti")
    alias = entities.select("id", F.explode(F.array_append("aliases", F.col("name"))).alias("alias"))
    own = text.normal_name(F.col("name"))

    def first(keys: DataFrame, key: str, out: str) -> DataFrame:
        return keys.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("id").alias(out))

    rows = rows.join(first(alias.withColumn("name", F.col("alias")), "name", "by_alias"), "name", "left")
    rows = rows.join(first(alias.select("id", F.lower("alias").alias("norm")), "norm", "by_lower"), "norm", "left")
    rows = rows.join(first(entities.select("id", own.alias("norm")), "norm", "by_norm"), "norm", "left")
    rows = rows.join(first(entities.select("id", F.regexp_replace(own, generic, "").alias("bare")), "bare", "by_bare"), "bare", "left")
    return rows.select("mention", "name", F.coalesce("by_alias", "by_lower", "by_norm", "by_bare").alias("entity_id"))


def edge_support(evidence: DataFrame, pinned: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges as evidence has them; those without any stay, at support 0, if an end is pinned."""
    keys = ["from_entity_id", "to_entity_id", "relation"]
    have = evidence.groupBy(*keys).agg(F.count("*").alias("support_count"), F.max("confidence").alias("confidence"))
    gone = edges.select(*keys).distinct().join(have, keys, "left_anti")
    ends = pinned.select(F.col("id").alias("end")).distinct()
    held = gone.join(ends, gone.from_entity_id == F.col("end"), "left_semi").union(gone.join(ends, gone.to_entity_id == F.col("end"), "left_semi")).distinct()
    return have.unionByName(held.select(*keys, F.lit(0).cast("bigint").alias("support_count"), F.lit(None).cast(dict(evidence.dtypes)["confidence"]).alias("confidence")))


def auto_pin(entities: DataFrame, links: DataFrame, threshold: int = 5) -> DataFrame:
    """Entities with enough links are pinned; those pinned automatically lose it below."""
    n = links.groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("n"))
    rows = entities.join(n, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    enough, auto = F.col("n") >= threshold, F.coalesce(F.col("pin_source") == "auto", F.lit(False))
    pinned = F.when(F.col("pinned") & ~auto, True).otherwise(enough)
    source = F.when(F.col("pinned") & ~auto, F.col("pin_source")).when(enough, F.lit("auto"))
    return rows.withColumns({"pinned": pinned, "pin_source": source})


def merge_entities(mapping: DataFrame, links: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links and edges after entities (loser, winner) are merged: redirected, without loops and
    repeats; of equal edges the best supported one stays."""
    to = lambda c: F.coalesce("winner", c)
    m = mapping.select("loser", "winner")
    new_links = links.join(m, links.entity_id == m.loser, "left").select("thought_id", to("entity_id").alias("entity_id")).distinct()
    a = edges.join(m, edges.from_entity_id == m.loser, "left").withColumn("from_entity_id", to("from_entity_id")).drop("loser", "winner")
    b = a.join(m, a.to_entity_id == m.loser, "left").withColumn("to_entity_id", to("to_entity_id")).drop("loser", "winner")
    return new_links, b.where("from_entity_id <> to_entity_id").groupBy("from_entity_id", "to_entity_id", "relation").agg(F.max("support_count").alias("support_count"))


def loose_groups(entities: DataFrame) -> DataFrame:
    """id, keeper: entities that a chain of equal loose names or aliases joins, with the chain's
    smallest id; a keeper is never itself merged away."""
    names = entities.select("id", F.explode(F.array_append("aliases", F.col("name"))).alias("n")).select("id", text.loose_name(F.col("n")).alias("n")).where("n <> ''").distinct()
    first = names.groupBy("n").agg(F.min("id").alias("b"), F.count("*").alias("c")).where("c > 1")
    pairs = names.join(first, "n").where("id <> b").select(F.col("id").alias("a"), "b").distinct()
    return graph.components(pairs).where("node <> root").select(F.col("node").alias("id"), F.col("root").alias("keeper"))


def merged_clusters(entities: DataFrame, clusters: DataFrame, links: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """Tables after all clusters (node, root) are merged at once: entities with the losers' names as
    aliases, links, edges, and the losers' names to block."""
    mapping = clusters.where("node <> root").select(F.col("node").alias("loser"), F.col("root").alias("winner"))
    lost = mapping.join(entities.select(F.col("id").alias("loser"), "name", "aliases"), "loser")
    more = lost.select("winner", F.explode(F.array_append("aliases", F.col("name"))).alias("alias")).groupBy("winner").agg(F.array_sort(F.collect_set("alias")).alias("more"))
    kept = entities.join(mapping.select(F.col("loser").alias("id")), "id", "left_anti").join(more.withColumnRenamed("winner", "id"), "id", "left")
    kept = kept.withColumn("aliases", F.array_union("aliases", F.coalesce("more", F.array().cast("array<string>")))).drop("more")
    new_links, new_edges = merge_entities(mapping, links, edges)
    return {"entities": kept, "links": new_links, "edges": new_edges, "blocked": lost.select("name").distinct()}


def revise(thoughts: DataFrame, patches: DataFrame, at: datetime) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New thoughts, archived old versions, and ids to queue again, for patches (id, content, status).

    New content raises the version and archives the old row; only a new fingerprint queues it."""
    rows = thoughts.join(patches.select("id", F.col("content").alias("new"), F.col("status").alias("new_status"), F.lit(True).alias("patched")), "id", "left")
    changed = F.coalesce(F.col("new").isNotNull() & ~F.col("new").eqNullSafe(F.col("content")), F.lit(False))
    moved = F.coalesce(F.col("new_status").isNotNull() & ~F.col("new_status").eqNullSafe(F.col("status")), F.lit(False))
    old = rows.where(changed).select("id", "version", "content", F.lit(at).alias("archived_at"))
    requeue = rows.where(changed & (text.fingerprint(F.col("new")) != text.fingerprint(F.col("content")))).select("id")
    new = rows.select("id", F.when(changed, F.col("new")).otherwise(F.col("content")).alias("content"), (F.col("version") + changed.cast("int")).alias("version"), F.coalesce("new_status", "status").alias("status"), F.when(moved, F.lit(at)).otherwise(F.col("status_updated_at")).alias("status_updated_at"))
    return new, old, requeue


def enqueue(changes: DataFrame, queue: DataFrame) -> DataFrame:
    """Queue entries after changes (id, content, generated_by): generated rows are skipped, known
    ones come back only with another fingerprint, and then with no attempts counted."""
    new = changes.where("generated_by IS NULL").select(F.col("id").alias("thought_id"), text.fingerprint(F.col("content"), "md5").alias("print"))
    both = queue.join(new, "thought_id", "full")
    again = F.col("print").isNotNull() & ~F.col("print").eqNullSafe(F.col("source_fingerprint"))
    return both.select("thought_id", F.when(again, "pending").otherwise(F.col("status")).alias("status"), F.when(again, 0).otherwise(F.col("attempt_count")).alias("attempt_count"), F.when(again, F.col("print")).otherwise(F.col("source_fingerprint")).alias("source_fingerprint"))


def without_blocked(rows: DataFrame, blocked: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(blocked.select(*on).distinct(), on, "left_anti")


def last_inserted(logs: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The value of the row inserted last, not of the latest date."""
    return logs.groupBy(key).agg(F.max_by(value, order).alias(value))


def next_due(tasks: DataFrame, logs: DataFrame) -> DataFrame:
    done = last_inserted(logs, "task_id", "completed_at", "seq").withColumnRenamed("completed_at", "last_completed")
    due = F.col("last_completed") + F.make_dt_interval(F.col("frequency_days"))
    return tasks.join(done, "task_id", "left").withColumn("next_due", F.when(F.col("last_completed").isNull(), F.col("next_due")).when(F.col("frequency_days").isNotNull(), due))


def learned_thresholds(outcomes: DataFrame, start: float = 0.75, step: float = 0.02, low: float = 0.5, high: float = 0.95, block: int = 10_000) -> DataFrame:
    """Threshold by type after ordered outcomes: accepted lowers it, rejected raises it, clamped.

    Clamped steps compose: any run of them is again a shift between two bounds. Runs of ``block``
    sequence numbers are folded apart, then a type's runs, so a large type is many groups."""
    clamp = lambda x: F.greatest(F.lit(low), F.least(F.lit(high), x))
    run = lambda c, a, b: F.struct(c.alias("c"), a.alias("a"), b.alias("b"))
    none = run(F.lit(0.0), F.lit(-1e9), F.lit(1e9))
    moves = F.transform(F.array_sort(F.collect_list(F.struct("seq", "accepted"))), lambda s: F.when(s["accepted"], -step).otherwise(step))
    runs = outcomes.groupBy("type", F.floor(F.col("seq") / block).alias("block")).agg(
        F.aggregate(moves, none, lambda r, d: run(r["c"] + d, clamp(r["a"] + d), clamp(r["b"] + d))).alias("run"), F.count("*").alias("n")
    )
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("block", "run"))), lambda s: s["run"])
    final = F.aggregate(ordered, F.lit(start), lambda t, r: F.least(r["b"], F.greatest(r["a"], t + r["c"])))
    return runs.groupBy("type").agg(final.alias("threshold"), F.sum("n").alias("samples"))


def purge(entities: DataFrame, links: DataFrame, pages: DataFrame, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """Pages to drop (entities with fewer than ``least`` links left; edited ones stay) and entities
    without any link."""
    n = links.groupBy("entity_id").agg(F.count("*").alias("n"))
    weak = pages.join(n, "entity_id", "left").where((F.coalesce("n", F.lit(0)) < least) & ~F.coalesce("manually_edited", F.lit(False)) & F.col("notes").isNull())
    return weak.select("slug"), entities.join(n, entities.id == n.entity_id, "left_anti").select("id")


def after_deletion(deleted: DataFrame, links: DataFrame, thoughts: DataFrame, pages: DataFrame, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """For the entities that deleted thoughts (thought_id) linked: pages to drop, as fewer than
    ``least`` links are left, and the newest thought of each other one, to be queued again."""
    gone = deleted.select("thought_id").distinct()
    touched = links.join(gone, "thought_id", "left_semi").select("entity_id").distinct()
    left = links.join(touched, "entity_id", "left_semi").join(gone, "thought_id", "left_anti").join(thoughts.select(F.col("id").alias("thought_id"), "created_at"), "thought_id")
    left = left.groupBy("entity_id").agg(F.count("*").alias("n"), F.max_by("thought_id", F.struct("created_at", "thought_id")).alias("newest"))
    state = touched.join(left, "entity_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return pages.join(state.where(F.col("n") < least), "entity_id", "left_semi").select("slug"), state.where(F.col("n") >= least).select("entity_id", F.col("newest").alias("thought_id"))


def stale_citations(pages: DataFrame, thoughts: DataFrame) -> DataFrame:
    """Citations of thoughts that are gone."""
    cited = pages.select("slug", F.explode(text.citations(F.col("content"))).alias("serial_id"))
    return cited.join(thoughts.select("serial_id"), "serial_id", "left_anti")


def upgraded_tiers(thoughts: DataFrame) -> DataFrame:
    """Tiers of rows without one or at standard, raised where the content asks for it."""
    open_ = F.col("sensitivity_tier").isNull() | (F.col("sensitivity_tier") == "standard")
    found = text.sensitivity_tier(F.coalesce("content", F.lit("")))
    return thoughts.withColumn("sensitivity_tier", F.when(open_ & (found != "standard"), found).otherwise(F.col("sensitivity_tier")))


#: What a review action sets; a null leaves the column as it is.
REVIEW_RULES = {
    "confirm": {"review_status": "confirmed", "provenance_status": "user_confirmed", "can_use_as_instruction": True, "requires_user_confirmation": False},
    "evidence_only": {"review_status": "evidence_only", "can_use_as_instruction": False, "can_use_as_evidence": True, "requires_user_confirmation": False},
    "reject": {"review_status": "rejected", "lifecycle_status": "rejected", "can_use_as_instruction": False, "can_use_as_evidence": False},
    "mark_stale": {"review_status": "stale", "lifecycle_status": "stale", "can_use_as_instruction": False},
    "dispute": {"lifecycle_status": "disputed", "provenance_status": "disputed", "can_use_as_instruction": False},
    "restrict_scope": {"review_status": "restricted", "visibility": "personal"},
    "edit": {},
}
REVIEW_EVENTS = {"confirm": "memory_confirmed", "edit": "memory_edited", "reject": "memory_rejected", "supersede": "memory_superseded", "dispute": "memory_disputed"}
REVIEW_RELATIONS = {"merge": "merged_into", "supersede": "supersedes"}
REVIEWED = ("review_status", "lifecycle_status", "provenance_status", "visibility", "can_use_as_instruction", "can_use_as_evidence", "requires_user_confirmation")


def reviewed(memories: DataFrame, actions: DataFrame) -> DataFrame:
    """Memories after review actions (id, action, and content to edit); one action a memory."""
    rows = memories.join(actions.select("id", "action", F.col("content").alias("new")), "id", "left")
    for name in REVIEWED:
        sets = {a: v[name] for a, v in REVIEW_RULES.items() if name in v}
        rows = rows.withColumn(name, F.coalesce(*[F.when(F.col("action") == a, F.lit(v)) for a, v in sets.items()], F.col(name)))
    edited = F.when(F.col("action") == "edit", F.col("new"))
    return rows.withColumn("content", F.coalesce(edited, "content")).drop("action", "new")


def review_log(memories: DataFrame, actions: DataFrame) -> DataFrame:
    """One row for each action: the state before and after as JSON, the audit event, and for merges
    and replacements the relation to the other memory (related_id)."""
    state = F.to_json(F.struct(*REVIEWED))
    both = memories.select("id", state.alias("before")).join(reviewed(memories, actions).select("id", state.alias("after")), "id")
    pick = lambda table, rest: F.coalesce(*[F.when(F.col("action") == a, F.lit(v)) for a, v in table.items()], rest)
    relation = F.when(F.col("related_id").isNotNull(), pick(REVIEW_RELATIONS, F.lit(None).cast("string")))
    return both.join(actions, "id").select("id", "action", "before", "after", pick(REVIEW_EVENTS, F.lit("memory_edited")).alias("event"), "related_id", relation.alias("relation"))
