"""Queries of the write side and of joins: the plan and its SQL, side by side."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import curation, domains, search, upsert
from ..streaming import changes, keyed
from . import views
from .queries import _FULL, query
from .stored import checkpointing, scratch
from .views import EDGES_SQL, ENTITY_THOUGHTS_SQL, LINKS_SQL, NOTES_SQL, table

def _entities(spark, d):
    """Suppliers whose names clash loosely: several share a name but for case, dashes and marks."""
    rows = table(spark, d, "supplier")
    name = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("Unit-"), F.col("s_suppkey") % 4)).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("unit "), F.col("s_suppkey") % 4, F.lit("!"))).otherwise(F.concat(F.lit("Other "), F.col("s_suppkey")))
    return rows.select(F.col("s_suppkey").alias("id"), name.alias("name"), F.array(F.concat(F.lit("a"), F.floor(F.col("s_suppkey") / 2).cast("bigint"))).alias("aliases"), F.when(F.col("s_suppkey") % 2 == 0, "tool").otherwise("person").alias("entity_type"))


_NAME = "CASE s_suppkey % 3 WHEN 0 THEN 'Unit-' || s_suppkey % 4 WHEN 1 THEN 'unit ' || s_suppkey % 4 || '!' ELSE 'Other ' || s_suppkey END"
_ENTS = f"ents AS (SELECT s_suppkey AS id, {_NAME} AS name, ['a' || s_suppkey // 2] AS aliases, CASE WHEN s_suppkey % 2 = 0 THEN 'tool' ELSE 'person' END AS entity_type FROM supplier)"
_LOOSE_KEY = "rtrim(regexp_replace(lower({c}), '[\\s\\-_]+', ' ', 'g'), '.,;!?')"
_CLUSTERS = f"""{_ENTS}, keys AS (SELECT DISTINCT id, {_LOOSE_KEY.format(c='n')} AS k FROM (SELECT id, unnest(list_append(aliases, name)) AS n FROM ents)),
near AS (SELECT DISTINCT x.id AS a, y.id AS b FROM keys x JOIN keys y ON x.k = y.k), walk AS (SELECT id AS a, id AS b FROM ents UNION SELECT w.a, n.b FROM walk w JOIN near n ON n.a = w.b), roots AS (SELECT a AS id, min(b) AS root FROM walk GROUP BY a)"""


# ---- upserts ----------------------------------------------------------------------------------


@query("SELECT user_id % 7 AS id, count(*) AS writes, min(event_id) AS first, arg_max(event_id, event_id) FILTER (event_id % 3 = 0) AS last_vector, arg_max(event_type, event_id) AS kind FROM events GROUP BY 1")
def upsert_keeps_vectors(spark, d):
    """A write without a vector keeps the last one; metadata keys of later writes win."""
    n = F.col("event_id")
    vector = F.when(n % 3 == 0, F.array(n.cast("double")))  # exact beyond 2^24
    rows = table(spark, d, "events").select(n.alias("seq"), F.concat(F.lit("Text "), F.col("user_id") % 7).alias("content"), F.create_map(F.lit("kind"), "event_type", F.concat(F.lit("u"), "user_id"), F.lit("x")).alias("metadata"), vector.alias("embedding"), n.alias("at"))
    out = upsert.upsert_thoughts(rows)
    return out.select(F.regexp_extract("content", "([0-9]+)", 1).cast("bigint").alias("id"), "writes", F.col("created_at").alias("first"), F.col("embedding")[0].cast("bigint").alias("last_vector"), F.col("metadata")["kind"].alias("kind"))


@query("SELECT 'user ' || user_id AS normalized_name, string_agg(DISTINCT CASE WHEN event_id % 2 = 0 THEN 'USER  ' ELSE 'User ' END || user_id, '|' ORDER BY CASE WHEN event_id % 2 = 0 THEN 'USER  ' ELSE 'User ' END || user_id) AS aliases FROM events GROUP BY user_id")
def entity_spellings(spark, d):
    name = F.concat(F.when(F.col("event_id") % 2 == 0, "USER  ").otherwise("User "), "user_id")
    rows = upsert.fold_entities(table(spark, d, "events").select(F.lit("person").alias("entity_type"), name.alias("name"), F.col("ts").alias("at")))
    return rows.select("normalized_name", F.array_join("aliases", "|").alias("aliases"))


@query("SELECT l_partkey AS from_id, l_suppkey AS to_id, max('v' || lpad((l_orderkey * 10 + l_linenumber)::VARCHAR, 12, '0')) AS version FROM lineitem GROUP BY ALL")
def edge_versions(spark, d):
    seq = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    rows = table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("from_id"), F.col("l_suppkey").alias("to_id"), F.lit("r").alias("relation"), F.lit(1).alias("support"), F.lit(0.5).alias("confidence"),
        F.lit(None).cast("timestamp").alias("valid_until"), F.lit(None).cast("timestamp").alias("valid_from"), F.concat(F.lit("v"), F.lpad(seq.cast("string"), 12, "0")).alias("version"), seq.alias("seq"),
    )
    return upsert.fold_typed_edges(rows).select("from_id", "to_id", "version")


_SYM = ", ".join(f"'{r}'" for r in upsert.SYMMETRIC)


@query(f"""WITH r AS (SELECT l_suppkey AS f, l_partkey % 37 AS t, ['co_occurs_with', 'related_to', 'collaborates_with', 'integrates_with', 'alternative_to', 'knew', 'friend_of', 'family_of', 'uses', 'works_with'][1 + l_orderkey % 10] AS relation FROM lineitem WHERE l_suppkey <> l_partkey % 37)
SELECT relation, CASE WHEN relation NOT IN ('uses', 'works_with') AND t < f THEN t ELSE f END AS from_id, CASE WHEN relation NOT IN ('uses', 'works_with') AND t < f THEN f ELSE t END AS to_id, count(*) AS support FROM r GROUP BY ALL""")
def symmetric_edges(spark, d):
    kinds = ("co_occurs_with", "related_to", "collaborates_with", "integrates_with", "alternative_to", "knew", "friend_of", "family_of", "uses", "works_with")
    relation = F.element_at(F.array(*map(F.lit, kinds)), (1 + F.col("l_orderkey") % 10).cast("int"))
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("from_id"), (F.col("l_partkey") % 37).alias("to_id"), relation.alias("relation"), F.lit(1.0).alias("confidence"))
    return upsert.fold_entity_edges(rows).select("relation", "from_id", "to_id", "support")


@query("""WITH e AS (SELECT s_suppkey AS id, s_name AS name, 'alias ' || s_suppkey AS alias FROM supplier),
m AS (SELECT c_custkey AS mention, 1 + c_custkey % 40 AS k, CASE c_custkey % 5 WHEN 0 THEN 'alias ' || 1 + c_custkey % 40 WHEN 1 THEN 'ALIAS ' || 1 + c_custkey % 40 WHEN 2 THEN (SELECT upper(name) FROM e WHERE id = 1 + c_custkey % 7) || '  Inc' WHEN 3 THEN 'blocked' ELSE 'new ' || c_custkey END AS name FROM customer)
SELECT mention, CASE mention % 5 WHEN 2 THEN 1 + mention % 7 WHEN 4 THEN NULL ELSE (SELECT id FROM e WHERE id = k) END AS entity_id FROM m WHERE name <> 'blocked'""")
def resolve_entities(spark, d):
    """Mentions by alias, alias in other case, name with a generic ending, blocked, new."""
    n, named = F.col("c_custkey"), views.entities(spark, d).select("id", "name")
    entities = named.withColumn("aliases", F.array(F.concat(F.lit("alias "), F.col("id"))))
    rows = table(spark, d, "customer").join(named.withColumnRenamed("id", "own"), F.col("own") == 1 + n % 7)
    name = F.when(n % 5 == 0, F.concat(F.lit("alias "), 1 + n % 40)).when(n % 5 == 1, F.concat(F.lit("ALIAS "), 1 + n % 40)).when(n % 5 == 2, F.concat(F.upper("name"), F.lit("  Inc"))).when(n % 5 == 3, "blocked").otherwise(F.concat(F.lit("new "), n))
    blocked = spark.createDataFrame([("Blocked",)], "name string")
    return upsert.resolve_entities(rows.select(n.alias("mention"), name.alias("name")), entities, blocked).select("mention", "entity_id")


@query(f"WITH {NOTES_SQL} SELECT id, CASE WHEN id % 3 = 0 THEN 'reviewed' ELSE 'draft' END AS state, CASE WHEN id % 3 = 0 THEN 'bob' END AS reviewer, 'kept' AS origin FROM notes")
def merge_metadata(spark, d):
    new = F.when(F.col("id") % 3 == 0, F.create_map(F.lit("state"), F.lit("reviewed"), F.lit("by"), F.lit("bob")))
    rows = views.notes(spark, d).select("id", upsert.merged(F.create_map(F.lit("state"), F.lit("draft"), F.lit("origin"), F.lit("kept")), new).alias("m"))
    return rows.select("id", F.col("m")["state"].alias("state"), F.col("m")["by"].alias("reviewer"), F.col("m")["origin"].alias("origin"))


@query(f"""WITH {NOTES_SQL} SELECT id AS thought_id, CASE WHEN id % 3 = 1 THEN 'complete' ELSE 'pending' END AS status, CASE WHEN id % 3 = 1 THEN 2 ELSE 0 END AS attempt_count FROM notes WHERE generated_by IS NULL""")
def enqueue_changes(spark, d):
    """Known and unchanged, known and changed, and new thoughts; generated ones are left out."""
    rows = views.notes(spark, d).select("id", "content", "generated_by")
    own = text.fingerprint(F.col("content"), "md5")
    queue = rows.where("id % 3 > 0 AND generated_by IS NULL").select(F.col("id").alias("thought_id"), F.lit("complete").alias("status"), F.lit(2).alias("attempt_count"), F.when(F.col("id") % 3 == 1, own).otherwise("old").alias("source_fingerprint"))
    return upsert.enqueue(rows, queue).select("thought_id", "status", "attempt_count")


@query(f"""WITH {LINKS_SQL}, {ENTITY_THOUGHTS_SQL}, t AS (SELECT DISTINCT entity_id FROM links WHERE thought_id % 40 > 0), l AS (SELECT entity_id, count(*) AS n, arg_max(thought_id, (created_at, thought_id)) AS newest FROM links JOIN entity_thoughts ON id = thought_id WHERE thought_id % 40 = 0 GROUP BY entity_id)
SELECT 'drop' AS what, 's-' || s_suppkey AS key FROM supplier JOIN t ON t.entity_id = s_suppkey LEFT JOIN l ON l.entity_id = s_suppkey WHERE coalesce(n, 0) < 20 UNION ALL SELECT 'queue', newest::VARCHAR FROM l JOIN t USING (entity_id) WHERE n >= 20""")
def after_deletion(spark, d):
    links = views.links(spark, d)
    pages = table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity_id"), F.concat(F.lit("s-"), F.col("s_suppkey")).alias("slug"))
    drop, again = upsert.after_deletion(links.where("thought_id % 40 > 0"), links, views.entity_thoughts(spark, d), pages, 20)
    return drop.select(F.lit("drop").alias("what"), F.col("slug").alias("key")).union(again.select(F.lit("queue"), F.col("thought_id").cast("string")))


@query(f"""WITH RECURSIVE {_CLUSTERS} SELECT id, root AS keeper FROM roots WHERE id <> root""")
def loose_groups(spark, d):
    checkpointing(spark)
    return upsert.loose_groups(_entities(spark, d))


@query(f"""WITH RECURSIVE {_CLUSTERS}, {EDGES_SQL} SELECT f.root AS from_entity_id, t.root AS to_entity_id, relation, max(support_count) AS support_count FROM edges JOIN roots f ON f.id = from_entity_id JOIN roots t ON t.id = to_entity_id WHERE f.root <> t.root GROUP BY ALL""")
def merged_edges(spark, d):
    return _merged(spark, d)["edges"]


@query(f"WITH RECURSIVE {_CLUSTERS}, {LINKS_SQL} SELECT DISTINCT thought_id, root AS entity_id FROM links JOIN roots ON id = entity_id")
def merged_links(spark, d):
    return _merged(spark, d)["links"].select("thought_id", "entity_id")


@query(f"""WITH RECURSIVE {_CLUSTERS}, x AS (SELECT root AS id, unnest(CASE WHEN e.id = root THEN aliases ELSE list_append(aliases, name) END) AS alias FROM ents e JOIN roots r ON r.id = e.id) SELECT id, string_agg(DISTINCT alias, ',' ORDER BY alias) AS aliases FROM x GROUP BY id""")
def merged_aliases(spark, d):
    return _merged(spark, d)["entities"].select("id", F.array_join(F.array_sort("aliases"), ",").alias("aliases"))


def _merged(spark, d):
    checkpointing(spark)
    entities = _entities(spark, d)
    clusters = upsert.loose_groups(entities).select(F.col("id").alias("node"), F.col("keeper").alias("root"))
    return upsert.merged_clusters(entities, clusters, views.links(spark, d), views.edges(spark, d))


@query(f"""WITH {NOTES_SQL} SELECT id, CASE WHEN id % 10 = 1 AND EXISTS (SELECT 1 FROM notes p WHERE p.id = notes.id + 1) THEN md5(coalesce((SELECT content FROM notes p WHERE p.id = notes.id + 1), '')) ELSE md5(coalesce(content, '')) END AS content_md5, CASE WHEN id % 10 <> 5 THEN review_status END AS review_status FROM notes WHERE id % 10 <> 2""")
def approve_reviews(spark, d):
    """Of every ten thoughts the second updates the first and the fifth is new."""
    rows = views.notes(spark, d).select("id", F.coalesce("content", F.lit("")).alias("content"), "review_status")
    decisions = rows.where("id % 10 IN (2, 5)").select(F.col("id").alias("pending_id"), F.when(F.col("id") % 10 == 2, "UPDATE").otherwise("NEW").alias("action"), (F.col("id") - 1).alias("target_id"))
    return curation.approve(rows, decisions).select("id", F.md5("content").alias("content_md5"), "review_status")


@query(f"""WITH t AS (SELECT doc_id AS item, doc_id % 4 AS job_id, coalesce(text, '') AS content, CASE WHEN doc_id % 3 > 0 THEN 'add' ELSE 'skip' END AS action FROM documents), f AS (SELECT *, {_FULL} AS fp FROM t), k AS (SELECT DISTINCT {_FULL} AS fp FROM (SELECT coalesce(text, '') AS content FROM benchmark)),
a AS (SELECT min(item) AS item FROM f WHERE action = 'add' AND fp <> '' AND fp NOT IN (FROM k) GROUP BY fp) SELECT job_id, count(a.item) AS added, count(*) - count(a.item) AS skipped FROM f LEFT JOIN a ON a.item = f.item GROUP BY job_id""")
def execute_jobs(spark, d):
    n = F.col("doc_id")
    items = table(spark, d, "documents").select(n.alias("item"), (n % 4).alias("job_id"), F.coalesce("text", F.lit("")).alias("content"), F.when(n % 3 > 0, "add").otherwise("skip").alias("action"))
    known = table(spark, d, "benchmark").select(text.fingerprint(F.col("text")).alias("fingerprint"))
    return curation.executed(items, known)[1]


@query("""SELECT CASE WHEN p_partkey % 2 = 0 THEN 'duplicate' ELSE 'orphan' END AS state, p_partkey AS id FROM part""")
def missing_fingerprints(spark, d):
    """Texts without a stored fingerprint: every second one is there already but for a plural and a mark."""
    n = F.col("p_partkey")
    missing = table(spark, d, "part").select(n.alias("id"), F.concat(F.lit("Topic number "), n, F.lit(" items.")).alias("content"))
    stored = missing.where("id % 2 = 0").select(text.fingerprint(F.concat(F.lit("topic  number "), F.col("id"), F.lit(" item")), "loose").alias("fingerprint"))
    same, fresh = curation.duplicates_and_orphans(missing, stored)
    return same.select(F.lit("duplicate").alias("state"), "id").union(fresh.select(F.lit("orphan"), "id"))


@query("""WITH l AS (SELECT o_custkey AS id, arg_max(o_orderdate::DATE, o_orderkey) AS done FROM orders GROUP BY 1) SELECT c_custkey AS task_id, done::VARCHAR AS last_completed, (CASE WHEN done IS NULL THEN DATE '2000-01-01' WHEN c_custkey % 3 > 0 THEN done + (c_custkey % 3 * 30)::INT END)::VARCHAR AS next_due FROM customer LEFT JOIN l ON id = c_custkey""")
def next_due(spark, d):
    n = F.col("c_custkey")
    tasks = table(spark, d, "customer").select(n.alias("task_id"), F.when(n % 3 > 0, (n % 3 * 30).cast("int")).alias("frequency_days"), F.lit("2000-01-01").cast("date").alias("next_due"))
    logs = table(spark, d, "orders").select(F.col("o_custkey").alias("task_id"), F.to_date("o_orderdate").alias("completed_at"), F.col("o_orderkey").alias("seq"))
    return upsert.next_due(tasks, logs).select("task_id", F.col("last_completed").cast("string").alias("last_completed"), F.to_date("next_due").cast("string").alias("next_due"))


@query("SELECT o_custkey AS contact_id, arg_max(o_orderdate::DATE, o_orderkey)::VARCHAR AS last_contacted FROM orders GROUP BY 1")
def last_contacted(spark, d):
    logs = table(spark, d, "orders").select(F.col("o_custkey").alias("contact_id"), F.to_date("o_orderdate").cast("string").alias("last_contacted"), F.col("o_orderkey").alias("seq"))
    return upsert.last_inserted(logs, "contact_id", "last_contacted", "seq")


_ACTIONS = ["confirm", "evidence_only", "reject", "mark_stale", "dispute", "restrict_scope", "edit", "supersede", "merge", None]


def _reviews(spark, d):
    i = F.col("vec_id")
    rows = table(spark, d, "embeddings").select(
        i.alias("id"), F.lit("pending").alias("review_status"), F.lit("active").alias("lifecycle_status"), F.lit("generated").alias("provenance_status"), F.lit("project").alias("visibility"),
        F.lit(True).alias("can_use_as_instruction"), F.lit(True).alias("can_use_as_evidence"), F.lit(True).alias("requires_user_confirmation"), F.concat(F.lit("m"), i).alias("content"),
    )
    action = F.element_at(F.array(*[F.lit(a).cast("string") for a in _ACTIONS]), (1 + F.col("id") % 10).cast("int"))
    return rows, rows.select("id", action.alias("action"), F.lit("new text").alias("content"), F.when(F.col("id") % 20 > 5, F.col("id") + 1).alias("related_id")).where("action IS NOT NULL")


@query("""SELECT vec_id AS id, CASE vec_id % 10 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'evidence_only' WHEN 2 THEN 'rejected' WHEN 3 THEN 'stale' WHEN 5 THEN 'restricted' ELSE 'pending' END AS review_status,
 CASE vec_id % 10 WHEN 2 THEN 'rejected' WHEN 3 THEN 'stale' WHEN 4 THEN 'disputed' ELSE 'active' END AS lifecycle_status, CASE vec_id % 10 WHEN 0 THEN 'user_confirmed' WHEN 4 THEN 'disputed' ELSE 'generated' END AS provenance_status,
 CASE vec_id % 10 WHEN 5 THEN 'personal' ELSE 'project' END AS visibility, vec_id % 10 NOT IN (1, 2, 3, 4) AS can_use_as_instruction, vec_id % 10 <> 2 AS can_use_as_evidence, vec_id % 10 NOT IN (0, 1) AS requires_user_confirmation, CASE WHEN vec_id % 10 = 6 THEN 'new text' ELSE 'm' || vec_id END AS content FROM embeddings""")
def review_memories(spark, d):
    return upsert.reviewed(*_reviews(spark, d))


@query("""SELECT vec_id AS id, CASE vec_id % 10 WHEN 0 THEN 'memory_confirmed' WHEN 2 THEN 'memory_rejected' WHEN 4 THEN 'memory_disputed' WHEN 7 THEN 'memory_superseded' ELSE 'memory_edited' END AS event, CASE WHEN vec_id % 20 > 5 THEN CASE vec_id % 10 WHEN 7 THEN 'supersedes' WHEN 8 THEN 'merged_into' END END AS relation, vec_id % 10 IN (6, 7, 8) AS same FROM embeddings WHERE vec_id % 10 < 9""")
def review_log(spark, d):
    rows = upsert.review_log(*_reviews(spark, d))
    return rows.select("id", "event", "relation", (F.col("before") == F.col("after")).alias("same"))


@query("SELECT c_custkey % 25 AS agent_id, n_name AS agent_label, 'key ' || c_custkey AS key_label FROM customer JOIN nation ON n_nationkey = c_custkey % 25 WHERE c_custkey = 12")
def agent_key_lookup(spark, d):
    import hashlib

    n = F.col("c_custkey")
    keys = table(spark, d, "customer").select(F.sha2(n.cast("string"), 256).alias("key_hash"), (n % 25).alias("agent_id"), F.concat(F.lit("key "), n).alias("key_label"), (n % 3 == 0).alias("active"), F.when(n % 4 > 0, "2024-01-01").cast("timestamp").alias("revoked_at"))
    agents = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("agent_id"), F.col("n_name").alias("agent_label"))
    asked = [hashlib.sha256(str(i).encode()).hexdigest() for i in (12, 13, 15)]  # in use, off, revoked
    found = [curation.key_owner(keys, agents, h) for h in (f" {asked[0].upper()} ", *asked[1:], "short")]
    return found[0].union(found[1]).union(found[2]).union(found[3])


_STEPS = ("rhythm", "decisions", "dependencies", "knowledge", "friction")


@query("""WITH s AS (SELECT c_custkey AS session_id, c_custkey % 5 AS k FROM customer) SELECT session_id, CASE k WHEN 0 THEN 'rhythm' WHEN 1 THEN 'rhythm,decisions' WHEN 2 THEN 'rhythm,dependencies' WHEN 3 THEN 'rhythm,knowledge' ELSE 'rhythm,friction' END AS completed, CASE k WHEN 1 THEN 'dependencies' ELSE 'decisions' END AS pending, 2 + CASE WHEN k > 0 THEN 1 ELSE 0 END AS entries FROM s""")
def save_layers(spark, d):
    """All have rhythm with an entry; one layer is saved with two, which for some is rhythm again."""
    n = F.col("c_custkey")
    state = table(spark, d, "customer").select(n.alias("session_id"), F.array(F.lit("rhythm")).alias("completed"))
    old = state.select("session_id", F.lit("rhythm").alias("layer"), F.lit(0).alias("position"), F.lit("old").alias("entry"))
    layer = F.element_at(F.array(*map(F.lit, _STEPS)), (1 + F.col("session_id") % 5).cast("int"))
    sessions, entries = curation.saved_layer(state, old, state.select("session_id", layer.alias("layer"), F.array(F.lit("x"), F.lit("y")).alias("entries")), _STEPS)
    return sessions.join(entries.groupBy("session_id").agg(F.count("*").cast("int").alias("entries")), "session_id").select("session_id", F.array_join("completed", ",").alias("completed"), "pending", "entries")


@query(f"""WITH {NOTES_SQL} SELECT 'thought' AS kind, id AS record_id, NULL AS item FROM notes WHERE id % 3 > 0 UNION ALL SELECT 'interaction', id, NULL FROM notes WHERE id % 2 = 0 UNION ALL SELECT 'action', id, unnest(action_items) FROM notes""")
def route_records(spark, d):
    n = F.col("id")
    rows = views.notes(spark, d).select(n.alias("record_id"), F.when(n % 2 == 0, n % 13).alias("person_id"), F.col("created_at").alias("at"), F.when(n % 3 > 0, "text").alias("content"), "action_items")
    out, none = curation.routed(rows), F.lit(None).cast("string")
    parts = [out["thoughts"].select(F.lit("thought").alias("kind"), "record_id", none.alias("item")), out["interactions"].select(F.lit("interaction"), "record_id", none), out["action_items"].select(F.lit("action"), "record_id", "action_item")]
    return parts[0].union(parts[1]).union(parts[2])


# ---- pages, entities, edges -------------------------------------------------------------------


def _page_rows(spark, d):
    """Every second supplier has a page, some of them edited by hand or with notes."""
    n = F.col("s_suppkey")
    return table(spark, d, "supplier").where("s_suppkey % 2 = 0").select(
        n.alias("entity_id"), F.concat(F.lit("s-"), n).alias("slug"), F.concat(F.lit("Page "), n).alias("title"), F.concat(F.lit("See [#"), n * 3, F.lit("] and [#"), n * 500, F.lit("].")).alias("content"),
        (n % 4 == 0).alias("manually_edited"), F.when(n % 10 == 6, "note").alias("notes"),
    )


@query("""SELECT 's-' || s_suppkey AS slug, CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 4 > 0 THEN 'New ' || s_suppkey ELSE 'Page ' || s_suppkey END AS title, s_suppkey % 4 = 0 AS manually_edited FROM supplier WHERE s_suppkey % 6 = 0 OR s_suppkey % 2 = 0
UNION ALL SELECT 's-' || s_suppkey, 'New ' || s_suppkey, false FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey % 2 = 1""")
def upsert_pages(spark, d):
    new = table(spark, d, "supplier").where("s_suppkey % 3 = 0").select(F.concat(F.lit("s-"), F.col("s_suppkey")).alias("slug"), F.concat(F.lit("New "), F.col("s_suppkey")).alias("title"), F.lit("text").alias("content"))
    return curation.upsert_pages(_page_rows(spark, d), new).select("slug", "title", "manually_edited")


@query("""SELECT 's-' || s_suppkey AS slug, s_suppkey % 4 = 0 OR s_suppkey % 6 = 0 AS manually_edited, CASE WHEN s_suppkey % 6 = 0 THEN 'mine' ELSE 'See [#' || s_suppkey * 3 || '] and [#' || s_suppkey * 500 || '].' END AS content, CASE WHEN s_suppkey % 8 = 0 THEN 'n2' WHEN s_suppkey % 10 = 6 THEN 'note' END AS notes FROM supplier WHERE s_suppkey % 2 = 0""")
def edit_pages(spark, d):
    pages = _page_rows(spark, d)
    edits = pages.where("entity_id % 6 = 0 OR entity_id % 8 = 0").select("slug", F.when(F.col("entity_id") % 6 == 0, "mine").alias("content"), F.when(F.col("entity_id") % 8 == 0, "n2").alias("notes"))
    return curation.pages_edited(pages, edits).select("slug", "manually_edited", "content", "notes")


@query(f"""WITH {LINKS_SQL}, n AS (SELECT entity_id, count(*) AS n FROM links WHERE thought_id % 50 = 0 AND entity_id % 5 > 0 GROUP BY 1)
SELECT 'page' AS kind, 's-' || s_suppkey AS key FROM supplier LEFT JOIN n ON entity_id = s_suppkey WHERE s_suppkey % 2 = 0 AND s_suppkey % 4 > 0 AND s_suppkey % 10 <> 6 AND coalesce(n, 0) < 14 UNION ALL SELECT 'entity', s_suppkey::VARCHAR FROM supplier WHERE s_suppkey NOT IN (SELECT entity_id FROM n)""")
def purge_orphans(spark, d):
    links = views.links(spark, d).where("thought_id % 50 = 0 AND entity_id % 5 > 0")
    pages, gone = upsert.purge(views.entities(spark, d), links, _page_rows(spark, d), 14)
    return pages.select(F.lit("page").alias("kind"), F.col("slug").alias("key")).union(gone.select(F.lit("entity"), F.col("id").cast("string")))


@query("SELECT 's-' || s_suppkey AS slug, c AS serial_id FROM (SELECT s_suppkey, unnest([s_suppkey * 3, s_suppkey * 500]) AS c FROM supplier WHERE s_suppkey % 2 = 0) WHERE c NOT IN (SELECT doc_id FROM documents)")
def stale_citations(spark, d):
    return upsert.stale_citations(_page_rows(spark, d), table(spark, d, "documents").select(F.col("doc_id").alias("serial_id")))


@query("SELECT s_suppkey AS id FROM supplier WHERE s_suppkey % 2 = 1")
def entities_without_page(spark, d):
    entities = views.entities(spark, d)
    return entities.join(_page_rows(spark, d).select(F.col("entity_id").alias("id")), "id", "left_anti").select("id")


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN CASE WHEN s_suppkey % 3 = 0 THEN 'n' || s_suppkey ELSE lower(s_name) || ',n' || s_suppkey END WHEN s_suppkey % 3 = 0 THEN '' ELSE lower(s_name) END AS aliases FROM supplier")
def change_aliases(spark, d):
    entities = views.entities(spark, d)
    add, drop = F.when(F.col("id") % 2 == 0, F.array(F.concat(F.lit("n"), F.col("id")))), F.when(F.col("id") % 3 == 0, F.col("aliases"))
    out = curation.aliases_changed(entities, entities.where("id % 2 = 0 OR id % 3 = 0").select("id", add.alias("add"), drop.alias("remove")))
    return out.select("id", F.array_join("aliases", ",").alias("aliases"))


@query(f"WITH {LINKS_SQL} SELECT DISTINCT thought_id FROM links WHERE entity_id IN (2, 3)")
def resplit_aliases(spark, d):
    return curation.resplit(views.entities(spark, d).where("id IN (2, 3)"), views.links(spark, d))


@query(f"WITH {_ENTS} SELECT id AS loser, 2::BIGINT AS winner FROM ents WHERE ({_LOOSE_KEY.format(c='name')} = 'unit 1' AND id <> 2)")
def absorb_alias(spark, d):
    return curation.absorbed_aliases(_entities(spark, d), spark.createDataFrame([(2, " UNIT_1. ")], "id bigint, alias string"))


@query(f"WITH {_ENTS} SELECT id AS loser, (SELECT min(id) FROM ents WHERE id % 5 = 0) AS winner FROM ents WHERE entity_type = 'tool' AND lower(name) = 'other 2' OR (entity_type = 'tool' AND id % 5 = 0 AND id <> (SELECT min(id) FROM ents WHERE id % 5 = 0)) OR (entity_type = 'person' AND id % 5 = 0 AND id <> (SELECT min(id) FROM ents WHERE id % 5 = 0))")
def rename_entities(spark, d):
    """Every fifth becomes a tool of one name, which another holds already."""
    entities = _entities(spark, d)
    renames = entities.where("id % 5 = 0").select("id", F.lit("Other  2").alias("new_name"), F.lit("tool").alias("new_type"))
    return curation.renamed(entities, renames)[1]


@query(f"WITH {_ENTS} SELECT id FROM ents WHERE name NOT IN (SELECT name FROM ents WHERE id % 7 = 0)")
def delete_entities(spark, d):
    """Deleted entities' names are blocked, so others of the name go too."""
    entities = _entities(spark, d)
    return upsert.without_blocked(entities, entities.where("id % 7 = 0"), ["name"]).select("id")


@query(f"""WITH {EDGES_SQL}, w AS (SELECT DISTINCT CASE r WHEN 'knew' THEN least(a, b) ELSE a END AS f, CASE r WHEN 'knew' THEN greatest(a, b) ELSE b END AS t, r FROM (SELECT s_suppkey AS a, 1 + s_suppkey % 9 AS b, CASE WHEN s_suppkey % 2 = 0 THEN 'knew' ELSE 'A' END AS r FROM supplier) WHERE a <> b)
SELECT f AS from_entity_id, t AS to_entity_id, r AS relation, 1.0::DOUBLE AS confidence FROM w WHERE (f, t) <> (4, 5) AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.from_entity_id = f AND e.to_entity_id = t AND e.relation = r)""")
def manual_edges(spark, d):
    wanted = table(spark, d, "supplier").select(F.col("s_suppkey").alias("from_entity_id"), (1 + F.col("s_suppkey") % 9).alias("to_entity_id"), F.when(F.col("s_suppkey") % 2 == 0, "knew").otherwise("A").alias("relation"), F.lit(7.0).alias("confidence"))
    blocked = spark.createDataFrame([(4, 5, "knew")], "from_entity_id bigint, to_entity_id bigint, relation string")
    return curation.manual_edges(wanted, views.edges(spark, d), blocked, upsert.SYMMETRIC)


@query(f"""WITH {EDGES_SQL}, e AS (SELECT l_suppkey AS f, l_suppkey % 5 + 1 AS t, l_returnflag AS r, l_orderkey AS thought_id FROM lineitem), g AS (SELECT DISTINCT f, t, r FROM e WHERE f <= 3 AND r = 'R')
SELECT 'edge' AS kind, count(*) AS n FROM edges WHERE NOT (from_entity_id <= 3 AND relation = 'R' AND to_entity_id = from_entity_id % 5 + 1) UNION ALL SELECT 'evidence', count(*) FROM e WHERE NOT (f <= 3 AND r = 'R') UNION ALL SELECT 'blocked', count(*) FROM g
UNION ALL SELECT 'queue', sum(DISTINCT thought_id)::BIGINT FROM (SELECT thought_id, row_number() OVER (PARTITION BY f, t, r ORDER BY o_orderdate DESC, thought_id DESC) AS k FROM e JOIN orders ON o_orderkey = thought_id WHERE f <= 3 AND r = 'R') WHERE k = 1""")
def delete_edges(spark, d):
    evidence = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("from_entity_id"), (F.col("l_suppkey") % 5 + 1).alias("to_entity_id"), F.col("l_returnflag").alias("relation"), F.col("l_orderkey").alias("thought_id"))
    out = curation.deleted_edges(views.edges(spark, d), evidence, evidence.where("from_entity_id <= 3 AND relation = 'R'"), views.entity_thoughts(spark, d))
    n = lambda k, c: out[k].agg(c.alias("n")).select(F.lit("edge" if k == "edges" else k).alias("kind"), "n")
    return n("edges", F.count("*")).union(n("evidence", F.count("*"))).union(n("blocked", F.count("*"))).union(n("queue", F.sum("thought_id")))


@query("SELECT event_id, CASE WHEN ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 720 MINUTE THEN 'undone' ELSE 'kept' END AS state FROM events")
def undo_blocks(spark, d):
    from datetime import datetime

    rows = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("created_at"))
    kept, undone = curation.unblocked(rows, datetime(2024, 1, 20), 9999)  # at most 720 minutes
    return kept.select("event_id", F.lit("kept").alias("state")).union(undone.select("event_id", F.lit("undone")))


@query("SELECT p_partkey AS from_entity_id, p_size AS to_entity_id, f.s_name AS from_name, t.s_name AS to_name FROM part LEFT JOIN supplier f ON f.s_suppkey = p_partkey LEFT JOIN supplier t ON t.s_suppkey = p_size")
def blocklist(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("from_entity_id"), F.col("p_size").alias("to_entity_id"))
    return curation.blocks_named(rows, views.entities(spark, d)).select("from_entity_id", "to_entity_id", "from_name", "to_name")


@query(f"WITH {NOTES_SQL} SELECT id, CASE WHEN sensitivity_tier IN ('personal', 'restricted') THEN sensitivity_tier WHEN id % 2 = 0 THEN 'restricted' WHEN id % 5 = 1 THEN 'personal' ELSE sensitivity_tier END AS sensitivity_tier FROM notes")
def upgrade_tiers(spark, d):
    said = F.when(F.col("id") % 2 == 0, "my password: hunter22").when(F.col("id") % 5 == 1, "I was diagnosed").otherwise("hello")
    return upsert.upgraded_tiers(views.notes(spark, d).withColumn("content", said)).select("id", "sensitivity_tier")


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '{\"a\":' || doc_id || '}' END AS metadata FROM documents")
def repair_metadata(spark, d):
    n = F.col("doc_id")
    raw = F.when(n % 4 == 0, F.concat(F.lit('"{\\"a\\":'), n, F.lit('}"'))).when(n % 4 == 1, F.lit('"[1, 2]"')).when(n % 4 == 2, F.lit('"{broken"')).otherwise(F.lit("12"))
    return table(spark, d, "documents").select("doc_id", curation.parsed_metadata(raw).alias("metadata"))


@query(f"""WITH {NOTES_SQL}, m AS (SELECT id, type, CASE id % 4 WHEN 0 THEN 'task' WHEN 1 THEN 'reference' WHEN 2 THEN 'odd' END AS own FROM notes WHERE type IS NOT NULL)
SELECT id, CASE WHEN type = 'reference' AND own = 'task' THEN 'task' ELSE type END AS type, CASE WHEN type <> 'reference' THEN 'already_typed' WHEN own IS NULL THEN 'no_metadata_type' WHEN own = 'odd' THEN 'invalid' WHEN own = 'reference' THEN 'same' ELSE 'updated' END AS reason FROM m""")
def backfill_types(spark, d):
    own = F.when(F.col("id") % 4 == 0, "task").when(F.col("id") % 4 == 1, "reference").when(F.col("id") % 4 == 2, "odd")
    return curation.retyped(views.notes(spark, d).where("type IS NOT NULL").select("id", "type", own.alias("metadata_type"))).select("id", "type", "reason")


@query(f"WITH {NOTES_SQL} SELECT id, CASE WHEN id % 6 IN (0, 1) THEN 'newsletter' ELSE type END AS type, CASE WHEN id % 6 IN (0, 1) THEN 'personal' ELSE classification END AS classification FROM notes")
def retag_newsletters(spark, d):
    openings = ["Newsletter — X", "newsletter-Y", "Newsletters", "A Newsletter", " Newsletter x", "Newsletter"]
    content = F.element_at(F.array(*map(F.lit, openings)), (1 + F.col("id") % 6).cast("int"))
    return curation.newsletters(views.notes(spark, d).withColumn("content", content)).select("id", "type", "classification")


@query(f"WITH {NOTES_SQL} SELECT id, CASE WHEN id % 3 = 0 THEN 'lesson' ELSE type END AS type, CASE WHEN id % 2 = 0 THEN 5 ELSE 1 END AS importance, source_type FROM notes")
def enrich_notes(spark, d):
    rows = views.notes(spark, d)
    patches = rows.select("id", F.when(F.col("id") % 3 == 0, "Lesson").otherwise("invented").alias("type"), F.when(F.col("id") % 2 == 0, 9).otherwise(-3).alias("importance"))
    return curation.enriched(rows, patches).select("id", "type", F.col("importance").cast("int").alias("importance"), "source_type")


@query("""WITH q AS (SELECT n_nationkey AS item, CASE n_nationkey % 4 WHEN 0 THEN (SELECT upper(s_name) FROM supplier WHERE s_suppkey = 1 + n_nationkey % 5) WHEN 1 THEN '1' WHEN 2 THEN (SELECT right(s_name, 4) FROM supplier WHERE s_suppkey = 2) ELSE 'absent' END AS name FROM nation),
c AS (SELECT item, count(DISTINCT s_suppkey) AS n, min(s_suppkey) AS single, min(s_suppkey) FILTER (lower(s_name) = lower(name)) AS exact FROM q LEFT JOIN supplier ON s_name ILIKE '%' || name || '%' GROUP BY item)
SELECT item, coalesce(exact, CASE WHEN n = 1 THEN single END) AS entity_id, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN n = 1 THEN 'single' WHEN n > 1 THEN 'ambiguous' ELSE 'none' END AS state FROM c""")
def resolve_related(spark, d):
    n, entities = F.col("n_nationkey"), views.entities(spark, d)
    second = F.lit(entities.where("id = 2").first()["name"][-4:])
    rows = table(spark, d, "nation").join(entities.select(F.col("id").alias("own"), "name"), F.col("own") == 1 + n % 5)
    name = F.when(n % 4 == 0, F.upper("name")).when(n % 4 == 1, "1").when(n % 4 == 2, second).otherwise("absent")
    return curation.related_entities(rows.select(n.alias("item"), name.alias("name")), entities).select("item", "entity_id", "state")


@query(f"WITH {EDGES_SQL} SELECT s_suppkey AS from_entity_id, 1 + s_suppkey % 9 AS to_entity_id FROM supplier WHERE NOT EXISTS (SELECT 1 FROM edges WHERE relation = 'A' AND support_count > 20 AND ((from_entity_id = s_suppkey AND to_entity_id = 1 + s_suppkey % 9) OR (to_entity_id = s_suppkey AND from_entity_id = 1 + s_suppkey % 9)))")
def new_pairs_only(spark, d):
    wanted = table(spark, d, "supplier").select(F.col("s_suppkey").alias("from_entity_id"), (1 + F.col("s_suppkey") % 9).alias("to_entity_id"))
    return curation.without_linked_pairs(wanted, views.edges(spark, d).where("relation = 'A' AND support_count > 20"))


@query("SELECT o_custkey AS trace_id, o_orderkey AS memory_id, o_orderkey % 4 = 0 AS used FROM orders")
def recall_usage(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("trace_id"), F.col("o_orderkey").alias("memory_id"))
    return curation.usage(rows, rows.where("memory_id % 4 = 0"))


_REL = ["works_on", "published_by", "references", "related_to", "invented", "uses", "knew"]
_REL_SQL = "['works_on', 'published_by', 'references', 'related_to', 'invented', 'uses', 'knew'][1 + l_orderkey % 7]"


@query(f"""WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS thought_id, l_suppkey AS f, 1 + l_partkey % 10 AS t, {_REL_SQL} AS relation, l_discount * 10 AS confidence, l_returnflag = 'N' AS paper FROM lineitem),
k AS (SELECT s_suppkey AS e, CASE s_suppkey % 3 WHEN 0 THEN 'newsletter' WHEN 1 THEN 'person' ELSE 'tool' END AS kind, s_suppkey % 4 = 1 AS author FROM supplier)
SELECT r.id, relation FROM r JOIN k a ON a.e = f JOIN k b ON b.e = t WHERE f <> t AND relation <> 'invented' AND confidence >= 0.5 AND NOT (a.kind = 'newsletter' AND relation IN ('works_on', 'uses', 'related_to')) AND NOT (b.kind = 'newsletter' AND relation IN ('works_on', 'uses'))
AND (relation <> 'published_by' OR (a.kind = 'newsletter' AND b.kind = 'person')) AND (relation <> 'references' OR b.kind = 'newsletter') AND (relation = 'published_by' OR NOT (paper AND (a.author OR b.author)))""")
def valid_relations(spark, d):
    line = table(spark, d, "lineitem")
    other = 1 + F.col("l_partkey") % 10
    rows = line.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("thought_id"), F.concat(F.lit("E "), "l_suppkey").alias("from_name"), F.concat(F.lit("e  "), other).alias("to_name"), F.element_at(F.array(*map(F.lit, _REL)), (1 + F.col("l_orderkey") % 7).cast("int")).alias("relation"), (F.col("l_discount") * 10).alias("confidence"), (F.col("l_returnflag") == "N").alias("is_newsletter"))
    ends = line.select(F.col("l_orderkey").alias("thought_id"), F.explode(F.array("l_suppkey", other)).alias("e")).distinct()
    ends = ends.join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("e")), "e", "left_semi")
    kind = F.when(F.col("e") % 3 == 0, "newsletter").when(F.col("e") % 3 == 1, "person").otherwise("tool")
    known = ends.select("thought_id", F.concat(F.lit("E "), "e").alias("name"), kind.alias("entity_type"), (F.col("e") % 4 == 1).alias("is_author"))
    return curation.valid_relations(rows, known).select("id", "relation")


# ---- joins ------------------------------------------------------------------------------------


@query(f"""WITH p AS (SELECT x.item_id AS a, y.item_id AS b FROM benchmark x JOIN benchmark y ON y.item_id = x.item_id + 1), t AS (SELECT doc_id, ' ' || array_to_string(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), ' ') || ' ' AS body FROM documents),
w AS (SELECT item_id, array_to_string(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')[1:1], ' ') AS name FROM benchmark), h AS (SELECT item_id, doc_id FROM w JOIN t ON contains(body, ' ' || name || ' '))
SELECT p.a, p.b, count(y.doc_id) AS grounding FROM p LEFT JOIN h x ON x.item_id = p.a LEFT JOIN h y ON y.item_id = p.b AND y.doc_id = x.doc_id GROUP BY p.a, p.b""")
def grounded_by_text(spark, d):
    """Neighbouring benchmark items, named by their first word, that no thought links."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.element_at(text.tokens(F.col("text")), 1).alias("name"))
    pairs = items.select(F.col("id").alias("a")).join(items.select((F.col("id") - 1).alias("a"), F.col("id").alias("b")), "a").select("a", "b")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return curation.grounded(pairs, spark.createDataFrame([], "entity_id bigint, thought_id bigint"), items, docs)


@query("SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey")
def embedded_parents(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "customer")
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("customer"), "c_name", F.col("c_nationkey").alias("nation"))
    rows = domains.with_parent(o, people, "customer")
    rows = domains.with_parent(rows.select("o_orderkey", "customer", F.col("customer_row.c_name").alias("c_name"), F.col("customer_row.nation").alias("nation")), table(spark, d, "nation").select(F.col("n_nationkey").alias("nation"), "n_name"), "nation")
    return rows.select("o_orderkey", "c_name", F.col("nation_row.n_name").alias("n_name"))


@query("SELECT user_id, item, count(*) AS n FROM (SELECT user_id, unnest(string_split(event_type, 'i')) AS item FROM events) GROUP BY ALL")
def exploded_items(spark, d):
    return table(spark, d, "events").select("user_id", F.explode(F.split("event_type", "i")).alias("item")).groupBy("user_id", "item").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey AS mention, CASE c_custkey % 4 WHEN 0 THEN CASE WHEN c_custkey % 10 < 9 THEN c_custkey % 10 END WHEN 1 THEN CASE WHEN c_custkey % 10 < 9 THEN c_custkey % 10 END WHEN 2 THEN CASE WHEN c_custkey % 10 < 9 THEN c_custkey % 10 END END AS person FROM customer""")
def match_people(spark, d):
    """By full name, by alias, by first name, and unknown ones; ten people of whom the last is missing."""
    firsts = ["Amara", "Bruno", "Celia", "Dmitri", "Elena", "Farid", "Greta", "Hugo", "Ivana", "Jonas"]
    people = spark.createDataFrame([(i, f"{f} Smith{i}", [f"boss{i}"]) for i, f in enumerate(firsts[:9])], "id bigint, name string, aliases array<string>")
    n, first = F.col("c_custkey"), F.element_at(F.array(*map(F.lit, firsts)), (1 + F.col("c_custkey") % 10).cast("int"))
    name = F.when(n % 4 == 0, F.concat(first, F.lit(" smith"), n % 10)).when(n % 4 == 1, F.concat(F.lit("BOSS"), n % 10)).when(n % 4 == 2, F.concat(first, F.lit(" X"))).otherwise("Nobody Else")
    asked = table(spark, d, "customer").select(n.alias("id"), name.alias("mention"))
    return asked.join(domains.match_people(asked.select("mention").distinct(), people), "mention").select(F.col("id").alias("mention"), "person")


@query("""SELECT c_custkey AS id, 'user' || c_custkey % 20 || '@x.org' AS mail, CASE WHEN c_custkey % 20 < 5 THEN c_custkey % 20 WHEN c_custkey % 20 < 10 THEN 100 + c_custkey % 20 END AS person FROM customer""")
def mail_identities(spark, d):
    """Five people are known by mail, five only by name, the others not."""
    people = spark.createDataFrame([(i, f"User{i}@X.org", "someone") for i in range(5)] + [(100 + i, None, f"Person {i}") for i in range(5, 10)], "id bigint, mail string, name string")
    n = F.col("c_custkey") % 20
    rows = table(spark, d, "customer").select("c_custkey", F.concat(F.lit('"person  '), n, F.lit('" <USER'), n, F.lit("@x.org>")).alias("address"))
    found = curation.identities(rows.select("address").distinct(), people)
    return rows.join(found, "address").select(F.col("c_custkey").alias("id"), "mail", "person")


@query(r"""SELECT c_custkey AS id, 2 AS n, 'a b, "c" ' || c_custkey AS first_name FROM customer""")
def address_lists(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.concat(F.lit('"a b, \\"c\\" '), "c_custkey", F.lit('" <x@y.org>, Bob <b@c.org>')).alias("to"))
    parts = curation.address_list(F.col("to"))
    return rows.select(F.col("c_custkey").alias("id"), F.size(parts).alias("n"), parts[0]["name"].alias("first_name"))


# ---- the queue --------------------------------------------------------------------------------


def _queue(spark, d):
    n = F.col("o_orderkey")
    status = F.when(n % 3 == 0, "pending").when(n % 3 == 1, "processing").otherwise("complete")
    return table(spark, d, "orders").select(n.alias("thought_id"), status.alias("status"), F.col("o_orderdate").alias("queued_at"), (n % 4).cast("int").alias("attempt_count"))


@query("SELECT o_orderkey AS thought_id FROM orders WHERE o_orderkey % 3 = 0 ORDER BY o_orderdate, o_orderkey LIMIT 25")
def claim_batch(spark, d):
    return changes.claimed(_queue(spark, d), 25).select("thought_id")


@query("""SELECT o_orderkey AS thought_id, CASE WHEN o_orderkey % 3 <> 1 THEN CASE o_orderkey % 3 WHEN 0 THEN 'pending' ELSE 'complete' END WHEN o_orderkey % 2 = 0 THEN 'complete' WHEN o_orderkey % 4 + 1 >= 3 THEN 'failed' ELSE 'pending' END AS status, o_orderkey % 4 + CASE WHEN o_orderkey % 3 = 1 AND o_orderkey % 2 = 1 THEN 1 ELSE 0 END AS attempt_count FROM orders""")
def settle_batch(spark, d):
    queue = _queue(spark, d)
    done = queue.where("status = 'processing'").select("thought_id", (F.col("thought_id") % 2 == 0).alias("ok"), F.lit("e").alias("error"))
    return changes.settled(queue, done).select("thought_id", "status", F.col("attempt_count").cast("bigint").alias("attempt_count"))


@query(f"WITH {LINKS_SQL} SELECT entity_id, count(*) AS links FROM links WHERE entity_id IN (SELECT entity_id FROM links WHERE thought_id < 40) GROUP BY entity_id HAVING count(*) >= 55")
def dirty_entities(spark, d):
    queue, links = _queue(spark, d), views.links(spark, d)
    done = queue.where("thought_id < 40")
    idle = changes.dirty_entities(queue.where("status <> 'pending'"), links, done, 55)
    busy = changes.dirty_entities(queue, links, done, 55)  # something waits: nothing yet
    return idle.union(busy)


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 5 = 0")
def unprocessed(spark, d):
    n = F.col("c_custkey")
    rows = table(spark, d, "customer").select(n.alias("id"), F.lit(10).alias("update_time"))
    log = rows.where("id % 3 > 0").select("id", F.when(F.col("id") % 5 == 0, 9).otherwise(10).alias("update_time"))
    return changes.unprocessed(rows, log).select("id")


@query("""SELECT 'p:' || c_custkey AS base_key, i::INT AS index, CASE i WHEN 0 THEN 'decision' WHEN 1 THEN 'decision' ELSE 'work_log' END AS memory_type, sha256(CASE i WHEN 2 THEN 'work_log:Next step: c' ELSE 'decision:' || CASE i WHEN 0 THEN 'a' ELSE 'b' END END || c_custkey) AS content_hash, 'p:' || c_custkey || ':' || i AS idempotency_key FROM customer, range(3) t(i)""")
def memory_rows(spark, d):
    n = F.col("c_custkey")
    rows = table(spark, d, "customer").select(F.concat(F.lit("p:"), n).alias("base_key"), F.array(F.concat(F.lit("a"), n), F.concat(F.lit("b"), n)).alias("decisions"), F.array(F.concat(F.lit("c"), n)).alias("next_steps"))
    return search.memory_rows(rows).select("base_key", "index", "memory_type", "content_hash", "idempotency_key")


@query(f"WITH {NOTES_SQL} SELECT id, 1 + (CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END) AS version, CASE WHEN id % 3 = 0 THEN 1 END AS archived, id % 6 = 3 AS queued FROM notes")
def revise_archives(spark, d):
    """A third get new content, half of them only other white space, which archives but does not queue."""
    from datetime import datetime

    rows = views.notes(spark, d).select("id", F.concat(F.lit("Text "), F.col("id")).alias("content"), F.lit(1).alias("version"), F.lit("new").alias("status"), F.lit(None).cast("timestamp").alias("status_updated_at"))
    patches = rows.where("id % 3 = 0").select("id", F.when(F.col("id") % 6 == 0, F.concat(F.lit(" text  "), F.col("id"))).otherwise("other").alias("content"), F.lit(None).cast("string").alias("status"))
    new, old, queue = upsert.revise(rows, patches, datetime(2024, 1, 1))
    out = new.join(old.select("id", F.col("version").alias("archived")), "id", "left").join(queue.select("id", F.lit(True).alias("q")), "id", "left")
    return out.select("id", "version", "archived", F.coalesce("q", F.lit(False)).alias("queued"))


@query(f"WITH {_ENTS} SELECT entity_type, count(*) AS n FROM ents GROUP BY entity_type")
def entity_types(spark, d):
    from ..operators import stats

    return stats.counts_by(_entities(spark, d), "entity_type")


# ---- the keyed sink -----------------------------------------------------------------------------


@query("SELECT user_id, event_type, count(*) AS n, min(ts) AS first, max(ts) AS last FROM events GROUP BY ALL")
def keyed_upserts(spark, d):
    """Events folded into a keyed table in three batches, one of which comes twice."""
    rows = table(spark, d, "events").select("user_id", "event_type", F.lit(1).cast("bigint").alias("n"), F.col("ts").alias("first"), F.col("ts").alias("last"), (F.col("event_id") % 3).alias("part"))
    kinds = dict(rows.dtypes)
    sink = keyed.KeyedTable(spark, scratch(spark, "keyed"), ", ".join(f"{c} {kinds[c]}" for c in ("user_id", "event_type", "n", "first", "last")), ("user_id", "event_type"))
    fold = keyed.totals(("user_id", "event_type"), n="sum", first="min", last="max")
    for number in (0, 1, 1, 2):
        sink.merge(rows.where(F.col("part") == number).drop("part"), number, fold)
    return sink.read()


@query("""WITH q AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS r FROM orders WHERE o_orderstatus = 'O')
SELECT o_orderkey AS thought_id, CASE WHEN r <= 30 THEN 'a' ELSE 'b' END AS worker, CASE WHEN r <= 30 THEN 'complete' ELSE 'processing' END AS status FROM q WHERE r <= 50""")
def queue_claims(spark, d):
    """Two workers claim entries of one queue; one of them settles what it holds, and what it does not."""
    checkpointing(spark)
    none = F.lit(None)
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("thought_id"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("complete").alias("status"), F.col("o_orderdate").alias("queued_at"), none.cast("string").alias("worker"), none.cast("timestamp_ntz").alias("claimed_at"))
    queue = keyed.KeyedTable(spark, scratch(spark, "queue"), ", ".join(f"{c} {k}" for c, k in rows.dtypes), ("thought_id",))
    queue.merge(rows, 0, keyed.newest(("thought_id",), [F.col("queued_at")]))
    at = F.expr("TIMESTAMP_NTZ'2001-08-02 00:00:00'")
    keyed.claim(queue, "a", 30, at)
    keyed.claim(queue, "b", 20, at)
    keyed.settle(queue, "a", rows.select("thought_id", F.lit("complete").alias("outcome")))
    return queue.read().where("worker IS NOT NULL").select("thought_id", "worker", "status")


_RECENT = "list_filter(w.times, lambda u: u > e.t - 14400000000)"


@query(f"""WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS key, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
w AS (SELECT DISTINCT key, 0::BIGINT AS r, []::BIGINT[] AS times, NULL::BIGINT AS id, NULL::BOOLEAN AS allowed FROM e
UNION ALL SELECT e.key, e.r, CASE WHEN len({_RECENT}) < 2 THEN list_append({_RECENT}, e.t) ELSE {_RECENT} END, e.event_id, len({_RECENT}) < 2 FROM w JOIN e ON e.key = w.key AND e.r = w.r + 1)
SELECT key, id, allowed FROM w WHERE r > 0""")
def rate_limited_calls(spark, d):
    """Which events of a user a limit of two in four hours allows, by the stream's rule."""
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), "ts", F.col("event_id").alias("id"))
    return changes.limited_rows(rows, 2, 4 * 3600)
