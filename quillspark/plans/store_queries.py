"""Queries of lists, counts, reports and retrieval over notes: the plan and its SQL, side by side."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import filters, vectors
from ..operators import curation, domains, graph, search, stats
from . import views
from .queries import _COS, _FULL, _QUERY_VECTOR, _focus_sql, _places, _query_vector, at, query
from .views import EDGES_SQL, ENTITY_THOUGHTS_SQL, LINKS_SQL, NOTES_SQL, table

NOW = "2024-01-09 00:00:00"
ORDERS_END = "2001-08-02 00:00:00"
_AT = f"TIMESTAMP '{NOW}'"


def joined(column: str):
    return F.array_join(column, ",").alias(column)


# ---- lists and pages --------------------------------------------------------------------------


@query(f"WITH {NOTES_SQL} SELECT serial_id, type, (SELECT count(*) FROM notes WHERE type = 'task') AS total FROM notes WHERE type = 'task' ORDER BY created_at DESC, serial_id DESC LIMIT 10 OFFSET 10")
def list_page(spark, d):
    rows = views.notes(spark, d).where(filters.equal_if(F.col("type"), "task") & filters.equal_if(F.col("status"), None))
    return search.page(rows.select("serial_id", "type", "created_at"), [F.desc("created_at"), F.desc("serial_id")], 2, 10).select("serial_id", "type", "total")


@query("SELECT event_id, user_id FROM events WHERE ts < TIMESTAMP '2024-01-05 00:00:00' OR (ts = TIMESTAMP '2024-01-05 00:00:00' AND event_id < 100) ORDER BY ts DESC, event_id DESC LIMIT 100")
def keyset_page(spark, d):
    rows = table(spark, d, "events")
    return rows.where(filters.before_cursor(F.col("ts"), F.col("event_id"), at("2024-01-05 00:00:00"), 100)).orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "user_id")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 200")
def id_cursor_batch(spark, d):
    return filters.after_id(table(spark, d, "orders"), "o_orderkey", 500, 200).select("o_orderkey", "o_orderstatus")


@query(f"WITH {NOTES_SQL} SELECT serial_id FROM notes WHERE type IN ('task', 'idea') AND importance >= 3 AND created_at < {_AT} AND classification = 'work'")
def filtered_notes(spark, d):
    rows = views.notes(spark, d)
    return rows.where(F.col("type").isin("task", "idea") & (F.col("importance") >= 3) & (F.col("created_at") < at(NOW)) & filters.equal_if(F.col("classification"), "work") & filters.equal_if(F.col("status"), None)).select("serial_id")


@query(f"WITH {NOTES_SQL} SELECT serial_id FROM notes WHERE classification = 'personal' AND list_contains(topics, 't4') AND list_contains(people, 'p4')")
def metadata_containment(spark, d):
    rows = views.notes(spark, d).select("serial_id", F.struct("classification", "topics", "people").alias("metadata"))
    return rows.where(filters.contains(F.col("metadata"), {"classification": "personal", "topics": ["t4"], "people": ["p4"]})).select("serial_id")


@query(f"WITH {NOTES_SQL} SELECT serial_id FROM notes WHERE list_contains(topics, 't2')")
def topic_filter(spark, d):
    return views.notes(spark, d).where(filters.contains(F.col("topics"), ["t2"])).select("serial_id")


@query(f"WITH {NOTES_SQL} SELECT serial_id FROM notes WHERE list_contains(people, 'p1')")
def key_exists(spark, d):
    return views.notes(spark, d).where(F.array_contains("people", "p1")).select("serial_id")


@query(f"WITH {NOTES_SQL} SELECT id FROM notes WHERE serial_id > 0 AND (serial_id - 1) // 7 = 3 AND sensitivity_tier IS DISTINCT FROM 'restricted' ORDER BY created_at DESC, id LIMIT 100")
def find_derivatives(spark, d):
    """Every thought is derived from that of a seventh of its number."""
    parent = F.floor((F.col("serial_id") - 1) / 7).cast("bigint")
    rows = views.notes(spark, d).withColumn("derived_from", F.when(F.col("serial_id") > 0, F.array(parent)).otherwise(F.array().cast("array<bigint>")))
    return graph.derivatives(rows, 3).select("id")


@query("SELECT c_custkey FROM customer WHERE c_name ILIKE '%7%' AND list_contains(['t' || c_custkey % 5, 't' || c_custkey % 3], 't2')")
def contact_search(spark, d):
    n = F.col("c_custkey")
    rows = table(spark, d, "customer").withColumn("tags", F.array(F.concat(F.lit("t"), n % 5), F.concat(F.lit("t"), n % 3)))
    return domains.search_contacts(rows, "7", ["c_name"], ["t2"]).select("c_custkey")


@query("SELECT p_partkey FROM part WHERE list_contains(string_split(p_name, ' '), split_part((SELECT min(p_name) FROM part), ' ', 1))")
def recipes_by_ingredient(spark, d):
    rows = table(spark, d, "part").withColumn("ingredients", F.transform(F.split("p_name", " "), lambda w: F.struct(w.alias("name"))))
    first = rows.agg(F.min("p_name").alias("n")).first()["n"]
    return domains.recipes_with(rows, first.split(" ")[0]).select("p_partkey")


@query("SELECT s_suppkey FROM supplier WHERE s_name ILIKE '%00%' OR s_suppkey::VARCHAR ILIKE '%00%'")
def any_column_search(spark, d):
    return table(spark, d, "supplier").where(filters.any_ilike([F.col("s_name"), F.col("s_suppkey").cast("string")], "00")).select("s_suppkey")


@query("SELECT c_custkey FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey WHERE c_name ILIKE '%11%' OR coalesce(n_name, '') ILIKE '%11%' OR c_mktsegment ILIKE '%11%'")
def job_contact_search(spark, d):
    people = table(spark, d, "customer").withColumnRenamed("c_nationkey", "company_id")
    firms = table(spark, d, "nation").select(F.col("n_nationkey").alias("company_id"), F.col("n_name").alias("company_name"))
    return domains.search_jobs(people, firms, "11", ["c_name", "c_mktsegment"]).select("c_custkey")


@query("SELECT vec_id AS id FROM embeddings WHERE ('run-' || vec_id) LIKE 'run-1%' AND vec_id % 3 = 0 ORDER BY vec_id DESC LIMIT 50")
def memory_list(spark, d):
    return search.memory_list(_memories(spark, d), "w0", 50, "run-1").select("id")


@query("SELECT vec_id AS id FROM embeddings WHERE vec_id % 3 = 1 AND vec_id % 2 = 1 AND vec_id % 4 = 3 ORDER BY vec_id DESC LIMIT 100")
def memory_review_queue(spark, d):
    return search.review_queue(_memories(spark, d), "w1", "p3").select("id")


@query("""SELECT vec_id AS memory_id, vec_id // 10 AS rank, CASE WHEN vec_id % 2 = 1 THEN 'pending' ELSE 'confirmed' END AS review_status FROM embeddings WHERE vec_id % 10 = 4""")
def recall_trace(spark, d):
    rows = _memories(spark, d)
    items = rows.select((F.col("id") % 10).alias("trace_id"), F.col("id").alias("memory_id"), F.floor(F.col("id") / 10).alias("rank"))
    traces = items.select("trace_id").distinct().withColumn("request_id", F.concat(F.lit("r"), "trace_id"))
    return search.recall_trace(traces, items, rows, "r4").select("memory_id", "rank", "review_status")


def _memories(spark, d):
    i = F.col("vec_id")
    return table(spark, d, "embeddings").select(
        i.alias("id"), "embedding", F.concat(F.lit("w"), i % 3).alias("workspace_id"), F.concat(F.lit("p"), i % 4).alias("project_id"), F.when(i % 2 == 1, "pending").otherwise("confirmed").alias("review_status"),
        F.concat(F.lit("run-"), i).alias("task_id"), i.alias("created_at"),
    )


@query(f"WITH {_QUERY_VECTOR} SELECT vec_id AS id, round({_COS}, 6) AS similarity FROM embeddings e, q WHERE vec_id % 3 = 0 AND vec_id % 4 = 0 AND {_COS} > 0.05 ORDER BY {_COS} DESC, vec_id LIMIT 20")
def match_memories(spark, d):
    return search.match_memories(_memories(spark, d), _query_vector(spark, d), "w0", "p0", 0.05).select("id", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {_QUERY_VECTOR} SELECT vec_id AS serial_id, round({_COS}, 6) AS similarity FROM embeddings e, q WHERE label = (SELECT min(label) FROM embeddings) AND {_COS} >= 0.2 ORDER BY {_COS} DESC, vec_id LIMIT 1")
def duplicate_in_source(spark, d):
    rows = table(spark, d, "embeddings")
    least = rows.agg(F.min("label")).first()[0]
    return search.duplicate_in_source(rows.withColumn("serial_id", F.col("vec_id")).withColumn("source_type", F.col("label")), _query_vector(spark, d), least, 0.2).select("serial_id", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {NOTES_SQL} SELECT serial_id, 'text' AS mode FROM notes WHERE classification = 'work' AND content ILIKE '%an%' ORDER BY created_at DESC, serial_id DESC LIMIT 20")
def hybrid_search_text(spark, d):
    return search.hybrid(views.notes(spark, d), "an", None, 20, "work").select("serial_id", "mode")


@query(f"WITH {_QUERY_VECTOR} SELECT vec_id AS serial_id, round({_COS}, 6) AS similarity, 'semantic' AS mode FROM embeddings e, q WHERE vec_id % 2 = 0 AND {_COS} > 0.15 ORDER BY {_COS} DESC, vec_id LIMIT 20")
def hybrid_search_semantic(spark, d):
    rows = table(spark, d, "embeddings").withColumn("serial_id", F.col("vec_id")).withColumn("classification", F.when(F.col("vec_id") % 2 == 0, "work"))
    return search.hybrid(rows, "an", _query_vector(spark, d), 20, "work").select("serial_id", F.round("similarity", 6).alias("similarity"), "mode")


# ---- windows and dates ------------------------------------------------------------------------


@query(f"WITH {NOTES_SQL} SELECT serial_id FROM notes WHERE created_at >= {_AT} - INTERVAL 36 HOUR")
def since_hours(spark, d):
    return views.notes(spark, d).where(filters.within_hours(F.col("created_at"), at(NOW), 36)).select("serial_id")


_WEEK = "start_date <= DATE '2001-07-29' AND (end_date IS NULL OR end_date >= DATE '2001-07-23') OR day_of_week IS NOT NULL"


@query(f"WITH a AS (SELECT o_orderkey, o_orderdate::DATE AS start_date, CASE WHEN o_orderkey % 5 > 0 THEN o_orderdate::DATE + (o_orderkey % 5)::INT END AS end_date, CASE WHEN o_orderkey % 97 = 0 THEN 'monday' END AS day_of_week FROM orders) SELECT o_orderkey FROM a WHERE {_WEEK}")
def calendar_week(spark, d):
    from datetime import date

    k, start = F.col("o_orderkey"), F.to_date("o_orderdate")
    rows = table(spark, d, "orders").select("o_orderkey", start.alias("start_date"), F.when(k % 5 > 0, F.date_add(start, (k % 5).cast("int"))).alias("end_date"), F.when(k % 97 == 0, "monday").alias("day_of_week"))
    return domains.week(rows, date(2001, 7, 23), date(2001, 7, 29)).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate::DATE BETWEEN DATE '2001-07-01' AND DATE '2001-07-15'")
def upcoming_dates(spark, d):
    from datetime import date

    return domains.upcoming(table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("due")), "due", date(2001, 7, 1), 14).select("o_orderkey")


@query(f"WITH {NOTES_SQL} SELECT serial_id FROM notes WHERE type NOT IN ('task', 'journal') OR type IS NULL")
def excluded_types(spark, d):
    return views.notes(spark, d).where(filters.not_among(F.col("type"), ("task", "journal"))).select("serial_id")


@query(f"WITH {NOTES_SQL} SELECT count(*) AS all_rows, count(*) FILTER (length(trim(coalesce(content, ''), ' ' || chr(9) || chr(10))) < 30) AS too_short, count(*) FILTER (length(trim(coalesce(content, ''), ' ' || chr(9) || chr(10))) >= 30 AND importance < 3) AS low_importance FROM notes")
def quality_gate(spark, d):
    reason = search.quality_gate(F.coalesce("content", F.lit("")), F.col("importance"))
    rows = views.notes(spark, d).select(reason.alias("reason"))
    return rows.agg(F.count("*").alias("all_rows"), F.count_if(F.col("reason") == "too_short").alias("too_short"), F.count_if(F.col("reason") == "low_importance").alias("low_importance"))


# ---- counts -----------------------------------------------------------------------------------


@query(f"""WITH {NOTES_SQL}, t AS (SELECT type, count(*) AS n FROM notes WHERE classification = 'work' AND type IS NOT NULL GROUP BY type)
SELECT (SELECT count(*) FROM notes WHERE classification = 'work') AS total, string_agg(type || '=' || n, ',' ORDER BY type) AS types FROM t""")
def type_counts_of_class(spark, d):
    rows = stats.type_summary(views.notes(spark, d), "work")
    entry = F.transform(F.array_sort(F.map_entries("types")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return rows.select("total", F.array_join(entry, ",").alias("types"))


def _top_sql(column: str, section: str, where: str, most: int) -> str:
    return f"SELECT '{section}' AS section, item, n FROM (SELECT item, count(*) AS n FROM (SELECT unnest({column}) AS item FROM notes WHERE {where}) GROUP BY item ORDER BY n DESC, item LIMIT {most})"


@query(f"WITH {NOTES_SQL} SELECT 'type' AS section, type AS item, count(*) AS n FROM notes WHERE type IS NOT NULL GROUP BY type UNION ALL {_top_sql('topics', 'topic', 'true', 10)} UNION ALL {_top_sql('people', 'person', 'true', 10)}")
def stats_with_tops(spark, d):
    return stats.summary_with_tops(views.notes(spark, d))


_SEEN = f"sensitivity_tier IS DISTINCT FROM 'restricted' AND classification = 'work'"  # noqa: F541
_FRESH = f"{_SEEN} AND created_at >= {_AT} - INTERVAL 5 DAY"


@query(f"WITH {NOTES_SQL} SELECT 'total' AS section, NULL AS item, count(*) AS n FROM notes WHERE {_SEEN} UNION ALL SELECT 'type', type, n FROM (SELECT type, count(*) AS n FROM notes WHERE {_FRESH} GROUP BY type ORDER BY n DESC, type NULLS FIRST LIMIT 20) UNION ALL {_top_sql('topics', 'topic', _FRESH, 20)}")
def brain_stats_of_class(spark, d):
    return stats.brain_stats(views.notes(spark, d), at(NOW), 5, "work")


@query(f"WITH {NOTES_SQL} SELECT type, count(*) AS n FROM (SELECT coalesce(type, 'unknown') AS type FROM notes WHERE review_status = 'pending_review') GROUP BY type")
def pending_by_type(spark, d):
    return stats.pending_by_type(views.notes(spark, d))


@query("SELECT count(*) AS n, round(avg((l_quantity + l_discount + l_tax) / 3), 6) AS average, round(avg(l_quantity), 6) AS existence, round(avg(l_discount), 6) AS relevance, round(avg(l_tax), 6) AS sufficiency FROM lineitem")
def evaluation_summary(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_quantity").cast("double").alias("existence"), F.col("l_discount").cast("double").alias("relevance"), F.col("l_tax").cast("double").alias("sufficiency"))
    return stats.evaluation_summary(rows).select("n", *[F.round(c, 6).alias(c) for c in ("average", "existence", "relevance", "sufficiency")])


@query(f"""WITH {NOTES_SQL} SELECT e.event_id, coalesce(CASE WHEN event_type <> 'view' THEN event_type END, 'general') AS reflection_type, n.serial_id, md5(substr(regexp_replace(coalesce(content, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), 1, 160)) AS preview_md5
FROM events e JOIN (SELECT DISTINCT user_id % 20 AS thought_id FROM events WHERE event_id % 7 = 2) l ON e.user_id = l.thought_id LEFT JOIN notes n ON n.id = l.thought_id""")
def entity_reflections(spark, d):
    events = table(spark, d, "events")
    links = events.select((F.col("event_id") % 7).alias("entity_id"), (F.col("user_id") % 20).alias("thought_id"))
    notes_ = events.select("event_id", F.col("user_id").alias("thought_id"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("reflection_type"))
    return stats.reflections_of(2, links, notes_, views.notes(spark, d)).select("event_id", "reflection_type", "serial_id", F.md5("preview").alias("preview_md5"))


@query("SELECT o_orderkey AS thought_id, o_custkey % 5 AS attempt_count FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 3")
def queue_failures(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("thought_id"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("done").alias("status"), (F.col("o_custkey") % 5).alias("attempt_count"), F.lit("e").alias("last_error"), F.col("o_orderdate").alias("processed_at"))
    return stats.last_failures(rows).select("thought_id", "attempt_count")


@query(f"""WITH {NOTES_SQL}, t AS (SELECT serial_id, created_at, coalesce(nullif(regexp_extract(coalesce(content, ''), '((?:19|20)[0-9]{{2}})', 1), ''), year(created_at)::VARCHAR) AS year FROM notes)
SELECT serial_id, year, rank FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY created_at, serial_id) AS rank FROM t) WHERE rank <= 300""")
def year_buckets(spark, d):
    return stats.year_buckets(views.notes(spark, d), F.coalesce("content", F.lit(""))).select("serial_id", "year", F.col("rank").cast("bigint").alias("rank"))


_ITEMS = "SELECT p_partkey AS recipe_id, i, split_part(p_name, ' ', i) AS name, p_brand AS unit, (p_size + i)::VARCHAR AS quantity FROM part, (SELECT unnest([1, 2]) AS i)"


@query(f"""SELECT name, unit, string_agg(quantity, ' + ' ORDER BY o_orderkey, i, quantity) AS quantity, count(*) AS uses FROM orders JOIN ({_ITEMS}) ON recipe_id = 1 + o_orderkey % 150 WHERE o_orderkey <= 1500 GROUP BY ALL""")
def shopping_list(spark, d):
    plans = table(spark, d, "orders").where("o_orderkey <= 1500").select(F.col("o_orderkey").alias("plan_id"), (1 + F.col("o_orderkey") % 150).alias("recipe_id"))
    item = lambda i: F.struct(F.split_part("p_name", F.lit(" "), F.lit(i)).alias("name"), F.col("p_brand").alias("unit"), (F.col("p_size") + i).cast("string").alias("quantity"))
    recipes = table(spark, d, "part").select(F.col("p_partkey").alias("recipe_id"), F.array(item(1), item(2)).alias("ingredients"))
    return stats.shopping_list(plans, recipes)


@query("SELECT o_custkey % 50 AS lesson_id, round(avg(o_orderkey % 101), 1) AS average, max(o_orderkey % 101) AS best, count(*) AS attempts, count(*) FILTER (o_orderstatus = 'F') AS completed FROM orders GROUP BY 1")
def quiz_report(spark, d):
    rows = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("lesson_id"), (F.col("o_orderkey") % 101).alias("score"), (F.col("o_orderstatus") == "F").alias("completed"))
    return curation.quiz_report(rows)


@query("""WITH m AS (SELECT conv_id AS thread_id, count(DISTINCT turn) AS messages, sum(len(string_split_regex(trim(text), '\\s+'))) AS words FROM conversations GROUP BY 1) SELECT thread_id FROM m WHERE words >= 200 AND messages >= 2""")
def wiki_eligible(spark, d):
    words = F.sum(F.size(F.split(F.trim("text"), r"\s+"))).alias("words")
    rows = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("thread_id")).agg(F.count_distinct("turn").alias("messages"), words, F.lit(0).alias("atoms"))
    return stats.wiki_eligible(rows, 200).select("thread_id")


_LAYERS = ("rhythm", "decisions", "dependencies", "knowledge", "friction")
_LAYER_SQL = "CASE l_linenumber % 5 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_LAYERS)) + " END"


def _layered(spark, d):
    return table(spark, d, "lineitem").where("l_orderkey < 400").selectExpr(f"{_LAYER_SQL} AS layer", "l_orderkey % 3 AS version", "l_orderkey * 10 + l_linenumber AS position", "CAST(l_partkey AS string) AS entry", "CASE l_linenumber % 3 WHEN 0 THEN 'daily' WHEN 1 THEN 'weekly' END AS cadence", "l_linestatus AS line_status", "l_returnflag AS flag")


@query(f"""WITH e AS (SELECT {_LAYER_SQL} AS layer, l_orderkey % 3 AS version, l_orderkey * 10 + l_linenumber AS position, l_partkey::VARCHAR AS entry FROM lineitem WHERE l_orderkey < 400), n AS (SELECT layer, max(version) AS version FROM e GROUP BY layer)
SELECT e.layer, e.version, string_agg(entry, ',' ORDER BY position, entry) AS entries FROM e JOIN n ON n.layer = e.layer AND n.version = e.version GROUP BY ALL""")
def model_layers(spark, d):
    return curation.layer_entries(_layered(spark, d), _LAYERS).select("layer", "version", joined("entries"))


@query(f"""WITH e AS (SELECT {_LAYER_SQL} AS layer, l_orderkey * 10 + l_linenumber AS position, CASE l_linenumber % 3 WHEN 0 THEN 'daily' WHEN 1 THEN 'weekly' END AS cadence, l_returnflag AS flag, l_linestatus AS ls FROM lineitem WHERE l_orderkey < 400)
SELECT position FROM e WHERE cadence ILIKE '%ai%' AND flag <> 'N' AND ls = 'F' AND ('s' || flag) ILIKE '%sa%' AND (layer || ' ' || flag) ILIKE '%ion%'""")
def model_slice(spark, d):
    rows = _layered(spark, d).withColumns({
        "stakeholders": F.array(F.concat(F.lit("s"), "flag")), "status": F.when((F.col("flag") != "N") & (F.col("line_status") == "F"), "unresolved").otherwise("done"), "priority": F.lit("low"),
        "title": F.col("layer"), "summary": F.col("flag"), "trigger": F.lit(None).cast("string"), "inputs": F.array().cast("array<string>"), "constraints": F.array().cast("array<string>"), "details": F.lit("{}"),
    }).withColumn("stakeholders", F.col("stakeholders"))
    return curation.model_slice(rows, keyword="ion", cadence="AI", stakeholder="sa", unresolved=True).select("position")


# ---- constellation with its parameters --------------------------------------------------------

_SCOPE = f"SELECT id FROM entity_thoughts WHERE created_at >= TIMESTAMP '{ORDERS_END}' - INTERVAL 200 DAY AND classification = 'work'"
_KINDS = "CASE s_nationkey % 3 WHEN 0 THEN 'person' WHEN 1 THEN 'tool' ELSE 'topic' END"


def _scope(spark, d):
    return graph.scoped(views.entity_thoughts(spark, d), at(ORDERS_END), 200, "work")


@query(f"""WITH {LINKS_SQL}, {ENTITY_THOUGHTS_SQL} SELECT entity_id, s_name AS name, count(*) AS mentions FROM links JOIN supplier ON s_suppkey = entity_id WHERE thought_id IN ({_SCOPE}) AND {_KINDS} NOT IN ('tool', 'place') GROUP BY ALL ORDER BY mentions DESC, entity_id LIMIT 5""")
def top_entities_of_class(spark, d):
    found = graph.top_entities(views.links(spark, d), views.entity_thoughts(spark, d), views.entities(spark, d), at(ORDERS_END), 200, 5, "work", ("tool", "place"))
    return found.select("entity_id", "name", "mentions")


@query(f"""WITH {LINKS_SQL}, {ENTITY_THOUGHTS_SQL}, l AS (SELECT * FROM links WHERE entity_id IN (1, 2, 3, 4, 5, 6) AND thought_id IN ({_SCOPE})) SELECT a.entity_id AS a, b.entity_id AS b, count(*) AS weight FROM l a JOIN l b ON a.thought_id = b.thought_id AND a.entity_id < b.entity_id GROUP BY ALL""")
def co_occurrence_of_ids(spark, d):
    return graph.co_occurrence(views.links(spark, d), 1, [1, 2, 3, 4, 5, 6], _scope(spark, d))


@query(_focus_sql("1").replace("WITH ", f"WITH {ENTITY_THOUGHTS_SQL}, all_", 1).replace(", s AS (SELECT", f", links AS (SELECT * FROM all_links WHERE thought_id IN ({_SCOPE})), x AS (SELECT s_suppkey FROM supplier WHERE {_KINDS} = 'tool'), s AS (SELECT", 1).replace("SELECT * FROM e)", "SELECT * FROM e) WHERE entity_id NOT IN (FROM x)", 1))
def focus_neighbors_of_class(spark, d):
    tools = views.entities(spark, d).where("entity_type = 'tool'")
    return graph.focus_neighbors(views.links(spark, d), views.edges(spark, d), [1], scope=_scope(spark, d), excluded=tools)


@query(f"""WITH {NOTES_SQL}, o AS (SELECT topics AS t, people AS p FROM notes WHERE id = 4), c AS (SELECT n.id, type, created_at, list_filter(topics, lambda x: list_contains(t, x)) AS st, list_filter(people, lambda x: list_contains(p, x)) AS sp, substr(content, 1, 200) AS preview FROM notes n, o WHERE id <> 4 AND sensitivity_tier <> 'restricted')
SELECT id, type, md5(preview) AS preview_md5, array_to_string(st, ',') AS shared_topics, array_to_string(sp, ',') AS shared_people, len(st) + len(sp) AS overlap FROM c WHERE len(st) + len(sp) > 0 ORDER BY len(st) + len(sp) DESC, created_at DESC, id DESC LIMIT 20""")
def thought_connections(spark, d):
    rows = graph.thought_connections(views.notes(spark, d), 4)
    return rows.select("id", "type", F.md5("preview").alias("preview_md5"), joined("shared_topics"), joined("shared_people"), F.col("overlap").cast("bigint").alias("overlap"))


@query("SELECT 'n' || s_nationkey AS node, 'out' AS direction, n_name AS label FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey = 1")
def node_neighbors(spark, d):
    nodes = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("label"))
    return graph.neighbors(nodes, _places(spark, d), "s1").select("node", "direction", "label")


@query(f"WITH {LINKS_SQL} SELECT thought_id AS id, string_agg(s_name, ',' ORDER BY entity_id) AS names FROM links JOIN supplier ON s_suppkey = entity_id GROUP BY thought_id")
def thoughts_with_entities(spark, d):
    rows = graph.with_entities(views.entity_thoughts(spark, d), views.links(spark, d), views.entities(spark, d)).where("entities IS NOT NULL")
    return rows.select("id", F.array_join(F.transform("entities", lambda e: e["name"]), ",").alias("names"))


@query(f"""WITH {LINKS_SQL}, {ENTITY_THOUGHTS_SQL}, f AS (SELECT id FROM entity_thoughts ORDER BY created_at DESC, id DESC LIMIT 8) SELECT entity_id, count(*) AS n FROM links WHERE thought_id IN (SELECT id FROM f) GROUP BY entity_id ORDER BY n DESC, entity_id LIMIT 6""")
def recent_entities(spark, d):
    return graph.recent_entities(views.links(spark, d), views.entity_thoughts(spark, d), views.entities(spark, d)).select("entity_id", "n")


@query(f"WITH {LINKS_SQL}, n AS (SELECT entity_id AS id, count(*) AS links FROM links GROUP BY 1 HAVING count(*) >= 50) SELECT id, links FROM n JOIN supplier ON s_suppkey = id ORDER BY s_acctbal DESC, id LIMIT 10")
def batch_candidates(spark, d):
    seen = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("last_seen_at"))
    return graph.batch_candidates(seen, views.links(spark, d), 50, 10).select("id", "links")


@query(f"WITH {EDGES_SQL} SELECT s_suppkey AS id FROM supplier WHERE s_suppkey NOT IN (SELECT from_entity_id FROM edges WHERE relation = 'A' AND support_count > 22) AND s_suppkey NOT IN (SELECT to_entity_id FROM edges WHERE relation = 'A' AND support_count > 22)")
def unlinked_entities(spark, d):
    return graph.unlinked(views.entities(spark, d), views.edges(spark, d).where("relation = 'A' AND support_count > 22")).select("id")


@query(f"""WITH {EDGES_SQL}, e AS (SELECT *, from_entity_id::VARCHAR || '-' || to_entity_id || '-' || relation AS id FROM edges)
SELECT id, 'out' AS direction, to_entity_id AS other, s_name AS other_name FROM e JOIN supplier ON s_suppkey = to_entity_id WHERE from_entity_id = 1 UNION ALL SELECT id, 'in', from_entity_id, s_name FROM e JOIN supplier ON s_suppkey = from_entity_id WHERE to_entity_id = 1 AND from_entity_id <> 1""")
def entity_adjacency(spark, d):
    rows = views.edges(spark, d).withColumn("id", F.concat_ws("-", "from_entity_id", "to_entity_id", "relation"))
    return graph.adjacency(rows, views.entities(spark, d), 1).select("id", "direction", "other", "other_name")


@query("SELECT s_suppkey AS id FROM supplier WHERE (s_name ILIKE '%1%' OR lower(s_name) ILIKE '%1%') AND s_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 4 = 0) ORDER BY s_name, id LIMIT 100")
def search_entities(spark, d):
    have = views.entities(spark, d).where("id % 4 = 0").select(F.col("id").alias("entity_id"))
    return search.search_entities(views.entities(spark, d), "1", have).select("id")


def _pages(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity_id"), F.concat(F.lit("page "), (F.col("s_suppkey") % 7).cast("string")).alias("title"), F.concat(F.lit("s-"), "s_suppkey").alias("slug"), F.col("s_acctbal").alias("generated_at"))


@query("""WITH p AS (SELECT s_suppkey, 'page ' || s_suppkey % 7 AS title, 's-' || s_suppkey AS slug, s_name FROM supplier), h AS (SELECT slug, title, 0 AS rank FROM p WHERE title ILIKE '%3%' UNION ALL SELECT slug, title, 1 FROM p WHERE s_name ILIKE '%3%')
SELECT slug, title, min(rank) AS rank FROM h GROUP BY slug, title ORDER BY rank, title, slug LIMIT 20""")
def wiki_search(spark, d):
    return curation.wiki_search(_pages(spark, d), views.entities(spark, d), "3")


@query(f"""WITH {_QUERY_VECTOR}, l AS (SELECT vec_id AS thought_id FROM embeddings WHERE vec_id % 50 = 1), s AS (SELECT vec_id AS thought_id, {_COS} AS similarity FROM embeddings e, q)
SELECT thought_id, 'linked' AS how FROM l UNION ALL SELECT thought_id, 'similar' FROM (SELECT * FROM s WHERE thought_id NOT IN (FROM l) ORDER BY similarity DESC, thought_id LIMIT 30)""")
def wiki_context(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("thought_id"), vectors.cosine(F.col("embedding"), vectors.vector(_query_vector(spark, d))).alias("similarity"))
    return curation.wiki_context(rows.where("thought_id % 50 = 1"), rows)


# ---- reports ----------------------------------------------------------------------------------


@query(f"WITH {NOTES_SQL} SELECT serial_id FROM notes WHERE created_at >= {_AT} - INTERVAL 72 HOUR AND source_type = (SELECT min(source) FROM documents) ORDER BY created_at DESC, serial_id DESC LIMIT 50")
def capture_review(spark, d):
    first = table(spark, d, "documents").agg(F.min("source")).first()[0]
    return search.capture_review(views.notes(spark, d), at(NOW), 72, 50, (first,)).select("serial_id")


@query(f"WITH {NOTES_SQL}, f AS (SELECT * FROM notes WHERE created_at >= {_AT} - INTERVAL 168 HOUR AND len(action_items) > 0 AND classification = 'personal' ORDER BY created_at DESC, serial_id DESC LIMIT 30) SELECT serial_id, (i - 1)::INT AS nth, action_items[i] AS item FROM f, (SELECT unnest([1, 2]) AS i)")
def list_action_items(spark, d):
    return search.action_items(views.notes(spark, d), at(NOW), 168, 30, "personal").select("serial_id", "nth", "item")


@query(f"WITH {NOTES_SQL} SELECT serial_id FROM notes WHERE review_status = 'pending_review' ORDER BY created_at DESC, serial_id DESC LIMIT 50")
def list_pending_review(spark, d):
    return search.pending_review(views.notes(spark, d)).select("serial_id")


@query(f"""WITH {NOTES_SQL}, {LINKS_SQL}, w AS (SELECT * FROM notes WHERE classification = 'work'), r AS (SELECT * FROM w WHERE created_at >= {_AT} - INTERVAL 48 HOUR), a AS (SELECT * FROM r WHERE len(action_items) > 0 ORDER BY created_at DESC, serial_id DESC LIMIT 20),
m AS (SELECT entity_id, count(*) AS n FROM links WHERE thought_id IN (SELECT id FROM r ORDER BY created_at DESC, id DESC LIMIT 8) GROUP BY entity_id ORDER BY n DESC, entity_id LIMIT 6)
SELECT 'cards' AS section, row_number() OVER (ORDER BY importance DESC, serial_id DESC) AS rank, serial_id::VARCHAR AS key FROM (SELECT * FROM w WHERE status IN ('active', 'planning') AND type IN ('task', 'idea') ORDER BY importance DESC, serial_id DESC LIMIT 15)
UNION ALL SELECT 'recent', row_number() OVER (ORDER BY created_at DESC, serial_id DESC), serial_id::VARCHAR FROM (SELECT * FROM r ORDER BY created_at DESC, serial_id DESC LIMIT 8)
UNION ALL SELECT 'entities', row_number() OVER (ORDER BY n DESC, entity_id), entity_id::VARCHAR FROM m
UNION ALL SELECT 'actions', rank, serial_id::VARCHAR FROM (SELECT serial_id, row_number() OVER (ORDER BY created_at DESC, serial_id DESC, i) AS rank FROM a, (SELECT unnest([1, 2]) AS i)) WHERE rank <= 10
UNION ALL SELECT 'pages', row_number() OVER (ORDER BY s_acctbal DESC, slug), slug FROM (SELECT s_acctbal, 's-' || s_suppkey AS slug FROM supplier ORDER BY s_acctbal DESC, slug LIMIT 4)""")
def context_brief(spark, d):
    rows = search.context_brief(views.notes(spark, d), views.links(spark, d), views.entities(spark, d), _pages(spark, d), at(NOW), 48, "work")
    return rows.select("section", F.col("rank").cast("bigint").alias("rank"), "key")


@query(f"WITH {NOTES_SQL} SELECT serial_id FROM notes WHERE list_contains(topics, 't1') ORDER BY CASE WHEN serial_id IN (7, 23, 40) THEN 0 ELSE 1 END, serial_id LIMIT 40")
def persona_pool(spark, d):
    return stats.persona_pool(views.notes(spark, d).where(F.array_contains("topics", "t1")), [7, 23, 40]).select("serial_id")


@query("SELECT event_id AS id FROM events WHERE event_type = (SELECT min(event_type) FROM events) ORDER BY ts DESC, id DESC LIMIT 10")
def recent_reports(spark, d):
    events = table(spark, d, "events")
    first = events.agg(F.min("event_type")).first()[0]
    return stats.recent_reports(events.select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.col("ts").alias("created_at")), first).select("id")


@query(f"WITH {NOTES_SQL} SELECT serial_id, type FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY importance DESC, serial_id DESC) AS r FROM notes WHERE type IN ('task', 'idea')) WHERE r <= 100")
def board_cards(spark, d):
    return stats.board_cards(views.notes(spark, d)).select("serial_id", "type")


@query(f"WITH {NOTES_SQL} SELECT serial_id, CASE WHEN len(topics) = 0 AND len(tags) = 0 AND len(people) = 0 THEN 'untagged' ELSE 'over_tagged' END AS rule FROM notes WHERE (len(topics) = 0 AND len(tags) = 0 AND len(people) = 0) OR len(tags) > 10")
def lint_tags(spark, d):
    rows = views.notes(spark, d).select("serial_id", F.struct("topics", "tags", "people").alias("metadata"))
    return stats.untagged(rows).select("serial_id", F.lit("untagged").alias("rule")).union(stats.over_tagged(rows).select("serial_id", F.lit("over_tagged").alias("rule")))


@query(f"WITH t AS (SELECT doc_id, coalesce(text, '') AS content FROM documents), f AS (SELECT doc_id, {_FULL} AS fingerprint FROM t) SELECT fingerprint, count(*) AS copies, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids FROM f WHERE fingerprint <> '' GROUP BY fingerprint HAVING count(*) > 1")
def lint_duplicate_ids(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("serial_id"), F.col("text").alias("content"))
    return stats.exact_duplicates(rows, ids=True).select("fingerprint", "copies", F.array_join("ids", ",").alias("ids"))
