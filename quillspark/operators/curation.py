"""Capture, review, blocklists, pages and repairs: the remaining changes to the store's tables."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import patterns

# ---- capture and review -----------------------------------------------------------------------


def capture(items: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New thoughts and repeated items of a batch (item, content, type, classification): the first
    item of every fingerprint that is not known yet is captured, with defaults."""
    rows = items.withColumn("fingerprint", text.fingerprint(F.col("content"))).where(text.trimmed(F.coalesce("content", F.lit(""))) != "")
    new = rows.join(known.select("fingerprint").distinct(), "fingerprint", "left_anti")
    first = new.groupBy("fingerprint").agg(F.min("item").alias("item"))
    kept = new.join(first, ["fingerprint", "item"], "left_semi")
    kept = kept.withColumns({"type": text.canonical_type(F.col("type")), "classification": F.when(F.lower("classification") == "work", "work").otherwise("personal")})
    return kept, rows.join(kept.select("item"), "item", "left_anti")


def job_counts(items: DataFrame) -> DataFrame:
    """Items of every job by action."""
    n = lambda a: F.count_if(F.col("action") == a)
    return items.groupBy("job_id").agg(n("add").alias("added"), n("skip").alias("skipped"), n("create_revision").alias("revised"), n("append_evidence").alias("appended"), F.count("*").alias("items"))


def duplicates_and_orphans(missing: DataFrame, fingerprinted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without a stored fingerprint whose text is there already, and those that are to be patched."""
    rows = missing.withColumn("fingerprint", text.fingerprint(F.col("content"), "loose"))
    old = fingerprinted.select("fingerprint").distinct()
    return rows.join(old, "fingerprint", "left_semi"), rows.join(old, "fingerprint", "left_anti")


def approve(thoughts: DataFrame, decisions: DataFrame) -> DataFrame:
    """Thoughts after review decisions (pending_id, action, target_id): UPDATE moves the pending
    content to its target and drops the pending row; NEW clears the review state."""
    moved = decisions.where("action = 'UPDATE'").join(thoughts.select(F.col("id").alias("pending_id"), F.col("content").alias("new")), "pending_id")
    latest = moved.groupBy(F.col("target_id").alias("id")).agg(F.max_by("new", "pending_id").alias("new"))
    fresh = decisions.where("action = 'NEW'").select(F.col("pending_id").alias("id"), F.lit(True).alias("fresh")).distinct()
    rows = thoughts.join(decisions.where("action = 'UPDATE'").select(F.col("pending_id").alias("id")), "id", "left_anti")
    rows = rows.join(latest, "id", "left").join(fresh, "id", "left")
    return rows.withColumns({"content": F.coalesce("new", "content"), "review_status": F.when(~F.coalesce("fresh", F.lit(False)), F.col("review_status"))}).drop("new", "fresh")


def enriched(thoughts: DataFrame, patches: DataFrame) -> DataFrame:
    """Thoughts after enrichment (id, type, importance): valid types, importance 1 to 5; all other
    columns stay, the source among them."""
    p = patches.select("id", F.when(F.lower("type").isin(*text.ALLOWED_TYPES), F.lower("type")).alias("new_type"), F.greatest(F.lit(1), F.least(F.lit(5), F.col("importance"))).alias("new_importance"))
    return thoughts.join(p, "id", "left").withColumns({"type": F.coalesce("new_type", "type"), "importance": F.coalesce("new_importance", "importance")}).drop("new_type", "new_importance")


def retyped(thoughts: DataFrame) -> DataFrame:
    """Types taken over from metadata where the row has the default one; with the reason."""
    own = F.col("metadata_type")
    reason = F.when(F.col("type") != "reference", "already_typed").when(own.isNull(), "no_metadata_type").when(~own.isin(*text.ALLOWED_TYPES), "invalid").when(own == "reference", "same").otherwise("updated")
    return thoughts.withColumn("reason", reason).withColumn("type", F.when(F.col("reason") == "updated", own).otherwise(F.col("type")))


def parsed_metadata(raw: Column) -> Column:
    """An object that was stored as a JSON string within JSON; null unless it is one."""
    once = F.get_json_object(F.concat(F.lit('{"v":'), raw, F.lit("}")), "$.v")
    return F.when(text.trimmed(once).startswith("{") & F.try_parse_json(once).isNotNull(), once)


def newsletters(thoughts: DataFrame) -> DataFrame:
    """Thoughts that open with the word Newsletter, as personal newsletters."""
    opens = F.coalesce(F.col("content").rlike(r"(?i)\ANewsletter[\s\x{2014}-]"), F.lit(False))
    return thoughts.withColumns({"type": F.when(opens, "newsletter").otherwise(F.col("type")), "classification": F.when(opens, "personal").otherwise(F.col("classification"))})


def routed(records: DataFrame) -> dict[str, DataFrame]:
    """One record's thoughts, interactions and action items, as a table each."""
    ids = [c for c in ("record_id", "person_id", "at") if c in records.columns]
    return {
        "thoughts": records.where("content IS NOT NULL").select(*ids, "content"),
        "interactions": records.where("person_id IS NOT NULL").select(*ids, "content"),
        "action_items": records.select(*ids, F.explode("action_items").alias("action_item")),
    }


# ---- entities and edges -----------------------------------------------------------------------


def aliases_changed(entities: DataFrame, changes: DataFrame) -> DataFrame:
    """Entities after alias changes (id, add array, remove array)."""
    none = F.array().cast("array<string>")
    rows = entities.join(changes.select("id", "add", "remove"), "id", "left")
    kept = F.array_except(F.array_union(F.coalesce("aliases", none), F.coalesce("add", none)), F.coalesce("remove", none))
    return rows.withColumn("aliases", kept).drop("add", "remove")


def renamed(entities: DataFrame, renames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities after renames (id, new_name, new_type), and (loser, winner) where another entity
    holds the new type and normal name already and is absorbed."""
    rows = entities.join(renames, "id", "left").withColumns({"name": F.coalesce("new_name", "name"), "entity_type": F.coalesce("new_type", "entity_type"), "moved": F.col("new_name").isNotNull() | F.col("new_type").isNotNull()})
    key = ["entity_type", "norm"]
    rows = rows.withColumn("norm", text.normal_name(F.col("name")))
    winner = rows.where("moved").groupBy(*key).agg(F.min("id").alias("winner"))
    losers = rows.join(winner, key).where("id <> winner").select(F.col("id").alias("loser"), "winner")
    return rows.join(losers.select(F.col("loser").alias("id")), "id", "left_anti").drop("new_name", "new_type", "moved", "norm"), losers


def manual_edges(wanted: DataFrame, edges: DataFrame, blocked: DataFrame, symmetric: tuple[str, ...]) -> DataFrame:
    """Edges that may be added by hand: normal form, not blocked, not there yet, confidence within
    0 and 1 (0.95 by default)."""
    even = F.col("relation").isin(*symmetric)
    keys = ["from_entity_id", "to_entity_id", "relation"]
    rows = wanted.where("from_entity_id <> to_entity_id").select(
        F.when(even, F.least("from_entity_id", "to_entity_id")).otherwise(F.col("from_entity_id")).alias("from_entity_id"),
        F.when(even, F.greatest("from_entity_id", "to_entity_id")).otherwise(F.col("to_entity_id")).alias("to_entity_id"),
        "relation", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.95)))).alias("confidence"),
    )
    return rows.dropDuplicates(keys).join(blocked.select(*keys), keys, "left_anti").join(edges.select(*keys), keys, "left_anti")


def unblocked(blocks: DataFrame, as_of: datetime, minutes: int) -> tuple[DataFrame, DataFrame]:
    """Blocks that stay, and those of the last minutes (1 to 720) that are undone."""
    since = F.lit(as_of) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(max(1, min(minutes, 720))))
    return blocks.where(F.col("created_at") < since), blocks.where(F.col("created_at") >= since)


def newest_link(links: DataFrame, thoughts: DataFrame, entities: DataFrame) -> DataFrame:
    """The newest thought of each of the entities, to be queued again."""
    rows = links.join(entities.select(F.col("id").alias("entity_id")), "entity_id", "left_semi").join(thoughts.select(F.col("id").alias("thought_id"), "created_at"), "thought_id")
    return rows.groupBy("entity_id").agg(F.max_by("thought_id", F.struct("created_at", "thought_id")).alias("thought_id"))


def distinct_pairs(edges: DataFrame, without: str = "co_occurs_with") -> DataFrame:
    return edges.where(F.col("relation") != without).select(F.least("from_entity_id", "to_entity_id").alias("a"), F.greatest("from_entity_id", "to_entity_id").alias("b")).distinct()


#: Entities of a thought up to which all its pairs are counted.
PAIRED = 64


def grounded(pairs: DataFrame, links: DataFrame, named: DataFrame | None = None, thoughts: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) by the number of thoughts that link both ends.

    All pairs of a thought of at most PAIRED entities are counted, which is linear in the links; in
    larger thoughts only the pairs asked for are looked up, which such hubs would else square.
    With ``named`` (id, name) and ``thoughts`` (id, content), pairs that no thought links count the
    thoughts whose content holds both names instead."""
    # a thought's entities lie together from here on, and nothing but pairs is dealt again
    each = links.select("thought_id", "entity_id").where("thought_id IS NOT NULL AND entity_id IS NOT NULL").repartition("thought_id").distinct()
    each = each.withColumn("n", F.count("*").over(Window.partitionBy("thought_id")))
    few, many = each.where(F.col("n") <= PAIRED), each.where(F.col("n") > PAIRED)
    low, high = few.select("thought_id", F.col("entity_id").alias("low")), few.select("thought_id", F.col("entity_id").alias("high"))
    n = low.join(high, "thought_id").where("low <= high").groupBy("low", "high").agg(F.count("*").alias("n"))
    ends = {"low": F.when(F.col("a") <= F.col("b"), F.col("a")).otherwise(F.col("b")), "high": F.when(F.col("a") <= F.col("b"), F.col("b")).otherwise(F.col("a"))}
    wanted = pairs.withColumns(ends)
    at = many.select("thought_id", F.col("entity_id").alias("low")).join(wanted, "low")
    large = at.join(many.select("thought_id", F.col("entity_id").alias("high")), ["thought_id", "high"]).groupBy("low", "high").agg(F.count_distinct("thought_id").alias("n"))  # a pair may be given twice
    n = n.unionByName(large).groupBy("low", "high").agg(F.sum("n").alias("grounding"))
    out = wanted.join(n, ["low", "high"], "left")
    out = out.drop("low", "high").withColumn("grounding", F.coalesce("grounding", F.lit(0).cast("bigint")))
    if named is None or thoughts is None:
        return out
    # an automaton over all names reads each thought's words once
    run = lambda c: F.concat(F.lit(" "), F.array_join(text.tokens(F.coalesce(c, F.lit(""))), " "), F.lit(" "))
    names = named.select("id", run("name").alias("pattern")).where(F.length("pattern") > 2)
    found = patterns.contained(thoughts.select(F.col("id").alias("thought_id"), run("content").alias("text")), names, "thought_id")
    held = found.join(names, "pattern").select(F.col("id").alias("entity_id"), "thought_id").distinct()
    rest = grounded(out.where("grounding = 0").select("a", "b"), held)
    return out.where("grounding > 0").unionByName(rest)


#: What is no topic. File endings, dates and quarters, paths, keys, amounts, tickets,
#: numbered articles, and nouns that name nothing.
FILE_ENDING = r"(?i)\.(md|markdown|json|ya?ml|toml|env|ini|cfg|sql|tsx?|jsx?|mjs|cjs|py|rb|go|rs|sh|ps1|bat|txt|csv|log|html?|css|scss|xml)$"
DATE_FORM = r"(?i)^(\d{4}-\d{1,2}-\d{1,2}|\d{1,2}/\d{1,2}/\d{2,4}|Q[1-4](\s*\d{4})?|\d{4}\s*Q[1-4]|H[12](\s*\d{4})?)$"
FILE_PATH = r"(?i)^[./\\]|^[\w-]+/[\w\-./\\]+\.[a-z]{1,5}$"
SETTING_KEY = r"^[a-z][a-z0-9]*(_[a-z0-9]+){1,}$"
AMOUNT = r"^[\x{a3}$\x{20ac}]?\s*[\d,]+(\.\d+)?\s*[kKmMbB%]?$"
TICKET = r"^[A-Z]{2,5}-\d+$"
ARTICLE_NUMBER = r"^\d[\d,]*\s*-\s*\w"
EMPTY_NOUNS = (
    "funder", "funders", "rate book", "rate books", "the meeting", "the system", "the bot", "the dashboard", "the tool", "the project", "the platform",
    "the team", "the vendor", "the client", "the customer", "stakeholder meetings", "stakeholder meeting", "poc milestones", "poc milestone",
    "end-of-quarter period", "weekly standup", "daily standup", "all-hands", "the call", "the chat", "the email", "the demo", "the proposal",
)


def is_junk_topic(name: Column) -> Column:
    """Whether a name is no topic: too short, a date, a file, a setting, an amount, a ticket, a
    numbered article or a noun that names nothing."""
    t = text.trimmed(F.coalesce(name, F.lit("")))
    forms = [t.rlike(p) for p in (DATE_FORM, FILE_ENDING, FILE_PATH, SETTING_KEY, AMOUNT, TICKET, ARTICLE_NUMBER)]
    return reduce(Column.__or__, forms, F.char_length(t) < 2) | F.lower(t).isin(*EMPTY_NOUNS)


#: Relations that may be extracted; those that a newsletter cannot be the source of,
#: and the target of.
RELATIONS = (
    "works_on", "uses", "uses_tool", "collaborates_with", "integrates_with", "alternative_to", "evaluates", "member_of", "located_in", "related_to",
    "co_occurs_with", "published_by", "references", "knew", "friend_of", "family_of", "mentor_of", "introduced_via",
)
NEWSLETTER_NO_SOURCE = ("works_on", "uses", "uses_tool", "evaluates", "integrates_with", "alternative_to", "collaborates_with", "member_of", "located_in", "related_to")
NEWSLETTER_NO_TARGET = ("works_on", "uses", "uses_tool", "evaluates", "integrates_with", "alternative_to", "collaborates_with", "member_of", "located_in")


def valid_relations(relations: DataFrame, entities: DataFrame, least: float = 0.5) -> DataFrame:
    """Extracted relations (thought_id, from_name, to_name, relation, confidence, is_newsletter) that
    may become edges, by the entities (thought_id, name, entity_type, is_author) of the same thought.

    Both ends are known and different, the relation is one of RELATIONS, the confidence enough
    (null counts as ``least``). A newsletter only takes part as fits it: published_by leads from one
    to a person, references lead to one. In newsletters the author has no edge but published_by."""
    known = entities.groupBy("thought_id", text.normal_name(F.col("name")).alias("n")).agg(F.max("entity_type").alias("kind"), F.bool_or("is_author").alias("author"))
    end = lambda side: known.select("thought_id", *[F.col(c).alias(f"{side}_{c}") for c in ("n", "kind", "author")])
    rows = relations.withColumns({"from_n": text.normal_name(F.col("from_name")), "to_n": text.normal_name(F.col("to_name")), "relation": F.lower(F.trim("relation"))})
    rows = rows.where((F.col("from_n") != F.col("to_n")) & F.col("relation").isin(*RELATIONS) & (F.coalesce("confidence", F.lit(0.5)) >= least))
    rows = rows.join(end("from"), ["thought_id", "from_n"]).join(end("to"), ["thought_id", "to_n"])
    paper = lambda side: F.col(f"{side}_kind") == "newsletter"
    fits = (
        ~(paper("from") & F.col("relation").isin(*NEWSLETTER_NO_SOURCE)) & ~(paper("to") & F.col("relation").isin(*NEWSLETTER_NO_TARGET))
        & ((F.col("relation") != "published_by") | (paper("from") & (F.col("to_kind") == "person"))) & ((F.col("relation") != "references") | paper("to"))
        & ((F.col("relation") == "published_by") | ~(F.col("is_newsletter") & (F.col("from_author") | F.col("to_author"))))
    )
    return rows.where(fits).select(*relations.columns)


def deleted_edges(edges: DataFrame, evidence: DataFrame, gone: DataFrame, thoughts: DataFrame) -> dict[str, DataFrame]:
    """Tables after edges (from_entity_id, to_entity_id, relation) are deleted by hand: the edges and
    evidence left, what is blocked, and for each edge the newest thought of its evidence to queue."""
    keys = ["from_entity_id", "to_entity_id", "relation"]
    blocked = gone.select(*keys).distinct()
    dated = evidence.join(blocked, keys, "left_semi").join(thoughts.select(F.col("id").alias("thought_id"), "created_at"), "thought_id")
    newest = dated.groupBy(*keys).agg(F.max_by("thought_id", F.struct("created_at", "thought_id")).alias("thought_id"))
    return {"edges": edges.join(blocked, keys, "left_anti"), "evidence": evidence.join(blocked, keys, "left_anti"), "blocked": blocked, "queue": newest.select("thought_id").distinct()}


def blocks_named(blocks: DataFrame, entities: DataFrame) -> DataFrame:
    """Blocked edges with the names of both ends, null where the entity is gone."""
    name = lambda c: entities.select(F.col("id").alias(c), F.col("name").alias(c.replace("_entity_id", "_name")))
    return blocks.join(name("from_entity_id"), "from_entity_id", "left").join(name("to_entity_id"), "to_entity_id", "left")


def resplit(changes: DataFrame, links: DataFrame) -> DataFrame:
    """All thoughts that link an entity (id) one of whose aliases is taken away to stand alone."""
    return links.join(changes.select(F.col("id").alias("entity_id")).distinct(), "entity_id", "left_semi").select("thought_id").distinct()


def absorbed_aliases(entities: DataFrame, added: DataFrame) -> DataFrame:
    """(loser, winner) of entities whose loose name is an alias (id, alias) that another one is given;
    of several winners the smallest."""
    new = added.select(F.col("id").alias("winner"), text.loose_name(F.col("alias")).alias("n")).where("n <> ''")
    own = entities.select(F.col("id").alias("loser"), text.loose_name(F.col("name")).alias("n"))
    return own.join(new, "n").where("loser <> winner").groupBy("loser").agg(F.min("winner").alias("winner"))


def related_entities(wanted: DataFrame, entities: DataFrame) -> DataFrame:
    """Entity of each name (item, name) by search: one of that name in any case, else the only one
    whose name or alias holds it; with state exact, single, ambiguous or none."""
    asked = wanted.select("item", F.lower(F.trim("name")).alias("q")).where("q <> ''")
    spelled = entities.select("id", F.lower("name").alias("own"), F.explode(F.array_append("aliases", F.col("name"))).alias("alias")).select("id", "own", F.lower("alias").alias("alias"))
    exact = asked.join(spelled.select("id", F.col("own").alias("q")).distinct(), "q").groupBy("item").agg(F.min("id").alias("exact"))
    found = patterns.contained(spelled, asked.select(F.col("q").alias("pattern")), text="alias")
    held = found.join(asked.withColumnRenamed("q", "pattern"), "pattern")
    held = held.select("item", "id").distinct().groupBy("item").agg(F.count("*").alias("n"), F.min("id").alias("only"))
    rows = wanted.select("item", "name").join(exact, "item", "left").join(held, "item", "left")
    state = F.when(F.col("exact").isNotNull(), "exact").when(F.col("n") == 1, "single").when(F.col("n") > 1, "ambiguous").otherwise("none")
    return rows.select("item", "name", F.coalesce("exact", F.when(F.col("n") == 1, F.col("only"))).alias("entity_id"), state.alias("state"))


def without_linked_pairs(wanted: DataFrame, edges: DataFrame) -> DataFrame:
    """Wanted edges whose two ends no edge joins yet, whichever way."""
    ends = lambda df: df.select(F.least("from_entity_id", "to_entity_id").alias("lo"), F.greatest("from_entity_id", "to_entity_id").alias("hi"))
    rows = wanted.withColumns({"lo": F.least("from_entity_id", "to_entity_id"), "hi": F.greatest("from_entity_id", "to_entity_id")})
    return rows.join(ends(edges).distinct(), ["lo", "hi"], "left_anti").drop("lo", "hi")


# ---- pages, memories and reports --------------------------------------------------------------


def upsert_pages(pages: DataFrame, new: DataFrame) -> DataFrame:
    """Pages by slug, the new ones first; edited pages keep their content."""
    rows = pages.select("slug", "title", "content", "manually_edited").join(new.select("slug", F.col("title").alias("t"), F.col("content").alias("c")), "slug", "full")
    edited = F.coalesce("manually_edited", F.lit(False))
    return rows.select("slug", F.when(edited, F.col("title")).otherwise(F.coalesce("t", "title")).alias("title"), F.when(edited, F.col("content")).otherwise(F.coalesce("c", "content")).alias("content"), edited.alias("manually_edited"))


def wiki_search(pages: DataFrame, entities: DataFrame, query: str, most: int = 20) -> DataFrame:
    """Pages by title, then by an alias of their entity, each once."""
    like = f"%{query}%"
    named = entities.where(F.exists("aliases", lambda a: a.ilike(like))).select(F.col("id").alias("entity_id"))
    both = pages.where(F.col("title").ilike(like)).withColumn("rank", F.lit(0)).unionByName(pages.join(named, "entity_id", "left_semi").withColumn("rank", F.lit(1)))
    return both.groupBy("slug", "title").agg(F.min("rank").alias("rank")).orderBy("rank", "title", "slug").limit(most)


def wiki_context(linked: DataFrame, similar: DataFrame, most: int = 30) -> DataFrame:
    """Linked thoughts, then similar ones that are not linked, by similarity."""
    rest = similar.join(linked.select("thought_id"), "thought_id", "left_anti").orderBy(F.desc("similarity"), "thought_id").limit(most)
    return linked.select("thought_id", F.lit("linked").alias("how")).union(rest.select("thought_id", F.lit("similar").alias("how")))


def with_latest(rows: DataFrame, children: DataFrame, key: str, order: str, fields: list[str], n: int = 5) -> DataFrame:
    """Rows with an array of the newest ``n`` children."""
    w = Window.partitionBy(key).orderBy(F.desc(order), *fields)
    few = children.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n)
    listed = few.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", *fields))), lambda s: F.struct(*[s[f].alias(f) for f in fields])).alias("latest"))
    return rows.join(listed, key, "left")


def usage(recalled: DataFrame, used: DataFrame) -> DataFrame:
    """Recalled items (trace_id, memory_id) with whether they were used or ignored."""
    return recalled.join(used.select("trace_id", "memory_id", F.lit(True).alias("u")), ["trace_id", "memory_id"], "left").select("trace_id", "memory_id", F.coalesce("u", F.lit(False)).alias("used"))


def findings(messages: DataFrame, most: int = 5) -> DataFrame:
    """Finding lines of conversations (conv_id, turn, role, text) by category, the first ``most``
    of each; a line counts once in a conversation."""
    lines = messages.where(F.col("role").isin("user", "assistant")).select("conv_id", "turn", F.posexplode(text.finding_lines(F.coalesce("text", F.lit("")))).alias("pos", "line"))
    lines = lines.withColumn("category", text.finding_category(F.col("line"))).where("category IS NOT NULL")
    lines = lines.groupBy("conv_id", "category", "line").agg(F.min(F.struct("turn", "pos")).alias("at"))
    w = Window.partitionBy("conv_id", "category").orderBy("at", "line")
    return lines.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("conv_id", "category", "rank", "line")


def layer_entries(entries: DataFrame, layers: tuple[str, ...]) -> DataFrame:
    """The newest version of every layer, in the order of the layers, with its entries in order."""
    place = F.array_position(F.array(*map(F.lit, layers)), F.col("layer"))
    newest = entries.groupBy("layer").agg(F.max("version").alias("version"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("position", "entry"))), lambda s: s["entry"])
    return entries.join(newest, ["layer", "version"]).groupBy("layer", "version").agg(items.alias("entries")).withColumn("place", place).where("place > 0").orderBy("place")


def next_layer(done: Column, layers: tuple[str, ...]) -> Column:
    """The first layer that is not done, else review."""
    return F.coalesce(F.try_element_at(F.filter(F.array(*map(F.lit, layers)), lambda x: ~F.array_contains(done, x)), F.lit(1)), F.lit("review"))


def quiz_report(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy("lesson_id").agg(F.round(F.avg("score"), 1).alias("average"), F.max("score").alias("best"), F.count("*").alias("attempts"), F.count_if("completed").alias("completed"))


def identities(addresses: DataFrame, people: DataFrame) -> DataFrame:
    """Person of each address (address as 'Name <mail>'): by mail, else a person of that name who has
    no mail yet; null for new ones."""
    mail = F.lower(F.regexp_extract("address", r"([^\s<>]+@[^\s<>]+)", 1))
    name = text.normal_name(F.regexp_replace(F.regexp_extract("address", r"^\s*\"?([^\"<]*?)\"?\s*<", 1), '"', ""))
    rows = addresses.select("address", mail.alias("mail"), name.alias("name"))
    by_mail = people.where("mail IS NOT NULL").groupBy(F.lower("mail").alias("mail")).agg(F.min("id").alias("a"))
    by_name = people.where("mail IS NULL").groupBy(text.normal_name(F.col("name")).alias("name")).agg(F.min("id").alias("b"))
    return rows.join(by_mail, "mail", "left").join(by_name, "name", "left").select("address", "mail", F.coalesce("a", "b").alias("person"))


def address_list(header: Column) -> Column:
    """Addresses of a mail header as structs of name and mail, in order; commas and escaped marks
    within quotes belong to the name."""
    part = r'((?:"(?:[^"\\]|\\.)*"|[^",<>])*)<([^<>]*)>|([^\s",<>]+@[^\s",<>]+)'
    found = F.regexp_extract_all(header, F.lit(part), F.lit(0))
    name = lambda a: text.trimmed(F.regexp_replace(F.regexp_replace(F.regexp_replace(a, r"<[^<>]*>\s*$", ""), r'^[\s,]*"|"\s*$', ""), r"\\(.)", "$1"))
    mail = lambda a: F.lower(F.regexp_extract(a, r"([^\s<>,\"]+@[^\s<>,\"]+)>?\s*$", 1))
    return F.transform(found, lambda a: F.struct(F.when(F.contains(a, F.lit("<")), name(a)).otherwise("").alias("name"), mail(a).alias("mail")))


#: Kinds of secrets in a note, in the order in which they are tried.
SECRETS = [
    ("OpenAI/OpenRouter API key", r"sk-(?:or-v1-|proj-|live-)?[a-zA-Z0-9]{20,}"),
    ("JWT token", r"eyJ[a-zA-Z0-9_-]{20,}\.[a-zA-Z0-9_-]{20,}"),
    ("GitHub token", r"gh[ps]_[a-zA-Z0-9]{36,}"),
    ("GitHub OAuth token", r"gho_[a-zA-Z0-9]{36,}"),
    ("AWS access key", r"AKIA[0-9A-Z]{16}"),
    ("Supabase key", r"sbp_[a-zA-Z0-9]{20,}"),
    ("Private key block", r"-----BEGIN [A-Z ]+ PRIVATE KEY-----"),
    ("Generic secret assignment", r"(?i)(?:password|secret|token|api_key|apikey|api_secret|access_token|auth_token)\s*[=:]\s*[\"']?[a-zA-Z0-9_\-/.]{16,}"),
    ("Connection string with credentials", r"(?i)(?:postgres|mysql|mongodb|redis)://[^:]+:[^@]+@"),
]


def first_secret(content: Column) -> Column:
    """Label of the first kind of secret in a note, or null."""
    return F.coalesce(*[F.when(content.rlike(p), F.lit(n)) for n, p in SECRETS])


def key_owner(keys: DataFrame, agents: DataFrame, key_hash: str) -> DataFrame:
    """Agent of a key by its hash (64 digits, any case), if the key is active and not revoked."""
    asked = key_hash.strip().lower()
    found = keys.where((F.col("key_hash") == asked) & F.col("active") & F.col("revoked_at").isNull() & F.lit(len(asked) == 64))
    return found.join(agents, "agent_id").select("agent_id", "agent_label", "key_label")


def saved_layer(state: DataFrame, entries: DataFrame, saved: DataFrame, layers: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Sessions (session_id, completed array) and entries (session_id, layer, position, entry) after
    layers (session_id, layer, entries array) are saved: a saved layer's entries are replaced, it
    counts as completed, and the next open one is pending."""
    done = saved.groupBy("session_id").agg(F.collect_set("layer").alias("new"))
    rows = state.join(done, "session_id", "left")
    all_done = F.filter(F.array(*map(F.lit, layers)), lambda x: F.array_contains(F.array_union("completed", F.coalesce("new", F.array().cast("array<string>"))), x))
    sessions = rows.select("session_id", all_done.alias("completed")).withColumn("pending", next_layer(F.col("completed"), layers))
    kept = entries.join(saved.select("session_id", "layer"), ["session_id", "layer"], "left_anti").select("session_id", "layer", "position", "entry")
    return sessions, kept.union(saved.select("session_id", "layer", F.posexplode("entries").alias("position", "entry")).select("session_id", "layer", "position", "entry"))


def model_slice(entries: DataFrame, layer: str | None = None, keyword: str | None = None, cadence: str | None = None, stakeholder: str | None = None, unresolved: bool = False, friction: str | None = None) -> DataFrame:
    """Entries of an operating model by what is asked; without case."""
    has = lambda c, q: F.coalesce(F.contains(F.lower(c), F.lit(q.lower())), F.lit(False))
    rows = entries if layer is None else entries.where(F.col("layer") == layer)
    if cadence:
        rows = rows.where(has(F.col("cadence"), cadence))
    if stakeholder:
        rows = rows.where(F.exists("stakeholders", lambda s: has(s, stakeholder)))
    if unresolved:
        rows = rows.where("status = 'unresolved'")
    if friction:
        rows = rows.where((F.col("layer") == "friction") & (F.lower("priority") == friction))
    if keyword:
        rows = rows.where(has(F.concat_ws(" ", "title", "summary", "cadence", "trigger", "inputs", "stakeholders", "constraints", "details"), keyword))
    return rows


def pages_edited(pages: DataFrame, edits: DataFrame) -> DataFrame:
    """Pages after edits by hand (slug, content, notes): what is given replaces, new content marks the
    page as edited."""
    rows = pages.join(edits.select("slug", F.col("content").alias("c"), F.col("notes").alias("n")), "slug", "left")
    return rows.withColumns({"manually_edited": F.coalesce("manually_edited", F.lit(False)) | F.col("c").isNotNull(), "content": F.coalesce("c", "content"), "notes": F.coalesce("n", "notes")}).drop("c", "n")


def executed(items: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Thoughts that a job's items (job_id, item, action, content) become, and the counts by job:
    items to add whose text is new; all others are skipped."""
    rows = items.withColumn("fingerprint", text.fingerprint(F.col("content")))
    first = rows.where("action = 'add' AND fingerprint <> ''").join(known.select("fingerprint").distinct(), "fingerprint", "left_anti").groupBy("fingerprint").agg(F.min("item").alias("item"))
    added = rows.join(first, ["fingerprint", "item"], "left_semi")
    counts = items.join(added.select("item", F.lit(1).alias("added")), "item", "left").groupBy("job_id").agg(F.count("added").alias("added"), F.count_if(F.col("added").isNull()).alias("skipped"))
    return added, counts
