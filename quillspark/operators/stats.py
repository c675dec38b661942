"""Counts, duplicates, quotas and the other reports of the store."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.filters import differs, within_days


def counts_by(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    """Rows by value, null values left out."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(name))


def type_summary(thoughts: DataFrame, classification: str | None = None) -> DataFrame:
    """total, first and last creation, and an object of counts by type, in one row."""
    rows = thoughts if classification is None else thoughts.where(F.col("classification") == classification)
    by = rows.groupBy("type").agg(F.count("*").alias("n"), F.min("created_at").alias("lo"), F.max("created_at").alias("hi"))
    entry = F.when(F.col("type").isNotNull(), F.struct("type", "n"))
    return by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.min("lo").alias("earliest"), F.max("hi").alias("latest"), F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("types"))


def top_items(df: DataFrame, column: str, most: int, name: str = "item") -> DataFrame:
    """The most frequent items of an array column, ties by item."""
    return df.select(F.explode(column).alias(name)).groupBy(name).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name).limit(most)


def summary_with_tops(thoughts: DataFrame, most: int = 10) -> DataFrame:
    """Counts by type, and the most frequent topics and people, as rows (section, item, n)."""
    sections = [thoughts.where("type IS NOT NULL").groupBy(F.col("type").alias("item")).agg(F.count("*").alias("n")).select(F.lit("type").alias("section"), "item", "n")]
    sections += [top_items(thoughts, c, most).select(F.lit(s).alias("section"), "item", "n") for s, c in (("topic", "topics"), ("person", "people"))]
    return reduce(DataFrame.union, sections)


def brain_stats(thoughts: DataFrame, as_of: datetime, days: int = 30, classification: str | None = None, exclude_restricted: bool = True, most: int = 20) -> DataFrame:
    """Rows (section, item, n): the total of all time, and the window's most frequent types (null
    among them) and topics; of one class, without restricted rows."""
    rows = thoughts.where(differs(F.col("sensitivity_tier"), "restricted")) if exclude_restricted else thoughts
    rows = rows if classification is None else rows.where(F.col("classification") == classification)
    fresh = rows.where(within_days(F.col("created_at"), as_of, days))
    types = fresh.groupBy(F.col("type").alias("item")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "item").limit(most)
    total = rows.agg(F.count("*").alias("n")).select(F.lit("total").alias("section"), F.lit(None).cast("string").alias("item"), "n")
    return total.union(types.select(F.lit("type"), "item", "n")).union(top_items(fresh, "topics", most).select(F.lit("topic"), "item", "n"))


def windowed_top(df: DataFrame, key: str, ts: str, as_of: datetime, days: int, most: int = 20) -> DataFrame:
    """The most frequent values of a window, ties by value, beside the total of all time."""
    total = df.agg(F.count("*").alias("total"))
    top = df.where(within_days(F.col(ts), as_of, days)).groupBy(key).agg(F.count("*").alias("n")).where(F.col(key).isNotNull())
    return top.orderBy(F.desc("n"), key).limit(most).crossJoin(F.broadcast(total))  # one row


def exact_duplicates(thoughts: DataFrame, mode: str = "full", ids: bool = False) -> DataFrame:
    """Fingerprints of several rows, with their number, first and last id, and with ``ids`` all of
    them in order (a fingerprint's ids then meet in one row)."""
    prints = thoughts.select(text.fingerprint(F.col("content"), mode).alias("fingerprint"), "serial_id").where("fingerprint <> ''")
    listed = [F.array_sort(F.collect_list("serial_id")).alias("ids")] if ids else []
    return prints.groupBy("fingerprint").agg(F.count("*").alias("copies"), F.min("serial_id").alias("first_id"), F.max("serial_id").alias("last_id"), *listed).where("copies > 1")


def latest_per_key(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of every key, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= n)


def lint(thoughts: DataFrame, links: DataFrame) -> DataFrame:
    """Rows that break a rule, with the rule's name: empty, very_long, low_signal, isolated."""
    content, trimmed = F.col("content"), text.trimmed(F.coalesce("content", F.lit("")))
    linked = links.select(F.col("thought_id").alias("serial_id"))
    isolated = thoughts.where("importance >= 4").join(linked, "serial_id", "left_anti").select("serial_id", F.lit("isolated").alias("rule"))
    rules = F.array_compact(F.array(
        F.when(trimmed == "", F.lit("empty")),
        F.when(F.char_length(content) > 20000, F.lit("very_long")),
        F.when((F.col("importance") <= 2) & (F.char_length(trimmed) < 40), F.lit("low_signal")),
    ))
    return thoughts.select("serial_id", F.explode(rules).alias("rule")).union(isolated)


def untagged(thoughts: DataFrame) -> DataFrame:
    """Rows without topics, tags and people."""
    none = lambda c: F.coalesce(F.size(F.col(f"metadata.{c}")), F.lit(0)) <= 0
    return thoughts.where(none("topics") & none("tags") & none("people"))


def over_tagged(thoughts: DataFrame, most: int = 10) -> DataFrame:
    return thoughts.where(F.size("metadata.tags") > most)


def sweep(thoughts: DataFrame, newest: int = 2000) -> DataFrame:
    """Counters of noise over the newest rows."""
    rows = thoughts.orderBy(F.desc("created_at"), F.desc("serial_id")).limit(newest)
    n = F.char_length(text.trimmed(F.coalesce("content", F.lit(""))))
    return rows.agg(F.count("*").alias("checked"), F.count_if(n == 0).alias("empty"), F.count_if(n < 40).alias("short"), F.count_if(n > 20000).alias("long"), F.count_if(F.col("sensitivity_tier").isNull()).alias("no_tier"))


def quota(edges: DataFrame, most: int) -> DataFrame:
    """Links of every node in either direction, the part of a quota, and its state."""
    degree = edges.select(F.explode(F.array("from_entity_id", "to_entity_id")).alias("entity_id")).groupBy("entity_id").agg(F.count("*").alias("degree"))
    used = F.col("degree") / F.lit(float(most))
    return degree.withColumn("used", used).withColumn("state", F.when(used >= 1, "over").when(used >= 0.8, "near").otherwise("ok"))


def thread_rollup(mail: DataFrame) -> DataFrame:
    """Messages, atoms, words (atoms' words, else the message's once), dates and subject by thread."""
    per = mail.groupBy("thread_id", "gmail_id").agg(
        F.count("*").alias("atoms"), F.sum("atom_word_count").alias("atom_words"), F.max("word_count").alias("words"),
        F.min("created_at").alias("first"), F.max("created_at").alias("last"), F.min_by("subject", F.struct("created_at", "subject")).alias("subject"),
    )
    return per.groupBy("thread_id").agg(
        F.count("*").alias("messages"), F.sum("atoms").alias("atoms"), F.sum(F.coalesce("atom_words", "words", F.lit(0))).alias("words"),
        F.min("first").alias("first_at"), F.max("last").alias("last_at"), F.min_by("subject", F.struct("first", "subject")).alias("subject"),
    )


def wiki_eligible(threads: DataFrame, words: int = 500, messages: int = 2, atoms: int = 3) -> DataFrame:
    return threads.where((F.col("words") >= words) & ((F.col("messages") >= messages) | (F.col("atoms") >= atoms)))


def year_buckets(thoughts: DataFrame, life_date: Column, most: int = 300) -> DataFrame:
    """Rows by the year of a life date, else of creation; the first ``most`` of each."""
    year = F.coalesce(F.nullif(F.regexp_extract(life_date, r"((?:19|20)\d{2})", 1), F.lit("")), F.year("created_at").cast("string"))
    return latest_per_key(thoughts.withColumn("year", year), "year", [F.col("created_at"), F.col("serial_id")], most)


def shopping_list(plans: DataFrame, recipes: DataFrame) -> DataFrame:
    """Ingredients of planned recipes by name and unit, their quantities joined in order."""
    items = plans.join(recipes, "recipe_id").select("plan_id", F.posexplode("ingredients").alias("pos", "i")).select("plan_id", "pos", "i.*")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("plan_id", "pos", "quantity"))), lambda s: s["quantity"]), " + ")
    return items.groupBy("name", "unit").agg(joined.alias("quantity"), F.count("*").alias("uses"))


def queue_status(queue: DataFrame, as_of: datetime) -> DataFrame:
    return queue.groupBy("status").agg(F.count("*").alias("n"), F.max(F.unix_timestamp(F.lit(as_of)) - F.unix_timestamp("queued_at")).alias("oldest_seconds"))


def last_failures(queue: DataFrame, n: int = 3) -> DataFrame:
    """The newest failed entries with their error."""
    return queue.where("status = 'failed'").orderBy(F.desc("processed_at"), "thought_id").limit(n).select("thought_id", "attempt_count", "last_error", "processed_at")


def pending_by_type(thoughts: DataFrame) -> DataFrame:
    """Thoughts that wait for review, by type; a missing type is its own bucket."""
    return thoughts.where("review_status = 'pending_review'").groupBy(F.coalesce("type", F.lit("unknown")).alias("type")).agg(F.count("*").alias("n"))


def evaluation_summary(scored: DataFrame) -> DataFrame:
    """Means of three scores and of their mean, in one row; empty without scores."""
    parts = ("existence", "relevance", "sufficiency")
    mean = reduce(Column.__add__, [F.col(c) for c in parts]) / 3
    return scored.agg(F.count("*").alias("n"), F.avg(mean).alias("average"), *[F.avg(c).alias(c) for c in parts]).where("n > 0")


def triage(items: DataFrame, as_of: datetime, stale_days: int = 14) -> DataFrame:
    age = F.datediff(F.lit(as_of), "created_at")
    bucket = F.when(F.col("status") == "active", "active").when(age <= stale_days, "waiting").otherwise("stale")
    return items.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def board(thoughts: DataFrame, as_of: datetime, lanes: tuple[str, ...] = ("new", "planning", "active", "review", "done", "archived"), archive_days: int = 30) -> DataFrame:
    """Rows by lane; done ones are archived in time, unknown states go to the backlog."""
    old = (F.col("status") == "done") & (F.datediff(F.lit(as_of), "status_updated_at") > archive_days)
    lane = F.when(old, "archived").when(F.col("status").isin(*lanes), F.col("status")).otherwise("backlog")
    return thoughts.groupBy(lane.alias("lane")).agg(F.count("*").alias("n"))


def digest_pool(thoughts: DataFrame, high: int = 4, enough: int = 10, few: int = 60, most: int = 200) -> DataFrame:
    """The most important, then newest rows: all important ones, or the first few if those are rare."""
    ranked = thoughts.orderBy(F.desc("importance"), F.desc("created_at"), "serial_id").limit(most)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance"), F.desc("created_at"), "serial_id")))  # at most `most` rows
    n = F.count_if(F.col("importance") >= high).over(Window.partitionBy())
    return ranked.withColumn("n_high", n).where(F.when(F.col("n_high") < enough, F.col("rank") <= few).otherwise(F.col("importance") >= high)).drop("n_high")


def persona_pool(found: DataFrame, seeds: list[int], most: int = 40, least: int = 3) -> DataFrame:
    """Thoughts for a persona page, seeded ones first, then by id; none if they are too few."""
    few = found.dropDuplicates(["serial_id"]).orderBy(F.when(F.col("serial_id").isin(seeds), 0).otherwise(1), "serial_id").limit(most)
    return few.withColumn("_n", F.count("*").over(Window.partitionBy())).where(F.col("_n") >= least).drop("_n")  # at most ``most`` rows


def recent_reports(reports: DataFrame, kind: str, n: int = 10) -> DataFrame:
    return reports.where(F.col("kind") == kind).orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def board_cards(thoughts: DataFrame, kinds: tuple[str, ...] = ("task", "idea"), per_kind: int = 100) -> DataFrame:
    """The most important cards of each kind, in one list by importance."""
    best = lambda k: thoughts.where(F.col("type") == k).orderBy(F.desc("importance"), F.desc("serial_id")).limit(per_kind)
    return reduce(DataFrame.union, map(best, kinds)).orderBy(F.desc("importance"), F.desc("serial_id"))


def reflections_of(entity_id: int, links: DataFrame, reflections: DataFrame, thoughts: DataFrame) -> DataFrame:
    """Reflections on an entity's thoughts with the thought's number and preview, newest first by type."""
    own = links.where(F.col("entity_id") == entity_id).select("thought_id").distinct()
    source = thoughts.select(F.col("id").alias("thought_id"), "serial_id", F.substring(F.regexp_replace(F.coalesce("content", F.lit("")), r"\s+", " "), 1, 160).alias("preview"))
    rows = reflections.join(own, "thought_id", "left_semi").join(source, "thought_id", "left")
    return rows.withColumn("reflection_type", F.coalesce("reflection_type", F.lit("general")))


def restricted_left_out(thoughts: DataFrame) -> DataFrame:
    return thoughts.where(differs(F.col("sensitivity_tier"), "restricted"))
