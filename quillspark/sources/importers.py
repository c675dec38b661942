"""Readers of common export formats; each gives rows ready for capture."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from . import json_array

#: Parts of chats that hold no knowledge.
SKIPPED_PARTS = ("thoughts", "reasoning_recap", "computer_output", "system_error", "super_widget", "citable_code_output", "tether_quote", "user_editable_context")


def canonical_path(nodes: DataFrame) -> DataFrame:
    """Nodes (conv_id, node_id, parent, ...) on the path from each conversation's current leaf
    (``is_current``, else its deepest, then largest node id) to its root, with their position.

    Pointers double: each round every node learns the ancestor twice as far, and the path takes in
    the ancestors of its own nodes, so a chat of n turns takes log n joins of n rows."""
    current = F.col("is_current") if "is_current" in nodes.columns else F.lit(False)
    # the nodes, which may be read from files, are read here and once more with all their columns
    base = nodes.select("conv_id", "node_id", "parent", F.coalesce(current, F.lit(False)).alias("c")).checkpoint()
    jump = base.select("conv_id", "node_id", F.col("parent").alias("to"), F.when(F.col("parent").isNotNull(), 1).otherwise(0).cast("bigint").alias("depth"))
    steps = [jump]
    while jump.where("to IS NOT NULL").limit(1).count():
        far = jump.select("conv_id", F.col("node_id").alias("to"), F.col("to").alias("far"), F.col("depth").alias("more"))
        jump = jump.join(far, ["conv_id", "to"], "left").select("conv_id", "node_id", F.col("far").alias("to"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")).checkpoint()
        steps.append(jump)
    depths = jump.select("conv_id", "node_id", "depth")
    line = base.join(depths, ["conv_id", "node_id"]).groupBy("conv_id").agg(F.max_by("node_id", F.struct("c", "depth", "node_id")).alias("node_id"))
    for step in steps:
        up = step.where("to IS NOT NULL").select("conv_id", "node_id", "to")
        line = line.union(line.join(up, ["conv_id", "node_id"]).select("conv_id", F.col("to").alias("node_id"))).checkpoint()
    return nodes.join(depths.join(line, ["conv_id", "node_id"], "left_semi"), ["conv_id", "node_id"]).withColumnRenamed("depth", "position")


#: The mark of a cited web source, and of a shown image.
CITED = r"\x{3010}\d+\x{2020}[^\x{3011}]*\x{3011}"
SHOWN_IMAGE = "<<ImageDisplayed>>"


def part_text(content_type: Column, parts: Column, spoken: Column | None = None, snippet: Column | None = None) -> Column:
    """The text of a chat message by its kind; null for kinds without knowledge.

    Text parts are joined by lines, ``spoken`` transcriptions after them; web pages lose their citation
    marks, code its fenced blocks, shown images all."""
    joined = lambda p: text.trimmed(F.array_join(F.filter(p, lambda x: x.isNotNull()), "\n"))
    none = F.array().cast("array<string>")
    own = joined(F.coalesce(parts, none))
    both = joined(F.concat(F.coalesce(parts, none), F.coalesce(spoken, none))) if spoken is not None else own
    uncited = lambda c: text.trimmed(F.regexp_replace(c, CITED, ""))
    return (
        F.when(content_type.isin(*SKIPPED_PARTS), None).when(content_type == "multimodal_text", both).when((content_type == "execution_output") & (own == SHOWN_IMAGE), "")
        .when(content_type == "tether_browsing_display", uncited(own)).when(content_type == "sonic_webpage", uncited(text.trimmed(F.coalesce(snippet, F.lit("")))) if snippet is not None else F.lit(""))
        .when(content_type == "code", text.trimmed(F.regexp_replace(own, r"(?s)```.*?```", ""))).otherwise(own)
    )


#: The part of a chat export that is read; parts that are objects come as JSON.
EXPORT = """id string, title string, create_time double, update_time double, current_node string, is_do_not_remember boolean,
  mapping map<string, struct<id:string, parent:string, message:struct<author:struct<role:string>, create_time:double, content:struct<content_type:string, parts:array<string>, snippet:string>>>>"""


def chat_export(spark: SparkSession, path: str, split_bytes: int = json_array.SPLIT_BYTES) -> DataFrame:
    """Conversations of an export folder or zip archives in it: conversations.json or numbered files
    of that name, each an array. Plain files of any size are read by ranges of ``split_bytes``; a zip
    archive, which cannot be read from within, is opened in one task."""

    def unzipped(batches):
        import io
        import zipfile

        import pandas as pd

        for pdf in batches:
            for raw in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    for name in sorted(z.namelist()):
                        if re.fullmatch(r"(.*/)?conversations(-\d+)?\.json", name):
                            yield pd.DataFrame({"value": [z.read(name).decode("utf-8-sig")]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    plain = files.option("pathGlobFilter", "conversations*.json").load(path).where(F.col("path").rlike(r"/conversations(-\d+)?\.json$"))
    found = sorted((r.path, r.length) for r in plain.select("path", "length").collect())  # the export's files
    element = f"struct<{EXPORT}>"
    zipped = files.option("pathGlobFilter", "*.zip").load(path).select("content").mapInPandas(unzipped, "value string")
    zipped = zipped.select(F.explode(F.from_json("value", f"array<{element}>")).alias("c"))
    return json_array.read(spark, found, EXPORT, split_bytes).drop("path", "position").unionByName(zipped.select("c.*"))


def chat_nodes(conversations: DataFrame) -> DataFrame:
    """Messages of an export as rows for ``canonical_path``, with role, kind and text."""
    rows = conversations.select(F.col("id").alias("conv_id"), "current_node", F.explode("mapping").alias("node_id", "n"))
    said, mixed = F.col("n.message.content"), F.col("n.message.content.content_type") == "multimodal_text"
    spoken = F.filter(F.transform(said["parts"], lambda p: F.get_json_object(p, "$.audio_transcription.text")), lambda t: t.isNotNull())
    written = F.when(mixed, F.filter(said["parts"], lambda p: ~p.startswith("{"))).otherwise(said["parts"])
    content = part_text(said["content_type"], written, spoken, said["snippet"])
    return rows.select("conv_id", "node_id", F.col("n.parent").alias("parent"), (F.col("node_id") == F.col("current_node")).alias("is_current"), F.col("n.message.author.role").alias("role"), content.alias("text"))


def dialogue(messages: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Conversations as 'User: ...' and 'Assistant: ...' paragraphs in order; other roles are left
    out. One conversation is one row: its turns meet in one group."""
    rows = messages.where(F.col("role").isin("user", "assistant"))
    line = F.concat(F.initcap("role"), F.lit(": "), F.coalesce("text", F.lit("")))
    turns = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(turns, lambda t: t["line"]), "\n\n").alias("dialogue"), F.count("*").alias("messages"))


def skip_reason(messages: Column, title: Column, dialogue_text: Column, imported: Column | None = None, newer: Column | None = None, day: Column | None = None, after=None, before=None, forget: Column | None = None, least: int = 2, always: int = 10, least_words: int = 50) -> Column:
    """Why a conversation is not imported, or null, by the first rule that holds: imported before and
    not changed since (``newer``), out of the dates wanted, marked to be forgotten, too few messages;
    many messages are always kept; no title and few messages, too few words."""
    no = F.lit(False)
    rules = F.when(F.coalesce(imported, no) & ~F.coalesce(newer, no), "already_imported") if imported is not None else F.when(no, None)
    if day is not None and after is not None:
        rules = rules.when(day < F.lit(after), "before_date_filter")
    if day is not None and before is not None:
        rules = rules.when(day > F.lit(before), "after_date_filter")
    if forget is not None:
        rules = rules.when(F.coalesce(forget, no), "do_not_remember")
    rules = rules.when(messages < least, "single_turn").when(messages >= always, None)
    return rules.when((F.coalesce(title, F.lit("")) == "") & (messages <= 5), "untitled_short").when(F.size(text.words(dialogue_text)) < least_words, "too_little_text")


def sessions(rows: DataFrame, key: str, ts: str, gap_seconds: int = 4 * 3600) -> DataFrame:
    """Rows with the number of their session: a gap of ``gap_seconds`` or more starts a new one."""
    w = Window.partitionBy(key).orderBy(ts)
    gap = F.unix_micros(ts) - F.unix_micros(F.lag(ts).over(w))
    starts = F.when(gap >= gap_seconds * 1_000_000, 1).otherwise(0)
    return rows.withColumn("_starts", starts).withColumn("session", F.sum("_starts").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))).drop("_starts")


def vault(spark: SparkSession, path: str) -> DataFrame:
    """Markdown notes: title, front matter lines, links, tags, chunks and date."""
    rows = spark.read.option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).text(path, wholetext=True).select("value", "_metadata.file_path", F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B"))).alias("file_name"), "_metadata.file_modification_time")
    front = F.regexp_extract("value", r"(?s)\A---\n(.*?)\n---\n", 1)
    body = F.regexp_replace("value", r"(?s)\A---\n.*?\n---\n", "")
    found = F.coalesce(F.try_to_date(F.nullif(F.regexp_extract(front, r"(?m)^date:\s*(\d{4}-\d{2}-\d{2})", 1), F.lit(""))), F.try_to_date(F.nullif(F.regexp_extract("file_name", r"(\d{4}-\d{2}-\d{2})", 1), F.lit(""))), F.to_date("file_modification_time"))
    return rows.select(F.regexp_replace("file_name", r"\.md$", "").alias("title"), front.alias("front_matter"), body.alias("content"), text.wikilinks(body).alias("links"), text.inline_tags(body).alias("tags"), text.heading_chunks(body).alias("chunks"), found.alias("date"), F.col("file_path").alias("path"))


def script_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of an exported script file: the array after the first bracket."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.explode(F.from_json(F.expr("substring(value, instr(value, '['))"), f"array<{schema}>")).alias("r")).select("r.*")


def batched(rows: DataFrame, key: Column, order: list[Column], size: int, body: str, sep: str = "\n\n") -> DataFrame:
    """Texts joined in batches of ``size`` by key, in order."""
    n = F.floor((F.row_number().over(Window.partitionBy("k").orderBy(*order)) - 1) / size)
    rows = rows.withColumn("k", key).withColumn("batch", n).withColumn("_n", F.row_number().over(Window.partitionBy("k").orderBy(*order)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", body))), lambda s: s[body]), sep)
    return rows.groupBy("k", "batch").agg(joined.alias("content"), F.count("*").alias("n"))


def tweets(rows: DataFrame, size: int = 20, least: int = 30) -> DataFrame:
    """Own posts (id, created_at, full_text) that are long enough, batched by day."""
    kept = rows.where(~F.col("full_text").startswith("RT @") & (F.char_length("full_text") >= least))
    return batched(kept, F.to_date("created_at").cast("string"), [F.col("created_at"), F.col("id")], size, "full_text")


def direct_messages(rows: DataFrame, least: int = 3, most: int | None = None) -> DataFrame:
    """Conversations (conversation_id, sender, ts, text) of enough messages, in time order."""
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy("conversation_id").orderBy("ts", "sender", "text")))
    if most is not None:
        ranked = ranked.where(F.col("_n") <= most)
    line = F.concat_ws(": ", "sender", "text")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", line.alias("line")))), lambda s: s["line"]), "\n")
    return ranked.groupBy("conversation_id").agg(joined.alias("content"), F.count("*").alias("messages"), F.min("ts").alias("first_at")).where(F.col("messages") >= least)


def repaired_encoding(c: Column) -> Column:
    """UTF-8 that was read as Latin-1; texts with other characters stay as they are."""
    return F.when(c.rlike(r"^[\x00-\x{ff}]*$") & c.rlike(r"[\x{c2}-\x{f4}][\x{80}-\x{bf}]"), F.decode(F.encode(c, "ISO-8859-1"), "UTF-8")).otherwise(c)


def is_activity_noise(category: Column, title: Column) -> Column:
    """Whether an activity says nothing: short titles and notifications; of maps all but searches, ways
    and long titles; of videos visits and short watched titles; of the browser short titles."""
    n, starts = F.char_length(title), lambda *ps: reduce(Column.__or__, [title.startswith(p) for p in ps])
    maps = starts("Visited ", "Viewed ", "Used maps", "Opened ") | (~starts("Searched for", "Direction", "Navigat") & (n < 30))
    video = (title.startswith("Watched ") & (n < 40)) | title.startswith("Visited ")
    noise = (n < 10) | title.rlike(r"^\d+ notification") | ((category == "Maps") & maps) | ((category == "YouTube") & video) | ((category == "Chrome") & (n < 15))
    return F.coalesce(noise, F.lit(True))


def activity_days(rows: DataFrame) -> DataFrame:
    """Activities (category, title, time) that say something, by category and day, in order of time."""
    rows = rows.where(~is_activity_noise(F.col("category"), F.col("title")))
    titles = F.transform(F.array_sort(F.collect_list(F.struct("time", "title"))), lambda s: s["title"])
    day = F.coalesce(F.nullif(F.substring("time", 1, 10), F.lit("")), F.lit("unknown"))
    return rows.groupBy("category", day.alias("day")).agg(F.array_join(titles, "\n").alias("content"), F.count("*").alias("n"))


def comments(rows: DataFrame, size: int = 50) -> DataFrame:
    """Comments (id, ts, text) in batches, in time order; ``captions`` in smaller ones."""
    return batched(rows.where(text.trimmed(F.col("text")) != ""), F.date_format("ts", "yyyy-MM"), [F.col("ts"), F.col("id")], size, "text", "\n")


def captions(rows: DataFrame, size: int = 30) -> DataFrame:
    return comments(rows, size)


def atom_feed(spark: SparkSession, path: str, least: int = 20) -> DataFrame:
    """Posts and comments of an Atom export as text."""
    schema = "id string, title string, content struct<_VALUE:string,_type:string>, published string, category array<struct<_term:string>>"
    rows = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    kind = F.regexp_extract(F.element_at(F.filter(F.transform("category", lambda c: c["_term"]), lambda t: t.contains("#")), 1), "#(.*)$", 1)
    body = text.html_stripped(F.col("content._VALUE"))
    return rows.select("id", "title", kind.alias("kind"), body.alias("content"), text.parsed_timestamp(F.col("published")).alias("published")).where(F.col("kind").isin("post", "comment") & (F.char_length("content") >= least))


def mail_body(encoded: Column) -> Column:
    """A base64url body as text."""
    return F.decode(F.unbase64(F.translate(encoded, "-_", "+/")), "UTF-8")


def without_quotes(body: Column) -> Column:
    """A mail's own text: cut at the quoted original and at the signature, without quoted lines."""
    cut = F.regexp_replace(body, r"(?s)\n(?:On [^\n]{5,200}wrote:|-{2,} ?Original Message ?-{2,}|From: [^\n]+\nSent: ).*$", "")
    cut = F.regexp_replace(cut, r"(?s)\n-- ?\n.*$", "")
    return text.trimmed(F.array_join(F.filter(F.split(cut, "\n"), lambda x: ~x.startswith(">")), "\n"))


#: What automatic mail looks like, in its sender, subject and body.
AUTOMATIC_SENDERS = ("no-reply", "noreply", "no.reply", "automated@", "donotreply", "notifications@", "mailer-daemon", "postmaster@")
AUTOMATIC_SUBJECTS = (
    r"\b(receipt|invoice|payment|autopay|billing)\b", r"\byour (order|booking|reservation|subscription)\b", r"\bconfirmation #", r"\bbooking #", r"\bpassword reset\b",
    r"\bverify your (email|account)\b", r"\bpayment (is )?due\b", r"\bpayment failed\b", r"\brequests? \$[\d,.]+",
)
AUTOMATIC_BODIES = ("reacted via gmail", "this message was automatically generated")


def is_automatic_mail(sender: Column, subject: Column, body: Column, auto_submitted: Column | None = None) -> Column:
    """Whether nobody wrote a mail: by its header, sender, subject, body, or style sheets in it."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    auto = low(auto_submitted) if auto_submitted is not None else F.lit("")
    tests = [(auto != "") & (auto != "no"), low(subject) == "unsubscribe", F.regexp_count(F.coalesce(body, F.lit("")), F.lit(r"\{[^}]*\}")) > 10]
    tests += [F.contains(low(body), F.lit(p)) for p in AUTOMATIC_BODIES] + [F.contains(low(sender), F.lit(p)) for p in AUTOMATIC_SENDERS] + [low(subject).rlike(p) for p in AUTOMATIC_SUBJECTS]
    return reduce(Column.__or__, tests)


def number_or_date(date_text: Column, millis: Column) -> Column:
    """A timestamp given as text or as a number of milliseconds in text."""
    return F.coalesce(text.parsed_timestamp(date_text), F.timestamp_millis(millis.try_cast("bigint")))


def flags(c: Column) -> Column:
    return F.lower(c).isin("true", "1", "yes")


def csv_summary(spark: SparkSession, path: str, sep: str = ",", preview: int = 5) -> dict:
    """Rows, columns, header and first rows of a delimited file; only the preview reaches the driver."""
    rows = spark.read.csv(path, header=True, sep=sep)
    return {"rows": rows.count(), "columns": len(rows.columns), "header": rows.columns, "preview": [r.asDict() for r in rows.limit(preview).collect()]}


def export_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Back up tables as JSON lines, a folder each."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def since(window: str, as_of: Column) -> Column | None:
    """The start of a named window (24h, 7d, 30d, 90d, 1y); None for all."""
    days = {"24h": 1, "7d": 7, "30d": 30, "90d": 90, "1y": 365}
    return None if window == "all" else as_of - F.make_dt_interval(F.lit(days[window]))


def kept_memories(rows: DataFrame, dropped: list[str]) -> DataFrame:
    """Rows in which none of the flag columns (written as text) is set."""
    for c in dropped:
        rows = rows.where(~F.coalesce(flags(F.col(c)), F.lit(False)))
    return rows


def profile_sentences(profile: Column) -> Column:
    """A map of lists as 'Label: a, b.' sentences in the order of the labels."""
    label = lambda k: F.initcap(F.replace(k, F.lit("_"), F.lit(" ")))
    entries = F.array_sort(F.map_entries(F.map_filter(profile, lambda _, v: F.size(v) > 0)))
    return F.array_join(F.transform(entries, lambda e: F.concat(label(e["key"]), F.lit(": "), F.array_join(e["value"], ", "), F.lit("."))), " ")


def chat_rows(rows: DataFrame) -> DataFrame:
    """Turns (conv_id, sender, message, date_text, millis) with normal roles and times, in order."""
    role = F.when(F.lower("sender").isin("human", "user"), "user").when(F.lower("sender").isin("assistant", "bot", "model", "ai"), "assistant").otherwise("system")
    rows = rows.select("conv_id", role.alias("role"), F.col("message").alias("text"), number_or_date(F.col("date_text"), F.col("millis")).alias("at"))
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("at"), "role", "text")) - 1)


#: Titles of searches that are not kept.
JUNK_TITLES = (
    r"^how many\s+", r"^what (time|date|day)\s", r"^when (does|did|is)\s", r"^how do you spell\s", r"^spell\s\w+\s*$", r"^convert\s+[\d.]+\s", r"^\d+\s*(\x{b0}|degrees)",
    r"^\d+\s*[+\-*/]\s*\d+", r"^(define|definition of)\s", r"^translate\s", r"^pronounce\s", r"^what does (.{1,30})\s+mean\s*\??$", r"^image\.(jpg|png|jpeg|webp)\s*$",
)


def junk_reason(title: Column, answer: Column, patterns: tuple[str, ...] = JUNK_TITLES, least: int = 400) -> Column:
    """Why a search is not kept, or null: no answer, a short one, or a title of trivia."""
    n, name = F.char_length(text.trimmed(F.coalesce(answer, F.lit("")))), text.trimmed(F.coalesce(title, F.lit("")))
    return F.when(n == 0, "empty_answer").when(n < least, "short_answer").when(reduce(Column.__or__, [name.rlike(f"(?i){p}") for p in patterns]), "trivia_title")


def searches(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame:
    """Searches (title, answer, asked) of an export as delimited text with a header, or as JSON."""
    rows = spark.read.json(path, multiLine=True) if kind == "json" else spark.read.csv(path, header=True, multiLine=True, escape='"')
    names = {c.lower().replace(" ", "_"): c for c in rows.columns}
    first = lambda *cs: F.coalesce(*[F.col(f"`{names[c]}`").cast("string") for c in cs if c in names], F.lit(None).cast("string"))
    return rows.select(first("title", "query", "question").alias("title"), first("answer", "answer_text", "response").alias("answer"), text.parsed_timestamp(first("created_at", "date", "timestamp")).alias("asked"))


def memory_export(spark: SparkSession, path: str, dropped: tuple[str, ...] = ("IS_DELETED", "IS_FORGOTTEN")) -> DataFrame:
    """Rows of a delimited memory export that are neither deleted nor forgotten."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return kept_memories(rows, [c for c in dropped if c in rows.columns])
